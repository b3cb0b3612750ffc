"""Independent DuckDB SQL for every query that has a SQL form.

The driver registers the raw tables as views; each oracle rebuilds the
fixture view it needs as a CTE and then states the operator in plain SQL.
"""

from __future__ import annotations

# ---- fixture views (FIXTURES.md), DuckDB dialect -------------------------

FX_RESPONDENT = """
WITH asked AS (SELECT o_custkey, SUM(o_totalprice) AS spend FROM orders
  WHERE o_orderpriority='1-URGENT' AND o_orderdate >= TIMESTAMP '2000-06-01 00:00:00' GROUP BY o_custkey),
lines AS (SELECT o_custkey, l_returnflag, p_type FROM orders
  JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey
  WHERE o_orderpriority='1-URGENT' AND o_orderdate >= TIMESTAMP '2000-06-01 00:00:00'),
cells AS (SELECT o_custkey,
  COALESCE(array_to_string(list_sort(list(DISTINCT p_type) FILTER (l_returnflag='R')),';'),'') AS have_cell,
  COALESCE(array_to_string(list_sort(list(DISTINCT p_type) FILTER (l_returnflag='A')),';'),'') AS want_cell,
  COUNT(CASE WHEN l_returnflag='R' THEN 1 END) AS n_ret FROM lines GROUP BY o_custkey),
hist AS (SELECT o_custkey, COUNT(*) AS n_orders, MIN(o_orderkey) AS first_key FROM orders GROUP BY o_custkey)
SELECT c_custkey AS respondent_id, c_mktsegment AS segment, n_name AS country,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN f.o_orderstatus='F' THEN 'Yes'
       WHEN f.o_orderstatus='O' THEN 'Soon' ELSE 'No' END AS outcome,
  CASE WHEN n_orders < 6 THEN 'Less than 1 year' WHEN n_orders > 15 THEN 'More than 50 years'
       ELSE CAST(n_orders AS VARCHAR) END AS years_text,
  asked.spend AS spend,
  CASE WHEN asked.o_custkey IS NOT NULL THEN COALESCE(n_ret,0) END AS n_returns,
  CASE WHEN asked.o_custkey IS NOT NULL THEN COALESCE(have_cell,'') END AS have_cell,
  CASE WHEN asked.o_custkey IS NOT NULL THEN COALESCE(want_cell,'') END AS want_cell
FROM customer JOIN nation ON n_nationkey=c_nationkey
LEFT JOIN asked ON asked.o_custkey=c_custkey LEFT JOIN cells ON cells.o_custkey=c_custkey
LEFT JOIN hist ON hist.o_custkey=c_custkey LEFT JOIN orders f ON f.o_orderkey=hist.first_key
"""

FX_RESPONDENT_BOTH = """
SELECT *, CASE WHEN have_cell IS NULL THEN NULL ELSE COALESCE(array_to_string(list_sort(
  list_intersect(string_split(NULLIF(have_cell,''),';'), string_split(NULLIF(want_cell,''),';'))),';'),'') END
  AS both_cell FROM fx
"""

FX_DOC = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

FX_SCORES = """
SELECT doc_id, quality AS label, CAST(n_chars % 97 AS DOUBLE) / 97e0 AS score
FROM fx_doc WHERE quality IS NOT NULL
"""


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with every fixture view as a CTE (unused ones are pruned)."""
    return (
        "WITH fx AS (" + FX_RESPONDENT + "),\n"
        "fxb AS (" + FX_RESPONDENT_BOTH + "),\n"
        "fx_doc AS (" + FX_DOC + "),\n"
        "fx_scores AS (" + FX_SCORES + ")\n" + body
    )


ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = with_fixtures(body)


# ---- multi-select ---------------------------------------------------------

_LONG = """
SELECT respondent_id, question, value FROM (
  SELECT respondent_id, 'have_cell' AS question, unnest(string_split(have_cell, ';')) AS value FROM fxb WHERE have_cell IS NOT NULL
  UNION ALL
  SELECT respondent_id, 'want_cell', unnest(string_split(want_cell, ';')) FROM fxb WHERE want_cell IS NOT NULL
  UNION ALL
  SELECT respondent_id, 'both_cell', unnest(string_split(both_cell, ';')) FROM fxb WHERE both_cell IS NOT NULL
) t WHERE value <> ''
"""

oracle("multiselect_long", _LONG)

_COUNTS = """
counts AS (SELECT question, value, COUNT(DISTINCT respondent_id) AS n FROM (""" + _LONG + """) l GROUP BY question, value)
"""

oracle(
    "top_options",
    ", " + _COUNTS.strip() + """
SELECT question, value, n, rank FROM (
  SELECT question, value, n, CAST(row_number() OVER (PARTITION BY question ORDER BY n DESC, value ASC) AS INTEGER) AS rank FROM counts
) WHERE rank <= 3
""",
)

oracle(
    "have_vs_want",
    ", " + _COUNTS.strip() + """,
top AS (SELECT value, n AS have_n, CAST(row_number() OVER (ORDER BY n DESC, value ASC) AS INTEGER) AS rank
        FROM counts WHERE question = 'have_cell' QUALIFY rank <= 4),
wide AS (SELECT top.value, top.rank, top.have_n, w.n AS want_n
         FROM top LEFT JOIN counts w ON w.question = 'want_cell' AND w.value = top.value)
SELECT value, 'have' AS kind, CAST(have_n AS DOUBLE) AS n, rank FROM wide
UNION ALL SELECT value, 'want' AS kind, CAST(want_n AS DOUBLE) AS n, rank FROM wide
""",
)

oracle(
    "detect_multiselect",
    """
SELECT 'segment' AS column_name, COALESCE(bool_or(contains(segment, ';')), false) AS is_multiselect FROM fx
UNION ALL SELECT 'country', COALESCE(bool_or(contains(country, ';')), false) FROM fx
UNION ALL SELECT 'outcome', COALESCE(bool_or(contains(outcome, ';')), false) FROM fx
UNION ALL SELECT 'years_text', COALESCE(bool_or(contains(years_text, ';')), false) FROM fx
UNION ALL SELECT 'have_cell', COALESCE(bool_or(contains(have_cell, ';')), false) FROM fx
UNION ALL SELECT 'want_cell', COALESCE(bool_or(contains(want_cell, ';')), false) FROM fx
""",
)

P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _multihot_cols(q: str) -> str:
    parts = [f"{q} IS NOT NULL AS {q}__answered"]
    for t in P_TYPES:
        parts.append(
            f"CAST(COALESCE(list_contains(string_split(NULLIF({q},''),';'), '{t}'), false) AS TINYINT) AS {q}__{t}"
        )
    return ",\n  ".join(parts)


oracle(
    "multihot",
    "SELECT respondent_id, segment, country,\n  "
    + _multihot_cols("have_cell")
    + ",\n  "
    + _multihot_cols("want_cell")
    + "\nFROM fxb",
)

oracle(
    "answered_flag",
    """
SELECT respondent_id, have_cell IS NOT NULL AS have_cell__answered,
       want_cell IS NOT NULL AS want_cell__answered FROM fx
""",
)

oracle(
    "set_intersection_check",
    """
SELECT COUNT(*) AS n_rows,
       COUNT(*) FILTER (WHERE both_cell IS NOT DISTINCT FROM
         CASE WHEN have_cell IS NULL THEN NULL ELSE COALESCE(array_to_string(list_sort(
           list_intersect(string_split(NULLIF(have_cell,''),';'), string_split(NULLIF(want_cell,''),';'))),';'),'') END) AS n_match,
       COUNT(*) FILTER (WHERE both_cell IS DISTINCT FROM
         CASE WHEN have_cell IS NULL THEN NULL ELSE COALESCE(array_to_string(list_sort(
           list_intersect(string_split(NULLIF(have_cell,''),';'), string_split(NULLIF(want_cell,''),';'))),';'),'') END) AS n_mismatch
FROM fxb
""",
)

oracle(
    "response_rate_by_class",
    """
SELECT question, outcome, COUNT(*) AS n, AVG(CASE WHEN cell IS NOT NULL THEN 1e0 ELSE 0e0 END) * 100e0 AS answer_rate
FROM (SELECT outcome, 'have_cell' AS question, have_cell AS cell FROM fx WHERE outcome IS NOT NULL
      UNION ALL SELECT outcome, 'want_cell', want_cell FROM fx WHERE outcome IS NOT NULL
      UNION ALL SELECT outcome, 'spend', CAST(spend AS VARCHAR) FROM fx WHERE outcome IS NOT NULL) t
GROUP BY question, outcome
""",
)


# ---- cleaning ----------------------------------------------------------------

_YEARS = """CASE WHEN years_text = 'Less than 1 year' THEN 0.5e0 WHEN years_text = 'More than 50 years' THEN 51e0
  ELSE TRY_CAST(years_text AS DOUBLE) END"""
_SEGNUM = """CASE segment WHEN 'AUTOMOBILE' THEN 1e0 WHEN 'BUILDING' THEN 2e0 WHEN 'FURNITURE' THEN 3e0
  WHEN 'HOUSEHOLD' THEN 4e0 WHEN 'MACHINERY' THEN NULL END"""

oracle(
    "clean_silver",
    f"""SELECT respondent_id, segment, country, outcome, {_YEARS} AS years_text, spend, have_cell, want_cell,
  {_SEGNUM} AS segmentNum FROM fx""",
)
oracle("sentinel_numeric", f"SELECT respondent_id, {_YEARS} AS years FROM fx")
oracle(
    "strict_violations",
    f""", bad AS (SELECT 'years_text' AS column_name, 'number' AS rule, years_text AS value FROM (SELECT years_text, {_YEARS} AS y FROM fx)
  WHERE years_text IS NOT NULL AND y IS NULL
  UNION ALL SELECT 'country', 'number', country FROM fx WHERE country IS NOT NULL AND TRY_CAST(country AS DOUBLE) IS NULL
  UNION ALL SELECT 'segment', 'label', segment FROM fx WHERE segment = 'BUILDING'),
counted AS (SELECT column_name, rule, value, COUNT(*) AS n FROM bad GROUP BY column_name, rule, value),
vals AS (SELECT *, row_number() OVER (PARTITION BY column_name, rule ORDER BY value) AS place FROM counted)
SELECT column_name, rule, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_values, string_agg(value, '|' ORDER BY value) FILTER (WHERE place <= 5) AS examples
FROM vals GROUP BY ALL""",
)
oracle(
    "lenient_numeric",
    f"""SELECT respondent_id, {_YEARS.replace('years_text', 'trim(years_text)')} AS years_text,
  CASE WHEN trim(segment) = 'Less than 1 year' THEN 0.5e0 WHEN trim(segment) = 'More than 50 years' THEN 51e0
  ELSE TRY_CAST(trim(segment) AS DOUBLE) END AS segment FROM fx""",
)
oracle("ordinal_encode", f"SELECT respondent_id, segment, {_SEGNUM} AS segmentNum FROM fx")
oracle(
    "unknown_values",
    "SELECT DISTINCT segment AS value FROM fx WHERE segment IS NOT NULL "
    "AND segment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD')",
)
oracle(
    "binary_label",
    "SELECT respondent_id, outcome, CAST(outcome = 'Yes' AS INTEGER) AS target FROM fx WHERE outcome IS NOT NULL",
)
oracle(
    "trim_to_quantile",
    """, b AS (SELECT quantile_cont(spend, 0.01) AS lo, quantile_cont(spend, 0.99) AS hi FROM fx)
SELECT respondent_id, CASE WHEN spend >= lo AND spend <= hi THEN spend END AS spend_trimmed FROM fx, b""",
)
oracle(
    "leak_family_drop",
    "SELECT respondent_id, segment, country,\n  " + _multihot_cols("have_cell") + "\nFROM fxb",
)
oracle(
    "row_invariants",
    """SELECT COUNT(*) AS silver_rows, COUNT(DISTINCT respondent_id) AS distinct_ids, COUNT(*) AS wide_rows,
  9 AS silver_cols, 17 AS wide_cols FROM fx""",
)

# ---- rates ---------------------------------------------------------------------

_LABELLED = f"""lab AS (SELECT *, CAST(outcome = 'Yes' AS INTEGER) AS target,
  {_YEARS.replace('years_text', 'trim(years_text)')} AS years FROM fx WHERE outcome IS NOT NULL)"""

oracle(
    "rate_by_country",
    ", " + _LABELLED + """
SELECT country, AVG(CAST(target AS DOUBLE)) * 100e0 AS rate, COUNT(target) AS n FROM lab
GROUP BY country HAVING COUNT(target) >= 60""",
)

_XBANDS = [("junior (0-3)", -1, 3), ("mid (4-10)", 3, 10), ("senior (11+)", 10, 100)]
_XBAND_SQL = "CASE " + " ".join(f"WHEN years > {lo} AND years <= {hi} THEN '{lab}'" for lab, lo, hi in _XBANDS) + " END"

oracle(
    "rate_by_option_and_band",
    ", " + _LABELLED + f""",
rows AS (SELECT trim(unnest(string_split(have_cell, ';'))) AS option, target, {_XBAND_SQL} AS band
         FROM lab WHERE have_cell IS NOT NULL AND years IS NOT NULL),
top AS (SELECT option FROM rows GROUP BY option ORDER BY COUNT(*) DESC, option ASC LIMIT 10),
kept AS (SELECT * FROM rows WHERE option IN (SELECT option FROM top)),
agg AS (SELECT option, 'all' AS band, AVG(CAST(target AS DOUBLE)) * 100e0 AS rate, COUNT(target) AS n FROM kept GROUP BY option
        UNION ALL
        SELECT option, band, AVG(CAST(target AS DOUBLE)) * 100e0, COUNT(target) FROM kept WHERE band IS NOT NULL GROUP BY option, band),
grid AS (SELECT option, b.band FROM top, (VALUES ('all'), ('junior (0-3)'), ('mid (4-10)'), ('senior (11+)')) b(band))
SELECT grid.option, grid.band, agg.rate, CAST(agg.n AS DOUBLE) AS n FROM grid LEFT JOIN agg ON agg.option = grid.option AND agg.band = grid.band""",
)

_CBANDS = [("0-2", 0, 2), ("3-5", 2, 5), ("6-10", 5, 10), ("11-15", 10, 15), ("16-20", 15, 20), ("21-30", 20, 30), ("30+", 30, 60)]
_CBAND_SQL = "CASE " + " ".join(
    (f"WHEN years >= {lo} AND years <= {hi} THEN '{lab}'" if i == 0 else f"WHEN years > {lo} AND years <= {hi} THEN '{lab}'")
    for i, (lab, lo, hi) in enumerate(_CBANDS)
) + " END"

oracle(
    "rate_by_band",
    ", " + _LABELLED + f"""
SELECT band, AVG(CAST(target AS DOUBLE)) * 100e0 AS rate, COUNT(target) AS n
FROM (SELECT *, {_CBAND_SQL} AS band FROM lab WHERE years IS NOT NULL) t WHERE band IS NOT NULL GROUP BY band""",
)

oracle(
    "rate_two_way",
    ", " + _LABELLED + f""",
b AS (SELECT *, {_CBAND_SQL} AS band FROM lab),
agg AS (SELECT segment, band, AVG(CAST(target AS DOUBLE)) AS rate, COUNT(*) AS n FROM b
        WHERE segment IS NOT NULL AND band IS NOT NULL AND target IS NOT NULL GROUP BY segment, band),
grid AS (SELECT s.segment, c.band FROM (SELECT DISTINCT segment FROM fx) s,
         (VALUES {", ".join(f"('{lab}')" for lab, _, _ in _CBANDS)}) c(band))
SELECT grid.segment, grid.band, agg.rate, COALESCE(agg.n, 0) AS n
FROM grid LEFT JOIN agg ON agg.segment = grid.segment AND agg.band = grid.band""",
)

oracle(
    "indicator_rate_two_way",
    """SELECT segment, outcome, AVG(CAST(CAST(n_returns > 0 AS INTEGER) AS DOUBLE)) AS rate,
  COUNT(CAST(n_returns > 0 AS INTEGER)) AS n
FROM fx WHERE segment IS NOT NULL AND outcome IS NOT NULL GROUP BY segment, outcome""",
)


# ---- profiles --------------------------------------------------------------------

_YEARS_L = _YEARS.replace("years_text", "trim(years_text)")


def _union(pairs: list[tuple[str, str]], source: str, value_name: str = "value") -> str:
    return "\n  UNION ALL ".join(f"SELECT '{name}' AS \"column\", {expr} AS {value_name} FROM {source}" for name, expr in pairs)


oracle(
    "value_counts_pct",
    ", long AS (" + _union([("segment", "segment"), ("outcome", "outcome"), ("years_text", "years_text")], "fx") + """)
SELECT "column", value, COUNT(*) AS n, COUNT(*) * 100e0 / SUM(COUNT(*)) OVER (PARTITION BY "column") AS pct
FROM long GROUP BY "column", value""",
)

oracle(
    "target_distribution",
    """SELECT CAST(CAST(outcome = 'Yes' AS INTEGER) AS VARCHAR) AS target, COUNT(*) AS n,
  COUNT(*) * 100e0 / SUM(COUNT(*)) OVER () AS pct FROM fx WHERE outcome IS NOT NULL GROUP BY 1""",
)

oracle(
    "ordered_counts",
    """SELECT outcome, COUNT(*) AS n, CAST(row_number() OVER (ORDER BY
  CASE outcome WHEN 'Yes' THEN 0 WHEN 'Soon' THEN 1 WHEN 'No' THEN 2 ELSE 3 END, COUNT(*) DESC, outcome) AS INTEGER) AS position
FROM fx WHERE outcome IS NOT NULL GROUP BY outcome""",
)

oracle(
    "numeric_profile",
    ", long AS (" + _union([("years", _YEARS_L), ("n_returns", "CAST(n_returns AS DOUBLE)")], "fx", "x") + """),
b AS (SELECT "column", COUNT(x) AS n, COUNT(*) - COUNT(x) AS missing, MIN(x) AS min, MAX(x) AS max,
  quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi, quantile_cont(x, 0.5) AS median FROM long GROUP BY "column"),
c AS (SELECT long."column", LEAST(GREATEST(x, lo), hi) AS x FROM long JOIN b ON b."column" = long."column" WHERE x IS NOT NULL),
m AS (SELECT "column", AVG(x) AS mean, VAR_SAMP(x) AS variance, STDDEV_SAMP(x) AS sd,
  skewness(x) * (COUNT(x) - 2) / SQRT(COUNT(x) * (COUNT(x) - 1)) AS skewness, kurtosis_pop(x) AS kurtosis FROM c GROUP BY "column")
SELECT b."column", n, missing, min, max, mean, variance, sd, median, skewness, kurtosis
FROM b JOIN m ON m."column" = b."column" WHERE n >= 2""",
)

oracle(
    "numeric_summary",
    """SELECT 'n_chars' AS "column", COUNT(x) AS count, AVG(x) AS mean, STDDEV_SAMP(x) AS std, MIN(x) AS min,
  quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, MAX(x) AS max
FROM (SELECT CAST(n_chars AS DOUBLE) AS x FROM fx_doc) t""",
)

oracle(
    "category_profile",
    ", long AS ("
    + _union([(c, c) for c in ["segment", "country", "outcome", "years_text", "have_cell"]], "fx")
    + """),
cnt AS (SELECT "column", value, COUNT(*) AS c FROM long WHERE value IS NOT NULL GROUP BY "column", value),
pc AS (SELECT "column", SUM(c) AS n, COUNT(*) AS nd, MAX(c) AS mode_count FROM cnt GROUP BY "column"),
md AS (SELECT cnt."column", MIN(value) AS mode FROM cnt JOIN pc ON cnt."column" = pc."column" AND c = mode_count GROUP BY cnt."column"),
ms AS (SELECT "column", COUNT(*) - COUNT(value) AS missing FROM long GROUP BY "column")
SELECT pc."column", CAST(n AS BIGINT) AS n, missing, nd AS "distinct", mode, mode_count, mode_count * 100e0 / n AS mode_pct
FROM pc JOIN md ON md."column" = pc."column" JOIN ms ON ms."column" = pc."column\"""",
)

oracle(
    "quantiles",
    "\n  UNION ALL ".join(
        f"SELECT 'n_chars' AS \"column\", {p}e0 AS prob, quantile_cont(CAST(n_chars AS DOUBLE), {p}) AS value FROM fx_doc"
        for p in ["0.005", "0.01", "0.5", "0.99", "0.995"]
    ),
)


def _histogram_sql(expr: str, source: str, bins: int) -> str:
    return f""", v AS (SELECT {expr} AS x FROM {source}),
r AS (SELECT MIN(x) AS lo, MAX(x) AS hi, CASE WHEN MAX(x) > MIN(x) THEN (MAX(x) - MIN(x)) / {bins}e0 ELSE 1e0 END AS w
      FROM v WHERE x IS NOT NULL AND NOT isnan(x)),
e0 AS (SELECT floor((x - lo) / w) AS est, x, lo, w FROM v, r WHERE x IS NOT NULL AND NOT isnan(x)),
e1 AS (SELECT CASE WHEN lo + est * w > x THEN est - 1 ELSE est END AS est, x, lo, w FROM e0),
e2 AS (SELECT CASE WHEN lo + (est + 1) * w <= x THEN est + 1 ELSE est END AS est FROM e1),
cnt AS (SELECT CAST(LEAST(GREATEST(est, 0), {bins - 1}) AS INTEGER) AS bin, COUNT(*) AS n FROM e2 GROUP BY 1),
grid AS (SELECT CAST(i AS INTEGER) AS bin, lo + CAST(i AS INTEGER) * w AS lower, lo + (CAST(i AS INTEGER) + 1) * w AS upper
         FROM r, range({bins}) t(i))
SELECT grid.bin, lower, upper, COALESCE(cnt.n, 0) AS n FROM grid LEFT JOIN cnt ON cnt.bin = grid.bin"""


oracle("histogram", _histogram_sql(_YEARS_L, "fx", 30))
oracle("histogram_log", _histogram_sql("log10(n_chars)", "fx_doc", 50))

# ---- association ----------------------------------------------------------------------

_NUM = f"nums AS (SELECT spend, CAST(n_returns AS DOUBLE) AS n_returns, {_YEARS_L} AS years, 7.5e0 AS unit, outcome FROM fx)"
_NUMBERS = ["spend", "n_returns", "years", "unit"]
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


_PAIRS_SQL = "\n  UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {_corr(a, b)} AS r FROM nums"
    for a, b in _PAIRS
)
_TIER_R = "CASE WHEN r IS NULL THEN NULL WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'medium' ELSE 'weak' END"

oracle(
    "correlation_matrix",
    ", "
    + _NUM
    + "\n"
    + "\n  UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        + (f"CASE WHEN stddev_samp({a}) > 0 THEN 1e0 END" if a == b else _corr(a, b))
        + " AS r FROM nums"
        for a in _NUMBERS
        for b in _NUMBERS
    ),
)
oracle(
    "correlation_pairs",
    ", "
    + _NUM
    + ", pairs AS ("
    + _PAIRS_SQL
    + f") SELECT var1, var2, n, r, {_TIER_R} AS strength, "
    + "row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, var1, var2) AS position FROM pairs WHERE n >= 3",
)


def _ranked(body: str, by: str) -> str:
    cut = body.rindex("\nSELECT variable, CAST(n")
    return f"{body[:cut]}, tests AS ({body[cut:]})\nSELECT *, row_number() OVER (ORDER BY {by} DESC NULLS LAST, variable) AS position FROM tests"



def _chi_sql(long_sql: str) -> str:
    return f""", long AS ({long_sql}),
cells AS (SELECT variable, value, target, COUNT(*) AS o FROM long GROUP BY ALL),
rt AS (SELECT variable, value, SUM(o) AS rt FROM cells GROUP BY ALL),
ct AS (SELECT variable, target, SUM(o) AS ct FROM cells GROUP BY ALL),
nn AS (SELECT variable, SUM(o) AS n, COUNT(DISTINCT value) AS nr, COUNT(DISTINCT target) AS nc FROM cells GROUP BY ALL),
grid AS (SELECT rt.variable, rt.value, ct.target, rt.rt, ct.ct FROM rt JOIN ct ON rt.variable = ct.variable),
full_t AS (SELECT g.variable, CAST(COALESCE(cells.o, 0) AS DOUBLE) AS o, g.rt * g.ct * 1e0 / nn.n AS e, nn.n, nn.nr, nn.nc
  FROM grid g LEFT JOIN cells ON cells.variable = g.variable AND cells.value = g.value AND cells.target = g.target
  JOIN nn ON nn.variable = g.variable),
stat AS (SELECT variable, n, nr, nc, (nr - 1) * (nc - 1) AS dof,
  SUM(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN power(greatest(abs(o - e) - 0.5, 0), 2) / e ELSE power(o - e, 2) / e END) AS chi2
  FROM full_t GROUP BY ALL)
SELECT variable, CAST(n AS BIGINT) AS n, CASE WHEN dof = 0 THEN 0e0 ELSE chi2 END AS chi2, CAST(dof AS BIGINT) AS dof,
  sqrt((CASE WHEN dof = 0 THEN 0e0 ELSE chi2 END) / (n * (least(nr, nc) - 1))) AS cramers_v,
  CASE WHEN sqrt(chi2 / (n * (least(nr, nc) - 1))) >= 0.3 THEN 'strong'
       WHEN sqrt(chi2 / (n * (least(nr, nc) - 1))) >= 0.1 THEN 'medium' ELSE 'weak' END AS strength
FROM stat"""


oracle(
    "chi_square",
    _ranked(
        _chi_sql(
            "\n  UNION ALL ".join(
                f"SELECT '{v}' AS variable, {v} AS value, outcome AS target FROM fx WHERE {v} IS NOT NULL AND outcome IS NOT NULL"
                for v in ["segment", "country", "years_text"]
            )
        ),
        "cramers_v",
    ),
)
oracle(
    "chi_square_2x2",
    _chi_sql(
        "SELECT 'toxic' AS variable, CAST(toxic AS VARCHAR) AS value, CAST(quality AS VARCHAR) AS target "
        "FROM fx_doc WHERE toxic IS NOT NULL AND quality IS NOT NULL"
    ),
)

_GROUPS = ", " + _NUM + """, g AS (
  SELECT variable, outcome, COUNT(*) AS n_g, AVG(x) AS mean_g, VAR_POP(x) AS var_g FROM (
    SELECT 'years' AS variable, outcome, years AS x FROM nums UNION ALL SELECT 'n_returns', outcome, n_returns FROM nums
  ) t WHERE x IS NOT NULL AND outcome IS NOT NULL GROUP BY ALL)"""

oracle(
    "anova",
    _ranked(
        _GROUPS
        + """,
tot AS (SELECT variable, SUM(n_g) AS n, COUNT(*) AS k, SUM(n_g * mean_g) / SUM(n_g) AS grand FROM g GROUP BY variable),
ss AS (SELECT g.variable, tot.n, tot.k, SUM(n_g * power(mean_g - grand, 2)) AS ssb, SUM(n_g * var_g) AS ssw
       FROM g JOIN tot ON tot.variable = g.variable GROUP BY ALL HAVING tot.k >= 2)
SELECT variable, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, (ssb / (k - 1)) / (ssw / (n - k)) AS f_statistic,
  CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) END AS eta_squared,
  CASE WHEN ssb / (ssb + ssw) >= 0.14 THEN 'large' WHEN ssb / (ssb + ssw) >= 0.06 THEN 'medium' ELSE 'small' END AS effect
FROM ss""",
        "eta_squared",
    ),
)
oracle("group_mean_sd", _GROUPS + "\nSELECT variable, outcome, n_g AS n, mean_g AS mean, sqrt(var_g) AS sd FROM g")
oracle(
    "crosstab",
    """SELECT segment, COUNT(*) FILTER (WHERE outcome = 'No') AS "No", COUNT(*) FILTER (WHERE outcome = 'Soon') AS "Soon",
  COUNT(*) FILTER (WHERE outcome = 'Yes') AS "Yes" FROM fx WHERE segment IS NOT NULL AND outcome IS NOT NULL GROUP BY segment""",
)
oracle(
    "regression_line",
    ", " + _NUM + """, cap AS (SELECT quantile_cont(spend, 0.99) AS c FROM nums)
SELECT COUNT(*) AS n, regr_slope(spend, years) AS slope, regr_intercept(spend, years) AS intercept, regr_r2(spend, years) AS r2
FROM nums, cap WHERE spend <= c AND years IS NOT NULL""",
)


# ---- split ---------------------------------------------------------------------------

_MODEL = f"""model AS (SELECT respondent_id, CAST(outcome = 'Yes' AS INTEGER) AS target, segment, country, spend,
  {_YEARS_L} AS years, n_returns, {_SEGNUM} AS segmentNum FROM fx WHERE outcome IS NOT NULL)"""


def _split_ctes(source: str, id_col: str, cls: str) -> str:
    """Exact stratified split: ceil(0.2 N) test rows, largest-remainder class
    quotas, first rows of each class in md5('42:<id>') order."""
    return f"""cn AS (SELECT {cls} AS cls, COUNT(*) AS n FROM {source} GROUP BY {cls}),
tot AS (SELECT CAST(SUM(n) AS BIGINT) AS nn, CAST(CEIL(0.2e0 * SUM(n)) AS BIGINT) AS tt FROM cn),
q0 AS (SELECT cls, (tt * n) // nn AS base, (tt * n) % nn AS rem FROM cn, tot),
q1 AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls)
         <= (SELECT tt FROM tot) - (SELECT SUM(base) FROM q0) THEN 1 ELSE 0 END AS quota FROM q0),
ranked AS (SELECT {id_col}, {cls}, row_number() OVER (PARTITION BY {cls}
         ORDER BY md5(concat('42:', CAST({id_col} AS VARCHAR))), {id_col}) AS rn FROM {source}),
split AS (SELECT ranked.{id_col}, ranked.{cls}, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
          FROM ranked JOIN q1 ON q1.cls = ranked.{cls})"""


_SPLIT = ", " + _MODEL + ",\n" + _split_ctes("model", "respondent_id", "target")

oracle("stratified_split", _SPLIT + "\nSELECT respondent_id, target, split FROM split")
oracle(
    "stratified_folds",
    _SPLIT
    + """
SELECT respondent_id, target, CAST((row_number() OVER (PARTITION BY target
  ORDER BY md5(concat('42:', CAST(respondent_id AS VARCHAR))), respondent_id) - 1) % 5 AS INTEGER) AS fold
FROM split WHERE split = 'train'""",
)
oracle(
    "seeded_sample",
    "SELECT doc_id, lang, source, n_chars FROM fx_doc ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 5000",
)
oracle("split_ids", _SPLIT + "\nSELECT respondent_id, split FROM split")
oracle(
    "split_disjoint",
    _SPLIT
    + """
SELECT COUNT(*) FILTER (WHERE split = 'train') AS n_train, COUNT(*) FILTER (WHERE split = 'test') AS n_test,
  (SELECT COUNT(*) FROM split a WHERE a.split = 'train'
     AND a.respondent_id IN (SELECT respondent_id FROM split b WHERE b.split = 'test')) AS n_overlap FROM split""",
)
oracle(
    "apply_split",
    _SPLIT + "\nSELECT f.respondent_id, f.outcome, f.segment, s.split FROM fx f JOIN split s ON s.respondent_id = f.respondent_id",
)
oracle(
    "split_manifest",
    _SPLIT
    + """
SELECT 0.2e0 AS test_size, CAST(42 AS INTEGER) AS seed, 'target' AS stratify,
  COUNT(*) FILTER (WHERE split = 'train') AS n_train, COUNT(*) FILTER (WHERE split = 'test') AS n_test,
  AVG(CASE WHEN split = 'train' THEN target END) AS positive_rate_train,
  AVG(CASE WHEN split = 'test' THEN target END) AS positive_rate_test,
  (SELECT COUNT(*) FROM fx WHERE outcome IS NULL) AS n_dropped_unlabelled FROM split""",
)

# ---- linear features -----------------------------------------------------------------------

_LIN = (
    _SPLIT
    + """,
t AS (SELECT model.*, split.split FROM model JOIN split ON split.respondent_id = model.respondent_id),
b AS (SELECT quantile_cont(spend, 0.01) AS lo, quantile_cont(spend, 0.99) AS hi FROM t WHERE split = 'train'),
pre AS (SELECT t.*, ln(1 + CASE WHEN spend IS NOT NULL THEN LEAST(GREATEST(spend, lo), hi) END) AS spend_pre,
  ln(1 + years) AS years_pre, ln(1 + n_returns) AS n_returns_pre, segmentNum AS segmentNum_pre FROM t, b),
med AS (SELECT quantile_cont(spend_pre, 0.5) AS m_spend, quantile_cont(years_pre, 0.5) AS m_years,
  quantile_cont(n_returns_pre, 0.5) AS m_n_returns, quantile_cont(segmentNum_pre, 0.5) AS m_segmentNum FROM pre WHERE split = 'train'),
lin AS (SELECT respondent_id, split, target,
  CAST(spend IS NULL AS TINYINT) AS spend_missing, COALESCE(spend_pre, m_spend) AS spend_log,
  CAST(years IS NULL AS TINYINT) AS years_missing, COALESCE(years_pre, m_years) AS years_log,
  CAST(n_returns IS NULL AS TINYINT) AS n_returns_missing, CAST(COALESCE(n_returns > 0, false) AS TINYINT) AS n_returns_any,
  COALESCE(n_returns_pre, m_n_returns) AS n_returns_log,
  CAST(segmentNum IS NULL AS TINYINT) AS segmentNum_missing, COALESCE(segmentNum_pre, m_segmentNum) AS segmentNum,
  spend AS spend_raw, years AS years_raw, n_returns AS n_returns_raw, t_seg AS segmentNum_raw
  FROM (SELECT pre.*, pre.segmentNum AS t_seg FROM pre) p, med)"""
)

oracle(
    "winsorize",
    _LIN + "\nSELECT respondent_id, CASE WHEN spend IS NOT NULL THEN LEAST(GREATEST(spend, lo), hi) END AS spend_clipped FROM t, b",
)
oracle("log1p_transform", _LIN + "\nSELECT respondent_id, spend_pre AS spend_log, years_pre AS years_log, n_returns_pre AS n_returns_log FROM pre")
oracle(
    "missing_flags",
    _LIN + "\nSELECT respondent_id, spend_missing, years_missing, n_returns_missing, n_returns_any, segmentNum_missing FROM lin",
)
oracle(
    "median_impute",
    _LIN
    + """
SELECT 'spend_log' AS "column", m_spend AS median FROM med UNION ALL SELECT 'years_log', m_years FROM med
UNION ALL SELECT 'n_returns_log', m_n_returns FROM med UNION ALL SELECT 'segmentNum', m_segmentNum FROM med""",
)
oracle(
    "linear_params_json",
    _LIN
    + """
SELECT 'spend' AS "column", 'spend_log' AS output, (SELECT lo FROM b) AS clip_low, (SELECT hi FROM b) AS clip_high, true AS log, m_spend AS median FROM med
UNION ALL SELECT 'years', 'years_log', NULL, NULL, true, m_years FROM med
UNION ALL SELECT 'n_returns', 'n_returns_log', NULL, NULL, true, m_n_returns FROM med
UNION ALL SELECT 'segmentNum', 'segmentNum', NULL, NULL, false, m_segmentNum FROM med""",
)
oracle(
    "pipeline_tables",
    _SPLIT
    + """, tokens AS (SELECT DISTINCT 'h' AS q, unnest(string_split(have_cell, ';')) AS v FROM fx UNION SELECT DISTINCT 'w', unnest(string_split(want_cell, ';')) FROM fx)
SELECT split, COUNT(*) AS n, CAST(SUM(target) AS BIGINT) AS n_positive,
  CAST((SELECT COUNT(*) + 1 FROM tokens WHERE q = 'w' AND v <> '') AS INTEGER) AS columns_dropped,
  CAST(5 + 9 + (SELECT COUNT(*) + 1 FROM tokens WHERE q = 'h' AND v <> '') AS INTEGER) AS columns_kept
FROM split GROUP BY split""",
)
oracle(
    "fit_apply_linear",
    _LIN
    + """
SELECT respondent_id, split, target, spend_missing, spend_log, years_missing, years_log, n_returns_missing, n_returns_any,
  n_returns_log, segmentNum_missing, segmentNum FROM lin""",
)
oracle(
    "standardize",
    _LIN
    + """,
sc AS (SELECT AVG(spend_log) AS a1, STDDEV_POP(spend_log) AS s1, AVG(years_log) AS a2, STDDEV_POP(years_log) AS s2,
  AVG(n_returns_log) AS a3, STDDEV_POP(n_returns_log) AS s3, AVG(segmentNum) AS a4, STDDEV_POP(segmentNum) AS s4
  FROM lin WHERE split = 'train')
SELECT respondent_id, split, (spend_log - a1) / s1 AS spend_log, (years_log - a2) / s2 AS years_log,
  (n_returns_log - a3) / s3 AS n_returns_log, (segmentNum - a4) / s4 AS segmentNum FROM lin, sc""",
)
oracle(
    "skew_before_after",
    _LIN
    + """
SELECT 'spend' AS "column", COUNT(spend_raw) AS n, skewness(spend_raw) AS skew_before,
  skewness(CASE WHEN spend_missing = 0 THEN spend_log END) AS skew_after FROM lin WHERE split = 'train'
UNION ALL SELECT 'years', COUNT(years_raw), skewness(years_raw), skewness(CASE WHEN years_missing = 0 THEN years_log END)
  FROM lin WHERE split = 'train'
UNION ALL SELECT 'n_returns', COUNT(n_returns_raw), skewness(n_returns_raw),
  skewness(CASE WHEN n_returns_missing = 0 THEN n_returns_log END) FROM lin WHERE split = 'train'
UNION ALL SELECT 'segmentNum', COUNT(segmentNum_raw), skewness(segmentNum_raw),
  skewness(CASE WHEN segmentNum_missing = 0 THEN segmentNum END) FROM lin WHERE split = 'train'""",
)
oracle(
    "category_fill",
    "SELECT respondent_id, COALESCE(outcome, 'Missing') AS outcome, COALESCE(have_cell, '__MISSING__') AS have_cell FROM fx",
)
_XB = "CASE " + " ".join(f"WHEN y > {lo} AND y <= {hi} THEN '{lab}'" for lab, lo, hi in _XBANDS) + " END"
_CB = _CBAND_SQL.replace("years", "y")
oracle(
    "bin_right_closed",
    f"SELECT respondent_id, y AS years, {_XB} AS experience_band, {_CB} AS career_band "
    f"FROM (SELECT respondent_id, {_YEARS_L} AS y FROM fx) t",
)
oracle(
    "rare_level_fold",
    ", docs AS (SELECT * FROM fx_doc WHERE quality IS NOT NULL),\n"
    + _split_ctes("docs", "doc_id", "quality")
    + """,
lv AS (SELECT d.source AS level, COUNT(*) AS n_train FROM docs d JOIN split s ON s.doc_id = d.doc_id
       WHERE s.split = 'train' GROUP BY d.source)
SELECT d.doc_id, s.split, d.source, CASE WHEN lv.n_train >= 20 THEN d.source WHEN lv.n_train IS NOT NULL THEN 'infrequent' END
  AS source_level FROM docs d JOIN split s ON s.doc_id = d.doc_id LEFT JOIN lv ON lv.level = d.source""",
)


# ---- evaluation on deterministic scores --------------------------------------------------

_SCORED = ", sc AS (SELECT doc_id, label, score, CAST(score >= 0.5 AS INTEGER) AS pred FROM fx_scores)"
_CNT = _SCORED + """, c AS (SELECT COUNT(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, COUNT(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  COUNT(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, COUNT(*) FILTER (WHERE label = 0 AND pred = 0) AS tn,
  AVG(CAST(label AS DOUBLE)) AS baseline FROM sc),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END AS r0,
  tp + fn AS s1, tn + fp AS s0 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0e0 END AS f1_1,
  CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0e0 END AS f1_0, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM m)"""

oracle("score_threshold", _SCORED + " SELECT * FROM sc")
oracle(
    "confusion_matrix",
    _CNT
    + """
SELECT 0 AS actual, 0 AS predicted, tn AS n, CASE WHEN s0 > 0 THEN tn / s0 ELSE 0e0 END AS row_share FROM f
UNION ALL SELECT 0, 1, fp, CASE WHEN s0 > 0 THEN fp / s0 ELSE 0e0 END FROM f
UNION ALL SELECT 1, 0, fn, CASE WHEN s1 > 0 THEN fn / s1 ELSE 0e0 END FROM f
UNION ALL SELECT 1, 1, tp, CASE WHEN s1 > 0 THEN tp / s1 ELSE 0e0 END FROM f""",
)
oracle(
    "binary_metrics",
    _CNT + "\nSELECT (tp + tn) / n AS accuracy, p1 AS precision, r1 AS recall, f1_1 AS f1, baseline, CAST(n AS BIGINT) AS n FROM f",
)
oracle(
    "macro_metrics",
    _CNT + "\nSELECT f1_0, f1_1, (f1_0 + f1_1) / 2 AS f1_macro, (r0 + r1) / 2 AS balanced_accuracy FROM f",
)
oracle(
    "classification_report",
    _CNT
    + """
SELECT 'low quality' AS class, p0 AS precision, r0 AS recall, f1_0 AS f1_score, CAST(s0 AS DOUBLE) AS support FROM f
UNION ALL SELECT 'high quality', p1, r1, f1_1, CAST(s1 AS DOUBLE) FROM f
UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, (tp + tn) / n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f1_0 * s0 + f1_1 * s1) / n, n FROM f""",
)
_ROC = _SCORED + """, g AS (SELECT CAST(score AS DOUBLE) AS threshold, SUM(label) AS pos, COUNT(*) - SUM(label) AS neg FROM sc GROUP BY 1),
cum AS (SELECT threshold, pos, neg, SUM(pos) OVER (ORDER BY threshold DESC) AS cum_pos, SUM(neg) OVER (ORDER BY threshold DESC) AS cum_neg,
  SUM(pos) OVER () AS n_pos, SUM(neg) OVER () AS n_neg FROM g)"""
oracle(
    "roc_curve",
    _ROC
    + """
SELECT threshold, cum_neg / n_neg AS fpr, cum_pos / n_pos AS tpr FROM cum
UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0e0, 0e0""",
)
oracle(
    "roc_auc",
    _ROC
    + """
SELECT SUM(pos * (n_neg - cum_neg + neg * 0.5e0)) / (ANY_VALUE(n_pos) * ANY_VALUE(n_neg)) AS roc_auc,
  CAST(ANY_VALUE(n_pos) AS BIGINT) AS n_pos, CAST(ANY_VALUE(n_neg) AS BIGINT) AS n_neg FROM cum""",
)
oracle(
    "predictions_table",
    """SELECT doc_id, CAST(label AS INTEGER) AS actual_target, CAST(score >= 0.5 AS INTEGER) AS predicted_target,
  score AS predicted_probability, CASE label WHEN 0 THEN 'low quality' WHEN 1 THEN 'high quality' END AS actual_label,
  CASE WHEN score >= 0.5 THEN 'high quality' ELSE 'low quality' END AS predicted_label,
  label = CAST(score >= 0.5 AS INTEGER) AS correct FROM fx_scores""",
)


# ---- feature labels -------------------------------------------------------------------------


def _case(expr: str, mapping: dict) -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    return "(CASE " + expr + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END)"


def _feature_labels_sql() -> str:
    from canvass.plans.catalog import CODEBOOK, LINEAR, MANUAL_LABELS

    def q(x: str) -> str:
        stem = f"substring({x}, 1, length({x}) - 3)"
        return (
            f"COALESCE({_case(x, MANUAL_LABELS)}, {_case(x, CODEBOOK)}, "
            f"CASE WHEN ends_with({x}, 'Num') THEN {_case(stem, CODEBOOK)} || ' (ordinal)' END, {x})"
        )

    def strip(x: str, suffix: str) -> str:
        return f"substring({x}, 1, length({x}) - {len(suffix)})"

    fixed = [f"num__{c.output}" for c in LINEAR] + [f"remainder__{c.source}_missing" for c in LINEAR] + [
        "remainder__n_returns_any", "remainder__have_cell__answered", "remainder__want_cell__answered",
        "cat__segment_infrequent", "remainder__respondent_id",
    ]
    fixed_sql = " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in fixed)
    long_hw = _LONG.replace("fxb", "fx").split("UNION ALL\n  SELECT respondent_id, 'both_cell'")[0] + ") t WHERE value <> ''"
    cat_col = "CASE WHEN starts_with(name, 'country_') THEN 'country' WHEN starts_with(name, 'segment_') THEN 'segment' END"
    level = f"substring(name, length({cat_col}) + 2)"
    clean_level = f"CASE WHEN {level} = 'Missing' THEN '(no answer)' WHEN {level} = 'infrequent' THEN '(rare levels)' ELSE {level} END"
    base = "split_part(name, '__', 1)"
    option = f"substring(name, length({base}) + 3)"
    return f""", feats AS (
  SELECT DISTINCT 'remainder__' || question || '__' || value AS feature FROM ({long_hw}) l
  UNION ALL SELECT * FROM (SELECT DISTINCT 'cat__segment_' || COALESCE(segment, 'Missing') AS feature FROM fx
                           UNION SELECT DISTINCT 'cat__country_' || COALESCE(country, 'Missing') FROM fx) c
  UNION ALL {fixed_sql}),
parts AS (SELECT feature, split_part(feature, '__', 1) AS grp, substring(feature, length(split_part(feature, '__', 1)) + 3) AS name FROM feats)
SELECT feature,
  CASE WHEN grp = 'num' THEN (CASE WHEN ends_with(name, '_log') THEN {q(strip('name', '_log'))} ELSE {q('name')} END)
       WHEN grp = 'cat' THEN (CASE WHEN {cat_col} IS NOT NULL THEN {q(cat_col)} ELSE name END)
       ELSE (CASE WHEN instr(name, '__') > 0 THEN {q(base)}
                  WHEN ends_with(name, '_missing') THEN {q(strip('name', '_missing'))}
                  WHEN ends_with(name, '_any') THEN {q(strip('name', '_any'))}
                  ELSE {q('name')} END) END AS question,
  CASE WHEN grp = 'num' THEN (CASE WHEN ends_with(name, '_log') THEN 'log scale' ELSE 'numeric' END)
       WHEN grp = 'cat' THEN (CASE WHEN {cat_col} IS NOT NULL THEN '-> ' || {clean_level} END)
       ELSE (CASE WHEN instr(name, '__') > 0 AND {option} = 'answered' THEN 'answered'
                  WHEN instr(name, '__') > 0 THEN '-> ' || {option}
                  WHEN ends_with(name, '_missing') THEN 'missing'
                  WHEN ends_with(name, '_any') THEN 'above zero' END) END AS detail
FROM parts"""


oracle("feature_labels", _feature_labels_sql())

# ---- sources and sinks ------------------------------------------------------------------------

oracle("csv_null_token", "SELECT respondent_id, segment, years_text, have_cell, want_cell FROM fx")
oracle("parquet_roundtrip", _LONG)
oracle("csv_roundtrip", ORACLES["rate_by_country"][len(with_fixtures("")):])

_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
# Python (the reference's language) upper-cases 'ß' to 'SS' like Spark; DuckDB gives 'ẞ'
_NAME = (
    f"(string_split({_TITLE}, ' ')[1] || array_to_string(list_transform(string_split({_TITLE}, ' ')[2:], "
    "lambda w: CASE WHEN substring(w, 1, 1) = 'ß' THEN 'SS' ELSE upper(substring(w, 1, 1)) END || substring(w, 2)), ''))"
)
_Q0 = "trim(replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '*', ''))"
oracle(
    "codebook_clean",
    f""", cb AS (SELECT page_id, {_NAME} AS column_silver, {_Q0} AS q FROM pages)
SELECT page_id, column_silver, CASE WHEN instr(q, '?') > 0 THEN substring(q, 1, instr(q, '?')) ELSE q END AS question
FROM cb WHERE column_silver <> '' AND column_silver <> '(dropped)'""",
)

oracle(
    "column_profile",
    """SELECT 'segment' AS column_name, 'string' AS data_type, 'categorical' AS role, COUNT(segment) AS non_null FROM fx
UNION ALL SELECT 'country', 'string', 'categorical', COUNT(country) FROM fx
UNION ALL SELECT 'outcome', 'string', 'categorical', COUNT(outcome) FROM fx
UNION ALL SELECT 'years_text', 'double', 'numeric', COUNT(years_text) FROM fx
UNION ALL SELECT 'spend', 'double', 'numeric', COUNT(spend) FROM fx
UNION ALL SELECT 'have_cell', 'string', 'categorical', COUNT(have_cell) FROM fx
UNION ALL SELECT 'want_cell', 'string', 'categorical', COUNT(want_cell) FROM fx
UNION ALL SELECT 'segmentNum', 'double', 'numeric', COUNT(segment) FILTER (WHERE segment <> 'MACHINERY') FROM fx""",
)

oracle(
    "prepare_tables",
    """, det AS (SELECT COALESCE(bool_or(contains(have_cell, ';')), false) AS mh,
  COALESCE(bool_or(contains(want_cell, ';')), false) AS mw, COALESCE(bool_or(contains(both_cell, ';')), false) AS mb FROM fxb),
long AS (""" + _LONG + """),
lq AS (SELECT long.* FROM long, det
       WHERE (question = 'have_cell' AND mh) OR (question = 'want_cell' AND mw) OR (question = 'both_cell' AND mb))
SELECT (SELECT COUNT(*) FROM fx) AS silver_rows, (SELECT COUNT(*) FROM fx) AS wide_rows,
  (SELECT COUNT(*) FROM lq) AS long_rows, 10 AS silver_cols,
  (SELECT CAST(10 - CAST(mb AS INTEGER) + (SELECT COUNT(DISTINCT question || '__' || value) FROM lq WHERE question <> 'both_cell')
     AS INTEGER) FROM det) AS wide_cols,
  (SELECT CAST(CAST(mh AS INTEGER) + CAST(mw AS INTEGER) + CAST(mb AS INTEGER) AS INTEGER) FROM det) AS multiselect_questions""",
)

oracle("metrics_json", ORACLES["binary_metrics"][len(with_fixtures("")):])
