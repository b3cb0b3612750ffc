"""DuckDB SQL for the queries that SQL can state over whole tables."""

from __future__ import annotations

# op4: targets by the level at which sources that aren't full share what the full ones leave; keys and prefix sums
# over whole sources, which the Spark query never does
_MIX = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM {docs}
), k AS (
  SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest,
         (1.0::DOUBLE + least(size, 1000) / 1000.0::DOUBLE)
           * CASE WHEN coalesce(regexp_matches(text, '[.!?][\x20\x09-\x0D]*$'), false) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), t AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s
), u AS (
  SELECT *, [3.0, 1.0, 2.0][turn % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM t
), v AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            (SELECT sum(w) FROM u)
              - coalesce(sum(w) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heft
  FROM u
), g AS (
  SELECT source, source_size,
         CASE WHEN cap * heft <= rest * w THEN cap
              ELSE max(CASE WHEN cap * heft > rest * w THEN rest / heft END) OVER () * w END AS target
  FROM v
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g
), o AS (
  SELECT k.doc_id, k.source, k.size, h.source_size, h.target, h.epochs,
         floor(h.target - h.epochs * h.source_size)::BIGINT AS budget,
         coalesce(sum(k.size) OVER (
           PARTITION BY k.source
           ORDER BY -ln((('0x' || substr(digest, 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight, substr(digest, 14, 19)
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
)
"""

# op11: checksums bit by bit over the different features, plain sums of gains, one window over all scores
_IMPORTANCE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), x AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM d
), y AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM b
), f AS (
  SELECT DISTINCT feature, hex(encode(feature)) AS digits FROM (SELECT feature FROM x UNION ALL SELECT feature FROM y)
), k AS (
  SELECT feature, xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, len(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(0, 8)),
             lambda c, i: xor(c // 2, 3988292384::BIGINT * (c % 2))))) % 10000 AS bucket
  FROM f
), s AS (
  SELECT bucket, count(*)::BIGINT AS n FROM x JOIN k USING (feature) GROUP BY bucket
), t AS (
  SELECT bucket, count(*)::BIGINT AS n FROM y JOIN k USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(
           ((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
           / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), m AS (
  SELECT doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS total FROM x JOIN k USING (feature) JOIN g USING (bucket) GROUP BY doc_id
), v AS (
  SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0
              ELSE total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END END AS weight,
         ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (doc_id)
), z AS (
  SELECT doc_id, n_words >= 20 AS able, n_features, weight,
         weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM v
), r AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank
FROM r
"""

# op12: all phrases of 1 to 5 words counted at once, parts and longer candidates by joins on the spelled phrases
_COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), t AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4), (5)) AS sizes(m)
  WHERE len(w) >= m
), f AS (
  SELECT lang, m, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2
), k AS (
  SELECT c.lang, c.m, c.phrase, c.f, cut.k, l.f AS l, r.f AS r, 1000::HUGEINT * c.f * t.n // (l.f::HUGEINT * r.f) AS score, t.n
  FROM c JOIN t USING (lang), (VALUES (1), (2), (3), (4)) AS cut(k), f AS l, f AS r
  WHERE cut.k < c.m AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:cut.k], ' ') AND r.phrase = array_to_string(c.w[cut.k + 1:], ' ')
), s AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, f, m, unnest(list_transform(range(1, m - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM c, (VALUES (2), (3), (4)) AS sizes(size)
  WHERE size < m
), z AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 100 * s.f)
), o AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score::BIGINT AS score FROM z
)
SELECT * FROM o WHERE rank <= 2000
"""



def _sharding() -> str:
    """op6: a document's slot by its md5; the owners of the slots as a text of two hexadecimal digits each."""
    from canvass.llm.sharding import SLOTS, lookup_table

    names = [f"shard-{i:03d}" for i in range(64)]
    owners = ["".join(f"{s:02x}" for s in lookup_table(n)) for n in (names, names[:-1])]
    owner = "printf('shard-%03d', ('0x' || substr('{}', 2 * slot + 1, 2))::INTEGER)"
    return f"""
SELECT doc_id, slot::INTEGER AS slot, {owner.format(owners[0])} AS shard, {owner.format(owners[1])} AS shard_after
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
"""


ORACLES: dict[str, str] = {
    "op12_phrase_collocations": _COLLOCATIONS,
    "op11_importance_resampling": _IMPORTANCE,
    "op4_mixing_sources": _MIX.format(docs="documents")
    + """
SELECT doc_id, source, size, source_size, target,
       epochs * size + greatest(0, least(size, budget - before)) AS taken
FROM o
""",
    # which pages the replica loses, changes, cuts or has alone, found without any hash tree
    "op8_warc_fixity": """
SELECT page_id, url, CASE draw WHEN 1 THEN 'missing' WHEN 3 THEN 'extra' ELSE 'changed' END AS kind
FROM (SELECT page_id, url, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % 97 AS draw FROM pages)
WHERE draw < 4
""",
    "op6_sharding": _sharding(),
    # every query against every vector, one window over all scores
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024::DOUBLE * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
""",
}
