"""Exact top-k search by tiled matrix products.

Vectors become integers and are packed into tiles (ids and one matrix). Tiles are dealt onto a grid:
a cell holds some query tiles and some shard tiles, and every query meets every vector in one cell. A cell
multiplies tile by tile, keeps each query's best k per tile and merges; the cells' lists of a
query are then merged in a tree. Nothing is broadcast, no group grows with the table: a cell's
size is a parameter, and a level of the tree merges ``FAN`` lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import common as cm

SCALE = 1024.0
TILE = 2048
QUERY_TILES = 16  # most in a cell
SHARD_TILES = 64  # most in a cell
FAN = 16
#: Below it, products of doubles are exact.
EXACT = 2.0**53
_LOW, _HIGH = -(2**63), 2**63 - 1

TILES = "tile long, dim int, ids array<long>, matrix binary"
LISTS = "tile long, at int, query_id long, col long, vec_id long, score long"


def tiles(vectors: DataFrame, id_col: str, vector_col: str, scale: float = SCALE, rows: int = TILE) -> DataFrame:
    """Pack vectors into tiles of floor(scale * x). Vectors that are null or hold null or non-finite
    components are left out. A tile holds vectors of one length."""

    def pack(batches):
        import pyarrow.compute as pc
        from pyspark import TaskContext

        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 33
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))
            size = pc.list_value_length(column).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, n in enumerate(size):
                if n is not None:
                    by_dim.setdefault(n, []).append(i)
            for dim, where in by_dim.items():
                flat = pc.list_flatten(column.take(pa.array(where)))
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(where), dim)
                good = np.isfinite(x).all(axis=1)  # nulls are NaN here
                whole = np.floor(x[good] * scale)
                own = ids.take(pa.array(np.array(where)[good])).to_pylist()
                for k in range(0, len(own), rows):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int64()),
                            pa.array([dim], pa.int32()),
                            pa.array([own[k : k + rows]], pa.list_(pa.int64())),
                            pa.array([whole[k : k + rows].tobytes()], pa.binary()),
                        ],
                        names=["tile", "dim", "ids", "matrix"],
                    )
                    number += 1

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(pack, TILES)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64; exact, and held at the ends of int64 beyond."""
    most = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries @ shard.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in shard]
    return np.array([[min(_HIGH, max(_LOW, sum(a * b for a, b in zip(q, s)))) for s in whole[1]] for q in whole[0]], np.int64)


def _best(score: np.ndarray, row: np.ndarray, vec: np.ndarray, null: np.ndarray, k: int):
    """The first k of each row by (higher score, smaller id, null id last)."""
    order = np.lexsort((vec, null, -score, row))
    row = row[order]
    first = np.searchsorted(row, row, "left")
    keep = order[np.arange(len(row)) - first < k]
    return keep


def _select(scores: np.ndarray, query_ids: np.ndarray, vec: np.ndarray, null: np.ndarray, k: int):
    """Partial selection on one tile: (row, column) of all scores that can be among a row's first k."""
    low = np.int64(_LOW)
    own = (query_ids[:, None] == vec[None, :]) & ~null[None, :]
    scores = np.where(own, low, scores)
    if scores.shape[1] > k:
        least = -np.partition(-scores.astype(np.float64), k - 1, axis=1)[:, k - 1] if np.abs(scores[~own]).max(initial=0) < EXACT else np.sort(scores, axis=1)[:, -k]
        r, c = np.nonzero((scores >= least[:, None]) & ~own)
    else:
        r, c = np.nonzero(~own)
    keep = _best(scores[r, c], r, vec[c], null[c], k)
    return r[keep], c[keep], scores[r[keep], c[keep]]


def _cell(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = {n: [] for n in ("tile", "at", "query_id", "col", "vec_id", "score")}
        for q in left.to_pylist():
            queries = np.frombuffer(q["matrix"], np.float64).reshape(len(q["ids"]), q["dim"])
            qid = np.array(q["ids"], np.int64)
            best = None
            for j in range(right.num_rows):
                ids = right.column("ids")[j].values
                if right.column("dim")[j].as_py() != q["dim"]:
                    continue
                null = np.array(ids.is_null())
                vec = ids.fill_null(0).to_numpy()
                shard = np.frombuffer(right.column("matrix")[j].as_py(), np.float64).reshape(len(vec), q["dim"])
                r, c, s = _select(products(queries, shard), qid, vec, null, k)
                new = (s, r, vec[c], null[c])
                best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new))
                keep = _best(*best, k)
                best = tuple(x[keep] for x in best)
            if best is None:
                continue
            score, row, vec, null = best
            found["tile"].append(np.full(len(row), q["tile"]))
            found["at"].append(row.astype(np.int32))
            found["query_id"].append(qid[row])
            found["col"].append(np.full(len(row), right.column("col")[0].as_py()))
            found["vec_id"].append(np.ma.array(vec, mask=null))
            found["score"].append(score)
        join = lambda x, t: pa.array(np.ma.concatenate(x) if x else np.zeros(0), t)
        return pa.table({n: join(x, pa.int32() if n == "at" else pa.int64()) for n, x in found.items()})

    return run


def top_k(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """For each query row its ``k`` highest integer inner products: (query_id, rank from 1, vec_id, score), ties to the
    smaller id, a null id last.

    A query doesn't meet rows with its own id. Repeated equal query rows give one list; rows of ``vectors`` that
    repeat are candidates each. Vectors meet those of their own length only. Vectors that are null, or
    hold null or non-finite components, take no part; queries without candidates give no rows."""
    stored = cm.written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "topk-vectors")
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null").dropDuplicates(["id", "v"])
    n, nq = stored.count(), asked.count()
    workers = spark.sparkContext.defaultParallelism
    query_tiles = cm.written(tiles(asked.repartition(max(1, -(-nq // TILE))), "id", "v", scale), "topk-queries")
    shard_tiles = tiles(stored, "id", "v", scale)
    per_cell = int(min(SHARD_TILES, max(1, n // (TILE * 4 * workers))))
    columns = max(1, -(-n // (TILE * per_cell)))
    lines = max(1, -(-nq // (TILE * QUERY_TILES)))
    left = query_tiles.withColumn("line", F.pmod(F.xxhash64("tile"), F.lit(lines))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<long>")))
    right = shard_tiles.withColumn("col", F.pmod(F.xxhash64("tile"), F.lit(columns))).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)).cast("array<long>")))
    lists = left.groupBy("line", "col").cogroup(right.groupBy("line", "col")).applyInArrow(_cell(k), LISTS)
    # merge the cells' lists of a query, FAN at a time
    while True:
        lists = lists.withColumn("col", F.floor(F.col("col") / FAN))
        order = Window.partitionBy("tile", "at", "col").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        columns = -(-columns // FAN)
        if columns == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
