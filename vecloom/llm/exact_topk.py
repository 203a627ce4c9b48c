"""Exact top-k by integer inner product: tiled matrix products, partial selection, tree merging.

Vectors are packed into blocks of at most TILE rows.  Query blocks meet candidate blocks cell by
cell; a cell multiplies two matrices and keeps each query's best k.  Lists of the cells are merged
FAN at a time, level by level, until one list per query is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import table

QUERY_TILE, SHARD_TILE, FAN = 1024, 8192, 8
BIG = (1 << 63) - 1


def top_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best scores; ids ascend, so of equals the first wins.

    own: the row's id, which is no candidate of the row.
    """
    rows, cols = [], []
    for i in range(len(scores)):
        line = scores[i]
        keep = np.flatnonzero(ids != own[i])
        line = line[keep]
        if len(line) > k:
            edge = np.partition(line, len(line) - k)[len(line) - k]
            above = np.flatnonzero(line > edge)
            at = np.concatenate([above, np.flatnonzero(line == edge)[: k - len(above)]])
        else:
            at = np.arange(len(line))
        rows.append(np.full(len(at), i))
        cols.append(keep[at])
    return np.concatenate(rows), np.concatenate(cols)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, clamped to 64 bits: in doubles while no sum can pass 2**53, then in 64 bits, then in Python's integers."""
    if q.shape[1] == 0:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(exact, -BIG - 1, BIG).astype(np.int64)


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(1024 * x).

    Queries are the rows whose vec_id is divisible by ``every``.  Vectors that are null or hold null
    or non-finite components take no part, nor do rows with a null vec_id.  Only vectors of the same
    length are compared.  Rows that share a vec_id count once, by the vector that sorts first.  Ties
    go to the smaller vec_id.  Scores beyond 64 bits are clamped before ranking.  Without queries or
    candidates the result is empty.  Other columns are ignored.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = table(whole, "vectors")
    n = whole.count()
    shards, tiles = n // SHARD_TILE + 1, max(1, n // (every * QUERY_TILE) + 1)
    place = F.xxhash64("vec_id")
    cand = whole.select("vec_id", "embedding", F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    asked = whole.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.pmod(place, F.lit(tiles)).cast("int").alias("tile"))
    left = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("length", F.size("embedding"))
    right = cand.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("length", F.size("embedding"))

    def cell(key: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
        if q.num_rows == 0 or x.num_rows == 0:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score", "shard")})
        q, x = q.sort_by("vec_id"), x.sort_by("vec_id")
        d = key[2].as_py()
        qi, xi = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        a, b = (np.floor(1024.0 * t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((t.num_rows, 0))) for t in (q, x))
        row, col, got = [], [], []
        for at in range(0, len(a), 128):  # 128 rows of scores at a time
            s = products(a[at : at + 128], b)
            i, j = top_of(s, xi, qi[at : at + 128], k)
            row.append(i + at), col.append(j), got.append(s[i, j])
        i, j = np.concatenate(row), np.concatenate(col)
        return pa.table({"query_id": qi[i], "vec_id": xi[j], "score": np.concatenate(got), "shard": np.full(len(i), key[0].as_py(), np.int64)})

    keys = ["shard", "tile", "length"]
    left = left.select(*(F.col(c).alias(c) for c in (*keys, "vec_id", "embedding")))  # columns of their own: both sides come from one table
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long, shard long")
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN:
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN}")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN)
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
