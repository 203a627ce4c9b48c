"""Registered queries of the engine, each with its SQL where SQL can express it.

Queries that shouldn't depend on the k-means kernel cut each dimension into blocks of unequal sizes,
four in even and three in odd dimensions, so that 2**entropy differs from the number of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions import cost
from vecloom.operators import codebook, entropy_graph, kmeans1d, partition, search
from vecloom.operators.decomposition import Decomposition
from vecloom.params import Params
from vecloom.plans import pipelines
from vecloom.sources import sinks
from vecloom.sources import vectors as V

TRUE_N = 20000
TARGET = 0.4
CURVE = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LONG = "l AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS x FROM embeddings)"
#: of twenty equal parts of a dimension, the last of each block but the last
CUTS = ((9, 14, 18), (12, 17))


def _cut_sql(t: str, cuts: tuple[int, ...]) -> str:
    return " + ".join(f"CAST({t} > {c} AS INTEGER)" for c in cuts)


_CUT = f"{_LONG}, tw AS (SELECT vec_id, dim, x, ntile(20) OVER (PARTITION BY dim ORDER BY x, vec_id) AS t FROM l), q AS (SELECT vec_id, dim, x, CASE dim % 2 WHEN 0 THEN {_cut_sql('t', CUTS[0])} ELSE {_cut_sql('t', CUTS[1])} END AS b FROM tw), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings)"
_PAIRS = f"{_CUT}, ps AS (SELECT a.dim AS i, c.dim AS j, a.b AS x, c.b AS y, count(*) AS c FROM q a JOIN q c ON a.vec_id = c.vec_id AND a.dim < c.dim GROUP BY ALL), h2 AS (SELECT i, j, -sum(c / n * log2(c / n)) AS h, count(*) AS k FROM ps, n GROUP BY i, j), h1 AS (SELECT dim, -sum(c / n * log2(c / n)) AS h, count(*) AS k FROM (SELECT dim, b, count(*) AS c FROM q GROUP BY ALL), n GROUP BY dim)"
_BITS = f"({TRUE_N}.0 * log2({{k}}) + {{k}} * {{d}} * 32)"


def _curve_sql(most: int, long: str = f"WITH {_LONG}", points: str = "SELECT dim, x AS lo, n, n * x::DOUBLE AS s1, n * (x * x)::DOUBLE AS s2 FROM v") -> str:
    """The dynamic program over distinct values, or other points, a step at a time."""
    out = [
        f"{long}, v AS (SELECT dim, x, count(*) AS n FROM l GROUP BY ALL)",
        f"p AS (SELECT dim, row_number() OVER w AS m, sum(n) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM ({points}) WINDOW w AS (PARTITION BY dim ORDER BY lo ROWS UNBOUNDED PRECEDING))",
        "z AS (SELECT dim, m, n, s1, s2 FROM p UNION ALL SELECT DISTINCT dim, 0, 0, 0.0, 0.0 FROM p)",
        "last AS (SELECT dim, max(m) AS m FROM p GROUP BY dim)",
        "d1 AS (SELECT dim, m, greatest(0.0, s2 - s1 * s1 / n) AS c FROM p)",
    ]
    for k in range(2, most + 1):
        out.append(f"d{k} AS (SELECT b.dim, b.m, min(d.c + greatest(0.0, b.s2 - a.s2 - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.n - a.n))) AS c FROM z a JOIN d{k - 1} d ON d.dim = a.dim AND d.m = a.m JOIN z b ON b.dim = a.dim AND b.m > a.m GROUP BY b.dim, b.m)")
    rows = " UNION ALL ".join(f"SELECT dim, {k} AS k, c AS sse FROM d{k} JOIN last USING (dim, m)" for k in range(1, most + 1))
    return ", ".join(out) + f", curve AS ({rows})"


def _three_sql() -> str:
    """Where the second and third of three clusters begin: ``lo`` and ``hi`` values come before them."""
    cost = "d.c + greatest(0.0, b.s2 - a.s2 - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.n - a.n))"
    return (
        f"{_curve_sql(3)}, c3 AS (SELECT b.dim, arg_min(a.m, {cost}) AS hi FROM z a JOIN d2 d ON d.dim = a.dim AND d.m = a.m JOIN z b ON b.dim = a.dim AND b.m > a.m JOIN last ON last.dim = b.dim AND last.m = b.m GROUP BY b.dim), "
        f"c2 AS (SELECT b.dim, arg_min(a.m, {cost}) AS lo FROM z a JOIN d1 d ON d.dim = a.dim AND d.m = a.m JOIN c3 ON c3.dim = a.dim JOIN z b ON b.dim = a.dim AND b.m > a.m AND b.m = c3.hi GROUP BY b.dim), "
        "o AS (SELECT dim, x, n, row_number() OVER (PARTITION BY dim ORDER BY x) AS m FROM v), "
        "g AS (SELECT dim, x, n, CAST(m > lo AS INTEGER) + CAST(m > hi AS INTEGER) AS block_id FROM o JOIN c2 USING (dim) JOIN c3 USING (dim))"
    )


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _cut(t: Column, cuts: tuple[int, ...]) -> Column:
    return sum(((t > c).cast("int") for c in cuts), F.lit(0))


def uneven(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, codes with unequal blocks of each dimension (CUTS)."""
    t = F.ntile(20).over(Window.partitionBy("dim").orderBy("x", "vec_id"))
    q = V.components(vectors).withColumn("t", t).select("vec_id", "dim", "x", F.when(F.col("dim") % 2 == 0, _cut(F.col("t"), CUTS[0])).otherwise(_cut(F.col("t"), CUTS[1])).alias("b"))
    return q.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("dim", "b", "x"))).alias("c")).select("vec_id", F.col("c.x").alias("embedding"), F.col("c.b").alias("codes"))


#: dimensions that are each cut in both ways, two columns of codes that share much: a search of its own for each group
TWICE = ((0, 1, 2, 3), (9, 26, 43, 60))


def twice_cut(vectors: DataFrame, dims: tuple[int, ...]) -> DataFrame:
    t = F.ntile(20).over(Window.partitionBy("dim").orderBy("x", "vec_id"))
    q = V.components(vectors).where(F.col("dim").isin(*dims)).withColumn("t", t)
    q = q.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("dim", _cut(F.col("t"), CUTS[0]).alias("a"), _cut(F.col("t"), CUTS[1]).alias("b")))).alias("c"))
    return q.select("vec_id", F.flatten(F.transform("c", lambda x: F.array(x["a"], x["b"]))).alias("codes"))


def paired(d: int) -> Decomposition:
    return Decomposition(i // 2 * 2 for i in range(d))


def _setup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    v = V.read_parquet(spark, sf_dir)
    return v, uneven(v), v.select(F.max(F.size("embedding"))).first()[0] or 0


@query("SELECT CAST(sum(len(embedding)) AS BIGINT) AS n_values, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS d FROM embeddings")
def vec_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.shape(V.read_parquet(spark, sf_dir))


@query("SELECT vec_id, embedding FROM embeddings")
def vec_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV in the shared folder, and read again with numbered lines; vec_id is 0 to n - 1 here."""
    V.checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/csv-{uuid.uuid4().hex}"
    V.write_csv(V.read_parquet(spark, sf_dir), path)
    return V.read_csv(spark, path)


@query(f"WITH {_LONG} SELECT vec_id, dim, x FROM l")
def vec_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.components(V.read_parquet(spark, sf_dir))


@query("SELECT vec_id, embedding[1] AS first, embedding[len(embedding)] AS last, CAST(len(embedding) AS INTEGER) AS d FROM embeddings")
def vec_transposed_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = V.from_components(V.components(V.read_parquet(spark, sf_dir)))
    return back.select("vec_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"), F.size("embedding").alias("d"))


@query(f"WITH {_LONG} SELECT vec_id, dim, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(x::DOUBLE) OVER w, 6) AS s1, round(sum((x * x)::DOUBLE) OVER w, 6) AS s2 FROM l WINDOW w AS (PARTITION BY dim ORDER BY x, vec_id ROWS UNBOUNDED PRECEDING)")
def dim_rank_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans1d.ranked(V.read_parquet(spark, sf_dir)).select("vec_id", "dim", "rank", r6("s1").alias("s1"), r6("s2").alias("s2"))


@query(f"WITH {_LONG} SELECT dim, count(*) AS n, round(greatest(0.0, sum((x * x)::DOUBLE) - sum(x::DOUBLE) * sum(x::DOUBLE) / count(*)), 6) AS sse FROM l GROUP BY dim")
def dim_sse_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans1d.sse_of_one(V.read_parquet(spark, sf_dir)).select("dim", "n", r6("sse").alias("sse"))


@query(f"{_curve_sql(2)} SELECT dim, round(sse, 6) AS sse FROM curve WHERE k = 2")
def kmeans_sse_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans1d.error_curve(V.read_parquet(spark, sf_dir), 2).where("k = 2").select("dim", r6("sse").alias("sse"))


@query(f"{_curve_sql(CURVE)} SELECT dim, k, round(sse, 6) AS sse FROM curve")
def kmeans_error_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans1d.error_curve(V.read_parquet(spark, sf_dir), CURVE).select("dim", "k", r6("sse").alias("sse"))


@query(f"{_curve_sql(5)} SELECT dim, min(k) AS k FROM curve, (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings) WHERE sse <= {TARGET} / d * n GROUP BY dim")
def kmeans_target_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = pipelines.equal_budgets(V.read_parquet(spark, sf_dir), Params(TRUE_N, TARGET))
    return spark.createDataFrame(sorted(ks.items()), "dim int, k int")


@query(f"{_curve_sql(2)}, cut AS (SELECT b.dim, arg_min(a.m, d.c + greatest(0.0, b.s2 - a.s2 - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.n - a.n))) AS bound FROM z a JOIN d1 d ON d.dim = a.dim AND d.m = a.m JOIN z b ON b.dim = a.dim AND b.m > a.m JOIN last ON last.dim = b.dim AND last.m = b.m GROUP BY b.dim), o AS (SELECT dim, x, n, row_number() OVER (PARTITION BY dim ORDER BY x) AS m FROM v) SELECT dim, CAST(o.m > bound AS INTEGER) AS block_id, min(x) AS lo, max(x) AS hi, CAST(sum(n) AS BIGINT) AS n, round(sum(n * x::DOUBLE) / sum(n), 6) AS mean FROM o JOIN cut USING (dim) GROUP BY 1, 2")
def kmeans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, d = _setup(spark, sf_dir)
    return kmeans1d.blocks(v, dict.fromkeys(range(d), 2)).select("dim", "block_id", "lo", "hi", "n", r6("mean").alias("mean"))


@query(f"{_three_sql()} SELECT l.vec_id, l.dim, g.block_id FROM l JOIN g ON g.dim = l.dim AND g.x = l.x")
def kmeans_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, d = _setup(spark, sf_dir)
    return kmeans1d.assignments(pipelines.cluster(v, dict.fromkeys(range(d), 3)))


@query(f"{_three_sql()}, k AS (SELECT dim, block_id, CAST(sum(n) AS DOUBLE) AS n FROM g GROUP BY ALL) SELECT dim, CAST(count(*) AS INTEGER) AS k, round(count(*) * sum(n * n) / pow(sum(n), 2), 9) AS imbalance FROM k GROUP BY dim")
def kmeans_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, d = _setup(spark, sf_dir)
    return kmeans1d.quality(kmeans1d.blocks(v, dict.fromkeys(range(d), 3))).select("dim", "k", F.round("imbalance", 9).alias("imbalance"))


@query(f"{_three_sql()} SELECT dim, block_id, min(x) AS lo, max(x) AS hi, CAST(sum(n) AS BIGINT) AS n, round(sum(n * x::DOUBLE) / sum(n), 6) AS centroid FROM g GROUP BY ALL")
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and centroids in ascending order of three clusters per dimension."""
    v, _, d = _setup(spark, sf_dir)
    return kmeans1d.blocks(v, dict.fromkeys(range(d), 3)).select("dim", "block_id", "lo", "hi", "n", r6("mean").alias("centroid"))


@query(f"{_curve_sql(12)}, one AS (SELECT dim, sse / 100 AS penalty FROM curve WHERE k = 1) SELECT dim, CAST(arg_min(k, sse + k * penalty) AS INTEGER) AS k FROM curve JOIN one USING (dim) GROUP BY dim")
def kmeans_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters per dimension if each costs a hundredth of the dimension's error."""
    return kmeans1d.penalised_counts(kmeans1d.points(V.read_parquet(spark, sf_dir)), 0.01)


#: columns of lineitem that are read as vectors, and as codes
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_CODES = ("l_quantity", "l_discount * 100", "l_tax * 100", "l_linenumber", "l_extendedprice / 10000", "l_orderkey % 5")
BINS = 512
_LINE_LONG = f"WITH l AS (SELECT CAST(i - 1 AS INTEGER) AS dim, CAST(e[i] AS FLOAT) AS x FROM (SELECT [{', '.join(f'{c}::DOUBLE' for c in LINE)}] AS e FROM lineitem), range(1, {len(LINE) + 1}) r(i)), lh AS (SELECT dim, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM l GROUP BY dim), bins AS (SELECT dim, min(x) AS lo, max(x) AS hi, count(*) AS n, sum(x::DOUBLE) AS s1, sum((x * x)::DOUBLE) AS s2 FROM l JOIN lh USING (dim) GROUP BY dim, CASE WHEN high > low THEN least(floor((x::DOUBLE - low) / (high - low) * {BINS}), {BINS - 1}) ELSE 0 END)"


@query(
    f"{_curve_sql(3, _LINE_LONG, 'SELECT * FROM bins')}, own AS (SELECT dim, sum(CASE WHEN lo < hi THEN greatest(0.0, s2 - s1 * s1 / n) ELSE 0.0 END) AS within FROM bins GROUP BY dim), one AS (SELECT dim, sse AS whole FROM curve WHERE k = 1) "
    "SELECT dim, k, round(sse / whole, 8) AS share, round(CASE WHEN within > 0 THEN pow(greatest(0.0, sqrt(greatest(0.0, sse - within)) - sqrt(within)), 2) ELSE sse END / whole, 7) AS least FROM curve JOIN own USING (dim) JOIN one USING (dim)"
)
def binned_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error curves of lineitem's columns from bins, as shares of the whole error, and what the best clusterings have at least."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(0).alias("vec_id"), F.array(*[F.col(c).cast("double").cast("float") for c in LINE]).alias("embedding"))
    curve = kmeans1d.curve_of(kmeans1d.binned_points(rows, BINS), 3)
    whole = F.first_value("sse").over(Window.partitionBy("dim").orderBy("k"))
    return curve.select("dim", "k", F.round(F.col("sse") / whole, 8).alias("share"), F.round(F.col("least") / whole, 7).alias("least"))


@query(
    f"WITH q AS (SELECT row_number() OVER () AS nr, [{', '.join(f'CAST(floor(round({c}, 6)) AS INTEGER)' for c in LINE_CODES)}] AS e FROM lineitem), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM q), d AS (SELECT nr, i - 1 AS dim, e[i] AS b FROM q, range(1, {len(LINE_CODES) + 1}) r(i)), "
    "ps AS (SELECT a.dim AS i, c.dim AS j, a.b AS x, c.b AS y, count(*) AS c FROM d a JOIN d c ON a.nr = c.nr AND a.dim < c.dim GROUP BY ALL), h2 AS (SELECT i, j, -sum(c / n * log2(c / n)) AS h FROM ps, n GROUP BY i, j), h1 AS (SELECT dim, -sum(c / n * log2(c / n)) AS h FROM (SELECT dim, b, count(*) AS c FROM d GROUP BY ALL), n GROUP BY dim) "
    "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(2 * h2.h - a.h - c.h, 6) AS w FROM h2 JOIN h1 a ON a.dim = i JOIN h1 c ON c.dim = j"
)
def line_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation of Information between columns of lineitem, of which some have many blocks."""
    code = [F.floor(F.round(F.expr(c).cast("double"), 6)).cast("int") for c in LINE_CODES]
    return entropy_graph.all_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.array(*code).alias("codes"))).select("i", "j", r6("w").alias("w"))


@query(
    f"{_curve_sql(6)}, s AS (SELECT dim, k, sse, lag(sse) OVER w - sse AS saved, (lag(sse) OVER w - sse) / ({TRUE_N}.0 * log2(k) + k * 32 - (lag({TRUE_N}.0 * log2(k) + k * 32) OVER w)) AS eff FROM curve WINDOW w AS (PARTITION BY dim ORDER BY k)), t AS (SELECT *, min(eff) OVER (PARTITION BY dim ORDER BY k ROWS UNBOUNDED PRECEDING) AS worth FROM s WHERE k > 1), u AS (SELECT *, coalesce(sum(saved) OVER (ORDER BY worth DESC, dim DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT dim, CAST(1 + count(*) FILTER (WHERE total - before > {TARGET} * n) AS INTEGER) AS k FROM u, (SELECT sum(sse) AS total FROM curve WHERE k = 1), (SELECT count(*) AS n FROM embeddings) GROUP BY dim"
)
def cluster_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.read_parquet(spark, sf_dir)
    ks = pipelines.shared_budget(v, Params(TRUE_N, TARGET))
    return spark.createDataFrame(sorted(ks.items()), "dim int, k int")


@query(f"WITH {_PAIRS} SELECT dim, round(h, 6) AS h, round(pow(2, h), 6) AS exp_h FROM h1")
def partition_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, _ = _setup(spark, sf_dir)
    return entropy_graph.dim_entropies(coded).select("dim", r6("h").alias("h"), r6(F.pow(F.lit(2.0), "h")).alias("exp_h"))


@query(f"WITH {_CUT}, s AS (SELECT a.dim AS i, a.b AS x, c.b AS y, e.b AS z, count(*) AS c FROM q a JOIN q c ON a.vec_id = c.vec_id AND c.dim = a.dim + 1 JOIN q e ON a.vec_id = e.vec_id AND e.dim = a.dim + 2 GROUP BY ALL) SELECT CAST(i AS INTEGER) AS i, round(-sum(c / n * log2(c / n)), 6) AS h, round(pow(2, -sum(c / n * log2(c / n))), 6) AS exp_h, count(*) AS blocks FROM s, n GROUP BY i")
def joint_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every three dimensions that follow each other."""
    _, coded, d = _setup(spark, sf_dir)
    found = partition.set_entropies(coded, [(i, i + 1, i + 2) for i in range(d - 2)])
    return found.select(F.col("set_id").alias("i"), r6("h").alias("h"), r6(F.pow(F.lit(2.0), "h")).alias("exp_h"), "blocks")


@query(f"WITH {_CUT}, d AS (SELECT count(DISTINCT dim) AS d FROM q), p AS (SELECT a.dim AS i, c.dim AS j, a.b AS x, c.b AS y FROM q a, d JOIN q c ON a.vec_id = c.vec_id AND c.dim IN (a.dim, (a.dim + 1) % d, (a.dim + 2) % d) GROUP BY ALL) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) AS is_equal FROM p GROUP BY i, j")
def partition_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension's partition under other labels against itself, the next dimension, and the one after it, with blocks of the same sizes; after the last comes the first."""
    _, coded, d = _setup(spark, sf_dir)
    own = kmeans1d.assignments(coded)
    pairs = own.select("vec_id", F.col("dim").alias("i"), (9 - F.col("block_id")).alias("block_id"), F.explode(F.array(*[F.pmod(F.col("dim") + k, F.lit(d)) for k in range(3)])).alias("j"))
    others = own.select("vec_id", F.col("dim").alias("j"), "block_id", F.explode(F.array(*[F.pmod(F.col("dim") - k, F.lit(d)) for k in range(3)])).alias("i"))
    return partition.equal(pairs, others, ["i", "j"])


@query(f"WITH {_CUT} SELECT CAST(a.dim AS INTEGER) AS i, a.b AS x, c.b AS y, count(*) AS n FROM q a JOIN q c ON a.vec_id = c.vec_id AND c.dim = a.dim + 1 GROUP BY ALL")
def joint_pair_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each dimension and the next."""
    _, coded, _ = _setup(spark, sf_dir)
    own = kmeans1d.assignments(coded).withColumnRenamed("dim", "i")
    return partition.joint(own, own.withColumn("i", F.col("i") - 1), ["i"]).groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_three_sql()}, a AS (SELECT l.vec_id, l.dim, g.block_id FROM l JOIN g ON g.dim = l.dim AND g.x = l.x) SELECT dim, count(*) = count(DISTINCT vec_id) AS is_consistent FROM a GROUP BY dim")
def partition_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three clusters in each dimension: whether vectors' blocks and blocks' sizes agree."""
    v, _, d = _setup(spark, sf_dir)
    blocks = kmeans1d.blocks(v, dict.fromkeys(range(d), 3))
    return partition.consistent(kmeans1d.assignments(kmeans1d.codes(v, blocks)), blocks, ["dim"])


#: how far apart the dimensions of a subset are, in shares of all
APART = 3


@query(f"WITH {_CUT}, w AS (SELECT max(dim) + 1 AS d FROM q), s AS (SELECT a.dim AS i, a.b AS x, c.b AS y, e.b AS z, count(*) AS n FROM q a, w JOIN q c ON c.vec_id = a.vec_id AND c.dim = (a.dim + d // {APART}) % d JOIN q e ON e.vec_id = a.vec_id AND e.dim = (a.dim + 2 * (d // {APART})) % d GROUP BY ALL) SELECT CAST(i AS INTEGER) AS i, x || '-' || y || '-' || z AS key, n FROM s")
def joint_subset_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each dimension, the one a third of all further on, and the one two thirds further on."""
    _, coded, d = _setup(spark, sf_dir)
    found = partition.joint_blocks_of(coded, [tuple((i + k * (d // APART)) % d for k in range(APART)) for i in range(d)])
    return found.select(F.col("set_id").alias("i"), F.concat_ws("-", F.transform("key", lambda x: x.cast("string"))).alias("key"), "n")


@query(f"WITH {_PAIRS} SELECT i, j, round(2 * h2.h - a.h - c.h, 6) AS w FROM h2 JOIN h1 a ON a.dim = i JOIN h1 c ON c.dim = j")
def vi_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, _ = _setup(spark, sf_dir)
    return entropy_graph.all_pairs(coded).select("i", "j", r6("w").alias("w"))


def _edges(spark: SparkSession, around: list[list[int]]) -> DataFrame:
    return spark.createDataFrame(entropy_graph.edge_list(around), "i int, j int")


_MST = f"{_PAIRS}, e AS (SELECT i, j, round(2 * h2.h - a.h - c.h, 12) AS w FROM h2 JOIN h1 a ON a.dim = i JOIN h1 c ON c.dim = j), t AS (SELECT [0] AS seen, -1 AS i, -1 AS j UNION ALL SELECT * FROM (SELECT list_append(seen, CASE WHEN list_contains(seen, e.i) THEN e.j ELSE e.i END) AS seen, e.i, e.j FROM t, e WHERE list_contains(seen, e.i) <> list_contains(seen, e.j) QUALIFY row_number() OVER (ORDER BY w, e.i, e.j) = 1))"


@query(f"WITH RECURSIVE {_MST} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM t WHERE i >= 0")
def vi_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    return _edges(spark, entropy_graph.dimension_tree(coded, d, None))


def _capped_sql() -> str:
    """Shortcuts of the tree, a dimension of the queue at a time: ``adj`` holds both directions of each edge in the order of lists."""
    return (
        f"WITH RECURSIVE {_MST}, tree AS (SELECT i, j, row_number() OVER (ORDER BY w, i, j) AS o FROM t JOIN e USING (i, j)), "
        "both_ways AS (SELECT i AS a, o, j AS b FROM tree UNION ALL SELECT j, o, i FROM tree), cap AS (SELECT greatest(2, CAST(ceil(log2(count(*) + 1)) AS BIGINT)) AS cap FROM tree), "
        "root AS (SELECT min(a) AS a FROM (SELECT a FROM both_ways GROUP BY a HAVING count(*) >= 2)), "
        "c AS (SELECT 0 AS n, (SELECT list({'a': a, 'o': o, 'b': b}) FROM both_ways) AS adj, [{'v': a, 'p': -1}] AS todo FROM root "
        "UNION ALL SELECT n + 1, "
        "list_concat(list_filter(adj, lambda x: NOT (x.a = v AND list_contains(chain[2:], x.b)) AND NOT (x.b = v AND list_contains(chain[2:], x.a))), "
        "flatten(list_transform(range(1, len(chain)), lambda k: [{'a': chain[k], 'o': 1000000 * (n + 1) + k, 'b': chain[k + 1]}, {'a': chain[k + 1], 'o': 1000000 * (n + 1) + k, 'b': chain[k]}]))), "
        "list_concat(todo[2:], list_transform(list_filter(children, lambda x: NOT list_contains(chain[2:], x)), lambda x: {'v': x, 'p': v})) "
        "FROM (SELECT *, children[1:greatest(0, degree - cap) + 1] AS chain FROM (SELECT n, adj, todo, v, degree, list_transform(list_filter(own, lambda x: x.b <> p), lambda x: x.b) AS children FROM "
        "(SELECT *, len(own) AS degree FROM (SELECT *, todo[1].v AS v, todo[1].p AS p, list_sort(list_filter(adj, lambda x: x.a = todo[1].v)) AS own FROM c WHERE len(todo) > 0))), cap)) "
        "SELECT CAST(x.a AS INTEGER) AS i, CAST(x.b AS INTEGER) AS j FROM (SELECT unnest(adj) AS x FROM (SELECT adj FROM c ORDER BY n DESC LIMIT 1)) WHERE x.a < x.b"
    )


@query(_capped_sql())
def vi_dcmst(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    return _edges(spark, entropy_graph.dimension_tree(coded, d, Params(TRUE_N, TARGET).degree(d)))


@query(f"WITH {_PAIRS} SELECT i, j, round({_BITS.format(k='pow(2, h)', d=2)}, 4) AS bits FROM h2")
def subspace_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    h = _pair_entropies(coded, d)
    return h.select("i", "j", F.round(cost.subspace_bits(F.pow(F.lit(2.0), "h"), F.lit(2), TRUE_N), 4).alias("bits"))


def _pair_entropies(coded: DataFrame, d: int) -> DataFrame:
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    names = coded.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "set_id int, i int, j int")
    return partition.set_entropies(coded, pairs).join(names, "set_id").select("i", "j", "h", "blocks")


_R = f"(ln(n) / ln({TRUE_N}.0))"
_CORRECTED = f"cc AS (SELECT i, j, pow(pow(2, h2.h), {_R}) * pow(CAST(a.k * c.k AS DOUBLE), 1 - {_R}) AS clusters, h2.k AS blocks FROM h2 JOIN h1 a ON a.dim = i JOIN h1 c ON c.dim = j, n UNION ALL SELECT dim, dim, pow(pow(2, h), {_R}) * pow(CAST(k AS DOUBLE), 1 - {_R}), k FROM h1, n)"


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, clusters, blocks of every pair of dimensions, and of each alone (i = j)."""
    _, coded, d = _setup(spark, sf_dir)
    n = coded.count()
    alone = partition.set_entropies(coded, [(i,) for i in range(d)]).select(F.col("set_id").alias("dim"), "h", "blocks")
    k = lambda of, name: alone.select(F.col("dim").alias(of), F.col("blocks").cast("double").alias(name))
    two = lambda c: F.pow(F.lit(2.0), c)
    both = _pair_entropies(coded, d).join(k("i", "a"), "i").join(k("j", "b"), "j")
    both = both.select("i", "j", cost.corrected(two("h"), F.col("a") * F.col("b"), n, TRUE_N).alias("clusters"), "blocks")
    return both.unionByName(alone.select(F.col("dim").alias("i"), F.col("dim").alias("j"), cost.corrected(two("h"), F.col("blocks").cast("double"), n, TRUE_N).alias("clusters"), "blocks"))


@query(f"WITH {_PAIRS}, {_CORRECTED} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(clusters, 6) AS clusters FROM cc")
def corrected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir).select("i", "j", r6("clusters").alias("clusters"))


@query(f"WITH {_PAIRS}, {_CORRECTED} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(least(pow(2, ceil(log2(clusters) - 1e-9)), blocks) AS BIGINT) AS num_codewords FROM cc")
def corrected_codewords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir).select("i", "j", cost.codewords(F.log2("clusters"), F.col("blocks")).alias("num_codewords"))


def _costs_sql(d: int, correct: bool) -> str:
    """h, number of blocks, clusters and cost of every set of d columns of codes (v); a set is a number with a bit for each column."""
    k = f"pow(pow(2, s.h), {_R}) * pow(pr.product, 1 - {_R})" if correct else "pow(2, s.h)"
    return (
        f"c AS (SELECT mask, list_transform(range(0, {d}), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN codes[i + 1] ELSE -1 END) AS key, count(*) AS c FROM v, range(1, {2**d}) m(mask) GROUP BY ALL), "
        "s AS (SELECT mask, round(-sum(c / n * log2(c / n)), 12) AS h, count(*) AS k FROM c, n GROUP BY mask), "
        f"pr AS (SELECT s.mask, exp(sum(ln(o.k))) AS product FROM s JOIN s o ON bit_count(o.mask) = 1 AND s.mask & o.mask > 0 GROUP BY s.mask), "
        f"e AS (SELECT s.mask, s.h, s.k AS blocks, {k} AS clusters, {TRUE_N}.0 * log2({k}) + {k} * bit_count(s.mask) * 32 AS bits FROM s JOIN pr USING (mask), n)"
    )


def _sets_sql(dims: tuple[int, ...], correct: bool = False) -> str:
    """Costs of all sets of the twice-cut columns of some dimensions."""
    codes = ", ".join(f"max(CASE WHEN dim = {i} THEN {_cut_sql('t', c)} END)" for i in dims for c in CUTS)
    return f"WITH RECURSIVE {_CUT}, v AS (SELECT [{codes}] AS codes FROM tw WHERE dim IN {dims} GROUP BY vec_id), {_costs_sql(2 * len(dims), correct)}"


_PARTS = "list_aggregate(list_sort(list_transform({parts}, lambda x: lpad(CAST(x AS VARCHAR), 3, '0'))), 'string_agg', ' ') AS parts"


def _merging_sql(d: int) -> str:
    """Groupings of d columns by greedy merging: step, parts."""
    return (
        f"r AS (SELECT 0 AS step, list_transform(range(0, {d}), lambda i: CAST(1 << i AS BIGINT)) AS parts UNION ALL "
        "SELECT * FROM (SELECT r.step + 1 AS step, list_append(list_filter(r.parts, lambda x: x <> a.mask AND x <> b.mask), a.mask | b.mask) AS parts "
        "FROM r, e a, e b, e ab WHERE list_contains(r.parts, a.mask) AND list_contains(r.parts, b.mask) AND (a.mask & -a.mask) < (b.mask & -b.mask) AND ab.mask = a.mask | b.mask "
        "AND ab.bits - a.bits - b.bits < -1e-9 * (a.bits + b.bits) QUALIFY row_number() OVER (ORDER BY ab.bits - a.bits - b.bits, a.mask & -a.mask, b.mask & -b.mask) = 1))"
    )


def _merge_sql(correct: bool) -> str:
    """Greedy merging of the twice-cut columns: costs of all their sets, then a step at a time."""

    def one(k: int, dims: tuple[int, ...]) -> str:
        return (
            f"SELECT {k} AS grp, * FROM ({_sets_sql(dims, correct)}, "
            f"{_merging_sql(2 * len(dims))} "
            f"SELECT CAST(step AS INTEGER) AS step, round(sum(e.bits), 3) AS cost, {_PARTS.format(parts='list_distinct(list(e.mask))')} "
            "FROM r, e WHERE list_contains(r.parts, e.mask) GROUP BY step)"
        )

    return " UNION ALL ".join(one(k, dims) for k, dims in enumerate(TWICE))


def _bits(parts: list[tuple[int, ...]]) -> str:
    return " ".join(sorted(f"{sum(1 << i for i in s):03d}" for s in parts))


def _merged(spark: SparkSession, sf_dir: str, correct: bool) -> DataFrame:
    """grp, step, cost, parts (each a number with a bit for every column) of a search over the twice-cut columns of each group."""
    rows = []
    for k, dims in enumerate(TWICE):
        ev = search.Evaluator(twice_cut(V.read_parquet(spark, sf_dir), dims), TRUE_N, correct)
        steps: list[list[tuple[int, ...]]] = []
        _, trace = search.merge_all_pairs(ev, steps)
        rows += [(k, at, round(c, 3), _bits(parts)) for (_, _, at, c), parts in zip(trace, steps, strict=True)]
        ev.close()
    return spark.createDataFrame(rows, "grp int, step int, cost double, parts string")


@query(_merge_sql(False))
def merge_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


@query(_merge_sql(True))
def merge_steps_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, True)


def _turns_sql(d: int) -> str:
    """The search along the tree of d columns, a merge or a cut at a time.

    A state holds the grouping that is worked on (cur), the one that is to be cut next (nxt), and what
    merging came to (res).  Every move there can be is known beforehand: what it needs, and what it gives.
    """
    return (
        f"w AS (SELECT i, j, round(2 * b.h - x.h - y.h, 12) AS w FROM range(0, {d}) r(i), range(0, {d}) q2(j), e b, e x, e y WHERE i < j AND b.mask = (1 << i) | (1 << j) AND x.mask = 1 << i AND y.mask = 1 << j), "
        "t AS (SELECT 1::BIGINT AS seen, -1::BIGINT AS i, -1::BIGINT AS j UNION ALL SELECT * FROM (SELECT seen | (1 << w.i) | (1 << w.j) AS seen, w.i, w.j FROM t, w WHERE (seen >> w.i) & 1 <> (seen >> w.j) & 1 QUALIFY row_number() OVER (ORDER BY w.w, w.i, w.j) = 1)), "
        "tree AS (SELECT i, j, row_number() OVER (ORDER BY w.w, i, j) AS o FROM t JOIN w USING (i, j)), "
        # what is on j's side of each edge
        "side AS (SELECT i, j, (1::BIGINT << j) AS mask FROM tree UNION SELECT s.i, s.j, s.mask | (1 << x.i) | (1 << x.j) FROM side s, tree x WHERE (x.i, x.j) <> (s.i, s.j) AND (s.mask & ((1 << x.i) | (1 << x.j))) > 0), "
        "far AS (SELECT i, j, max(mask) AS mask FROM side GROUP BY i, j), "
        "mv AS (SELECT 'merge' AS kind, x.mask AS a, y.mask AS b, [xy.mask] AS made, xy.bits - x.bits - y.bits AS delta, 100 * i + o AS o FROM tree, e x, e y, e xy WHERE (x.mask >> i) & 1 = 1 AND (y.mask >> j) & 1 = 1 AND x.mask & y.mask = 0 AND xy.mask = x.mask | y.mask "
        "UNION ALL SELECT 'split', s.mask, s.mask, [x.mask, y.mask], x.bits + y.bits - s.bits, 0 FROM far, e s, e x, e y WHERE (s.mask >> i) & 1 = 1 AND (s.mask >> j) & 1 = 1 AND x.mask = s.mask & far.mask AND y.mask = s.mask & ~far.mask), "
        "bl AS (SELECT list(bits ORDER BY mask) AS bits FROM e), "
        f"r AS (SELECT 0 AS turn, 'merge' AS phase, 0 AS step, list_transform(range(0, {d}), lambda i: CAST(1 << i AS BIGINT)) AS cur, [{2**d - 1}::BIGINT] AS nxt, []::BIGINT[] AS res, false AS moved, 0 AS nr UNION ALL "
        "SELECT CASE WHEN delta IS NULL AND phase = 'split' THEN turn + 1 ELSE turn END, CASE WHEN delta IS NULL THEN CASE phase WHEN 'merge' THEN 'split' ELSE 'merge' END ELSE phase END, CASE WHEN delta IS NULL THEN 0 ELSE step + 1 END, "
        "CASE WHEN delta IS NOT NULL THEN list_concat(list_filter(cur, lambda x: x <> a AND x <> b), made) WHEN phase = 'merge' THEN nxt ELSE cur END, "
        "CASE WHEN delta IS NULL AND phase = 'split' THEN res ELSE nxt END, CASE WHEN delta IS NULL AND phase = 'merge' THEN cur ELSE res END, "
        "CASE WHEN delta IS NOT NULL THEN true WHEN phase = 'split' THEN false ELSE moved END, nr + 1 "
        "FROM (SELECT r.*, mv.a, mv.b, mv.made, mv.delta FROM r CROSS JOIN bl LEFT JOIN mv ON mv.kind = r.phase AND list_contains(r.cur, mv.a) AND list_contains(r.cur, mv.b) AND mv.delta < -1e-9 * list_sum(list_transform(r.cur, lambda x: bl.bits[x])) QUALIFY row_number() OVER (ORDER BY mv.delta NULLS LAST, mv.o) = 1) "
        f"WHERE NOT (delta IS NULL AND phase = 'split' AND ({_SAME} OR NOT moved)))"
    )


_SAME = "list_sort(cur) = list_sort(res)"
_TOTAL = "round(list_sum(list_transform({of}, lambda x: bl.bits[x])), 3)"
#: of the two groupings that a search along the tree ends with
_BETTER = f"CASE WHEN {_TOTAL.format(of='cur')} < {_TOTAL.format(of='res')} OR {_SAME} THEN cur ELSE res END"


def _tree_sql(last: bool) -> str:
    def one(k: int, dims: tuple[int, ...]) -> str:
        head = f"{_sets_sql(dims)}, {_turns_sql(2 * len(dims))}"
        if not last:
            return f"SELECT {k} AS grp, * FROM ({head} SELECT CAST(turn AS INTEGER) AS round, phase, CAST(step AS INTEGER) AS step, {_TOTAL.format(of='cur')} AS cost, {_PARTS.format(parts='cur')} FROM r, bl)"
        return f"SELECT {k} AS grp, * FROM ({head} SELECT {_PARTS.format(parts=_BETTER)} FROM r, bl ORDER BY nr DESC LIMIT 1)"

    return " UNION ALL ".join(one(k, dims) for k, dims in enumerate(TWICE))


def _along_tree(spark: SparkSession, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of the trace, and the groupings found, of a search along the tree of each group's columns."""
    rows, found = [], []
    for k, dims in enumerate(TWICE):
        coded = twice_cut(V.read_parquet(spark, sf_dir), dims)
        around = entropy_graph.dimension_tree(coded, 2 * len(dims), None)
        ev = search.Evaluator(coded, TRUE_N)
        steps: list[list[tuple[int, ...]]] = []
        end, trace = search.search_tree(ev, around, entropy_graph.edge_list(around), steps)
        rows += [(k, turn, phase, at, round(c, 3), _bits(parts)) for (turn, phase, at, c), parts in zip(trace, steps, strict=True)]
        found.append((k, _bits([tuple(end.dims(s)) for s in end.subspaces()])))
        ev.close()
    return rows, found


@query(_tree_sql(False))
def tree_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grouping that merging and splitting in turns comes by."""
    return spark.createDataFrame(_along_tree(spark, sf_dir)[0], "grp int, round int, phase string, step int, cost double, parts string")


@query(_tree_sql(True))
def tree_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_along_tree(spark, sf_dir)[1], "grp int, parts string")


_GAIN = f"g AS (SELECT i, j, {_BITS.format(k='pow(2, h2.h)', d=2)} - {_BITS.format(k='pow(2, a.h)', d=1)} - {_BITS.format(k='pow(2, c.h)', d=1)} AS delta FROM h2 JOIN h1 a ON a.dim = i JOIN h1 c ON c.dim = j)"


@query(f"WITH {_PAIRS}, {_GAIN} SELECT i, j, round(delta, 4) AS delta FROM g")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    bits = lambda c, m: cost.subspace_bits(F.pow(F.lit(2.0), c), F.lit(m), TRUE_N)
    h = entropy_graph.dim_entropies(coded)
    both = _pair_entropies(coded, d).join(h.select(F.col("dim").alias("i"), F.col("h").alias("a")), "i").join(h.select(F.col("dim").alias("j"), F.col("h").alias("b")), "j")
    return both.select("i", "j", F.round(bits("h", 2) - bits("a", 1) - bits("b", 1), 4).alias("delta"))


@query(f"WITH {_PAIRS}, {_GAIN} SELECT i, j, round(delta, 4) AS delta FROM g ORDER BY delta, i, j LIMIT 1")
def best_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that a search would take first: a top-1 report."""
    return merge_candidates(spark, sf_dir).orderBy("delta", "i", "j").limit(1)


def _cut_costs_sql() -> str:
    """The cost of each beginning ``p`` and each end ``s`` of the dimensions, as a subspace."""
    h = "SELECT dim, -sum(c / n * log2(c / n)) AS h FROM (SELECT dim, {key}, count(*) AS c FROM runs GROUP BY ALL), n GROUP BY dim"
    return (
        "runs AS (SELECT dim, string_agg(b, ',') OVER (PARTITION BY vec_id ORDER BY dim) AS p, string_agg(b, ',') OVER (PARTITION BY vec_id ORDER BY dim DESC) AS s FROM q), w AS (SELECT max(dim) + 1 AS d FROM q), "
        f"head AS (SELECT dim + 1 AS size, {_BITS.format(k='pow(2, h)', d='(dim + 1)')} AS bits FROM ({h.format(key='p')})), "
        f"tail AS (SELECT dim AS start, {_BITS.format(k='pow(2, h)', d='(d - dim)')} AS bits FROM ({h.format(key='s')}), w)"
    )


@query(f"WITH {_CUT}, {_cut_costs_sql()} SELECT CAST(start AS INTEGER) AS cut_before, round(head.bits + tail.bits - whole.bits, 4) AS delta FROM tail JOIN head ON head.size = tail.start JOIN (SELECT bits FROM tail WHERE start = 0) whole ON true")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of cost for cutting each edge of a path through the dimensions."""
    _, coded, d = _setup(spark, sf_dir)
    around = [[j for j in (i - 1, i + 1) if 0 <= j < d] for i in range(d)]
    ev = search.Evaluator(coded, TRUE_N)
    splitter = search.TreeSplitter(ev, Decomposition.whole(d), around)
    return spark.createDataFrame([(min(b) if 0 in a else min(a), round(float(delta), 4)) for delta, _, _, a, b in splitter.queue], "cut_before int, delta double")


@query()
def decomp_allpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, _ = _setup(spark, sf_dir)
    return search.merge_all_pairs(search.Evaluator(coded, TRUE_N))[0].to_df(spark)


@query()
def decomp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    ev = search.Evaluator(coded, TRUE_N)
    around = entropy_graph.dimension_tree(ev.coded, d, Params(TRUE_N, TARGET).degree(d))
    found = search.search_tree(ev, around, entropy_graph.edge_list(around))[0]
    ev.close()
    return found.to_df(spark)


@query()
def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    ev = search.Evaluator(coded, TRUE_N)
    around = entropy_graph.dimension_tree(ev.coded, d, None)
    rows = search.search_tree(ev, around, entropy_graph.edge_list(around))[1]
    ev.close()
    return spark.createDataFrame(rows, "round int, phase string, step int, cost double")


@query(f"WITH {_PAIRS} SELECT i AS subspace_id, CAST(least(pow(2, ceil(h - 1e-9)), k) AS INTEGER) AS num_codewords FROM h2 WHERE i % 2 = 0 AND j = i + 1")
def codeword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    return codebook.counts(spark, search.Evaluator(coded, TRUE_N), paired(d)).select("subspace_id", "num_codewords")


_WORDS = "w AS (SELECT a.dim AS s, a.b AS x, c.b AS y, count(*) AS size, avg(a.x) AS m0, avg(c.x) AS m1 FROM q a JOIN q c ON a.vec_id = c.vec_id AND a.dim % 2 = 0 AND c.dim = a.dim + 1 GROUP BY ALL), r AS (SELECT w.*, row_number() OVER (PARTITION BY s ORDER BY size DESC, x, y) - 1 AS code_id, least(pow(2, ceil(h - 1e-9)), k) AS most FROM w JOIN h2 ON h2.i = s AND h2.j = s + 1)"


@query(f"WITH {_PAIRS}, {_WORDS} SELECT s AS subspace_id, CAST(code_id AS INTEGER) AS code_id, size AS block_size, round(CAST(m0 AS FLOAT), 5) AS m0, round(CAST(m1 AS FLOAT), 5) AS m1 FROM r WHERE code_id < most")
def codebook_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _paired_codebook(spark, sf_dir)
    return words.select("subspace_id", "code_id", "block_size", F.round(F.element_at("codeword", 1), 5).alias("m0"), F.round(F.element_at("codeword", 2), 5).alias("m1"))


@query(f"WITH {_PAIRS}, {_WORDS} SELECT s AS subspace_id, count(*) AS codewords, CAST(sum(size) AS BIGINT) AS vectors FROM r WHERE code_id < most GROUP BY s")
def codebook_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired_codebook(spark, sf_dir).groupBy("subspace_id").agg(F.count(F.lit(1)).alias("codewords"), F.sum("block_size").alias("vectors"))


def _paired_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    return codebook.centroids(coded, codebook.counts(spark, search.Evaluator(coded, TRUE_N), paired(d)))


@query(f"WITH {_PAIRS} SELECT subspace_id, line_no, line FROM (SELECT i AS subspace_id, 0 AS line_no, 'Subspace ' || i || ':' AS line FROM h2 WHERE i % 2 = 0 AND j = i + 1 UNION ALL SELECT i, 1, 'Dimensions: ' || i || ' ' || j FROM h2 WHERE i % 2 = 0 AND j = i + 1 UNION ALL SELECT i, 2, 'Number of codewords: ' || CAST(least(pow(2, ceil(h - 1e-9)), k) AS INTEGER) FROM h2 WHERE i % 2 = 0 AND j = i + 1)")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded, d = _setup(spark, sf_dir)
    return sinks.summary_lines(codebook.counts(spark, search.Evaluator(coded, TRUE_N), paired(d)))


@query(
    f"WITH {_PAIRS}, {_WORDS}, k AS (SELECT * FROM r WHERE code_id < most) SELECT subspace_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT DISTINCT s AS subspace_id, 0 AS line_no, 'Subspace ' || s || ':' AS line FROM k UNION ALL SELECT DISTINCT s, 1, 'Dimensions: ' || s || ' ' || (s + 1) FROM k UNION ALL SELECT s, code_id + 2, printf('%.4f', CAST(CAST(m0 AS FLOAT) AS DOUBLE)) || ' ' || printf('%.4f', CAST(CAST(m1 AS FLOAT) AS DOUBLE)) FROM k)"
)
def codebook_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.codebook_lines(_paired_codebook(spark, sf_dir), 4)


#: whole designers, over few columns of all vectors: a dimension and a share of another, so that some columns have much in common
FEW = ((9, 26, 0.0), (9, 26, 0.125), (43, 60, 0.0), (43, 60, 0.25), (60, 60, 0.0))
FEW_TARGET = 0.02
FEW_MOST = 7


def _design_sql(equal: bool, correct: bool, tree: bool, words: bool) -> str:
    """Allocation, clusters, search, and codewords or their counts."""
    d = len(FEW)
    long = f"WITH RECURSIVE l AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(CAST(embedding[f.dims[i][1]] AS DOUBLE) + CAST(embedding[f.dims[i][2]] AS DOUBLE) * f.share[i] AS FLOAT) AS x FROM embeddings, (SELECT {[[i + 1, j + 1] for i, j, _ in FEW]} AS dims, {[x for *_, x in FEW]}::DOUBLE[] AS share) f, range(1, {d + 1}) r(i)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings)"
    ks = f"ks AS (SELECT dim, min(k) AS k FROM curve, n WHERE sse <= {FEW_TARGET} / {d} * n GROUP BY dim)"
    if not equal:
        bits = f"({TRUE_N}.0 * log2(k) + k * 32)"
        ks = (
            f"a1 AS (SELECT dim, k, lag(sse) OVER w - sse AS saved, (lag(sse) OVER w - sse) / ({bits} - lag({bits}) OVER w) AS eff FROM curve WINDOW w AS (PARTITION BY dim ORDER BY k)), "
            "a2 AS (SELECT *, min(eff) OVER (PARTITION BY dim ORDER BY k ROWS UNBOUNDED PRECEDING) AS worth FROM a1 WHERE k > 1), "
            "a3 AS (SELECT *, coalesce(sum(saved) OVER (ORDER BY worth DESC, dim DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a2), "
            f"ks AS (SELECT dim, 1 + count(*) FILTER (WHERE total - before > {FEW_TARGET} * n) AS k FROM a3, (SELECT sum(sse) AS total FROM curve WHERE k = 1), n GROUP BY dim)"
        )
    every = " UNION ALL ".join(f"SELECT {k} AS k, dim, m, c FROM d{k}" for k in range(1, FEW_MOST + 1))
    rest = "d.c + greatest(0.0, f.s2 - a.s2 - (f.s1 - a.s1) * (f.s1 - a.s1) / (f.n - a.n))"
    search_ = f"{_turns_sql(d)}, ends AS (SELECT {_BETTER} AS parts FROM r, bl ORDER BY nr DESC LIMIT 1)" if tree else f"{_merging_sql(d)}, ends AS (SELECT parts FROM r ORDER BY step DESC LIMIT 1)"
    members = f"list_filter(range(0, {d}), lambda i: (mask >> i) & 1 = 1)"
    head = (
        f"{_curve_sql(FEW_MOST, long)}, {ks}, every_d AS ({every}), "
        # where each dimension's clusters end, the last first
        f"ended AS (SELECT dim, k, m AS hi FROM ks JOIN last USING (dim) UNION ALL SELECT dim, k - 1, start FROM (SELECT g.dim, g.k, a.m AS start FROM ended g JOIN z f ON f.dim = g.dim AND f.m = g.hi JOIN every_d d ON d.dim = g.dim AND d.k = g.k - 1 AND d.m < g.hi JOIN z a ON a.dim = d.dim AND a.m = d.m WHERE g.k > 1 QUALIFY row_number() OVER (PARTITION BY g.dim ORDER BY {rest}, a.m) = 1)), "
        "o AS (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY x) AS m FROM v), "
        "code AS (SELECT o.dim, o.x, count(ended.hi) AS block FROM o LEFT JOIN ended ON ended.dim = o.dim AND ended.hi < o.m GROUP BY ALL), "
        "w0 AS (SELECT vec_id, list(CAST(block AS INTEGER) ORDER BY dim) AS codes, list(x ORDER BY dim) AS xs FROM l JOIN code USING (dim, x) GROUP BY vec_id)"
    )
    head += f", {_costs_sql(d, correct).replace('FROM v, range', 'FROM w0, range')}, {search_}, "
    head += f"subs AS (SELECT e.mask, {members} AS dims, CAST(least(pow(2, ceil(log2(clusters) - 1e-9)), blocks) AS INTEGER) AS num FROM ends, e WHERE list_contains(ends.parts, e.mask))"
    names = "CAST(dims[1] AS INTEGER) AS subspace_id, list_aggregate(list_transform(dims, lambda i: CAST(i AS VARCHAR)), 'string_agg', ' ') AS dims"
    if not words:
        return f"{head} SELECT {names}, num AS num_codewords FROM subs"
    return (
        f"{head}, b0 AS (SELECT mask, dims, num, key, count(*) AS size, list(xs) AS own FROM (SELECT *, list_transform(dims, lambda i: codes[i + 1]) AS key FROM w0, subs) GROUP BY mask, dims, num, key), "
        "b AS (SELECT mask, dims, num, key, size, list_transform(dims, lambda i: list_avg(list_transform(own, lambda x: CAST(x[i + 1] AS DOUBLE)))) AS means FROM b0), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY size DESC, key) - 1 AS code_id FROM b) "
        f"SELECT {names}, CAST(code_id AS INTEGER) AS code_id, size AS block_size, list_aggregate(list_transform(means, lambda x: printf('%.4f', CAST(CAST(x AS FLOAT) AS DOUBLE))), 'string_agg', ' ') AS codeword FROM k WHERE code_id < num"
    )


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i + 1).cast("double")
    return V.read_parquet(spark, sf_dir).select("vec_id", F.array(*[(at(i) + at(j) * F.lit(x)).cast("float") for i, j, x in FEW]).alias("embedding"))


def _listed(c: str) -> Column:
    return F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))


def _shown(codebook_: DataFrame) -> DataFrame:
    word = F.concat_ws(" ", F.transform("codeword", lambda x: F.format_string("%.4f", x.cast("double"))))
    return codebook_.select("subspace_id", _listed("dims").alias("dims"), "code_id", "block_size", word.alias("codeword"))


@query(_design_sql(equal=True, correct=False, tree=False, words=False))
def simplified_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipelines.recommend(_few(spark, sf_dir), Params(TRUE_N, FEW_TARGET)).summary
    return found.select("subspace_id", _listed("dims").alias("dims"), "num_codewords")


@query(_design_sql(equal=False, correct=True, tree=False, words=True))
def hybrid_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(pipelines.fit_allpairs(_few(spark, sf_dir), Params(TRUE_N, FEW_TARGET, correct=True)).codebook)


@query(_design_sql(equal=False, correct=False, tree=True, words=True))
def tree_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(pipelines.fit_tree(_few(spark, sf_dir), Params(TRUE_N, FEW_TARGET, max_degree=-1)).codebook)


@query()
def simplified_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.recommend(V.read_parquet(spark, sf_dir), Params(TRUE_N, TARGET)).summary


@query()
def hybrid_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.fit_allpairs(V.read_parquet(spark, sf_dir), Params(TRUE_N, TARGET, correct=True)).codebook


@query()
def tree_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.fit_tree(V.read_parquet(spark, sf_dir), Params(TRUE_N, TARGET)).codebook
