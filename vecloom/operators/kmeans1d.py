"""Optimal one-dimensional k-means for every dimension, and the allocation of clusters among them.

Equal values always share a cluster, so a dimension is first aggregated to its distinct values with
counts.  A table of more than EXACT vectors is summed up in BINS bins of each dimension instead, whose
counts, sums and squares are added up map-side: clusters then end between bins, and how far their
error can be from the best is stated.  The dynamic program over values or bins is the only kernel.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.cost import FLOAT_BITS
from vecloom.operators.ranges import running
from vecloom.sources.vectors import components

#: vectors whose distinct values go to one task for each dimension
EXACT = 1 << 20
#: bins of a dimension of more vectors
BINS = 1 << 16
#: clusters that curves are drawn for at first; their length doubles while that is too short
FIRST = 4


def ranked(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x, rank and running sums of x and x*x in value order (ties by vec_id), over ranges of each dimension."""
    x = F.col("x")
    sums = {"rank": F.lit(1), "s1": x.cast("double"), "s2": (x * x).cast("double")}
    before = running(components(vectors), [x.asc(), F.col("vec_id").asc()], sums, "dim")
    return before.select("vec_id", "dim", "x", *[(F.col(name) + c).cast("int" if name == "rank" else "double").alias(name) for name, c in sums.items()])


def interval_sse(n: Column, s1: Column, s2: Column) -> Column:
    """Sum of squared errors of n values around their mean, from their sums."""
    return F.greatest(F.lit(0.0), s2 - s1 * s1 / n)


def sse_of_one(vectors: DataFrame) -> DataFrame:
    """dim, n, sse of a single cluster."""
    x = F.col("x").cast("double")
    return components(vectors).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), interval_sse(F.count(F.lit(1)), F.sum(x), F.sum((F.col("x") * F.col("x")).cast("double"))).alias("sse"))


def values(vectors: DataFrame) -> DataFrame:
    """dim, x, n: distinct values, aggregated before anything is shuffled."""
    return components(vectors).groupBy("dim", "x").agg(F.count(F.lit(1)).alias("n"))


POINTS = "dim int, lo float, hi float, n long, s1 double, s2 double"


def exact_points(vectors: DataFrame) -> DataFrame:
    """A point for each distinct value: dim, lo and hi (the value), n, and the sums s1 of x and s2 of x*x."""
    x, n = F.col("x"), F.col("n")
    return values(vectors).select("dim", x.alias("lo"), x.alias("hi"), "n", (n * x.cast("double")).alias("s1"), (n * (x * x).cast("double")).alias("s2"))


def binned_points(vectors: DataFrame, bins: int) -> DataFrame:
    """A point for each bin of a dimension's range that has values: its least and largest, count and sums."""
    x = F.col("x")
    long = components(vectors)
    ranges = long.groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))  # a row per dimension
    bin_ = F.least(F.floor((x.cast("double") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    bin_ = F.when(F.col("high") > F.col("low"), bin_).otherwise(F.lit(0)).cast("int")
    return long.join(F.broadcast(ranges), "dim").groupBy("dim", bin_.alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(x.cast("double")).alias("s1"), F.sum((x * x).cast("double")).alias("s2")).drop("bin")


def points(vectors: DataFrame, exact: int = EXACT, bins: int = BINS) -> DataFrame:
    """What the dynamic program runs over: at most ``exact`` distinct values a dimension, or ``bins`` bins of more vectors.

    With bins, a clustering's error is still the exact one of its values.  Let W be the error of the
    bins around their own means and B the error of the best clustering of those means: the clustering
    found has B + W, and the best of all, O, has sqrt(O) >= sqrt(B) - sqrt(W), since moving every
    value to its bin's mean changes the distance of values and centres by sqrt(W) at most.  Bins of
    one value each have W = 0.
    """
    return exact_points(vectors) if vectors.count() <= exact else binned_points(vectors, bins)


class Intervals:
    """SSE of runs of sorted points, in constant time each."""

    def __init__(self, x: np.ndarray, n: np.ndarray) -> None:
        self._sum(n, n * x.astype(np.float64), n * (x * x).astype(np.float64))  # squares keep the precision of the values

    def _sum(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> None:
        sums = lambda x: np.concatenate([[0.0], np.cumsum(np.asarray(x, np.float64))])
        self.n, self.s1, self.s2 = sums(n), sums(s1), sums(s2)
        self.within = 0.0

    @classmethod
    def of_points(cls, t: pa.Table) -> Intervals:
        """Of a dimension's points in order; within is their own error."""
        out = cls.__new__(cls)
        n, s1, s2 = (t[c].to_numpy() for c in ("n", "s1", "s2"))
        out._sum(n, s1, s2)
        spread = (t["lo"].to_numpy() < t["hi"].to_numpy()).astype(float)
        out.within = float((np.maximum(0.0, s2 - s1 * s1 / n) * spread).sum())
        return out

    def __len__(self) -> int:
        return len(self.n) - 1

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of points i to j, both included."""
        n, s1, s2 = self.n[j + 1] - self.n[i], self.s1[j + 1] - self.s1[i], self.s2[j + 1] - self.s2[i]
        return np.maximum(0.0, s2 - s1 * s1 / n)


def next_row(cost: Intervals, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The program's next row and where each last cluster starts, k clusters before it.

    Starts never decrease along a row (the cost is concave Monge), so the middle of a range bounds
    both halves.  All middles of one depth are done at once: O(m log m) for m values.
    """
    m = len(row)
    out, start = np.full(m, np.inf), np.zeros(m, np.int64)
    lo, hi = np.array([k]), np.array([m - 1])
    a, b = np.array([k]), np.array([m - 1])
    while len(lo):
        keep = lo <= hi
        lo, hi, a, b = lo[keep], hi[keep], a[keep], b[keep]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        top = np.minimum(b, mid)
        size = top - a + 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.arange(size.sum()) - np.repeat(first - a, size)
        j = np.repeat(mid, size)
        got = row[i - 1] + cost(i, j)
        best = np.minimum.reduceat(got, first)
        hit = np.flatnonzero(got == np.repeat(best, size))
        at = hit[np.searchsorted(hit, first)]  # the leftmost
        out[mid], start[mid] = best, i[at]
        lo, hi, a, b = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([a, i[at]]), np.concatenate([i[at], b])
    return out, start


def program(cost: Intervals, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The program's rows for 1, 2, ... clusters, up to ``most`` or the number of points, and where last clusters start."""
    m = len(cost)
    row, start = cost(np.zeros(m, np.int64), np.arange(m)), np.zeros(m, np.int64)
    yield row, start
    for k in range(1, min(most, m)):
        row, start = next_row(cost, row, k)
        yield row, start


def curve(x: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """SSE for 1, 2, ... clusters of values x with counts n, up to ``most`` or the number of values."""
    return _curve(Intervals(x, n), most)


def _curve(cost: Intervals, most: int) -> np.ndarray:
    return np.array([row[-1] for row, _ in program(cost, most)])


def clusters(x: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Where each of k clusters starts among the sorted values."""
    return _clusters(Intervals(x, n), k)


def _clusters(cost: Intervals, k: int) -> np.ndarray:
    starts = [start for _, start in program(cost, k)]
    out, end = [], len(cost) - 1
    for s in reversed(starts):
        out.append(int(s[end]))
        end = out[-1] - 1
    return np.array(out[::-1])


def penalised(x: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """Where clusters of values x with counts n start if each costs ``penalty`` besides its error.

    Later starts win over earlier ones from some end on and stay ahead (the cost is concave Monge).
    So starts are held in the order in which they take over, each with the first end it is best for;
    a new one drops those at the back that it beats from their first end on, and finds by bisection
    where it takes over from the last that is left: O(m log m).
    """
    return _penalised(Intervals(x, n), penalty)


def _penalised(cost: Intervals, penalty: float) -> np.ndarray:
    m = len(cost)
    n, s1, s2 = cost.n.tolist(), cost.s1.tolist(), cost.s2.tolist()
    best, back = [0.0] * (m + 1), [0] * (m + 1)

    def with_last(i: int, j: int) -> float:
        d = s1[j] - s1[i]
        return best[i] + max(0.0, s2[j] - s2[i] - d * d / (n[j] - n[i])) + penalty

    starts, since, head = [0], [1], 0
    for j in range(1, m + 1):
        while head + 1 < len(starts) and since[head + 1] <= j:
            head += 1
        back[j] = starts[head]
        best[j] = with_last(back[j], j)
        if j == m:
            break
        while since[-1] > j and with_last(j, since[-1]) < with_last(starts[-1], since[-1]):
            starts.pop(), since.pop()
        lo, hi = max(j, since[-1]) + 1, m + 1
        while lo < hi:  # the first end from which j is better than the last start
            mid = (lo + hi) // 2
            if with_last(j, mid) < with_last(starts[-1], mid):
                hi = mid
            else:
                lo = mid + 1
        if lo <= m:
            starts.append(j), since.append(lo)
    out, at = [], m
    while at:
        at = back[at]
        out.append(at)
    return np.array(out[::-1])


def _in_order(t: pa.Table) -> tuple[pa.Table, Intervals]:
    t = t.sort_by("lo")
    return t, Intervals.of_points(t)


def penalised_counts(found: DataFrame, share: float) -> DataFrame:
    """dim, k: clusters of each dimension if each costs this share of the dimension's whole error.  found: points()."""

    def run(t: pa.Table) -> pa.Table:
        cost = _in_order(t)[1]
        start = _penalised(cost, float(_curve(cost, 1)[0]) * share)
        return pa.table({"dim": pa.array([t["dim"][0].as_py()], pa.int32()), "k": pa.array([len(start)], pa.int32())})

    return found.groupBy("dim").applyInArrow(run, "dim int, k int")


def error_curve(vectors: DataFrame, most: int) -> DataFrame:
    """dim, k, sse for k up to ``most`` or the number of distinct values."""
    return curve_of(points(vectors), most).select("dim", "k", "sse")


def curve_of(found: DataFrame, most: int) -> DataFrame:
    """dim, k, sse, least for k up to ``most`` or the number of points; least: what the best clustering has at least."""

    def run(t: pa.Table) -> pa.Table:
        cost = _in_order(t)[1]
        sse = _curve(cost, most)
        least = np.maximum(0.0, np.sqrt(np.maximum(0.0, sse - cost.within)) - np.sqrt(cost.within)) ** 2 if cost.within else sse
        return pa.table({"dim": pa.array([t["dim"][0].as_py()] * len(sse), pa.int32()), "k": pa.array(np.arange(1, len(sse) + 1), pa.int32()), "sse": sse, "least": least})

    return found.groupBy("dim").applyInArrow(run, "dim int, k int, sse double, least double")


def blocks(vectors: DataFrame, ks: dict[int, int]) -> DataFrame:
    """dim, block_id (ascending by value), lo, hi, n, mean, sse for ks[dim] clusters of each dimension."""
    return blocks_of(points(vectors), ks)


def blocks_of(found: DataFrame, ks: dict[int, int]) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t, cost = _in_order(t)
        dim = t["dim"][0].as_py()
        start = _clusters(cost, ks[dim])
        end = np.append(start[1:], len(cost))
        size = np.add.reduceat(t["n"].to_numpy(), start)
        mean = np.add.reduceat(t["s1"].to_numpy(), start) / size
        return pa.table({"dim": pa.array([dim] * len(start), pa.int32()), "block_id": pa.array(np.arange(len(start)), pa.int32()), "lo": t["lo"].take(start), "hi": t["hi"].take(end - 1), "n": size, "mean": mean, "sse": cost(start, end - 1)})

    return found.groupBy("dim").applyInArrow(run, "dim int, block_id int, lo float, hi float, n long, mean double, sse double")


def codes(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """vec_id, embedding, codes: the block of each component.  found: from blocks(); dims * clusters numbers are broadcast."""
    rows = found.select("dim", "block_id", "lo").toArrow().sort_by([("dim", "ascending"), ("block_id", "ascending")])
    lo, dim = rows["lo"].to_numpy(), rows["dim"].to_numpy()
    bounds = [lo[a:b] for a, b in itertools.pairwise(np.searchsorted(dim, np.arange(dim.max() + 2)))] if len(dim) else []
    shared = vectors.sparkSession.sparkContext.broadcast(bounds)
    vectors = vectors.select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            out = np.empty(x.shape, np.int32)
            for i in range(x.shape[1]):
                out[:, i] = np.searchsorted(own[i], x[:, i], "right") - 1
            ends = np.arange(0, out.size + 1, max(1, x.shape[1]), dtype=np.int32)[: b.num_rows + 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["vec_id", "embedding", "codes"])

    return vectors.mapInArrow(run, vectors.withColumn("codes", F.array(F.lit(0))).schema)


def assignments(coded: DataFrame) -> DataFrame:
    """vec_id, dim, block_id."""
    return coded.select("vec_id", F.posexplode("codes").alias("dim", "block_id"))


def target_k(curves: DataFrame, budget: float) -> DataFrame:
    """dim, k, sse: the fewest clusters with an SSE of at most ``budget``."""
    return curves.where(F.col("sse") <= budget).groupBy("dim").agg(F.min_by(F.struct("k", "sse"), "k").alias("b")).select("dim", "b.k", "b.sse")


def allocation(curves: DataFrame, budget: float, true_n: int) -> DataFrame:
    """dim, k: clusters added one by one where they save most error per bit, until all errors
    together are at most ``budget``.

    Adding clusters in this order is a sort: a dimension's next cluster comes no later than its
    best one so far, so clusters go by the running minimum of their efficiency; ties to the larger
    dimension.  What was saved before each is added up over ranges of that order.
    """
    by = Window.partitionBy("dim").orderBy("k")
    bits = F.lit(float(true_n)) * F.log2(F.col("k").cast("double")) + F.col("k") * FLOAT_BITS
    steps = curves.withColumn("bits", bits).withColumn("saved", F.lag("sse").over(by) - F.col("sse")).withColumn("extra", F.col("bits") - F.lag("bits").over(by)).where("k > 1")
    steps = steps.withColumn("worth", F.min(F.col("saved") / F.col("extra")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = curves.where("k = 1").agg(F.sum("sse").alias("total"))
    steps = running(steps, [F.desc("worth"), F.desc("dim"), F.col("k").asc()], {"before": F.col("saved")})
    taken = steps.crossJoin(F.broadcast(total)).where(F.col("total") - F.col("before") > budget).groupBy("dim").agg(F.count(F.lit(1)).alias("more"))
    return curves.where("k = 1").join(taken, "dim", "left").select("dim", (F.coalesce("more", F.lit(0)) + 1).cast("int").alias("k"))


def allocate(found: DataFrame, budget: float, true_n: int, first: int = FIRST) -> dict[int, int]:
    """The allocation over points(), on curves long enough for it: their length doubles until no
    dimension with more points has used its curve up, nor the budget is missed."""
    many = sizes(found)
    most = first
    while True:
        curves = curve_of(found, most).persist()
        ks = {r.dim: r.k for r in allocation(curves, budget, true_n).collect()}
        curves.unpersist()
        if not any(ks[i] >= most and many[i] > most for i in ks):
            return ks
        most *= 2


def sizes(found: DataFrame) -> dict[int, int]:
    """The number of points of each dimension."""
    return {r.dim: r.n for r in found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}


def quality(found: DataFrame) -> DataFrame:
    """dim, k, imbalance: k * sum of squared sizes over the square of their sum."""
    n = F.col("n").cast("double")
    return found.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("k"), (F.count(F.lit(1)) * F.sum(n * n) / F.pow(F.sum(n), F.lit(2.0))).alias("imbalance"))
