"""Approximate nearest neighbours by cosine: NN-descent builds a graph, queries walk it greedily.

Equal vectors are one node.  The first lists come from random-hyperplane blocks; then rounds of
NN-descent join each node's neighbours with each other (neighbours of neighbours) and keep every
node's best, until few entries change.  Only pairs of which one has come in since the last round are
looked at: the others were.  A query starts at its own node and at a few fixed entries,
and expands the best nodes found that it hasn't expanded yet, until none of its best ``width`` is
left.  Recall is then measured on a sample of queries against all vectors, and all searches go on
with twice the width until it is high enough.  The graph is built from half-precision unit vectors;
scores come from the original ones in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import checkpoint, drop, mix, table

ENTRIES = 16
LIST = "node long, other long, near float"
#: entries of the graph, and whether they came in with the last round
GRAPH = LIST + ", new boolean"
#: the same of many nodes at once, packed: shuffles carry a row for two buckets that have to do with each other, not one for each entry
PACKED = "node binary, other binary, near binary, new binary"
EDGES = "bucket long, " + PACKED
#: nodes and queries of a bucket, about
BUCKET, ASKING = 2048, 128
#: what comes from no other bucket: neighbourhoods, and the last of each list
LISTS, LAST = -1, -2
#: queries whose true neighbours are looked up, and the recall that they must show, less two standard errors
SAMPLE, RECALL = 512, 0.9


def _matrix(column: pa.Array, d: int, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the unit vector in half precision as bytes."""
    for b in rows:
        v = b.column("embedding")
        d = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(d)])
        norm = np.sqrt(np.add.reduceat(flat * flat, at[:-1])) if len(flat) else np.zeros(len(d))
        unit = (flat / np.repeat(norm, d)).astype(np.float16).tobytes()
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(d.astype(np.int32)), pa.array([unit[2 * i : 2 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "d", "unit"])


def _best(node: np.ndarray, other: np.ndarray, near: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each node's k nearest different others; what was there before isn't new if it is found again."""
    if not len(node):
        return node, other, near, new
    order = np.lexsort((new, other, node))
    node, other, near, new = node[order], other[order], near[order], new[order]
    one = np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])])
    node, other, near, new = node[one], other[one], near[one], new[one]
    order = np.lexsort((other, -near, node))
    node, other, near, new = node[order], other[order], near[order], new[order]
    first = np.concatenate([[True], node[1:] != node[:-1]])
    at = np.arange(len(node))
    keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return node[keep], other[keep], near[keep], new[keep]


def _joined(t: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    """The arrays of a packed column, one after the other."""
    return np.frombuffer(b"".join(t[name].to_pylist()), kind)


def _split(bucket: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """A row for each bucket: its number, and the packed part of every column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    edge = np.append(first, len(bucket))
    out = [pa.array(bucket[first].astype(np.int64))]
    for c in columns:
        data = np.ascontiguousarray(c[order])
        size = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
        out.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edge * size).astype(np.int32)), pa.py_buffer(data)]))
    return out


def _place(node: np.ndarray, d: int, parts: int) -> np.ndarray:
    """The bucket of each node; vectors of different lengths share none."""
    return (int(d) << 32) + (mix(node.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _edges(node: np.ndarray, other: np.ndarray, near: np.ndarray, new: np.ndarray, d: int, parts: int) -> pa.Table:
    """Entries packed by their node's bucket."""
    return pa.table(_split(_place(node, d, parts), node.astype(np.int64), other.astype(np.int64), near.astype(np.float32), new.astype(bool)), ["bucket", "node", "other", "near", "new"])


def _entries(t: pa.Table) -> tuple[np.ndarray, ...]:
    return _joined(t, "node"), _joined(t, "other"), _joined(t, "near", np.float32), _joined(t, "new", bool)


def _rows(edges: DataFrame) -> DataFrame:
    """Packed entries as rows."""

    def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _entries(pa.Table.from_batches([b]))], ["node", "other", "near", "new"])

    return edges.mapInArrow(unpack, GRAPH)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One packed row for each bucket: the k best entries of its nodes."""

    def merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for b in rows:
            got.append(_entries(pa.Table.from_batches([b])))
            held += len(got[-1][0])
            if held > 2_000_000:
                got = [_best(*(np.concatenate(x) for x in zip(*got, strict=True)), k)]
                held = len(got[0][0])
        best = _best(*(np.concatenate(x) for x in zip(*got, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in best)], ["bucket", "node", "other", "near", "new"])

    return lists.groupBy("bucket").applyInArrow(merge, EDGES)


def _vectors(nodes: DataFrame, column: str, kind: type, parts: int) -> DataFrame:
    """bucket, ids, vectors: the nodes of each bucket and a packed column of theirs, in some rows."""

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            v = b.column(column)
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == d))
                v, ids = own.column(column), own.column("node").to_numpy()
                x = _matrix(v, d, kind) if pa.types.is_binary(v.type) else v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                yield pa.RecordBatch.from_arrays(_split(_place(ids, d, parts), ids, x), ["bucket", "ids", "vectors"])

    def whole(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t["bucket"].slice(0, 1), "ids": pa.array([b"".join(t["ids"].to_pylist())], pa.binary()), "vectors": pa.array([b"".join(t["vectors"].to_pylist())], pa.binary())})

    schema = "bucket long, ids binary, vectors binary"
    return table(nodes.mapInArrow(deal, schema).groupBy("bucket").applyInArrow(whole, schema), "vectors")


def _blocks(nodes: DataFrame, trees: int, block: int, k: int, n: int) -> DataFrame:
    """The first lists as rows."""
    return _rows(_first_lists(nodes, trees, block, k, n, 1))


def _first_lists(nodes: DataFrame, trees: int, block: int, k: int, n: int, parts: int) -> DataFrame:
    """First lists, packed: nodes that fall on the same sides of random planes, in blocks of about ``block``."""
    bits = max(0, (n // block).bit_length() - 1)

    def sides(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            d = b.column("d").to_numpy()
            for length in np.unique(d):
                own = b.filter(pa.array(d == length))
                x = _matrix(own.column("unit"), int(length), np.float16).astype(np.float32)
                for t in range(trees):
                    planes = np.random.default_rng([t, int(length)]).standard_normal((int(length), bits)).astype(np.float32)
                    code = (x @ planes > 0) @ (1 << np.arange(bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([own.column("node"), own.column("d"), own.column("unit"), pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64))], ["node", "d", "unit", "tree", "code"])

    coded = nodes.mapInArrow(sides, "node long, d int, unit binary, tree int, code long")
    sizes = coded.groupBy("d", "tree", "code").agg(F.count(F.lit(1)).alias("size"))
    coded = coded.join(sizes, ["d", "tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.expr(f"size div {block} + 1")))

    def lists(t: pa.Table) -> pa.Table:
        ids, d = t["node"].to_numpy(), t["d"][0].as_py()
        x = _matrix(t["unit"], d, np.float16).astype(np.float32)
        out = []
        for at in range(0, len(x), 256):
            s = x[at : at + 256] @ x.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -2
            m = min(k, len(ids) - 1)
            if m <= 0:
                continue
            j = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append((np.repeat(ids[at : at + 256], m), ids[j].ravel(), np.take_along_axis(s, j, 1).ravel()))
        node, other, near = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return _edges(node, other, near, np.ones(len(node), bool), d, parts)

    return coded.groupBy("d", "tree", "code", "part").applyInArrow(lists, EDGES)


def _turned(graph: DataFrame, parts: int) -> DataFrame:
    """Entries the other way round, packed by the bucket of the node that was the other."""

    def turn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                node, other, near, new = _entries(pa.Table.from_batches([b.slice(i, 1)]))
                yield from _edges(other, node, near, new, b.column("bucket")[i].as_py() >> 32, parts).to_batches()

    return graph.mapInArrow(turn, EDGES)


def _descend(graph: DataFrame, vectors: DataFrame, k: int, back: int, parts: int) -> DataFrame:
    """Entries of one round, packed: within each node's neighbourhood, pairs that beat the last of a list.

    Of two neighbours that meet at least one is new to the node.  A node itself is among its neighbours,
    so that it gets into the lists of those that it has.  A bucket asks others for the vectors it needs, once each.
    """
    both = graph.withColumn("turned", F.lit(False)).unionByName(_turned(graph, parts).withColumn("turned", F.lit(True)))

    def around(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        turned = t["turned"].to_numpy()
        node, other, near, new = _entries(t.filter(pa.array(~turned)))
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        last = np.minimum.reduceat(near, first) if len(node) else near
        # of a node that is in many lists, the nearest that have it
        by, of, _, came = _best(*_entries(t.filter(pa.array(turned))), back)
        ids = np.unique(np.concatenate([node, by]))
        a, o, f = np.concatenate([node, by, ids]), np.concatenate([other, of, ids]), np.concatenate([new, came, np.zeros(len(ids), bool)])
        order = np.lexsort((~f, o, a))
        a, o, f = a[order], o[order], f[order]
        one = np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])])
        a, o, f = a[one], o[one], f[one]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        some = np.repeat(np.logical_or.reduceat(f, start), np.diff(np.append(start, len(a))))
        a, o, f = a[some], o[some], f[some]
        need = np.unique(o)
        to, asked = _split(_place(need, bucket >> 32, parts), need)
        none, m = [b""] * len(to), len(to)
        own = lambda x: pa.array([x.tobytes()], pa.binary())
        blank = pa.array([b""], pa.binary())
        gaps = pa.array(none, pa.binary())
        return pa.table(
            {
                "bucket": pa.concat_arrays([pa.array([bucket, bucket], pa.int64()), to]),
                "source": pa.array([LISTS, LAST] + [bucket] * m, pa.int64()),
                "node": pa.concat_arrays([own(a), own(node[first]), asked]),
                "other": pa.concat_arrays([own(o), blank, gaps]),
                "near": pa.concat_arrays([blank, own(last), gaps]),
                "new": pa.concat_arrays([own(f), blank, gaps]),
            }
        )

    def answer(key: tuple, own: pa.Table, asks: pa.Table) -> pa.Table:
        d = key[0].as_py() >> 32
        ids = _joined(own, "ids")
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(own["vectors"], d, np.float16)[order]
        last = np.full(len(ids), -2, np.float32)
        out = []
        source = asks["source"].to_numpy()
        held = asks.filter(pa.array(source == LAST))
        last[np.searchsorted(ids, _joined(held, "node"))] = _joined(held, "near", np.float32)
        for i in np.flatnonzero(source >= 0).tolist():
            need = asks["node"][i].as_py()
            at = np.searchsorted(ids, np.frombuffer(need, np.int64))
            out.append((int(source[i]), need, x[at].tobytes(), last[at].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "ids", "vectors", "last"])

    def found(key: tuple, lists: pa.Table, held: pa.Table) -> pa.Table:
        """The better pairs of a bucket's neighbourhoods."""
        d = key[0].as_py() >> 32
        node, other, new, ids = _joined(lists, "node"), _joined(lists, "other"), _joined(lists, "new", bool), _joined(held, "ids")
        order = np.argsort(ids)
        at = order[np.searchsorted(ids, other, sorter=order)]
        vectors, last = _matrix(held["vectors"], d, np.float16), _joined(held, "last", np.float32)[at]
        got, out, size = [], [], 0

        def keep() -> None:
            a, o, s = (np.concatenate(v) for v in zip(*out, strict=True))
            got.append(_best(a, o, s, np.ones(len(a), bool), k))
            out.clear()

        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=False):
            x = vectors[at[i:j]].astype(np.float32)
            fresh = np.flatnonzero(new[i:j])
            s = x[fresh] @ x.T
            s[np.arange(len(fresh)), fresh] = -2
            r, c = np.nonzero(s > last[i:j])
            out.append((other[i + c], other[i + fresh[r]], s[r, c]))
            size += len(r)
            r, c = np.nonzero((s > last[i + fresh, None]) & ~new[i:j])  # two new ones meet as row and column already
            out.append((other[i + fresh[r]], other[i + c], s[r, c]))
            size += len(r)
            if size > 1_000_000:
                keep()
                size = 0
        if out:
            keep()
        if len(got) > 1:
            got = [_best(*(np.concatenate(v) for v in zip(*got, strict=True)), k)]
        none = np.zeros(0, np.int64)
        return _edges(*(got[0] if got else (none, none, none, none)), d, parts)

    steps = table(both.groupBy("bucket").applyInArrow(around, f"bucket long, source long, {PACKED}"), "around")
    held = vectors.groupBy("bucket").cogroup(steps.where(F.col("source") != LISTS).groupBy("bucket")).applyInArrow(answer, "bucket long, ids binary, vectors binary, last binary")
    # much work on few bytes: Spark would make few tasks of it
    tasks = max(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 4)
    lists, held = (x.repartition(tasks, "bucket").groupBy("bucket") for x in (steps.where(F.col("source") == LISTS), held))
    out = lists.cogroup(held).applyInArrow(found, EDGES)
    out.steps = steps
    return out


def _graph(nodes: DataFrame, n: int, k: int, trees: int, block: int, settled: float, back: int, parts: int) -> DataFrame:
    """The neighbour graph, packed: k others of each node."""

    def tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            new = _joined(pa.Table.from_batches([b]), "new", bool)
            yield pa.RecordBatch.from_arrays([pa.array([int(new.sum())]), pa.array([len(new)])], ["came", "all_of"])

    vectors = _vectors(nodes, "unit", np.float16, parts)
    graph = table(_merged(_first_lists(nodes, trees, block, k, n, parts), k), "graph")

    def aged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            old = pa.array([bytes(len(x.as_buffer())) for x in b.column("new")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], old], b.schema.names)

    while True:
        last = graph
        found = _descend(last, vectors, k, back, parts)
        graph = table(_merged(last.mapInArrow(aged, EDGES).unionByName(found), k), "graph")
        drop(last, found.steps)
        came, all_of = graph.mapInArrow(tally, "came long, all_of long").agg(F.sum("came"), F.sum("all_of")).first()
        if (came or 0) <= settled * (all_of or 0):
            drop(vectors)
            return graph


def _parts(n: int, size: int) -> int:
    """Buckets of about ``size``; of few rows, 24 if each then has a dozen."""
    return max(1, n // size, min(24, n // 12))


def build(nodes: DataFrame, k: int = 24, trees: int = 4, block: int = 2048, settled: float = 0.1, back: int = 16) -> DataFrame:
    """The neighbour graph (node, other, near, new): k others of each node.  nodes: node, d, unit.

    Rounds go on until at most the share ``settled`` of the entries is new.
    """
    n = nodes.count()
    return _rows(_graph(nodes, n, k, trees, block, settled, back, _parts(n, BUCKET)))


def _truth(first: DataFrame, picked: DataFrame, k: int) -> DataFrame:
    """home, edge, most: the score of each picked home's k-th nearest other node, of all of its length; how many that are.

    first: node, embedding.  picked: home, q, so few that they are sent to all executors.
    """
    asked: dict[int, list] = {}
    for r in picked.select("home", "q").collect():
        asked.setdefault(len(r.q), []).append(r)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    shared = first.sparkSession.sparkContext.broadcast({d: (np.array([r.home for r in rows]), unit(np.array([r.q for r in rows]))) for d, rows in asked.items()})

    def tops(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            v = b.column("embedding")
            d = np.diff(v.offsets.to_numpy())
            for length in np.unique(d):
                if int(length) not in shared.value:
                    continue
                own = b.filter(pa.array(d == length))
                home, q = shared.value[int(length)]
                x = unit(own.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(length)))
                s = q @ x.T
                s[home[:, None] == own.column("node").to_numpy()] = -2  # no neighbour of itself
                m = min(k, s.shape[1])
                near = -np.partition(-s, m - 1, axis=1)[:, :m]
                keep = near > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(home, keep.sum(1))), pa.array(near[keep])], ["home", "near"])

    near = first.select("node", "embedding").mapInArrow(tops, "home long, near double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("home").orderBy(F.desc("near")))).where(F.col("r") <= k)
    return checkpoint(best.groupBy("home").agg(F.min("near").alias("edge"), F.count(F.lit(1)).alias("most")))


def _recall(seen: DataFrame, truth: DataFrame, of: int) -> float:
    """The mean share of true neighbours that were seen, less two standard errors.  of: queries that truth is a sample of."""
    hit = seen.join(F.broadcast(truth), "home").where((F.col("node") != F.col("home")) & (F.col("score") >= F.col("edge") - 1e-9))
    hits = hit.groupBy("home").agg(F.count(F.lit(1)).alias("hits"))
    rows = truth.join(hits, "home", "left").select((F.least(F.coalesce("hits", F.lit(0)), "most") / F.col("most")).alias("share")).collect()  # SAMPLE at most
    share = np.array([r.share for r in rows])
    return 1.0 if not len(share) else float(share.mean() - 2 * share.std() * np.sqrt(max(0, 1 - len(share) / of) / len(share)))


#: the searches of a bucket: its queries and their vectors, then who has seen which node, its score and whether it may yet be expanded
STATE = "bucket long, homes binary, q binary, home binary, node binary, score binary, open binary"


def _ways(graph: DataFrame, parts: int) -> DataFrame:
    """bucket, node, other: entries both ways, sorted by node."""

    def join(key: tuple, t: pa.Table) -> pa.Table:
        node, other = _joined(t, "node"), _joined(t, "other")
        order = np.lexsort((other, node))
        node, other = node[order], other[order]
        one = np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])])[: len(node)]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([node[one].tobytes()], pa.binary()), pa.array([other[one].tobytes()], pa.binary())], ["bucket", "node", "other"])

    out = table(graph.unionByName(_turned(graph, parts)).select("bucket", "node", "other").groupBy("bucket").applyInArrow(join, "bucket long, node binary, other binary"), "ways")
    drop(graph)
    return out


def _begin(homes: DataFrame, entries: list[tuple[int, int]], groups: int) -> tuple[DataFrame, DataFrame]:
    """Searches that have seen nothing, and what they reach first: their own nodes and the entries."""

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            lengths = np.diff(b.column("q").offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == d))
                ids, q = own.column("home").to_numpy(), own.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                yield pa.RecordBatch.from_arrays(_split(_place(ids, d, groups), ids, q), ["bucket", "homes", "q"])

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        homes = _joined(t, "homes")
        order = np.argsort(homes)
        q = _joined(t, "q", np.float64).reshape(len(homes), -1)[order]
        blank = pa.array([b""], pa.binary())
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([homes[order].tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary()), blank, blank, blank, blank], ["bucket", "homes", "q", "home", "node", "score", "open"])

    def reach(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for bucket, homes in zip(b.column("bucket").to_pylist(), b.column("homes").to_pylist(), strict=True):
                ids = np.frombuffer(homes, np.int64)
                to = np.array([e for e, d in entries if d == bucket >> 32], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([np.concatenate([ids, np.repeat(ids, len(to))]).tobytes()], pa.binary()), pa.array([np.concatenate([ids, np.tile(to, len(ids))]).tobytes()], pa.binary())], ["bucket", "home", "node"])

    states = table(homes.mapInArrow(deal, "bucket long, homes binary, q binary").groupBy("bucket").applyInArrow(whole, STATE), "searches")
    return states, states.mapInArrow(reach, "bucket long, home binary, node binary")


def _reached(front: DataFrame, ways: DataFrame) -> DataFrame:
    """bucket, home, node: the neighbours of nodes that are expanded, for the searches that expand them."""

    def follow(key: tuple, asks: pa.Table, own: pa.Table) -> pa.Table:
        node, other = _joined(own, "node"), _joined(own, "other")
        out = []
        for source, home, at in zip(asks["source"].to_pylist(), asks["home"].to_pylist(), asks["node"].to_pylist(), strict=True):
            home, at = np.frombuffer(home, np.int64), np.frombuffer(at, np.int64)
            low, high = np.searchsorted(node, at), np.searchsorted(node, at, "right")
            size = high - low
            place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append((source, np.repeat(home, size).tobytes(), other[place].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "home", "node"])

    return front.groupBy("bucket").cogroup(ways.groupBy("bucket")).applyInArrow(follow, "bucket long, home binary, node binary")


def _scored(states: DataFrame, reached: DataFrame, vectors: DataFrame, parts: int) -> DataFrame:
    """bucket, home, node, score: cosines, in double precision, of what searches have reached and not seen before."""

    def fresh(key: tuple, own: pa.Table, came: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        homes, seen, who, node = _joined(own, "homes"), _joined(own, "node"), _joined(came, "home"), _joined(came, "node")
        q = _joined(own, "q", np.float64).reshape(len(homes), -1)
        at = np.searchsorted(_joined(own, "home"), np.append(homes, np.iinfo(np.int64).max))
        order = np.argsort(who, kind="stable")
        who, node = who[order], node[order]
        edge = np.searchsorted(who, np.append(homes, np.iinfo(np.int64).max))
        edge[-1], at[-1] = len(who), len(seen)
        row, new = [], []
        for i in range(len(homes)):
            some = np.unique(node[edge[i] : edge[i + 1]])
            some = some[~np.isin(some, seen[at[i] : at[i + 1]])]
            row.append(np.full(len(some), i))
            new.append(some)
        row, new = np.concatenate(row), np.concatenate(new)
        to, row, new = _split(_place(new, bucket >> 32, parts), row.astype(np.int64), new)
        asking = [np.unique(np.frombuffer(r.as_buffer(), np.int64), return_inverse=True) for r in row]  # a query's vector goes to a bucket once
        return pa.table([to, pa.array([bucket] * len(to), pa.int64()), pa.array([homes[u].tobytes() for u, _ in asking], pa.binary()), pa.array([q[u].tobytes() for u, _ in asking], pa.binary()), pa.array([i.astype(np.int32).tobytes() for _, i in asking], pa.binary()), new], ["bucket", "source", "homes", "q", "row", "node"])

    def score(key: tuple, own: pa.Table, asks: pa.Table) -> pa.Table:
        d = key[0].as_py() >> 32
        ids = _joined(own, "ids")
        order = np.argsort(ids)
        ids, x = ids[order], _joined(own, "vectors", np.float64).reshape(-1, d)[order]
        norm = np.einsum("ij,ij->i", x, x)
        out = []
        for source, homes, q, row, node in zip(*(asks[c].to_pylist() for c in ("source", "homes", "q", "row", "node")), strict=True):
            q, row = np.frombuffer(q, np.float64).reshape(-1, d), np.frombuffer(row, np.int32)
            at = np.searchsorted(ids, np.frombuffer(node, np.int64))
            s = np.empty(len(at))
            for k in range(0, len(at), 1 << 14):
                i, j = row[k : k + (1 << 14)], at[k : k + (1 << 14)]
                s[k : k + (1 << 14)] = np.einsum("ij,ij->i", q[i], x[j]) / np.sqrt(np.einsum("ij,ij->i", q, q)[i] * norm[j])
            out.append((source, np.frombuffer(homes, np.int64)[row].tobytes(), node, s.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "home", "node", "score"])

    asks = states.groupBy("bucket").cogroup(reached.groupBy("bucket")).applyInArrow(fresh, "bucket long, source long, homes binary, q binary, row binary, node binary")
    return vectors.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(score, "bucket long, home binary, node binary, score binary")


def _ranked(home: np.ndarray, node: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of searches, best first, and the places in it, from 0."""
    order = np.lexsort((node, -score, home))
    first = np.concatenate([[True], home[order][1:] != home[order][:-1]])[: len(home)]
    return order, np.arange(len(home)) - np.maximum.accumulate(np.where(first, np.arange(len(home)), 0))


def _turn(states: DataFrame, scored: DataFrame | None, width: int, expand: int, parts: int) -> DataFrame:
    """The searches with what came in (source -1), and the nodes that they expand now, for the buckets of these."""

    def turn(key: tuple, own: pa.Table, came: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        more = _joined(came, "home")
        home, node = np.concatenate([_joined(own, "home"), more]), np.concatenate([_joined(own, "node"), _joined(came, "node")])
        score, able = np.concatenate([_joined(own, "score", np.float64), _joined(came, "score", np.float64)]), np.concatenate([_joined(own, "open", bool), np.ones(len(more), bool)])
        order, rank = _ranked(home, node, score)
        home, node, score, able = home[order], node[order], score[order], able[order]
        before = np.cumsum(able) - able  # open ones before this one, of all searches
        now = able & (rank < width) & (before - np.repeat(before[rank == 0], np.diff(np.append(np.flatnonzero(rank == 0), len(home)))) < expand)
        to, who, at = _split(_place(node[now], bucket >> 32, parts), home[now], node[now])
        gaps = pa.array([b""] * len(to), pa.binary())
        packed = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table(
            {
                "bucket": pa.concat_arrays([pa.array([bucket], pa.int64()), to]),
                "source": pa.array([-1] + [bucket] * len(to), pa.int64()),
                "homes": pa.concat_arrays([packed(_joined(own, "homes")), gaps]),
                "q": pa.concat_arrays([packed(_joined(own, "q", np.float64)), gaps]),
                "home": pa.concat_arrays([packed(home), who]),
                "node": pa.concat_arrays([packed(node), at]),
                "score": pa.concat_arrays([packed(score), gaps]),
                "open": pa.concat_arrays([packed(able & ~now), gaps]),
            }
        )

    schema = STATE.replace("bucket long", "bucket long, source long")
    scored = states.select("bucket", "home", "node", "score").limit(0) if scored is None else scored
    return states.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(turn, schema)


def _top(states: DataFrame, most: int) -> DataFrame:
    """home, node, score: the best that each search has seen."""

    def best(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                home, node, score = _joined(t, "home"), _joined(t, "node"), _joined(t, "score", np.float64)
                order, rank = _ranked(home, node, score)
                order = order[rank < most]
                yield pa.RecordBatch.from_arrays([pa.array(home[order]), pa.array(node[order]), pa.array(score[order])], ["home", "node", "score"])

    return states.mapInArrow(best, "home long, node long, score double")


def search(vectors: DataFrame, every: int = 50, k: int = 5, degree: int = 40, back: int = 24, width: int = 96, expand: int = 16, trees: int = 4, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest others found, by cosine.

    Queries are the rows whose vec_id is divisible by ``every``; ties go to the smaller vec_id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null vec_id.  Only vectors of the same length are compared.  Rows that share a vec_id
    count once, by the vector that sorts first.  Without queries or candidates the result is empty.
    Other columns are ignored.  ``width`` and ``expand`` are doubled until a sample of queries shows
    a recall of RECALL, or all nodes are in reach.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    good = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").cast("array<double>").alias("embedding"))
    # of equal vectors, the k + 1 smallest ids are all that a list of k can show
    same = table(good.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1), "same")
    first = same.where("r = 1").select(F.col("vec_id").alias("node"), "embedding")
    nodes = table(first.mapInArrow(_pack, "node long, d int, unit binary"), "nodes")
    n = nodes.count()
    parts = _parts(n, BUCKET)
    ways = _ways(_graph(nodes, n, degree, trees, block, 0.1, back, parts), parts)
    vectors = _vectors(first.withColumn("d", F.size("embedding")), "embedding", np.float64, parts)
    asked = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # all queries of one vector are one search
    asked = table(asked.join(first.select(F.col("node").alias("home"), F.col("embedding").alias("q")), "q"), "asked")
    homes = checkpoint(asked.groupBy("home").agg(F.first("q").alias("q")))
    many = homes.count()
    entries = [(r.node, r.d) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "d").collect()]
    states, reached = _begin(homes, entries, max(1, _parts(many, ASKING)))
    step, truth = None, None
    while True:
        last = step
        step = table(_turn(states, None if reached is None else _scored(states, reached, vectors, parts), width, expand, parts), "step")
        if last is not None:
            drop(last)
        states, front = step.where("source = -1").drop("source"), step.where("source >= 0").select("bucket", "source", "home", "node")
        if front.isEmpty():
            if width >= n:
                break
            truth = _truth(first, homes.orderBy(F.xxhash64("home"), "home").limit(SAMPLE), k) if truth is None else truth
            if _recall(_top(states, 3 * k + 1), truth, many) >= RECALL:
                break
            width, expand, reached = 2 * width, 2 * expand, None
            continue
        reached = _reached(front, ways)
    kept = _top(states, 3 * k + 1)
    members = same.select("vec_id", "embedding").join(first, "embedding").select("node", "vec_id")
    found = asked.select("query_id", "home").join(kept.select("home", "node", "score"), "home").join(members, "node").where("vec_id <> query_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
