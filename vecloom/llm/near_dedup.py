"""Near-duplicate classes: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

A document's signature has SIZE components of 8 bits; the first ``keyed`` have 16 bits.  Signatures
match if at most ``far`` of the keyed components differ and at most ``wide`` of all.  The join splits
the keyed components into chunks of CHUNK, and ``far`` errors leave some chunk with at most one
(pigeonhole), so each chunk is indexed once for every way to leave out a component: every pair under
the distance shares a key.  All three follow from the threshold (see form): a pair that just reaches
it exceeds the distances with a probability below MISSED.  Matches are links if their full sets
confirm it.

Only links between classes not joined already change the result, so the join first tests every
document against the most connected document under each of its keys, joins what is confirmed, and
then tests the pairs that still lie in different classes, all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import batches, bloom, components, drop, mix, small_batches, table, utf8, word_hashes

SIZE, CHUNK, MISSED = 128, 4, 1e-5


@dataclass(frozen=True)
class Form:
    """Keyed components, and how many of them and of all may differ."""

    keyed: int
    far: int
    wide: int

    @property
    def variants(self) -> list[tuple[int, ...]]:
        errors = self.far // (self.keyed // CHUNK)
        return [tuple(c + i for i in left) for c in range(0, self.keyed, CHUNK) for left in itertools.combinations(range(CHUNK), CHUNK - errors)]


def missed(share: float, form: Form) -> float:
    """The probability that two sets of this similarity exceed the distances; components are independent."""

    def chances(n: int, bits: int) -> np.ndarray:
        p = (1 - share) * (1 - 2.0**-bits)
        return np.array([comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])

    keyed, rest = chances(form.keyed, 16), chances(SIZE - form.keyed, 8)
    # sums of the small tails, which 1 - (the rest) would lose
    return float(keyed[form.far + 1 :].sum() + sum(keyed[i] * rest[max(0, form.wide - i + 1) :].sum() for i in range(form.far + 1)))


def form(percent: int) -> Form:
    """The fewest keyed components, 32 at least, and then the least ``wide`` that miss a pair at the threshold with less than MISSED."""
    for keyed in range(32, SIZE + 1, CHUNK):
        far = 2 * keyed // CHUNK - 1
        if missed(percent / 100, Form(keyed, far, SIZE)) < MISSED:
            return next(f for w in range(SIZE + 1) if missed(percent / 100, f := Form(keyed, far, w)) < MISSED)
    raise ValueError(f"signatures are too short for {percent} percent")


KEYED, FAR, VARIANTS = form(85).keyed, form(85).far, form(85).variants
TILE = 512
LIST = 20_000
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, (6, 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "doc_id long, n_shingles long, low long, high long, sig binary"


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's word shingles; a shorter text is one shingle as a whole."""
    words, at = word_hashes(*utf8(column))
    spans = np.lib.stride_tricks.sliding_window_view(words, width) if len(words) >= width else np.zeros((0, width), np.uint64)
    full = np.zeros(len(spans), np.uint64)
    for i in range(width):
        full += spans[:, i] * _PLACE[width, i]
    full = mix(full)
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j - i >= width:
            s = np.sort(full[i : j - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif j > i:
            out.append(mix((words[i:j] * _PLACE[j - i, : j - i]).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(every: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, the same for equal sets; at: where each set begins."""
    return np.add.reduceat(mix(every ^ np.uint64(0x1234567)), at), np.add.reduceat(mix(every * np.uint64(0xD6E8FEB86659FD93)), at)


def _signatures(rows: Iterator[pa.RecordBatch], form: Form) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        sets = shingle_sets(b.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        has = np.flatnonzero(n)
        low, high, sigs = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [b""] * len(n)
        if len(has):
            every = np.concatenate([sets[i] for i in has])
            at = np.concatenate([[0], np.cumsum(n[has])[:-1]])
            low[has], high[has] = digests(every, at)
            least = np.empty((len(has), SIZE), np.uint64)
            for k in range(SIZE):
                least[:, k] = np.minimum.reduceat((every ^ _XOR[k]) * _MUL[k], at)
            bits = mix(least)
            wide, rest = (bits[:, : form.keyed] & np.uint64(0xFFFF)).astype("<u2"), (bits[:, form.keyed :] & np.uint64(0xFF)).astype(np.uint8)
            for i, w, r in zip(has, wide, rest, strict=True):
                sigs[i] = w.tobytes() + r.tobytes()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "low", "high", "sig"])


def _keys(rows: Iterator[pa.RecordBatch], form: Form) -> Iterator[pa.RecordBatch]:
    for b in rows:
        sig = np.frombuffer(b"".join(x[: 2 * form.keyed] for x in b.column("sig").to_pylist()), "<u2").reshape(-1, form.keyed).astype(np.uint64)
        rep = b.column("rep").to_numpy()
        for v, places in enumerate(form.variants):
            key = np.full(len(sig), v + 1, np.uint64)
            for p in places:
                key = mix(key * np.uint64(65537) + sig[:, p])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(sig), v, np.int32)), pa.array(rep)], ["key", "variant", "rep"])


def split(sigs: list[bytes], form: Form) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, form.keyed + SIZE)
    return np.ascontiguousarray(raw[:, : 2 * form.keyed]).view("<u2"), raw[:, 2 * form.keyed :]


def distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    near = (a[0] != b[0]).sum(-1)
    return near, near + (a[1] != b[1]).sum(-1)


def _close(rows: Iterator[pa.RecordBatch], form: Form) -> Iterator[pa.RecordBatch]:
    for b in rows:
        d = distances(split(b.column("sig_u").to_pylist(), form), split(b.column("sig_v").to_pylist(), form))
        keep = (d[0] <= form.far) & (d[1] <= form.wide)
        yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep)), b.column("v").filter(pa.array(keep)), pa.array(d[1][keep].astype(np.int32))], ["u", "v", "far"])


def _first_variant(a: np.ndarray, b: np.ndarray, variants: list[tuple[int, ...]]) -> np.ndarray:
    """The first variant under which each two signatures share a key."""
    same = a == b
    return np.stack([same[:, list(places)].all(1) for places in variants], 1).argmax(1)


def _matches(t: pa.Table, form: Form) -> tuple[np.ndarray, np.ndarray]:
    """Matching pairs within cells (key, x, y) that lie in different classes, each under its first key.

    t: whole cells, one after the other, side 0 before side 1.  A cell with one side is a block with
    itself, else the sides are two blocks of one key.
    """
    key, x, y, side = (t[c].to_numpy() for c in ("key", "x", "y", "side"))
    rep, label, variant = (t[c].to_numpy() for c in ("rep", "label", "variant"))
    near, rest = split(t["sig"].to_pylist(), form)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        ok = (label[i] != label[j]) & ((x[i] == y[i]) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            d = (near[p] != near[q]).sum(1)
            ok = d <= form.far
            p, q, d = p[ok], q[ok], d[ok]
            ok = d + (rest[p] != rest[q]).sum(1) <= form.wide
            p, q = p[ok], q[ok]
            ok = _first_variant(near[p], near[q], form.variants) == variant[p]
            us.append(rep[p[ok]]), vs.append(rep[q[ok]])

    small = np.repeat(sizes <= 16, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for shift in range(1, 16):
        i = np.flatnonzero(small[:-shift] & (group[:-shift] == group[shift:])) if len(group) > shift else np.zeros(0, int)
        keep(i, i + shift)
    for at, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        step = max(1, 200_000 // int(n))
        for i in range(at, at + n, step):
            p, q = np.meshgrid(np.arange(i, min(i + step, at + n)), np.arange(at, at + n), indexing="ij")
            later = q > p
            keep(p[later], q[later])
    return np.concatenate(us), np.concatenate(vs)


def _tiles(rows: Iterator[pa.RecordBatch], form: Form) -> Iterator[pa.RecordBatch]:
    """Lists of pairs to confirm, and the documents of each list, from cells in order."""
    held: list[pa.Table] = []

    def lists(t: pa.Table) -> Iterator[pa.RecordBatch]:
        u, v = _matches(t, form)
        for at in range(0, len(u), LIST):
            p, q = u[at : at + LIST], v[at : at + LIST]
            docs = np.unique(np.concatenate([p, q]))
            name = int(mix(np.array([p[0] * 31 + q[0], len(p)]).view(np.uint64))[:1].view(np.int64)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs) + 1, name)), pa.array([None, *docs.tolist()], pa.int64()), pa.array([p.tobytes(), *[None] * len(docs)], pa.binary()), pa.array([q.tobytes(), *[None] * len(docs)], pa.binary())],
                ["list", "doc_id", "u", "v"],
            )

    for b in _with_end(rows):
        if b is not None:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) < 20_000:
                continue
        if not held:
            continue
        t = pa.concat_tables(held).combine_chunks()
        key, x, y = (t[c].to_numpy() for c in ("key", "x", "y"))
        cut = t.num_rows
        if b is not None:  # the last cell may go on
            same = (key == key[-1]) & (x == x[-1]) & (y == y[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = [t.slice(cut)] if cut < t.num_rows else []
        if cut:
            yield from lists(t.slice(0, cut))


def _with_end(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from rows
    yield None


def _sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        sets = shingle_sets(b.column("text"))
        has = [i for i, s in enumerate(sets) if len(s)]
        sets = [sets[i] for i in has]
        if sets:
            low, high = digests(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(has)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "low", "high", "set"])


def _confirmed(us: list[int], vs: list[int], held: dict[int, bytes], percent: int) -> pa.Table:
    """The pairs whose sets are similar enough; pairs that earlier ones have joined aren't tested."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while root.get(i, i) != i:
            i = root[i]
        return i

    out_u, out_v = [], []
    for u, v in zip(us, vs, strict=True):
        a, b = top(u), top(v)
        if a == b:
            continue
        x, y = np.frombuffer(held[u], np.uint64), np.frombuffer(held[v], np.uint64)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both >= percent * (len(x) + len(y) - both):
            out_u.append(u), out_v.append(v)
            root[max(a, b)] = min(a, b)
    return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, set) of the documents in ``wanted``; others are mostly left out before the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select("doc_id").distinct(), "doc_id"))  # 16 MB at most
    n_bits = bits.value.size * 8

    def maybe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at = b.column("at").to_numpy()
            yield b.filter(pa.array((bits.value[at >> 3] >> (at & 7)).astype(np.uint8) & 1 == 1))

    def held(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sets(maybe(rows))  # in one Python worker

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_bits)).alias("at"))
    sets = some.mapInArrow(held, "doc_id long, low long, high long, set binary")
    return sets.groupBy("doc_id").agg(F.min_by("set", F.struct("low", "high")).alias("set"))


def confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union.

    Documents and pairs are dealt over a square of cells by hashes of u and v, so a document with
    many pairs is sent to a row and a column of cells rather than once a pair.
    """
    pairs = table(pairs.distinct(), "pairs")
    side = max(12, round((pairs.count() / 400) ** 0.5))
    cut = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    pairs = pairs.withColumn("x", cut("u")).withColumn("y", cut("v"))
    wanted = pairs.select(F.col("u").alias("doc_id"), "x", "y").union(pairs.select("v", "x", "y")).distinct()
    dealt = sets_of(docs, wanted).join(wanted, "doc_id").select(F.col("x").alias("x"), F.col("y").alias("y"), F.col("doc_id").alias("doc_id"), "set")

    def test(p: pa.Table, s: pa.Table) -> pa.Table:
        return _confirmed(p["u"].to_pylist(), p["v"].to_pylist(), dict(zip(s["doc_id"].to_pylist(), s["set"].to_pylist(), strict=True)), percent)

    return pairs.groupBy("x", "y").cogroup(dealt.groupBy("x", "y")).applyInArrow(test, "u long, v long")


def confirm_lists(docs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """As confirm, for pairs that come as lists (see _tiles): each document is sent once to each list."""
    wanted = lists.where("doc_id is not null").select("list", "doc_id").distinct()
    dealt = sets_of(docs, wanted).join(wanted, "doc_id").select(F.col("list").alias("list"), F.col("doc_id").alias("doc_id"), "set")
    pairs = lists.where("doc_id is null").select(F.col("list").alias("list"), F.col("u").alias("u"), F.col("v").alias("v"))

    def test(p: pa.Table, s: pa.Table) -> pa.Table:
        us, vs = (np.frombuffer(b"".join(p[c].to_pylist()), np.int64).tolist() for c in ("u", "v"))
        return _confirmed(us, vs, dict(zip(s["doc_id"].to_pylist(), s["set"].to_pylist(), strict=True)), percent)

    return pairs.groupBy("list").cogroup(dealt.groupBy("list")).applyInArrow(test, "u long, v long")


def classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Lower-cases A-Z; words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  The set has the
    distinct 5-word shingles, or the whole sequence for 1 to 4 words.  Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable,
    and the document with that id is kept.  Without words or text the set is empty and the document
    stands alone, as does a row without doc_id (component_id null); both are kept.  Rows that share a
    doc_id are one document: the set whose digest sorts first decides its links for all of them.
    An empty table gives an empty result.  Other columns are ignored.  Texts are hashed in segments of
    512 KB; a task holds the hashes of one text's words, however many.  Signatures and distances follow
    from percent, 80 at least.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    own = form(percent)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda rows: _signatures(rows, own), SIGNATURE), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["low", "high", "n_shingles"]
    one = real.groupBy("doc_id").agg(F.min(F.struct(*same, "sig")).alias("s")).select("doc_id", "s.*")
    ids = table(one, "ids")
    reps = table(ids.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "reps")
    keys = reps.select("rep", "sig").mapInArrow(lambda rows: _keys(rows, own), "key long, variant int, rep long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = table(keys.join(shared, "key"), "members")
    fame = members.groupBy("rep").agg(F.sum("n").alias("fame"))
    hubs = members.join(fame, "rep").groupBy("key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("minus"))).alias("hub")).select("key", (-F.col("hub.minus")).alias("v"))
    tries = members.join(hubs, "key").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    u, v = reps.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), reps.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v"))
    close = tries.join(u, "u").join(v, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(lambda rows: _close(rows, own), "u long, v long, far int")
    best = close.groupBy("u").agg(F.min(F.struct("far", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    links = table(confirm(docs, best, percent), "links")
    nodes = reps.select(F.col("rep").alias("node"))
    label = table(components(nodes, links), "labels")
    placed = members.join(label.withColumnRenamed("node", "rep"), "rep")
    mixed = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most").select("key", "size")
    open_ = placed.drop("n").join(mixed, "key").join(reps.select("rep", "sig"), "rep").withColumn("blocks", F.expr(f"int((size + {TILE - 1}) div {TILE})"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = open_.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "at").alias("x"), F.greatest("block", "at").alias("y"), (F.col("block") > F.col("at")).cast("int").alias("side"), "variant", "rep", "label", "sig")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "rep")
    lists = table(ordered.mapInArrow(lambda rows: _tiles(rows, own), "list long, doc_id long, u binary, v binary"), "lists")
    drop(members)
    found = table(confirm_lists(docs, lists, percent), "links")
    drop(lists)
    label = table(components(nodes, links.unionByName(found)), "labels")
    placed = reps.drop("sig").join(label.withColumnRenamed("node", "rep"), "rep").select(*same, "label")
    placed = ids.drop("sig").join(placed, same).select("doc_id", "label")
    component = F.coalesce("label", "doc_id")
    return signed.join(placed, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
