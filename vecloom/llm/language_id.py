"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits.  For each bit a binary classifier weighs hashed byte n-grams
by the log ratio of their frequencies in the languages whose bit is set and in those whose bit is
not.  A text is decoded to the codeword of least loss; the loss of a bit is weighted by how often its
classifier was right for that language on texts that it wasn't learned from.

Weights have a row per bucket and a column per bit, some ten bits for each doubling of languages, so
the model stays small however many languages there are.  Texts are read a segment at a time: memory
beyond a text itself doesn't grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from vecloom.llm.common import batches, columns_of, free_names, small_batches, utf8

BUCKETS = 1 << 14
UNKNOWN = "und"
SMOOTH = 0.05
#: places of a segment, and bytes that its gathered weights may take
SEGMENT, GATHERED = 1 << 20, 32 << 20
#: languages with fewer rows than this are learned from as a whole; their bits are all trusted alike
CALIBRATED = 32
#: letters fold to lower case, bytes of other scripts stay, all else is a space
_CLASS = np.full(256, 32, np.uint32)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram at each place from at to stop, and which places count (not between words).

    Trigrams don't reach over row ends, but over the segment's.
    """
    low, high = max(0, at - 1), min(len(data), stop + 1)
    near = np.full(stop - at + 2, 32, np.uint32)
    near[1 - (at - low) : 1 - (at - low) + high - low] = _CLASS[data[low:high]]
    before, c, after = near[:-2].copy(), near[1:-1], near[2:].copy()
    first = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
    before[first] = 32
    last = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "right")] - 1 - at
    after[last] = 32
    code = (before * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(18)).astype(np.int32), c != 32


def rows_in(offsets: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with places from at to stop, and how many each has there."""
    low, high = np.clip(offsets[:-1], at, stop), np.clip(offsets[1:], at, stop)
    own = np.flatnonzero(high > low)
    return own, (high - low)[own]


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all different splits for up to 6 classes, else random ones spread far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        return np.array([[1 if c == 0 or (b >> (c - 1)) & 1 else -1 for b in range(2 ** (n - 1) - 1)] for c in range(n)], np.int8)
    bits, best, far = int(np.ceil(10 * np.log2(n))), None, 0
    for seed in range(50 if n <= 256 else 3):
        m = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        m = m[:, np.abs(m.sum(0, dtype=np.int64)) < n]
        least = bits
        for at in range(0, n, 1024):  # distances from a product, some rows at a time
            d = (m.shape[1] - m[at : at + 1024].astype(np.float32) @ m.T.astype(np.float32)) / 2
            d[np.arange(len(d)), at + np.arange(len(d))] = bits
            least = min(least, int(d.min()))
        if least > far:
            best, far = m, least
    if best is None:
        raise AssertionError("two codewords are the same")
    return best


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        bits = self.codes.shape[1]
        sums, n = np.zeros((len(offsets) - 1, bits)), np.zeros(len(offsets) - 1, np.int64)
        full = np.vstack([self.weights, np.zeros((1, bits), np.float32)])
        step = min(SEGMENT, max(1 << 12, GATHERED // (4 * bits)))
        for at in range(0, len(data), step):
            stop = min(len(data), at + step)
            code, real = grams(data, offsets, at, stop)
            own, size = rows_in(offsets, at, stop)
            first = np.cumsum(size) - size
            sums[own] += np.add.reduceat(full[np.where(real, code, np.int32(BUCKETS))], first, axis=0, dtype=np.float64)
            n[own] += np.add.reduceat(real, first, dtype=np.int64)
        return sums / np.sqrt(np.maximum(n, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, confidence in 0..1 and whether the runner-up is close."""
        m = np.clip(margins, -30, 30)
        # a bit's loss is log(1 + exp(-code * margin)), weighted by its trust
        loss = np.logaddexp(0, -m) @ (self.trust * (self.codes > 0)).T + np.logaddexp(0, m) @ (self.trust * (self.codes < 0)).T
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * 2)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(p, axis=1)
        close = top[:, -1] - top[:, -2] < 0.1 if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], close


def _counted(rows: Iterator[pa.RecordBatch], spared: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """How often each bucket occurs in each language, summed over the task; calibration rows of spared languages don't count."""
    total: dict[str, np.ndarray] = {}

    def held() -> Iterator[pa.RecordBatch]:
        for lang, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], ["lang", "bucket", "n"])
        total.clear()

    for b in batches(rows):
        b = b.filter(pa.array([not (part and lang in spared) for part, lang in zip(b.column("part").to_pylist(), b.column("lang").to_pylist(), strict=True)], pa.bool_()))
        data, offsets = utf8(b.column("text"))
        kinds = b.column("lang").dictionary_encode()
        names, which = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
        for at in range(0, len(data), SEGMENT):
            stop = min(len(data), at + SEGMENT)
            code, real = grams(data, offsets, at, stop)
            own, size = rows_in(offsets, at, stop)
            here, place = np.unique(which[own], return_inverse=True)
            seen = np.bincount((np.repeat(place, size) * BUCKETS + code)[real], minlength=len(here) * BUCKETS).reshape(len(here), BUCKETS)
            for k, own_seen in zip(here, seen, strict=True):
                total[names[k]] = total.get(names[k], 0) + own_seen
            if len(total) > 256:
                yield from held()
    yield from held()


def fit(docs: DataFrame, calibrate: int = 4096) -> Model:
    """Learn from all rows of docs with a text and a lang, but for about ``calibrate`` of them (a
    quarter at most), picked by a hash of doc_id, that measure how far each bit can be trusted for
    each language.  Languages of fewer than CALIBRATED rows are learned from as a whole.

    Extra columns are ignored, repeated rows count each, an empty table gives a model without languages.
    """
    spark = docs.sparkSession
    small_batches(spark)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    docs = docs.where("lang is not null and text is not null").select("lang", "text", part.alias("part"))
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.ones((0, 1)))
    spared = frozenset(x for x, n in sizes.items() if n >= CALIBRATED)
    edge = int(min(0.25, calibrate / sum(sizes.values())) * (1 << 20))
    docs = docs.withColumn("part", F.col("part") < edge)
    codes = codewords(len(langs))
    counts = docs.mapInArrow(lambda rows: _counted(rows, spared), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.persist(StorageLevel.DISK_ONLY)  # read twice; a lost part is counted again
    totals = {r.lang: r.n + SMOOTH * BUCKETS for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = np.array([totals.get(x, SMOOTH * BUCKETS) for x in langs])
    up, down = (codes > 0).astype(np.float64), (codes < 0).astype(np.float64)
    floor = SMOOTH / total  # what a bucket never seen in a language has there; languages weigh the same, however common
    shared = spark.sparkContext.broadcast(({x: i for i, x in enumerate(langs)}, codes, total))  # languages * bits

    def weighed(t: pa.Table) -> pa.Table:
        index, code, of = shared.value
        own = np.array([index[x] for x in t["lang"].to_pylist()])
        order = np.argsort(own)
        own = own[order]
        share = t["n"].to_numpy()[order] / of[own]
        return pa.table({"bucket": t["bucket"].slice(0, 1), "up": pa.array([(share @ (code[own] > 0)).tolist()]), "down": pa.array([(share @ (code[own] < 0)).tolist()])})

    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    sides = counts.groupBy("bucket").applyInArrow(weighed, "bucket int, up array<double>, down array<double>").collect()  # BUCKETS rows of two numbers a bit
    both = up.any(0) & down.any(0)
    rest = np.log((floor @ up)[both] / up.sum(0)[both]) - np.log((floor @ down)[both] / down.sum(0)[both])
    weights[:, both] = rest
    for r in sides:
        a, b = (np.array(r.up) + floor @ up)[both] / up.sum(0)[both], (np.array(r.down) + floor @ down)[both] / down.sum(0)[both]
        weights[r.bucket, both] = np.log(a) - np.log(b)
    counts.unpersist()
    shared.destroy()
    model = Model(langs, codes, weights, np.full(codes.shape, 1 / codes.shape[1]))
    sent = spark.sparkContext.broadcast(model)  # BUCKETS and languages, each times bits

    def judged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches(rows):
            b = b.filter(pa.array([x in spared for x in b.column("lang").to_pylist()], pa.bool_()))
            if not b.num_rows:
                continue
            own = np.searchsorted(m.langs, b.column("lang").to_pylist())
            right = (m.margins(b.column("text")) * m.codes[own] > 0).astype(np.int64)
            for k in np.unique(own):
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([int((own == k).sum())]), pa.array([right[own == k].sum(0).tolist()], pa.list_(pa.int64()))], ["k", "n", "right"])

    seen = docs.where("part").select("lang", "text").mapInArrow(judged, "k int, n long, right array<long>").select("k", "n", F.posexplode("right").alias("bit", "right")).groupBy("k", "bit").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).collect()  # languages * bits rows
    sent.destroy()
    trust = np.full(codes.shape, 0.5)
    for r in seen:
        trust[r.k, r.bit] = (r.right + 1) / (r.n + 2)
    return Model(langs, codes, weights, trust / trust.sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model, names: Sequence[str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Adds lang_pred, score and ambiguous, under ``names``, to all columns of docs; only ``text`` is looked at.

    A null text, a text without a letter, or a model without languages gives ``und`` and score 0.
    Columns of docs with these names are replaced; others may have any names.  Texts are read a segment
    at a time, so their length doesn't matter.  Rows are judged each, repeated or not; an empty
    table gives an empty result.
    """
    own = {x.lower() for x in names}
    docs = docs.select(*[c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name.lower() not in own or name.lower() == "text"])
    text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    final = [*docs.columns, *names]
    # Python looks columns up by name, so they go there under names without dots and the like
    docs = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = docs.select("*", F.lit("").alias("found"), F.lit(0.0).alias("sure"), F.lit(False).alias("close")).schema
    has = F.coalesce(F.col(f"c{text}").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(rows, 1 << 21):
            known = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) & bool(m.langs)
            if m.langs:
                best, sure, close = m.decode(m.margins(b.column(text)))
                found = np.array(m.langs, object)[best]
            else:
                found, sure, close = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            extra = [pa.array(np.where(known, found, UNKNOWN).tolist(), pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(close & known)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], schema.names)

    return docs.select("*", has).mapInArrow(run, schema).toDF(*final)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; learns from rows that aren't held out.

    Held out: crc32 of the doc_id as text leaves 1 when divided by 3.  A row without doc_id is not
    held out and nothing is learned from it.  Repeated rows count each.  A null text, or one without
    a letter, is ``und`` with score 0.  An empty table gives an empty result.  Extra columns are
    ignored.  Texts of any length are read whole.
    """
    docs = docs.select("doc_id", "lang", "text")
    model = fit(docs.where(remainder(3) != 1))
    held = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
