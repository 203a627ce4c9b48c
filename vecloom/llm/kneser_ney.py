"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Counts of trusted texts are Spark tables, joined into one table of n-grams with values:

    log p(w | h) = low(w) + left(h)        the backed-off part
                 + more(h, w)              if the pair was counted

Every word of a text is a token and the history of the next, so a text's log probability is the sum
of n * value over its n-grams: words, the start and pairs.  N-grams that aren't in the table have
value 0 against the constant for an unknown word.

Documents' n-grams are joined with that table by key: the HEAD most counted ones, which hold most
tokens, where the texts are, all others by a shuffle.  To keep that small, n-grams of many texts go
together: each different one once, with the texts that hold it, in one packed row for each shard of
keys; a bitmap leaves out most n-grams that the table hasn't.  A shard answers with sums per text.
Values are whole numbers of 2**-24, so sums don't depend on their order or on who adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import START, batches, bigrams, bloom, columns_of, drop, mix, numbered, planes, small_batches, table, unplanes

UNIT = 1 << 24
#: n-grams that are sent to all executors (16 MB)
HEAD = 1 << 20
#: n-grams that are packed together; n-grams of a shard; bytes of text that meet one copy of a shard
FLUSH, SHARD, MEETS = 1 << 20, 1 << 19, 64 << 20
#: texts are looked up in up to PARTS parts of this many bytes or more, one after the other: disk holds the n-grams of one part
PARTS, PART = 4, 64 << 20
ASKED = "shard int, slice int, keys binary, m binary, text binary, n binary, rows binary, row long, doc_id long, lang string, value long, tokens long"
ANSWER = "row long, doc_id long, lang string, value long, tokens long"


@dataclass(frozen=True)
class Model:
    """values: key, value, n (times counted) of every n-gram; rows: how many; unknown: log p of an
    unknown word after an unknown history; good, counted: doc_id of trusted texts, and of those that
    were counted."""

    values: DataFrame
    rows: int
    unknown: float
    good: DataFrame
    counted: DataFrame


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + (w ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        for h, w, *_ in bigrams(b.column("text"), fold=False):
            order = np.lexsort((w, h))
            h, w = h[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.zeros(0, int)
            n = np.diff(np.concatenate([new, [len(h)]]))
            h, w = h[new], w[new]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "w", "n"])


def _keyed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        key = pair(b.column("h").to_numpy().view(np.uint64), b.column("w").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(key.view(np.int64)), b.column("n"), b.column("after")], ["h", "key", "n", "after"])


def _discounts(table_: DataFrame, column: str) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    n = [0.0] * 5
    for r in table_.where(F.col(column) <= 4).groupBy(column).count().collect():
        n[r[0]] = float(r["count"])
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.1) if n[k] else 0.5 * min(k, 1) for k in (1, 2, 3))  # type: ignore[return-value]


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _half() -> Column:
    """Whether a trusted text is counted: every second one by a hash, whatever their number; all others set the limits."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 29)


def counted_ids(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id of the trusted texts to count."""
    return docs.where(F.col("text").isNotNull() & _half()).select("doc_id").distinct().join(good, "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None if no trusted text was counted.  docs: doc_id, lang, text.

    Of rows that share a doc_id, the text that sorts first is counted.  Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    good = table(trusted_ids(labels), "good")
    counted = table(counted_ids(docs, good), "counted")
    texts = docs.where(F.col("text").isNotNull() & _half()).join(counted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    c2 = table(texts.select("text").mapInArrow(_counts, "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n")), "bigrams")
    c1 = table(c2.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "continuations")  # after how many histories
    pairs, words = c2.count(), c1.count()
    if not pairs:
        return None
    d, e = _discounts(c2, "n"), _discounts(c1, "n")

    def cut(n: str, by: tuple[float, float, float]):  # noqa: ANN202
        return F.when(F.col(n) == 1, by[0]).when(F.col(n) == 2, by[1]).otherwise(by[2])

    spared = c1.agg(F.sum(cut("n", e))).first()[0] / pairs
    lowest = spared / (words + 1)  # the rest of the mass is spread evenly, one share for all unknown words
    low = lambda n: (F.col(n) - cut(n, e)) / pairs + lowest
    left = c2.groupBy("h").agg(F.sum("n").alias("of"), F.sum(cut("n", d)).alias("spare")).select("h", "of", (F.col("spare") / F.col("of")).alias("gamma"))
    left = table(left, "histories")
    # one join at a time, and each table dropped once the next is written: disk holds the pairs three times at most
    half = c2.join(c1.withColumnRenamed("n", "after"), "w").select("h", "w", "n", "after").mapInArrow(_keyed, "h long, key long, n long, after long")
    half = table(half, "words")
    drop(c2)
    unit = lambda log: F.round(log * UNIT).cast("long").alias("value")
    backed = F.col("gamma") * low("after")
    two = half.join(left, "h").select("key", unit(F.log(((F.col("n") - cut("n", d)) / F.col("of") + backed) / backed)), "n")
    one = c1.select(F.col("w").alias("key"), low("n").alias("low")).join(left.select(F.col("h").alias("key"), "gamma", "of"), "key", "full")  # the start is no word, the end no history
    one = one.select("key", unit(F.log(F.coalesce(F.col("low") / lowest, F.lit(1.0)) * F.coalesce("gamma", F.lit(1.0)))), F.coalesce("of", F.lit(1 << 40)).alias("n"))
    values = table(two.unionByName(one), "values")
    drop(half, left, c1)
    return Model(values, values.count(), float(np.log(lowest)), good, counted)


def _head(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and values of the most counted n-grams, HEAD at most."""
    least, above = 1, 0
    for r in model.values.groupBy("n").count().orderBy(F.desc("n")).collect():  # different counts: about the root of the tokens
        above += r["count"]
        if above > HEAD:
            least = r.n + 1
            break
    top = model.values.where(F.col("n") >= least).select("key", "value").toArrow()  # HEAD rows at most
    key, value = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["value"].to_numpy().astype(np.float64)
    order = np.argsort(key)
    return key[order], value[order]


def _values_of(key: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where there is none, and where there is one.  Whole numbers in doubles: sums below 2**53 are exact."""
    if not len(key):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    found = key[at] == wanted
    return np.where(found, value[at], 0.0), found


def _asked(shards: int, slices: int, sent):  # noqa: ANN001, ANN202
    """Packed n-grams of the texts of one task, and a row for each text: its number of tokens and the sum of common n-grams."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, head, head_value = sent.value
        schema = pa.schema([("shard", pa.int32()), ("slice", pa.int32()), *((c, pa.binary()) for c in ("keys", "m", "text", "n", "rows")), ("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("value", pa.int64()), ("tokens", pa.int64())])
        last = np.uint64(8 * len(bitmap) - 1)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, base = np.concatenate([x[2] for x in held]), np.cumsum([0, *(len(x[2]) for x in held)])
            keys, owner = np.concatenate([x[0] for x in held]), np.concatenate([x[1] + np.uint32(k) for x, k in zip(held, base, strict=False)])
            held.clear()
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, int)
            n = np.diff(new, append=len(keys))
            keys, owner = keys[new], owner[new]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            ends = np.append(first, len(keys))
            keys = keys[first]
            cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            names = planes(np.diff(ids, prepend=0), 8)
            piece = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(slices))
            out = []
            for s in range(shards):
                i, j = cuts[s], cuts[s + 1]
                if i < j:
                    p, q = ends[i], ends[j]
                    out.append((s, piece, planes(np.diff(keys[i:j], prepend=np.uint64(0)), 8), planes(np.diff(ends[i : j + 1]), 4), planes(owner[p:q], 4), planes(n[p:q], 4), names))
            cells = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=False)] + [pa.nulls(len(out), f.type) for f in list(schema)[7:]], schema=schema)

        for b in batches(rows):
            ids = b.column("row").to_numpy()
            real = b.column("text").is_valid().to_numpy(zero_copy_only=False)
            tokens, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for h, w, count, opens, _ in bigrams(b.column("text"), fold=False):
                owner = np.repeat(np.arange(len(ids), dtype=np.uint32), count)
                tokens += count
                begins = np.flatnonzero(opens & (count >= 0)).astype(np.uint32)
                for keys, of in ((w, owner), (np.full(len(begins), START), begins), (pair(h, w), owner)):
                    value, common = _values_of(head, head_value, keys)
                    sums += np.bincount(of, value, len(ids))
                    at = keys & last
                    some = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    some &= ~common & real[of]
                    held.append((keys[some], of[some], ids.copy()))
                    size += len(held[-1][0])
                if size > FLUSH:
                    yield flush()
                    size = 0
            where = mix(ids.view(np.uint64) + np.uint64(7))
            yield pa.RecordBatch.from_arrays(
                [pa.array((where % np.uint64(shards)).astype(np.int32)), pa.array((where // np.uint64(shards) % np.uint64(slices)).astype(np.int32)), *(pa.nulls(len(ids), pa.binary()) for _ in range(5)),
                 b.column("row"), b.column("doc_id"), b.column("lang"), pa.array(np.where(real, sums, 0).astype(np.int64)), pa.array(np.where(real, tokens, 0))],
                schema=schema,
            )
        if held:
            yield flush()

    return run


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Grows with the key as an unsigned number."""
    return ((keys >> np.uint64(33)) * np.uint64(shards)) >> np.uint64(31)


def _packed(shards: int):  # noqa: ANN202
    """The values of one task: a row for each shard, keys in order and as differences."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, value = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, value = key[order], value[order]
            cuts = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts))
            keys = [planes(np.diff(key[cuts[s] : cuts[s + 1]], prepend=np.uint64(0)), 8) for s in some]
            found = [planes(value[cuts[s] : cuts[s + 1]].view(np.uint64), 8) for s in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["shard", "keys", "values"])

        for b in rows:
            held.append((b.column("key").to_numpy().view(np.uint64), b.column("value").to_numpy()))
            if sum(len(k) for k, _ in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def _answered(asked: pa.Table, values: pa.Table) -> pa.Table:
    """Sums per text of one shard, and the texts' own rows."""
    key = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unplanes(x, 8), dtype=np.uint64) for x in values["keys"].to_pylist())])
    value = np.concatenate([np.zeros(0), *(unplanes(x, 8).view(np.int64).astype(np.float64) for x in values["values"].to_pylist())])
    order = np.argsort(key)
    key, value = key[order], value[order]
    own = asked.filter(asked["row"].is_valid())
    out = [own.select(["row", "doc_id", "lang", "value", "tokens"])]
    packed = asked.filter(asked["row"].is_null())
    for r in packed.select(["keys", "m", "text", "n", "rows"]).to_batches(max_chunksize=1):
        keys, m, text, n, rows = (c[0].as_py() for c in r.columns)
        keys = np.cumsum(unplanes(keys, 8), dtype=np.uint64)
        got, _ = _values_of(key, value, keys)
        ids = np.cumsum(unplanes(rows, 8).view(np.int64))
        sums = np.bincount(unplanes(text, 4).astype(np.int64), np.repeat(got, unplanes(m, 4).astype(np.int64)) * unplanes(n, 4), len(ids))
        some = np.flatnonzero(sums)
        nothing = np.zeros(len(some), np.int64)
        out.append(pa.table([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.string()), pa.array(sums[some].astype(np.int64)), pa.array(nothing)], names=["row", "doc_id", "lang", "value", "tokens"]))
    return pa.concat_tables(out)


def losses(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, lang, loss (-log p of the text), tokens (its words and the end; 0 for a null text).

    docs: row (a number of its own for each row), doc_id, lang, text.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(8, -(-model.rows // SHARD))
    slices = max(1, -(-size // (shards * MEETS)))  # copies of the table take a bounded share of the input
    sent = spark.sparkContext.broadcast((bloom(model.values, "key", mixed=True), *_head(model)))  # 32 MB at most
    values = model.values.select("key", "value").mapInArrow(_packed(shards), "shard int, keys binary, values binary")
    values = values.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    parts, found = min(PARTS, 1 + size // PART), []
    for k in range(parts):
        own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == k)
        asked = own.mapInArrow(_asked(shards, slices, sent), ASKED)
        answers = asked.groupBy("shard", "slice").cogroup(values.groupBy("shard", "slice")).applyInArrow(_answered, ANSWER)
        sums = answers.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.sum("value").alias("value"), F.sum("tokens").alias("tokens"))
        found.append(table(sums.select("row", "doc_id", "lang", (-F.col("value") / UNIT - F.col("tokens") * model.unknown).alias("loss"), "tokens"), "losses"))
    sent.destroy()
    return reduce(DataFrame.unionByName, found)


def quantiles(rated: DataFrame, quantile: float) -> DataFrame:
    """lang, limit: the least smooth value that at least the share ``quantile`` of a language's rows doesn't exceed.

    rated: lang, smooth.  Exact to 2**-26: rows are counted in bins, those of one bin in smaller ones,
    and those by value, so no language is sorted or gathered.
    """
    fine = rated.select("lang", F.round(F.col("smooth") * (1 << 26)).cast("long").alias("v"))
    state = fine.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) * quantile).alias("need")).select(F.col("lang").alias("of"), "need", F.lit(0).cast("long").alias("at"))
    before = 62
    for shift in (22, 11, 0):
        # of the bin found before, the first smaller bin by which enough rows are seen
        within = fine.join(state, F.col("lang").eqNullSafe(F.col("of")) & (F.shiftright("v", before) == F.col("at")))
        bins = within.groupBy("lang", "need", F.shiftright("v", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("lang").orderBy("bin")  # some thousand bins at most
        seen = bins.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("upto") >= F.col("need"))
        found = seen.groupBy("lang").agg(F.min(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))).alias("b"))
        state, before = found.select(F.col("lang").alias("of"), "b.need", F.col("b.bin").alias("at")), shift
    return state.select(F.col("of").alias("lang"), (F.col("at") / (1 << 26)).alias("limit"))


def limits(held: DataFrame, quantile: float, prior: float) -> DataFrame:
    """lang, limit, mean, docs; the row with a null lang is for all together.  held: lang, loss, tokens."""
    both = held.where("lang is not null").unionByName(held.withColumn("lang", F.lit(None).cast("string")))
    means = both.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), (F.sum("loss") / F.sum("tokens")).alias("mean"))
    means = table(means, "means")
    rated = both.join(means.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    smooth = (F.col("loss") + prior * F.col("mean")) / (F.col("tokens") + prior)
    found = quantiles(rated.select("lang", smooth.alias("smooth")), quantile).withColumnRenamed("lang", "of")
    return table(means.join(found, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "limit", "mean", "docs"), "limits")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, prior: float = 16.0, few: int = 50) -> DataFrame:
    """row, doc_id, lang, perplexity, quality_score, quality_limit, quality_kept.  docs: row, doc_id, lang, text.

    perplexity is the text's own.  The score is that of its mean loss drawn towards the language's
    mean by ``prior`` tokens, so that short texts aren't judged by a few rare words; a text whose score
    is above its language's limit is rejected.  Limits are the exact ``quantile`` of all trusted texts
    that weren't counted.  Languages with fewer than ``few`` of those, and null, have the limit of all
    together.  A null text has no tokens and is kept (perplexity null), as is everything without a
    model; an empty text has the end alone.
    """
    model = fit(docs, labels)
    if model is not None:
        lost = losses(docs, model)
        drop(model.values)
        held = lost.where("tokens > 0").join(model.good, "doc_id", "left_semi").join(model.counted, "doc_id", "left_anti").select("lang", "loss", "tokens")
        bounds = limits(table(held, "held"), quantile, prior)
        pooled = bounds.where("lang is null").first()
    if model is None or pooled is None:
        nothing = F.lit(None).cast("double")
        return docs.select("row", "doc_id", "lang", nothing.alias("perplexity"), nothing.alias("quality_score"), nothing.alias("quality_limit"), F.lit(True).alias("quality_kept"))
    own = bounds.where(F.col("lang").isNotNull() & (F.col("docs") >= few)).select("lang", "limit", "mean")
    limit, mean = F.coalesce("limit", F.lit(pooled["limit"])), F.coalesce("mean", F.lit(pooled["mean"]))
    score = F.when(F.col("tokens") > 0, (F.col("loss") + prior * mean) / (F.col("tokens") + prior))
    kept = F.coalesce(F.round(score * (1 << 26)) <= F.round(limit * (1 << 26)), F.lit(True))
    return lost.join(own, "lang", "left").select(
        "row", "doc_id", "lang", F.exp(F.when(F.col("tokens") > 0, F.col("loss") / F.col("tokens"))).alias("perplexity"),
        F.exp(score).alias("quality_score"), F.exp(limit).alias("quality_limit"), kept.alias("quality_kept"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, whatever their names.

    Texts of any length are read whole, in parts.
    """
    full, row = numbered(docs, "quality")
    own = full.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    bad = table(judge(own, labels).where("not quality_kept").select(F.col("row").alias(row)), "rejected")
    return full.join(bad, row, "left_anti").select(*columns_of(docs))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, quality_score, quality_limit, quality_kept of every row (see judge).

    Repeated rows are judged each.  An empty table gives an empty result.  Other columns are ignored.
    Texts of any length are read whole; beyond a text itself, memory doesn't grow with its length.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")  # numbers are read in one pass alone
    return judge(own, labels).drop("row")
