"""Katz backoff language model with Good-Turing discounts, learned and applied at corpus size.

    P(w | h) = d(c) c(h, w) / c(h)          if the pair was seen in training
             = alpha(h) P(w)                otherwise
    P(w)     = d(c) c(w) / N                if the word was seen
             = the mass that is left        otherwise, one share for all unknown words

alpha(h) = (1 - sum of P(. | h) over seen pairs) / (1 - sum of P(.) over the same words), so every
history's probabilities sum to 1.  A history none of whose counts is discounted (no pair was seen
once or twice) would leave nothing to unseen words: there c(h) + 1 stands for c(h).

Nothing of corpus size is broadcast:

1. word counts are a table;
2. pairs go to shards by their history, packed per task as sorted words with the texts that hold
   them; a shard counts its pairs and answers with sums for the texts that hold some, counts per
   history, the pairs that held-out texts hold and training texts don't, and the seen pairs of rare
   words.  Texts' own rows go through the same shuffle, so row numbers are read in one pass alone;
3. histories get their alpha from a join with the word table; unseen pairs are joined with both.

At most HEAD words, the most common ones, are sent to the executors with their counts (16 MB).
Histories that would fill a shard are spread by their next word, and their counts are added up over
shards; their counts as words are known before.  Which ones are spread changes no result.  Counts up
to 5 are reported as such, since discounts are only known at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import END, START, batches, bigrams, map_large, mix, planes, small_batches, table, trim, unplanes

HEAD = 1 << 20
K = 5
SHARDS, SHARD_BYTES = 64, 8 << 20
FLUSH, SLICE = 1 << 20, 1 << 18
def discounts(of: dict[int, int]) -> list[float]:
    """d(1) to d(K) from how many n-grams have each count, by Katz's rule for counts up to k, the
    largest of K, K - 1, ... for which all lie between 0 and 1 (1 above k); if none, as in tiny
    tables, (r - 1/2) / r."""
    n = [0, *(of.get(r, 0) for r in range(1, K + 2))]
    for k in range(K, 1, -1):
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        if all(n[1 : k + 2]) and a < 1:
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return [1.0, *d, *[1.0] * (K - k)]
    return [1.0, *((r - 0.5) / r for r in range(1, K + 1))]


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _word_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    for b in batches(rows):
        for _, w, *_ in bigrams(b.column("text"), fold=True):
            held.append(w)
            size += len(w)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


#: shard; of packed pairs: row number of the first text, how many texts, histories and how many words each has, those words, their
#: count in training texts, in how many texts they are, which, and how often; of a part of a text: what is known of it at once, and its rare words
POSTINGS = "shard int, base long, rows int, h binary, hn binary, w binary, train binary, m binary, text binary, n binary, row long, doc_id long, held_out boolean, tokens long, known long, logs double, others array<long>"
PACKED = pa.schema([("shard", pa.int32()), ("base", pa.int64()), ("rows", pa.int32()), *((c, pa.binary()) for c in ("h", "hn", "w", "train", "m", "text", "n"))])
TEXTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("others", pa.list_(pa.int64()))])
WHOLE = pa.schema([*PACKED, *TEXTS])


def _text_rows(b: pa.RecordBatch, w: np.ndarray, count: np.ndarray, head: np.ndarray, head_n: np.ndarray) -> list[pa.Array]:
    """TEXTS of one part: tokens, known tokens and base logs of common words; the others, in turn."""
    at, common = lookup(head, w)
    log = np.where(common, np.log10((head_n[at] if len(head_n) else np.zeros(len(w))) + 0.1), 0.0)
    owner = np.repeat(np.arange(len(count)), count)
    known, logs = np.bincount(owner, common, len(count)), np.bincount(owner, log, len(count))
    rest = np.concatenate([[0], np.cumsum(np.bincount(owner, ~common, len(count)))])
    others = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(w[~common].view(np.int64)))
    return [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(count.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logs), others]


def _postings(shards: int, heavy: np.ndarray, head: np.ndarray, head_n: np.ndarray):  # noqa: ANN202
    """Rows of one task's pairs for each shard, and of its texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0

        def taken(own: list) -> np.ndarray:
            out = np.concatenate(own)
            own.clear()
            return out

        def flush() -> Iterator[pa.RecordBatch]:
            # one array at a time, each freed as soon as it is replaced: a flush is the task's peak of memory
            h, w, ids, sizes, learn = map(taken, held)
            base, many = ids[0], len(ids)
            if ids[-1] - base + 1 != many:
                raise AssertionError("row numbers of a task must follow each other")
            text = np.repeat(np.arange(many, dtype=np.uint32), sizes)
            shard = np.empty(len(h), np.uint32)
            for i in range(0, len(h), SLICE):
                part = slice(i, i + SLICE)
                spread = lookup(heavy, h[part])[1]
                shard[part] = mix(np.where(spread, w[part], h[part]) + np.uint64(99)) % np.uint64(shards)
            order = np.lexsort((w, h, shard))  # stable: texts stay in turn
            shard = shard[order]
            h = h[order]
            w = w[order]
            text = text[order]
            del order
            at = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
            n = np.diff(at, append=len(h)).astype(np.uint32)
            shard = shard[at]
            h = h[at]
            w = w[at]
            text = text[at]
            train = n * learn[text]
            at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
            ends = np.append(at, len(h))
            m, total = np.diff(ends), np.add.reduceat(train, at)
            del train
            pair_shard = shard[at]
            h = h[at]
            w = w[at]
            cut = np.searchsorted(pair_shard, np.arange(shards + 1))
            for s in range(shards):
                i, j = cut[s], cut[s + 1]
                if i == j:
                    continue
                hs = h[i:j]
                first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                own = np.diff(hs[first], prepend=np.uint64(0))
                p, q = ends[i], ends[j]
                cells = [planes(own, 8), planes(np.diff(first, append=j - i), 4), planes(w[i:j], 8), planes(total[i:j], 4), planes(m[i:j], 4), planes(text[p:q], 4), planes(n[p:q], 4)]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([base], pa.int64()), pa.array([many], pa.int32()), *(pa.array([c], pa.binary()) for c in cells), *(pa.nulls(1, f.type) for f in TEXTS)], schema=WHOLE)

        for b in batches(rows):
            ids, learn = b.column("row").to_numpy().copy(), b.column("learn").to_numpy(zero_copy_only=False).astype(np.uint32)
            for h, w, count, opens, closes in bigrams(b.column("text"), fold=True):
                whole = opens and closes
                if held[0] and not whole:  # parts of a long text are packed by themselves
                    yield from flush()
                    size = 0
                texts = _text_rows(b, w, count, head, head_n)
                where = pa.array((mix(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([where, *(pa.nulls(len(ids), f.type) for f in list(PACKED)[1:]), *texts], schema=WHOLE)
                if len(w):
                    for own, x in zip(held, (h, w, ids, count, learn), strict=True):
                        own.append(x)
                size += len(w)
                if size > FLUSH or held[0] and not whole:
                    yield from flush()
                    size = 0
        if held[0]:
            yield from flush()

    return run


ANSWERS = "kind int, a long, b long, n long, known long, held boolean, seen array<long>, x double, raw binary"
SUMS, HISTORY, UNSEEN, RARE, SPARE, TEXT = range(6)


def _rows(kind: int, size: int, /, seen: np.ndarray | pa.Array | None = None, **columns) -> pa.Table:  # noqa: ANN003
    types = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "known": pa.int64(), "held": pa.bool_(), "x": pa.float64(), "raw": pa.binary()}
    own = {}
    for c, t in types.items():
        given = columns.get(c)
        own[c] = pa.nulls(size, t) if given is None else given if isinstance(given, pa.ChunkedArray) else pa.array(given, t)
    lists = pa.nulls(size, pa.list_(pa.int64())) if seen is None else seen if isinstance(seen, pa.ChunkedArray) else pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * seen.shape[1]), pa.array(seen.ravel()))
    return pa.table([pa.array(np.full(size, kind, np.int32)), own["a"], own["b"], own["n"], own["known"], own["held"], lists, own["x"], own["raw"]], names=["kind", "a", "b", "n", "known", "held", "seen", "x", "raw"])


def _answers(head: np.ndarray, head_p: np.ndarray, rarely: bool, heavy: np.ndarray, heavy_n: np.ndarray):  # noqa: ANN202
    """One shard: counts its pairs and answers for all texts that hold them."""

    def run(t: pa.Table) -> pa.Table:
        packed = np.flatnonzero(t["row"].is_null().to_numpy())
        texts = t.select(TEXTS.names).filter(t["row"].is_valid())
        out = [_rows(TEXT, texts.num_rows, a=texts["row"], b=texts["doc_id"], n=texts["tokens"], known=texts["known"], held=texts["held_out"], seen=texts["others"], x=texts["logs"])]
        if not len(packed):
            return pa.concat_tables(out)
        packed = packed[np.argsort(t["base"].to_numpy()[packed], kind="stable")]
        parts, hs, ws = [], [], []
        for i in packed.tolist():  # rows are read one at a time, in place
            r = {c: t[c][i].as_py() for c in PACKED.names}
            hs.append(np.repeat(np.cumsum(unplanes(r["h"], 8), dtype=np.uint64), unplanes(r["hn"], 4).astype(np.int64)))
            ws.append(unplanes(r["w"], 8))
            parts.append((len(ws[-1]), None, *(unplanes(r[c], 4).astype(np.int32) for c in ("train", "m", "text", "n")), r["base"], r["rows"]))
        h, w = np.concatenate(hs), np.concatenate(ws)
        del hs, ws
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
        pair = np.empty(len(h), np.int64)
        pair[order] = np.cumsum(new) - 1
        hs, ws = hs[new], ws[new]
        del h, w, order, new
        c = np.bincount(pair, np.concatenate([p[2] for p in parts]), len(hs)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        history = np.repeat(np.arange(len(first)), np.diff(first, append=len(hs)))
        of = np.add.reduceat(c, first)
        low = np.stack([np.add.reduceat((c == r).astype(np.int64), first) for r in range(1, K + 2)], 1)
        high = np.add.reduceat(np.where(c > K, c, 0), first)
        at, common = lookup(head, ws)
        p1 = np.add.reduceat(np.where(common & (c > 0), head_p[at] if len(head_p) else 0.0, 0.0), first)
        i, spread = lookup(heavy, hs[first])
        of = np.where(spread, heavy_n[i] if len(heavy_n) else 0, of)
        # discounts hold for counts of 1 and 2 at least; whether a spread history has such counts, all its shards know together
        spare = low[:, :2].sum(1) == 0
        log_of = np.log10(np.maximum(of + (spare & ~spread), 1).astype(np.float64))[history]
        value = np.where(c > K, np.log10(np.maximum(c, 1).astype(np.float64)), 0.0) - log_of
        maybe = (spare & spread)[history]
        start = 0
        for p in parts:
            own = pair[start : start + p[0]]
            start += p[0]
            each = np.repeat(own, p[3])  # the pair of each (text, n)
            got = c[each]
            sums = np.bincount(p[4], np.where(got > 0, value[each] * p[5], 0.0), p[7])
            lows = [np.bincount(p[4], np.where(got == r, p[5], 0), p[7]) for r in range(1, K + 1)]
            some = np.flatnonzero(np.bincount(p[4], got > 0, p[7]))
            out.append(_rows(SUMS, 1, a=[p[6]], b=[p[7]], raw=[planes(some, 4) + sums[some].astype("<f8").tobytes() + b"".join(planes(v[some], 4) for v in lows)]))
            miss = np.flatnonzero(got == 0)
            out.append(_rows(UNSEEN, len(miss), a=p[6] + p[4][miss].astype(np.int64), b=hs[each[miss]].view(np.int64), n=p[5][miss], seen=ws[each[miss]].view(np.int64)[:, None]))
            more = np.flatnonzero(maybe[each] & (got > 0))
            out.append(_rows(SPARE, len(more), a=p[6] + p[4][more].astype(np.int64), b=hs[each[more]].view(np.int64), n=p[5][more]))
        real = np.flatnonzero((of > 0) & (np.add.reduceat(c, first) > 0))
        out.append(_rows(HISTORY, len(real), a=hs[first][real].view(np.int64), b=of[real], n=high[real], seen=low[real], x=p1[real]))
        if rarely:
            rare = np.flatnonzero((c > 0) & ~common)
            out.append(_rows(RARE, len(rare), a=hs[rare].view(np.int64), b=ws[rare].view(np.int64)))
        return pa.concat_tables(out)

    return run


def _summed(t: pa.Table) -> pa.Table:
    """Adds up the shards' sums for the texts that were packed together."""
    size = t["b"][0].as_py()
    sums, lows = np.zeros(size), np.zeros((K, size), np.int64)
    for raw in t["raw"].to_pylist():
        n = len(raw) // (12 + 4 * K)
        at = unplanes(raw[: 4 * n], 4).astype(np.int64)  # each text once
        sums[at] += np.frombuffer(raw[4 * n : 12 * n], "<f8")
        for r in range(K):
            lows[r][at] += unplanes(raw[(12 + 4 * r) * n : (16 + 4 * r) * n], 4).astype(np.int64)
    return pa.table([pa.array(t["a"][0].as_py() + np.arange(size)), pa.array(sums), *(pa.array(x) for x in lows)], names=["row", "sums", *(f"n{r}" for r in range(1, K + 1))])


def _unlearned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        for _, w, count, *_ in bigrams(b.column("text"), fold=True):
            yield pa.RecordBatch.from_arrays(_text_rows(b, w[:0], count * 0, w[:0], w[:0])[:3] + [pa.array(count.astype(np.int64))], ["row", "doc_id", "held_out", "n_tokens"])


def score(docs: DataFrame, folds: int = 10, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32 of the doc_id as text isn't divisible by ``folds``; rows without
    doc_id are neither learned from nor held out.  A null text is empty: it has the end alone.
    Repeated rows count each.  Without training rows there is nothing to score with: train_tokens is
    0, base_score is 0 for each token (the one class of unknown words) and so is score.  An empty
    table gives an empty result.  Other columns are ignored.  Texts of any length are read whole, a
    part at a time.  shards: into how many parts pairs are dealt; it changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    left = F.crc32(F.col("doc_id").cast("string")) % folds
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(left == 0, F.lit(False)).alias("held_out"), F.coalesce(left != 0, F.lit(False)).alias("learn"), "text")
    words = table(docs.where("learn").select("text").mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "words")
    kinds = {r.c: r["count"] for r in words.groupBy("c").count().collect()}  # different counts: about the root of the words
    total, vocabulary = sum(c * k for c, k in kinds.items()), sum(kinds.values())
    trained, size = docs.agg(F.count_if("learn"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not total:
        plain = docs.select("row", "doc_id", "held_out", "text").mapInArrow(_unlearned, "row long, doc_id long, held_out boolean, n_tokens long")
        plain = plain.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"))
        return plain.select("doc_id", "held_out", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    d1 = discounts(kinds)
    unknown = 1 - sum(k * c * (d1[c] if c <= K else 1.0) for c, k in kinds.items()) / total
    grow = 1.0
    if unknown <= 0:  # nothing was discounted: one more count is left to the unknown
        grow, unknown = total / (total + 1), 1 / (total + 1)
    least, above = 1, 0
    for c in sorted(kinds, reverse=True):
        above += kinds[c]
        if above > HEAD:
            least = c + 1
            break
    top = words.where(F.col("c") >= least).toArrow()  # HEAD rows at most
    head, head_n = top["w"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.argsort(head)
    head, head_n = head[order], head_n[order]
    head_p = np.where(head_n <= K, np.array(d1)[np.minimum(head_n, K)], 1.0) * head_n * grow / total
    shards = shards or max(SHARDS, -(-size // SHARD_BYTES))
    many = (head_n * 4 * shards > total) & (head != END)  # the end is no history
    heavy = np.concatenate([head[many], [START]]).astype(np.uint64)
    heavy_n = np.concatenate([head_n[many], [trained]]).astype(np.int64)
    order = np.argsort(heavy)
    heavy, heavy_n = heavy[order], heavy_n[order]  # 4 * shards + 1 at most

    send = spark.sparkContext.broadcast((head, head_n, head_p, heavy, heavy_n))

    def answer(t: pa.Table) -> pa.Table:
        map_large()
        a, _, p, h, n = send.value
        out = _answers(a, p, least > 1, h, n)(t)
        trim()
        return out

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n, _, h, _ = send.value
        return _postings(shards, h, a, n)(rows)

    # row numbers are read in this one pass alone: they differ from one scan to the next
    answers = table(docs.mapInArrow(packed, POSTINGS).groupBy("shard").applyInArrow(answer, ANSWERS), "answers")
    send.destroy()

    p1 = F.when(F.col("c") <= K, F.element_at(F.array(*[F.lit(x) for x in d1[1:]]), F.least("c", F.lit(K)).cast("int"))).otherwise(1.0) * F.col("c") * grow / total
    rare = answers.where(f"kind = {RARE}").select(F.col("a").alias("h"), F.col("b").alias("w")).join(words.where(F.col("c") < least), "w").groupBy("h").agg(F.sum(p1).alias("more"))
    history = answers.where(f"kind = {HISTORY}").select(F.col("a").alias("h"), F.col("b").alias("of"), F.col("n").alias("high"), "seen", "x")
    fields = [F.sum(F.col("seen")[r]).alias(f"m{r + 1}") for r in range(K + 1)]
    history = table(history.groupBy("h").agg(F.max("of").alias("of"), F.sum("high").alias("high"), *fields, F.sum("x").alias("x")), "history")
    d2 = discounts({r + 1: v or 0 for r, v in enumerate(history.agg(*[F.sum(f"m{r + 1}") for r in range(K + 1)]).first())})
    spare = F.col("m1") + F.col("m2") == 0
    mass = sum((F.col(f"m{r}") * (r * d2[r]) for r in range(1, K + 1)), F.col("high")) / (F.col("of") + F.when(spare, 1).otherwise(0))
    alpha = history.join(rare, "h", "left").select("h", ((1 - mass) / (1 - F.col("x") - F.coalesce("more", F.lit(0.0)))).alias("alpha"))
    unseen = answers.where(f"kind = {UNSEEN}").select(F.col("a").alias("row"), F.col("b").alias("h"), F.col("seen")[0].alias("w"), "n")
    low = F.when(F.col("c").isNull(), F.lit(unknown)).otherwise(p1)
    unseen = unseen.join(alpha, "h", "left").join(words, "w", "left").select("row", (F.col("n") * (F.log10(F.coalesce("alpha", F.lit(1.0))) + F.log10(low))).alias("score"))
    # spread histories that turn out to have nothing discounted in any shard
    late = answers.where(f"kind = {SPARE}").select(F.col("a").alias("row"), F.col("b").alias("h"), "n").join(history.where(spare).select("h", "of"), "h")
    late = late.select("row", (F.col("n") * F.log10(F.col("of") / (F.col("of") + 1))).alias("score"))
    sums = answers.where(f"kind = {SUMS}").select("a", "b", "raw").groupBy("a").applyInArrow(_summed, "row long, sums double, " + ", ".join(f"n{r} long" for r in range(1, K + 1)))
    seen = sums.select("row", sum((F.col(f"n{r}") * float(np.log10(r * d2[r])) for r in range(1, K + 1)), F.col("sums")).alias("score"))

    texts = answers.where(f"kind = {TEXT}")
    other = texts.select(F.col("a").alias("row"), F.explode("seen").alias("w")).groupBy("row", "w").agg(F.count(F.lit(1)).alias("n")).join(words.where(F.col("c") < least), "w", "left")
    other = other.select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"))
    texts = texts.select(F.col("a").alias("row"), F.col("b").alias("doc_id"), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), "known", F.col("x").alias("logs"))
    parts = [texts, other, *(x.select("row", "score") for x in (seen, unseen, late))]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    every = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "logs", "score")))
    norm = float(np.log10(total + 0.1 * (vocabulary + 1)))
    return every.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
