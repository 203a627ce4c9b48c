"""Collocations: phrases of two and more words that occur together more often than their parts would.

1. Texts are gathered in chunks of about CHUNK bytes, written once.  A sketch of all phrases: each
   falls into a cell by its hash, so the cell's count is an upper bound of its own.  Chunks send the
   cells they met to blocks of cells, which add them up and send one bit a cell back to each chunk
   that met it: whether the bound reaches the least count.  There are about two cells for each byte of
   text that could begin a phrase, so that few phrases share one, and nobody holds all of them.
2. A chunk's candidates are its phrases whose cell, and those of the phrases in them, reach it.
3. Candidates that a chunk holds once by their hash are counted thereby.  The others become an
   Aho-Corasick automaton (pyahocorasick) over words written as three letters of three separate
   alphabets, so no match can begin or end within a word; a delimiter stands wherever no phrase can
   go on.  It scans its own chunk, counting overlapping matches.  So each text is read twice, however
   many candidates there are, and counts of chunks are added up by phrase.
4. Exact counts decide: least count, scores of all cuts in decimals, longer candidates that say the
   same, ranks.  Those are joins and windows on candidates.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import batches, drop, mix, small_batches, table, trim, utf8, word_spans

#: at most: bits of a cell's number, and of its place in a block
BITS, BLOCK = 40, 22
#: bytes of a chunk's texts
CHUNK = 1 << 23
#: candidates of an automaton, about 100 bytes each
SHARD = 1 << 21
#: fixed values: what ends a piece; other spaces are the blank and the tab
ENDS = b".,;:!?\n\v\f\r"
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[np.frombuffer(ENDS, np.uint8)] = 10
_TABLE[9] = 32
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a batch: keys (with the row's language), places, and which follow each other in a piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, most: int = 1 << 23) -> None:
        raw, offsets = utf8(texts)
        self.data = _TABLE[raw]
        h, self.start, self.end, at = word_spans(self.data, offsets, fold=False)
        self.count = np.diff(at)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), self.count)
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        self.lang = codes.indices.to_numpy(zero_copy_only=False)
        self.of = self.lang[row]
        self.key = mix(h ^ np.array([lang_hash(x) for x in self.langs], np.uint64)[self.of]) if len(h) else h
        piece = np.cumsum(self.data == 10, dtype=np.int32)[self.start] if len(h) else np.zeros(0, np.int32)
        self.joined = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1]) if len(h) else np.zeros(0, bool)

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 2 to ``most`` words: how many, where phrases begin, and their keys (of all words in a row, phrase or not)."""
        key, whole = self.key, np.ones(len(self.key), bool)
        for k in range(2, most + 1):
            n = max(0, len(self.key) - k + 1)
            key = mix(key[:n] * _ODD ^ self.key[k - 1 :])
            whole = whole[:n] & self.joined[k - 2 :][:n]
            yield k, np.flatnonzero(whole), key

    def texts(self, first: np.ndarray, k: np.ndarray) -> pa.Array:
        """Phrases of k words from word ``first`` on, with single blanks."""
        start, end = self.start[first], self.end[first + k - 1]
        size = end - start
        until = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = self.data[np.repeat(start - until[:-1], size) + np.arange(until[-1])]
        out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(until), pa.py_buffer(data))
        inside = np.concatenate([[0], np.cumsum(self.end - self.start)])
        wide = np.flatnonzero(inside[first + k] - inside[first] + k - 1 != size)
        if len(wide):  # several spaces in a row
            every = out.to_pylist()
            for i in wide.tolist():
                every[i] = " ".join(x for x in every[i].split(" ") if x)
            out = pa.array(every, pa.large_string())
        return out


def pieces(rows: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and langs of about ``most`` bytes; a long text comes in parts cut where a piece ends."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[tuple[pa.Array, pa.Array]]:
        if held:
            t = pa.Table.from_batches(held).select(["text", "lang"]).combine_chunks()
            held.clear()
            yield t["text"].chunk(0), t["lang"].chunk(0)

    for b in batches(rows):
        if b.num_rows > 1 or b.nbytes <= most:
            if sum(x.nbytes for x in held) + b.nbytes > most:
                yield from flush()
            held.append(b)
            continue
        raw = utf8(b.column("text"))[0]
        at = 0
        while at < len(raw):
            stop = min(len(raw), at + most)
            while stop < len(raw):  # the next end of a piece
                more = np.flatnonzero(_TABLE[raw[stop : stop + most]] == 10)
                if len(more):
                    stop += int(more[0]) + 1
                    break
                stop = min(len(raw), stop + most)
            yield pa.array([raw[at:stop].tobytes().decode()]), b.column("lang")
            at = stop
    yield from flush()


def words_of(rows: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[Words]:
    for texts, langs in pieces(rows, most):
        yield Words(texts, langs)


def _cells(w: Words, words: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``words`` words: how many, where phrases begin, their keys there, and their cells."""
    yield 1, np.arange(len(w.key)), w.key, w.key >> np.uint64(64 - bits)
    for k, at, key in w.phrases(words):
        yield k, at, key[at], key[at] >> np.uint64(64 - bits)


def _packed(edge: np.ndarray, data: np.ndarray) -> pa.Array:
    """A row for each part of an array."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def chunked(docs: DataFrame, words: int, bits: int, low: int) -> DataFrame:
    """Chunks of texts (block -1), and the cells that they met with their counts, by blocks of 2**low cells."""
    schema = "chunk long, block int, text array<string>, lang array<string>, step0 binary, step1 binary, step2 binary, n binary"
    names = ["chunk", "block", "text", "lang", "step0", "step1", "step2", "n"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in pieces(rows):
            chunk = uuid.uuid4().int >> 65
            row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1], pa.int32()), row(texts), row(langs), *[pa.nulls(1, pa.binary())] * 4], names)
            cell, n = np.unique(np.concatenate([c for _, _, _, c in _cells(Words(texts, langs), words, bits)]), return_counts=True)
            block = (cell >> np.uint64(low)).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)])
            edge = np.append(first, len(cell))
            step = np.diff(cell, prepend=np.uint64(0))  # from one cell to the next within a block; upper bytes are mostly 0
            step[first] = cell[first] & np.uint64((1 << low) - 1)
            steps = [_packed(edge, (step >> np.uint64(8 * i)).astype(np.uint8)) for i in range(3)]
            m = len(first)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(block[first]), pa.nulls(m, row(texts).type), pa.nulls(m, row(langs).type), *steps, _packed(edge, np.minimum(n, 255).astype(np.uint8))], names)
            for k in range(0, m, 512):
                yield out.slice(k, 512)
        trim()

    return docs.mapInArrow(run, schema)


def reached(chunks: DataFrame, least: int, low: int) -> DataFrame:
    """chunk, block, reached: a bit for each cell that a chunk met in a block, whether its count reaches ``least``."""

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(1 << low, np.int32), []
        for b in parts:
            for chunk, n, *steps in zip(*(b.column(c) for c in ("chunk", "n", "step0", "step1", "step2")), strict=True):
                step = sum(np.frombuffer(x.as_buffer(), np.uint8).astype(np.uint32) << 8 * i for i, x in enumerate(steps))
                at = np.cumsum(step, dtype=np.uint32)
                total[at] += np.frombuffer(n.as_buffer(), np.uint8)
                met.append((chunk.as_py(), at))
        for k in range(0, len(met), 1024):
            some = met[k : k + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some]), pa.array([key[0].as_py()] * len(some), pa.int32()), pa.array([np.packbits(total[at] >= least).tobytes() for _, at in some], pa.binary())], ["chunk", "block", "reached"])

    return chunks.where("block >= 0").select("chunk", "block", "step0", "step1", "step2", "n").groupBy("block").applyInArrow(add, "chunk long, block int, reached binary")


class Automaton:
    """Phrases as word numbers (from 1 on), one after the other; phrase i has those from at[i] to at[i + 1]."""

    def __init__(self, number: np.ndarray, at: np.ndarray, kinds: int) -> None:
        import ahocorasick

        #: letters of an alphabet, three of which make a word
        self.base = int(np.ceil((kinds + 1) ** (1 / 3))) + 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text = self.letters(number).astype("<u2").tobytes().decode("utf-16-le")
        for i, (a, b) in enumerate(itertools.pairwise((3 * at).tolist())):
            self.automaton.add_word(text[a:b], i)
        self.automaton.make_automaton()

    def letters(self, number: np.ndarray) -> np.ndarray:
        out = np.empty((len(number), 3), np.uint16)
        out[:, 0], out[:, 1], out[:, 2] = number // (self.base * self.base) + 1, number // self.base % self.base + 1 + self.base, number % self.base + 1 + 2 * self.base
        return out

    def matches(self, number: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The phrase of each match; near: words after which the next may go on a phrase."""
        follows, use = np.zeros(len(number), bool), np.zeros(len(number), bool)
        follows[near + 1] = use[near] = use[near + 1] = True
        own = np.flatnonzero(use)
        out = np.zeros((len(own), 4), np.uint16)  # a delimiter before what doesn't follow
        out[:, 1:] = self.letters(number[own])
        write = np.ones(out.shape, bool)
        write[:, 0] = ~follows[own]
        text = out[write].astype("<u2").tobytes().decode("utf-16-le")
        return np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64)


def _sorted(cell: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of cells, and where each other cell begins in it."""
    wide = len(cell).bit_length()
    if bits + wide > 64:
        order = np.argsort(cell)
        cell = cell[order]
    else:  # numbers are sorted faster than places
        both = np.sort(cell << np.uint64(wide) | np.arange(len(cell), dtype=np.uint64))
        order, cell = (both & np.uint64((1 << wide) - 1)).astype(np.int64), both >> np.uint64(wide)
    return order, np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))


def _counts(w: Words, words: int, bits: int, low: int, blocks: np.ndarray, marks: list[bytes], shard: int) -> tuple[np.ndarray, ...]:
    """First word, number of words, key and count of the distinct candidates and frequent words of a chunk."""
    parts = list(_cells(w, words, bits))
    cell = np.concatenate([c for _, _, _, c in parts])
    order, first = _sorted(cell, bits)
    own, size = np.unique(cell[order[first]] >> np.uint64(low), return_counts=True)
    turn = np.argsort(blocks)
    assert np.array_equal(own.astype(np.int64), blocks[turn])
    met = np.concatenate([np.unpackbits(np.frombuffer(marks[i], np.uint8), count=n) for i, n in zip(turn.tolist(), size.tolist(), strict=True)]).astype(bool)
    mark = np.empty(len(cell), bool)
    mark[order] = np.repeat(met, np.diff(np.append(first, len(cell))))
    edge = np.cumsum([0, *(len(at) for _, at, _, _ in parts)])
    _, number = np.unique(w.key, return_inverse=True)
    number = (number + 1).astype(np.int32)
    firsts, ks, keys, counts, again = [], [], [], [], []
    near, good = np.zeros(len(w.key), bool), np.ones(len(w.key), bool)
    for i, (k, at, key, _) in enumerate(parts):
        hit = mark[edge[i] : edge[i + 1]]
        if k > 1:
            hit = hit & good[at] & good[at + 1]
        at, key = at[hit], key[hit]
        good = np.zeros(len(w.key), bool)
        good[at] = True
        key, place, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        firsts.append(at[place])
        ks.append(np.full(len(place), k))
        keys.append(key)
        counts.append(n)  # of words; of phrases, where it is 1
        again.append(n > 1 if k > 1 else np.zeros(len(n), bool))
        for j in range(k - 1):
            near[at[n[back] > 1] + j] = True
    first, k, key, count, again = (np.concatenate(x) for x in (firsts, ks, keys, counts, again))
    near, again = np.flatnonzero(near), np.flatnonzero(again)
    for a in range(0, len(again), shard):
        some = again[a : a + shard]
        at = np.append(0, np.cumsum(k[some]))
        own = Automaton(number[np.repeat(first[some] - at[:-1], k[some]) + np.arange(at[-1])], at, int(number.max()))
        count[some] = np.bincount(own.matches(number, near), minlength=len(some))
    return first, k, key, count


def counted(docs: DataFrame, words: int, least: int, bits: int = BITS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, f, w: exact counts of phrases, w as a list, and words that occur ``least`` times; and lang, n: words of each language."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, min(bits, int(size // 2).bit_length()))
    low = max(8, min(BLOCK, bits - 6))
    parts = max(64, min(1 << 16, size >> 22))
    chunks = table(chunked(docs, words, bits, low), "chunks")

    def count(texts: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        for texts_of, langs_of in zip(texts["text"], texts["lang"], strict=True):  # one
            w = Words(texts_of.values, langs_of.values)
            n = np.bincount(w.of, minlength=len(w.langs))
            gaps = pa.array([b""] * len(n), pa.binary())
            out.append(pa.table([pa.array([-1] * len(n), pa.int32()), pa.array(w.langs, pa.string()), gaps, gaps, _packed(np.arange(len(n) + 1), n.astype(np.int64))], names))
            if not len(w.key):
                continue
            first, k, key, f = _counts(w, words, bits, low, marks["block"].to_numpy(), marks["reached"].to_pylist(), shard)
            part, lang = (key >> np.uint64(20)) % np.uint64(parts), w.of[first]
            turn = np.lexsort((lang, part))
            first, k, f, part, lang = first[turn], k[turn], f[turn], part[turn], lang[turn]
            head = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])])[: len(part)])
            edge = np.append(head, len(part))
            phrases = w.texts(first, k)
            until = np.frombuffer(phrases.buffers()[1], np.int64)[: len(phrases) + 1]
            data = np.frombuffer(phrases.buffers()[2] or b"", np.uint8)
            out.append(pa.table([pa.array(part[head].astype(np.int32)), pa.array(w.langs, pa.string()).take(pa.array(lang[head])), _packed(until[edge], data), _packed(edge, np.diff(until).astype(np.int32)), _packed(edge, f.astype(np.int64))], names))
        trim()
        return pa.concat_tables(out)

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held, many = key[1].as_py(), [], 0
        total = 0
        merge = lambda: pa.concat_tables(held).group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])
        for b in rows:
            f = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in b.column("f")])
            if key[0].as_py() < 0:
                total += int(f.sum())
                continue
            size = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in b.column("size")])
            data = b"".join(b.column("data").to_pylist())
            held.append(pa.table({"phrase": pa.LargeStringArray.from_buffers(len(f), pa.py_buffer(np.append(0, np.cumsum(size, dtype=np.int64))), pa.py_buffer(data)), "f": pa.array(f)}))
            many += len(f)
            if many > 1 << 20:
                held = [merge()]
                many = len(held[0])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([total])], ["lang", "k", "phrase", "f"])
        if held:
            every = merge()
            every = every.filter(pc.greater_equal(every["f"], least)).combine_chunks()
            for b in every.to_batches(1 << 16):
                phrase = b.column("phrase").cast(pa.string())
                k = pc.add(pc.count_substring(phrase, " "), pa.scalar(1, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * b.num_rows, pa.string()), k.cast(pa.int32()), phrase, b.column("f")], ["lang", "k", "phrase", "f"])

    names = ["part", "lang", "data", "size", "f"]
    # a chunk is seconds of work: Spark would make as few tasks of them as their bytes allow
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 24)
    texts, marks = (x.repartition(tasks, "chunk").groupBy("chunk") for x in (chunks.where("block < 0").select("chunk", "text", "lang"), reached(chunks, least, low)))
    found = texts.cogroup(marks).applyInArrow(count, "part int, lang string, data binary, size binary, f binary")
    exact = table(found.groupBy("part", "lang").applyInArrow(add, "lang string, k int, phrase string, f long"), "counts")
    drop(chunks)
    return exact.where("k > 0").withColumn("w", F.split("phrase", " ")), exact.where("k = 0").select("lang", F.col("f").alias("n"))


def mine(docs: DataFrame, words: int = 3, least: int = 10, covered: int = 50, top: int = 2000, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``words`` words.

    A phrase that occurs ``least`` times or more is a candidate, unless a longer candidate that holds
    it occurs at least ``covered`` percent as often.  A null text has no words, a null lang is
    ``und``; repeated rows count each; other columns are ignored; an empty table gives an empty
    result.  Ties go by a, then by the phrase's bytes.  Texts are read in parts of 8 MB, cut where a
    piece ends, so their length doesn't matter; a piece itself is held whole.
    """
    exact, totals = counted(docs, words, least, bits, shard)
    cands = exact.where((F.col("k") > 1) & (F.col("f") >= least))
    f = exact.select("lang", "phrase", "f")
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = cands.select("lang", "phrase", "k", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", join(F.lit(1), F.col("cut")).alias("first"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), big("l") * big("r"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best"))
    if words > 2:
        parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
        longer = cands.where("k > 2").select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def sql(words: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> str:
    ends = r"[.,;:!?\x0A-\x0D]"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS p FROM w WHERE len(w) >= {k}" for k in range(1, words + 1))
    return f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ends}')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM d),
        f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM ({grams}) GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= {least}),
        u AS MATERIALIZED (SELECT lang, k, p, a, w, unnest(range(1, k)) AS cut FROM c),
        x AS MATERIALIZED (SELECT u.*, f.f AS l FROM u JOIN f ON f.lang = u.lang AND f.p = array_to_string(u.w[1:u.cut], ' ')),
        y AS MATERIALIZED (SELECT x.*, f.f AS r FROM x JOIN f ON f.lang = x.lang AND f.p = array_to_string(x.w[x.cut + 1:], ' ')),
        s AS (SELECT lang, p, a, cut, l, r, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
        m AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS p, max(a) AS longer FROM (SELECT lang, a, w, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT lang, k, a, w, unnest(range(2, k)) AS n FROM c WHERE k > 2)) GROUP BY 1, 2),
        r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank, b.p AS phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.p = b.p WHERE m.longer IS NULL OR 100 * m.longer < {covered} * a)
        SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= {top}"""
