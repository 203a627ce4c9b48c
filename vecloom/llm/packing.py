"""Sequence packing: length patterns fitted to the histogram by non-negative least squares.

Lengths are sorted into SLOTS classes.  Patterns are one to four classes whose lengths can fill a
sequence exactly; they are columns of a least-squares problem whose rows are the classes, and its
non-negative solution, rounded down, says how often to use each.  A pattern takes lengths of its
classes that add up to the whole sequence, those first of which most are left.  What rounding and
missing lengths leave over is fitted again while that places a good part of it.  The residual is
packed by best fit, longest first; the shortest documents are kept for it, to fill its gaps.

The driver plans with one count per length, whatever the input; documents find their place by their
rank among those of their length.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import _SPACE, batches, mix, small_batches, table, utf8, word_spans

SLOTS, DEEP = 64, 4
CACHE = 1 << 19
#: the shortest documents, up to this share of all tokens, aren't put into patterns
RESERVE = 0.01
#: a fit that places less than this share of what it asks for is the last one
WORTH = 0.25
#: wide spaces beside other white space or at the ends of a text: those texts aren't cut at white space
_WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"[\t-\r ][{_WIDE}]|[{_WIDE}][\t-\r ]|\A[{_WIDE}]|[{_WIDE}]\z"
#: longer texts are encoded in parts of about this many bytes
PART = 1 << 22
_TAIL = np.uint64(0xA0761D6478BD642F)


class Tokens:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Where white space follows something else, that library always splits, so a text's ids are those of
    its units in turn: each word with the white space before it, however long, and what is left at the
    end.  A batch's different units are found by 64-bit hashes and length; the library encodes those
    that aren't known yet, some hundred at a time, and the rest is gathering.  Long texts come in parts
    of whole units.  Special tokens are cut out first.  Texts with wide spaces beside other white space
    are encoded by the library in parts of 64 KB.
    """

    def __init__(self, path: str, end: int = 0) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError("the file must be byte-level BPE that splits at spaces and changes no text")
        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must not take in what is around them")
        names = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(names.values()) + 1, np.int64)  # of each token: a letter stands for a byte
        for name, i in names.items():
            self.bytes[i] = len(name)
        self.line = len(self._encode("\n"))
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count, self.chars = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.full(1, self.end, np.uint32)  # ids of all known units; the first is the end's

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and how many each has."""
        texts = [b"".join(units[at : at + 100]).decode() for at in range(0, len(units), 100)]
        ids = np.concatenate([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]).astype(np.uint32)
        until = np.cumsum([len(w) for w in units])
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), until, "right"), prepend=0)

    def _learn(self, raw: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bare: np.ndarray, tail: np.ndarray) -> None:
        inner = np.flatnonzero(~tail)
        ids, count, order = [], [], [inner, np.flatnonzero(tail)]
        if len(inner):
            got = self._units([(b"\n" if b else b"") + raw[i:j].tobytes() for i, j, b in zip(lo[inner], hi[inner], bare[inner], strict=True)])
            ids.append(got[0]), count.append(got[1])
        for k in order[1]:  # white space at the end of a text must not meet another unit's
            ids.append(self._encode(raw[lo[k] : hi[k]].tobytes().decode()))
            count.append([len(ids[-1])])
        count, order = np.concatenate(count).astype(np.int64), np.concatenate(order)
        first = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *ids])
        every = [np.concatenate(x) for x in ((self.keys, keys[order]), (self.start, first), (self.count, count), (self.chars, (hi - lo + bare)[order]))]
        turn = np.argsort(every[0], kind="stable")
        self.keys, self.start, self.count, self.chars = (x[turn] for x in every)

    @staticmethod
    def _gaps(raw: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of the white space that begins at each place."""
        out = np.full(len(lo), 10, np.uint64)  # none counts as a line break
        some = np.flatnonzero(size > 0)
        out[some] = raw[lo[some]]
        for j in range(1, 8):
            some = some[size[some] > j]
            out[some] |= raw[lo[some] + j].astype(np.uint64) << np.uint64(8 * j)
        for k in some[size[some] > 8].tolist():
            out[k] = int.from_bytes(hashlib.blake2b(raw[lo[k] : lo[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
        return mix(out)

    def plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, an end after each, and where each begins (rows + 1 values)."""
        raw, offsets = utf8(column)
        h, start, hi, at = word_spans(raw, offsets, fold=False)
        lo = np.concatenate([[0], hi[:-1]]) if len(hi) else hi
        some = at[1:] > at[:-1]
        lo[at[:-1][some]] = offsets[:-1][some]
        bare = start == lo
        key = h ^ self._gaps(raw, lo, start - lo)
        # what is left at the end of a row is a unit too
        rest = offsets[:-1].copy()
        rest[some] = hi[at[1:][some] - 1]
        tail = rest < offsets[1:]
        own = at[1:][tail]
        key = np.insert(key, own, self._gaps(raw, rest[tail], (offsets[1:] - rest)[tail]) ^ _TAIL)
        lo, hi, bare, tails = np.insert(lo, own, rest[tail]), np.insert(hi, own, offsets[1:][tail]), np.insert(bare, own, False), np.insert(np.zeros(len(h), bool), own, True)
        at = at + np.concatenate([[0], np.cumsum(tail)])
        size = hi - lo + bare
        key ^= size.astype(np.uint64)
        kinds = pa.array(key).dictionary_encode()
        code, keys = kinds.indices.to_numpy(), kinds.dictionary.to_numpy()
        place = np.zeros(len(keys), np.int64)
        place[code[::-1]] = np.arange(len(code))[::-1]
        if len(self.keys) > CACHE:
            self.forget()
        known = self._find(keys)[1]
        new = place[~known]
        if len(new):
            self._learn(raw, keys[~known], lo[new], hi[new], bare[new], tails[new])
        found, known = self._find(keys)
        if not known.all() or (self.chars[found] != size[place]).any():
            raise AssertionError("two units of one hash")
        first, count = self.start[found][code], self.count[found][code]
        first[bare] += self.line
        count[bare] -= self.line
        first, count = np.insert(first, at[1:], 0), np.insert(count, at[1:], 1)
        until = np.cumsum(count)
        ids = self.pool[np.arange(until[-1]) + np.repeat(first - until + count, count)] if len(until) else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], until])[at + np.arange(len(at))]

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one long text and its end, a part at a time; parts end before white space."""
        out, at = [], 0
        while at < len(raw):
            stop = min(len(raw), at + PART)
            while stop < len(raw):
                edge = np.flatnonzero(_SPACE[raw[stop : stop + PART]] & ~_SPACE[raw[stop - 1 : stop + PART - 1]][: len(raw) - stop])
                if len(edge):
                    stop += int(edge[0])
                    break
                stop = min(len(raw), stop + PART)
            out.append(self.plain(pa.array([raw[at:stop].tobytes().decode()], pa.large_string()))[0][:-1])
            at = stop
        return np.append(np.concatenate(out), np.uint32(self.end))

    def _apart(self, text: str) -> np.ndarray:
        """Ids of a text with special tokens or odd white space, and its end."""
        out = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                at = 0
                while at < len(part):
                    edge = _EDGE.search(part, at + (1 << 16))
                    stop = edge.start() if edge else len(part)
                    out.append(self._encode(part[at:stop]))
                    at = stop
        return np.append(np.concatenate(out), np.uint32(self.end)) if out else np.array([self.end], np.uint32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def ids(self, column: pa.Array) -> Iterator[memoryview]:
        """Little-endian ids of each text, an end after each."""
        import pyarrow.compute as pc

        column = column.fill_null("")
        odd = pc.match_substring_regex(column, _ODD)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(column, name))
        odd = odd.to_numpy(zero_copy_only=False)
        long = pc.binary_length(column).to_numpy(zero_copy_only=False) > 2 * PART
        ids, at = self.plain(column.filter(pa.array(~odd & ~long)))
        raw, k = memoryview(ids.astype("<u4").tobytes()), 0
        for i in range(len(column)):
            if odd[i]:
                yield memoryview(self._apart(column[i].as_py()).astype("<u4").tobytes())
            elif long[i]:
                yield memoryview(self._long(utf8(column.slice(i, 1))[0]).astype("<u4").tobytes())
            else:
                yield raw[4 * at[k] : 4 * at[k + 1]]
                k += 1


#: where one of the library's spaces follows something else
_EDGE = re.compile("(?<=[^SPACES])[SPACES]".replace("SPACES", "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))
_tokens: dict[tuple[str, int], Tokens] = {}


def tokens(path: str, end: int = 0) -> Tokens:
    """One for each Python worker, file and id of the end."""
    if (path, end) not in _tokens:
        _tokens[path, end] = Tokens(path, end)
    return _tokens[path, end]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set: at most as many entries as rows are not 0."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[k] = True
        while True:
            on = np.flatnonzero(active)
            want = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (want > 1e-12).all():
                x[:] = 0
                x[on] = want
                break
            low = want <= 1e-12
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(low, x[on] / np.maximum(x[on] - want, 1e-300), np.inf))
            x[on] += min(1.0, step) * (want - x[on])
            active[on[low & (x[on] <= 1e-12)]] = False
            x[~active] = 0
            if k in on and not active[k]:
                return x
    return x


def patterns(present: np.ndarray, step: int, most: int) -> list[tuple[int, ...]]:
    """One to DEEP classes, largest first, some of whose lengths sum to ``most``; class c has step * c and up."""
    on = np.flatnonzero(present).tolist()
    there = set(on)
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int, more: int) -> None:
        if more == 1:
            if rest in there and (not head or rest <= head[-1]):
                out.append((*head, rest))
            return
        for c in on:
            if c > rest or (head and c > head[-1]):
                break
            if c * more >= rest:
                grow((*head, c), rest - c, more - 1)

    for n in range(1, DEEP + 1):
        for total in range(most // step + 1):
            above = most - step * total  # what the lengths must have beyond the beginnings of their classes
            if 0 <= above <= n * (step - 1) and abs(above - n * (step - 1) / 2) <= 0.75 * step:
                grow((), total, n)
    return out


def drawn(kind: tuple[int, ...], left: np.ndarray, step: int, most: int) -> tuple[list[int], int]:
    """Lengths of the pattern's classes that sum to ``most``, of those that can be used most often; and how often."""
    often, ways = np.array([np.iinfo(np.int64).max]), []  # by what the lengths so far have beyond their classes' beginnings
    for i, c in enumerate(kind):
        free = left[c * step : (c + 1) * step] // kind[: i + 1].count(c)  # a length may be drawn again
        more = np.zeros(len(often) + step - 1, np.int64)
        way = np.zeros(len(more), np.int64)
        for j, n in enumerate(free.tolist()):
            if n:
                times, best = np.minimum(often, n), more[j : j + len(often)]
                way[j : j + len(often)][times > best] = j
                np.maximum(best, times, out=best)
        often, ways = more, [*ways, way]
    above = most - step * sum(kind)
    times = int(often[above])
    lengths = []
    for c, way in zip(reversed(kind), reversed(ways), strict=True) if times else ():
        lengths.append(c * step + int(way[above]))
        above -= int(way[above])
    return lengths, times


def fitted(free: np.ndarray, step: int, most: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns of classes, and how often each is to be used."""
    classes = np.bincount(np.arange(most + 1) // step, free)
    kinds = patterns(classes > 0, step, most)
    a = np.zeros((len(classes), len(kinds)))
    for j, kind in enumerate(kinds):
        for c in kind:
            a[c, j] += 1
    weight = ((np.arange(len(classes)) + 0.5) / len(classes)) ** 2  # what is long is harder to place later
    return kinds, nonnegative_least_squares(a * weight[:, None], classes * weight) if kinds else np.zeros(0)


def plan(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold exactly counts[length] documents of each length.

    Where so few lengths occur that hardly any add up to ``most``, best fit alone may need fewer
    sequences than patterns and their residual; then it is taken.
    """
    return min(by_patterns(counts, most), best_fit(counts, most), key=lambda p: sum(times for _, times in p))


def by_patterns(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as the fits say, and the residual by best fit."""
    step = -(-most // SLOTS)
    tokens = np.cumsum(counts * np.arange(most + 1))
    short = int(np.searchsorted(tokens, RESERVE * tokens[-1], "right"))
    free = np.where(np.arange(most + 1) < short, 0, counts)
    out: list[tuple[tuple[int, ...], int]] = []
    while True:
        kinds, x = fitted(free, step, most)
        placed = 0
        for kind, asked in zip(kinds, np.floor(x + 1e-6).astype(np.int64).tolist(), strict=True):
            while asked:
                lengths, times = drawn(kind, free, step, most)
                if not times:
                    break
                times = min(times, asked)
                np.subtract.at(free, lengths, times)
                out.append((tuple(lengths), times))
                asked, placed = asked - times, placed + times
        if not placed or placed < WORTH * x.sum():
            break
    return out + best_fit(np.where(np.arange(most + 1) < short, counts, free), most)


def best_fit(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that begin with the longest document left and take the longest that fits, again and again."""
    left = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    while len(there := np.flatnonzero(left)):
        lengths, room = [], most
        while len(there := there[: np.searchsorted(there, room, "right")]):
            n = int(there[-1])
            if lengths.count(n) < left[n]:
                lengths.append(n)
                room -= n
            else:
                there = there[:-1]  # all of this length are in it already
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        out.append((tuple(lengths), times))
    return out


def pieces(docs: DataFrame, path: str, most: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and task, nth: its place among the task's of its length."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = tokens(path), TaskContext.get().partitionId(), [0] * (most + 1)
        for b in batches(rows, 1 << 21):
            out: list[tuple] = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), own.ids(b.column("text")), strict=True):
                n = len(raw) // 4
                at, k = 0, 0
                while at < n:
                    size = n if n <= most else (n - at) % most or most
                    out.append((doc, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), task, seen[size]))
                    seen[size] += 1
                    at, k = at + size, k + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, path: str, most: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null text: none) and an end, id 0; only documents of more than
    ``most`` ids are cut, the first piece being the shorter one.  Every row counts, repeated or not.
    An empty table gives an empty result.  Other columns are ignored.  Long texts are encoded in parts of
    4 MB.  path: the tokenizer's file, at the same place on every executor.
    """
    small_batches(docs.sparkSession)
    cut = table(pieces(docs, path, most), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(most + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r.length] = r.n
    used, first = np.zeros(most + 1, np.int64), 0
    rows = []
    for lengths, times in plan(counts, most):
        at = 0
        for n in lengths:
            rows.append((n, int(used[n]), first, at))
            used[n] += times
            at += n
        first += times
    if (used != counts).any():
        raise AssertionError("the plan leaves documents out")
    steps = np.array(sorted(rows), np.int64).reshape(-1, 4)
    span = 1 << 44
    shared = docs.sparkSession.sparkContext.broadcast((steps[:, 0] * span + steps[:, 1], steps[:, 1], steps[:, 2], steps[:, 3]))  # some rows per length

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, sequence, offset = shared.value
        for b in rows:
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(key, b.column("length").to_numpy() * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[k] + rank - start[k]), pa.array(offset[k])], [*b.schema.names[:-1], "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
