"""Packing into windows of several sizes: tiers of powers of two, gaps filled from shorter tiers.

What a document has beyond whole windows of the largest size goes to the tier of the smallest window
that holds it.  Tiers are packed from the largest on: a window takes the longest document of its tier
and fills the gap with the longest ones of any shorter tier that fit; if none fits, the longest
document left gives its beginning.  So every window is full.  What is too little for a window of the
last tier goes to windows of smaller powers of two, so nothing is padded.

Windows of a tier are dealt to step groups of equally many tokens, the costliest first and back and
forth, so that groups of a tier differ little in attention cost (the sum of squared piece lengths).

A task packs what it reads, BLOCK tokens at a time: each block ends in at most one window of each
smaller power of two, a task holds one block, and no table is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import batches, small_batches
from vecloom.llm.packing import tokens

END = 1
#: tokens that a task packs together
BLOCK = 1 << 22
#: tokens of a step group
STEP = 1 << 17
Piece = tuple[int, int, int]  # document, start, length


class Pool:
    """Pieces by length; a bit of ``there`` for each length that has any."""

    def __init__(self, most: int) -> None:
        self.own: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        self.there = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.own[length].append((doc, start))
        self.there |= 1 << length

    def longest(self, limit: int) -> int:
        """The largest length of at most ``limit``, or 0."""
        return max(0, (self.there & ((2 << limit) - 1)).bit_length() - 1)

    def take(self, length: int) -> Piece:
        doc, start = self.own[length].pop()
        if not self.own[length]:
            self.there ^= 1 << length
        return doc, start, length


def windows(lengths: list[int], most: int, tiers: int) -> list[tuple[int, list[Piece]]]:
    """(size, pieces) of full windows that hold all tokens of documents of these lengths."""
    pool, out = Pool(most), []
    for doc, n in enumerate(lengths):
        for start in range(0, n - most + 1, most):
            out.append((most, [(doc, start, most)]))
        if n % most:
            pool.put(doc, n - n % most, n % most)
    for k in range(tiers):
        size = most >> k
        least = size // 2 if k < tiers - 1 else 0
        while (n := pool.longest(size)) > least:
            own, gap = [pool.take(n)], size - n
            while gap:
                if n := pool.longest(gap):
                    own.append(pool.take(n))
                elif n := pool.longest(most):
                    doc, start, _ = pool.take(n)
                    own.append((doc, start, gap))
                    pool.put(doc, start + gap, n - gap)
                    n = gap
                else:
                    break
                gap -= n
            out += [(size, own)] if not gap else halves(own, size // 2)
    return out


def halves(own: list[Piece], size: int) -> list[tuple[int, list[Piece]]]:
    """Windows of smaller and smaller powers of two for pieces that don't fill one of twice the size."""
    out, rest = [], sum(n for _, _, n in own)
    own = own[::-1]
    while rest:
        while size > rest:
            size //= 2
        part, gap = [], size
        while gap:
            doc, start, n = own.pop()
            if n > gap:
                own.append((doc, start + gap, n - gap))
                n = gap
            part.append((doc, start, n))
            gap -= n
        out.append((size, part))
        rest -= size
    return out


def step_groups(found: list[tuple[int, list[Piece]]], step: int) -> list[int]:
    """The step group of each window: groups hold windows of one size, as many tokens as each other."""
    of, first = [0] * len(found), 0
    sizes = np.array([size for size, _ in found])
    cost = np.array([sum(n * n for _, _, n in own) for _, own in found])
    for size in np.unique(sizes)[::-1].tolist():
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(-cost[own], kind="stable")]
        groups = -(-len(own) * size // step)
        turn = np.arange(len(own)) % (2 * groups)
        for i, g in zip(own.tolist(), np.minimum(turn, 2 * groups - 1 - turn).tolist(), strict=True):
            of[i] = first + g
        first += groups
    return of


def pack(docs: DataFrame, path: str, most: int = 2048, tiers: int = 4, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its text's ids (null text: none) and an end, id 1; tier is the size of the
    sequence's window, all of whose places are taken.  Every row is a document, repeated or not; a
    null doc_id stays null.  An empty table gives an empty result.  Other columns are ignored.  Long
    texts are encoded in parts; a block holds at least one document, however long.  path: the
    tokenizer's file, at the same place on every executor.  Numbers of sequences and groups depend on
    how the input is split into tasks.
    """
    if most & (most - 1) or not 0 < tiers <= most.bit_length():
        raise ValueError("windows must be powers of two")
    small_batches(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "tier": pa.int32(), "step_group": pa.int64()}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = tokens(path, END), TaskContext.get().partitionId() << 36
        names, texts, held, sequence, group = [], [], 0, base, base

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            found = windows([len(t) // 4 for t in texts], most, tiers)
            steps = step_groups(found, step)
            out = []
            for (size, pieces), g in zip(found, steps, strict=True):
                at = 0
                for doc, start, n in pieces:
                    out.append((names[doc], start, n, zlib.crc32(texts[doc][4 * start : 4 * (start + n)]), len(texts[doc]) // 4, sequence, at, size, group + g))
                    at += n
                sequence += 1
            group += max(steps) + 1
            whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
            for k in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(k, 1 << 16)

        for b in batches(rows, 1 << 21):
            for name, ids in zip(b.column("doc_id").to_pylist(), own.ids(b.column("text")), strict=True):
                names.append(name)
                texts.append(ids)
                held += len(ids) // 4
            if held >= block:
                yield from flush()
                names, texts, held = [], [], 0
        if texts:
            yield from flush()

    schema = ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in kinds.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
