"""Joint partitions of sets of dimensions, counted without a row per vector and set.

A block of a set of dimensions is known by the sum of random 128-bit numbers, one for each of its
(dimension, code) pairs.  So the label of a union is the sum of its parts' labels and that of a
complement a difference, whatever the number of dimensions: a set is one addition away from the sets
it is made of.  Tasks hold vectors in chunks: they number the blocks of parts within the chunk, add
up a contingency matrix for each pair of parts, and hand on one row for each set and block they met.
Spark adds those up.  Two blocks share a label with probability 2**-128 for each pair of blocks, and
2**-64 for each pair within a chunk.

Sets of many dimensions have nearly as many blocks as there are vectors, and would hand on a row for
each.  They are counted by cores instead: a core is a small part that many of these sets contain, and
a block of a set lies within one block of its core.  Vectors are sorted into ranges by the blocks of
the core, so a task counts blocks where they lie and hands on how many there are of each size.  Only
what lies in a core's block at either end of a range may go on in another one, and is handed on as above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.cost import entropy

Dims = tuple[int, ...]
#: codes that a task holds at once
CELLS = 1 << 21
#: cells of a contingency matrix, as a multiple of the chunk's vectors; sparser ones are sorted instead
DENSE = 4
#: vectors in a core's block, about, if its dimensions are independent
CORE = 256


def union(*parts: Sequence[int]) -> Dims:
    return tuple(sorted(i for p in parts for i in p))


@dataclass(frozen=True)
class Recipe:
    """A set of dimensions as the union of disjoint parts less others: each is one dimension or made before."""

    dims: Dims
    plus: tuple[Dims, ...]
    minus: tuple[Dims, ...] = ()


def recipe(dims: Sequence[int]) -> Recipe:
    """From its dimensions alone."""
    dims = tuple(sorted(dims))
    return Recipe(dims, tuple((i,) for i in dims))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(dim: int, code: np.ndarray, half: int) -> np.ndarray:
    """A fixed random number for each code of a dimension; two independent halves."""
    base = np.uint64((2 * dim + half + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return _mix(_mix(code.astype(np.uint64) + base) ^ base)


@dataclass(frozen=True)
class Shape:
    """Of coded vectors: how many rows, the least and the largest code, and the entropy of each dimension."""

    rows: int
    low: int
    top: int
    bits: tuple[float, ...]

    @property
    def need(self) -> float:
        return max(1.0, math.log2(self.rows / CORE))

    def wide(self, dims: Dims) -> bool:
        """Whether a set may have so many blocks that it is counted by a core."""
        return sum(self.bits[i] for i in dims) > self.need

    def cores(self, sets: Sequence[Dims]) -> list[tuple[Dims, list[int]]]:
        """Parts of enough entropy with the sets that contain them, each set once: dimensions in most of the sets first."""
        bits = np.array(self.bits)
        has = np.zeros((len(sets), len(bits)), bool)
        for k, dims in enumerate(sets):
            has[k, list(dims)] = True
        has &= bits > 0
        left, out = np.ones(len(sets), bool), []
        while left.any():
            core: list[int] = []
            of = left.copy()
            while bits[core].sum() < self.need:
                often = has[of].sum(0)
                often[core] = 0
                if not often.any():
                    break
                core.append(max(np.flatnonzero(often == often.max()).tolist(), key=lambda i: bits[i]))
                of &= has[:, core[-1]]
            out.append((tuple(sorted(core)), np.flatnonzero(of).tolist()))
            left &= ~of
        return out


class Chunk:
    """Labels of the sets of some vectors, and how many vectors each block holds."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray, halves: tuple[int, ...] = (0, 1)) -> None:
        self.codes, self.weight, self.halves = codes, weight, halves
        self.labels: dict[Dims, tuple[np.ndarray, ...]] = {}
        self.numbers: dict[Dims, tuple[np.ndarray, np.ndarray]] = {}

    def label(self, dims: Dims) -> tuple[np.ndarray, ...]:
        if dims not in self.labels and len(dims) == 1:
            code = self.codes[:, dims[0]]
            if code.min() >= 0 and code.max() < len(code):
                kinds, which = np.arange(int(code.max()) + 1), code
            else:
                kinds, which = np.unique(code, return_inverse=True)
            self.labels[dims] = tuple(_random(dims[0], kinds, half)[which] for half in self.halves)
        return self.labels[dims]

    def make(self, r: Recipe) -> None:
        if r.dims in self.labels or len(r.dims) == 1:
            return
        halves = []
        for half in self.halves:
            out = self.label(r.plus[0])[half].copy()
            for p in r.plus[1:]:
                out += self.label(p)[half]
            for p in r.minus:
                out -= self.label(p)[half]
            halves.append(out)
        self.labels[r.dims] = tuple(halves)

    def number(self, dims: Dims) -> tuple[np.ndarray, np.ndarray]:
        """Blocks numbered within the chunk, and a vector of each."""
        if dims not in self.numbers:
            _, first, which = np.unique(self.label(dims)[0], return_index=True, return_inverse=True)
            self.numbers[dims] = which, first
        return self.numbers[dims]

    def count(self, r: Recipe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both halves of the labels of a set's blocks, and their weights."""
        if len(r.plus) == 2 and not r.minus:
            (a, first_a), (b, first_b) = self.number(r.plus[0]), self.number(r.plus[1])
            if len(first_a) * len(first_b) <= DENSE * max(256, len(a)):
                cells = np.bincount(a * len(first_b) + b, self.weight, len(first_a) * len(first_b))
                hit = np.flatnonzero(cells)
                x, y = first_a[hit // len(first_b)], first_b[hit % len(first_b)]
                lo, hi = (self.label(r.plus[0])[h][x] + self.label(r.plus[1])[h][y] for h in (0, 1))
                return lo, hi, cells[hit]
            lo = self.label(r.plus[0])[0] + self.label(r.plus[1])[0]
            _, first, which = np.unique(lo, return_index=True, return_inverse=True)
            return lo[first], (self.label(r.plus[0])[1] + self.label(r.plus[1])[1])[first], np.bincount(which, self.weight)
        self.make(r)
        which, first = self.number(r.dims)
        lo, hi = self.label(r.dims)
        return lo[first], hi[first], np.bincount(which, self.weight)

    def sizes(self, r: Recipe) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of a set's blocks, and how many have each."""
        self.make(r)
        lo = self.label(r.dims)[0]
        if (self.weight == 1).all():
            lo = np.sort(lo)
            starts = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]]))
            size = np.diff(np.append(starts, len(lo)))
        else:
            order = np.argsort(lo)
            lo = lo[order]
            size = np.add.reduceat(self.weight[order], np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]])))
        size = np.rint(size).astype(np.int64)
        if size.max() > 8 * len(size) + 1024:
            return np.unique(size, return_counts=True)
        often = np.bincount(size)
        return np.flatnonzero(often), often[often > 0]


def _chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    cells = 0

    def chunk() -> Chunk:
        return Chunk(np.concatenate([c for c, _ in held]), np.concatenate([w for _, w in held]))

    for b in rows:
        if not b.num_rows:
            continue
        codes = b.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        held.append((codes, b.column("n").to_numpy().astype(np.float64)))
        cells += codes.size
        if cells >= CELLS:
            yield chunk()
            held.clear()
            cells = 0
    if held:
        yield chunk()


def _batch(out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    k = np.repeat(np.array([x[0] for x in out], np.int32), [len(x[1]) for x in out])
    lo, hi, n = (np.concatenate([x[i] for x in out]) for i in (1, 2, 3))
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(np.rint(n).astype(np.int64))], ["set_id", "lo", "hi", "n"])


def _sources(plan: Sequence[Recipe], asked: set[int]) -> set[Dims]:
    """What the asked sets of a plan are made of, and what that is made of."""
    sources: set[Dims] = set()
    for k in range(len(plan) - 1, -1, -1):
        if k in asked or plan[k].dims in sources:
            sources.update((*plan[k].plus, *plan[k].minus))
    return sources


def block_sizes(coded: DataFrame, recipes: Sequence[Recipe], wanted: Sequence[int] | None = None) -> DataFrame:
    """set_id, lo, hi (the block's label), n: blocks of the sets that recipes make, in order; of ``wanted`` ones or all.

    coded: codes, not null and of one length, and n where a row stands for several vectors.  A stage
    gets at most a row for each set, block and chunk of vectors, added up by task before the shuffle.
    """
    many = F.col("n").cast("long") if "n" in coded.columns else F.lit(1).cast("long")
    plan = list(recipes)
    asked = set(range(len(plan)) if wanted is None else wanted)
    sources = _sources(plan, asked)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(rows):
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for k, r in enumerate(plan):
                if r.dims in sources:
                    chunk.make(r)
                if k in asked:
                    out.append((k, *chunk.count(r)))
                    size += len(out[-1][1])
                if r.dims not in sources:
                    chunk.labels.pop(r.dims, None), chunk.numbers.pop(r.dims, None)
                if size > 1 << 18:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    met = coded.select("codes", many.alias("n")).mapInArrow(run, "set_id int, lo long, hi long, n long")
    return met.groupBy("set_id", "lo", "hi").agg(F.sum("n").alias("n"))


def core_sizes(coded: DataFrame, recipes: Sequence[Recipe], wanted: Sequence[int], shape: Shape) -> DataFrame:
    """set_id, n, many: how many blocks of each size the wanted sets have, counted by cores.

    A vector is shuffled once for each core.  Ranges are of the core's block and a hash of the vector,
    so that a core's block of any size is spread over tasks; what a task holds is a chunk.
    """
    many = F.col("n").cast("long") if "n" in coded.columns else F.lit(1).cast("long")
    plan, d = list(recipes), len(shape.bits)
    kind = np.min_scalar_type(shape.top) if shape.low >= 0 else np.dtype(np.int32)
    cores, steps = [], []
    for core, of in shape.cores([plan[k].dims for k in wanted]):
        asked = {wanted[x] for x in of}
        sources = _sources(plan, asked)
        cores.append(core)
        steps.append([(k, r, k in asked, r.dims in sources) for k, r in enumerate(plan) if k in asked or r.dims in sources])

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(rows):
            n = len(chunk.codes)
            ends = np.arange(0, (n + 1) * d * kind.itemsize, d * kind.itemsize, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chunk.codes.astype(kind)))])
            weight = pa.array(chunk.weight.astype(np.int64))
            for at, core in enumerate(cores):
                key = sum(chunk.label((i,))[0] for i in core).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at, np.int32)), pa.array(key), packed, weight], ["core", "key", "packed", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now, size, goes_on = -1, 0, True  # goes_on: the first key that is held may have rows elsewhere
        for b in batches:
            if not b.num_rows:
                continue
            core, key, n = (b.column(x).to_numpy() for x in ("core", "key", "n"))
            codes = _unpacked(b.column("packed"), kind, d)
            edges = [0, *(np.flatnonzero(core[1:] != core[:-1]) + 1), len(core)]
            for a, z in zip(edges, edges[1:], strict=False):
                if held and core[a] != now:
                    yield from counted(now, _joined(held), goes_on, False)
                    held, size, goes_on = [], 0, False
                now = core[a]
                held.append((key[a:z], codes[a:z], n[a:z]))
                size += z - a
                if size * d >= CELLS:
                    keys, *rest = _joined(held)
                    cut = int(np.searchsorted(keys, keys[-1]))
                    if cut:
                        yield from counted(now, (keys[:cut], *[x[:cut] for x in rest]), goes_on, False)
                        held = [(keys[cut:], *[x[cut:] for x in rest])]
                    else:
                        yield from counted(now, (keys, *rest), True, True)
                        held = []
                    goes_on, size = not cut, len(keys) - cut if cut else 0
        if held:
            yield from counted(now, _joined(held), goes_on, True)

    def counted(core: int, rows: tuple[np.ndarray, np.ndarray, np.ndarray], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """first, last: whether the rows' first and last key may have rows elsewhere."""
        keys, codes, n = rows
        a = int(np.searchsorted(keys, keys[0], "right")) if first else 0
        z = int(np.searchsorted(keys, keys[-1])) if last else len(keys)
        inner = slice(a, max(a, z))
        outer = np.r_[0:a, max(a, z) : len(keys)]
        for own, whole in ((inner, True), (outer, False)):
            chunk = Chunk(codes[own], n[own].astype(np.float64), (0,) if whole else (0, 1))
            if not len(chunk.codes):
                continue
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for k, r, wanted_, source in steps[core]:
                if source:
                    chunk.make(r)
                if wanted_ and whole:
                    size, often = chunk.sizes(r)
                    out.append((k, size.view(np.uint64), np.zeros(len(size), np.uint64), often))
                elif wanted_:
                    out.append((k, *chunk.count(r)))
                if not source:
                    chunk.labels.pop(r.dims, None), chunk.numbers.pop(r.dims, None)
                if sum(len(x[1]) for x in out) > 1 << 18:
                    yield batch(out, whole)
                    out = []
            if out:
                yield batch(out, whole)

    def batch(out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], whole: bool) -> pa.RecordBatch:
        b = _batch(out)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, whole))], [*b.schema.names, "whole"])

    dealt = coded.select("codes", many.alias("n")).mapInArrow(deal, "core int, key long, packed binary, n long")
    dealt = dealt.repartitionByRange("core", "key", F.xxhash64("packed")).sortWithinPartitions("core", "key")
    met = dealt.mapInArrow(run, "set_id int, lo long, hi long, n long, whole boolean")  # of whole blocks lo is their size and n their number
    met = met.groupBy("set_id", "whole", "lo", "hi").agg(F.sum("n").alias("n"))
    return met.select("set_id", F.when(F.col("whole"), F.col("lo")).otherwise(F.col("n")).alias("n"), F.when(F.col("whole"), F.col("n")).otherwise(1).cast("long").alias("many"))


def _joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[i] for x in held]) for i in range(3))  # type: ignore[return-value]


def _unpacked(packed: pa.Array, kind: np.dtype, d: int) -> np.ndarray:
    packed = packed.cast(pa.binary())
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(packed), d)


def blocks(coded: DataFrame, sets: Sequence[Sequence[int]]) -> DataFrame:
    """set_id, key, n: the blocks of each set of dimensions with their codes, in the order of the set."""
    plan = [tuple(s) for s in sets]
    many = F.col("n").cast("long") if "n" in coded.columns else F.lit(1).cast("long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(rows):
            for k, dims in enumerate(plan):
                chunk.make(recipe(dims))
                which, first = chunk.number(tuple(sorted(dims)))
                keys = chunk.codes[np.ix_(first, dims)].astype(np.int32)
                ends = pa.array(np.arange(0, keys.size + 1, len(dims), dtype=np.int32))
                n = np.rint(np.bincount(which, chunk.weight)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.array(n)], ["set_id", "key", "n"])
                if len(dims) > 1:
                    chunk.labels.pop(tuple(sorted(dims))), chunk.numbers.pop(tuple(sorted(dims)))

    met = coded.select("codes", many.alias("n")).mapInArrow(run, "set_id int, key array<int>, n long")
    return met.groupBy("set_id", "key").agg(F.sum("n").alias("n"))


def entropies(coded: DataFrame, recipes: Sequence[Recipe], total: float, wanted: Sequence[int] | None = None, shape: Shape | None = None) -> DataFrame:
    """set_id, h, blocks of the joint partition of each set; with a shape, wide sets are counted by cores."""
    plan = list(recipes)
    ids = list(range(len(plan)) if wanted is None else wanted)
    wide = [k for k in ids if shape.wide(plan[k].dims)] if shape else []
    narrow = sorted(set(ids) - set(wide))
    sizes = block_sizes(coded, plan, narrow).select("set_id", "n", F.lit(1).cast("long").alias("many")) if narrow or not wide else None
    if wide:
        by_core = core_sizes(coded, plan, wide, shape)
        sizes = by_core if sizes is None else sizes.unionByName(by_core)
    return sizes.groupBy("set_id").agg(entropy(F.col("n"), F.lit(float(total)), F.col("many")).alias("h"), F.sum("many").alias("blocks"))
