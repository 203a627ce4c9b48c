"""Search for the cheapest grouping of dimensions: merging over all pairs, or along a tree.

The loop runs on the driver over one row per candidate; entropies and numbers of blocks come from
Spark jobs over contingency matrices (see contingency), some candidates ahead of the loop: a job also
looks at what the next best candidates would ask for, as far as LOOKAHEAD and GUESSES let it.  Candidates are
kept in heaps, in which outdated ones stay until they come up.  Changes within rounding of 0 are no
improvement.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.cost import corrected_of, subspace_bits_of
from vecloom.operators import contingency
from vecloom.operators.contingency import Dims, Recipe, recipe, union
from vecloom.operators.decomposition import Decomposition
from vecloom.operators.entropy_graph import Edge

#: sets times different codes that a job may look at beyond what is asked for, and how many guesses it may make
LOOKAHEAD = 1 << 27
GUESSES = 4
#: sets of one job
SETS = 1 << 19


@dataclass
class Evaluator:
    """Entropy and number of blocks of joint partitions, each set once."""

    coded: DataFrame
    true_n: int
    correct: bool = False
    n: int = 0
    known: dict[Dims, tuple[float, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # equal codes are one row; what depends on them needs only their number
        self.coded = self.coded.groupBy("codes").agg(F.count(F.lit(1)).alias("n")).persist()
        size = self.coded.agg(F.sum("n"), F.max(F.size("codes")), F.count(F.lit(1)), F.min(F.array_min("codes")), F.max(F.array_max("codes"))).first()
        self.n, self.d, self.rows, self.low, self.top = size[0] or 0, size[1] or 0, *size[2:]
        if not self.n or not self.d:
            self.close()
            raise ValueError("there are no vectors")

    def close(self) -> None:
        self.coded.unpersist()

    def look(self, plan: Iterable[Recipe]) -> None:
        """Finds out about the sets that a plan makes; later ones may be made of earlier ones."""
        first: dict[Dims, Recipe] = {}
        for r in plan:
            first.setdefault(r.dims, r)  # what a later one is made of may not be there yet
        plan = list(first.values())
        wanted = [k for k, r in enumerate(plan) if r.dims not in self.known]
        shape = self._shape() if any(len(plan[k].dims) > 2 for k in wanted) else None
        for at in range(0, len(wanted), SETS):
            for r in contingency.entropies(self.coded, plan, self.n, wanted[at : at + SETS], shape).collect():  # a row per set
                self.known[plan[r.set_id].dims] = round(r.h, 12) + 0.0, r.blocks

    def _shape(self) -> contingency.Shape | None:
        """None for a table of no more than a chunk."""
        if self.rows * self.d <= contingency.CELLS:
            return None
        self.look(recipe((i,)) for i in range(self.d))
        return contingency.Shape(self.rows, self.low, self.top, tuple(self.known[i,][0] for i in range(self.d)))

    def ahead(self, sets: int) -> int:
        """How many candidates of so many sets each a job may look at besides the one that is asked for."""
        return min(GUESSES, LOOKAHEAD // max(1, sets * self.rows))

    def entropy(self, dims: Sequence[int]) -> float:
        self.look([recipe(dims)])
        return self.known[tuple(sorted(dims))][0]

    def blocks(self, dims: Sequence[int]) -> int:
        self.look([recipe(dims)])
        return self.known[tuple(sorted(dims))][1]

    def clusters(self, dims: Sequence[int]) -> float:
        e = 2.0 ** self.entropy(dims)
        if not self.correct:
            return e
        self.look(recipe((i,)) for i in dims)
        product = math.prod(float(self.known[i,][1]) for i in dims)
        return corrected_of(min(e, product), product, self.n, self.true_n)

    def cost(self, dims: Sequence[int]) -> float:
        return subspace_bits_of(self.clusters(dims), len(dims), self.true_n)


def better(delta: float, scale: float) -> bool:
    return delta < -1e-9 * abs(scale)


Trace = list[tuple[int, str, int, float]]  # round, phase, step, cost


def merging(ev: Evaluator, merges: Sequence[tuple[Dims, Dims]], beside: Callable[[Dims, Dims], Iterable[Dims]]) -> None:
    """Looks at each union of two parts together with the parts beside it, and with the other unions.

    The first union is asked for, the others are guesses: they are only looked at if the first needs a job.
    """
    around = {(a, b): list(beside(a, b)) for a, b in merges}
    first = merges[0]
    if all(union(*first, x) in ev.known for x in around[first]):
        return
    parts = {x for m in merges for x in (*m, *around[m])}
    wholes = [Recipe(union(a, b), (a, b)) for a, b in merges]
    plan = [recipe(x) for x in sorted(parts)] + wholes
    plan += [Recipe(union(w.dims, x), (w.dims, x)) for w, m in zip(wholes, merges, strict=True) for x in around[m]]
    plan += [Recipe(union(v.dims, w.dims), (v.dims, w.dims)) for (v, m), w in itertools.product(zip(wholes, merges, strict=True), wholes) if v.dims < w.dims and any(x in around[m] for x in w.plus)]
    ev.look(plan)


def merge_all_pairs(ev: Evaluator, steps: list[list[Dims]] | None = None) -> tuple[Decomposition, Trace]:
    """Merges the pair of subspaces that saves most bits (ties to the smaller names) while one saves any.

    steps: takes up the subspaces before the first and after each merge.
    """
    steps = [] if steps is None else steps
    parts: dict[int, Dims] = {i: (i,) for i in range(ev.d)}
    found = Decomposition.singletons(ev.d)
    ev.look([recipe((i,)) for i in parts] + [recipe((i, j)) for i in parts for j in parts if i < j])
    cost = {i: ev.cost(parts[i]) for i in parts}
    version = dict.fromkeys(parts, 0)
    entry = lambda i, j: (ev.cost(union(parts[i], parts[j])) - cost[i] - cost[j], i, j, version[i], version[j])
    heap = [entry(i, j) for i in parts for j in parts if i < j]
    heapq.heapify(heap)
    total = sum(cost.values())
    trace: Trace = [(0, "merge", 0, total)]
    steps.append(list(parts.values()))

    def now(e: tuple) -> bool:
        return version.get(e[1]) == e[3] and version.get(e[2]) == e[4]

    def next_best(most: int) -> list[tuple[Dims, Dims]]:
        """The best candidates that share no subspace, without taking them off."""
        taken, out, seen = set(), [], []
        while heap and len(out) < most and len(seen) < 16 * most:
            e = heapq.heappop(heap)
            if not now(e):
                continue
            seen.append(e)
            if not better(e[0], cost[e[1]] + cost[e[2]]):
                break
            if not {e[1], e[2]} & taken:
                taken |= {e[1], e[2]}
                out.append((parts[e[1]], parts[e[2]]))
        for e in seen:
            heapq.heappush(heap, e)
        return out

    while heap:
        best = heapq.heappop(heap)
        if not now(best):
            continue
        delta, i, j, *_ = best
        if not better(delta, cost[i] + cost[j]):
            break
        if len(parts) > 2:
            heapq.heappush(heap, best)
            merges = next_best(1 + ev.ahead(len(parts)))
            heapq.heappop(heap)
            live = list(parts.values())
            merging(ev, merges, lambda a, b, live=live: [x for x in live if x not in (a, b)])
        found.merge(i, j)
        parts[i] = union(parts[i], parts.pop(j))
        cost[i] = ev.cost(parts[i])
        del cost[j], version[j]
        version[i] += 1
        total += delta
        trace.append((0, "merge", len(trace), total))
        steps.append(list(parts.values()))
        for k in parts:
            if k != i:
                heapq.heappush(heap, entry(min(i, k), max(i, k)))
    return found, trace


class TreeMerger:
    """Merges along tree edges between subspaces; of equal candidates the first in the queue wins."""

    def __init__(self, ev: Evaluator, start: Decomposition, edges: list[Edge]) -> None:
        self.ev, self.found = ev, Decomposition(start.of)
        self.parts: dict[int, Dims] = {s: tuple(start.dims(s)) for s in start.subspaces()}
        self.edges = dict(enumerate(e for e in edges if not start.together(*e)))
        self.at: dict[int, set[int]] = {s: set() for s in self.parts}  # edges that end in a subspace
        ends = {k: self._ends(k) for k in self.edges}
        for k, (a, b) in ends.items():
            self.at[a].add(k), self.at[b].add(k)
        ev.look([recipe(x) for x in self.parts.values()] + [Recipe(union(self.parts[a], self.parts[b]), (self.parts[a], self.parts[b])) for a, b in ends.values()])
        self.costs = {s: ev.cost(x) for s, x in self.parts.items()}
        self.losses = [sum(self.costs.values())]
        self.version = dict.fromkeys(self.edges, 0)
        self.heap = [self._entry(k) for k in self.edges]
        heapq.heapify(self.heap)

    def _ends(self, k: int) -> tuple[int, int]:
        return self.found.of[self.edges[k][0]], self.found.of[self.edges[k][1]]

    def _entry(self, k: int) -> tuple[float, int, int]:
        a, b = self._ends(k)
        return self.ev.cost(union(self.parts[a], self.parts[b])) - self.costs[a] - self.costs[b], k, self.version[k]

    def _head(self) -> tuple[float, int, int] | None:
        while self.heap and self.version.get(self.heap[0][1]) != self.heap[0][2]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap and better(self.heap[0][0], self.losses[-1]) else None

    def best(self) -> Edge | None:
        e = self._head()
        return self.edges[e[1]] if e else None

    def _merges(self, most: int) -> list[tuple[Dims, Dims]]:
        """The best candidates that share no subspace."""
        taken: set[int] = set()
        out = []
        for delta, k, v in heapq.nsmallest(16 * most, self.heap) if most > 1 else self.heap[:1]:
            if self.version.get(k) == v and better(delta, self.losses[-1]) and len(out) < most:
                a, b = self._ends(k)
                if not {a, b} & taken:
                    taken |= {a, b}
                    out.append((self.parts[a], self.parts[b]))
        return out

    def _beside(self, a: Dims, b: Dims) -> list[Dims]:
        a, b = a[0], b[0]  # a subspace's name is its first dimension
        return [self.parts[x] for x in sorted({x for k in self.at[a] | self.at[b] for x in self._ends(k)} - {a, b})]

    def step(self) -> bool:
        head = self._head()
        if head is None:
            return False
        delta, k, _ = head
        a, b = self._ends(k)
        merging(self.ev, self._merges(1 + self.ev.ahead(4)), self._beside)
        heapq.heappop(self.heap)
        self.losses.append(self.losses[-1] + delta)
        name = self.found.merge(*self.edges.pop(k))
        del self.version[k]
        gone = b if name == a else a
        self.parts[name] = union(self.parts[a], self.parts.pop(gone))
        self.at[name] = (self.at[name] | self.at.pop(gone)) - {k}
        del self.costs[gone]
        self.costs[name] = self.ev.cost(self.parts[name])
        for q in sorted(self.at[name]):
            self.version[q] += 1
            heapq.heappush(self.heap, self._entry(q))
        return True


class TreeSplitter:
    """Cuts tree edges within subspaces; of equal candidates the one found first wins."""

    def __init__(self, ev: Evaluator, start: Decomposition, around: list[list[int]]) -> None:
        self.ev, self.found, self.around = ev, Decomposition(start.of), around
        self.parts: dict[int, Dims] = {s: tuple(start.dims(s)) for s in start.subspaces()}
        ev.look(r for x in self.parts.values() for r in self.plan(x))
        self.costs = {s: ev.cost(x) for s, x in self.parts.items()}
        self.losses = [sum(self.costs.values())]
        self.seen = 0
        self.heap: list[tuple[float, int, Dims, Dims, Dims]] = []
        for x in self.parts.values():
            self._enqueue(x)

    def _tree(self, own: Dims) -> tuple[list[int], dict[int, int]]:
        """Dimensions of a subspace from its first one on, and each one's parent."""
        inside = set(own)
        order, parent = [own[0]], {own[0]: -1}
        for node in order:
            for c in self.around[node]:
                if c in inside and c not in parent:
                    parent[c] = node
                    order.append(c)
        return order, parent

    def plan(self, own: Dims) -> list[Recipe]:
        """What makes both sides of all cuts of a subspace, an addition or subtraction for each.

        What lies below a dimension is itself and what lies below its children; the other side of the
        edge above it is the rest of the subspace.
        """
        order, parent = self._tree(own)
        below: dict[int, Dims] = {}
        parts: dict[int, list[Dims]] = {i: [(i,)] for i in order}
        out = []
        for node in reversed(order):
            below[node] = union(*parts[node])
            out.append(Recipe(below[node], tuple(parts[node])))
            if parent[node] >= 0:
                parts[parent[node]].append(below[node])
        return out + [Recipe(tuple(sorted(set(own) - set(below[i]))), (own,), (below[i],)) for i in order[1:]]

    def cuts(self, own: Dims) -> list[tuple[Dims, Dims]]:
        """What lies below each edge of a subspace's tree, and the rest of it."""
        order = self._tree(own)[0]
        made = self.plan(own)
        below = {r.dims: r for r in made}
        return [(r.minus[0], r.dims) for r in made[len(order) :] if r.dims in below]

    def _enqueue(self, own: Dims) -> None:
        for a, b in self.cuts(own):
            heapq.heappush(self.heap, (self.ev.cost(a) + self.ev.cost(b) - self.costs[own[0]], self.seen, own, a, b))
            self.seen += 1

    def _live(self, e: tuple[float, int, Dims, Dims, Dims]) -> bool:
        return self.parts.get(e[2][0]) == e[2]

    @property
    def queue(self) -> list[tuple[float, int, Dims, Dims, Dims]]:
        return [e for e in self.heap if self._live(e)]

    def step(self) -> bool:
        while self.heap and not self._live(self.heap[0]):
            heapq.heappop(self.heap)
        if not self.heap or not better(self.heap[0][0], self.losses[-1]):
            return False
        delta, _, own, a, b = self.heap[0]
        new = [r for x in (a, b) for r in self.plan(x)]
        if any(r.dims not in self.ev.known for r in new):
            many = 1 + self.ev.ahead(2 * len(own))
            for e in heapq.nsmallest(many, self.heap)[1:] if many > 1 else []:
                if self._live(e) and better(e[0], self.losses[-1]):
                    new += [r for x in e[3:] for r in self.plan(x)]
            self.ev.look(new)
        heapq.heappop(self.heap)
        self.losses.append(self.losses[-1] + delta)
        del self.costs[own[0]], self.parts[own[0]]
        self.found.split(list(a), list(b))
        for part in (a, b):
            self.parts[part[0]], self.costs[part[0]] = part, self.ev.cost(part)
        for part in (a, b):
            self._enqueue(part)
        return True


def search_tree(ev: Evaluator, around: list[list[int]], edges: list[Edge], steps: list[list[Dims]] | None = None) -> tuple[Decomposition, Trace]:
    """Merging from singletons and splitting from the whole, in turns on each other's results.

    Each round exhausts merges on one grouping and splits on the other, then swaps them.  It ends
    when they are equal or neither changed; of two, the one that costs less is taken, the one that
    was split last if they cost the same.  steps: takes up the subspaces of each row of the trace.
    """
    steps = [] if steps is None else steps
    a, b, trace = Decomposition.singletons(ev.d), Decomposition.whole(ev.d), []
    turn = 0
    cost_a = cost_b = 0.0
    if a == b:
        steps.append([(0,)])
        return a, [(0, "merge", 0, ev.cost(a.dims(0)))]
    while True:
        merger, splitter = TreeMerger(ev, a, edges), TreeSplitter(ev, b, around)
        for own in (merger, splitter):
            steps.append(list(own.parts.values()))
            while own.step():
                steps.append(list(own.parts.values()))
        trace += [(turn, "merge", k, c) for k, c in enumerate(merger.losses)] + [(turn, "split", k, c) for k, c in enumerate(splitter.losses)]
        moved = len(merger.losses) > 1 or len(splitter.losses) > 1
        a, b = splitter.found, merger.found
        cost_a, cost_b = splitter.losses[-1], merger.losses[-1]
        turn += 1
        if a == b or not moved:
            break
    return (a if a == b or better(cost_a - cost_b, cost_b) else b), trace
