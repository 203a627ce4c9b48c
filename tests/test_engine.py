import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import cost
from vecloom.functions.cost import codewords_of, corrected_of
from vecloom.operators import codebook, contingency, entropy_graph, kmeans1d, partition, ranges, search
from vecloom.operators.decomposition import Decomposition
from vecloom.params import Params
from vecloom.plans import pipelines
from vecloom.sources import sinks, vectors


def blocks_df(spark, blocks):
    return spark.createDataFrame([(v, b) for b, vs in enumerate(blocks) for v in vs], "vec_id int, block_id int")


@pytest.mark.parametrize(("a", "b", "same"), [([[0, 2], [1]], [[1], [2, 0]], True), ([[0, 2], [1]], [[0, 1], [2]], False), ([], [], True)])
def test_equality_ignores_labels(spark, a, b, same):
    assert partition.equal(blocks_df(spark, a), blocks_df(spark, b)).first().is_equal is same


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [([[0, 2], [1]], [[1], [2, 0]], [[0, 2], [1]]), ([[0, 1, 2]], [[1], [0, 2]], [[1], [0, 2]]), ([[0, 2], [1]], [[0], [2, 1]], [[0], [1], [2]]), ([], [], [])],
)
def test_joint(spark, a, b, want):
    got = {}
    for r in partition.joint(blocks_df(spark, a), blocks_df(spark, b)).collect():
        got.setdefault((r.x, r.y), []).append(r.vec_id)
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(v) for v in want)


@pytest.mark.parametrize(("blocks", "h"), [([], 0), ([3], 0), ([1, 1, 1], math.log2(3)), ([2, 1], -2 / 3 * math.log2(2 / 3) - 1 / 3 * math.log2(1 / 3)), ([2, 2], 1)])
def test_entropy(spark, blocks, h):
    got = partition.block_entropy(spark.createDataFrame([(n,) for n in blocks], "n long")).first()
    assert got.h == pytest.approx(h, abs=1e-5) and got.exp_h == pytest.approx(2**h, abs=1e-5)


def brute(x, k):
    x = sorted(x)
    best = math.inf
    for cut in itertools.combinations(range(1, len(x)), k - 1):
        ends = [0, *cut, len(x)]
        best = min(best, sum(float(np.var(x[i:j]) * (j - i)) for i, j in itertools.pairwise(ends)))
    return best


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=9))
def test_curve_is_optimal(x):
    v, n = np.unique(np.array(x, np.float32), return_counts=True)
    got = kmeans1d.curve(v, n, 5)
    assert len(got) == min(5, len(v))
    for k, sse in enumerate(got, 1):
        assert sse == pytest.approx(brute(x, k), abs=1e-6)
        start = kmeans1d.clusters(v, n, k)
        assert len(start) == k and sum(kmeans1d.Intervals(v, n)(start, np.append(start[1:], len(v)) - 1)) == pytest.approx(sse, abs=1e-9)


def test_curve_of_repeated_values():
    v = np.arange(10, dtype=np.float32)
    assert kmeans1d.curve(v, np.full(10, 10), 12).tolist() == pytest.approx([825, 200, 90, 50, 25, 20, 15, 10, 5, 0])


def test_penalised_trades_clusters_for_error():
    v, n = np.arange(10, dtype=np.float32), np.full(10, 10)
    for penalty in (1.0, 30.0, 100.0, 1000.0):
        curve = kmeans1d.curve(v, n, 10) + penalty * np.arange(1, 11)
        assert len(kmeans1d.penalised(v, n, penalty)) == int(curve.argmin()) + 1


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.sampled_from([0.0, 0.5, 3.0, 20.0, 200.0]))
def test_penalised_agrees_with_every_start(x, penalty):
    v, n = np.unique(np.array(x, np.float32), return_counts=True)
    cost, m = kmeans1d.Intervals(v, n), len(v)
    best, back = [0.0], [0]
    for j in range(1, m + 1):
        got = [best[i] + float(cost(np.array([i]), np.array([j - 1]))[0]) + penalty for i in range(j)]
        best.append(min(got)), back.append(got.index(min(got)))
    start = kmeans1d.penalised(v, n, penalty)
    total = float(cost(start, np.append(start[1:], m) - 1).sum()) + penalty * len(start)
    assert start[0] == 0 and total == pytest.approx(best[m], abs=1e-6)


def test_penalised_of_a_million_values():
    x = np.sort(np.random.default_rng(2).normal(size=1_000_000)).astype(np.float32)
    v, n = np.unique(x, return_counts=True)
    start = kmeans1d.penalised(v, n, 20000.0)
    by_count = kmeans1d.curve(v, n, len(start) + 1) + 20000.0 * np.arange(1, len(start) + 2)
    assert int(by_count.argmin()) + 1 == len(start) > 2


def test_bins_keep_their_promise(spark):
    """Ten dimensions of values and repeated values in bins: errors lie between the best and the stated bound."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(4000, 8)), rng.integers(0, 5, (4000, 1)), np.zeros((4000, 1))], 1).astype(np.float32)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>").cache()
    best = {(r.dim, r.k): r.sse for r in kmeans1d.curve_of(kmeans1d.points(v), 6).collect()}
    gaps = []
    for bins in (16, 256):
        rough_, seen = kmeans1d.curve_of(kmeans1d.points(v, exact=100, bins=bins), 6).collect(), set()
        for r in rough_:
            seen.add((r.dim, r.k))
            assert r.least - 1e-6 <= best[r.dim, r.k] <= r.sse + 1e-6
            if r.dim >= 8:  # a bin for each value: nothing is lost
                assert r.sse == r.least == pytest.approx(best[r.dim, r.k], abs=1e-9)
        assert seen == set(best)
        gaps.append(sum(r.sse - r.least for r in rough_))
    assert 0 < gaps[1] < gaps[0] / 8  # the bound falls with the bins' width
    found = kmeans1d.blocks_of(kmeans1d.points(v, exact=100, bins=256), dict.fromkeys(range(10), 3))
    coded = kmeans1d.codes(v, found).collect()
    want = {(r.dim, r.block_id): r.n for r in found.collect()}
    got = {}
    for r in coded:
        for dim, c in enumerate(r.codes):
            got[dim, c] = got.get((dim, c), 0) + 1
    assert got == want and len(coded) == 4000


def test_codes_of_many_clusters(spark):
    """A thousand dimensions of a thousand clusters are planned and assigned."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1000, (50, 1000)).astype(np.float32)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    grid = spark.range(1000).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("block_id"), F.col("id").cast("int").alias("dim"))
    found = grid.select("dim", "block_id", (F.col("block_id") - 0.5).cast("float").alias("lo"))
    got = {r.vec_id: r.codes for r in kmeans1d.codes(v, found).collect()}
    assert all(got[i] == x[i].astype(int).tolist() for i in range(50))


def test_running_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), int(o), k, int(v)) for k, (g, o, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), rng.integers(0, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, o int, k int, v long").repartition(7)
    for by in (None, "g"):
        got = {r.k: r.before for r in ranges.running(df, [F.desc("o"), F.col("k").asc()], {"before": F.col("v")}, by).collect()}
        total = {}
        for g, o, k, v in sorted(rows, key=lambda r: (-r[1], r[2])):
            assert got[k] == total.get(g if by else 0, 0)
            total[g if by else 0] = got[k] + v


def test_largest_blocks_of_equal_sizes(spark):
    """More blocks of one size than codewords, and subspaces with fewer blocks than codewords."""
    words = [(s, [s], 5, [k], size) for s, sizes in enumerate([[1] * 50, [9, 1, 1, 1, 1, 1, 1, 1], [4, 3]]) for k, size in enumerate(sizes)]
    df = spark.createDataFrame(words, "subspace_id int, dims array<int>, num_codewords int, key array<int>, block_size long").repartition(5)
    got = {(r.subspace_id, r.code_id): (r.key[0], r.block_size) for r in codebook.ranks(df).where("code_id < num_codewords").collect()}
    want = {}
    for s in range(3):
        for c, (size, k) in enumerate(sorted((-w[4], w[3][0]) for w in words if w[0] == s)[:5]):
            want[s, c] = (k, -size)
    assert got == want


def heap_allocation(curves, budget, true_n):
    import heapq

    k = dict.fromkeys(curves, 1)
    bits = lambda c: true_n * math.log2(c) + 32 * c

    def head(d):
        c = k[d]
        return (-(curves[d][c - 1] - curves[d][c]) / (bits(c + 1) - bits(c)), -d)

    heap = [head(d) for d in curves]  # no curve has only one entry
    heapq.heapify(heap)
    while sum(curves[d][k[d] - 1] for d in curves) > budget:
        d = -heapq.heappop(heap)[1]
        k[d] += 1
        if k[d] < len(curves[d]):
            heapq.heappush(heap, head(d))
    return k


def test_allocation_agrees_with_a_heap(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        curves = {d: np.sort(rng.integers(0, 30, 8).astype(float))[::-1] for d in range(5)}
        rows = [(d, k + 1, float(s)) for d, c in curves.items() for k, s in enumerate(c)]
        budget = sum(c[2] for c in curves.values()) + 0.5
        got = kmeans1d.allocation(spark.createDataFrame(rows, "dim int, k int, sse double"), budget, 1000).collect()
        assert {r.dim: r.k for r in got} == heap_allocation(curves, budget, 1000)


@pytest.fixture(scope="module")
def repeat(spark):
    return vectors.from_rows(spark, [[r % 10] * 10 for r in range(100)]).cache()


@pytest.mark.parametrize(("target", "ks"), [(80, [1] * 9 + [2]), (30, [1] + [2] * 9), (21, [2] * 10), (1e-6, [10] * 10)])
def test_allocation_goldens(repeat, target, ks):
    got = pipelines.shared_budget(repeat, Params(40000, target))
    assert [got[i] for i in range(10)] == ks


@pytest.mark.parametrize(("budgets", "target", "drawn"), [(pipelines.shared_budget, 21, [4]), (pipelines.shared_budget, 1e-6, [4, 8, 16]), (pipelines.equal_budgets, 21, [4]), (pipelines.equal_budgets, 1e-6, [4, 8, 16])])
def test_curves_are_as_long_as_they_are_needed(repeat, monkeypatch, budgets, target, drawn):
    lengths, plain = [], kmeans1d.curve_of
    monkeypatch.setattr(kmeans1d, "curve_of", lambda found, most: lengths.append(most) or plain(found, most))
    ks = budgets(repeat, Params(40000, target))
    assert lengths == drawn and set(ks.values()) == {2 if target == 21 else 10}


@pytest.mark.parametrize("fit", [pipelines.fit_allpairs, pipelines.fit_tree])
def test_codebook_goldens(repeat, fit):
    m = fit(repeat, Params(40000, 30))
    words = {(r.subspace_id, tuple(r.codeword)) for r in m.codebook.collect()}
    assert words == {(0, (4.5,)), (1, (2.0,) * 9), (1, (7.0,) * 9)}
    m = fit(repeat, Params(40000, 1e-6))
    assert {tuple(r.codeword) for r in m.codebook.collect()} == {(float(c),) * 10 for c in range(10)}
    assert len(codebook.nested(m.codebook).first().codewords) == 10


def test_constant_columns_stay_apart(spark):
    flat = vectors.from_rows(spark, [[float(i) for i in range(10)]] * 20)
    for fit in (pipelines.fit_allpairs, pipelines.fit_tree):
        assert fit(flat, Params(1000, 0.5)).decomposition == Decomposition.singletons(10)


def test_recommend(repeat):
    assert [tuple(r) for r in pipelines.recommend(repeat, Params(40000, 21)).summary.collect()] == [(0, list(range(10)), 2)]


@pytest.mark.parametrize(
    ("cap", "edges"),
    [(4, "0-1 0-7 0-8 0-9 1-2 2-3 3-4 4-5 5-6"), (3, "0-1 0-8 0-9 1-2 2-3 3-4 4-5 5-6 6-7"), (2, "0-1 0-9 1-2 2-3 3-4 4-5 5-6 6-7 7-8")],
)
def test_degree_cap(cap, edges):
    got = entropy_graph.edge_list(entropy_graph.cap_degrees([list(range(1, 10)), *[[0]] * 9], cap))
    assert " ".join(f"{i}-{j}" for i, j in got) == edges


class Counted(search.Evaluator):
    """Evaluates sets by counting rows in NumPy."""

    def look(self, plan):
        if not hasattr(self, "matrix"):
            self.matrix = np.array([r.codes for r in self.coded.collect() for _ in range(r.n)])
        for r in plan:
            if r.dims not in self.known:
                _, n = np.unique(self.matrix[:, list(r.dims)], axis=0, return_counts=True)
                self.known[r.dims] = round(float(-(n / n.sum() * np.log2(n / n.sum())).sum()), 12) + 0.0, len(n)


def rough(seed, n=200):
    """Codes of seven dimensions, some of which share much."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 4, (n, 3))
    return np.concatenate([base, base[:, :2] ^ (rng.random((n, 2)) < 0.1), rng.integers(0, 3, (n, 2))], 1)


def coded_df(spark, codes):
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes.tolist())], "vec_id long, codes array<int>")


@pytest.mark.parametrize("lookahead", [0, 1 << 25])
def test_search_agrees_with_counting(spark, monkeypatch, lookahead):
    monkeypatch.setattr(search, "LOOKAHEAD", lookahead)
    coded = coded_df(spark, rough(3))
    found = [search.merge_all_pairs(kind(coded, 5000)) for kind in (Counted, search.Evaluator)]
    assert found[0][0] == found[1][0]
    costs = [c for *_, c in found[1][1]]
    assert all(b < a for a, b in itertools.pairwise(costs)) and costs == pytest.approx([c for *_, c in found[0][1]])
    around = entropy_graph.dimension_tree(coded, 7, None)
    edges = entropy_graph.edge_list(around)
    trees = [search.search_tree(kind(coded, 5000), around, edges) for kind in (Counted, search.Evaluator)]
    assert trees[0][0] == trees[1][0] and len(edges) == 6
    assert [x[:3] for x in trees[0][1]] == [x[:3] for x in trees[1][1]]


def plain_merging(coded, true_n):
    """The same search by trying all pairs at every step."""
    ev = Counted(coded, true_n)
    parts = [(i,) for i in range(ev.d)]
    cost = lambda s: (ev.look([contingency.recipe(s)]), ev.cost(s))[1]
    while True:
        pairs = [(cost(contingency.union(a, b)) - cost(a) - cost(b), a[0], b[0], a, b) for a, b in itertools.combinations(sorted(parts), 2)]
        delta, _, _, a, b = min(pairs, default=(0, 0, 0, (0,), (0,)))
        if not pairs or not search.better(delta, cost(a) + cost(b)):
            return sorted(parts)
        parts = [p for p in parts if p not in (a, b)] + [contingency.union(a, b)]


@pytest.mark.parametrize("seed", range(4))
def test_heap_takes_what_trying_all_takes(spark, seed):
    coded = coded_df(spark, rough(seed, 60))
    found = search.merge_all_pairs(Counted(coded, 3000))[0]
    assert [tuple(found.dims(s)) for s in found.subspaces()] == plain_merging(coded, 3000)


@pytest.mark.parametrize("tree", [[(0, i) for i in range(1, 7)], [(i, i + 1) for i in range(6)], [(3, 0), (3, 1), (1, 2), (1, 6), (6, 5), (0, 4)]])
def test_cuts_of_any_tree(spark, tree):
    """Both sides of every edge, each an addition or a subtraction away."""
    around = [[] for _ in range(7)]
    for a, b in tree:
        around[a].append(b), around[b].append(a)
    coded = coded_df(spark, rough(9))
    ev, plain = search.Evaluator(coded, 5000), Counted(coded, 5000)
    splitter = search.TreeSplitter(ev, Decomposition.whole(7), around)
    assert len(splitter.queue) == 6 and sum(len(r.plus) + len(r.minus) for r in splitter.plan(tuple(range(7)))) <= 4 * 7
    for delta, _, own, a, b in splitter.queue:
        assert sorted(a + b) == list(own) and any({x, y} & set(a) and {x, y} & set(b) for x, y in tree)
        assert delta == pytest.approx(plain.cost(a) + plain.cost(b) - plain.cost(own))


def test_contingency_of_sparse_and_weighted_codes(spark, monkeypatch):
    """Many codes, several chunks, repeated rows: sizes of blocks are those of counting."""
    monkeypatch.setattr(contingency, "CELLS", 90)
    rng = np.random.default_rng(4)
    codes = rng.integers(0, [40, 3, 200], (300, 3))
    coded = coded_df(spark, codes).groupBy("codes").agg(F.count(F.lit(1)).alias("n"))
    sets = [(0,), (0, 1), (0, 2), (0, 1, 2), (1, 2)]
    got = {s: [] for s in sets}
    for r in contingency.block_sizes(coded, [contingency.recipe(s) for s in sets]).collect():
        got[sets[r.set_id]].append(r.n)
    for s in sets:
        assert sorted(got[s]) == sorted(np.unique(codes[:, list(s)], axis=0, return_counts=True)[1].tolist())
    assert contingency.entropies(coded.where("n < 0"), [contingency.recipe((0,))], 1).count() == 0
    for s, own in zip([(2, 0), (1,)], (codes[:, [2, 0]], codes[:, [1]]), strict=True):
        kinds, n = np.unique(own, axis=0, return_counts=True)
        assert {(tuple(r.key), r.n) for r in partition.joint_blocks(coded, s).collect()} == set(zip(map(tuple, kinds.tolist()), n.tolist(), strict=True))


def crowded(kind):
    """3000 rows of twelve codes: all of few values, half in one block of most dimensions, or also large and negative codes."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 3, (3000, 12))
    if kind == "hot":
        codes[::2, :9] = 1
    if kind == "odd":
        codes[:, 3] = rng.integers(-2, 3, 3000)
        codes[:, 7] = rng.integers(0, 2, 3000) * 70000
    return np.concatenate([codes, codes[:40]])


@pytest.mark.parametrize("kind", ["even", "hot", "odd"])
@pytest.mark.parametrize("cells", [12 * 40, 12 * 700, 1 << 21])
def test_wide_sets_are_counted_by_cores(spark, monkeypatch, kind, cells):
    """Blocks that lie within a range, go on in another or fill several: sizes are those of counting."""
    monkeypatch.setattr(contingency, "CELLS", cells)
    monkeypatch.setattr(contingency, "CORE", 16)
    codes = crowded(kind)
    coded = coded_df(spark, codes).groupBy("codes").agg(F.count(F.lit(1)).alias("n"))
    bits = search.Evaluator(coded_df(spark, codes), 5000)
    shape = contingency.Shape(coded.count(), int(codes.min()), int(codes.max()), tuple(bits.entropy((i,)) for i in range(12)))
    sets = [tuple(range(k)) for k in range(6, 13)] + [tuple(range(k, 12)) for k in range(1, 5)] + [(0, 2, 4, 5, 6, 8, 9, 11)]
    plan = [contingency.recipe(s) for s in sets] + [contingency.Recipe(tuple(range(2, 12)), (tuple(range(12)),), ((0, 1),))]
    plan.insert(0, contingency.recipe((0, 1)))
    wanted = list(range(1, len(plan)))
    cores = shape.cores([plan[k].dims for k in wanted])
    assert sorted(k for _, of in cores for k in of) == list(range(len(wanted))) and 1 < len(cores) < len(wanted)
    assert all(set(core) <= set(plan[wanted[k]].dims) for core, of in cores for k in of)
    got = {k: {} for k in wanted}
    rows = contingency.core_sizes(coded, plan, wanted, shape).collect()
    for r in rows:
        got[r.set_id][r.n] = got[r.set_id].get(r.n, 0) + r.many
    for k in wanted:
        _, n = np.unique(codes[:, list(plan[k].dims)], axis=0, return_counts=True)
        assert got[k] == dict(zip(*map(np.ndarray.tolist, np.unique(n, return_counts=True)), strict=True))


def test_search_hands_on_no_row_for_each_vector_and_set(spark, monkeypatch):
    """In a table of more than a chunk, sets of many blocks don't go through a shuffle of their blocks."""
    monkeypatch.setattr(contingency, "CELLS", 12 * 700)
    asked, plain = [], contingency.block_sizes
    monkeypatch.setattr(contingency, "block_sizes", lambda coded, recipes, wanted=None: asked.extend(recipes[k].dims for k in (range(len(recipes)) if wanted is None else wanted)) or plain(coded, recipes, wanted))
    coded = coded_df(spark, crowded("even"))
    around = [[j for j in (i - 1, i + 1) if 0 <= j < 12] for i in range(12)]
    trees = [search.search_tree(kind(coded, 5000), around, entropy_graph.edge_list(around)) for kind in (Counted, search.Evaluator)]
    assert trees[0][0] == trees[1][0] and [x[:3] for x in trees[0][1]] == [x[:3] for x in trees[1][1]]
    assert [c for *_, c in trees[0][1]] == pytest.approx([c for *_, c in trees[1][1]])
    assert asked and max(map(len, asked)) < 6


def test_decomposition_rules():
    d = Decomposition.singletons(5)
    assert d.merge(4, 2) == 2 and d.dims(2) == [2, 4] and d.together(2, 4)
    assert d.splits([4], [2]) and not d.splits([4], [2, 4]) and not d.splits([2], [3])
    assert d.split([4], [2]) == (4, 2) and d == Decomposition.singletons(5)


def test_correction_and_codewords():
    assert corrected_of(3.0, 8.0, 100, 100) == pytest.approx(3.0)
    assert corrected_of(2.0, 8.0, 10, 100) == pytest.approx(4.0)
    assert corrected_of(2.0000000000000004, 2.0, 10, 100) == pytest.approx(2.0)
    assert codewords_of(3.0000000000001, 100) == 8 and codewords_of(3.1, 10) == 10 and codewords_of(0.0, 1) == 1


def test_correction_of_more_vectors_than_said(spark):
    """The same number from columns and from plain numbers on either side of true_n, and a search to its end."""
    for n in (1, 10, 99, 100, 101, 60_000):
        column = spark.range(1).select(cost.corrected(F.lit(3.0), F.lit(8.0), n, 100)).first()[0]
        assert corrected_of(3.0, 8.0, n, 100) == pytest.approx(column)
    assert corrected_of(3.0, 8.0, 10_000, 100) == pytest.approx(9 / 8)
    codes = rough(5, 60)
    found = [search.merge_all_pairs(kind(coded_df(spark, codes), 40, correct=True)) for kind in (Counted, search.Evaluator)]
    assert found[0][0] == found[1][0] and [c for *_, c in found[0][1]] == pytest.approx([c for *_, c in found[1][1]])


def test_correction_uses_numbers_of_blocks(spark):
    """Blocks of 6/2/2 and 8/2 of ten vectors, extrapolated to 100: each dimension alone, and both."""
    codes = [(a, b) for a, b in zip([0] * 6 + [1] * 2 + [2] * 2, [0] * 8 + [1] * 2, strict=True)]
    coded = spark.createDataFrame([(i, list(c)) for i, c in enumerate(codes)], "vec_id long, codes array<int>")
    for kind in (Counted, search.Evaluator):
        ev = kind(coded, 100, correct=True)
        h = [-sum(p * math.log2(p) for p in ps) for ps in ((0.6, 0.2, 0.2), (0.8, 0.2), (0.6, 0.2, 0.2))]
        for dims, e, product in (((0,), h[0], 3), ((1,), h[1], 2), ((0, 1), h[2], 6)):
            assert ev.clusters(dims) == pytest.approx(math.sqrt(2**e * product))
        assert [round(ev.clusters(d), 2) for d in ((0,), (1,), (0, 1))] == [2.79, 1.82, 3.94]
        ev.close()


def test_repeated_ids_count_each(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 2.0]), (2, [9.0, 1.0])], "vec_id long, embedding array<float>")
    coded = rows.select("vec_id", "embedding", F.transform("embedding", lambda x: (x > 5).cast("int")).alias("codes"))
    subspaces = spark.createDataFrame([(0, [0, 1], 4)], codebook.SUMMARY)
    got = {(tuple(r.codeword), r.block_size) for r in codebook.centroids(coded, subspaces).collect()}
    assert got == {((0.0, 1.0), 2), ((9.0, 1.0), 1)}


@pytest.mark.parametrize("odd", [None, [1.0, None], [1.0, float("nan")], [1.0]])
def test_odd_vectors_are_refused(spark, odd):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 3.0]), (2, odd)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        pipelines.fit_allpairs(rows, Params(100, 1))


def test_csv_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,1\n2,2\n")
    (tmp_path / "b.csv").write_text("".join(f"{i},{i}\n" for i in range(3, 400)))
    (tmp_path / "c.csv").write_text("400,400")
    got = vectors.read_csv(spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.embedding[0]) for r in got] == [(i, i + 1.0) for i in range(400)]


def test_command_line(spark, tmp_path, capsys):
    from vecloom.__main__ import main

    (tmp_path / "v.csv").write_text("\n".join(",".join([str(r % 10)] * 10) for r in range(100)))
    main([str(tmp_path / "v.csv"), "40000", "30", "--fit", "hybrid", "--out", str(tmp_path / "out")])
    text = capsys.readouterr().out.splitlines()
    assert text[:3] == ["Data size: 1000", "Number of vectors: 100", "Dimensionality: 10"]
    assert "Dimensions: 1 2 3 4 5 6 7 8 9" in text and "Number of codewords: 2" in text
    assert spark.read.text(str(tmp_path / "out" / "report")).count() == 7 and spark.read.parquet(str(tmp_path / "out" / "trace")).count() > 1


def test_csv_round_trip_and_ragged_lines(spark, tmp_path):
    (tmp_path / "v.csv").write_text("".join(f"{i},{i * 2}.5\n" for i in range(50)))
    got = sorted(vectors.read_csv(spark, str(tmp_path / "v.csv")).collect())
    assert [(r.vec_id, list(r.embedding)) for r in got] == [(i, [float(i), i * 2 + 0.5]) for i in range(50)]
    back = vectors.from_components(vectors.components(vectors.read_csv(spark, str(tmp_path / "v.csv"))))
    assert sorted(back.collect()) == got
    (tmp_path / "r.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="ragged"):
        vectors.read_csv(spark, str(tmp_path / "r.csv")).collect()


def test_reports(repeat, tmp_path):
    m = pipelines.fit_allpairs(repeat, Params(40000, 30))
    sinks.write_text(sinks.codebook_lines(m.codebook), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text[:3] == ["Subspace 0:", "Dimensions: 0", "4.5"] and len(text) == 7
    assert sinks.summary_lines(m.summary).count() == 6


@pytest.mark.parametrize("bad", [{"true_n": 0, "target": 1}, {"true_n": 5, "target": 0}, {"true_n": 5, "target": 1, "margin": 1}, {"true_n": 5, "target": 1, "max_degree": 1}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_entry_has_its_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
