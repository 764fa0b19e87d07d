import tracemalloc
from time import thread_time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.operators import spmv, stats
from vertexloom.operators.graph import degrees, from_arrays, symmetrised
from vertexloom.operators.orders import banded, burning, communities, greedy, simple
from vertexloom.plans import workflow
from vertexloom.sources.generators import random_graph, rmat

ORDERS = {
    "identity": simple.identity, "random": lambda g: simple.random_order(g, 3), "degree": simple.degree_order, "dbg": simple.grouped_order, "banded": banded.banded, "merged": communities.merged,
    "merged_in_rounds": communities.merged_in_rounds, "burned": lambda g: burning.burned(g, 0.2), "sliding": greedy.sliding, "tiled": lambda g: greedy.tiled(g, 64, 20),
    "batch": lambda g: greedy.batch_greedy(g, 16, 2), "batch_refined": lambda g: greedy.batch_greedy_refined(g, 16, 2, 5, "row", None), "block": lambda g: greedy.block_refined(g, 16, 3, 100),
    "growing": lambda g: greedy.growing(g, 32, refine_from=0, inner_hub=100), "blocks": lambda g: simple.block_shuffle(g, 0.5, 8, 1), "swaps": lambda g: simple.perturbed(g, 0.3, 2, 20)[1],
}


@pytest.fixture(scope="module")
def small(spark):
    g = random_graph(spark, 60, 240, 4)
    return g.with_edges(g.edges.cache())


@pytest.mark.parametrize("name", ORDERS)
def test_orders_are_bijections_and_keep_the_product(small, name):
    perm = workflow.written(ORDERS[name](small), "perm")
    assert stats.is_permutation(perm, small.n).first()["ok"] and stats.is_permutation(perm, small.n, "old_id").first()["ok"]
    back = spmv.unpermuted(spmv.multiply(simple.relabel(small, perm)), perm)
    assert spmv.difference(spmv.multiply(small), back).first().asDict() == {"mismatched": 0, "total_difference": 0.0}


def test_mismatches_are_found(spark):
    x, y = (spark.createDataFrame(v, "idx int, val double") for v in ([(0, 1.0), (1, 2.0), (2, 0.0)], [(0, 1.00001), (1, 2.5)]))
    assert spmv.difference(x, y).first().asDict() == {"mismatched": 1, "total_difference": 0.5}


def test_random_order_is_seeded(small):
    one, two, other = ([tuple(r) for r in simple.random_order(small, s).orderBy("old_id").collect()] for s in (1, 1, 2))
    assert one == two != other


def test_schedule_of_growing_batches():
    steps = greedy.growing_steps(5000, 1024)
    assert [(s.start, s.size, s.from_place, s.scored) for s in steps] == [
        (0, 32, 0, 32), (32, 32, 0, 64), (64, 64, 0, 128), (128, 128, 0, 256), (256, 256, 0, 512), (512, 512, 0, 1024),
        (1024, 1024, 1024, 1024), (2048, 1024, 2048, 1024), (3072, 1024, 3072, 1024), (4096, 904, 4096, 904),
    ]


def test_batches_against_brute_force(small):
    edges = [(r["row"], r["col"]) for r in small.edges.collect()]
    indeg = np.bincount([c for _, c in edges], minlength=small.n)
    steps = greedy.even_steps(small.n, 20, 1)
    placed, last = [], None
    for s in steps:
        score = indeg if last is None else np.array([sum(1 for v, u in edges if u in last for v2, w2 in edges if v2 == v and w2 == w) for w in range(small.n)])
        last = sorted((w for w in range(small.n) if w not in placed), key=lambda w: (-score[w], w))[: s.size]
        placed += last
    got = greedy.batches(small, steps, "col")
    assert [r["id"] for r in got.orderBy("place").collect()] == placed


def test_many_batches_in_one_worker_are_those_by_joins(spark):
    g = random_graph(spark, 200, 900, 8)
    g = g.with_edges(workflow.written(g.edges.unionByName(g.edges.where("row < 20")), "graph"))
    for steps, *how in ((greedy.growing_steps(200, 25, 8), "col", 8, False), (greedy.even_steps(200, 25, 2), "id", None, True)):
        one, two = ({r["id"]: (r["batch"], r["place"]) for r in greedy.batches(g, steps, *how, in_worker=m).collect()} for m in (greedy.IN_WORKER, 0))
        assert len(steps) >= greedy.MANY and one == two


def test_jobs_do_not_follow_the_number_of_batches(spark):
    g = random_graph(spark, 400, 900, 8)
    assert greedy.batches(g, [], "col").count() == 400
    spark.sparkContext.setJobGroup("batches", "")
    try:
        assert greedy.batches(g, greedy.even_steps(400, 4, 1), "col").count() == 400
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("batches")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_order(n, raised, first, width):
    """Vertex by vertex: the largest number of times that the last `width` raise it, then the smallest id."""
    out = [first]
    while len(out) < n:
        seen = [v for u in out[len(out) - min(width, len(out)) :] for v in raised(u)]
        out.append(min((v for v in range(n) if v not in out), key=lambda v: (-seen.count(v), v)))
    return out


@pytest.mark.parametrize("seeds,hub", [("id", 1000), ("row", None)])
def test_refined_batches_against_brute_force(spark, seeds, hub):
    g = random_graph(spark, 300, 1500, 8)
    edges = [(r["row"], r["col"]) for r in g.edges.collect()]
    limit = greedy.hub_limit(g.n) if hub is None else hub
    fan, into = (np.bincount([e[k] for e in edges], minlength=g.n) for k in (0, 1))
    placed = greedy.batches(g, greedy.even_steps(g.n, 100, 1), seeds, by_id=True).collect()
    new = {r["old_id"]: r["new_id"] for r in greedy.batch_greedy_refined(g, 100, 1, 5, seeds, hub).collect()}
    for batch in range(3):
        ids = sorted(r["id"] for r in placed if r["batch"] == batch)
        shared = {v: [ids.index(w) for s, t in edges if t == v and fan[s] < limit for s2, w in edges if s2 == s and w in ids and w != v] for v in ids}
        expected = plain_order(len(ids), lambda u: shared[ids[u]] if into[ids[u]] < limit else [], int(fan[ids].argmax()), 5)
        assert sorted(ids, key=new.get) == [ids[i] for i in expected]


def test_a_large_batch_is_refined_in_few_bytes_an_edge():
    n, m = 10_000, 200_000
    random = np.random.default_rng(5)
    member, source = random.integers(0, n, m), random.integers(0, 3 * n, m)
    pairs = greedy.pairs_of(source, member)
    tracemalloc.start()
    order = greedy.sibling_order(n, 0, np.bincount(member, minlength=n), pairs, 5, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(n)) and peak < 40 * m


def test_lists_of_both_sides_take_the_place_of_their_edges():
    n, m = 1000, 600_000
    row, col = np.random.default_rng(8).integers(0, n, (2, m), dtype=np.int32)
    tracemalloc.start()
    found = greedy.Gathered()
    for at in range(0, m, 10_000):
        found.add(greedy.pairs_of(row[at : at + 10_000], col[at : at + 10_000]))
    pairs = found.taken()
    gathered = tracemalloc.get_traced_memory()[1]
    targets, sources = greedy.both_lists(n, pairs)
    del pairs
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    extra = 4 * 8 * greedy.BLOCK
    assert gathered < 9.5 * m + extra and peak < 12 * m + extra and held < 8.5 * m
    for lists, key, value in ((targets, row, col), (sources, col, row)):
        assert (lists.values == value[np.lexsort((value, key))]).all() and (lists.counts == np.bincount(key, minlength=n)).all()


def test_refining_goes_by_blocks(monkeypatch):
    random = np.random.default_rng(3)
    member, source = random.integers(0, 40, 300), random.integers(0, 90, 300) * 7
    into = np.bincount(member, minlength=40)
    shared = [[int(w) for s in source[member == u] for w in member[source == s] if w != u] for u in range(40)]
    for block in (1, 7, 300, 1000):
        monkeypatch.setattr(greedy, "BLOCK", block)
        found = greedy.Gathered()
        for at in range(0, 300, 40):
            found.add(greedy.pairs_of(source[at : at + 40], member[at : at + 40]))
        assert greedy.sibling_order(40, 3, into, found.taken(), 5, 1000) == plain_order(40, lambda u: shared[u], 3, 5)


def test_sliding_places_siblings_together():
    row, col = np.array([0, 0, 1, 1]), np.array([2, 3, 4, 5])
    order = greedy.sliding_order(6, row, col, 5, 100)
    assert abs(order.index(2) - order.index(3)) <= 2 and abs(order.index(4) - order.index(5)) <= 2


def test_banded_narrows_a_shuffled_path(spark):
    n = 80
    ids = np.random.default_rng(3).permutation(n)
    g = from_arrays(spark, ids[:-1], ids[1:], n)
    assert banded.bandwidth(simple.relabel(g, banded.banded(g))).first()["bandwidth"] == 1


def test_communities_stay_together(spark):
    pairs = [(a + k, b + k) for k in (0, 10) for a in range(5) for b in range(5) if a < b] + [(4, 10)]
    g = from_arrays(spark, [a for a, _ in pairs], [b for _, b in pairs], 15)
    for perm in (communities.merged(g), communities.merged_in_rounds(g)):
        new = {r["old_id"]: r["new_id"] for r in perm.collect()}
        first = sorted(new[i] for i in range(5))
        assert first[-1] - first[0] == 4
    coms = communities.communities_in_rounds(g)
    assert communities.modularity(g, coms).first()["modularity"] > 0.3
    inverse = {r["new_id"]: r["old_id"] for r in communities.merged(g, inverted=True).collect()}
    assert inverse == {r["old_id"]: r["new_id"] for r in communities.merged(g).collect()}


def test_burning_puts_hubs_first_and_leaves_last(spark):
    star = from_arrays(spark, [0] * 9 + [10, 11], list(range(1, 10)) + [11, 12], 13)
    new = {r["old_id"]: r["new_id"] for r in burning.burned(star, 0.08).collect()}
    assert new[0] == 0 and min(new[i] for i in range(1, 10)) > new[11]
    assert [r["id"] for r in burning.hubs_of(degrees(symmetrised(star)), 2).orderBy("turn").collect()] == [0, 11]


def test_local_swaps():
    perm = simple.local_swaps(1000, 0.2, 5, 20, 1)
    assert sorted(perm) == list(range(1000)) and 100 < (perm != np.arange(1000)).sum() <= 400
    assert (simple.local_swaps(50, 0, 0, 0, 1) == np.arange(50)).all()


def test_workflow(spark):
    g = rmat(spark, 6, 4, 2)
    run = workflow.optimise(g, "dbg", None, sampled=False)
    assert run.reordered and run.mismatched == 0 and run.predicted > 0
    assert not workflow.optimise(g, "dbg", 1e9, sampled=False).reordered
    x = g.vertices("idx").withColumn("val", (F.col("idx") % 5).cast("double"))
    assert workflow.optimise(g, "degree", None, sampled=False, x=x).mismatched == 0
    with pytest.raises(ValueError):
        workflow.order(g, "nothing")


def test_generators(spark):
    a, b = rmat(spark, 7, 8, 1), rmat(spark, 7, 8, 1)
    assert a.edges.exceptAll(b.edges).isEmpty() and a.nnz() == 1024
    skew = degrees(rmat(spark, 9, 8, 1)).agg(F.max("deg")).first()[0], degrees(random_graph(spark, 512, 4096)).agg(F.max("deg")).first()[0]
    assert skew[0] > 2 * skew[1]


def test_a_component_of_many_edges_is_merged_in_few_bytes_an_edge():
    n, m = 2000, 60_000
    pairs = np.unique(greedy.pairs_of(*np.random.default_rng(2).integers(0, n, (2, m))))
    row, col = pairs >> 32, pairs & greedy.LOW
    row, col = row[row != col], col[row != col]
    both = np.unique(np.concatenate([greedy.pairs_of(row, col), greedy.pairs_of(col, row)]))
    row, col = both >> 32, (both & greedy.LOW).astype(np.int32)
    tracemalloc.start()
    trees = communities.merge_trees(n, row, col, np.ones(len(row)), float(len(row)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(v for v, _ in communities.walk(*trees)) == list(range(n)) and peak < 50 * len(row)


def test_merging_against_brute_force():
    random = np.random.default_rng(6)
    for n in (1, 5, 30):
        near = {v: {} for v in range(n)}
        for a, b in random.integers(0, n, (3 * n, 2)).tolist():
            if a != b:
                near[a][b] = near[b][a] = near[a].get(b, 0.0) + 1.0
        flat = [(a, b, w) for a in near for b, w in sorted(near[a].items())]
        row, col, weight = (np.array([x[k] for x in flat], t) for k, t in enumerate((np.int64, np.int32, float)))
        total = weight.sum() or 1.0
        strength, children, roots = {v: sum(x.values()) for v, x in near.items()}, {}, []
        for v in sorted(near, key=lambda v: (len(near[v]), v)):
            gains = {u: w - strength[v] * strength[u] / total for u, w in near[v].items()}
            best = min(gains, key=lambda u: (-gains[u], u), default=None)
            if best is None or gains[best] <= 0:
                roots.append(v)
                continue
            children.setdefault(best, []).append(v)
            strength[best] += strength[v]
            for u, w in near.pop(v).items():
                near[u].pop(v)
                if u != best:
                    near[u][best] = near[best][u] = near[best].get(u, 0.0) + w
            near[v] = {}
        assert communities.merge_trees(n, row, col, weight, total) == (children, roots)


@pytest.mark.parametrize("order", [lambda n, row, col: greedy.sliding_order(n, row, col, 5, 35), lambda n, row, col: greedy.tile_order(n, row, col, 448, 64)])
def test_sequential_orders_take_few_bytes_an_edge(order):
    n, m = 2000, 40_000
    row, col = np.random.default_rng(9).integers(0, n, (2, m))
    tracemalloc.start()
    found = order(n, row, col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == list(range(n)) and peak < 60 * m


@pytest.mark.parametrize("order", [lambda n, row, col: greedy.sliding_order(n, row, col, 5, 35), lambda n, row, col: greedy.tile_order(n, row, col, 448, 64)])
def test_sequential_orders_take_little_time(order):
    """A step looks at the paths of its window or tile only: about 0.2 s here."""
    n, m = 5000, 110_000
    row, col = np.random.default_rng(9).integers(0, n, (2, m))
    began = thread_time()
    assert sorted(order(n, row, col)) == list(range(n)) and thread_time() - began < 3


def test_sliding_against_brute_force():
    random = np.random.default_rng(4)
    for n, hub in ((1, 3), (12, 3), (40, 4), (40, 100)):
        edges = random.integers(0, n, (3 * n, 2)).tolist()
        targets, sources = ([sorted(e[1 - k] for e in edges if e[k] == v) for v in range(n)] for k in (0, 1))
        raised = lambda u: (targets[u] if len(targets[u]) < hub else []) + [x for w in sources[u] for x in [w, *(v for v in targets[w] if v != u and len(targets[w]) < hub)]]
        first = max(range(n), key=lambda v: (len(sources[v]), -v))
        assert greedy.sliding_order(n, *np.array(edges).T, 3, hub) == plain_order(n, raised, first, 3)


def test_tiles_against_brute_force():
    random = np.random.default_rng(7)
    for n, slots, hub in ((1, 4, 3), (12, 8, 5), (40, 20, 5), (40, 7, 100), (40, 2, 100)):
        edges = random.integers(0, n, (3 * n, 2)).tolist()
        targets, sources = ([sorted(e[1 - k] for e in edges if e[k] == v) for v in range(n)] for k in (0, 1))
        # slots of a tile hold the sources of its vertices one after the other
        out, filled, score, begin = [], [], [0] * n, 0
        for _ in range(n):
            u = min((v for v in range(n) if v not in out), key=lambda v: (-score[v], -len(sources[v]) if not out else 0, v))
            out.append(u)
            filled += sources[u]
            if len(filled) - begin >= slots:
                begin, score = len(filled) // slots * slots, [0] * n
            for w in filled[max(begin, len(filled) - len(sources[u])) :]:
                for v in targets[w] if len(targets[w]) < hub else []:
                    score[v] += 1
        assert greedy.tile_order(n, *np.array(edges).T, slots, hub) == out


def test_growing_keeps_its_batches(spark):
    """Refined or not, a batch fills the same places, and the steps are in one worker."""
    g = random_graph(spark, 300, 1200, 6)
    steps = greedy.growing_steps(300, 32)
    batch = {r["id"]: r["batch"] for r in greedy.batches(g, steps, "col", 10_000, in_worker=0).collect()}
    spark.sparkContext.setJobGroup("growing", "")
    try:
        found = {r["old_id"]: r["new_id"] for r in greedy.growing(g, 32, refine_from=3).collect()}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("growing")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(steps) >= greedy.MANY and all(steps[batch[v]].start <= p < steps[batch[v]].start + steps[batch[v]].size for v, p in found.items()) and len(found) == 300


def test_the_worker_of_all_edges_holds_them_once():
    n, m = 1000, 600_000
    row, col = np.random.default_rng(2).integers(0, n, (2, m), dtype=np.int32)
    row[5] = col[5] = -1  # the row beside the edges
    batches = [pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]) for x in (row, col)], names=["row", "col"]) for at in range(0, m, 10_000)]
    expected = np.delete(greedy.pairs_of(row, col), 5)
    tracemalloc.start()
    pairs = greedy.edge_pairs(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (pairs == expected).all() and peak < 9.5 * m + 4 * 8 * greedy.BLOCK
