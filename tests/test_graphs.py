"""Literal graph fixtures with known answers."""

import random

import numpy as np
import pytest

from cutgrove.operators import defects, graphs, multicut
from cutgrove.operators.components import components, contract

F1 = [(0, 1, 5.0), (0, 3, -20.0), (1, 2, 5.0), (1, 4, 5.0), (2, 5, -20.0), (3, 4, 5.0), (4, 5, 5.0)]
K5 = [(0, 1, 10.0), (0, 2, -1.0), (0, 3, -1.0), (0, 4, -1.0), (1, 2, 10.0), (1, 3, -1.0), (1, 4, 4.0), (2, 3, -1.0), (2, 4, -1.0), (3, 4, 10.0)]


def groups(labels):
    out = {}
    for a, k in labels.items():
        out.setdefault(k, set()).add(a)
    return sorted(map(sorted, out.values()))


def test_multicut_solvers_reach_the_optimum():
    for labels in (multicut.gaec(F1), multicut.kernighan_lin(F1, multicut.gaec(F1)), multicut.brute_force(F1)):
        assert groups(labels) == [[0, 1, 2], [3, 4, 5]]
        assert multicut.cut_energy(F1, labels) == -35
    kl = multicut.kernighan_lin(K5, multicut.gaec(K5))
    assert groups(kl) == [[0, 1, 2], [3, 4]] and multicut.cut_energy(K5, kl) == -1


def test_lifted_edges_do_not_connect():
    local_pairs = {(0, 1), (0, 3), (1, 2), (1, 4), (3, 4)}
    local, lifted = [e for e in K5 if e[:2] in local_pairs], [e for e in K5 if e[:2] not in local_pairs]
    best = multicut.brute_force(local, lifted)
    assert groups(best) == [[0, 1, 2], [3, 4]] and multicut.cut_energy(K5, best) == -1
    for labels in (multicut.gaec(local, lifted), multicut.kernighan_lin(local, multicut.gaec(local, lifted), lifted)):
        assert multicut.connected_labels(local, labels) == {a: min(b for b in labels if labels[b] == k) for a, k in labels.items()}


def test_fusion_is_never_worse():
    a, b = multicut.gaec(K5), {i: i for i in range(5)}
    fused = multicut.fuse(K5, a, b)
    assert multicut.cut_energy(K5, fused) <= min(multicut.cut_energy(K5, a), multicut.cut_energy(K5, b))


def test_distributed_solve(spark):
    far = [(u + 10, v + 10, c) for u, v, c in F1]
    df = spark.createDataFrame(F1 + far + [(5, 10, -3.0)], "u long, v long, cost double")
    labels = {r.node: r.label for r in multicut.solve(df).collect()}
    assert groups(labels) == [[0, 1, 2], [3, 4, 5], [10, 11, 12], [13, 14, 15]]


def test_components(spark):
    e = spark.createDataFrame([(0, 1), (2, 3), (3, 4), (5, 6), (5, 7), (6, 8), (7, 8), (9, 9), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9}
    chain = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(e.limit(0)).count() == 0


def test_contraction_against_union_find():
    r = np.random.default_rng(4)
    for n in (1, 5, 50, 400):
        for _ in range(20):
            a, b = r.integers(0, n, (2, r.integers(1, 2 * n + 1)))
            low = {x: x for x in {*a.tolist(), *b.tolist()}}
            for _ in low:
                for x, y in zip(a.tolist(), b.tolist()):
                    low[x] = low[y] = min(low[x], low[y])
            got = dict(zip(*(x.tolist() for x in contract(a, b))))
            assert got == {x: k for x, k in low.items() if x != k}


def test_components_by_rounds(spark, monkeypatch):
    """More edges than one task takes: hubs, a chain in random order and random pairs."""
    from cutgrove.operators import components as module

    r = random.Random(6)
    ids = list(range(600))
    r.shuffle(ids)
    pairs = [(ids[i], ids[i + 1]) for i in range(599) if i % 97] + [(5000, 1000 + i) for i in range(500)] + [(r.randrange(6000, 6400), r.randrange(6000, 6400)) for _ in range(250)]
    e = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    want = {x.node: x.component for x in components(e).collect()}
    monkeypatch.setattr(module, "GROUP_EDGES", 64)
    assert {x.node: x.component for x in components(e).collect()} == want
    parent = {a: a for p in pairs for a in p}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert want == {a: root(a) for a in parent}


def test_components_of_strings(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y"), ("x", "z"), ("q", "q")], "a string, b string")
    assert {x.node: x.component for x in components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "q": "q"}


def test_components_with_hubs(spark):
    r = random.Random(3)
    pairs = [(500, i) for i in range(0, 900, 3)] + [(1, i) for i in range(1, 900, 3)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(300)]
    low = {}
    find = lambda x: x if low.setdefault(x, x) == x else find(low[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == {x: find(x) for x in list(low)}


def test_bridges_and_cut_vertices():
    found, cuts = graphs.lowlink([(0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (4, 6), (5, 6)])
    assert found == [(0, 1), (0, 2), (1, 3)] and cuts == [0, 1, 2]
    assert graphs.lowlink([(0, 1), (0, 2), (1, 3), (2, 5), (4, 6), (5, 6)])[0] == [(0, 1), (0, 2), (1, 3), (2, 5), (4, 6), (5, 6)]


def test_max_flow():
    value, flows = graphs.max_flow([(0, 1, 20), (0, 2, 15), (1, 3, 10), (2, 4, 5), (3, 4, 5), (3, 5, 8), (4, 5, 10)], 0, 5)
    assert value == 15 and sum(flows[:2]) == 15 and sum(flows[5:]) == 15


def test_spanning_forest_weight(spark):
    df = spark.createDataFrame(F1, "u long, v long, cost double")
    assert graphs.minimum_spanning_forest(df).agg({"cost": "sum"}).first()[0] == -25
    without = df.filter("not (u = 0 and v = 3)")
    assert graphs.minimum_spanning_forest(without).agg({"cost": "sum"}).first()[0] == 0


def test_lifting_a_ring(spark):
    ring = spark.range(10).selectExpr("least(id, (id + 1) % 10) u", "greatest(id, (id + 1) % 10) v")
    for lower, upper in ((1, 2), (1, 4), (2, 3)):
        got = {(r.u, r.v) for r in graphs.k_hop(ring, upper, lower).collect()}
        assert got == {(a, b) for a in range(10) for b in range(a + 1, 10) if lower < min(b - a, 10 - b + a) <= upper}
    valued = graphs.lifted_distances(ring.selectExpr("u", "v", "2 cost"), 4).collect()
    assert all(r.cost == 2 * min(r.v - r.u, 10 - r.v + r.u) for r in valued) and len(valued) == 40


def test_grid_path_prefers_cheap_voxels():
    cost = {(x, y, 0): 10.0 if x == 1 and y < 2 else 1.0 for x in range(3) for y in range(3)}
    assert graphs.grid_path(cost, (0, 0, 0), (2, 0, 0)) == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 2, 0), (2, 2, 0), (2, 1, 0), (2, 0, 0)]
    assert graphs.grid_path({(0, 0, 0): 1.0, (5, 5, 5): 1.0}, (0, 0, 0), (5, 5, 5)) == []


@pytest.mark.parametrize("in_one_task", [True, False])
def test_distances_run_until_nothing_improves(spark, monkeypatch, in_one_task):
    n = 105
    if not in_one_task:
        n = 25
        monkeypatch.setattr(graphs, "SEARCH_EDGES", 0)
    chain = spark.range(n).selectExpr("id u", "id + 1 v")
    assert {r.node: r.dist for r in graphs.distances(chain, 0).collect()} == {i: i for i in range(n + 1)}
    assert {r.node: r.dist for r in graphs.distances(chain, 0, hops=3).collect()} == {i: i for i in range(4)}
    if not in_one_task:
        with pytest.raises(RuntimeError):
            graphs.distances(chain, 0, limit=4)


def test_shortest_paths_against_relaxation(spark):
    r = random.Random(5)
    rows = [(i, i + 1, r.randint(1, 9)) for i in range(20)] + [(r.randint(0, 20), r.randint(0, 20), r.randint(0, 30)) for _ in range(15)]
    got = {x.node: x.dist for x in graphs.distances(spark.createDataFrame(rows, "u long, v long, n long"), 0, cost="n").collect()}
    want = {0: 0} | {i: 10**9 for i in range(1, 21)}
    for _ in range(21):
        for u, v, c in rows:
            want[v] = min(want[v], want[u] + c)
            want[u] = min(want[u], want[v] + c)
    assert got == want


def test_dijkstra_query_reaches_the_whole_graph(spark, monkeypatch):
    from cutgrove.plans import graph_more

    # three objects of two nodes: edges between objects count too
    rows = spark.createDataFrame([(0, 1, 3), (1, 2, 4), (2, 3, 1), (3, 4, 1), (4, 5, 2), (0, 2, 9)], "u long, v long, n long")
    monkeypatch.setattr(graph_more, "edges", lambda s, d: rows)
    monkeypatch.setattr(graph_more, "gt_edges", lambda s, d: rows.filter("u % 2 = 0 and v = u + 1"))
    assert {r.node: r.dist for r in graph_more.QUERIES["gr7_dijkstra"](spark, "").collect()} == {0: 0, 1: 3, 2: 7, 3: 8, 4: 9, 5: 11}


def test_far_pairs_are_pairs_of_nodes_of_the_graph(spark, monkeypatch):
    from cutgrove.plans import graph_more

    # six nodes and eight draws a node: the sample holds all far pairs, of all nodes that there are
    monkeypatch.setattr(graph_more, "edges", lambda s, d: s.createDataFrame([(0, 1, 1), (1, 3, 1), (3, 4, 1), (4, 31, 1)], "u long, v long, n long"))
    monkeypatch.setattr(graph_more, "vox", lambda s, d: s.createDataFrame([(i,) for i in (0, 1, 3, 3, 4, 7, 31)], "seg long"))
    got = sorted(tuple(r) for r in graph_more.QUERIES["jn11_far_pairs"](spark, "").collect())
    assert got == [(0, 4), (0, 7), (0, 31), (1, 7), (1, 31), (3, 7), (4, 7), (7, 31)]


def test_searches_by_joins_and_in_one_task(spark, monkeypatch):
    r = random.Random(9)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(110)) if a != b})
    e = spark.createDataFrame([(u, v, r.randrange(1, 9)) for u, v in pairs], "u long, v long, n long")
    for cost in (None, "n"):
        one = {x.node: x.dist for x in graphs.distances(e, pairs[0][0], cost=cost).collect()}
        target = max(one)
        path = sorted(map(tuple, graphs.shortest_path(e, pairs[0][0], target, cost).collect()))
        monkeypatch.setattr(graphs, "SEARCH_EDGES", 0)
        assert {x.node: x.dist for x in graphs.distances(e, pairs[0][0], cost=cost).collect()} == one
        assert sorted(map(tuple, graphs.shortest_path(e, pairs[0][0], target, cost).collect())) == path
        monkeypatch.undo()
        assert sum(p[3] for p in path) == one[target] and path[0][1] == pairs[0][0] and path[-1][2] == target and all(a[2] == b[1] for a, b in zip(path, path[1:]))
        assert graphs.shortest_path(e, pairs[0][0], 10**6, cost).count() == 0
    two = {x.node: x.dist for x in graphs.distances(e, pairs[0][0], 2).collect()}
    assert two == {k: v for k, v in {x.node: x.dist for x in graphs.distances(e, pairs[0][0]).collect()}.items() if v <= 2}


def test_flows_and_cuts():
    r = random.Random(10)
    for _ in range(60):
        n = r.randrange(2, 9)
        rows = [(r.randrange(n), r.randrange(n), r.randrange(0, 9)) for _ in range(r.randrange(1, 25))]
        rows = [x for x in rows if x[0] != x[1]]
        push, side = graphs.push_relabel(rows, 0, n - 1)
        assert push == graphs.max_flow(rows, 0, n - 1)[0] == sum(c for u, v, c in rows if u in side and v not in side) and n - 1 not in side


def test_slices_to_replace():
    assert defects.run_sources((0,), 9) == [(0, 1)] and defects.run_sources((8,), 9) == [(8, 7)]
    assert defects.run_sources((2, 3, 4), 9) == [(2, 1), (3, 1), (4, 5)] and defects.run_sources((5, 6, 7, 8), 9) == [(5, 4), (6, 4), (7, 4), (8, 4)]
    with pytest.raises(ValueError):
        defects.run_sources((1, 2, 3, 4, 5), 9)
