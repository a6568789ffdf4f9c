"""Shapes that only large tables have, made small."""

import duckdb
import pytest

from cutgrove.plans.registry import ORACLE, QUERIES


def matches_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in df.collect()) and want


@pytest.mark.parametrize("name", ["jn14_block_nodes", "jn14_block_overlaps"])
def test_blocks_that_share_a_number(spark, tmp_path, name):
    """Slices 8,000 on: block (0, 1000) and block (1, 0) both have number 1000."""
    ids = spark.range(2600).selectExpr("case when id < 1000 then id else id + 798400 end event_id", "(id % 37) / 4.0 value")
    ids.write.parquet(f"{tmp_path}/events.parquet")
    matches_sql(spark, name, tmp_path)


def test_channel_values_that_differ_by_their_last_bit(spark, tmp_path):
    """Edges of two faces whose means are one bit apart: moments are those of the SQL, whatever that bit makes of them."""
    seg = lambda x, y, z: z * 6 + min(2, (x + (y + z) % 3) // 4) + 3 * (y // 5)
    faces: dict = {}
    for i in range(1100):
        x, y, z = i % 10, i // 10 % 10, i // 100
        if z < 10 and seg(x, y, z) != seg(x, y, z + 1):
            faces.setdefault((seg(x, y, z), seg(x, y, z + 1)), []).append(i)
    value = [(i * 7919 % 60_000) / 1000 for i in range(1100)]
    odd = [(351, 15041, 2762, 12630), (94064, 29962, 64430, 59596), (71455, 33589, 83718, 21326), (25280, 78452, 31932, 71800), (53707, 6708, 15992, 44423)]
    used: set = set()
    for first, second in (f for f in faces.values() if len(f) == 2):
        at = {first, first + 100, second, second + 100}
        if odd and not at & used:
            used |= at
            for i, pm in zip((first, first + 100, second, second + 100), odd.pop()):
                value[i] = pm / 1000
    assert not odd
    spark.createDataFrame(list(enumerate(value)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    matches_sql(spark, "ag2_channel_statistics", tmp_path)


def test_long_graphs_are_searched_by_ranges(spark, monkeypatch):
    """A ladder of 600 rungs: hops and costs to its end without a round of joins for every hop, and a path of such costs."""
    from cutgrove.operators import graphs

    rows = [(2 * i, 2 * i + 1, 5) for i in range(600)] + [(a, a + 2, 1 + a * 7 % 4) for a in range(1198)] + [(2000, 2001, 1)]
    df = spark.createDataFrame(rows, "u long, v long, n long")
    both = [*rows, *((v, u, c) for u, v, c in rows)]
    monkeypatch.setattr(graphs, "SEARCH_EDGES", 300)
    monkeypatch.setattr(graphs, "PART_STEPS", 200)
    for source in (0, 601, 5000):
        for cost in (None, "n"):
            want = graphs._search([(u, v, c if cost else 1) for u, v, c in both], source)[0]
            got = graphs.distances(df, source, cost=cost, limit=20)
            assert sorted((r.node, r.dist) for r in got.collect()) == sorted(want.items())
    path = graphs.shortest_path(df, 0, 1199, cost="n").orderBy("seq").collect()
    assert path[0].a == 0 and path[-1].b == 1199 and all(x.b == y.a for x, y in zip(path, path[1:]))
    assert sum(r.cost for r in path) == graphs._search(both, 0)[0][1199]


@pytest.mark.parametrize("far", [False, True])
def test_cluster_heights_by_ranges(spark, monkeypatch, far):
    """No task clusters a whole component beyond HEIGHT_EDGES, and heights are those of the whole; far: ids without order."""
    import random

    from cutgrove.operators import workflows

    r = random.Random(11)
    n = 60 if far else 240
    name = r.sample(range(n), n) if far else list(range(n))
    e = [(i, j) for i in range(n) for j in (i + 1, i + 2, i + 7) if j < n]
    rows = [(min(name[i], name[j]), max(name[i], name[j]), r.randrange(1, 30), r.random()) for i, j in e]
    pairs = [(min(name[i], name[i + 4]), max(name[i], name[i + 4])) for i in range(0, n - 4)]
    df, far_pairs = spark.createDataFrame(rows, "u long, v long, n long, p double"), spark.createDataFrame(pairs, "u long, v long")
    sizes = spark.createDataFrame([(a, r.randrange(1, 40)) for a in range(n)], "seg long, size long")
    by = lambda h: {(x.u, x.v): [getattr(x, c) for c in h.columns[2:]] for x in h.collect()}
    whole = by(workflows.cluster_heights(df, sizes, far_pairs))
    monkeypatch.setattr(workflows, "HEIGHT_EDGES", 20 if far else 150)
    monkeypatch.setattr(workflows, "merge_heights", None)
    ranges = by(workflows.cluster_heights(df, sizes, far_pairs))
    assert whole.keys() == ranges.keys() == set(pairs)
    assert all(ranges[k] == pytest.approx(v) for k, v in whole.items())


def test_kernels_take_blocks_of_whole_parts(spark, monkeypatch):
    """Beyond WHOLE_EDGES no kernel but greedy contraction gets the whole problem, and no solver is worse than contraction."""
    import random

    from cutgrove.operators import multicut, proposals

    r = random.Random(7)
    e = [(i, j, round(r.gauss(0.2, 1), 3)) for i in range(300) for j in (i + 1, i + 2, i + 7) if j < 300]
    f = [(i, i + 4, round(r.gauss(0, 1), 3)) for i in range(0, 290, 5)]
    for name, bound in (("WHOLE_EDGES", 200), ("PART_EDGES", 100), ("RANGE_EDGES", 250)):
        monkeypatch.setattr(multicut, name, bound)
    schema = "u long, v long, cost double"
    df, far = spark.createDataFrame(e, schema), spark.createDataFrame(f, schema)
    greedy = {x.node: x.label for x in multicut.greedy(df, far, 300).collect()}
    assert multicut.connected_labels(e, greedy) == greedy
    start = multicut.cut_energy([*e, *f], greedy)
    assert start <= 0.9 * multicut.cut_energy([*e, *f], multicut.gaec(e, f))  # energies are negative
    for solver in ("kl", "icm", "subgraph"):
        labels = {x.node: x.label for x in multicut.solve(df, solver, far, most=300).collect()}
        assert multicut.connected_labels(e, labels) == labels and len(labels) == 300
        assert multicut.cut_energy([*e, *f], labels) <= start + 1e-9, solver
    assert multicut.problems(df, far).select("component").distinct().count() > 1
    settings = multicut.FusionSettings("watershed", rounds=2, proposals=2, stale=2)
    tasks = {x.node: x.label for x in proposals.parallel_fusion(df, settings).collect()}
    one = {x.node: x.label for x in multicut.solve(df, lambda a, b: multicut.fusion_moves(a, multicut.SOLVERS["kl"](a, b), b, settings)).collect()}
    assert multicut.cut_energy(e, tasks) == pytest.approx(multicut.cut_energy(e, one))


def test_bounds_skip_searches_that_find_nothing(monkeypatch):
    """Repulsive edges between attractive parts start no search through them, and the bound is that of searching all the same."""
    import random

    from cutgrove.operators import bounds

    r = random.Random(2)
    e = [(a * 100 + i, a * 100 + j, 1.0 + r.random()) for a in range(6) for i in range(100) for j in (i + 1, i + 3) if j < 100]
    e += [(a * 100 + i, a * 100 + 100 + i, -r.random()) for a in range(5) for i in range(100)] + [(a * 100, a * 100 + 50, -3.0) for a in range(6)]
    popped, queue = [0], bounds.deque

    class Counted(queue):
        def popleft(self):
            popped[0] += 1
            return super().popleft()

    monkeypatch.setattr(bounds, "deque", Counted)
    got, seen = bounds.reduced_costs(e), popped[0]
    monkeypatch.setattr(bounds, "_attractive", lambda near, r: dict.fromkeys(near, 0))
    monkeypatch.setattr(bounds, "dict", type("Flat", (dict,), {"fromkeys": classmethod(lambda c, k, v=None: {})}), raising=False)
    assert bounds.reduced_costs(e) == got
    assert 10 * seen < popped[0] - seen


def test_local_forest_of_lifted_probabilities_is_learnt_once(monkeypatch):
    """The middle and the test volume are judged by one forest over the outer parts."""
    from unittest.mock import MagicMock

    from cutgrove.operators import learning, workflows

    learnt = []
    monkeypatch.setattr(learning, "z_cutouts", lambda *a: ("low", "middle", "high"))
    for name in ("train", "predict", "edge_labels", "graph", "local_features"):
        monkeypatch.setattr(learning, name, MagicMock())
    monkeypatch.setattr(learning, "training_rows", lambda volumes, *a, **k: learnt.append(volumes) or MagicMock())
    for name in ("lifted_pairs", "lifted_features", "cut"):
        monkeypatch.setattr(workflows, name, MagicMock())
    workflows.lifted_probabilities("train", "test")
    assert learnt == [["low", "high"]]


def test_a_hub_is_contracted_in_few_rounds(spark):
    """A node with sixty attractive neighbours takes one of them a round; a kernel ends what rounds would join one by one."""
    from cutgrove.operators import multicut

    rows = [(0, k, 1.0 + k / 100) for k in range(1, 61)] + [(k, k + 1, -0.1) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "u long, v long, cost double")
    edges, _, names = multicut.contract_mutual(df, None, 0, rounds=5)
    assert edges.isEmpty() and {r.label for r in names.collect()} == {0} and names.count() == 61
    far = spark.createDataFrame([(1, k, -5.0) for k in range(31, 61)], "u long, v long, cost double")
    _, _, names = multicut.contract_mutual(df, far, 0, rounds=5)
    want = multicut.gaec(rows, [tuple(r) for r in far.collect()])
    assert {r.node: r.label for r in names.collect()} == want


def test_sides_of_blocks_are_tried_together(spark, monkeypatch):
    """A chain whose blocks fit after ten halvings: the largest side that fits, found in two jobs and not in eleven."""
    from cutgrove.operators import blockwise

    edges = spark.createDataFrame([(a, a + 1, 1.0) for a in range(2000)], "u long, v long, cost double")
    pos = spark.range(2001).selectExpr("id node", "0.0 x", "0.0 y", "double(id) z", "1.0 w")
    written = []
    monkeypatch.setattr(blockwise, "settle", lambda df, settle=blockwise.settle: (written.append(1), settle(df))[1])
    held, side = blockwise._fitting(edges, pos, 2048.0, 0.0, 2)
    assert side == 2.0 and len(written) <= 4
    assert max(r["count"] for r in held.groupBy("block").count().collect()) <= 2


def test_no_chunk_of_the_flood_check_holds_the_volume(spark, monkeypatch):
    """Chunks of im7_flood_facts are bounded along the axis that grows."""
    from cutgrove.operators import grids
    from cutgrove.plans import grid_queries

    asked = []
    monkeypatch.setattr(grids, "watershed", lambda v, *a, chunk, **k: asked.append(chunk) or v.selectExpr("x", "y", "z", "seed label"))
    grid_queries.im7_facts(spark, "/root/testdata/sf0.001")
    assert len(asked) == 2 and all(c[2] <= 4096 for c in asked)


def test_pieces_on_faces_don_t_take_a_group_each(spark):
    """Pieces go through tasks as streams, whatever batches they are split into; squares, lines and pieces of one pixel."""
    import contextlib
    import io

    from cutgrove.operators import superpixels

    rows = [(0, y, z, 1) for y in range(5) for z in range(5)] + [(0, y, 9, 2) for y in range(4)] + [(0, 7, 7, 2)] + [(x, 9, z, 3) for x in range(3, 6) for z in range(3)] + [(5, 5, 5, 4)]
    v = spark.createDataFrame(rows, "x long, y long, z long, seg long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = superpixels.face_centroids(v, "seg", 20, 9)
        got = sorted((r.face, r.seg, r.a, r.b) for r in df.collect())
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            df.explain()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [("x0", 1, 2, 2), ("x0", 2, 2, 9), ("x0", 2, 7, 7), ("y0", 1, 0, 2), ("y0", 2, 0, 9), ("y1", 3, 4, 1)]
    assert "MapInArrow" in plan.getvalue() and "FlatMapGroups" not in plan.getvalue()


def test_links_of_a_path_are_all_checked(spark, monkeypatch):
    """A path of 5,000 edges with one gap, after its 4,096th edge, is not linked; nor one that ends before the target."""
    from cutgrove.operators import graphs
    from cutgrove.plans import graph_more

    monkeypatch.setattr(graph_more, "edges", lambda spark, d: spark.createDataFrame([(0, 1, 1)], "u long, v long, n long"))
    last = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("max(event_id) div 100 * 6 + 5 n").first().n
    for gap, end, linked in ((None, last, 1), (4096, last, 0), (3, last, 0), (None, last - 1, 0)):
        rows = spark.range(5000).selectExpr("id seq", f"if(id = {gap or -1}, -1, id) a", f"if(id = 4999, {end}, id + 1) b", "1L cost")
        monkeypatch.setattr(graphs, "shortest_path", lambda *a, rows=rows, **k: rows)
        assert graph_more.gr8(spark, "/root/testdata/sf0.001").collect() == [(last, 5000, linked)]


def test_fusion_moves_don_t_depend_on_the_bounds_of_blocks(spark, monkeypatch):
    """One attractive component beyond WHOLE_EDGES is fused as it is below it, and as the kernel does in one task."""
    import random

    from cutgrove.operators import multicut, proposals

    r = random.Random(3)
    e = [(i, j, round(r.gauss(0.2, 1), 3)) for i in range(200) for j in (i + 1, i + 2, i + 7) if j < 200]
    df, settings = spark.createDataFrame(e, "u long, v long, cost double"), multicut.FusionSettings("watershed", rounds=2, proposals=2, stale=2)
    by = lambda x: {r.node: r.label for r in x.collect()}
    small = by(proposals.parallel_fusion(df, settings))
    for name in ("WHOLE_EDGES", "PART_EDGES", "RANGE_EDGES", "KERNEL_EDGES"):
        monkeypatch.setattr(multicut, name, 60)
    assert by(proposals.parallel_fusion(df, settings)) == small
    one = by(multicut.solve(df, lambda a, b: multicut.fusion_moves(a, multicut.SOLVERS["kl"](a, b), b, settings)))
    assert multicut.cut_energy(e, one) == pytest.approx(multicut.cut_energy(e, small))


def test_filters_of_voxels_are_not_shuffled(spark):
    """Features of edges are those of filters a voxel each, but no exchange holds a voxel's filters or an edge's features."""
    import contextlib
    import io
    import random
    import re

    from pyspark.sql import functions as F

    from cutgrove.operators import features, images, learning

    r = random.Random(9)
    rows = [(x, y, z, (x // 4) + 3 * (y // 3) + 9 * (z // 3), r.randrange(100), r.randrange(1000)) for z in range(-2, 38) for x in range(z % 3, 9) for y in range(8 - z % 2) if r.random() < 0.95 and z != 20]
    v = spark.createDataFrame(rows, "x long, y long, z long, seg long, raw long, pm long")
    filtered, names = images.slice_filters(v, ("raw", "pm"))
    more = spark.createDataFrame([(u, u + 9, u % 5, u / 4) for u in range(60)], "u long, v long, n long, f_own double")
    want = {(q.u, q.v): q.asDict() for q in features.wide_statistics(filtered, names).join(more, ["u", "v"]).collect()}
    df = learning.local_features(v, None, ("raw", "prob"), more)
    got = {(q.u, q.v): q.asDict() for q in df.collect()}
    assert got.keys() == want.keys() and len(got) > 30 and df.schema["n"].dataType.simpleString() == "bigint"
    for k, q in want.items():
        assert all(got[k][c if c in ("u", "v", "n", "f_own") else f"f_{c}"] == pytest.approx(x, rel=1e-9, abs=1e-9) for c, x in q.items())
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        learning.local_features(v, None, ("raw", "prob"), more.withColumn("f_n", F.lit(1.0))).explain("formatted")
    assert len(re.findall("MapInArrow", plan.getvalue())) and "zip_with" not in plan.getvalue() and "FlatMapGroupsInArrow" not in plan.getvalue()


def test_a_join_of_clusters_pushes_edges_of_the_smaller_one(monkeypatch):
    """A hub of four hundred nodes takes one after the other; heights are those of searching all edges at every join."""
    import heapq
    import random
    from types import SimpleNamespace

    from cutgrove.operators import workflows

    r = random.Random(5)
    hub = [(0, a, r.random(), r.randrange(1, 9)) for a in range(1, 401)]
    net = [(i, j, r.random(), r.randrange(1, 9)) for i in range(60) for j in (i + 1, i + 2, i + 7) if j < 60]
    pushed = [0]
    monkeypatch.setattr(workflows, "heapq", SimpleNamespace(heapify=heapq.heapify, heappop=heapq.heappop, heappush=lambda *a: (pushed.__setitem__(0, pushed[0] + 1), heapq.heappush(*a))))

    def plain(rows, size, ward, pairs):
        near, size, name, out, top = {(u, v): (p * n, n) for u, v, p, n in rows}, dict(size), {a: a for r in rows for a in r[:2]}, {}, 0.0
        while near:
            h, (u, v) = min((s / n * 2 / (size[u] ** -ward + size[v] ** -ward), (u, v)) for (u, v), (s, n) in near.items())
            top, size[u], after = max(top, h), size[u] + size[v], {}
            out |= {i: h for i, (a, b) in enumerate(pairs) if {name[a], name[b]} == {u, v}}
            name = {a: u if k == v else k for a, k in name.items()}
            for (a, b), (s, n) in near.items():
                k = tuple(sorted((u if a == v else a, u if b == v else b)))
                if k[0] != k[1]:
                    s0, n0 = after.get(k, (0.0, 0))
                    after[k] = (s + s0, n + n0)
            near = after
        return [out.get(i, top) for i in range(len(pairs))]

    for ward in (0.01, 0.4, 0.7):
        size, pairs = {a: r.randrange(1, 40) for a in range(60)}, [(i, i + 5) for i in range(55)]
        assert workflows.merge_heights(net, size, ward, pairs) == pytest.approx(plain(net, size, ward, pairs))
    pushed[0] = 0
    workflows.merge_heights(hub, dict.fromkeys(range(401), 1), 0.1, [(1, 2)])
    assert pushed[0] < 20_000  # 79,800 where all edges of the hub are pushed at every join
