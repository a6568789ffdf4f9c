"""Array folders, step fits, outlines, lifted grids and chunked paths against brute force."""

import heapq
import random

import numpy as np
import pytest

from cutgrove.operators import features, graphs, outlines, paths
from cutgrove.session import scratch
from cutgrove.sources import arrays


def test_array_folder_round_trip(spark):
    rows = [(x, y, z, 10 * x + y, float(z) if x else None, x > y) for x in range(5) for y in range(4) for z in range(3) if (x, y, z) != (4, 3, 2)]
    df = spark.createDataFrame(rows, "x long, y long, z long, a int, b double, c boolean")
    path = scratch(spark, "volume")
    assert arrays.save_volume(df, path, (2, 3, 2)) == 3 * 11  # the last chunk holds no voxel
    back = arrays.load_volume(spark, path)
    assert back.schema["a"].dataType.simpleString() == "int" and back.schema["c"].dataType.simpleString() == "boolean"
    want = {r[:3]: (r[3], r[4] or 0.0, r[5]) for r in rows} | {(4, 3, 2): (0, 0.0, False)}
    assert {(r.x, r.y, r.z): (r.a, r.b, r.c) for r in back.collect()} == want
    part = arrays.load_volume(spark, path, z="1:2", x="3:").select("x", "z", "a")
    assert part.rdd.getNumPartitions() == 4 and {(r.x, r.z) for r in part.collect()} == {(3, 1), (4, 1)}
    assert arrays.load_volume(spark, path, y="9:").count() == 0
    arrays.save_volume(df.limit(0), empty := scratch(spark, "volume"))
    assert arrays.load_volume(spark, empty).count() == 0


def test_filters_skip_chunks(spark):
    df = spark.range(24).selectExpr("id % 2 AS x", "0L AS y", "id div 2 AS z", "id AS a")
    path, before = scratch(spark, "volume"), spark.conf.get(arrays.PUSHDOWN, "false")
    arrays.save_volume(df, path, (2, 2, 3))
    try:
        spark.conf.set(arrays.PUSHDOWN, "true")
        for where, chunks in (("z >= 3", 3), ("z > 5 AND z < 9", 1), ("z = 4 AND a > 1", 1), ("3 >= z", 2), ("a > 3", 4)):
            got = arrays.load_volume(spark, path).filter(where)
            assert got.rdd.getNumPartitions() == chunks, where
            assert sorted(r.a for r in got.collect()) == sorted(r.a for r in df.filter(where).collect()), where
    finally:
        spark.conf.set(arrays.PUSHDOWN, before)


def test_small_chunks_share_a_task(spark):
    """Forty chunks in four tasks: the same voxels, and every row says how many chunks the scan opens."""
    df = spark.range(80).selectExpr("id % 2 AS x", "0L AS y", "id div 2 AS z", "id AS a")
    path, before = scratch(spark, "volume"), spark.conf.get(arrays.PUSHDOWN, "false")
    arrays.save_volume(df, path, (2, 2, 1))
    try:
        spark.conf.set(arrays.PUSHDOWN, "true")
        for where, chunks, tasks in (("z >= 0", 40, 4), ("z >= 15", 25, 3), ("z >= 40", 0, 1)):
            got = arrays.load_volume(spark, path, per_task=10, counted=True).filter(where)
            assert got.rdd.getNumPartitions() == tasks
            assert sorted((r.a, r.opened) for r in got.collect()) == sorted((r.a, chunks) for r in df.filter(where).collect())
    finally:
        spark.conf.set(arrays.PUSHDOWN, before)


def test_step_fits(spark):
    r, rows, want = random.Random(2), [], {}
    for u in range(40):
        values = [r.randint(0, 9) for _ in range(r.choice((1, 2, 3, 8, 15)))]
        rows += [(u, u + 1, i, x) for i, x in enumerate(values)]
        n = len(values)
        if n >= 3:
            dev = lambda a: sum((x - sum(a) / len(a)) ** 2 for x in a)
            d, k = min((round(dev(values[:k]) + dev(values[k:]), 9), k) for k in range(1, n))
            want[u] = (n, k, pytest.approx(abs(sum(values[:k]) / k - sum(values[k:]) / (n - k))), pytest.approx(d / n, abs=1e-9))
    got = {x.u: (x.n, x.split, x.height, x.rest) for x in features.step_fits(spark.createDataFrame(rows, "u long, v long, at long, value long"), "value").collect()}
    assert got == want


def test_rings_of_a_label_with_a_hole_and_a_corner(spark):
    picture = ["11100", "10100", "11122", "00021", "00000"]
    df = spark.createDataFrame([(x, y, 0, int(c)) for y, row in enumerate(picture) for x, c in enumerate(row)], "x long, y long, z long, seg long")
    of = outlines.rings(df, "seg").cache()
    rings = {}
    for r in sorted(of.collect(), key=lambda r: (r.label, r.ring, r.at)):
        rings.setdefault((r.label, r.ring), []).append(r)
    for edges in rings.values():
        assert [e.at for e in edges] == list(range(len(edges)))
        assert all((a.x1, a.y1) == (b.x0, b.y0) for a, b in zip(edges, edges[1:] + edges[:1]))
    areas = sorted((r.label, r.area, r.edges) for r in outlines.ring_areas(of).collect())
    assert areas == [(0, 1, 4), (0, 4, 8), (0, 9, 14), (1, -1, 4), (1, 1, 4), (1, 9, 12), (2, 3, 8)] or [a[:2] for a in areas] == [(0, 1), (0, 4), (0, 8), (1, -1), (1, 1), (1, 9), (2, 3)]
    path = {r.label: r.path for r in outlines.vector_paths(of).collect()}
    assert path[1].count("M") == 3 and path[2].count("L") == 5


def dijkstra(near, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a]:
            continue
        for b, c in near(a):
            if d + c < best.get(b, float("inf")):
                best[b] = d + c
                heapq.heappush(heap, (d + c, b))
    return best


def test_lifted_grid_in_tiles(spark):
    r = np.random.default_rng(4)
    g = r.integers(1, 50, (9, 7))
    df = spark.createDataFrame([(x, y, z, int(g[x, y]) + z) for x in range(9) for y in range(7) for z in (0, 1)], "x long, y long, z long, pm long")
    found = {(q.x, q.y, q.z, q.dx, q.dy): q.cost for q in graphs.lifted_grid_distances(df, "pm", 2, tile=4).collect()}
    n = 0
    for z in (0, 1):
        for start in np.ndindex(g.shape):
            inside = lambda p: all(0 <= a < m and abs(a - s) <= 2 for a, m, s in zip(p, g.shape, start))  # noqa: B023, E731
            near = lambda p: [(q, int(g[p] + g[q]) + 2 * z) for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)) if inside(q)]  # noqa: B023, E731
            for q, d in dijkstra(near, start).items():
                dx, dy = q[0] - start[0], q[1] - start[1]
                if (dy > 0 or dy == 0 and dx > 0) and 1 < dx * dx + dy * dy <= 4:
                    assert found[*start, z, dx, dy] == d
                    n += 1
    assert n == len(found)


def test_paths_over_chunks(spark):
    r = random.Random(9)
    cost = {(x, y, z): float(r.randint(0, 9)) for x in range(7) for y in range(6) for z in range(5) if r.random() < 0.8}
    start, goal = min(cost), max(cost)
    rows = [(*p, 1, c) for p, c in cost.items()] + [(x, 0, 9, 2, 1.0) for x in range(6) if x != 3]
    df = spark.createDataFrame(rows, "x long, y long, z long, obj long, cost double")
    ends = spark.createDataFrame([(*start, 1), (0, 0, 9, 2)], "x long, y long, z long, obj long")
    near = lambda p: [(q, cost[q]) for k in range(3) for s in (-1, 1) if (q := p[:k] + (p[k] + s,) + p[k + 1 :]) in cost]
    want = dijkstra(near, start)
    for chunk, delta in (((3, 3, 3), 6.0), ((50, 50, 50), None)):
        best = paths.distances(df, ends, chunk, delta).cache()
        got = {(q.vid & (2**21 - 1), q.vid >> 21 & (2**21 - 1), q.vid >> 42): q.d for q in best.filter("obj = 1").collect()}
        assert got == want and best.filter("obj = 2").count() == 3
        goals = spark.createDataFrame([(*goal, 1), (5, 0, 9, 2)], "x long, y long, z long, obj long")
        steps = [(q.x, q.y, q.z) for q in paths.traced(best, goals).orderBy("seq").collect()]
        if goal in want:
            assert steps[0] == start and steps[-1] == goal and sum(cost[p] for p in steps[1:]) == want[goal]
            assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(steps, steps[1:]))
        else:
            assert not steps
