"""Distances, watersheds and paths in chunks against one task and brute force."""

import numpy as np

from cutgrove.operators import grids

SHAPE = (9, 8, 7)


def at(p):
    return (int(p[2]) << 42) | (int(p[1]) << 21) | int(p[0])


def rows(shape, *grids_of):
    return [(*map(int, p), *(g[p].item() for g in grids_of)) for p in np.ndindex(shape)]


def kruskal(h, seeds, axes=(0, 1, 2)):
    edges = []
    for p in np.ndindex(h.shape):
        for k in axes:
            q = tuple(p[i] + (i == k) for i in range(3))
            if all(a < n for a, n in zip(q, h.shape)):
                edges.append((max(h[p], h[q]), min(h[p], h[q]), at(p), k, p, q))
    parent, label = {p: p for p in np.ndindex(h.shape)}, {p: int(seeds[p]) for p in np.ndindex(h.shape)}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for *_, p, q in sorted(edges):
        a, b = root(p), root(q)
        if a != b and not (label[a] and label[b]):
            parent[a], label[b] = b, label[a] or label[b]
    return {p: label[root(p)] for p in parent}


def volume(seed=0):
    r = np.random.default_rng(seed)
    h = r.integers(0, 5, SHAPE).astype(float)
    return h, np.where(r.random(SHAPE) < 0.03, r.integers(1, 9, SHAPE), 0)


def labels(df):
    return {(r.x, r.y, r.z): r.label for r in df.collect()}


def test_flood_is_the_spanning_forest():
    for axes in ((0, 1, 2), (0, 1)):
        h, seeds = volume(1)
        points = list(np.ndindex(SHAPE))
        got = grids.flood(np.array([at(p) for p in points]), np.array([h[p] for p in points]), np.array([seeds[p] for p in points]), axes)
        want = kruskal(h, seeds, axes)
        assert [want[p] for p in points] == got.tolist()


def test_watershed_in_chunks_of_any_size(spark):
    h, seeds = volume()
    df = spark.createDataFrame(rows(SHAPE, h, seeds), "x long, y long, z long, height double, seed long")
    want = kruskal(h, seeds)
    for chunk, most in (((4, 3, 20), 10**6), ((5, 5, 4), 30)):
        assert labels(grids.watershed(df, "height", "seed", chunk=chunk, most=most)) == want
    assert labels(grids.watershed(df, "height", "seed", axes=(0, 1), chunk=(5, 8, 3))) == kruskal(h, seeds, (0, 1))


def test_watershed_with_walls_without_seeds_and_empty(spark):
    df = spark.createDataFrame([(x, 0, 0, 1.0, 7 if x == 0 else None) for x in range(9) if x != 4], "x long, y long, z long, height double, seed long")
    assert labels(grids.watershed(df, "height", "seed", chunk=(3, 3, 3))) == {(x, 0, 0): 7 if x < 4 else 0 for x in range(9) if x != 4}
    assert grids.watershed(df.limit(0), "height", "seed").count() == 0


def test_second_pass_gives_small_labels_to_others(spark):
    h = [3, 1, 5, 2, 9, 1, 1, 1]
    df = spark.createDataFrame([(x, 0, 0, float(v), {1: 1, 3: 2, 6: 3}.get(x, 0)) for x, v in enumerate(h)], "x long, y long, z long, height double, seed long")
    first, second = labels(grids.watershed(df, "height", "seed")), labels(grids.two_pass_watershed(df, "height", "seed", 3))
    assert sorted(first.values()) == [1, 1, 2, 2, 3, 3, 3, 3] or sorted(first.values()) == [1, 1, 1, 2, 3, 3, 3, 3] or sorted(first.values()) == [1, 1, 1, 2, 2, 3, 3, 3]
    assert 2 not in second.values() and len(second) == 8 and second[0, 0, 0] in (1, 3)


def test_distances_in_bundles_of_lines(spark):
    on = np.random.default_rng(3).random(SHAPE) < 0.04
    df = spark.createDataFrame(rows(SHAPE, on), "x long, y long, z long, is_on boolean")
    marks = np.argwhere(on)
    for axes, pitch in (((0, 1, 2), (1.0, 1.0, 5.0)), ((0, 1), (2.0, 1.0, 1.0))):
        got = {(r.x, r.y, r.z): r.d2 for r in grids.squared_distances(df, "is_on", pitch, axes, bundle=3).collect()}
        for p, d in got.items():
            near = [sum((pitch[k] * (p[k] - q[k])) ** 2 for k in axes) for q in marks if all(p[k] == q[k] for k in range(3) if k not in axes)]
            assert d == (min(near) if near else None)
    assert all(r.d2 is None for r in grids.squared_distances(df.selectExpr("x", "y", "z", "CAST(NULL AS BOOLEAN) AS is_on"), "is_on").collect())


def test_wide_statistics_equal_built_in_ones(spark):
    from pyspark.sql import functions as F

    from cutgrove.operators import features

    r = np.random.default_rng(6)
    rows = [(x, y, z, (x // 3) + 10 * (y // 4) + 100 * (z // 2), float(r.integers(0, 5)), float(r.normal()) if x != y else 1.0) for x in range(7) for y in range(8) for z in range(4)]
    df = spark.createDataFrame(rows, "x long, y long, z long, seg long, raw double, pm double")
    want = {(q.u, q.v): q.asDict() for q in features.wide_channels(features.channel_statistics(df, {"raw": F.col("raw"), "pm": F.col("pm")}), ["raw", "pm"]).collect()}
    got = {(q.u, q.v): q.asDict() for q in features.wide_statistics(df, ["raw", "pm"]).collect()}
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert row.keys() == got[k].keys() and all(abs(got[k][c] - x) <= 1e-9 * max(1, abs(x)) for c, x in row.items()), (k, row, got[k])
    whole = list(features.whole_groups(features.pa.Table.from_pydict({"u": [1, 1, 1, 2, 2, 3], "v": [1, 1, 2, 2, 2, 3]}).to_batches(max_chunksize=2), least=2))
    assert [t.column("u").to_pylist() for t in whole] == [[1, 1], [1], [2, 2], [3]] or sum(len(t) for t in whole) == 6


def test_distances_to_other_labels(spark):
    r = np.random.default_rng(8)
    g = np.repeat(np.repeat(r.integers(0, 3, (3, 3, 3)), 3, 0), 3, 1)  # 9 x 9 x 3
    df = spark.createDataFrame(rows(g.shape, g), "x long, y long, z long, seg long")
    got = {(q.x, q.y, q.z): q.d2 for q in grids.label_distances(df, "seg", (1.0, 1.0, 2.0), bundle=4).collect()}
    padded = np.full(tuple(n + 2 for n in g.shape), -1)
    padded[1:-1, 1:-1, 1:-1] = g
    for p, d in got.items():
        others = np.argwhere(padded != g[p]) - 1
        assert d == (((others - p) * (1, 1, 2)) ** 2).sum(1).min()
