import numpy as np
from pyspark.sql import functions as F

from cutgrove.operators import images, metrics, rag, superpixels
from cutgrove.operators.relabel import consecutive


def grid(spark):
    return spark.range(24).selectExpr("id % 4 x", "(id div 4) % 3 y", "id div 12 z", "1L pm", "id raw").withColumn("seg", F.expr("x div 2 + 2 * (y div 2) + 4 * z"))


def test_rag_of_a_small_grid(spark):
    got = {(r.u, r.v): r.n for r in rag.edges(rag.faces(grid(spark))).collect()}
    assert got == {(0, 1): 2, (0, 2): 2, (0, 4): 4, (1, 3): 2, (1, 5): 4, (2, 3): 1, (2, 6): 2, (3, 7): 2, (4, 5): 2, (4, 6): 2, (5, 7): 2, (6, 7): 1}


def test_distance_transform_against_brute_force():
    on = np.random.default_rng(0).random((9, 7)) > 0.8
    want = [[min((x - a) ** 2 + 4 * (y - b) ** 2 for a, b in zip(*np.nonzero(on))) for y in range(7)] for x in range(9)]
    assert np.array_equal(images.squared_edt(on, (1, 2)), want)


def test_distance_transform_in_three_dimensions_and_without_points():
    on = np.random.default_rng(1).random((6, 5, 4)) > 0.85
    at = np.argwhere(on)
    want = (((np.indices(on.shape).reshape(3, -1).T[:, None] - at[None]) * [1, 1, 5]) ** 2).sum(2).min(1).reshape(on.shape)
    assert np.array_equal(images.squared_edt(on, (1, 1, 5)), want)
    assert np.isinf(images.squared_edt(np.zeros((3, 3), bool))).all()


def test_distance_transform_of_a_large_slice_is_linear_in_memory():
    on = np.zeros((1024, 1024), bool)
    on[5, 7] = on[900, 100] = True
    d = images.squared_edt(on)
    assert d[5, 8] == 1 and d[1023, 1023] == min(1018**2 + 1016**2, 123**2 + 923**2)


def rooms():
    p = np.zeros((21, 21))
    p[[0, 10, 20]] = p[:, [0, 10, 20]] = 1
    return p


def test_watershed_of_four_rooms():
    for o in (superpixels.Options(0.5), superpixels.Options(0.5, seed_sigma=1.0, weight_sigma=1.0, group_seeds=True), superpixels.Options(0.5, grow_on_map=True)):
        labels = superpixels.watershed(rooms(), o)
        assert len(np.unique(labels)) == 4 and labels.min() > 0
        assert len({labels[5, 5], labels[5, 15], labels[15, 5], labels[15, 15]}) == 4


def test_small_membranes_and_segments_go():
    p = rooms()
    p[4, 4] = 1  # a speck of membrane
    assert superpixels.signed_distance(p, 0.5, 2)[4, 4] > 0 > superpixels.signed_distance(p, 0.5)[4, 4] - 1
    p[10, 5] = 0
    big = superpixels.watershed(p, superpixels.Options(0.5, least_segment=50))
    sizes = np.unique(big, return_counts=True)[1]
    assert big.min() > 0 and sizes.min() >= 50


def test_labels_of_a_grid():
    g = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 1]])
    assert superpixels.label_grid(g, 0).tolist() == [[1, 1, 0], [0, 0, 6], [7, 0, 6]]
    assert superpixels.label_grid(g, 0, diagonal=True).tolist() == [[1, 1, 0], [0, 0, 1], [7, 0, 1]]
    assert superpixels.drop_sizes(superpixels.label_grid(g, 0), 2).max() == 6


def test_maxima_with_plateaus_and_borders():
    d = np.array([[3, 3, 1, 0], [1, 1, 1, 2], [0, 5, 1, 1]])
    assert superpixels.maxima(d).astype(int).tolist() == [[1, 1, 0, 0], [0, 0, 0, 1], [0, 1, 0, 0]]
    assert superpixels.maxima(np.zeros((3, 3))).all()
    ball = -(np.indices((5, 5, 5)) - 2).__pow__(2).sum(0)
    assert np.argwhere(superpixels.maxima(ball)).tolist() == [[2, 2, 2]]


def test_grouped_seeds_against_brute_force():
    r = np.random.default_rng(4)
    mask, d = r.random((40, 30)) > 0.95, r.uniform(0.5, 8, (40, 30))
    at, reach = np.argwhere(mask), d[mask]
    gap = np.linalg.norm(at[:, None] - at[None], axis=2)
    near = (gap < reach[:, None]) & (gap < reach[None])
    label = np.arange(len(at))
    for _ in label:
        label = np.where(near | np.eye(len(at), dtype=bool), label[None], len(at)).min(1)
    got = superpixels.group_seeds(mask, d)[mask]
    assert len(set(zip(got.tolist(), label.tolist()))) == len(set(got.tolist())) == len(set(label.tolist()))


def test_enclosed_segments_are_joined():
    g = np.ones((7, 7), int)
    g[2:5, 2:5] = 2
    g[:, 6] = 3
    assert set(np.unique(superpixels.join_enclosed(g))) == {1, 3}


def test_fast_marching_between_straight_line_and_city_block():
    t = images.march(np.ones((30, 30)), (0, 0))
    line = np.hypot(*np.indices((30, 30)))
    assert (t >= line - 1e-9).all() and t[29, 29] < 1.1 * line[29, 29]
    assert np.array_equal(images.march(np.ones((5, 5)), (0, 0), False), np.indices((5, 5)).sum(0))


def test_filters_in_three_dimensions():
    g = np.zeros((15, 15, 9))
    g[7, 7, 4] = 1
    f = images.filters(g, (1.6, 1.6, 0.8))
    assert set(f) == {"smooth", "log", "hessian_1", "hessian_2", "hessian_3"} and f["smooth"].argmax() == g.argmax()
    assert np.allclose(f["hessian_1"] + f["hessian_2"] + f["hessian_3"], f["log"], atol=1e-6) and (f["hessian_1"] >= f["hessian_3"]).all()


def test_gaussian_keeps_constants():
    g = np.full((12, 5), 3.0)
    assert np.allclose(images.gaussian(g, 1.6), 3) and np.allclose(images.gaussian(g, 1.6, 2), 0)


def test_scores_of_equal_and_merged_labelings(spark):
    rows = spark.createDataFrame([(1, 1)] * 4 + [(2, 2)] * 4, "seg long, gt long")
    same = metrics.rand_vi(metrics.contingency(rows)).first()
    assert same.rand == 1 and same.vi == 0
    merged = metrics.rand_vi(metrics.contingency(rows.withColumn("seg", F.lit(1)))).first()
    assert merged.agree == 12 and round(merged.vi, 4) == round(float(np.log(2)), 4)
    assert metrics.adapted_rand(metrics.contingency(rows)).first().are == 0


def test_consecutive_labels(spark):
    df = spark.createDataFrame([(0,), (70000,), (7,), (7,)], "seg long")
    assert sorted((r.seg, r.new_label) for r in consecutive(df, "seg").collect()) == [(0, 0), (7, 1), (7, 1), (70000, 2)]
    assert sorted((r.seg, r.new_label) for r in consecutive(df, "seg", keep_zero=True).collect()) == [(0, 0), (7, 1), (7, 1), (70000, 2)]
