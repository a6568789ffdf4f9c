"""The command line on small tables."""

from pyspark.sql import functions as F

from cutgrove.__main__ import main
from cutgrove.functions import registry

from .test_solvers import blocks


def test_solve_and_segment(spark, tmp_path):
    spark.createDataFrame([(0, 1, 2.0), (1, 2, -1.0)], "u long, v long, cost double").write.parquet(f"{tmp_path}/edges")
    assert main(["solve", "--edges", f"{tmp_path}/edges", "--out", f"{tmp_path}/labels"]) == 0
    assert {r.node: r.label for r in spark.read.parquet(f"{tmp_path}/labels").collect()} == {0: 0, 1: 0, 2: 2}
    blocks(spark, 10).write.parquet(f"{tmp_path}/voxels")
    main(["segment", "--voxels", f"{tmp_path}/voxels", "--out", f"{tmp_path}/segments"])
    out = spark.read.parquet(f"{tmp_path}/segments")
    assert out.count() == 8 * 8 * 6 and out.groupBy(F.expr("x div 4")).agg(F.countDistinct("label")).filter("`count(DISTINCT label)` > 1").count() == 0


def test_segment_slices_and_arrays(spark, tmp_path):
    from cutgrove.sources import arrays, inputs, rasters

    v = blocks(spark, 10)
    for name in ("raw", "pm", "seg", "gt"):
        rasters.write_slices(v, name, f"{tmp_path}/{name}")
    args = ["--raw", f"{tmp_path}/raw", "--map", f"{tmp_path}/pm", "--gt", f"{tmp_path}/gt", "--segmentation", f"{tmp_path}/seg", "--mode", "isotropic"]
    assert main(["segment", *args, "--out", f"{tmp_path}/labels.tif"]) == 0
    out = rasters.read_slices(spark, f"{tmp_path}/labels.tif")
    assert out.count() == 8 * 8 * 6 and out.groupBy(F.expr("x div 4")).agg(F.countDistinct("value").alias("n")).filter("n > 1").count() == 0
    arrays.save_volume(v.select("x", "y", "z", "raw", "pm", "seg", "gt"), f"{tmp_path}/volume.arrays", (4, 4, 4))
    back = inputs.read_volume(spark, f"{tmp_path}/volume.arrays")
    assert back.count() == 8 * 8 * 10 and back.exceptAll(v.select(back.columns)).count() == 0
    inputs.write_labels(v.select("x", "y", "z", F.col("gt").alias("label")), f"{tmp_path}/labels.arrays")
    assert arrays.load_volume(spark, f"{tmp_path}/labels.arrays").filter("label > 0").count() == 8 * 8 * 10
    own = inputs.from_slices(spark, f"{tmp_path}/raw", f"{tmp_path}/pm")  # superpixels and no ground truth
    assert own.count() == 8 * 8 * 10 and own.agg(F.max("pm"), F.max("gt")).first() == (100_000, 0) and own.filter("seg = 0").count() == 0


def test_named_functions(spark):
    registry.register(spark)
    got = [(r.at, r.x, r.y) for r in spark.sql("SELECT * FROM line_points(0, 0, 3, -2)").collect()]
    assert got == [(0, 0, 0), (1, 1, -1), (2, 2, -1), (3, 3, -2)]
    row = spark.range(5).agg(*registry.aggregate(F.col("id"), ("mean", "q50", "n"))).first()
    assert (row.mean, row.q50, row.n) == (2.0, 2.0, 5)
