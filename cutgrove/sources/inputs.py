"""Volumes for whole runs: Parquet voxels, array folders, or layers of TIFF slices; and labels back to any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, rasters
from .volumes import PM_SCALE

TIFF = (".tif", ".tiff")
ARRAYS = ".arrays"


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """voxels(x, y, z, raw, pm, seg, gt) of a Parquet folder, or of an array folder, told by its suffix ``.arrays``."""
    return arrays.load_volume(spark, path) if path.rstrip("/").endswith(ARRAYS) else spark.read.parquet(path)


def _layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    return rasters.read_slices(spark, path).filter("channel = 0").select("x", "y", "z", F.col("value").alias(name))


def from_slices(spark: SparkSession, raw: str, probability: str, truth: str | None = None, segmentation: str | None = None, threshold: float = 0.5) -> DataFrame:
    """voxels(x, y, z, raw, pm, seg, gt) of folders or files of TIFF slices.

    Probabilities over 1 are divided by the largest one. Without a segmentation, superpixels of every slice from ``threshold``
    on; without ground truth gt is 0.
    """
    from cutgrove.operators import superpixels

    p = _layer(spark, probability, "p")
    top = p.agg(F.max("p")).first()[0] or 1.0
    share = F.col("p") / F.lit(float(top)) if top > 1 else F.col("p")
    v = _layer(spark, raw, "r").join(p, ["x", "y", "z"]).select("x", "y", "z", F.round("r").cast("long").alias("raw"), F.round(share * PM_SCALE).cast("long").alias("pm"))
    if segmentation:
        v = v.join(_layer(spark, segmentation, "s"), ["x", "y", "z"]).withColumn("seg", F.col("s").cast("long")).drop("s")
    else:
        v = v.join(superpixels.superpixels(v, "pm", superpixels.Options(threshold * PM_SCALE)).withColumnRenamed("label", "seg"), ["x", "y", "z"])
    if truth:
        return v.join(_layer(spark, truth, "g"), ["x", "y", "z"]).withColumn("gt", F.col("g").cast("long")).drop("g")
    return v.withColumn("gt", F.lit(0).cast("long"))


def write_labels(labels: DataFrame, path: str) -> None:
    """labels(x, y, z, label) as TIFF slices, an array folder or Parquet, by the path's suffix."""
    bare = path.rstrip("/")
    if bare.endswith(TIFF):
        rasters.write_slices(labels, "label", bare)
    elif bare.endswith(ARRAYS):
        arrays.save_volume(labels.select("x", "y", "z", "label"), bare)
    else:
        labels.write.mode("overwrite").parquet(path)
