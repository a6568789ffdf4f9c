"""Region adjacency graphs and what hangs on their edges.

A face is a pair of touching voxels. Faces come from ``lead`` along each axis: one sort per axis instead of a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = {0: ("x", ("y", "z")), 1: ("y", ("x", "z")), 2: ("z", ("x", "y"))}


def neighbours(voxels: DataFrame, axis: int, cols: tuple) -> DataFrame:
    """Each voxel with the named columns of the next voxel along the axis as next_<name>; absent where the grid ends."""
    along, others = AXES[axis]
    w = Window.partitionBy(*others).orderBy(along)
    step = F.lead(along).over(w) == F.col(along) + 1
    return voxels.select("*", *(F.when(step, F.lead(c).over(w)).alias(f"next_{c}") for c in cols)).withColumn("axis", F.lit(axis).cast("int"))


def voxel_pairs(voxels: DataFrame, cols: tuple = ("seg", "pm", "raw")) -> DataFrame:
    """Every pair of 6-neighbours: x, y, z, axis, columns of both voxels."""
    return reduce(DataFrame.unionByName, (neighbours(voxels, a, cols).filter(F.col(f"next_{cols[0]}").isNotNull()) for a in AXES))


def faces(voxels: DataFrame) -> DataFrame:
    """Faces between different labels: u < v, axis, position of the lower voxel and w, the sum of both pm values."""
    pairs = voxel_pairs(voxels).filter("seg <> next_seg")
    return pairs.select(F.least("seg", "next_seg").alias("u"), F.greatest("seg", "next_seg").alias("v"), "axis", "x", "y", "z", (F.col("pm") + F.col("next_pm")).alias("w"))


def edges(found: DataFrame) -> DataFrame:
    """u, v, n, kind (1 in a plane, 0 between planes), s = sum of w."""
    return found.groupBy("u", "v").agg(F.count("*").alias("n"), F.when(F.max("axis") == 2, 0).otherwise(1).cast("int").alias("kind"), F.sum("w").alias("s"))


def node_stats(voxels: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(f"s{c}") for c in ("x", "y", "z")]
    return voxels.groupBy("seg").agg(F.count("*").alias("n"), F.sum("raw").alias("total"), F.min("raw").alias("low"), F.max("raw").alias("high"), *sums)


def node_gt(voxels: DataFrame) -> DataFrame:
    """The commonest gt label of each superpixel; the smaller label of equals."""
    counts = voxels.groupBy("seg", "gt").agg(F.count("*").alias("n"))
    best = Window.partitionBy("seg").orderBy(F.desc("n"), "gt")
    return counts.withColumn("r", F.row_number().over(best)).filter("r = 1").select("seg", "gt", "n")


def ends(of: DataFrame, nodes: DataFrame, cols: tuple, key: str = "seg") -> DataFrame:
    """Edges with columns of both end nodes, as <name>_u and <name>_v."""
    for side in "uv":
        of = of.join(nodes.select(F.col(key).alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
    return of
