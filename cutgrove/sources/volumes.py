"""Volumes as long tables: voxels(x, y, z, raw, pm, seg, gt)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PM_SCALE = 100_000


def event_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic 10 x 10 x (N / 100) volume held by ``events``: six flat superpixels a slice, integer raw and pm."""
    e = F.col("event_id")
    x, y, z = (e % 10).cast("long"), (F.floor(e / 10) % 10).cast("long"), F.floor(e / 100).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value").select(
        x.alias("x"), y.alias("y"), z.alias("z"),
        F.round(F.col("value") * 100).cast("long").alias("raw"),
        F.least(F.lit(99_900), F.greatest(F.lit(100), F.round(F.col("value") * 1000))).cast("long").alias("pm"),
        F.expr("""(event_id div 100) * 6 + least(2, (event_id % 10 + ((event_id div 10) % 10 + event_id div 100) % 3) div 4)
               + 3 * (((event_id div 10) % 10) div 5)""").cast("long").alias("seg"),
        F.expr("(event_id div 500) * 2 + (event_id % 10) div 5").cast("long").alias("gt"),
    )


#: The same table for the SQL checks.
VOX_SQL = """vox AS (SELECT CAST(event_id % 10 AS BIGINT) AS x, CAST((event_id // 10) % 10 AS BIGINT) AS y, CAST(event_id // 100 AS BIGINT) AS z,
  CAST(round(value * 100) AS BIGINT) AS raw, CAST(least(99900, greatest(100, round(value * 1000))) AS BIGINT) AS pm,
  CAST((event_id // 100) * 6 + least(2, (event_id % 10 + ((event_id // 10) % 10 + event_id // 100) % 3) // 4) + 3 * (((event_id // 10) % 10) // 5) AS BIGINT) AS seg,
  CAST((event_id // 500) * 2 + (event_id % 10) // 5 AS BIGINT) AS gt FROM events)"""


def mask_labels(voxels: DataFrame, mask, seg: str = "seg") -> DataFrame:
    """Labels outside the mask become 0, the ignore label."""
    return voxels.withColumn(seg, F.when(mask, F.col(seg)).otherwise(F.lit(0)))


def cutout(voxels: DataFrame, box: tuple) -> DataFrame:
    """Half-open box (x0, x1, y0, y1, z0, z1); the ranges reach the scan."""
    x0, x1, y0, y1, z0, z1 = box
    return voxels.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("z") >= z0) & (F.col("z") < z1))


def inverse_cutout(voxels: DataFrame, box: tuple, seg: str = "seg") -> DataFrame:
    """All voxels; labels inside the box become 0 and the others move up by one."""
    x0, x1, y0, y1, z0, z1 = box
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("z") >= z0) & (F.col("z") < z1)
    return voxels.withColumn(seg, F.when(inside, F.lit(0)).otherwise(F.col(seg) + 1))


def input_channel(voxels: DataFrame, number: int, names: tuple):
    """The numbered input as a 32-bit float column."""
    if not 0 <= number < len(names):
        raise IndexError(f"input {number} of {len(names)}")
    return voxels[names[number]].cast("float")


def child_cutout(voxels: DataFrame, box: tuple, ignore: tuple = (), bad: tuple = ()) -> DataFrame:
    """x, y, z from the box's corner, consecutive seg, gt with ignored ids as 0, defect = 1 in bad slices of the parent."""
    from cutgrove.operators.relabel import consecutive

    x0, _, y0, _, z0, _ = box
    inside = consecutive(cutout(voxels, box), "seg")
    gt = F.when(F.col("gt").isin(*ignore), 0).otherwise(F.col("gt")) if ignore else F.col("gt")
    defect = F.col("z").isin(*bad).cast("int") if bad else F.lit(0)
    return inside.select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), (F.col("z") - z0).alias("z"), F.col("new_label").alias("seg"), gt.alias("gt"), defect.alias("defect"))


def parameters(spark: SparkSession, **lists: tuple) -> DataFrame:
    """(kind, value) of the id lists that a user sets; ids must be whole and not negative."""
    rows = [(kind, int(v)) for kind, values in lists.items() for v in values]
    if any(v < 0 for _, v in rows):
        raise ValueError("ids are not negative")
    return spark.createDataFrame(rows, "kind string, value long")
