"""Named extension points: aggregates, filters and a table function, looked up by fixed names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Aggregates of a column by name.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "total": F.sum, "low": F.min, "high": F.max, "var": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis, "n": F.count,
    **{f"q{k}": (lambda c, q=k / 100: F.percentile(c, q)) for k in (10, 25, 50, 75, 90)},
}


def aggregate(column: Column, names: tuple) -> list[Column]:
    """The named aggregates of a column, each under its name; unknown names raise."""
    return [AGGREGATES[n](column).alias(n) for n in names]


def line_points(lines: DataFrame) -> DataFrame:
    """Rows (x0, y0, x1, y1, at, px, py) of the straight lines between two pixels, one a step along the longer axis, halves up."""
    steps = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1)).cast("long")
    rows = lines.withColumn("steps", steps).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    # whole numbers, floored also under 0
    place = lambda c: F.floor((2 * (F.col(f"{c}0") * F.col("steps") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("at")) + F.col("steps")) / (2 * F.col("steps"))).cast("long")
    return rows.select("x0", "y0", "x1", "y1", "at", place("x").alias("px"), place("y").alias("py"))


class LinePoints:
    """Rows (at, x, y) of the straight line between two pixels, one a step along its longer axis, halves rounded up."""

    def eval(self, x0: int, y0: int, x1: int, y1: int):
        steps = max(abs(x1 - x0), abs(y1 - y0), 1)
        for i in range(steps + 1):
            yield i, (2 * (x0 * steps + (x1 - x0) * i) + steps) // (2 * steps), (2 * (y0 * steps + (y1 - y0) * i) + steps) // (2 * steps)


def register(spark: SparkSession) -> None:
    """line_points(x0, y0, x1, y1) for SQL."""
    spark.udtf.register("line_points", udtf(LinePoints, returnType="at bigint, x bigint, y bigint"))
