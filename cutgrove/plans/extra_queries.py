"""Named functions, batches of windows, features along lines between borders, and features of perturbed problems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cutgrove.functions import registry as functions
from cutgrove.operators import features, images, rag, workflows
from cutgrove.session import cut

from .common import WITH_EDGES, WITH_VOX, edges, vox
from .feature_queries import LIFTED, lifted

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("fn_line_points", WITH_VOX + ", l AS (SELECT DISTINCT x, y, seg % 10 AS x1, gt % 10 AS y1 FROM vox), s AS (SELECT *, greatest(abs(x1 - x), abs(y1 - y), 1) AS n FROM l) SELECT x AS x0, y AS y0, x1, y1, i AS at, (2 * (x * n + (x1 - x) * i) + n) // (2 * n) AS px, (2 * (y * n + (y1 - y) * i) + n) // (2 * n) AS py FROM s, range(20) t(i) WHERE i <= n")
def fn_line_points(spark, d):
    """Points of all lines from a pixel to a point that its labels name, by built-in functions."""
    lines = vox(spark, d).select(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("seg") % 10).alias("x1"), (F.col("gt") % 10).alias("y1")).distinct()
    return functions.line_points(lines)


@query("fn_named_aggregates", WITH_VOX + "SELECT seg, CAST(sum(raw) AS BIGINT) AS total, max(raw) AS high, count(raw) AS n, quantile_cont(raw, 0.5) AS q50 FROM vox GROUP BY seg")
def fn_aggregates(spark, d):
    """Aggregates by their names."""
    return vox(spark, d).groupBy("seg").agg(*functions.aggregate(F.col("raw"), ("total", "high", "n", "q50")))


@query("wn6_zipped_batches", WITH_VOX + ", w AS (SELECT x0, y0, z, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(pm) AS BIGINT) AS pm FROM vox, (SELECT unnest([0, 2, 4, 6]) AS x0), (SELECT unnest([0, 2, 4, 6]) AS y0) WHERE x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4 GROUP BY ALL), i AS (SELECT *, z * 16 + (y0 // 2) * 4 + x0 // 2 AS num FROM w) SELECT num // 8 AS batch, num % 8 AS place, raw, pm FROM i")
def wn6_zipped(spark, d):
    """Windows of two inputs in batches of eight, joined on the window's number."""
    w = images.sliding_windows(vox(spark, d), size=4, stride=2, extent=10)
    at = F.col("z") * 16 + F.expr("y0 div 2") * 4 + F.expr("x0 div 2")
    one = lambda c: w.groupBy(at.alias("at")).agg(F.sum(c).alias(c))
    return one("raw").join(one("pm"), "at").select(F.expr("at div 8").alias("batch"), (F.col("at") % 8).alias("place"), "raw", "pm")


@query("wn6_woven_batches", WITH_VOX + ", a AS (SELECT 0 AS source, z AS k, CAST(sum(raw) AS BIGINT) AS v FROM vox GROUP BY z UNION ALL SELECT 1, z, CAST(sum(pm) AS BIGINT) FROM vox GROUP BY z) SELECT k * 2 + source AS at, source, v FROM a")
def wn6_woven(spark, d):
    """Two sequences in turns: the first of each, the second of each, and so on."""
    one = lambda n, c: vox(spark, d).groupBy(F.col("z").alias("k")).agg(F.sum(c).alias("v")).withColumn("source", F.lit(n))
    return one(0, "raw").unionByName(one(1, "pm")).select((F.col("k") * 2 + F.col("source")).alias("at"), "source", "v")


@query("ag21_border_lines")
def ag21(spark, d):
    """Distances between the borders of lifted pairs of one slice, and statistics along the lines of the closest ones."""
    v = vox(spark, d)
    z = v.groupBy("seg").agg(F.max("z").alias("z"))
    pairs = rag.ends(lifted(spark, d), z, ("z",)).filter("z_u = z_v").select("u", "v")
    return features.border_lines(pairs, v, "raw", 5)


@query("ag21_border_facts", WITH_EDGES + LIFTED + ", zs AS (SELECT seg, max(z) AS z FROM vox GROUP BY seg), p AS (SELECT l.u, l.v FROM lifted l JOIN zs a ON a.seg = l.u JOIN zs b ON b.seg = l.v WHERE a.z = b.z) SELECT p.u, p.v, CAST(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS BIGINT) AS least2 FROM p JOIN vox a ON a.seg = p.u JOIN vox b ON b.seg = p.v GROUP BY p.u, p.v")
def ag21_facts(spark, d):
    """The least of these distances is the least between any voxels of the two."""
    return ag21(spark, d).select("u", "v", F.round(F.col("dist_low") * F.col("dist_low")).cast("long").alias("least2"))


@query("mc27_perturbed")
def mc27(spark, d):
    """How often solutions of problems with noise separate a lifted pair."""
    p = cut(edges(spark, d).withColumn("p", F.col("s") / (F.col("n") * 200000.0)))
    return workflows.perturbed(p, lifted(spark, d), 8, 0.5)


@query("mc27_facts", WITH_EDGES + LIFTED + "SELECT count(*) AS pairs, 0 AS odd FROM lifted")
def mc27_facts(spark, d):
    """A share between 0 and 1 for every lifted pair."""
    return mc27(spark, d).agg(F.count("*").alias("pairs"), F.count(F.when((F.col("share") < 0) | (F.col("share") > 1), 1)).cast("int").alias("odd"))


@query("wn4_path_steps", WITH_VOX + "SELECT seg, z, y, x, row_number() OVER w AS at, round(sqrt(coalesce((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + 25 * (z - lag(z) OVER w) ** 2, 0)), 6) AS step FROM vox WINDOW w AS (PARTITION BY seg ORDER BY z, y, x)")
def wn4(spark, d):
    """Consecutive differences along every segment's voxels in order, the step of each and its place."""
    w = Window.partitionBy("seg").orderBy("z", "y", "x")
    apart = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) * s for c, s in (("x", 1), ("y", 1), ("z", 25))), F.lit(0))
    return vox(spark, d).select("seg", "z", "y", "x", F.row_number().over(w).cast("long").alias("at"), F.round(F.sqrt(F.coalesce(apart, F.lit(0)).cast("double")), 6).alias("step"))


@query("wn7_context_stack", WITH_VOX + "SELECT x, y, z, coalesce(lag(raw) OVER w, 0) AS below, raw AS here, coalesce(lead(raw) OVER w, 0) AS above FROM vox WINDOW w AS (PARTITION BY x, y ORDER BY z)")
def wn7(spark, d):
    """Every voxel with the ones below and above it as channels, 0 beyond the volume."""
    w = Window.partitionBy("x", "y").orderBy("z")
    return vox(spark, d).select("x", "y", "z", F.coalesce(F.lag("raw").over(w), F.lit(0)).alias("below"), F.col("raw").alias("here"), F.coalesce(F.lead("raw").over(w), F.lit(0)).alias("above"))


@query("gr18_lift_values_3", WITH_EDGES + """, e2 AS (SELECT u, v, n FROM edges UNION ALL SELECT v, u, n FROM edges), p2 AS (SELECT a.u, b.v, min(a.n + b.n) AS c FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u <> b.v GROUP BY a.u, b.v), p3 AS (SELECT a.u, b.v, min(a.c + b.n) AS c FROM p2 a JOIN e2 b ON a.v = b.u WHERE a.u <> b.v GROUP BY a.u, b.v),
  p AS (SELECT u, v, min(c) AS c FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE u < v GROUP BY u, v) SELECT u, v, n AS cost FROM edges UNION ALL SELECT u, v, c FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = p.u AND e.v = p.v)""")
def gr18(spark, d):
    """Costs of lifted pairs up to three hops: the cheapest path of so many edges; edges keep their own."""
    from cutgrove.operators import graphs

    return graphs.lifted_distances(edges(spark, d).select("u", "v", F.col("n").alias("cost")), 3)
