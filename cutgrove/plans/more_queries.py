"""Scalar combiners, lifted energies, line features and projections with offsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cutgrove.functions import energies as en
from cutgrove.operators import features, graphs, rag

from .common import WITH_EDGES, WITH_FACES, WITH_PAIRS, WITH_VOX, edges, vox

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("sc8_lifted_energy", WITH_EDGES + """, e2 AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), l AS (SELECT DISTINCT a.u, b.v FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u < b.v AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = a.u AND e.v = b.v)),
  zs AS (SELECT seg, max(z) AS z FROM vox GROUP BY seg), p AS (SELECT l.u, l.v, 0.001 + 0.998 * (((l.u * 7 + l.v) % 97 + 1) / 99.0) AS q, abs(a.z - b.z) AS dz FROM l JOIN zs a ON l.u = a.seg JOIN zs b ON l.v = b.seg)
  SELECT u, v, round((ln((1 - q) / q) + ln(0.6 / 0.4)) / 2.0 / (dz + 1), 6) AS e FROM p""")
def sc8(spark, d):
    far = graphs.k_hop(edges(spark, d).select("u", "v"), 2).select("u", "v")
    z = vox(spark, d).groupBy("seg").agg(F.max("z").alias("z"))
    p = ((F.col("u") * 7 + F.col("v")) % 97 + 1) / 99.0
    return rag.ends(far, z, ("z",)).select("u", "v", F.round(en.energy(p, 0.4) / 2.0 / (F.abs(F.col("z_u") - F.col("z_v")) + 1), 6).alias("e"))


@query("sc13_pixel_cut", WITH_PAIRS + "SELECT x, y, z, axis, greatest(pm, next_pm) AS cut FROM pairs WHERE axis < 2")
def sc13(spark, d):
    return rag.voxel_pairs(vox(spark, d)).filter("axis < 2").select("x", "y", "z", "axis", F.greatest("pm", "next_pm").alias("cut"))


@query("sc17_norms", WITH_EDGES + "SELECT e.u, e.v, round(sqrt((CAST(a.sx AS DOUBLE) / a.n - CAST(b.sx AS DOUBLE) / b.n) ** 2 + (CAST(a.sy AS DOUBLE) / a.n - CAST(b.sy AS DOUBLE) / b.n) ** 2), 6) AS dist FROM edges e JOIN nodes a ON e.u = a.seg JOIN nodes b ON e.v = b.seg")
def sc17(spark, d):
    r = rag.ends(edges(spark, d).select("u", "v"), rag.node_stats(vox(spark, d)), ("sx", "sy", "n"))
    dx, dy = (F.col(f"s{c}_u").cast("double") / F.col("n_u") - F.col(f"s{c}_v").cast("double") / F.col("n_v") for c in "xy")
    return r.select("u", "v", F.round(F.sqrt(dx * dx + dy * dy), 6).alias("dist"))


@query("sc18_pair_combiners", WITH_EDGES + "SELECT e.u, e.v, least(a.high, b.high) AS lo, greatest(a.high, b.high) AS hi, abs(a.high - b.high) AS diff, a.high + b.high AS total FROM edges e JOIN nodes a ON e.u = a.seg JOIN nodes b ON e.v = b.seg")
def sc18(spark, d):
    r = rag.ends(edges(spark, d).select("u", "v"), rag.node_stats(vox(spark, d)), ("high",))
    a, b = F.col("high_u"), F.col("high_v")
    return r.select("u", "v", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.abs(a - b).alias("diff"), (a + b).alias("total"))


@query("ag15_lifted_gt", WITH_EDGES + ", e2 AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), l AS (SELECT DISTINCT a.u, b.v FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u < b.v AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = a.u AND e.v = b.v)) SELECT l.u, l.v, CASE WHEN a.gt <> b.gt THEN 1 ELSE 0 END AS label FROM l JOIN node_gt a ON l.u = a.seg JOIN node_gt b ON l.v = b.seg")
def ag15(spark, d):
    far = graphs.k_hop(edges(spark, d).select("u", "v"), 2).select("u", "v")
    return rag.ends(far, rag.node_gt(vox(spark, d)), ("gt",)).select("u", "v", (F.col("gt_u") != F.col("gt_v")).cast("int").alias("label"))


@query("ag20_line_features", WITH_EDGES + """, c AS (SELECT seg, sx / n AS cx, sy / n AS cy, CAST(round(sz / n) AS BIGINT) AS z FROM nodes),
  l AS (SELECT e.u, e.v, a.cx AS xu, a.cy AS yu, b.cx AS xv, b.cy AS yv, a.z, CAST(ceil(greatest(abs(a.cx - b.cx), abs(a.cy - b.cy), 1.0)) AS BIGINT) AS m FROM edges e JOIN c a ON a.seg = e.u JOIN c b ON b.seg = e.v WHERE e.kind = 1),
  s AS (SELECT *, unnest(range(0, m + 1)) AS i FROM l), p AS (SELECT DISTINCT u, v, CAST(round(xu + (xv - xu) * i / m) AS BIGINT) AS x, CAST(round(yu + (yv - yu) * i / m) AS BIGINT) AS y, z FROM s)
  SELECT u, v, count(*) AS n, avg(raw) AS mean, sum(raw)::BIGINT AS total, min(raw) AS low, max(raw) AS high, sum(raw * raw)::DOUBLE / count(*) AS m2, sum(raw * raw * raw)::DOUBLE / count(*) AS m3,
    round(quantile_cont(raw, 0.1), 3) AS q10, round(quantile_cont(raw, 0.25), 3) AS q25, round(quantile_cont(raw, 0.5), 3) AS q50, round(quantile_cont(raw, 0.75), 3) AS q75, round(quantile_cont(raw, 0.9), 3) AS q90
  FROM p JOIN vox USING (x, y, z) GROUP BY u, v""")
def ag20(spark, d):
    """Eleven statistics of raw, raw moments among them, along the straight in-plane line between the centres of two touching regions."""
    v = vox(spark, d)
    e = edges(spark, d).filter("kind = 1").select("u", "v")
    centre = rag.node_stats(v).select("seg", (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"), F.round(F.col("sz") / F.col("n")).cast("long").alias("z"))
    ends = rag.ends(e, centre, ("cx", "cy", "z"))
    steps = F.ceil(F.greatest(F.abs(F.col("cx_u") - F.col("cx_v")), F.abs(F.col("cy_u") - F.col("cy_v")), F.lit(1.0))).cast("int")
    at = lambda c: F.round(F.col(f"{c}_u") + (F.col(f"{c}_v") - F.col(f"{c}_u")) * F.col("i") / F.col("steps")).cast("long")
    points = ends.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps")))).select("u", "v", at("cx").alias("x"), at("cy").alias("y"), F.col("z_u").alias("z")).distinct()
    return points.join(v.select("x", "y", "z", "raw"), ["x", "y", "z"]).groupBy("u", "v").agg(F.count("*").alias("n"), F.avg("raw").alias("mean"), F.sum("raw").alias("total"), F.min("raw").alias("low"), F.max("raw").alias("high"), (F.sum(F.col("raw") * F.col("raw")) / F.count("*")).alias("m2"), (F.sum(F.col("raw") * F.col("raw") * F.col("raw")) / F.count("*")).alias("m3"), *(F.round(F.percentile("raw", q), 3).alias(f"q{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)))


@query("wf9_project_resolved", WITH_VOX + ", r AS (SELECT DISTINCT seg, gt % 3 AS obj, seg % 4 AS part FROM vox WHERE gt % 3 < 2), o AS (SELECT obj, max(part) + 1 AS m FROM r GROUP BY obj), f AS (SELECT obj, 100000 + sum(m) OVER (ORDER BY obj) - m AS off FROM o) SELECT x, y, z, CAST(CASE WHEN gt % 3 < 2 THEN off + seg % 4 ELSE seg END AS BIGINT) AS label FROM vox LEFT JOIN f ON gt % 3 = obj")
def wf9(spark, d):
    """Resolved objects get the labels of their parts after an offset per object; other voxels keep theirs."""
    v = vox(spark, d).withColumn("obj", F.col("gt") % 3)
    parts = v.filter("obj < 2").groupBy("obj").agg((F.max(F.col("seg") % 4) + 1).alias("m"))
    off = parts.select("obj", (100000 + F.sum("m").over(Window.orderBy("obj")) - F.col("m")).alias("off"))
    return v.join(F.broadcast(off), "obj", "left").select("x", "y", "z", F.coalesce(F.col("off") + F.col("seg") % 4, "seg").alias("label"))  # one row an object class


@query("ag9_edge_parts", WITH_FACES.replace("WITH ", "WITH RECURSIVE ", 1) + """, d AS (SELECT DISTINCT u, v, x, y, z FROM faces), r AS (SELECT u, v, x, y, z, z * 100 + y * 10 + x AS k FROM d UNION SELECT d.u, d.v, d.x, d.y, d.z, r.k FROM r JOIN d ON d.u = r.u AND d.v = r.v AND abs(d.x - r.x) <= 1 AND abs(d.y - r.y) <= 1 AND abs(d.z - r.z) <= 1 AND r.k < d.z * 100 + d.y * 10 + d.x), m AS (SELECT u, v, x, y, z, min(k) AS k FROM r GROUP BY ALL)
  SELECT u, v, count(DISTINCT k) AS parts FROM m GROUP BY u, v""")
def ag9(spark, d):
    """Number of 26-connected pieces of each boundary."""
    return features.edge_parts(rag.faces(vox(spark, d)))
