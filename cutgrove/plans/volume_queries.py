"""Sources, per-voxel maps, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cutgrove.operators import grids, images, rag
from cutgrove.operators.relabel import consecutive, dense_ids, running_offsets
from cutgrove.sources import volumes

from .common import WITH_PAIRS, WITH_VOX, bank_names, bank_sql, vox

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("src1_voxels", WITH_VOX + "SELECT x, y, z, raw, pm FROM vox")
def src1(spark, d):
    return vox(spark, d).select("x", "y", "z", "raw", "pm")


@query("src2_extra_input", WITH_VOX + ", extra AS (SELECT x, y, z, raw * 2 + 1 AS inp FROM vox) SELECT x, y, z, raw, inp FROM vox JOIN extra USING (x, y, z)")
def src2(spark, d):
    v = vox(spark, d)
    return v.select("x", "y", "z", "raw").join(v.select("x", "y", "z", (F.col("raw") * 2 + 1).alias("inp")), ["x", "y", "z"])


@query("src3_relabel", WITH_VOX + "SELECT DISTINCT seg * 3 AS seg, CAST(dense_rank() OVER (ORDER BY seg * 3) - 1 AS BIGINT) AS new_label FROM vox")
def src3(spark, d):
    return dense_ids(vox(spark, d).select((F.col("seg") * 3).alias("seg")), "seg")


@query("src4_ground_truth", WITH_VOX + "SELECT gt, count(*) AS n FROM vox GROUP BY gt")
def src4(spark, d):
    return vox(spark, d).groupBy("gt").agg(F.count("*").alias("n"))


@query("src5_mask", WITH_VOX + "SELECT x, y, z, CASE WHEN raw > 5000 THEN seg ELSE 0 END AS seg FROM vox")
def src5(spark, d):
    return volumes.mask_labels(vox(spark, d), F.col("raw") > 5000).select("x", "y", "z", "seg")


@query("prj1_normalize", WITH_VOX + "SELECT x, y, z, CASE WHEN (SELECT max(pm) FROM vox) > 1 THEN pm / CAST((SELECT max(pm) FROM vox) AS DOUBLE) ELSE pm END AS p FROM vox")
def prj1(spark, d):
    v = vox(spark, d)
    top = v.agg(F.max("pm")).first()[0] or 1
    return v.select("x", "y", "z", (F.col("pm") / float(top) if top > 1 else F.col("pm").cast("double")).alias("p"))


@query("prj2_slice_offset", WITH_VOX + """, r AS (SELECT DISTINCT z, seg, dense_rank() OVER (PARTITION BY z ORDER BY seg) AS k FROM vox),
  c AS (SELECT z, max(k) AS m FROM r GROUP BY z), o AS (SELECT z, sum(m) OVER (ORDER BY z) - m AS off FROM c)
  SELECT z, seg, CAST(k + off AS BIGINT) AS label FROM r JOIN o USING (z)""")
def prj2(spark, d):
    r = vox(spark, d).select("z", "seg").distinct().withColumn("k", F.row_number().over(Window.partitionBy("z").orderBy("seg")))
    off = running_offsets(r.groupBy("z").agg(F.max("k").alias("m")), "z", "m")
    return r.join(off, "z").select("z", "seg", (F.col("k") + F.col("off")).cast("long").alias("label"))


@query("prj3_replace", WITH_VOX + ", m AS (SELECT DISTINCT seg, seg % 7 AS to_label FROM vox WHERE seg % 2 = 0) SELECT x, y, z, coalesce(to_label, seg) AS label FROM vox LEFT JOIN m USING (seg)")
def prj3(spark, d):
    v = vox(spark, d)
    m = v.filter("seg % 2 = 0").select("seg", (F.col("seg") % 7).alias("to_label")).distinct()
    return v.join(m, "seg", "left").select("x", "y", "z", F.coalesce("to_label", "seg").alias("label"))


@query("prj8_edge_volume", WITH_PAIRS + """, f AS (SELECT *, (least(seg, next_seg) + greatest(seg, next_seg)) % 2 + 1 AS label FROM pairs WHERE seg <> next_seg),
  s AS (SELECT x, y, z, label FROM f UNION ALL SELECT x + CASE axis WHEN 0 THEN 1 ELSE 0 END, y + CASE axis WHEN 1 THEN 1 ELSE 0 END, z + CASE axis WHEN 2 THEN 1 ELSE 0 END, label FROM f)
  SELECT x, y, z, max(label) AS label FROM s GROUP BY x, y, z""")
def prj8(spark, d):
    f = rag.faces(vox(spark, d)).withColumn("label", (F.col("u") + F.col("v")) % 2 + 1)
    return images.paint_faces(f)


@query("prj9_in_plane_edges", WITH_PAIRS + "SELECT x, y, z, least(seg, next_seg) AS u, greatest(seg, next_seg) AS v FROM pairs WHERE seg <> next_seg AND axis < 2")
def prj9(spark, d):
    return rag.faces(vox(spark, d)).filter("axis < 2").select("x", "y", "z", "u", "v")


@query("prj10_skip_volume", WITH_VOX + "SELECT a.x, a.y, a.z, a.seg AS u, b.seg AS v FROM vox a JOIN vox b ON a.x = b.x AND a.y = b.y AND b.z = a.z + 2")
def prj10(spark, d):
    v = vox(spark, d)
    up = v.select("x", "y", (F.col("z") - 2).alias("z"), F.col("seg").alias("v"))
    return v.select("x", "y", "z", F.col("seg").alias("u")).join(up, ["x", "y", "z"])


@query("prj11_boundary", WITH_PAIRS + """, b AS (SELECT x, y, z FROM pairs WHERE seg <> next_seg UNION SELECT x + CASE axis WHEN 0 THEN 1 ELSE 0 END, y + CASE axis WHEN 1 THEN 1 ELSE 0 END, z + CASE axis WHEN 2 THEN 1 ELSE 0 END FROM pairs WHERE seg <> next_seg)
  SELECT v.x, v.y, v.z, CASE WHEN b.x IS NULL THEN 255 ELSE 0 END AS val FROM vox v LEFT JOIN b ON v.x = b.x AND v.y = b.y AND v.z = b.z""")
def prj11(spark, d):
    return images.boundary_image(vox(spark, d))


@query("prj12_class_labels", WITH_VOX + "SELECT x, y, z, CASE WHEN seg <> 0 THEN 1 ELSE 0 END AS label FROM vox")
def prj12(spark, d):
    return vox(spark, d).select("x", "y", "z", (F.col("seg") != 0).cast("int").alias("label"))


@query("prj13_flatten", WITH_VOX + "SELECT z, x + y * 10 AS i, seg FROM vox")
def prj13(spark, d):
    return vox(spark, d).select("z", (F.col("x") + F.col("y") * 10).alias("i"), "seg")


@query("prj14_cutout", WITH_VOX + ", c AS (SELECT * FROM vox WHERE x >= 2 AND x < 8 AND y >= 1 AND y < 9 AND z >= 2 AND z < 60) SELECT x, y, z, CAST(dense_rank() OVER (ORDER BY seg) - 1 AS BIGINT) AS label FROM c")
def prj14(spark, d):
    return consecutive(volumes.cutout(vox(spark, d), (2, 8, 1, 9, 2, 60)), "seg").select("x", "y", "z", F.col("new_label").alias("label"))


@query("prj15_inverse_cutout", WITH_VOX + "SELECT x, y, z, CASE WHEN x >= 2 AND x < 8 AND y >= 1 AND y < 9 AND z >= 2 AND z < 60 THEN 0 ELSE seg + 1 END AS label FROM vox")
def prj15(spark, d):
    return volumes.inverse_cutout(vox(spark, d), (2, 8, 1, 9, 2, 60)).select("x", "y", "z", F.col("seg").alias("label"))


@query("prj20_small", WITH_VOX + """, s AS (SELECT seg, count(*) AS n FROM vox GROUP BY seg), k AS (SELECT seg, dense_rank() OVER (ORDER BY seg) AS label FROM s WHERE n >= 16)
  SELECT seg, CAST(coalesce(label, 0) AS BIGINT) AS label FROM s LEFT JOIN k USING (seg)""")
def prj20(spark, d):
    return images.drop_small(vox(spark, d), 16)


@query("prj21_size_between", WITH_VOX + ", s AS (SELECT seg, count(*) AS n FROM vox GROUP BY seg) SELECT x, y, z, CASE WHEN n BETWEEN 14 AND 18 THEN 1 ELSE 0 END AS label FROM vox JOIN s USING (seg)")
def prj21(spark, d):
    v = vox(spark, d)
    sizes = v.groupBy("seg").agg(F.count("*").alias("n"))
    return v.join(sizes, "seg").select("x", "y", "z", F.col("n").between(14, 18).cast("int").alias("label"))


@query("prj22_standardise", WITH_VOX + "SELECT x, y, z, round((raw - avg(raw) OVER ()) / (stddev_pop(raw) OVER () + 0.000001), 6) AS v FROM vox")
def prj22(spark, d):
    v = vox(spark, d)
    mean, dev = v.agg(F.avg("raw"), F.stddev_pop("raw")).first()
    return v.select("x", "y", "z", F.round((F.col("raw") - F.lit(mean)) / F.lit((dev or 0.0) + 0.000001), 6).alias("v"))


@query("ag16_bincount", WITH_VOX + "SELECT seg, count(*) AS n FROM vox GROUP BY seg")
def ag16(spark, d):
    return vox(spark, d).groupBy("seg").agg(F.count("*").alias("n"))


@query("ag10_node_z", WITH_VOX + "SELECT seg, max(z) AS z FROM vox GROUP BY seg")
def ag10(spark, d):
    return vox(spark, d).groupBy("seg").agg(F.max("z").alias("z"))


@query("ag17_slice_stats", WITH_VOX + ", c AS (SELECT z, count(DISTINCT seg) AS nseg FROM vox GROUP BY z), m AS (SELECT min(nseg) AS lo, max(nseg) AS hi FROM c) SELECT i, CAST(lo + (hi - lo) * i / 16.0 AS DOUBLE) AS edge FROM m, range(17) t(i)")
def ag17(spark, d):
    c = vox(spark, d).groupBy("z").agg(F.countDistinct("seg").alias("nseg")).agg(F.min("nseg").alias("lo"), F.max("nseg").alias("hi"))
    return c.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i")).select(F.col("i").cast("long").alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 16.0).cast("double").alias("edge"))


@query("ag18_defects", WITH_VOX + ", c AS (SELECT z, count(DISTINCT CASE WHEN raw > 40000 THEN seg END) AS nseg FROM vox GROUP BY z), m AS (SELECT min(nseg) + (max(nseg) - min(nseg)) * 2 / 4.0 AS t FROM c) SELECT z, nseg, CASE WHEN nseg < t THEN 1 ELSE 0 END AS defect FROM c, m")
def ag18(spark, d):
    c = vox(spark, d).groupBy("z").agg(F.countDistinct(F.when(F.col("raw") > 40000, F.col("seg"))).alias("nseg"))
    lo, hi = c.agg(F.min("nseg"), F.max("nseg")).first()
    return c.select("z", "nseg", (F.col("nseg") < lo + (hi - lo) * 2 / 4.0).cast("int").alias("defect"))


@query("ag19_defect_nodes", WITH_VOX + "SELECT DISTINCT z, seg FROM vox WHERE z IN (3, 4, 7) AND seg <> 0")
def ag19(spark, d):
    return vox(spark, d).filter(F.col("z").isin(3, 4, 7) & (F.col("seg") != 0)).select("z", "seg").distinct()


@query("ag25_path_length", WITH_VOX + ", p AS (SELECT seg, x, y, z, row_number() OVER (PARTITION BY seg ORDER BY z, y, x) AS i FROM vox) SELECT a.seg AS obj, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 25 * (a.z - b.z) ** 2)), 6) AS len FROM p a JOIN p b ON a.seg = b.seg AND b.i = a.i - 1 GROUP BY a.seg")
def ag25(spark, d):
    w = Window.partitionBy("seg").orderBy("z", "y", "x")
    step = [(F.col(c) - F.lag(c).over(w)) * s for c, s in (("x", 1), ("y", 1), ("z", 5))]
    return vox(spark, d).select("seg", F.sqrt(sum((s * s for s in step), F.lit(0.0))).alias("s")).filter("s is not null").groupBy(F.col("seg").alias("obj")).agg(F.round(F.sum("s"), 6).alias("len"))


@query("ag24_path_features", WITH_VOX + "SELECT seg AS path_id, avg(raw) AS mean, CAST(sum(raw) AS BIGINT) AS total, max(raw) AS high, min(raw) AS low, round(var_pop(raw), 3) AS var FROM vox WHERE y = x GROUP BY seg")
def ag24(spark, d):
    return vox(spark, d).filter("y = x").groupBy(F.col("seg").alias("path_id")).agg(F.avg("raw").alias("mean"), F.sum("raw").alias("total"), F.max("raw").alias("high"), F.min("raw").alias("low"), F.round(F.var_pop("raw"), 3).alias("var"))


@query("wn1_neighbour", WITH_PAIRS + "SELECT x, y, z, axis, next_seg FROM pairs")
def wn1(spark, d):
    return rag.voxel_pairs(vox(spark, d)).select("x", "y", "z", "axis", "next_seg")


@query("wn2_islands", WITH_VOX + ", d AS (SELECT DISTINCT z FROM vox WHERE z % 5 IN (0, 1, 3)), r AS (SELECT z, z - row_number() OVER (ORDER BY z) AS k FROM d) SELECT min(z) AS first_z, max(z) AS last_z, count(*) AS n FROM r GROUP BY k")
def wn2(spark, d):
    bad = vox(spark, d).filter((F.col("z") % 5).isin(0, 1, 3)).select("z").distinct()
    # a slice's place among the bad ones, taken from it, is one number for a whole run
    place = running_offsets(bad.withColumn("one", F.lit(1)), "z", "one")
    return place.withColumn("k", F.col("z") - F.col("off")).groupBy("k").agg(F.min("z").alias("first_z"), F.max("z").alias("last_z"), F.count("*").alias("n")).drop("k")


@query("wn3_running_offset", WITH_VOX + ", c AS (SELECT z, count(DISTINCT seg) AS k FROM vox GROUP BY z) SELECT z, CAST(sum(k) OVER (ORDER BY z) - k AS BIGINT) AS off FROM c")
def wn3(spark, d):
    c = vox(spark, d).groupBy("z").agg(F.countDistinct("seg").alias("k"))
    return running_offsets(c, "z", "k")


@query("wn6_windows", WITH_VOX + "SELECT x0, y0, z, CAST(sum(raw) AS BIGINT) AS total, count(*) AS n FROM vox, (SELECT unnest([0, 2, 4, 6]) AS x0), (SELECT unnest([0, 2, 4, 6]) AS y0) WHERE x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4 GROUP BY ALL")
def wn6(spark, d):
    return images.sliding_windows(vox(spark, d), size=4, stride=2, extent=10).groupBy("x0", "y0", "z").agg(F.sum("raw").alias("total"), F.count("*").alias("n"))


@query("wn7_z_context", WITH_VOX + "SELECT a.z, a.x % 2 AS px, a.y % 2 AS py, b.z - a.z AS dz, CAST(sum(b.raw) AS BIGINT) AS total FROM vox a JOIN vox b ON a.x = b.x AND a.y = b.y AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY ALL")
def wn7(spark, d):
    v = vox(spark, d)
    moved = v.select("x", "y", "raw", F.col("z").alias("zb"), F.explode(F.sequence(F.col("z") - 1, F.col("z") + 1)).alias("z"))
    planes = v.select("x", "y", "z")
    return moved.join(planes, ["x", "y", "z"]).groupBy("z", (F.col("x") % 2).alias("px"), (F.col("y") % 2).alias("py"), (F.col("zb") - F.col("z")).alias("dz")).agg(F.sum("raw").alias("total"))


@query("wn8_gradient", WITH_VOX + "SELECT x, y, z, (lead(raw) OVER w - lag(raw) OVER w) / 2.0 AS g FROM vox WINDOW w AS (PARTITION BY y, z ORDER BY x)")
def wn8(spark, d):
    w = Window.partitionBy("y", "z").orderBy("x")
    return vox(spark, d).select("x", "y", "z", ((F.lead("raw").over(w) - F.lag("raw").over(w)) / F.lit(2.0)).alias("g"))


@query("so3_closest", WITH_VOX + ", r AS (SELECT seg, x, y, raw, row_number() OVER (PARTITION BY seg ORDER BY raw, x, y) AS k FROM vox) SELECT seg, x, y, raw, k FROM r WHERE k <= 3")
def so3(spark, d):
    k = F.row_number().over(Window.partitionBy("seg").orderBy("raw", "x", "y"))
    return vox(spark, d).select("seg", "x", "y", "raw", k.cast("long").alias("k")).filter("k <= 3")


@query("st1_union", WITH_VOX + "SELECT 'a' AS ds, seg, count(*) AS n FROM vox GROUP BY seg UNION ALL SELECT 'b', gt, count(*) FROM vox GROUP BY gt")
def st1(spark, d):
    v = vox(spark, d)
    return v.groupBy("seg").agg(F.count("*").alias("n")).select(F.lit("a").alias("ds"), "seg", "n").unionByName(v.groupBy(F.col("gt").alias("seg")).agg(F.count("*").alias("n")).select(F.lit("b").alias("ds"), "seg", "n"))


@query("st2_unique_rows", WITH_VOX + "SELECT seg, gt, min(z * 100 + y * 10 + x) AS first_index FROM vox GROUP BY seg, gt")
def st2(spark, d):
    return vox(spark, d).groupBy("seg", "gt").agg(F.min(F.col("z") * 100 + F.col("y") * 10 + F.col("x")).alias("first_index"))


@query("st3_except", WITH_VOX + "SELECT DISTINCT seg FROM vox EXCEPT SELECT seg FROM vox WHERE raw > 45000")
def st3(spark, d):
    v = vox(spark, d)
    return v.select("seg").distinct().join(v.filter("raw > 45000").select("seg").distinct(), "seg", "left_anti")


@query("im1_smooth", WITH_VOX + "SELECT x, y, z, lag(raw) OVER w + 2 * raw + lead(raw) OVER w AS v FROM vox WINDOW w AS (PARTITION BY y, z ORDER BY x)")
def im1(spark, d):
    w = Window.partitionBy("y", "z").orderBy("x")
    return vox(spark, d).select("x", "y", "z", (F.lag("raw").over(w) + 2 * F.col("raw") + F.lead("raw").over(w)).alias("v"))


_bank = ", ".join(f"round(max({kind}) FILTER (scale = '{s}'), 6) + 0.0 AS {name}" for name, kind, s in bank_names(images.SIGMAS))


@query("im1_filter_bank", WITH_VOX + ", " + bank_sql("raw", images.SIGMAS) + f" SELECT x, y, z, {_bank} FROM fb GROUP BY x, y, z")
def im1_bank(spark, d):
    """Every filter at every scale in every slice, to six digits."""
    bank = images.filter_bank(vox(spark, d), "raw")
    return bank.select("x", "y", "z", *((F.round(c, 6) + 0.0).alias(c) for c in bank.columns if c not in ("x", "y", "z")))


@query("im3_distance_transform", WITH_PAIRS + """, b AS (SELECT z, x, y FROM pairs WHERE seg <> next_seg AND axis < 2 UNION SELECT z, x + CASE axis WHEN 0 THEN 1 ELSE 0 END, y + CASE axis WHEN 1 THEN 1 ELSE 0 END FROM pairs WHERE seg <> next_seg AND axis < 2)
  SELECT v.x, v.y, v.z, CAST(min((v.x - b.x) ** 2 + (v.y - b.y) ** 2) AS BIGINT) AS d2 FROM vox v JOIN b ON v.z = b.z GROUP BY v.x, v.y, v.z""")
def im3(spark, d):
    return grids.edge_distances(vox(spark, d))


@query("im14_border_contacts", WITH_VOX + ", f AS (SELECT 'x0' AS face, seg, y AS a, z AS b FROM vox WHERE x = 0 UNION ALL SELECT 'x1', seg, y, z FROM vox WHERE x = 9 UNION ALL SELECT 'y0', seg, x, z FROM vox WHERE y = 0 UNION ALL SELECT 'y1', seg, x, z FROM vox WHERE y = 9) SELECT face, seg, count(*) AS n, min(a) AS a, min(b) AS b FROM f GROUP BY face, seg")
def im14(spark, d):
    return images.border_contacts(vox(spark, d), 9, 9).groupBy("face", "seg").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))


@query("im15_flip_rotate", WITH_VOX + "SELECT 'flip' AS op, 9 - x AS x, y, z, raw FROM vox UNION ALL SELECT 'rot90', y, 9 - x, z, raw FROM vox UNION ALL SELECT 'transpose', y, x, z, raw FROM vox")
def im15(spark, d):
    return images.augmented(vox(spark, d), 10)


@query("im16_average", WITH_VOX + ", p AS (SELECT x, y, z, raw, 1 AS w FROM vox UNION ALL SELECT x, y, z, raw + 2, 3 FROM vox WHERE x > 3) SELECT x, y, z, CAST(sum(raw * w) AS DOUBLE) / sum(w) AS v FROM p GROUP BY x, y, z")
def im16(spark, d):
    v = vox(spark, d).select("x", "y", "z", "raw", F.lit(1).alias("w"))
    return images.weighted_average(v.unionByName(v.filter("x > 3").withColumn("raw", F.col("raw") + 2).withColumn("w", F.lit(3))))


@query("im17_reflect_pad", WITH_VOX + "SELECT x, y, z, raw FROM vox UNION ALL SELECT -x, y, z, raw FROM vox WHERE x BETWEEN 1 AND 2 UNION ALL SELECT 18 - x, y, z, raw FROM vox WHERE x BETWEEN 7 AND 8")
def im17(spark, d):
    return images.reflect_pad_x(vox(spark, d), 10, 2)
