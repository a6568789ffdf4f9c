"""Edge and node features, energies, masks, overlaps, defects and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cutgrove.functions import energies as en
from cutgrove.operators import defects, metrics, rag
from cutgrove.operators.relabel import running_offsets
from cutgrove.sources.volumes import cutout

from .common import WITH_EDGES, WITH_FACES, WITH_VOX, edges, faces, vox

QUERIES, ORACLE = {}, {}
BAD = (3, 4, 7)


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def mean_p():
    """Mean boundary probability of an edge."""
    return F.col("s") / (F.col("n") * 200000.0)


@query("jn1_rag_edges", WITH_EDGES + "SELECT u, v, n, kind FROM edges")
def jn1(spark, d):
    return edges(spark, d).select("u", "v", "n", "kind")


@query("prj4_project", WITH_VOX + "SELECT x, y, z, seg % 5 + 1 AS label FROM vox")
def prj4(spark, d):
    v = vox(spark, d)
    labels = v.select("seg").distinct().select("seg", (F.col("seg") % 5 + 1).alias("label"))
    return v.join(labels, "seg").select("x", "y", "z", "label")


@query("prj5_node_gt", WITH_EDGES + "SELECT seg, gt, n FROM node_gt")
def prj5(spark, d):
    return rag.node_gt(vox(spark, d))


@query("prj5_seg_gt", WITH_EDGES + "SELECT x, y, z, g.gt FROM vox JOIN node_gt g USING (seg)")
def prj5b(spark, d):
    v = vox(spark, d)
    return v.drop("gt").join(rag.node_gt(v).drop("n"), "seg").select("x", "y", "z", "gt")


@query("prj16_learning_mask", WITH_EDGES + ", i AS (SELECT seg FROM node_gt WHERE gt % 5 = 0) SELECT u, v, n FROM edges WHERE kind = 1 AND u NOT IN (SELECT seg FROM i) AND v NOT IN (SELECT seg FROM i)")
def prj16(spark, d):
    ignored = rag.node_gt(vox(spark, d)).filter("gt % 5 = 0").select("seg")
    return defects.touching(edges(spark, d).filter("kind = 1"), ignored, "left_anti").select("u", "v", "n")


@query("prj18_ignore_mask", WITH_EDGES + """SELECT e.u, e.v, CASE WHEN ((a.gt IN (1, 4) OR b.gt IN (1, 4)) AND a.gt <> b.gt) OR (a.gt IN (2, 3) AND b.gt IN (2, 3)) THEN 1 ELSE 0 END AS masked
  FROM edges e JOIN node_gt a ON e.u = a.seg JOIN node_gt b ON e.v = b.seg""")
def prj18(spark, d):
    both = rag.ends(edges(spark, d), rag.node_gt(vox(spark, d)), ("gt",))
    split, merge = (1, 4), (2, 3)
    a, b = F.col("gt_u"), F.col("gt_v")
    masked = ((a.isin(*split) | b.isin(*split)) & (a != b)) | (a.isin(*merge) & b.isin(*merge))
    return both.select("u", "v", masked.cast("int").alias("masked"))


@query("prj19_matching_rows", WITH_EDGES + "SELECT u, v FROM edges WHERE u % 11 = 0 OR v % 11 = 0")
def prj19(spark, d):
    members = vox(spark, d).filter("seg % 11 = 0").select("seg").distinct()
    return defects.touching(edges(spark, d).select("u", "v"), members, "left_semi")


@query("jn2_gather", WITH_EDGES + "SELECT e.u, e.v, a.total AS total_u, b.total AS total_v FROM edges e JOIN nodes a ON e.u = a.seg JOIN nodes b ON e.v = b.seg")
def jn2(spark, d):
    return rag.ends(edges(spark, d), rag.node_stats(vox(spark, d)), ("total",)).select("u", "v", "total_u", "total_v")


@query("jn3_adjacent_edges", WITH_EDGES + ", s AS (SELECT u AS a, u, v FROM edges UNION ALL SELECT v, u, v FROM edges) SELECT x.u, x.v, count(*) AS n_adjacent FROM s x JOIN s y ON x.a = y.a AND (x.u <> y.u OR x.v <> y.v) GROUP BY x.u, x.v")
def jn3(spark, d):
    e = edges(spark, d).select("u", "v")
    deg = e.select(F.explode(F.array("u", "v")).alias("seg")).groupBy("seg").agg(F.count("*").alias("d"))
    # each end adds its other edges: counts by degree instead of a many-to-many join
    return rag.ends(e, deg, ("d",)).select("u", "v", (F.col("d_u") + F.col("d_v") - 2).alias("n_adjacent")).filter("n_adjacent > 0")


@query("jn4_row_equality", WITH_EDGES + ", r AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS i FROM edges) SELECT i, u, v FROM r WHERE (u + v) % 3 = 0")
def jn4(spark, d):
    e = edges(spark, d).select("u", "v")
    before = running_offsets(e.groupBy("u").agg(F.count("*").alias("c")), "u", "c").withColumnRenamed("off", "o")
    i = F.row_number().over(Window.partitionBy("u").orderBy("v")) - 1 + F.col("o")
    numbered = e.join(before, "u").select("u", "v", i.cast("long").alias("i"))
    return numbered.join(e.filter("(u + v) % 3 = 0"), ["u", "v"]).select("i", "u", "v")


@query("jn5_semi_defect", WITH_EDGES + ", b AS (SELECT DISTINCT seg FROM vox WHERE z IN (3, 4, 7)) SELECT u, v FROM edges WHERE EXISTS (SELECT 1 FROM b WHERE seg = u OR seg = v)")
def jn5(spark, d):
    return defects.touching(edges(spark, d).select("u", "v"), defects.defect_nodes(vox(spark, d), BAD), "left_semi")


@query("jn6_anti_defect", WITH_EDGES + ", b AS (SELECT DISTINCT seg FROM vox WHERE z IN (3, 4, 7)) SELECT u, v FROM edges WHERE NOT EXISTS (SELECT 1 FROM b WHERE seg = u OR seg = v)")
def jn6(spark, d):
    return defects.touching(edges(spark, d).select("u", "v"), defects.defect_nodes(vox(spark, d), BAD), "left_anti")


@query("jn7_sub_graph", WITH_EDGES + "SELECT e.u, e.v FROM edges e JOIN node_gt a ON e.u = a.seg JOIN node_gt b ON e.v = b.seg WHERE a.gt = 3 AND b.gt = 3")
def jn7(spark, d):
    inside = rag.node_gt(vox(spark, d)).filter("gt = 3").select("seg")
    e = edges(spark, d).select("u", "v")
    for side in "uv":
        e = e.join(inside.withColumnRenamed("seg", side), side, "left_semi")
    return e.select("u", "v")


OVERLAP = """, o AS (SELECT seg, gt, count(*) AS n FROM vox GROUP BY seg, gt), t AS (SELECT seg, sum(n) AS t FROM o GROUP BY seg),
  h AS (SELECT e.u, e.v, sum(a.n * b.n) AS same FROM edges e JOIN o a ON e.u = a.seg JOIN o b ON e.v = b.seg AND a.gt = b.gt GROUP BY e.u, e.v),
  f AS (SELECT e.u, e.v, 1 - CAST(coalesce(h.same, 0) AS DOUBLE) / CAST(a.t * b.t AS DOUBLE) AS p FROM edges e LEFT JOIN h ON e.u = h.u AND e.v = h.v JOIN t a ON e.u = a.seg JOIN t b ON e.v = b.seg) """


def overlaps(spark, d):
    v = vox(spark, d)
    o = v.groupBy("seg", "gt").agg(F.count("*").alias("n"))
    e = edges(spark, d).select("u", "v")
    same = e.join(o.select(F.col("seg").alias("u"), "gt", F.col("n").alias("a")), "u").join(o.select(F.col("seg").alias("v"), "gt", F.col("n").alias("b")), ["v", "gt"]).groupBy("u", "v").agg(F.sum(F.col("a") * F.col("b")).alias("same"))
    t = v.groupBy("seg").agg(F.count("*").alias("t"))
    return rag.ends(e.join(same, ["u", "v"], "left"), t, ("t",)).select("u", "v", (1 - F.coalesce("same", F.lit(0)).cast("double") / (F.col("t_u") * F.col("t_v")).cast("double")).alias("p"))


@query("jn8_overlap", WITH_EDGES + OVERLAP + "SELECT u, v, p AS p_diff FROM f")
def jn8(spark, d):
    return overlaps(spark, d).withColumnRenamed("p", "p_diff")


@query("ag14_fuzzy", WITH_EDGES + OVERLAP + "SELECT u, v, CASE WHEN p > 0.6 THEN 1.0 WHEN p < 0.4 THEN 0.0 ELSE 0.5 END::DOUBLE AS label FROM f")
def ag14(spark, d):
    return overlaps(spark, d).select("u", "v", F.when(F.col("p") > 0.6, 1.0).when(F.col("p") < 0.4, 0.0).otherwise(0.5).alias("label"))


SKIP = """, g AS (SELECT x, y, z, seg, lead(seg) OVER (PARTITION BY x, y ORDER BY z) AS up, lead(z) OVER (PARTITION BY x, y ORDER BY z) - z AS skip_range FROM vox WHERE z NOT IN (3, 4, 7)),
  sk AS (SELECT least(seg, up) AS u, greatest(seg, up) AS v, skip_range, count(*) AS n FROM g WHERE skip_range > 1 GROUP BY ALL)"""


@query("jn9_skip_edges", WITH_EDGES + SKIP + " SELECT u, v, skip_range, n FROM sk")
def jn9(spark, d):
    return defects.skip_edges(vox(spark, d), BAD)


@query("df1_modified_adjacency", WITH_EDGES + SKIP + """, b AS (SELECT DISTINCT seg FROM vox WHERE z IN (3, 4, 7)), h AS (SELECT u, v, kind, (u IN (SELECT seg FROM b) OR v IN (SELECT seg FROM b)) AS hit FROM edges)
  SELECT u, v, 'local' AS origin, CAST(hit AS INTEGER) AS ignore, 1::BIGINT AS skip_range FROM h WHERE NOT (hit AND kind = 0)
  UNION ALL SELECT u, v, 'skip', 0, skip_range FROM sk WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = sk.u AND e.v = sk.v)""")
def df1(spark, d):
    return defects.modified_edges(edges(spark, d), vox(spark, d), BAD)


@query("df2_deleted_edges", WITH_EDGES + ", b AS (SELECT DISTINCT seg FROM vox WHERE z IN (3, 4, 7)) SELECT u, v FROM edges WHERE kind = 0 AND (u IN (SELECT seg FROM b) OR v IN (SELECT seg FROM b))")
def df2(spark, d):
    return defects.touching(edges(spark, d).filter("kind = 0").select("u", "v"), defects.defect_nodes(vox(spark, d), BAD), "left_semi")


@query("df4_skip_features", WITH_EDGES + ", g AS (SELECT x, y, z, seg, pm, lead(seg) OVER w AS up, lead(pm) OVER w AS pu, lead(z) OVER w - z AS r FROM vox WHERE z NOT IN (3, 4, 7) WINDOW w AS (PARTITION BY x, y ORDER BY z)) SELECT least(seg, up) AS u, greatest(seg, up) AS v, CAST(sum(pm + pu) AS BIGINT) AS total, min(pm + pu) AS low, max(pm + pu) AS high FROM g WHERE r > 1 GROUP BY ALL")
def df4(spark, d):
    w = Window.partitionBy("x", "y").orderBy("z")
    g = vox(spark, d).filter(~F.col("z").isin(*BAD)).select("seg", F.lead("seg").over(w).alias("up"), (F.col("pm") + F.lead("pm").over(w)).alias("w"), (F.lead("z").over(w) - F.col("z")).alias("r")).filter("r > 1")
    return g.groupBy(F.least("seg", "up").alias("u"), F.greatest("seg", "up").alias("v")).agg(F.sum("w").alias("total"), F.min("w").alias("low"), F.max("w").alias("high"))


@query("df8_replace_slices", WITH_VOX + ", m(z, source) AS (VALUES (3, 2), (4, 5), (7, 6)) SELECT a.x, a.y, a.z, coalesce(b.seg, a.seg) AS seg FROM vox a LEFT JOIN m ON a.z = m.z LEFT JOIN vox b ON b.x = a.x AND b.y = a.y AND b.z = m.source")
def df8(spark, d):
    v = vox(spark, d)
    depth = (v.agg(F.max("z")).first()[0] or -1) + 1
    m = defects.replacement_slices(spark, BAD, min(depth, max(BAD) + 2))
    source = v.select("x", "y", F.col("z").alias("source"), F.col("seg").alias("other")).join(F.broadcast(m), "source").select("x", "y", "z", "other")  # one row a bad slice
    return v.join(source, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("other", "seg").alias("seg"))


@query("ag1_edge_stats", WITH_FACES + "SELECT u, v, count(*) AS n, CAST(sum(w) AS BIGINT) AS total, min(w) AS low, max(w) AS high, CAST(sum(w) AS DOUBLE) / count(*) AS mean, CAST(quantile_disc(w, 0.5) AS DOUBLE) AS q50, CAST(quantile_disc(w, 0.9) AS DOUBLE) AS q90 FROM faces GROUP BY u, v")
def ag1(spark, d):
    total, n = F.sum("w"), F.count("*")
    return faces(spark, d).groupBy("u", "v").agg(n.alias("n"), total.alias("total"), F.min("w").alias("low"), F.max("w").alias("high"), (total.cast("double") / n).alias("mean"), *(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY w)").cast("double").alias(k) for k, q in (("q50", 0.5), ("q90", 0.9))))


@query("ag1_edge_moments", WITH_FACES + """, m AS (SELECT u, v, avg(w) AS mu FROM faces GROUP BY u, v), c AS (SELECT f.u, f.v, avg((w - mu) ** 2) AS m2, avg((w - mu) ** 3) AS m3, avg((w - mu) ** 4) AS m4 FROM faces f JOIN m USING (u, v) GROUP BY f.u, f.v)
  SELECT u, v, round(m2, 2) AS var, CASE WHEN m2 = 0 THEN 0.0 ELSE round(m3 / m2 ** 1.5, 4) END AS skew, CASE WHEN m2 = 0 THEN 0.0 ELSE round(m4 / m2 ** 2 - 3, 4) END AS kurt FROM c""")
def ag1m(spark, d):
    g = faces(spark, d).groupBy("u", "v").agg(F.var_pop("w").alias("m2"), F.skewness("w").alias("sk"), F.kurtosis("w").alias("ku"))
    return g.select("u", "v", F.round("m2", 2).alias("var"), F.when(F.col("m2") == 0, 0.0).otherwise(F.round("sk", 4)).alias("skew"), F.when(F.col("m2") == 0, 0.0).otherwise(F.round("ku", 4)).alias("kurt"))


@query("ag4_affinity", WITH_FACES + "SELECT u, v, CAST(sum(CASE WHEN axis < 2 THEN w ELSE 200000 - w END) AS DOUBLE) / count(*) AS val FROM faces GROUP BY u, v")
def ag4(spark, d):
    return faces(spark, d).groupBy("u", "v").agg((F.sum(F.when(F.col("axis") < 2, F.col("w")).otherwise(200000 - F.col("w"))).cast("double") / F.count("*")).alias("val"))


@query("ag5_region_stats", WITH_EDGES + "SELECT seg, n, total, low, high, CAST(sx AS DOUBLE) / n AS cx, CAST(sy AS DOUBLE) / n AS cy, CAST(sz AS DOUBLE) / n AS cz FROM nodes")
def ag5(spark, d):
    return rag.node_stats(vox(spark, d)).select("seg", "n", "total", "low", "high", *((F.col(f"s{c}").cast("double") / F.col("n")).alias(f"c{c}") for c in "xyz"))


@query("ag6_region_pairs", WITH_EDGES + """SELECT e.u, e.v, least(a.total, b.total) AS lo, greatest(a.total, b.total) AS hi, abs(a.total - b.total) AS diff, a.total + b.total AS total,
  round((CAST(a.sx AS DOUBLE) / a.n - CAST(b.sx AS DOUBLE) / b.n) ** 2, 6) AS dx2 FROM edges e JOIN nodes a ON e.u = a.seg JOIN nodes b ON e.v = b.seg""")
def ag6(spark, d):
    r = rag.ends(edges(spark, d).select("u", "v"), rag.node_stats(vox(spark, d)), ("total", "sx", "n"))
    a, b = F.col("total_u"), F.col("total_v")
    dx = F.col("sx_u").cast("double") / F.col("n_u") - F.col("sx_v").cast("double") / F.col("n_v")
    return r.select("u", "v", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.abs(a - b).alias("diff"), (a + b).alias("total"), F.round(dx * dx, 6).alias("dx2"))


@query("ag7_edge_length", WITH_FACES + "SELECT u, v, count(*) AS len FROM faces GROUP BY u, v")
def ag7(spark, d):
    return faces(spark, d).groupBy("u", "v").agg(F.count("*").alias("len"))


@query("ag8_topology", WITH_EDGES + "SELECT e.u, e.v, e.n AS len, a.n + b.n - e.n AS uni, CASE WHEN a.n + b.n = e.n THEN 0.0 ELSE CAST(e.n AS DOUBLE) / (a.n + b.n - e.n) END AS iou FROM edges e JOIN nodes a ON e.u = a.seg JOIN nodes b ON e.v = b.seg")
def ag8(spark, d):
    e = edges(spark, d).select("u", "v", F.col("n").alias("len"))
    r = rag.ends(e, rag.node_stats(vox(spark, d)), ("n",)).withColumn("uni", F.col("n_u") + F.col("n_v") - F.col("len"))
    return r.select("u", "v", "len", "uni", F.coalesce(F.try_divide(F.col("len").cast("double"), F.col("uni")), F.lit(0.0)).alias("iou"))


@query("ag11_edge_kind", WITH_EDGES + "SELECT u, v, kind FROM edges")
def ag11(spark, d):
    return edges(spark, d).select("u", "v", "kind")


@query("ag13_edge_gt", WITH_EDGES + "SELECT e.u, e.v, CASE WHEN a.gt <> b.gt THEN 1 ELSE 0 END AS label FROM edges e JOIN node_gt a ON e.u = a.seg JOIN node_gt b ON e.v = b.seg")
def ag13(spark, d):
    return rag.ends(edges(spark, d), rag.node_gt(vox(spark, d)), ("gt",)).select("u", "v", (F.col("gt_u") != F.col("gt_v")).cast("int").alias("label"))


@query("ag26_candidate_fold", WITH_EDGES + "SELECT u, v, (u % 2 + v % 2 + (u + v) % 2) AS total FROM edges")
def ag26(spark, d):
    states = F.array(F.col("u") % 2, F.col("v") % 2, (F.col("u") + F.col("v")) % 2)
    return edges(spark, d).select("u", "v", F.aggregate(states, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("ag36_superpixels", WITH_EDGES + "SELECT (SELECT count(DISTINCT seg) FROM vox) AS nodes, (SELECT count(*) FROM edges) AS edges")
def ag36(spark, d):
    n = vox(spark, d).agg(F.countDistinct("seg").alias("nodes"), F.lit(1).alias("k"))
    return n.join(edges(spark, d).agg(F.count("*").alias("edges"), F.lit(1).alias("k")), "k").drop("k")


@query("sc1_clamp", WITH_EDGES + "SELECT u, v, round(0.998 * (s / (n * 200000.0)) + 0.001, 9) AS p FROM edges")
def sc1(spark, d):
    return edges(spark, d).select("u", "v", F.round(en.clamp(mean_p()), 9).alias("p"))


@query("sc2_energy", WITH_EDGES + "SELECT u, v, round(e, 6) AS e, CASE WHEN e > 0 THEN 1 ELSE 0 END AS attractive FROM costs")
def sc2(spark, d):
    return edges(spark, d).withColumn("e", en.energy(mean_p())).select("u", "v", F.round("e", 6).alias("e"), (F.col("e") > 0).cast("int").alias("attractive"))


@query("sc3_affinity_energy", WITH_EDGES + "SELECT u, v, round(-e + ln(0.6 / 0.4), 6) AS e FROM costs")
def sc3(spark, d):
    return edges(spark, d).select("u", "v", F.round(en.affinity_energy(mean_p(), 0.4), 6).alias("e"))


for _scheme, _sql in {
    "z": "e * CASE WHEN kind = 0 THEN 16.0 * n / (SELECT max(n) FROM costs WHERE kind = 0) ELSE 1 END",
    "xyz": "e * 16.0 * n / max(n) OVER (PARTITION BY kind)",
    "all": "e * 16.0 * n / max(n) OVER ()",
}.items():

    @query(f"sc{dict(z=4, xyz=5, all=6)[_scheme]}_weight_{_scheme}", WITH_EDGES + f"SELECT u, v, round({_sql}, 6) AS e FROM costs")
    def weighed(spark, d, scheme=_scheme):
        return en.weigh(edges(spark, d).withColumn("e", en.energy(mean_p())), scheme).select("u", "v", F.round("e", 6).alias("e"))


@query("sc7_masked_energy", WITH_EDGES + "SELECT u, v, round(CASE WHEN (u + v) % 7 = 0 THEN 2 * (SELECT min(e) FROM costs) ELSE e END, 6) AS e FROM costs")
def sc7(spark, d):
    e = edges(spark, d).withColumn("e", en.energy(mean_p()))
    low = e.agg(F.min("e")).first()[0] or 0.0
    return e.select("u", "v", F.round(F.when((F.col("u") + F.col("v")) % 7 == 0, F.lit(2 * low)).otherwise(F.col("e")), 6).alias("e"))


@query("sc9_balance", WITH_EDGES + "SELECT u, v, round(e / count(*) OVER (), 9) AS e FROM costs")
def sc9(spark, d):
    e = edges(spark, d).withColumn("e", en.energy(mean_p()))
    return e.select("u", "v", F.round(F.col("e") / F.lit(e.count()), 9).alias("e"))


@query("sc10_log_ratio", WITH_VOX + "SELECT x, y, z, round(ln((1 - q) / q), 6) AS c FROM (SELECT *, greatest(least(pm / 100000.0, 1 - 1 / 255.0), 1 / 255.0) AS q FROM vox)")
def sc10(spark, d):
    return vox(spark, d).select("x", "y", "z", F.round(en.negative_log_ratio(F.col("pm") / 100000.0), 6).alias("c"))


@query("sc11_log_inverse", WITH_VOX + "SELECT x, y, z, round(-ln(1 - pm / 100000.0), 6) AS c, round(1 - exp(-(pm / 100000.0)), 6) AS p, round(ln((pm / 100000.0) / (1 - pm / 100000.0)), 6) AS logit FROM vox")
def sc11(spark, d):
    p = F.col("pm") / 100000.0
    return vox(spark, d).select("x", "y", "z", F.round(-F.ln(1 - p), 6).alias("c"), F.round(1 - F.exp(-p), 6).alias("p"), F.round(en.logit(p), 6).alias("logit"))


@query("sc12_logistic_prior", WITH_VOX + "SELECT x, y, z, round(1 / (1 + exp(-ln((pm / 100000.0) / (1 - pm / 100000.0)) - ln(0.3 / 0.7))), 6) AS p FROM vox")
def sc12(spark, d):
    return vox(spark, d).select("x", "y", "z", F.round(en.logistic_prior(F.col("pm") / 100000.0, 0.3), 6).alias("p"))


@query("sc15_inverted_power", WITH_VOX + "SELECT x, y, z, round(pow(1 - pm / CAST((SELECT max(pm) FROM vox) AS DOUBLE), 10), 9) AS c FROM vox")
def sc15(spark, d):
    v = vox(spark, d)
    top = float(v.agg(F.max("pm")).first()[0] or 1)
    return v.select("x", "y", "z", F.round(F.pow(1 - F.col("pm") / F.lit(top), F.lit(10)), 9).alias("c"))


@query("sc16_scrub", WITH_VOX + "SELECT x, y, z, CASE WHEN x = 0 THEN 0.0 ELSE CAST(raw AS DOUBLE) / x END AS v FROM vox")
def sc16(spark, d):
    return vox(spark, d).select("x", "y", "z", en.finite(F.try_divide(F.col("raw").cast("double"), F.col("x"))).alias("v"))


@query("sc19_fused_gts", WITH_EDGES + "SELECT e.u, e.v, CAST((CASE WHEN e.u // 3 <> e.v // 3 THEN 1 ELSE 0 END) + (CASE WHEN a.gt <> b.gt THEN 1 ELSE 0 END) AS DOUBLE) / 2 AS p FROM edges e JOIN node_gt a ON e.u = a.seg JOIN node_gt b ON e.v = b.seg")
def sc19(spark, d):
    r = rag.ends(edges(spark, d), rag.node_gt(vox(spark, d)), ("gt",))
    return r.select("u", "v", ((F.expr("u div 3 <> v div 3").cast("int") + (F.col("gt_u") != F.col("gt_v")).cast("int")).cast("double") / 2).alias("p"))


@query("mc19_costs_no_learning", WITH_EDGES + ", f AS (SELECT u, v, n, kind, 0.001 + 0.998 * (s / (n * 200000.0)) AS q FROM edges) SELECT u, v, round(ln(q / (1 - q)) * CASE WHEN kind = 0 THEN 16.0 * n / (SELECT max(n) FROM f WHERE kind = 0) ELSE 1 END, 6) AS e FROM f")
def mc19(spark, d):
    return en.weigh(edges(spark, d).withColumn("e", en.affinity_energy(mean_p())), "z").select("u", "v", F.round("e", 6).alias("e"))


SUMS = ", c AS (SELECT seg AS a, gt AS b, count(*) AS n FROM vox GROUP BY seg, gt), ca AS (SELECT a, sum(n) AS n FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS n FROM c GROUP BY b) "


@query("ag27_rand_vi", WITH_VOX + SUMS + """, t AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * n) FROM c) AS qab, (SELECT sum(n * n) FROM ca) AS qa, (SELECT sum(n * n) FROM cb) AS qb,
  (SELECT sum(n * ln(n)) FROM c) AS lab, (SELECT sum(n * ln(n)) FROM ca) AS la, (SELECT sum(n * ln(n)) FROM cb) AS lb)
  SELECT CAST((2 * qab + n * n - qa - qb - n) / 2 AS BIGINT) AS agree, round(CAST((2 * qab + n * n - qa - qb - n) / 2 AS DOUBLE) / (n * (n - 1) / 2), 9) AS rand, round((lb - lab) / n, 6) AS vi_split, round((la - lab) / n, 6) AS vi_merge, round((lb - lab) / n + (la - lab) / n, 6) AS vi FROM t""")
def ag27(spark, d):
    return metrics.rand_vi(metrics.contingency(vox(spark, d)))


@query("ag29_arand", WITH_VOX + SUMS + """, i AS (SELECT * FROM c WHERE b <> 0 AND a <> 0), s AS (SELECT (SELECT sum(n * n) FROM i) AS qab, (SELECT sum(n * n) FROM (SELECT sum(n) AS n FROM i GROUP BY a)) AS qa, (SELECT sum(n * n) FROM (SELECT sum(n) AS n FROM c WHERE b <> 0 GROUP BY b)) AS qb, (SELECT coalesce(sum(n), 0) FROM c WHERE b <> 0 AND a = 0) AS o),
  r AS (SELECT CAST(qab + o AS DOUBLE) / (qa + o) AS p, CAST(qab + o AS DOUBLE) / qb AS r FROM s) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(1 - 2 * p * r / (p + r), 9) AS are FROM r""")
def ag29(spark, d):
    return metrics.adapted_rand(metrics.contingency(vox(spark, d)))


@query("ag31_cut_energy", WITH_EDGES + "SELECT round(sum(CASE WHEN a.gt <> b.gt THEN e ELSE 0 END), 4) AS energy FROM costs c JOIN node_gt a ON c.u = a.seg JOIN node_gt b ON c.v = b.seg")
def ag31(spark, d):
    r = rag.ends(edges(spark, d).withColumn("e", en.energy(mean_p())), rag.node_gt(vox(spark, d)), ("gt",))
    return r.agg(F.round(F.sum(F.when(F.col("gt_u") != F.col("gt_v"), F.col("e")).otherwise(0.0)), 4).alias("energy"))


@query("wn5_best_nbr", WITH_EDGES + ", s AS (SELECT u AS node, v AS nbr, n FROM edges UNION ALL SELECT v, u, n FROM edges) SELECT node, nbr FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, nbr) AS r FROM s) WHERE r = 1")
def wn5(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "n").unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "n"))
    return both.groupBy("node").agg(F.min_by("nbr", F.struct((-F.col("n")).alias("n"), "nbr")).alias("nbr"))


@query("so1_sorted_pairs", WITH_FACES + "SELECT DISTINCT u, v FROM faces")
def so1(spark, d):
    return faces(spark, d).select("u", "v").distinct()


@query("jn14_blocks", WITH_VOX + ", b(block, lo, hi) AS (VALUES (0, 0, 6), (1, 4, 10)) SELECT block, count(*) AS n, count(DISTINCT seg) AS nseg FROM vox JOIN b ON x >= lo AND x < hi GROUP BY block")
def jn14(spark, d):
    v = vox(spark, d)
    both = cutout(v, (0, 6, 0, 10, 0, 1 << 40)).withColumn("block", F.lit(0)).unionByName(cutout(v, (4, 10, 0, 10, 0, 1 << 40)).withColumn("block", F.lit(1)))
    return both.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("seg").alias("nseg"))
