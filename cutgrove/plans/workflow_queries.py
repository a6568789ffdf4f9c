"""Solvers, learning and workflows, and what is true of their results whatever they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutgrove.functions import energies as en
from cutgrove.operators import graphs, learning, multicut, rag, workflows
from cutgrove.session import cut

from .common import WITH_EDGES, WITH_VOX, edges, vox
from .feature_queries import LIFTED, lifted
from .graph_queries import costs

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


for _name, _solver in {"mc3_fusion_moves": "fusion", "mc15_noise_proposals": "noise", "mc15_subgraph_proposals": "subgraph", "mc16_block_icm": "icm", "mc17_optimize_lifted": "lifted"}.items():

    @query(_name)
    def solved(spark, d, solver=_solver):
        return multicut.solve(costs(spark, d), solver)


TRUTH = WITH_EDGES + "SELECT s.solver, (SELECT count(*) FROM nodes) AS nodes, 0 AS torn, 1 AS no_worse FROM (VALUES {}) s(solver)"


def _facts(c, labels, name, than):
    """Nodes with a label, labels whose nodes are not connected, and whether the cut costs no more than another."""
    labels = cut(labels)
    e = cut(multicut.cut_edges(c, labels))
    inside = multicut.components(e.filter("cut = 0").select(F.col("u").alias("a"), F.col("v").alias("b")))
    parts = labels.join(inside, "node", "left").select("label", F.coalesce("component", "node").alias("k")).distinct().groupBy("label").count()
    value = e.filter("cut = 1").agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    torn = parts.filter("count > 1").count()
    row = labels.agg(F.count("*").alias("nodes")).select(F.lit(name).alias("solver"), "nodes", F.lit(torn).alias("torn"), F.lit(int(than is None or value <= than + 1e-6)).alias("no_worse"))
    return row, value


@query("mc_solver_facts", TRUTH.format("('gaec'), ('kl'), ('noise'), ('subgraph'), ('icm')"))
def facts(spark, d):
    """Every solver labels every node, parts are connected, and none is worse than greedy contraction."""
    c = cut(costs(spark, d))
    out, first = _facts(c, multicut.solve(c, "gaec"), "gaec", None)
    for s in ("kl", "noise", "subgraph", "icm"):
        out = out.unionByName(_facts(c, multicut.solve(c, s), s, first)[0])
    return out


@query("mc2_exact_facts", WITH_VOX + "SELECT count(DISTINCT z) AS slices, 0 AS worse FROM vox")
def exact_facts(spark, d):
    """The optimum of every slice is no worse than two-cut moves on it."""
    c = cut(costs(spark, d))
    z = vox(spark, d).groupBy("seg").agg(F.max("z").alias("z"))
    value = lambda s: multicut.cut_edges(c, cut(workflows.slicewise(c, z, s))).join(z.withColumnRenamed("seg", "u"), "u").groupBy("z").agg(F.sum(F.when(F.col("cut") == 1, F.col("cost")).otherwise(0.0)).alias(s))
    both = value("exact").join(value("kl"), "z")
    return both.agg(F.count("*").alias("slices"), F.count(F.when(F.col("exact") > F.col("kl") + 1e-6, 1)).cast("int").alias("worse"))


@query("mc1_dense_facts", WITH_EDGES + "SELECT (SELECT count(*) FROM nodes) AS nodes, 1::BIGINT AS first, 1 AS gapless")
def dense_facts(spark, d):
    """Dense labels begin at 1 and leave none out."""
    labels = multicut.dense_labels(cut(multicut.solve(costs(spark, d), "gaec")))
    return labels.agg(F.count("*").alias("nodes"), F.min("label").alias("first"), (F.max("label") == F.countDistinct("label")).cast("int").alias("gapless"))


@query("mc12_fusion_facts", WITH_EDGES + "SELECT 1 AS no_worse FROM (SELECT 1)")
def fusion_facts(spark, d):
    """A fusion is no worse than what it began with."""
    c = cut(costs(spark, d))
    value = lambda s: multicut.cut_edges(c, cut(multicut.solve(c, s))).filter("cut = 1").agg(F.sum("cost")).first()[0] or 0.0
    return spark.range(1).select(F.lit(int(value("fusion") <= value("kl") + 1e-6)).alias("no_worse"))


@query("mc24_labels_both_ways", WITH_EDGES + "SELECT count(*) AS edges, 0::BIGINT AS changed FROM edges")
def mc24(spark, d):
    """Labels of nodes to labels of edges and back: the same edges are cut again."""
    c = cut(costs(spark, d))
    first = cut(multicut.cut_edges(c, cut(multicut.solve(c, "gaec"))).select("u", "v", "cost", "cut"))
    again = multicut.cut_edges(c, cut(multicut.node_labels(first))).select("u", "v", F.col("cut").alias("again"))
    return first.join(again, ["u", "v"]).agg(F.count("*").alias("edges"), F.count(F.when(F.col("cut") != F.col("again"), 1)).alias("changed"))


@query("mc19_affinity_features", WITH_EDGES + ", f AS (SELECT u, v, CASE WHEN axis < 2 THEN w ELSE 200000 - w END / 200000.0 AS w FROM faces), s AS (SELECT u, v, avg(w) AS mean, max(w) AS maximum, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS quantile75, quantile_cont(w, 0.9) AS quantile90 FROM f GROUP BY u, v), l AS (SELECT u, v, 'mean' AS feature, mean AS p FROM s UNION ALL SELECT u, v, 'max', maximum FROM s UNION ALL SELECT u, v, 'median', median FROM s UNION ALL SELECT u, v, 'quantile75', quantile75 FROM s UNION ALL SELECT u, v, 'quantile90', quantile90 FROM s) SELECT u, v, feature, round(ln((0.001 + 0.998 * p) / (1 - (0.001 + 0.998 * p))), 6) + 0.0 AS cost FROM l")
def mc19(spark, d):
    """Costs straight from affinities by each of the five statistics."""
    from cutgrove.operators import features

    f = features.affinity_faces(rag.faces(vox(spark, d)), 200_000.0).withColumn("w", F.col("w") / 200_000.0)
    s = features.edge_statistics(f, F.col("w"))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(c).alias("p")) for k, c in (("mean", "mean"), ("max", "high"), ("median", "q50"), ("quantile75", "q75"), ("quantile90", "q90"))))).alias("x")
    return s.select("u", "v", named).select("u", "v", "x.feature", (F.round(en.affinity_energy(F.col("x.p")), 6) + 0.0).alias("cost"))


@query("mc20_slicewise")
def mc20(spark, d):
    """The multicut of every slice on its own."""
    return workflows.slicewise(costs(spark, d), vox(spark, d).groupBy("seg").agg(F.max("z").alias("z")))


@query("mc21_long_range_costs", WITH_VOX + "SELECT a.z, a.x + 10 * a.y AS u, a.x + 3 + 10 * a.y AS v, round(ln((1 - p) / p), 6) AS cost FROM (SELECT z, x, y, greatest(pm, lead(pm, 1) OVER w, lead(pm, 2) OVER w, lead(pm, 3) OVER w) / 100000.0 AS p, lead(x, 3) OVER w AS x3 FROM vox WINDOW w AS (PARTITION BY z, y ORDER BY x)) a WHERE x3 = x + 3")
def mc21(spark, d):
    """Lifted grid pairs three pixels apart along x: the logit of the largest value on the line between them."""
    return graphs.long_range_costs(vox(spark, d), "pm", 3, 1.0 / 100_000.0).select("z", (F.col("x") + 10 * F.col("y")).alias("u"), (F.col("x") + 3 + 10 * F.col("y")).alias("v"), F.round("cost", 6).alias("cost"))


@query("mc21_seeded_costs", WITH_EDGES + "SELECT e.u, e.v, CASE WHEN a.gt % 4 = 0 AND b.gt % 4 = 0 THEN CASE WHEN a.gt = b.gt THEN 100.0 ELSE -100.0 END ELSE round(c.e, 6) END AS cost FROM edges e JOIN costs c USING (u, v) JOIN node_gt a ON a.seg = e.u JOIN node_gt b ON b.seg = e.v")
def mc21_seeded(spark, d):
    """Pairs of seeded nodes must or must not be joined; the others keep their energies."""
    r = rag.ends(costs(spark, d), rag.node_gt(vox(spark, d)), ("gt",))
    a, b = F.col("gt_u"), F.col("gt_v")
    return r.select("u", "v", F.when((a % 4 == 0) & (b % 4 == 0), F.when(a == b, 100.0).otherwise(-100.0)).otherwise(F.round("cost", 6)).alias("cost"))


@query("mc25_multicut_states")
def mc25(spark, d):
    """Whether fifteen multicuts separate a lifted pair, and how many do."""
    p = cut(edges(spark, d).withColumn("p", F.col("s") / (F.col("n") * 200000.0)))
    return workflows.multicut_states(p, lifted(spark, d))


@query("mc25_state_facts", WITH_EDGES + LIFTED + "SELECT count(*) AS pairs, 0 AS odd FROM lifted")
def mc25_facts(spark, d):
    """A row for every lifted pair; the last column is the sum of the others, each 0 or 1."""
    p = cut(edges(spark, d).withColumn("p", F.col("s") / (F.col("n") * 200000.0)))
    s = workflows.multicut_states(p, lifted(spark, d))
    total = sum((F.col(f"mc_{k}") for k in range(15)), F.lit(0))
    return s.agg(F.count("*").alias("pairs"), F.count(F.when((total != F.col("mc_sum")) | (F.greatest(*(f"mc_{k}" for k in range(15))) > 1), 1)).cast("int").alias("odd"))


@query("mc26_cluster_heights")
def mc26(spark, d):
    """Heights at which hierarchical clusterings join a lifted pair."""
    p = edges(spark, d).select("u", "v", "n", (F.col("s") / (F.col("n") * 200000.0)).alias("p"))
    return workflows.cluster_heights(cut(p), vox(spark, d).groupBy("seg").agg(F.count("*").alias("size")), lifted(spark, d))


@query("mc26_height_facts", WITH_EDGES + LIFTED + "SELECT count(*) AS pairs, 0 AS odd FROM lifted")
def mc26_facts(spark, d):
    """A row for every lifted pair with heights over 0 and their mean between the least and the largest."""
    h = mc26(spark, d)
    cols = [F.col(f"cl_{k}") for k in range(8)]
    odd = (F.least(*cols) <= 0) | (F.col("cl_mean") < F.least(*cols) - 1e-9) | (F.col("cl_mean") > F.greatest(*cols) + 1e-9)
    return h.agg(F.count("*").alias("pairs"), F.count(F.when(odd, 1)).cast("int").alias("odd"))


def halves(spark, d):
    """The volume in two along z: one to learn on, one to predict."""
    return learning.z_cutouts(vox(spark, d), (0.5,))


@query("ml1_local_features")
def ml1(spark, d):
    """All local features of every edge side by side."""
    v = vox(spark, d)
    return learning.local_features(v, learning.graph(v), ("raw", "prob", "affinities", "reg", "topo"))


@query("ml1_plain_columns", WITH_EDGES + """, around AS (SELECT seg, sum(n) AS a FROM (SELECT u AS seg, n FROM edges WHERE kind = 1 UNION ALL SELECT v, n FROM edges WHERE kind = 1) GROUP BY seg)
  SELECT e.u, e.v, e.n::DOUBLE AS f_len, e.kind::DOUBLE AS f_kind, CASE WHEN e.kind = 0 THEN a.n + b.n - e.n ELSE 0 END::DOUBLE AS f_uni, least(a.n, b.n)::DOUBLE AS f_lo_n, greatest(a.n, b.n)::DOUBLE AS f_hi_n,
    abs(a.total - b.total)::DOUBLE AS f_diff_total, least(a.low, b.low)::DOUBLE AS f_lo_low, greatest(a.high, b.high)::DOUBLE AS f_hi_high, (a.low + b.low)::DOUBLE AS f_sum_low,
    CASE WHEN e.kind = 0 THEN round(greatest(coalesce(a.n::DOUBLE / x.a, 0), coalesce(b.n::DOUBLE / y.a, 0)), 6) ELSE 0 END::DOUBLE AS f_shape_hi
  FROM edges e JOIN nodes a ON a.seg = e.u JOIN nodes b ON b.seg = e.v LEFT JOIN around x ON x.seg = e.u LEFT JOIN around y ON y.seg = e.v""")
def ml1_plain(spark, d):
    """Those columns of the feature table that filters have no part in."""
    v = vox(spark, d)
    wide = learning.local_features(v, learning.graph(v), ("reg", "topo"))
    return wide.select("u", "v", *(f"f_{c}" for c in ("len", "kind", "uni", "lo_n", "hi_n", "diff_total", "lo_low", "hi_high", "sum_low")), F.round("f_shape_hi", 6).alias("f_shape_hi"))


@query("ml2_learn_and_predict")
def ml2(spark, d):
    """Learnt on one half, without ignored objects, predicted on the other."""
    train, test = halves(spark, d)
    return learning.learn_and_predict([train], test, ignore_gt=(5,))


@query("ml2_facts", WITH_VOX + ", m AS (SELECT max(z) + 1 AS depth FROM vox) SELECT count(DISTINCT seg) AS nodes, 0 AS odd, 1 AS learnt FROM vox, m WHERE z >= round(depth * 0.5)")
def ml2_facts(spark, d):
    """All nodes of the half that was not learnt on, probabilities between 0 and 1, and more right than wrong."""
    train, test = halves(spark, d)
    p = cut(learning.learn_and_predict([train], test))
    e = cut(p.join(learning.edge_labels(p, test), ["u", "v"]))
    right = e.agg(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    nodes = e.select(F.explode(F.array("u", "v")).alias("a")).agg(F.countDistinct("a").alias("nodes"))
    odd = e.filter("p < 0 or p > 1").count()
    return nodes.select("nodes", F.lit(odd).alias("odd"), F.lit(int(right > 0.5)).alias("learnt"))


@query("ml4_forest_by_kind")
def ml4(spark, d):
    """One forest for edges in planes, one for those between them."""
    train, test = halves(spark, d)
    return learning.learn_by_kind([train], test)


@query("ag35_cross_validation")
def ag35(spark, d):
    """Accuracy of the forest over folds: all edges, in planes, between them."""
    v = vox(spark, d)
    e = learning.graph(v)
    rows = learning.local_features(v, e).join(learning.edge_labels(e, v), ["u", "v"]).join(e.select("u", "v", "kind"), ["u", "v"])
    return learning.cross_validated(rows)


@query("ml5_lifted_forest")
def ml5(spark, d):
    """Probabilities of lifted pairs from a forest of depth 10 over multicut states, cluster heights and regions."""
    train, test = halves(spark, d)
    return workflows.lifted_probabilities(train, test)[0]


@query("wf2_defect_workflow")
def wf2(spark, d):
    train, test = halves(spark, d)
    first = test.agg(F.min("z")).first()[0] or 0
    begin = train.agg(F.min("z")).first()[0] or 0
    return workflows.defect_workflow([train], test, (first + 1, first + 2), train_bad=((begin + 2, begin + 3),))


@query("wf3_lifted_workflow")
def wf3(spark, d):
    train, test = halves(spark, d)
    return workflows.lifted_workflow(train, test)


@query("wf4_lifted_defect_workflow")
def wf4(spark, d):
    train, test = halves(spark, d)
    first = test.agg(F.min("z")).first()[0] or 0
    begin = train.agg(F.min("z")).first()[0] or 0
    return workflows.lifted_defect_workflow([train], test, (first + 1, first + 2), train_bad=((begin + 2, begin + 3),))


def merged(spark, d):
    """Both halves with a segmentation that joins pairs of objects here and there."""
    joined = F.when(F.col("gt") % 3 == 0, F.col("gt") - F.col("gt") % 2).otherwise(F.col("gt"))
    return [v.withColumn("obj", joined) for v in halves(spark, d)]


@query("wf10_object_paths")
def wf10(spark, d):
    """Paths through every object between the places where it leaves the volume, with their label."""
    v = merged(spark, d)[0]
    paths = cut(workflows.object_paths(v, "obj", 9, 9))
    return paths.join(workflows.path_features(paths, v).select("obj", "path", "label"), ["obj", "path"])


@query("wf7_false_merges")
def wf7(spark, d):
    """Probability of a false merge along every path."""
    train, test = merged(spark, d)
    return workflows.false_merges(train, test, "obj", 9, 9)[0]


@query("wf8_resolved_merges")
def wf8(spark, d):
    """Falsely merged objects solved anew: the part of every segment."""
    train, test = merged(spark, d)
    p, paths = workflows.false_merges(train, test, "obj", 9, 9)
    e = learning.graph(test).withColumn("cost", en.energy(F.col("s") / (F.col("n") * 200000.0))).select("u", "v", "cost")
    return workflows.resolve_merges(test, "obj", cut(p), paths, e)
