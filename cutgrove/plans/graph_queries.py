"""Graph algorithms, solvers, learning and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutgrove.functions import energies as en
from cutgrove.operators import components as cc
from cutgrove.operators import graphs, learning, metrics, multicut, rag, relabel, workflows
from cutgrove.session import cut

from .common import WITH_EDGES, WITH_VOX, edges, vox

QUERIES, ORACLE = {}, {}


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


def costs(spark, d, beta=0.5, scheme="none"):
    e = en.weigh(edges(spark, d).withColumn("e", en.energy(mean_p(), beta)), scheme)
    return e.select("u", "v", "n", "kind", F.col("e").alias("cost"))


def gt_edges(spark, d):
    """Edges inside one gt region: a graph of many components."""
    return rag.ends(edges(spark, d), rag.node_gt(vox(spark, d)), ("gt",)).filter("gt_u = gt_v").select("u", "v", "n")


GT_EDGES = ", ge AS (SELECT e.u, e.v, e.n FROM edges e JOIN node_gt a ON e.u = a.seg JOIN node_gt b ON e.v = b.seg WHERE a.gt = b.gt), ge2 AS (SELECT u, v, n FROM ge UNION ALL SELECT v, u, n FROM ge)"


@query("gr3_components", WITH_EDGES + GT_EDGES + ", reach AS (SELECT u AS node, u AS r FROM ge2 UNION SELECT ge2.v, reach.r FROM reach JOIN ge2 ON reach.node = ge2.u) SELECT node, min(r) AS component FROM reach GROUP BY node")
def gr3(spark, d):
    return cc.components(gt_edges(spark, d), "u", "v")


@query("gr4_union_find", WITH_EDGES + GT_EDGES + ", reach AS (SELECT u AS node, u AS r FROM ge2 UNION SELECT ge2.v, reach.r FROM reach JOIN ge2 ON reach.node = ge2.u), c AS (SELECT node, min(r) AS m FROM reach GROUP BY node) SELECT m AS component, count(*) AS n FROM c GROUP BY m")
def gr4(spark, d):
    return cc.components(gt_edges(spark, d), "u", "v").groupBy("component").agg(F.count("*").alias("n"))


@query("jn10_khop", WITH_EDGES + """, e2 AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), h2 AS (SELECT DISTINCT a.u, b.v FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u < b.v), h3 AS (SELECT DISTINCT a.u, c.v FROM e2 a JOIN e2 b ON a.v = b.u JOIN e2 c ON b.v = c.u WHERE a.u < c.v),
  k AS (SELECT u, v, 2 AS hops FROM h2 UNION ALL SELECT u, v, 3 FROM h3) SELECT u, v, min(hops) AS hops FROM k WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = k.u AND e.v = k.v) GROUP BY u, v""")
def jn10(spark, d):
    return graphs.k_hop(edges(spark, d).select("u", "v"), 3)


@query("gr17_lift", WITH_EDGES + ", e2 AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges) SELECT DISTINCT a.u, b.v FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u < b.v AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = a.u AND e.v = b.v)")
def gr17(spark, d):
    return graphs.k_hop(edges(spark, d).select("u", "v"), 2).select("u", "v")


@query("gr18_lift_values", WITH_EDGES + ", e2 AS (SELECT u, v, n FROM edges UNION ALL SELECT v, u, n FROM edges), p AS (SELECT a.u, b.v, min(a.n + b.n) AS c FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u < b.v GROUP BY a.u, b.v) SELECT u, v, n AS cost FROM edges UNION ALL SELECT u, v, c FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = p.u AND e.v = p.v)")
def gr18(spark, d):
    return graphs.lifted_distances(edges(spark, d).select("u", "v", F.col("n").alias("cost")), 2)


@query("gr2_dfs")
def gr2(spark, d):
    return graphs.dfs_order(gt_edges(spark, d))


@query("gr20_degrees", WITH_EDGES + "SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node")
def gr20(spark, d):
    return edges(spark, d).select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


@query("gr21_grid_index", WITH_VOX + "SELECT x + 10 * y + 100 * z AS vertex, seg FROM vox")
def gr21(spark, d):
    return vox(spark, d).select((F.col("x") + 10 * F.col("y") + 100 * F.col("z")).alias("vertex"), "seg")


@query("gr25_model_costs", WITH_EDGES + ", r AS (SELECT u, v, n AS c FROM edges UNION ALL SELECT u, v, 5 FROM edges WHERE kind = 0) SELECT u, v, CAST(sum(c) AS BIGINT) AS cost FROM r GROUP BY u, v")
def gr25(spark, d):
    e = edges(spark, d)
    return e.select("u", "v", F.col("n").alias("c")).unionByName(e.filter("kind = 0").select("u", "v", F.lit(5).cast("long").alias("c"))).groupBy("u", "v").agg(F.sum("c").alias("cost"))


@query("jn15_contract", WITH_EDGES + "SELECT least(u // 3, v // 3) AS u, greatest(u // 3, v // 3) AS v, CAST(sum(n) AS BIGINT) AS n FROM edges WHERE u // 3 <> v // 3 GROUP BY ALL")
def jn15(spark, d):
    e = edges(spark, d).select(F.expr("u div 3").alias("a"), F.expr("v div 3").alias("b"), "n").filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("n").alias("n"))


@query("jn17_find_edge", WITH_EDGES + "SELECT q.a, q.b, CASE WHEN e.u IS NULL THEN 0 ELSE 1 END AS found FROM (SELECT v AS a, u AS b FROM edges UNION ALL SELECT v + 1, u FROM edges) q LEFT JOIN edges e ON e.u = least(q.a, q.b) AND e.v = greatest(q.a, q.b)")
def jn17(spark, d):
    e = edges(spark, d).select("u", "v")
    asked = e.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(e.select((F.col("v") + 1).alias("a"), F.col("u").alias("b")))
    return asked.select("a", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).join(e.withColumn("found", F.lit(1)), ["u", "v"], "left").select("a", "b", F.coalesce("found", F.lit(0)).alias("found"))


def _solved(solver):
    def run(spark, d):
        return multicut.solve(costs(spark, d), solver)

    return run


for _name, _solver in {"mc6_gaec": "gaec", "mc7_kernighan_lin": "kl", "mc2_exact_small": "exact", "mc12_fusion": "fusion"}.items():
    QUERIES[_name] = _solved(_solver)


@query("mc1_dense_labels")
def mc1(spark, d):
    return multicut.dense_labels(cut(multicut.solve(costs(spark, d))))


@query("mc13_decomposition", WITH_EDGES + ", a2 AS (SELECT u, v FROM costs WHERE e >= 0 UNION ALL SELECT v, u FROM costs WHERE e >= 0), reach AS (SELECT seg AS node, seg AS r FROM nodes UNION SELECT a2.v, reach.r FROM reach JOIN a2 ON reach.node = a2.u WHERE reach.r < a2.v), c AS (SELECT node, min(r) AS component FROM reach GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component")
def mc13(spark, d):
    return multicut.attractive_components(costs(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query("mc24_edge_labels")
def mc24(spark, d):
    c = costs(spark, d)
    return multicut.cut_edges(c, cut(multicut.solve(c))).groupBy("cut").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query("mc9_lifted_gaec")
def mc9(spark, d):
    return workflow_lifted(spark, d, "gaec")


@query("mc10_lifted_kl")
def mc10(spark, d):
    return workflow_lifted(spark, d, "kl")


def workflow_lifted(spark, d, solver):
    """Lifted pairs at two hops; their cost is the balanced energy of the weaker edge on the best two-hop path."""
    e = cut(costs(spark, d))
    far = cut(graphs.k_hop(e.select("u", "v"), 2).select("u", "v"))
    b = graphs.both_ways(e, "cost")
    via = b.select("u", F.col("v").alias("m"), F.col("cost").alias("c1")).join(b.select(F.col("u").alias("m"), "v", "cost"), "m").filter("u < v").groupBy("u", "v").agg(F.max(F.least("c1", "cost")).alias("cost"))
    n, m = e.count(), max(1, far.count())
    lifted = far.join(via, ["u", "v"]).withColumn("cost", F.col("cost") / m)
    return multicut.solve(e.withColumn("cost", F.col("cost") / n), solver, lifted)


@query("mc29_merge_small", WITH_EDGES + """, small AS (SELECT seg FROM nodes WHERE n <= 14), nb AS (SELECT u AS seg, v AS nbr, n FROM edges UNION ALL SELECT v, u, n FROM edges),
  best AS (SELECT seg, nbr FROM (SELECT nb.*, row_number() OVER (PARTITION BY seg ORDER BY n DESC, nbr) AS r FROM nb JOIN small USING (seg)) WHERE r = 1),
  l AS (SELECT seg AS a, nbr AS b FROM best UNION SELECT nbr, seg FROM best), reach AS (SELECT seg AS node, seg AS r FROM nodes UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.node),
  c AS (SELECT node AS seg, min(r) AS m FROM reach GROUP BY node) SELECT seg, dense_rank() OVER (ORDER BY m)::BIGINT AS label FROM c""")
def mc29(spark, d):
    e, v = edges(spark, d), vox(spark, d)
    small = v.groupBy("seg").count().filter("count <= 14").select("seg")
    both = e.select(F.col("u").alias("seg"), F.col("v").alias("nbr"), "n").unionByName(e.select(F.col("v").alias("seg"), F.col("u").alias("nbr"), "n"))
    best = both.join(small, "seg", "left_semi").groupBy("seg").agg(F.min_by("nbr", F.struct((-F.col("n")).alias("n"), "nbr")).alias("nbr"))
    alone = v.select("seg").distinct().select(F.col("seg").alias("a"), F.col("seg").alias("b"))
    merged = cc.components(best.select(F.col("seg").alias("a"), F.col("nbr").alias("b")).unionByName(alone))
    return relabel.consecutive(merged, "component", 1).select(F.col("node").alias("seg"), F.col("new_label").alias("label"))


@query("jn12_path_pairs", WITH_VOX + ", f AS (SELECT DISTINCT gt AS obj, seg AS a FROM vox WHERE x = 0 OR x = 9) SELECT p.obj, p.a, q.a AS b FROM f p JOIN f q ON p.obj = q.obj AND p.a < q.a")
def jn12(spark, d):
    f = vox(spark, d).filter("x = 0 or x = 9").select(F.col("gt").alias("obj"), F.col("seg").alias("a")).distinct()
    return f.join(f.withColumnRenamed("a", "b"), "obj").filter("a < b")


def halves(spark, d):
    return learning.z_cutouts(vox(spark, d), (0.5,))


@query("ml3_forest_probabilities")
def ml3(spark, d):
    """Probabilities of the second half's edges from a forest over the first half's."""
    train, test = halves(spark, d)
    return learning.learn_and_predict([train], test).select("u", "v", "p")


@query("wf1_multicut_workflow")
def wf1(spark, d):
    """Learnt on the outer parts of the volume along z, solved on the middle."""
    low, middle, high = learning.z_cutouts(vox(spark, d))
    return workflows.multicut_workflow([low, high], middle)


@query("wf5_no_learning")
def wf5(spark, d):
    return cut(multicut.solve(costs(spark, d, scheme="z")))


@query("mc_end_to_end")
def end_to_end(spark, d):
    """Voxels to edges to energies to a partition to voxels to scores."""
    labels = cut(multicut.solve(costs(spark, d, scheme="z")))
    projected = vox(spark, d).join(labels.withColumnRenamed("node", "seg"), "seg")
    return metrics.rand_vi(metrics.contingency(projected, "label", "gt"))
