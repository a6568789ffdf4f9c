"""Whole feature tables: edges, regions, pairs of regions, topology, paths, and what defects change in them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cutgrove.functions import energies as en
from cutgrove.operators import defects, features, graphs, images, rag

from .common import BANK, WITH_EDGES, WITH_FACES, WITH_PAIRS, WITH_VOX, bank_names, bank_sql, edges, faces, vox
from .edge_queries import BAD, SKIP

QUERIES, ORACLE = {}, {}
TOP = 200_000.0


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df, keys, digits=None):
    """All columns but the keys as doubles, skewness and kurtosis to 4 digits, the rest to 6."""
    return df.select(*keys, *((F.round(F.col(c).cast("double"), 4 if c.split("_")[-1] in ("skew", "kurt") else 6) + 0.0).alias(c) for c in df.columns if c not in keys))


def stats_sql(source, keys, value="w"):
    """CTE st: EDGE_STATS of an integer-valued column by keys, rounded as above."""
    quantiles = ", ".join(f"round(quantile_cont(CAST({value} AS DOUBLE), {q}), 6) AS q{int(100 * q)}" for q in features.EDGE_QUANTILES)
    mean = f"mu AS (SELECT {keys}, avg({value}) AS mu FROM {source} GROUP BY {keys})"
    moments = f"mo AS (SELECT {keys}, avg(({value} - mu) ** 2) AS m2, avg(({value} - mu) ** 3) AS m3, avg(({value} - mu) ** 4) AS m4 FROM {source} JOIN mu USING ({keys}) GROUP BY {keys})"
    first = f"fi AS (SELECT {keys}, round(avg({value}), 6) AS mean, round(CAST(sum({value}) AS DOUBLE), 6) AS total, round(CAST(min({value}) AS DOUBLE), 6) AS low, round(CAST(max({value}) AS DOUBLE), 6) AS high, min({value}) = max({value}) AS flat, {quantiles} FROM {source} GROUP BY {keys})"
    last = f"st AS (SELECT {keys}, mean, total, low, high, round(m2, 6) AS var, CASE WHEN flat THEN 0.0 ELSE round(m3 / m2 ** 1.5, 4) + 0.0 END AS skew, CASE WHEN flat THEN 0.0 ELSE round(m4 / m2 ** 2 - 3, 4) + 0.0 END AS kurt, {', '.join(f'q{int(100 * q)}' for q in features.EDGE_QUANTILES)} FROM fi JOIN mo USING ({keys}))"
    return ", ".join((mean, moments, first, last))


#: Two-hop pairs that are no edge.
LIFTED = ", e2 AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), lifted AS (SELECT DISTINCT a.u, b.v FROM e2 a JOIN e2 b ON a.v = b.u WHERE a.u < b.v AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = a.u AND e.v = b.v))"


def lifted(spark, d):
    return graphs.k_hop(edges(spark, d).select("u", "v"), 2).select("u", "v")


# values are scaled by a prime so that no statistic ends exactly between two rounded numbers
SMALL = ", f AS (SELECT u, v, axis, w / 977.0 AS w FROM faces)"


def small_faces(spark, d):
    return faces(spark, d).select("u", "v", "axis", (F.col("w") / 977.0).alias("w"))


@query("ag1_all_statistics", WITH_FACES + SMALL + ", " + stats_sql("f", "u, v") + " SELECT * FROM st")
def ag1_all(spark, d):
    return rounded(features.edge_statistics(small_faces(spark, d), F.col("w")), ("u", "v"))


CHANNELS = ", f AS (SELECT least(seg, next_seg) AS u, greatest(seg, next_seg) AS v, 'pm' AS channel, (pm / 977.0 + next_pm / 977.0) / 2 AS w FROM pairs WHERE seg <> next_seg UNION ALL SELECT least(seg, next_seg), greatest(seg, next_seg), 'diff', (CAST(raw - pm AS DOUBLE) / 977.0 + CAST(next_raw - next_pm AS DOUBLE) / 977.0) / 2 FROM pairs WHERE seg <> next_seg)"


def channels():
    return {"pm": F.col("pm") / 977.0, "diff": (F.col("raw") - F.col("pm")).cast("double") / 977.0}


@query("ag2_channel_statistics", WITH_PAIRS + CHANNELS + ", " + stats_sql("f", "u, v, channel") + " SELECT * FROM st")
def ag2(spark, d):
    return rounded(features.channel_statistics(vox(spark, d), channels()), ("u", "v", "channel"))


_ch = " UNION ALL ".join(f"SELECT x, y, z, '{kind}_' || scale AS channel, {kind} AS w FROM fb" for kind in BANK)
_wide = ", ".join(f"max({s}) FILTER (channel = '{name}') AS {name}_{s}" for name, _, _ in bank_names(images.SIGMAS) for s in features.EDGE_STATS)
FILTERED = ", " + bank_sql("pm / 977.0", images.SIGMAS) + f""", ch AS ({_ch}), cw AS MATERIALIZED (SELECT x, y, z, list(channel ORDER BY channel) AS names, list(w ORDER BY channel) AS w FROM ch GROUP BY x, y, z),
  far AS (SELECT *, x + CASE axis WHEN 0 THEN 1 ELSE 0 END AS x2, y + CASE axis WHEN 1 THEN 1 ELSE 0 END AS y2, z + CASE axis WHEN 2 THEN 1 ELSE 0 END AS z2 FROM pairs WHERE seg <> next_seg),
  f AS MATERIALIZED (SELECT least(p.seg, p.next_seg) AS u, greatest(p.seg, p.next_seg) AS v, unnest(a.names) AS channel, (unnest(a.w) + unnest(b.w)) / 2 AS w FROM far p JOIN cw a ON a.x = p.x AND a.y = p.y AND a.z = p.z JOIN cw b ON b.x = p.x2 AND b.y = p.y2 AND b.z = p.z2)"""


@query("ag3_edge_features", WITH_PAIRS + FILTERED + ", " + stats_sql("f", "u, v, channel") + f" SELECT u, v, {_wide} FROM st GROUP BY u, v")
def ag3(spark, d):
    """The twelve statistics of every filter and scale, 12 x 12 columns; each filter is one channel."""
    v = vox(spark, d).withColumn("pm", F.col("pm") / 977.0)
    bank = images.filter_bank(v, "pm")
    names = [c for c in bank.columns if c not in ("x", "y", "z")]
    wide = bank.join(v.select("x", "y", "z", "seg"), ["x", "y", "z"])
    return rounded(features.wide_channels(features.channel_statistics(wide, {n: F.col(n) for n in names}), names), ("u", "v"))


@query("ag4_affinity_statistics", WITH_FACES + ", f AS (SELECT u, v, CASE WHEN axis < 2 THEN w / 977.0 ELSE 205.0 - w / 977.0 END AS w FROM faces), " + stats_sql("f", "u, v") + " SELECT * FROM st")
def ag4_all(spark, d):
    return rounded(features.edge_statistics(features.affinity_faces(small_faces(spark, d), 205.0), F.col("w")), ("u", "v"))


_c = {f"{a}{b}": f"covar_pop({a}, {b})" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
_q = ", ".join(f"round(quantile_cont(CAST(val AS DOUBLE), {q}), 6) AS q{int(100 * q)}" for q in features.REGION_QUANTILES)
REGIONS = f""", rv AS (SELECT seg, x, y, z, raw / 97.0 AS val FROM vox), rmu AS (SELECT seg, avg(val) AS mu FROM rv GROUP BY seg),
  rmo AS (SELECT seg, avg((val - mu) ** 2) AS m2, avg((val - mu) ** 3) AS m3, avg((val - mu) ** 4) AS m4 FROM rv JOIN rmu USING (seg) GROUP BY seg),
  rag AS (SELECT seg, CAST(count(*) AS DOUBLE) AS n, max(val) AS high, min(val) AS low, {_q}, round(sum(val), 6) AS total, round(sum(x * val) / sum(val), 6) AS wx, round(sum(y * val) / sum(val), 6) AS wy, round(sum(z * val) / sum(val), 6) AS wz, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz,
    {', '.join(f'{f} AS c{k}' for k, f in _c.items())} FROM rv GROUP BY seg),
  rp AS (SELECT seg, (cxx + cyy + czz) / 3 AS me, cxy * cxy + cxz * cxz + cyz * cyz AS o FROM rag),
  rr AS (SELECT seg, me, sqrt(((cxx - me) ** 2 + (cyy - me) ** 2 + (czz - me) ** 2 + 2 * o) / 6) AS p,
    (cxx - me) * ((cyy - me) * (czz - me) - cyz * cyz) - cxy * (cxy * (czz - me) - cyz * cxz) + cxz * (cxy * cyz - (cyy - me) * cxz) AS dt FROM rag JOIN rp USING (seg)),
  re AS (SELECT seg, CASE WHEN p = 0 THEN me ELSE me + 2 * p * cos(acos(greatest(-1.0, least(1.0, dt / (2 * p * p * p)))) / 3) END AS e1, CASE WHEN p = 0 THEN me ELSE me + 2 * p * cos(acos(greatest(-1.0, least(1.0, dt / (2 * p * p * p)))) / 3 + {2 * math.pi / 3!r}) END AS e3, me FROM rr),
  regions AS (SELECT seg, n, CASE WHEN low = high THEN 0.0 ELSE round(m4 / m2 ** 2 - 3, 4) + 0.0 END AS kurt, round(high, 6) AS high, round(low, 6) AS low, {', '.join(f'q{int(100 * q)}' for q in features.REGION_QUANTILES)},
    round(sqrt(greatest(e1, 0)), 4) AS r1, round(sqrt(greatest(3 * me - e1 - e3, 0)), 4) AS r2, round(sqrt(greatest(e3, 0)), 4) AS r3, CASE WHEN low = high THEN 0.0 ELSE round(m3 / m2 ** 1.5, 4) + 0.0 END AS skew, total, round(m2, 6) AS var, wx, wy, wz, cx, cy, cz
    FROM rag JOIN rmo USING (seg) JOIN re USING (seg))"""


def regions(spark, d):
    found = features.region_statistics(vox(spark, d).withColumn("raw", F.col("raw") / 97.0))
    return rounded(found, ("seg",)).withColumns({r: F.round(r, 4) for r in ("r1", "r2", "r3")})


@query("ag5_region_features", WITH_VOX + REGIONS.replace(", rv", " , rv", 1) + " SELECT * FROM regions")
def ag5_all(spark, d):
    return regions(spark, d)


COMBINE = {"lo": "least(a.{0}, b.{0})", "hi": "greatest(a.{0}, b.{0})", "diff": "abs(a.{0} - b.{0})", "sum": "a.{0} + b.{0}"}


def pairs_sql(pairs):
    stats = ", ".join(f"round({f.format(n)}, 6) AS {k}_{n}" for k, f in COMBINE.items() for n in features.REGION_STATS)
    apart = ", ".join(f"round((a.{c} - b.{c}) * (a.{c} - b.{c}), 6) AS d{c}" for c in features.CENTRES)
    return f"SELECT p.u, p.v, {stats}, {apart} FROM {pairs} p JOIN regions a ON p.u = a.seg JOIN regions b ON p.v = b.seg"


def round_all(df):
    return df.select("u", "v", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c not in ("u", "v")))


@query("ag6_region_pair_features", WITH_EDGES + REGIONS + pairs_sql("edges"))
def ag6_all(spark, d):
    return round_all(features.pair_statistics(edges(spark, d), regions(spark, d)))


@query("mc28_lifted_region_features", WITH_EDGES + LIFTED + REGIONS + pairs_sql("lifted"))
def mc28(spark, d):
    """The region part of the lifted features: the same combination over lifted pairs."""
    return round_all(features.pair_statistics(lifted(spark, d), regions(spark, d)))


TOPOLOGY = """, ar AS (SELECT seg, sum(n) AS around FROM (SELECT u AS seg, n FROM edges WHERE kind = 1 UNION ALL SELECT v, n FROM edges WHERE kind = 1) GROUP BY seg),
  sh AS (SELECT a.seg, a.n AS size, CASE WHEN coalesce(around, 0) = 0 THEN 0.0 ELSE CAST(a.n AS DOUBLE) / around END AS shape FROM nodes a LEFT JOIN ar USING (seg)),
  topo AS (SELECT e.u, e.v, e.n AS len, e.kind, CASE WHEN e.kind = 0 THEN a.size + b.size - e.n ELSE 0 END AS uni, CASE WHEN e.kind = 0 AND a.size + b.size <> e.n THEN CAST(e.n AS DOUBLE) / (a.size + b.size - e.n) ELSE 0.0 END AS iou,
    CASE WHEN e.kind = 0 THEN least(a.shape, b.shape) ELSE 0.0 END AS shape_lo, CASE WHEN e.kind = 0 THEN greatest(a.shape, b.shape) ELSE 0.0 END AS shape_hi, CASE WHEN e.kind = 0 THEN abs(a.shape - b.shape) ELSE 0.0 END AS shape_diff FROM edges e JOIN sh a ON e.u = a.seg JOIN sh b ON e.v = b.seg)"""


@query("ag8_topology_features", WITH_EDGES + TOPOLOGY + " SELECT u, v, len, kind, CAST(uni AS BIGINT) AS uni, round(iou, 6) AS iou, round(shape_lo, 6) AS shape_lo, round(shape_hi, 6) AS shape_hi, round(shape_diff, 6) AS shape_diff FROM topo")
def ag8_all(spark, d):
    t = features.topology(edges(spark, d), vox(spark, d))
    return t.withColumns({c: F.round(c, 6) for c in ("iou", "shape_lo", "shape_hi", "shape_diff")}).withColumn("uni", F.col("uni").cast("long"))


@query("ag15_lifted_fuzzy_gt", WITH_EDGES + LIFTED + """, o AS (SELECT seg, gt, count(*) AS n FROM vox GROUP BY seg, gt), t AS (SELECT seg, sum(n) AS t FROM o GROUP BY seg),
  h AS (SELECT e.u, e.v, sum(a.n * b.n) AS same FROM lifted e JOIN o a ON e.u = a.seg JOIN o b ON e.v = b.seg AND a.gt = b.gt GROUP BY e.u, e.v)
  SELECT e.u, e.v, CASE WHEN p > 0.6 THEN 1.0 WHEN p < 0.4 THEN 0.0 ELSE 0.5 END::DOUBLE AS label FROM (SELECT e.u, e.v, 1 - CAST(coalesce(h.same, 0) AS DOUBLE) / CAST(a.t * b.t AS DOUBLE) AS p FROM lifted e LEFT JOIN h USING (u, v) JOIN t a ON e.u = a.seg JOIN t b ON e.v = b.seg) e""")
def ag15_fuzzy(spark, d):
    v = vox(spark, d)
    o = v.groupBy("seg", "gt").agg(F.count("*").alias("n"))
    e = lifted(spark, d)
    same = e.join(o.select(F.col("seg").alias("u"), "gt", F.col("n").alias("a")), "u").join(o.select(F.col("seg").alias("v"), "gt", F.col("n").alias("b")), ["v", "gt"]).groupBy("u", "v").agg(F.sum(F.col("a") * F.col("b")).alias("same"))
    t = v.groupBy("seg").agg(F.count("*").alias("t"))
    p = 1 - F.coalesce("same", F.lit(0)).cast("double") / (F.col("t_u") * F.col("t_v")).cast("double")
    return rag.ends(e.join(same, ["u", "v"], "left"), t, ("t",)).select("u", "v", F.when(p > 0.6, 1.0).when(p < 0.4, 0.0).otherwise(0.5).alias("label"))


@query("ag24_line_path_features", WITH_VOX + ", f AS (SELECT z * 1000 + y AS path_id, raw / 97.0 AS w FROM vox), " + stats_sql("f", "path_id") + " SELECT path_id, mean, total, low, high, var, skew, kurt FROM st")
def ag24_all(spark, d):
    """Seven statistics along every row of voxels, the paths of this volume."""
    rows = vox(spark, d).select((F.col("z") * 1000 + F.col("y")).alias("path_id"), (F.col("raw") / 97.0).alias("w"))
    found = rows.groupBy("path_id").agg(*features.statistics(F.col("w")))
    return rounded(found, ("path_id",)).select("path_id", "mean", "total", "low", "high", "var", "skew", "kurt")


@query("ag26_state_statistics", WITH_EDGES + "SELECT u, v, CAST(u % 2 + v % 2 + (u + v) % 3 AS BIGINT) AS total, round((u % 2 + v % 2 + (u + v) % 3) / 3.0, 6) AS mean, round(sqrt(((u % 2) ** 2 + (v % 2) ** 2 + ((u + v) % 3) ** 2) / 3.0 - ((u % 2 + v % 2 + (u + v) % 3) / 3.0) ** 2), 6) AS dev FROM edges")
def ag26_all(spark, d):
    """Sum, mean and deviation over the states that candidate solutions give an edge."""
    states = F.array(F.col("u") % 2, F.col("v") % 2, (F.col("u") + F.col("v")) % 3)
    e = edges(spark, d).select("u", "v", states.alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    square = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x * x)
    mean = total / 3.0
    return e.select("u", "v", total.alias("total"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(square / 3.0 - mean * mean), 6).alias("dev"))


def slope(c: str) -> str:
    """Central differences in order ``w``, one-sided at either end."""
    return f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2.0 END"


CURVES = f""", sp AS (SELECT u, v, max(x) - min(x) >= max(y) - min(y) AS wide FROM faces WHERE axis < 2 GROUP BY u, v),
  o AS (SELECT u, v, f.x, f.y, row_number() OVER (PARTITION BY u, v ORDER BY CASE WHEN wide THEN f.x ELSE f.y END, CASE WHEN wide THEN f.y ELSE f.x END) AS i FROM faces f JOIN sp USING (u, v) WHERE axis < 2),
  d1 AS (SELECT u, v, i, {slope('x')} AS dx, {slope('y')} AS dy FROM o WINDOW w AS (PARTITION BY u, v ORDER BY i)),
  d2 AS (SELECT u, v, dx, dy, {slope('dx')} AS ddx, {slope('dy')} AS ddy, count(*) OVER (PARTITION BY u, v) AS n FROM d1 WINDOW w AS (PARTITION BY u, v ORDER BY i)),
  k AS (SELECT u, v, CASE WHEN n > 2 AND dx * dx + dy * dy > 0 THEN (dx * ddy - dy * ddx) / (dx * dx + dy * dy) ** 1.5 ELSE 0 END AS k FROM d2)
  SELECT u, v, round(avg(k), 6) + 0.0 AS mean, round(min(k), 6) + 0.0 AS low, round(max(k), 6) + 0.0 AS high, round(stddev_pop(k), 6) + 0.0 AS dev FROM k GROUP BY u, v"""


@query("ag12_curvature", WITH_FACES + CURVES)
def ag12(spark, d):
    """Mean, min, max and deviation of the curvature of every in-plane boundary, ordered along its longer axis."""
    return rounded(features.curvature(faces(spark, d).filter("axis < 2")), ("u", "v"))


# ---- what defects change


MOD = SKIP + """, b AS (SELECT DISTINCT seg FROM vox WHERE z IN (3, 4, 7)), h AS (SELECT u, v, n, s, kind, (u IN (SELECT seg FROM b) OR v IN (SELECT seg FROM b)) AS hit FROM edges),
  nsk AS (SELECT * FROM sk WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = sk.u AND e.v = sk.v))"""


def parts(spark, d):
    """(edges with hit, new skip edges)"""
    v = vox(spark, d)
    e = defects.marked(edges(spark, d), v, BAD)
    return e, defects.skip_edges(v, BAD).join(e.select("u", "v"), ["u", "v"], "left_anti")


@query("df2_accessors", WITH_EDGES + MOD + """SELECT 'node' AS part, seg AS a, z AS b, 0::BIGINT AS c FROM (SELECT DISTINCT seg, z FROM vox WHERE z IN (3, 4, 7))
  UNION ALL SELECT 'delete', u, v, 0 FROM h WHERE hit AND kind = 0 UNION ALL SELECT 'ignore', u, v, 0 FROM h WHERE hit AND kind = 1 UNION ALL SELECT 'skip', u, v, skip_range FROM nsk
  UNION ALL SELECT 'start', u, least(a.z, b.z), skip_range FROM nsk JOIN (SELECT seg, max(z) AS z FROM vox GROUP BY seg) a ON a.seg = nsk.u JOIN (SELECT seg, max(z) AS z FROM vox GROUP BY seg) b ON b.seg = nsk.v""")
def df2_all(spark, d):
    """All accessors of a defective volume as one table: bad nodes, edges to delete, to ignore, skip edges with range and start."""
    e, skip = parts(spark, d)
    v = vox(spark, d)
    z = v.groupBy("seg").agg(F.max("z").alias("z"))
    start = rag.ends(skip, z, ("z",))
    zero = F.lit(0).cast("long")
    rows = lambda df, part, *c: df.select(F.lit(part).alias("part"), *(F.col(x).alias(k) if isinstance(x, str) else x.alias(k) for x, k in zip(c, "abc")))
    found = rows(v.filter(F.col("z").isin(*BAD)).select("seg", "z").distinct(), "node", "seg", "z", zero)
    for name, df in (("delete", e.filter("hit and kind = 0")), ("ignore", e.filter("hit and kind = 1"))):
        found = found.unionByName(rows(df, name, "u", "v", zero))
    return found.unionByName(rows(skip, "skip", "u", "v", "skip_range")).unionByName(rows(start, "start", "u", F.least("z_u", "z_v"), "skip_range"))


@query("df3_modified_indications", WITH_EDGES + MOD + "SELECT u, v, kind, CASE WHEN a.gt <> b.gt THEN 1 ELSE 0 END AS label FROM (SELECT u, v, kind FROM h WHERE NOT (hit AND kind = 0) UNION ALL SELECT u, v, 0 FROM nsk) m JOIN node_gt a ON m.u = a.seg JOIN node_gt b ON m.v = b.seg")
def df3(spark, d):
    """Kind of the modified edges, 0 for skip edges, and their ground truth."""
    e, skip = parts(spark, d)
    both = e.filter("not (hit and kind = 0)").select("u", "v", "kind").unionByName(skip.select("u", "v", F.lit(0).alias("kind")))
    return rag.ends(both, rag.node_gt(vox(spark, d)), ("gt",)).select("u", "v", "kind", (F.col("gt_u") != F.col("gt_v")).cast("int").alias("label"))


@query("df4_modified_edge_features", WITH_EDGES + MOD + """, g2 AS (SELECT x, y, z, seg, pm, lead(seg) OVER w2 AS up, lead(pm) OVER w2 AS pu, lead(z) OVER w2 - z AS r FROM vox WHERE z NOT IN (3, 4, 7) WINDOW w2 AS (PARTITION BY x, y ORDER BY z)),
  f AS (SELECT f.u, f.v, w / 977.0 AS w FROM faces f JOIN h USING (u, v) WHERE NOT (hit AND kind = 0) UNION ALL SELECT least(seg, up), greatest(seg, up), (pm + pu) / 977.0 FROM g2 JOIN nsk ON nsk.u = least(seg, up) AND nsk.v = greatest(seg, up) WHERE r > 1), """ + stats_sql("f", "u, v") + " SELECT * FROM st")
def df4_all(spark, d):
    """The twelve statistics of surviving edges over their faces, of skip edges over the voxels that face each other."""
    e, skip = parts(spark, d)
    kept = small_faces(spark, d).join(e.filter("not (hit and kind = 0)").select("u", "v"), ["u", "v"], "left_semi").select("u", "v", "w")
    over = defects.skip_faces(vox(spark, d), BAD).join(skip.select("u", "v"), ["u", "v"], "left_semi").select("u", "v", (F.col("w") / 977.0).alias("w"))
    return rounded(features.edge_statistics(kept.unionByName(over), F.col("w")), ("u", "v"))


@query("df5_modified_region_features", WITH_EDGES + MOD + REGIONS + ", mp AS (SELECT u, v, 1::BIGINT AS skip_range FROM h WHERE NOT (hit AND kind = 0) UNION ALL SELECT u, v, skip_range FROM nsk) " + pairs_sql("mp").replace("SELECT p.u, p.v,", "SELECT p.u, p.v, CAST(p.skip_range AS DOUBLE) AS skip_range,"))
def df5(spark, d):
    """Region features of surviving and skip edges with a last column: 1, or the range that a skip edge bridges."""
    e, skip = parts(spark, d)
    both = e.filter("not (hit and kind = 0)").select("u", "v", F.lit(1).cast("long").alias("skip_range")).unionByName(skip.select("u", "v", "skip_range"))
    return round_all(features.pair_statistics(both, regions(spark, d)).join(both, ["u", "v"]))


@query("df6_modified_topology", WITH_EDGES + MOD + """, ar AS (SELECT seg, sum(n) AS around FROM (SELECT u AS seg, n FROM edges WHERE kind = 1 UNION ALL SELECT v, n FROM edges WHERE kind = 1) GROUP BY seg),
  sh AS (SELECT a.seg, a.n AS size, CASE WHEN coalesce(around, 0) = 0 THEN 0.0 ELSE CAST(a.n AS DOUBLE) / around END AS shape FROM nodes a LEFT JOIN ar USING (seg)), m AS (SELECT u, v, n, kind FROM h WHERE NOT (hit AND kind = 0) UNION ALL SELECT u, v, n, 0 FROM nsk)
  SELECT e.u, e.v, e.n AS len, e.kind, CAST(CASE WHEN e.kind = 0 THEN a.size + b.size - e.n ELSE 0 END AS BIGINT) AS uni, round(CASE WHEN e.kind = 0 AND a.size + b.size <> e.n THEN CAST(e.n AS DOUBLE) / (a.size + b.size - e.n) ELSE 0.0 END, 6) AS iou, round(CASE WHEN e.kind = 0 THEN least(a.shape, b.shape) ELSE 0.0 END, 6) AS shape_lo, round(CASE WHEN e.kind = 0 THEN greatest(a.shape, b.shape) ELSE 0.0 END, 6) AS shape_hi, round(CASE WHEN e.kind = 0 THEN abs(a.shape - b.shape) ELSE 0.0 END, 6) AS shape_diff FROM m e JOIN sh a ON e.u = a.seg JOIN sh b ON e.v = b.seg""")
def df6(spark, d):
    """Topology features of surviving and skip edges; a skip edge counts as one between planes."""
    e, skip = parts(spark, d)
    both = e.filter("not (hit and kind = 0)").select("u", "v", "n", "kind").unionByName(skip.select("u", "v", "n", F.lit(0).alias("kind")))
    # perimeters come from all edges in a plane: they all survive
    t = features.topology(both, vox(spark, d))
    return t.withColumns({c: F.round(c, 6) for c in ("iou", "shape_lo", "shape_hi", "shape_diff")}).withColumn("uni", F.col("uni").cast("long"))


@query("df7_modified_energies", WITH_EDGES + MOD + """, g2 AS (SELECT seg, pm, lead(seg) OVER w2 AS up, lead(pm) OVER w2 AS pu, lead(z) OVER w2 - z AS r FROM vox WHERE z NOT IN (3, 4, 7) WINDOW w2 AS (PARTITION BY x, y ORDER BY z)),
  ks AS (SELECT least(seg, up) AS u, greatest(seg, up) AS v, sum(pm + pu) AS s FROM g2 WHERE r > 1 GROUP BY ALL), m AS (SELECT u, v, n, kind, s, hit FROM h WHERE NOT (hit AND kind = 0) UNION ALL SELECT nsk.u, nsk.v, n, 0, ks.s, false FROM nsk JOIN ks USING (u, v)),
  q AS (SELECT *, 0.001 + 0.998 * (s / (n * 200000.0)) AS q FROM m), w AS (SELECT *, (ln((1 - q) / q) + ln(0.6 / 0.4)) * CASE WHEN kind = 0 THEN 16.0 * n / (SELECT max(n) FROM m WHERE kind = 0) ELSE 1 END AS e FROM q)
  SELECT u, v, round(CASE WHEN hit THEN 2 * (SELECT min(e) FROM w) ELSE e END, 6) AS e FROM w""")
def df7(spark, d):
    """Energies of the modified edges, weighed between planes; edges to ignore are twice the most repulsive one."""
    return defects.modified_energies(*parts(spark, d), defects.skip_faces(vox(spark, d), BAD), 0.4, 16.0).select("u", "v", F.round("e", 6).alias("e"))


@query("df8_replace_by_runs", "WITH r(z, source) AS (VALUES (3, 2), (4, 5), (7, 6), (20, 19), (21, 19), (22, 23), (30, 29), (31, 29), (32, 34), (33, 34)) SELECT CAST(z AS BIGINT) AS z, CAST(source AS BIGINT) AS source FROM r")
def df8_runs(spark, d):
    """Sources of bad slices by runs of one to four, whatever the depth of the volume beyond them."""
    depth = max(40, (vox(spark, d).agg(F.max("z")).first()[0] or 0) + 1)
    return spark.createDataFrame(defects.run_sources((3, 4, 7, 20, 21, 22, 30, 31, 32, 33), depth), "z long, source long")


@query("df9_insert_missing", WITH_VOX + ", s(z, source) AS (VALUES (3, 2), (6, 4)), i AS (SELECT z + (SELECT count(*) FROM s WHERE s.z <= vox.z) AS z, x, y, seg FROM vox), n AS (SELECT s.z + row_number() OVER (ORDER BY s.z) - 1 AS z, source FROM s) SELECT x, y, z, seg FROM i UNION ALL SELECT vox.x, vox.y, n.z, vox.seg FROM n JOIN vox ON vox.z = n.source")
def df9(spark, d):
    """Slices that are missing before z = 3 and z = 6 come in as copies of others; later slices move up."""
    return defects.insert_slices(vox(spark, d).select("x", "y", "z", "seg"), {3: 2, 6: 4})
