"""Sources and sinks, the rest of the projections, masks, and image operators with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cutgrove.operators import defects, features, images, rag, superpixels
from cutgrove.session import cut, scratch
from cutgrove.sources import catalog, graph_files, rasters, volumes

from .common import WITH_EDGES, WITH_FACES, WITH_PAIRS, WITH_VOX, edges, vox
from .feature_queries import LIFTED, lifted

QUERIES, ORACLE = {}, {}
BOX = (2, 8, 1, 9, 2, 60)
IN_BOX = "x >= 2 AND x < 8 AND y >= 1 AND y < 9 AND z >= 2 AND z < 60"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- sources and sinks


@query("src6_accessors", WITH_VOX + "SELECT x, y, z, CAST(raw AS FLOAT) AS raw, CAST(pm AS FLOAT) AS pm, seg, gt FROM vox")
def src6(spark, d):
    """Inputs by number as 32-bit floats, a segmentation and the ground truth; numbers out of range raise."""
    v = vox(spark, d)
    return v.select("x", "y", "z", volumes.input_channel(v, 0, ("raw", "pm")).alias("raw"), volumes.input_channel(v, 1, ("raw", "pm")).alias("pm"), "seg", "gt")


@query("src7_tiff_slices", WITH_VOX + "SELECT x, y, z, CAST(raw AS DOUBLE) AS value FROM vox")
def src7(spark, d):
    """Every slice encoded as a TIFF file and decoded again."""
    return rasters.decode_slices(rasters.encode_slices(vox(spark, d), "raw", "tiff", "<i4")).select("x", "y", "z", "value")


@query("src14_pnm_slices", WITH_VOX + "SELECT x, y, z, CAST(pm % 60000 AS DOUBLE) AS value FROM vox")
def src14(spark, d):
    """Every slice as a binary grey image of 16 bits and back."""
    v = vox(spark, d).withColumn("pm", F.col("pm") % 60000)
    return rasters.decode_slices(rasters.encode_slices(v, "pm", "pnm", "<u2"), "pnm").select("x", "y", "z", "value")


@query("src9_load_save", WITH_VOX + "SELECT x, y, z, CAST(raw AS DOUBLE) AS value FROM vox WHERE z >= 3")
def src9(spark, d):
    """A volume written and read by the suffix of its path, with a slice range that reaches the scan."""
    path = scratch(spark, "volume") + ".parquet"
    rasters.save(vox(spark, d).select("x", "y", "z", F.col("raw").cast("double").alias("value")), path)
    return rasters.load(spark, path).filter("z >= 3")


@query("src10_graph_saved", WITH_EDGES + "SELECT u, v, n, kind FROM edges")
def src10(spark, d):
    """A graph written to disk and read back."""
    path = scratch(spark, "graph")
    graph_files.save_graph(edges(spark, d).select("u", "v", "n", "kind"), path)
    return graph_files.load_graph(spark, path)


@query("src11_named_arrays", WITH_EDGES + "SELECT 'edges' AS name, count(*) AS n FROM edges UNION ALL SELECT 'nodes', count(*) FROM nodes")
def src11(spark, d):
    """Several named arrays in one folder."""
    path = scratch(spark, "arrays")
    graph_files.save_arrays({"edges": edges(spark, d).select("u", "v"), "nodes": vox(spark, d).select("seg").distinct()}, path)
    count = lambda name: graph_files.load_array(spark, path, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("edges").unionByName(count("nodes"))


@query("src12_rag_reloaded", WITH_EDGES + "SELECT u, v, n FROM edges WHERE u < 100")
def src12(spark, d):
    """The region adjacency graph from the cache: built once, then read, with a filter that reaches the scan."""
    folder = scratch(spark, "cache")
    for _ in range(2):
        e = catalog.cached(spark, folder, "rag", {"seg": 0}, lambda: edges(spark, d).select("u", "v", "n"))
    return e.filter("u < 100")


@query("src13_mesh_edges", WITH_EDGES + "SELECT u, v, s / (n * 200000.0) AS p FROM edges")
def src13(spark, d):
    """Edges as binary records and back."""
    return graph_files.decode_mesh(graph_files.encode_mesh(edges(spark, d).select("u", "v", (F.col("s") / (F.col("n") * 200000.0)).alias("p"))))


@query("src15_model_costs", WITH_EDGES + LIFTED + "SELECT u, v, 1 AS is_local, round(ln((1 - p) / p), 6) AS cost FROM (SELECT u, v, s / (n * 200000.0) AS p FROM edges) UNION ALL SELECT u, v, 0, round(ln((1 - p) / p), 6) FROM (SELECT u, v, ((u * 7 + v) % 97 + 1) / 99.0 AS p FROM lifted)")
def src15(spark, d):
    """A model from two tables of probabilities, local and lifted."""
    local = edges(spark, d).select("u", "v", (F.col("s") / (F.col("n") * 200000.0)).alias("p"))
    far = lifted(spark, d).withColumn("p", ((F.col("u") * 7 + F.col("v")) % 97 + 1) / 99.0)
    return graph_files.model_costs(local, far).withColumn("cost", F.round("cost", 6))


@query("src16_catalogue", WITH_VOX + ", m AS (SELECT max(z) // 2 AS half FROM vox), p AS (SELECT CASE WHEN z <= half THEN 'train' ELSE 'test' END AS name, count(*)::VARCHAR AS voxels, count(DISTINCT seg)::VARCHAR AS labels, max(z)::VARCHAR AS last FROM vox, m GROUP BY 1) SELECT name, 'voxels' AS field, voxels AS value FROM p UNION ALL SELECT name, 'labels', labels FROM p UNION ALL SELECT name, 'last', last FROM p")
def src16(spark, d):
    """Both halves of the volume as entries with what they hold: added, updated, one more removed, listed."""
    v = vox(spark, d)
    middle = (v.agg(F.max("z")).first()[0] or 0) // 2
    name = F.when(F.col("z") <= middle, "train").otherwise("test")
    c = catalog.Catalogue(spark, scratch(spark, "catalogue"))
    c.add("whole", voxels=v.count())
    for r in v.groupBy(name.alias("name")).agg(F.count("*").alias("voxels"), F.countDistinct("seg").alias("labels"), F.max("z").alias("last")).collect():  # one row a half
        c.add(r["name"], voxels=0)
        c.update(r["name"], voxels=r["voxels"], labels=r["labels"], last=r["last"])
    c.remove("whole")
    return c.entries().select("name", F.explode("fields").alias("field", "value"))


@query("src17_cached_result", WITH_EDGES + "SELECT count(*) AS n, 1 AS built FROM edges")
def src17(spark, d):
    """A result keyed by its parameters: two calls, one computation."""
    folder, calls = scratch(spark, "cache"), []

    def build():
        calls.append(1)
        return edges(spark, d).select("u", "v")

    for _ in range(2):
        e = catalog.cached(spark, folder, "edges", {"seg": 0, "sigma": 1.6}, build)
    return e.agg(F.count("*").alias("n")).withColumn("built", F.lit(len(calls)))


# ---- projections and masks


@query("prj6_local_weight", WITH_PAIRS + "SELECT x, y, z, axis, (pm + next_pm) / 2.0 AS w FROM pairs")
def prj6(spark, d):
    """Mean of both voxels on every pair of neighbours."""
    return rag.voxel_pairs(vox(spark, d)).select("x", "y", "z", "axis", ((F.col("pm") + F.col("next_pm")) / F.lit(2.0)).alias("w"))


@query("prj7_region_image", WITH_VOX + ", f AS (SELECT z, seg, min(x + 10 * y) AS region FROM vox GROUP BY z, seg) SELECT x, y, z, region FROM vox JOIN f USING (z, seg)")
def prj7(spark, d):
    """Regions of pixels joined by uncut edges of every slice's grid; here edges inside one label are uncut."""
    pairs = rag.voxel_pairs(vox(spark, d)).filter("axis < 2").select("x", "y", "z", "axis", (F.col("seg") != F.col("next_seg")).alias("cut"))
    return images.region_image(vox(spark, d), pairs).select("x", "y", "z", F.expr("first_x + 10 * first_y").alias("region"))


@query("prj9_between_planes", WITH_PAIRS + "SELECT x, y, z, 0 AS down, least(seg, next_seg) AS u, greatest(seg, next_seg) AS v FROM pairs WHERE seg <> next_seg AND axis = 2 UNION ALL SELECT x, y, z + 1, 1, least(seg, next_seg), greatest(seg, next_seg) FROM pairs WHERE seg <> next_seg AND axis = 2")
def prj9(spark, d):
    """Edges between planes on the lower voxel, and looking down on the upper one."""
    f = rag.faces(vox(spark, d)).filter("axis = 2").select("x", "y", "z", "u", "v")
    return f.withColumn("down", F.lit(0)).unionByName(f.withColumn("z", F.col("z") + 1).withColumn("down", F.lit(1)))


@query("prj10_skip_labels", WITH_VOX + ", p AS (SELECT a.x, a.y, a.z, least(a.seg, b.seg) AS u, greatest(a.seg, b.seg) AS v FROM vox a JOIN vox b ON a.x = b.x AND a.y = b.y AND b.z = a.z + 3 AND a.z % 7 = 1) SELECT x, y, z, (u + v) % 2 + 1 AS label FROM p WHERE (u * v) % 3 <> 0")
def prj10(spark, d):
    """Labels of skip edges between slices three apart, painted on the lower slice; pairs without a label are skipped."""
    v = vox(spark, d)
    starts = v.filter("z % 7 = 1").select("z").distinct().withColumn("reach", F.lit(3))
    found = images.skip_pairs(v, starts)
    labels = cut(found.select("u", "v").distinct().filter((F.col("u") * F.col("v")) % 3 != 0).withColumn("label", (F.col("u") + F.col("v")) % 2 + 1))
    return found.join(labels, ["u", "v"]).select("x", "y", "z", "label")


@query("prj12_membrane", WITH_VOX + "SELECT x, y, z, CASE WHEN coalesce(lead(seg) OVER wx, seg) <> coalesce(lag(seg) OVER wx, seg) OR coalesce(lead(seg) OVER wy, seg) <> coalesce(lag(seg) OVER wy, seg) THEN 1 ELSE 0 END AS membrane FROM vox WINDOW wx AS (PARTITION BY y, z ORDER BY x), wy AS (PARTITION BY x, z ORDER BY y)")
def prj12(spark, d):
    """1 where the gradient of the labels in a plane is not 0."""
    return images.membrane(vox(spark, d))


@query("prj14_cutout_with_defects", WITH_VOX + f", c AS (SELECT x - 2 AS x, y - 1 AS y, z - 2 AS z, seg, CASE WHEN gt IN (3, 5) THEN 0 ELSE gt END AS gt, z IN (3, 4, 7) AS defect FROM vox WHERE {IN_BOX}) SELECT x, y, z, CAST(dense_rank() OVER (ORDER BY seg) - 1 AS BIGINT) AS seg, gt, CAST(defect AS INTEGER) AS defect FROM c")
def prj14(spark, d):
    """A cutout in coordinates of its own, with consecutive labels, the parent's ignored ids and its bad slices moved along."""
    return volumes.child_cutout(vox(spark, d), BOX, ignore=(3, 5), bad=(3, 4, 7))


@query("prj15_artificial_edges", WITH_PAIRS + f", f AS (SELECT x, y, z, axis, CASE WHEN {IN_BOX} THEN 0 ELSE seg + 1 END AS a, x + CASE axis WHEN 0 THEN 1 ELSE 0 END AS x2, y + CASE axis WHEN 1 THEN 1 ELSE 0 END AS y2, z + CASE axis WHEN 2 THEN 1 ELSE 0 END AS z2, next_seg FROM pairs), g AS (SELECT a, CASE WHEN x2 >= 2 AND x2 < 8 AND y2 >= 1 AND y2 < 9 AND z2 >= 2 AND z2 < 60 THEN 0 ELSE next_seg + 1 END AS b FROM f) SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS n FROM g WHERE a <> b AND (a = 0 OR b = 0) GROUP BY ALL")
def prj15(spark, d):
    """Edges of an inverse cutout that exist only because the box became one region, 0."""
    inverse = volumes.inverse_cutout(vox(spark, d), BOX)
    return rag.edges(rag.faces(inverse)).filter("u = 0").select("u", "v", "n")


MASK = ", i AS (SELECT seg FROM node_gt WHERE gt % 5 = 0), bad AS (SELECT DISTINCT seg FROM vox WHERE z IN (3, 4, 7))"


@query("prj16_all_masks", WITH_EDGES + MASK + "SELECT u, v, CASE WHEN u IN (SELECT seg FROM i) OR v IN (SELECT seg FROM i) THEN 1 ELSE 0 END AS by_gt, CASE WHEN u = 0 THEN 1 ELSE 0 END AS by_seg, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS by_plane, CASE WHEN u IN (SELECT seg FROM bad) OR v IN (SELECT seg FROM bad) THEN 1 ELSE 0 END AS by_defect FROM edges")
def prj16(spark, d):
    """Why an edge is left out of learning: ignored objects, the segmentation mask, planes, bad slices."""
    v = vox(spark, d)
    ignored = rag.node_gt(v).filter("gt % 5 = 0").select("seg")
    return defects.learning_masks(edges(spark, d), {"by_gt": ignored, "by_defect": defects.defect_nodes(v, (3, 4, 7))}).select("u", "v", "by_gt", (F.col("u") == 0).cast("int").alias("by_seg"), (F.col("kind") == 0).cast("int").alias("by_plane"), "by_defect")


@query("prj17_lifted_masks", WITH_EDGES + LIFTED + MASK + "SELECT u, v, CASE WHEN u IN (SELECT seg FROM i) OR v IN (SELECT seg FROM i) THEN 1 ELSE 0 END AS by_gt, CASE WHEN u IN (SELECT seg FROM bad) OR v IN (SELECT seg FROM bad) THEN 1 ELSE 0 END AS by_defect, CASE WHEN a.z <> b.z THEN 1 ELSE 0 END AS by_plane FROM lifted JOIN (SELECT seg, max(z) AS z FROM vox GROUP BY seg) a ON a.seg = u JOIN (SELECT seg, max(z) AS z FROM vox GROUP BY seg) b ON b.seg = v")
def prj17(spark, d):
    """The same for lifted pairs; those between planes go where learning is in planes."""
    v = vox(spark, d)
    z = v.groupBy("seg").agg(F.max("z").alias("z"))
    pairs = rag.ends(lifted(spark, d), z, ("z",)).select("u", "v", (F.col("z_u") != F.col("z_v")).cast("int").alias("by_plane"))
    return defects.learning_masks(pairs, {"by_gt": rag.node_gt(v).filter("gt % 5 = 0").select("seg"), "by_defect": defects.defect_nodes(v, (3, 4, 7))}).select("u", "v", "by_gt", "by_defect", "by_plane")


@query("prj18_lifted_ignore_mask", WITH_EDGES + LIFTED + "SELECT l.u, l.v, CASE WHEN ((a.gt IN (1, 4) OR b.gt IN (1, 4)) AND a.gt <> b.gt) OR (a.gt IN (2, 3) AND b.gt IN (2, 3)) THEN 1 ELSE 0 END AS masked FROM lifted l JOIN node_gt a ON l.u = a.seg JOIN node_gt b ON l.v = b.seg")
def prj18(spark, d):
    """Lifted pairs that objects known to be falsely split or merged make useless."""
    return defects.ignore_mask(lifted(spark, d), rag.node_gt(vox(spark, d)), (1, 4), (2, 3))


@query("prj21_sized_components", WITH_VOX + ", s AS (SELECT gt, count(*) AS n FROM vox WHERE raw >= 0 GROUP BY gt) SELECT x, y, z, CASE WHEN n BETWEEN 100 AND 300 AND gt % 3 <> 0 THEN 1 ELSE 0 END AS label FROM vox JOIN s USING (gt)")
def prj21(spark, d):
    """Connected components of the kept labels with a size in range, as a binary volume; gt objects are connected."""
    return images.sized_components(vox(spark, d).withColumn("gt", F.when(F.col("gt") % 3 != 0, F.col("gt")).otherwise(-1)), "gt", 100, 300, background=-1)


@query("prj22_normalisations", WITH_VOX + ", m AS (SELECT avg(raw) AS mu, stddev_pop(raw) AS sd, min(raw) AS lo, max(raw) AS hi FROM vox) SELECT x, y, z, round((raw - mu) / (sd + 0.000001), 6) AS batch, CAST(raw AS FLOAT) AS cast32, round((raw / CAST(hi AS DOUBLE)) * 2 - 1, 6) AS centred, round(raw / 65535.0, 9) AS of_16_bit, round((raw - lo) / CAST(hi - lo AS DOUBLE), 6) AS whole FROM vox, m")
def prj22(spark, d):
    """Standardised, cast, centred around 0, as a share of n bits, and scaled to the volume's range."""
    return images.normalisations(vox(spark, d), "raw", 16)


@query("prj23_parameters", WITH_VOX + ", p AS (SELECT * FROM (VALUES ('defect_slice', 3::BIGINT), ('defect_slice', 4), ('defect_slice', 7), ('ignore_gt', 0), ('false_merge', 2), ('false_split', 5)) t(kind, value)) SELECT p.kind, p.value, count(vox.x) AS voxels FROM p LEFT JOIN vox ON CASE WHEN p.kind = 'defect_slice' THEN vox.z ELSE vox.gt END = p.value GROUP BY ALL")
def prj23(spark, d):
    """What users set on a data set, as a small table, and how many voxels each setting concerns."""
    p = volumes.parameters(spark, defect_slice=(3, 4, 7), ignore_gt=(0,), false_merge=(2,), false_split=(5,))
    each = F.explode(F.array(F.struct(F.lit("z").alias("of"), F.col("z").alias("value")), F.struct(F.lit("gt").alias("of"), F.col("gt").alias("value")))).alias("k")
    held = vox(spark, d).select(each).groupBy("k.of", "k.value").agg(F.count("*").alias("voxels"))
    asked = p.withColumn("of", F.when(F.col("kind") == "defect_slice", "z").otherwise("gt"))
    return asked.join(held, ["of", "value"], "left").select("kind", "value", F.coalesce("voxels", F.lit(0)).alias("voxels"))


@query("jn16_feature_names", WITH_FACES + ", s AS (SELECT u, v, sum(w)::DOUBLE AS total, min(w)::DOUBLE AS low, max(w)::DOUBLE AS high FROM faces GROUP BY u, v) SELECT u, v, 'total' AS name, 1::BIGINT AS at, total AS value FROM s UNION ALL SELECT u, v, 'low', 2, low FROM s UNION ALL SELECT u, v, 'high', 3, high FROM s")
def jn16(spark, d):
    """Features zipped with their names and places: the whole-number ones of the twelve statistics, one row a value."""
    found = features.edge_statistics(rag.faces(vox(spark, d)), F.col("w"))
    names = [c for c in found.columns if c not in ("u", "v")]
    zipped = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).cast("long").alias("at"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)))).alias("f")
    return found.select("u", "v", zipped).select("u", "v", "f.*").filter(F.col("name").isin("total", "low", "high"))


# ---- images


@query("im2_cutout_filters", WITH_VOX + ", f AS (SELECT x, y, z, lag(raw) OVER w + 2 * raw + lead(raw) OVER w AS v FROM vox WINDOW w AS (PARTITION BY y, z ORDER BY x)) SELECT x - 2 AS x, y - 1 AS y, z - 2 AS z, v FROM f WHERE " + IN_BOX)
def im2(spark, d):
    """A cutout takes the parent's filter table and cuts it: values at its rim come from beyond it."""
    w = Window.partitionBy("y", "z").orderBy("x")
    whole = vox(spark, d).select("x", "y", "z", (F.lag("raw").over(w) + 2 * F.col("raw") + F.lead("raw").over(w)).alias("v"))
    return volumes.cutout(whole, BOX).select((F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), (F.col("z") - 2).alias("z"), "v")


@query("im12_label_volume", WITH_VOX + ", f AS (SELECT gt, min(z * 100 + y * 10 + x) AS k FROM vox GROUP BY gt) SELECT x, y, z, (k // 100)::VARCHAR || ',' || (k // 10 % 10)::VARCHAR || ',' || (k % 10)::VARCHAR AS component FROM vox JOIN f USING (gt)")
def im12(spark, d):
    """Connected components of equal labels; every gt object is connected."""
    return images.label_volume(vox(spark, d), "gt")


@query("im12_label_slices", WITH_VOX + ", f AS (SELECT z, gt, min(x + 10 * y) AS k FROM vox GROUP BY z, gt) SELECT x, y, z, k AS component FROM vox JOIN f USING (z, gt)")
def im12_8(spark, d):
    """Components with eight neighbours inside every slice."""
    return superpixels.label_slices(vox(spark, d), "gt", 8).select("x", "y", "z", "component")


@query("im17_reflect_pad_all", WITH_VOX + ", px AS (SELECT x, y, z, raw FROM vox UNION ALL SELECT 18 - x, y, z, raw FROM vox WHERE x BETWEEN 7 AND 8), py AS (SELECT x, y, z, raw FROM px UNION ALL SELECT x, 18 - y, z, raw FROM px WHERE y BETWEEN 7 AND 8) SELECT x, y, z, raw FROM py")
def im17(spark, d):
    """x and y filled up to a multiple of four by reflection."""
    return images.reflect_to_multiple(vox(spark, d).select("x", "y", "z", "raw"), {"x": 4, "y": 4})


@query("im15_augmentations", WITH_VOX + """SELECT 'pad' AS op, x, y, z, raw FROM vox UNION ALL SELECT 'pad', -1, y, z, 0 FROM vox WHERE x = 0 UNION ALL SELECT 'trim', x - 2, y - 2, z, raw FROM vox WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7
  UNION ALL SELECT 'flip_z', x, y, (SELECT max(z) FROM vox) - z, raw FROM vox UNION ALL SELECT 'drop_slice', x, y, z, CASE WHEN z % 10 = 3 THEN 0 ELSE raw END FROM vox UNION ALL SELECT 'occlude', x, y, z, CASE WHEN x BETWEEN 3 AND 5 AND y BETWEEN 4 AND 6 THEN 0 ELSE raw END FROM vox
  UNION ALL SELECT 'complement', x, y, z, (SELECT max(raw) FROM vox) - raw FROM vox UNION ALL SELECT 'shift', x + 1, y, z, raw FROM vox WHERE x < 9 UNION ALL SELECT 'scale', x // 2, y // 2, z, CAST(max(raw) AS BIGINT) FROM vox GROUP BY x // 2, y // 2, z""")
def im15(spark, d):
    """The augmentations that are maps of voxels: pad, trim, flip along z, dropped slices, occlusion, complement, shift, coarser scale."""
    return images.augmentations(vox(spark, d))


@query("im15_time_to_channel", WITH_VOX + "SELECT x, y, z // 5 AS z, z % 5 AS channel, raw FROM vox")
def im15_time(spark, d):
    """Runs of five slices become channels of one."""
    return vox(spark, d).select("x", "y", F.expr("z div 5").alias("z"), (F.col("z") % 5).alias("channel"), "raw")


@query("im15_elastic")
def im15_elastic(spark, d):
    """A smooth random displacement, one for each slice by a seed, sampled at the nearest pixel."""
    return superpixels.elastic(vox(spark, d), "raw", 2.0, 3.0, 7)


@query("im1_filters_3d")
def im1_3d(spark, d):
    """Filters in three dimensions, five times narrower along z."""
    return images.filter_bank(vox(spark, d), "raw", (1.6, 4.2), 5.0)


@query("im4_signed_distance", WITH_VOX.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT z, x, y FROM vox WHERE pm >= 50000),
  r AS (SELECT z, x, y, y * 10 + x AS k FROM m UNION SELECT b.z, b.x, b.y, r.k FROM r JOIN m b ON b.z = r.z AND abs(b.x - r.x) + abs(b.y - r.y) = 1),
  c AS (SELECT z, x, y, min(k) AS k FROM r GROUP BY z, x, y), big AS (SELECT z, k FROM c GROUP BY z, k HAVING count(*) >= 3),
  v AS (SELECT vox.z, vox.x, vox.y, big.k IS NOT NULL AS on_ FROM vox LEFT JOIN c USING (z, x, y) LEFT JOIN big ON big.z = c.z AND big.k = c.k),
  d AS (SELECT a.z, a.x, a.y, a.on_, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM v a LEFT JOIN v b ON a.z = b.z AND a.on_ <> b.on_ GROUP BY ALL)
  SELECT x, y, z, CASE WHEN on_ THEN 1 - coalesce(d, sqrt(200)) ELSE coalesce(d, sqrt(200)) END AS distance FROM d""")
def im4(spark, d):
    """Distance to membrane outside, minus the distance to the rest inside, in every slice."""
    return superpixels.signed_distances(vox(spark, d), "pm", 50_000, 3)


@query("im4_signs", WITH_VOX + "SELECT count(*) AS voxels, 0 AS wrong FROM vox")
def im4_signs(spark, d):
    """No membrane voxel has a positive distance and no other one a negative distance, where nothing small is dropped."""
    s = superpixels.signed_distances(vox(spark, d), "pm", 50_000, 0).join(vox(spark, d).select("x", "y", "z", "pm"), ["x", "y", "z"])
    return s.agg(F.count("*").alias("voxels"), F.count(F.when((F.col("distance") > 0) == (F.col("pm") >= 50_000), 1)).cast("int").alias("wrong"))


@query("im5_seeds")
def im5(spark, d):
    """Local maxima, plateaus as one, of the smoothed distance in every slice."""
    return superpixels.seeds(vox(spark, d), "pm", 50_000, 0.8)


@query("im7_two_pass_watershed")
def im7(spark, d):
    """Watershed, small segments dropped, watershed again from the rest."""
    return superpixels.superpixels(vox(spark, d), "pm", superpixels.Options(50_000, least_segment=6))


@query("im8_watershed")
def im8(spark, d):
    return superpixels.superpixels(vox(spark, d), "pm", superpixels.Options(50_000))


@query("im8_grouped_watershed")
def im8_all(spark, d):
    """All options: small membranes and segments dropped, smoothed seeds and weights, seeds grouped by distance, grown on pm."""
    return superpixels.superpixels(vox(spark, d), "pm", superpixels.Options(50_000, 3, 6, 0.8, 0.8, True, True))


@query("im8_covered", WITH_VOX + "SELECT count(*) AS voxels, 0 AS empty, 0 AS shared FROM vox")
def im8_covered(spark, d):
    """Every voxel has a label, and no label lies in two slices."""
    s = cut(superpixels.superpixels(vox(spark, d), "pm", superpixels.Options(50_000, 3, 6, 0.8, 0.8, True, True)))
    spread = s.groupBy("label").agg(F.countDistinct("z").alias("k")).filter("k > 1").count()
    return s.agg(F.count("*").alias("voxels"), F.count(F.when(F.col("label") == 0, 1)).cast("int").alias("empty")).withColumn("shared", F.lit(spread))


@query("im9_pitched_watershed")
def im9(spark, d):
    """Distances over the volume with a pitch, then seeds and watershed in every slice."""
    return superpixels.pitched_superpixels(vox(spark, d), "pm", 50_000, 5.0)


@query("im10_smoothed_watershed")
def im10(spark, d):
    """Watershed of the smoothed map from its minima, eight neighbours."""
    return superpixels.smoothed_watershed(vox(spark, d), "pm", 1.0)


@query("im11_dense_ground_truth")
def im11(spark, d):
    """Labels grown over the membrane, then segments inside exactly one other joined to it."""
    return superpixels.dense_ground_truth(vox(spark, d).withColumn("label", F.when(F.col("pm") > 80_000, 0).otherwise(F.col("seg") + 1)), "label", "pm")


@query("im13_eccentricity_centres")
def im13(spark, d):
    """In every slice the voxel of each segment from which the farthest one is nearest."""
    return superpixels.eccentricity_centres(vox(spark, d), "seg")


@query("im13_inside", WITH_VOX + "SELECT count(*) AS centres FROM (SELECT DISTINCT z, seg FROM vox)")
def im13_inside(spark, d):
    """One centre a segment and slice, each inside its segment."""
    c = superpixels.eccentricity_centres(vox(spark, d), "seg")
    return c.join(vox(spark, d).select("x", "y", "z", "seg"), ["x", "y", "z", "seg"]).agg(F.count("*").alias("centres"))


SIDES = """, side AS (SELECT 'x0' AS face, seg, y AS a, z AS b FROM vox WHERE x = 0 UNION ALL SELECT 'x1', seg, y, z FROM vox WHERE x = 9 UNION ALL SELECT 'y0', seg, x, z FROM vox WHERE y = 0 UNION ALL SELECT 'y1', seg, x, z FROM vox WHERE y = 9),
  step(da, db) AS (SELECT * FROM range(-1, 2) AS s(da), range(-1, 2) AS t(db)),
  reach AS (SELECT face, seg, a, b, a + 10 * b AS r FROM side UNION SELECT t.face, t.seg, t.a, t.b, reach.r FROM reach, step JOIN side t ON true WHERE t.face = reach.face AND t.seg = reach.seg AND t.a = reach.a + da AND t.b = reach.b + db),
  piece AS (SELECT face, seg, a, b, min(r) AS piece FROM reach GROUP BY ALL),
  outside AS (SELECT DISTINCT face, seg, piece, a + da AS a, b + db AS b FROM piece, step WHERE NOT EXISTS (SELECT 1 FROM piece q WHERE q.face = piece.face AND q.seg = piece.seg AND q.piece = piece.piece AND q.a = piece.a + da AND q.b = piece.b + db)),
  inner_d AS (SELECT p.face, p.seg, p.piece, p.a, p.b, min((p.a - o.a) ** 2 + (p.b - o.b) ** 2) AS d FROM piece p JOIN outside o USING (face, seg, piece) GROUP BY ALL),
  deepest AS (SELECT *, max(d) OVER (PARTITION BY face, seg, piece) AS most FROM inner_d)
  SELECT face, seg, piece, CAST(round_even(avg(a), 0) AS BIGINT) AS a, CAST(round_even(avg(b), 0) AS BIGINT) AS b FROM deepest WHERE d = most GROUP BY face, seg, piece"""


@query("im14_face_centroids", WITH_VOX.replace("WITH ", "WITH RECURSIVE ", 1) + SIDES)
def im14(spark, d):
    """Where segments leave the volume: the innermost pixel of each of their pieces on the four sides."""
    return superpixels.face_centroids(vox(spark, d), "seg", 9, 9)


@query("jn13_grouped_seeds")
def jn13(spark, d):
    """Seeds of every slice that are closer to each other than either is to membrane, as groups."""
    return superpixels.grouped_seeds(vox(spark, d), "pm", 50_000)
