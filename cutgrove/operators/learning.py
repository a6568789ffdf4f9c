"""Random forests over edges, lifted pairs and paths. Training and test volumes are different voxel tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrove.session import cut

from . import defects, features, images, rag
from .relabel import consecutive

#: Kinds of local features: the filters over raw and over the map, regions, topology. Others: affinities, plain values.
LOCAL = ("raw", "prob", "reg", "topo")
#: Columns of the inputs that filters work on, by kind.
INPUTS = {"raw": "raw", "prob": "pm"}


@dataclass(frozen=True)
class Forest:
    trees: int = 20
    depth: int = 8
    seed: int = 42


def z_cutouts(voxels: DataFrame, shares: tuple = (0.2, 0.8)) -> list[DataFrame]:
    """The volume cut along z at the given shares of its depth, each part in one piece with labels of its own."""
    depth = (voxels.agg(F.max("z")).first()[0] or 0) + 1
    edges = [0, *(round(s * depth) for s in shares), depth]
    parts = [voxels.filter((F.col("z") >= a) & (F.col("z") < b)) for a, b in zip(edges, edges[1:])]
    return [cut(consecutive(p, "seg").drop("seg").withColumnRenamed("new_label", "seg")) for p in parts]


def graph(voxels: DataFrame) -> DataFrame:
    return cut(rag.edges(rag.faces(voxels)))


def local_features(voxels: DataFrame, edges: DataFrame, kinds: tuple = LOCAL, more: DataFrame | None = None) -> DataFrame:
    """(u, v, f_...): the kinds of features side by side; odd values are 0. more(u, v, numbers): other columns, of edges to keep."""
    found = []
    inputs = tuple(INPUTS[k] for k in kinds if k in INPUTS)
    if "plain" in kinds:
        found.append(_named(features.wide_statistics(voxels, list(INPUTS.values()))))
    if "affinities" in kinds:
        found.append(fine(features.edge_statistics(features.affinity_faces(rag.faces(voxels), 200_000.0), F.col("w")).withColumnsRenamed({n: f"aff_{n}" for n in features.EDGE_STATS}), ("u", "v")))
    if "reg" in kinds:
        found.append(fine(features.pair_statistics(edges, features.region_statistics(voxels)), ("u", "v")))
    if "topo" in kinds:
        found.append(fine(features.topology(edges, voxels), ("u", "v")))
    if more is not None:
        found.append(more)
    narrow = reduce(lambda a, b: a.join(b, ["u", "v"]), found) if found else None
    if not inputs:
        return narrow
    faces, names = images.filter_faces(voxels, inputs)
    wide = features.face_statistics(faces, names, narrow)
    stats = [f"{c}_{s}" for c in names for s in features.EDGE_STATS]
    return wide.withColumnsRenamed({c: f"f_{c}" for c in stats})


def _named(wide: DataFrame) -> DataFrame:
    return wide.toDF(*(c if c in ("u", "v") else f"f_{c}" for c in wide.columns))


def fine(wide: DataFrame, keys: tuple) -> DataFrame:
    """All columns but the keys as doubles named f_<name>, what is not finite as 0."""
    one = lambda v: f"CASE WHEN isnan({v}) OR abs({v}) = double('infinity') THEN 0D ELSE coalesce({v}, 0D) END"
    return wide.selectExpr(*keys, *(f"{one(f'CAST(`{c}` AS DOUBLE)')} AS `f_{c}`" for c in wide.columns if c not in keys))


def edge_labels(edges: DataFrame, voxels: DataFrame) -> DataFrame:
    """(u, v, label): 1 where the ends belong to different objects."""
    return rag.ends(edges.select("u", "v"), rag.node_gt(voxels), ("gt",)).select("u", "v", (F.col("gt_u") != F.col("gt_v")).cast("double").alias("label"))


def masked(edges: DataFrame, voxels: DataFrame, ignore_gt: tuple = (), in_plane: bool = False, bad: tuple = ()) -> DataFrame:
    """Edges to learn from: without ignored objects, edges between planes if only planes count, and bad slices."""
    nodes = {"by_gt": rag.node_gt(voxels).filter(F.col("gt").isin(*ignore_gt) if ignore_gt else F.lit(False)).select("seg"), "by_defect": defects.defect_nodes(voxels, bad) if bad else voxels.select("seg").limit(0)}
    kept = defects.learning_masks(edges, nodes).filter("by_gt = 0 and by_defect = 0")
    return (kept.filter("kind = 1") if in_plane else kept).drop("by_gt", "by_defect")


def _vectors(rows: DataFrame) -> DataFrame:
    names = sorted(c for c in rows.columns if c.startswith("f_"))
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows).drop(*names)


def train(rows: DataFrame, forest: Forest = Forest()):
    """A model of rows(f_..., label); a class without rows raises."""
    rows = cut(_vectors(rows))
    if rows.select("label").distinct().count() < 2:
        raise ValueError("learning needs rows of both classes")
    return RandomForestClassifier(numTrees=forest.trees, maxDepth=forest.depth, seed=forest.seed).fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """rows with p, the share of votes for class 1; 0.5 where there is none."""
    p = vector_to_array("probability")[1]
    out = model.transform(_vectors(rows))
    return out.select(*(c for c in out.columns if c not in ("features", "rawPrediction", "probability", "prediction")), F.coalesce(F.nanvl(p, F.lit(0.5)), F.lit(0.5)).alias("p"))


def training_rows(volumes: list[DataFrame], kinds: tuple = LOCAL, **masks) -> DataFrame:
    """Features and labels of all training volumes, less the masked edges."""
    parts = []
    for v in volumes:
        e = graph(v)
        parts.append(local_features(v, e, kinds, masked(e, v, **masks).select("u", "v").join(edge_labels(e, v), ["u", "v"])).drop("u", "v"))
    return reduce(DataFrame.unionByName, parts)


def learn_and_predict(volumes: list[DataFrame], test: DataFrame, kinds: tuple = LOCAL, forest: Forest = Forest(), **masks) -> DataFrame:
    """(u, v, n, kind, p) of the test volume's edges, learnt on other volumes."""
    return judged(train(training_rows(volumes, kinds, **masks), forest), test, kinds)


def judged(model, test: DataFrame, kinds: tuple = LOCAL) -> DataFrame:
    """(u, v, n, kind, p) of a volume's edges by a model of these kinds of features."""
    e = graph(test)
    return predict(model, local_features(test, e, kinds, e.select("u", "v", "n", "kind"))).select("u", "v", "p", "n", "kind")


def learn_by_kind(volumes: list[DataFrame], test: DataFrame, kinds: tuple = LOCAL, forest: Forest = Forest()) -> DataFrame:
    """The same with one forest for edges in planes and one for those between them."""
    e = graph(test)
    found, rows = local_features(test, e, kinds).join(e.select("u", "v", "n", "kind"), ["u", "v"]), training_rows(volumes, kinds)
    parts = [predict(train(rows.filter(F.col("f_kind") == k), forest), found.filter(F.col("kind") == k)) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def cross_validated(rows: DataFrame, folds: int = 3, forest: Forest = Forest()) -> DataFrame:
    """(part, mean, dev) of the accuracy over folds dealt by a hash of the edge: over all edges, in planes, between them."""
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("u", "v"), F.lit(folds))))
    scored = [predict(train(rows.filter(F.col("fold") != k).drop("fold"), forest), rows.filter(F.col("fold") == k)) for k in range(folds)]
    hit = reduce(DataFrame.unionByName, scored).withColumn("hit", ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double"))
    part = F.explode(F.array(F.lit("all"), F.when(F.col("kind") == 1, "in_plane").otherwise("between"))).alias("part")
    by_fold = hit.select(part, "fold", "hit").groupBy("part", "fold").agg(F.avg("hit").alias("a"))
    return by_fold.groupBy("part").agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("dev"))


def learn_with_defects(volumes: list[DataFrame], test: DataFrame, bad: tuple, forest: Forest = Forest(), train_bad: tuple = ()) -> DataFrame:
    """(u, v, origin, ignore, n, kind, p) of the test volume's modified edges: one forest for edges, one for skip edges.

    train_bad: the bad slices of each training volume. The second forest learns on their skip edges; where those have no rows of
    both classes, the first one judges skip edges too. Only statistics that both kinds have count, and the range bridged.
    """
    def rows(v, defect):
        e = graph(v)
        marked = defects.marked(e, v, defect) if defect else e.withColumn("hit", F.lit(False))
        kept = marked.filter("not (hit and kind = 0)").select("u", "v", "n", "kind", F.lit("local").alias("origin"), F.col("hit").cast("int").alias("ignore"), F.lit(1).cast("long").alias("skip_range"))
        found = rag.faces(v).select("u", "v", "w")
        if defect:
            skip = defects.skip_edges(v, defect).join(e.select("u", "v"), ["u", "v"], "left_anti")
            kept = kept.unionByName(skip.select("u", "v", "n", F.lit(0).alias("kind"), F.lit("skip").alias("origin"), F.lit(0).alias("ignore"), "skip_range"))
            found = found.unionByName(defects.skip_faces(v, defect).select("u", "v", "w"))
        kept = cut(kept)
        stats = features.edge_statistics(found.join(kept.select("u", "v"), ["u", "v"], "left_semi"), F.col("w"))
        wide = stats.join(features.pair_statistics(kept, features.region_statistics(v)), ["u", "v"]).join(kept.select("u", "v", "skip_range"), ["u", "v"])
        return fine(wide, ("u", "v")).join(kept, ["u", "v"]).join(edge_labels(kept, v), ["u", "v"])

    known = cut(reduce(DataFrame.unionByName, (rows(v, tuple(d)) for v, d in zip_longest(volumes, train_bad, fillvalue=()))))
    here, out = cut(rows(test, bad)), None
    models = {}
    for origin in ("local", "skip"):
        own = known.filter((F.col("origin") == origin) & (F.col("ignore") == 0)).drop("u", "v", "n", "kind", "origin", "ignore", "skip_range")
        enough = origin == "local" or own.select("label").distinct().count() == 2
        models[origin] = train(own, forest) if enough else models["local"]
        part = predict(models[origin], here.filter(F.col("origin") == origin)).select("u", "v", "origin", "ignore", "n", "kind", "p")
        out = part if out is None else out.unionByName(part)
    return out
