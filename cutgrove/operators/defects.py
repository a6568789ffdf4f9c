"""Bad slices: edges that leave, edges to ignore, and skip edges over runs of bad slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutgrove.functions import energies
from cutgrove.session import cut


def skip_edges(voxels: DataFrame, bad: tuple) -> DataFrame:
    """(u, v, skip_range, n): nodes over each other on both sides of a run of bad slices."""
    w = Window.partitionBy("x", "y").orderBy("z")
    good = voxels.filter(~F.col("z").isin(*bad)).select("x", "y", "z", "seg", F.lead("seg").over(w).alias("up"), (F.lead("z").over(w) - F.col("z")).alias("skip_range"))
    return good.filter("skip_range > 1").groupBy(F.least("seg", "up").alias("u"), F.greatest("seg", "up").alias("v"), "skip_range").agg(F.count("*").alias("n"))


def defect_nodes(voxels: DataFrame, bad: tuple) -> DataFrame:
    return voxels.filter(F.col("z").isin(*bad)).select("seg").distinct()


def touching(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Edges with (left_semi) or without (left_anti) an end among nodes."""
    if how == "left_anti":
        return edges.join(nodes.withColumnRenamed("seg", "u"), "u", "left_anti").join(nodes.withColumnRenamed("seg", "v"), "v", "left_anti")
    left = edges.join(nodes.withColumnRenamed("seg", "u"), "u", "left_semi").select(*edges.columns)
    return left.unionByName(edges.join(nodes.withColumnRenamed("seg", "v"), "v", "left_semi").select(*edges.columns)).distinct()


def modified_edges(edges: DataFrame, voxels: DataFrame, bad: tuple) -> DataFrame:
    """edges_mod(u, v, origin, ignore, skip_range): edges between planes at bad nodes go, those in a plane are ignored."""
    nodes = defect_nodes(voxels, bad).withColumn("bad", F.lit(True))
    both = edges
    for side in "uv":
        both = both.join(nodes.select(F.col("seg").alias(side), F.col("bad").alias(f"bad_{side}")), side, "left")
    hit = F.coalesce("bad_u", F.lit(False)) | F.coalesce("bad_v", F.lit(False))
    local = both.filter(~(hit & (F.col("kind") == 0))).select("u", "v", F.lit("local").alias("origin"), hit.cast("int").alias("ignore"), F.lit(1).cast("long").alias("skip_range"))
    known = edges.select("u", "v")
    skip = skip_edges(voxels, bad).join(known, ["u", "v"], "left_anti").select("u", "v", F.lit("skip").alias("origin"), F.lit(0).alias("ignore"), "skip_range")
    return local.unionByName(skip)


def replacement_slices(spark, bad: tuple, depth: int) -> DataFrame:
    """(z, source): each bad slice takes the nearest good one, the lower of two at equal distance."""
    good = [z for z in range(depth) if z not in set(bad)]
    rows = [(z, min(good, key=lambda g: (abs(g - z), g))) for z in sorted(set(bad)) if z < depth and good]
    return spark.createDataFrame(rows, "z long, source long")


def marked(edges: DataFrame, voxels: DataFrame, bad: tuple) -> DataFrame:
    """Edges with hit: whether an end lies in a bad slice."""
    nodes = defect_nodes(voxels, bad).withColumn("bad", F.lit(True))
    for side in "uv":
        edges = edges.join(nodes.select(F.col("seg").alias(side), F.col("bad").alias(f"bad_{side}")), side, "left")
    return edges.withColumn("hit", F.coalesce("bad_u", F.lit(False)) | F.coalesce("bad_v", F.lit(False))).drop("bad_u", "bad_v")


def skip_faces(voxels: DataFrame, bad: tuple) -> DataFrame:
    """(u, v, skip_range, w): voxels over each other on both sides of a run of bad slices, w the sum of their pm."""
    w = Window.partitionBy("x", "y").orderBy("z")
    good = voxels.filter(~F.col("z").isin(*bad)).select("seg", F.lead("seg").over(w).alias("up"), (F.col("pm") + F.lead("pm").over(w)).alias("w"), (F.lead("z").over(w) - F.col("z")).alias("skip_range"))
    return good.filter("skip_range > 1").select(F.least("seg", "up").alias("u"), F.greatest("seg", "up").alias("v"), "skip_range", "w")


def modified_energies(edges: DataFrame, skip: DataFrame, over: DataFrame, beta: float, weight: float, top: float = 200_000.0) -> DataFrame:
    """(u, v, e): marked edges that survive and skip edges; those with hit get twice the least energy."""
    sums = over.groupBy("u", "v").agg(F.sum("w").alias("s"))
    skip = skip.join(sums, ["u", "v"]).select("u", "v", "n", F.lit(0).alias("kind"), "s", F.lit(False).alias("hit"))
    both = cut(edges.filter("not (hit and kind = 0)").select("u", "v", "n", "kind", "s", "hit").unionByName(skip))
    e = cut(energies.weigh(both.withColumn("e", energies.energy(F.col("s") / (F.col("n") * top), beta)), "z", weight))
    least = e.agg(F.min("e")).first()[0] or 0.0
    return e.select("u", "v", F.when(F.col("hit"), F.lit(2 * least)).otherwise(F.col("e")).alias("e"))


def run_sources(bad: tuple, depth: int) -> list[tuple[int, int]]:
    """(z, source) for runs of up to four bad slices.

    The lower half of a run, of three the lower two, takes the slice below the run, the rest the one above; where the volume
    ends on that side the other side serves. Longer runs are an error.
    """
    runs: list[list[int]] = []
    for z in sorted(set(bad)):
        if runs and runs[-1][-1] == z - 1:
            runs[-1].append(z)
        else:
            runs.append([z])
    out = []
    for run in runs:
        n, below, above = len(run), run[0] - 1, run[-1] + 1
        if n > 4:
            raise ValueError(f"{n} bad slices in a row: replacement goes up to 4")
        lower = {1: 1, 2: 1, 3: 2, 4: 2}[n]
        for i, z in enumerate(run):
            first, second = (below, above) if i < lower else (above, below)
            if not 0 <= first < depth:
                first = second
            if not 0 <= first < depth:
                raise ValueError("no good slice is left")
            out.append((z, first))
    return out


def insert_slices(rows: DataFrame, missing: dict[int, int]) -> DataFrame:
    """Rows with new slices: before old slice z comes a copy of slice missing[z]; the others move up."""
    order = sorted(missing)
    moved = F.col("z") + sum((F.when(F.col("z") >= z, 1).otherwise(0) for z in order), F.lit(0))
    out = rows.withColumn("z", moved.cast("long"))
    for k, z in enumerate(order):
        out = out.unionByName(rows.filter(F.col("z") == missing[z]).withColumn("z", F.lit(z + k).cast("long")))
    return out


def learning_masks(pairs: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """Pairs with a 0/1 column for each named table of nodes(seg): whether an end is among them."""
    for name, some in nodes.items():
        some = some.select("seg").distinct().withColumn("in", F.lit(1))
        for side in "uv":
            pairs = pairs.join(some.select(F.col("seg").alias(side), F.col("in").alias(f"in_{side}")), side, "left")
        pairs = pairs.withColumn(name, F.coalesce("in_u", "in_v", F.lit(0))).drop("in_u", "in_v")
    return pairs


def ignore_mask(pairs: DataFrame, node_gt: DataFrame, split: tuple, merge: tuple) -> DataFrame:
    """(u, v, masked): ((gt_u in split or gt_v in split) and gt_u <> gt_v) or both in merge."""
    for side in "uv":
        pairs = pairs.join(node_gt.select(F.col("seg").alias(side), F.col("gt").alias(f"gt_{side}")), side)
    a, b = F.col("gt_u"), F.col("gt_v")
    masked = ((a.isin(*split) | b.isin(*split)) & (a != b)) | (a.isin(*merge) & b.isin(*merge))
    return pairs.select("u", "v", masked.cast("int").alias("masked"))
