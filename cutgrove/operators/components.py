"""Connected components by local contraction and large-star rounds.

``contract`` replaces a batch of edges by stars around the smallest node of each of its components; it runs inside map
tasks on at most GROUP_EDGES edges at once, so memory is bounded whatever the partition. If what the first contraction
leaves is no more than that, one more task contracts it all. Otherwise rounds follow, and a round is

1. large star: every node hands its smallest neighbour to its larger neighbours. The minima are aggregated on the map side
   and written before the join, so the join's two sides are plain shuffles and AQE can split the rows of a hub;
2. contraction before and after a shuffle on the larger node, which no longer meets a hub: a hub is the smaller node.

Lineage is cut each round in the shared checkpoint folder. Nodes are integers, or anything comparable (then the second
step is the DataFrame form of the small star); self-loops keep a node that has no other edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutgrove.session import cut

#: Edges that one contraction holds: 16 MB. It changes the plan, not the result.
GROUP_EDGES = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that isn't the smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, low[u], m)
        np.minimum.at(new, low[v], m)
        while ((up := new[new]) != new).any():
            new = up
        if (new == low).all():
            break
        low = new
    other = low != np.arange(len(nodes))
    return nodes[other], nodes[low[other]]


def _contract_batches(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars():
        u, v = contract(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        a, b = (np.asarray(c, np.int64) for c in batch.columns)
        for lo in range(0, len(a), GROUP_EDGES):
            if held and sum(len(x) for x, _ in held) + len(a[lo : lo + GROUP_EDGES]) > GROUP_EDGES:
                yield stars()
                held.clear()
            held.append((a[lo : lo + GROUP_EDGES], b[lo : lo + GROUP_EDGES]))
    if held:
        yield stars()


def _small_star(large: DataFrame) -> DataFrame:
    large = cut(large.distinct())
    low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
    return large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Null ends are left out."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).na.drop()
    kinds = [f.dataType for f in pairs.schema]
    whole = all(isinstance(k, T.IntegralType) for k in kinds)
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    star = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if whole:
        local = lambda x: x.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract_batches, "u long, v long")
        small = lambda x: local(local(x).repartition("u"))
        star = cut(local(star))
        few = star.count() <= GROUP_EDGES
        star = cut(local(star.coalesce(1))) if few else cut(local(star.repartition("u")))
    else:
        few, small = False, _small_star
        star = cut(small(star))
    before = None
    for _ in range(0 if few else max_rounds):
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        star = cut(small(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
    else:
        if not few:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = star.withColumnsRenamed({"u": "node", "v": "low"}) if few else star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    out = nodes.join(labels, "node", "left").select("node", F.coalesce("low", "node").alias("component"))
    return out.select(*(F.col(c).cast(kinds[0]) for c in out.columns)) if whole and kinds[0] == kinds[1] else out
