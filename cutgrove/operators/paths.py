"""Cheapest paths through voxels of masked volumes, one object over many tasks.

Distances settle bucket by bucket: frontier rows are offers (a voxel, the distance of the neighbour before it). A round
takes the offers of the least bucket of width ``delta``, and each chunk that has some runs a heap over its own voxels from
them; what gets nearer beside another chunk becomes an offer to that chunk. Rounds end when no offer is left that improves
a distance. A task holds a chunk of an object; the volume of an object does not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrove.session import settle

from .images import voxel_id

AXES = ("x", "y", "z")
CHUNK = (64, 64, 64)
_STEPS = (1, 1 << 21, 1 << 42)
_MASK = (1 << 21) - 1


def _settled(costs: dict[int, float], known: dict[int, float], offers: list[tuple]) -> tuple[dict, list]:
    """Distances that improve, as voxel -> (distance, voxel before), and offers to voxels outside as (voxel, distance, voxel before).

    offers: (voxel, distance before it, voxel before it); the cost of the entered voxel is added. Equal distances keep the
    first, in the order of (distance, voxel before).
    """
    best, out = {}, {}  # voxels leave the heap in order of distance, so each settles once
    heap = sorted((d + costs[v], u, v) for v, d, u in offers if v in costs)
    while heap:
        d, u, v = heapq.heappop(heap)
        if d >= best.get(v, (known.get(v, np.inf),))[0]:
            continue
        best[v] = (d, u)
        for k, step in enumerate(_STEPS):
            for w in (v - step, v + step):
                if w in costs:
                    if d + costs[w] < best.get(w, (known.get(w, np.inf),))[0]:
                        heapq.heappush(heap, (d + costs[w], v, w))
                elif w >= 0 and not (w < v and v >> (21 * k) & _MASK == 0):
                    out[w, v] = d
    return best, [(w, d, v) for (w, v), d in out.items()]


def distances(voxels: DataFrame, starts: DataFrame, chunk: tuple = CHUNK, delta: float | None = None, rounds: int = 100_000) -> DataFrame:
    """(obj, vid, d, by): least cost from the object's start to each voxel that it reaches, and the voxel before it.

    voxels(x, y, z, obj, cost): every voxel in one object; costs of entered voxels add up and are not negative. starts(x, y, z, obj).
    Neighbours are the six beside a voxel within its object. ``delta``: width of a bucket, by default without end.
    """
    home = lambda at: F.struct(*(F.floor(a / chunk[k]).alias(c) for k, (c, a) in enumerate(zip(AXES, at))))
    place = lambda vid: [F.shiftright(F.col(vid), 21 * k).bitwiseAND(_MASK) for k in range(3)]
    v = settle(voxels.select("obj", voxel_id().alias("vid"), F.col("cost").cast("double").alias("cost"), home([F.col(c) for c in AXES]).alias("chunk")))
    first = starts.select("obj", voxel_id().alias("vid"))
    best = settle(v.join(first, ["obj", "vid"], "left_semi").select("obj", "vid", F.lit(0.0).alias("d"), F.lit(-1).cast("long").alias("by")))
    around = F.explode(F.array(*(F.col("vid") + s * w for s in _STEPS for w in (-1, 1)))).alias("to")
    offers = settle(best.select("obj", around, F.col("d").alias("before"), F.col("vid").alias("from")).filter("to >= 0").withColumnRenamed("to", "vid"))

    def run(key, t):
        cols = [t.column(c).to_pylist() for c in ("kind", "vid", "value", "d", "from")]
        costs, known, asked = {}, {}, []
        for kind, vid, value, d, u in zip(*cols):
            if kind:
                asked.append((vid, value, u))
            else:
                costs[vid] = value
                if d is not None:
                    known[vid] = d
        near, out = _settled(costs, known, asked)
        rows = [(0, vid, d, u) for vid, (d, u) in near.items()] + [(1, *o) for o in out]
        return pa.table({"obj": pa.array([key[0].as_py()] * len(rows), pa.int64()), **{n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("kind", pa.int32()), ("vid", pa.int64()), ("d", pa.float64()), ("by", pa.int64())))}})

    for _ in range(rounds):
        low = offers.agg(F.min("before")).first()[0]
        if low is None:
            break
        limit = float("inf") if delta is None else (low // delta + 1) * delta
        now = offers.filter(F.col("before") < limit)
        asks = now.select("obj", home(place("vid")).alias("chunk"), F.lit(1).alias("kind"), "vid", F.col("before").alias("value"), F.lit(None).cast("double").alias("d"), "from")
        live = asks.select("obj", "chunk").distinct()
        held = v.join(live, ["obj", "chunk"], "left_semi").join(best.select("obj", "vid", "d"), ["obj", "vid"], "left")
        held = held.select("obj", "chunk", F.lit(0).alias("kind"), "vid", F.col("cost").alias("value"), "d", F.lit(None).cast("long").alias("from"))
        got = settle(held.unionByName(asks).groupBy("obj", "chunk").applyInArrow(run, "obj long, kind int, vid long, d double, by long"))
        found = got.filter("kind = 0").select("obj", "vid", "d", "by")
        best = settle(best.unionByName(found).groupBy("obj", "vid").agg(F.min(F.struct("d", "by")).alias("m")).select("obj", "vid", "m.d", "m.by"))
        new = got.filter("kind = 1").select("obj", "vid", F.col("d").alias("before"), F.col("by").alias("from"))
        waiting = offers.filter(F.col("before") >= limit).unionByName(new)
        # an offer to a voxel that is no farther already can't improve it, as costs aren't negative
        offers = settle(waiting.join(best.select("obj", "vid", "d"), ["obj", "vid"], "left").filter("d IS NULL OR before < d").drop("d").join(v.select("obj", "vid"), ["obj", "vid"], "left_semi"))
    else:
        raise RuntimeError(f"distances still change after {rounds} rounds")
    return best


def traced(best: DataFrame, goals: DataFrame) -> DataFrame:
    """(obj, seq, x, y, z) of the paths from the starts to goals(x, y, z, obj): voxels are found by pointer doubling, in as
    many rounds as the logarithm of the longest path. Goals that were not reached have no rows."""
    jump = best.select("obj", "vid", F.col("by").alias("to"))
    ends = best.select("obj", "vid").join(goals.select("obj", voxel_id().alias("vid")), ["obj", "vid"], "left_semi")
    path, step = settle(ends.withColumn("back", F.lit(0).cast("long"))), 1
    while not jump.isEmpty():
        hop = path.join(jump.filter("to >= 0"), ["obj", "vid"]).select("obj", F.col("to").alias("vid"), (F.col("back") + step).alias("back"))
        more = settle(hop)
        if more.isEmpty():
            break
        path = settle(path.unionByName(more))
        ahead = jump.filter("to >= 0").select("obj", "vid", F.col("to").alias("mid"))
        jump = settle(ahead.join(jump.select("obj", F.col("vid").alias("mid"), "to"), ["obj", "mid"]).select("obj", "vid", "to"))
        step *= 2
    last = path.groupBy("obj").agg(F.max("back").alias("last"))
    at = [F.shiftright(F.col("vid"), 21 * k).bitwiseAND(_MASK).alias(c) for k, c in enumerate(AXES)]
    return path.join(last, "obj").select("obj", (F.col("last") - F.col("back")).alias("seq"), *at)
