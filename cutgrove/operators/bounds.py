"""Lower bounds of multicut problems: cutting planes over cycles, in the dual.

An edge may only be cut if the rest of every cycle through it is cut somewhere. Each violated cycle with one repulsive edge
gets a multiplier that moves cost from the edges of its path to that edge; the sum of the negative reduced costs is a lower
bound of every partition's cost, whatever the multipliers are. They rise one at a time, which never lowers the bound, and
cycles are separated anew by shortest paths over the edges that still attract, so they have no chords there.

A bound of parts of a problem is a bound of the whole: reduced costs of one round are the costs of the next, over other
parts. So a large component is worked on in ranges of nodes, a task each, and ranges shift between rounds.
"""

from __future__ import annotations

import random
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrove.session import settle

from . import multicut
from .relabel import dense_ids

EPS = 1e-9


def _attractive(near: dict, r: list) -> dict[int, int]:
    """A node of every node's part of the graph of attractive edges."""
    part: dict[int, int] = {}
    for start in near:
        if start not in part:
            part[start], todo = start, [start]
            while todo:
                for b, e in near[todo.pop()]:
                    if r[e] > EPS and b not in part:
                        part[b] = start
                        todo.append(b)
    return part


def _path(near: dict, r: list, start: int, goal: int, most: int, part: dict[int, int]) -> list[int] | None:
    """Edges of a shortest path over attractive edges, of at most ``most`` edges.

    part: names of parts that such edges may join; where a search has seen all of its part, that gets a name of its own.
    """
    if part[start] != part[goal]:
        return None
    by, queue = {start: None}, deque([(start, 0)])
    while queue:
        a, d = queue.popleft()
        if d == most:
            return None
        for b, e in near[a]:
            if r[e] > EPS and b not in by:
                by[b] = (a, e)
                if b == goal:
                    out = []
                    while by[b] is not None:
                        b, e = by[b]
                        out.append(e)
                    return out
                queue.append((b, d + 1))
    part.update(dict.fromkeys(by, ~start))
    return None


def reduced_costs(edges: list[tuple], passes: int = 60, seed: int = 5) -> list[float]:
    """Reduced costs, in the order of the edges (u, v, cost), whose negative part sums to the bound."""
    r = [float(c) for _, _, c in edges]
    near: dict[int, list] = {}
    for e, (u, v, _) in enumerate(edges):
        near.setdefault(u, []).append((v, e))
        near.setdefault(v, []).append((u, e))
    weight: dict[tuple, float] = {}
    rng = random.Random(seed)
    bound = lambda: sum(x for x in r if x < 0)

    def raise_cycle(e: int, path: tuple, by: float) -> None:
        r[e] += by
        for f in path:
            r[f] -= by
        weight[e, path] = weight.get((e, path), 0.0) + by

    def separate(most: int) -> None:
        part = _attractive(near, r)  # edges only lose attraction in here: parts fall to pieces, but never grow
        for e in sorted((i for i, x in enumerate(r) if x < -EPS), key=lambda i: (r[i], i)):
            u, v, _ = edges[e]
            while r[e] < -EPS and (path := _path(near, r, u, v, most, part)):
                raise_cycle(e, tuple(sorted(path)), min(-r[e], *(r[f] for f in path)))

    for most in (2, 3, 4, 8, len(edges)):  # short cycles first: they take from fewer edges
        separate(most)
    best, kept, stale = bound(), list(r), 0
    for _ in range(passes):
        for e, path in rng.sample(sorted(weight), len(weight)):
            own = weight[e, path]
            # without this cycle: the bound is flat in its multiplier between two values, and any of them will do
            need, least = -(r[e] - own), sorted(r[f] + own for f in path)
            low, high = (need, least[0]) if need <= least[0] else (least[0], min(need, least[1]) if len(least) > 1 else need)
            low, high = max(0.0, low), max(0.0, high)
            raise_cycle(e, path, low + rng.random() * (high - low) - own)
        separate(len(edges))
        if (now := bound()) > best + 1e-7:
            best, kept, stale = now, list(r), 0
        elif (stale := stale + 1) >= 10:
            break
    return kept


def lower_bound(edges: list[tuple], **kw) -> float:
    return float(sum(x for x in reduced_costs(edges, **kw) if x < 0))


def _round(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(u, v, cost): costs after one round inside parts(node, part); edges between parts keep theirs."""
    ends = edges
    for side in "uv":
        ends = ends.join(parts.select(F.col("node").alias(side), F.col("part").alias(f"p_{side}")), side)
    ends = settle(ends)

    def run(key, t):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", "cost"))))
        return pa.table({"u": pa.array([x[0] for x in rows], pa.int64()), "v": pa.array([x[1] for x in rows], pa.int64()), "cost": pa.array(reduced_costs(rows), pa.float64())})

    inside = ends.filter("p_u = p_v").select(F.col("p_u").alias("part"), "u", "v", "cost").groupBy("part").applyInArrow(run, "u long, v long, cost double")
    return settle(inside.unionByName(ends.filter("p_u <> p_v").select("u", "v", "cost")))


def component_bounds(edges: DataFrame, solver: str = "kl", most: int = 20_000, rounds: int = 2) -> DataFrame:
    """(component, edges, lower, upper) of every attractive component of edges(u, v, cost) that has an edge inside.

    upper: the cost of ``solver``'s cut. A component of at most ``most`` edges is one task; a larger one is worked on in
    ranges of its nodes of about that many edges, shifted by half a range each round, and its lower bound is what those see.
    Edges between components are cut in every optimum and are not counted.
    """
    e = settle(edges.select("u", "v", F.col("cost").cast("double").alias("cost")))
    comp = settle(multicut.attractive_components(e))
    labels = multicut.solve(e, solver)
    ends = e.join(comp.select(F.col("node").alias("u"), "component"), "u").join(comp.select(F.col("node").alias("v"), F.col("component").alias("c2")), "v").filter("component = c2").drop("c2")
    ends = settle(ends.select("component", "u", "v", "cost"))
    upper = multicut.cut_edges(ends, labels).groupBy("component").agg(F.count("*").alias("edges"), F.sum(F.when(F.col("cut") == 1, F.col("cost")).otherwise(0.0)).alias("upper"))
    sizes = settle(ends.groupBy("component").agg(F.count("*").alias("n")))
    ids = dense_ids(comp.withColumnRenamed("node", "seg"), "seg").withColumnsRenamed({"seg": "node", "new_label": "i"})
    placed = settle(comp.join(sizes, "component").join(ids, "node"))
    nodes_in = placed.groupBy("component").agg(F.count("*").alias("nodes"))
    placed = placed.join(nodes_in, "component")
    reduced = ends.select("u", "v", "cost")
    all_fit = sizes.filter(F.col("n") > most).isEmpty()
    for k in range(1 if all_fit else rounds):
        width = F.greatest(F.lit(1.0), F.floor(F.col("nodes") * most / F.col("n")))
        part = F.when(F.col("n") <= most, F.lit(-1.0)).otherwise(F.floor((F.col("i") + k * width / 2) / width))
        reduced = _round(reduced, placed.select("node", F.struct("component", part.alias("range")).alias("part")))
    lower = reduced.join(comp.select(F.col("node").alias("u"), "component"), "u").groupBy("component").agg(F.sum(F.least("cost", F.lit(0.0))).alias("lower"))
    return upper.join(lower, "component").select("component", "edges", "lower", "upper")


def slice_bounds(edges: DataFrame, node_z: DataFrame, solver: str = "exact") -> DataFrame:
    """(z, lower, upper) of every slice's own graph."""
    from .rag import ends

    rows = ends(edges, node_z, ("z",)).filter("z_u = z_v")

    def run(key, t):
        e = sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", "cost"))))
        value = multicut.cut_energy(e, multicut.SOLVERS[solver](e, []))
        return pa.table({"z": pa.array([key[0].as_py()], pa.int64()), "lower": [lower_bound(e)], "upper": [float(value)]})

    return rows.select(F.col("z_u").alias("z"), "u", "v", "cost").groupBy("z").applyInArrow(run, "z long, lower double, upper double")
