"""Distances and watersheds over volumes of any size: lines and chunks are the tasks, never the volume or a slice.

Distances are separable: the squared distance along one axis after the other, each a lower envelope of parabolas along
lines of voxels. A task holds a bundle of whole lines.

The watershed is the minimum spanning forest rooted in the seeds, edges in a total order by the higher and the lower of
both heights, then by place: every voxel gets the seed that its forest leads to. That forest is unique, so chunks may be of
any size. A chunk joins each of its parts along the part's lightest edge as long as that edge stays inside; heights one
voxel beyond the chunk show where it doesn't. What is left of all chunks are parts that wait for a neighbour: borders are
exchanged as edges between parts, and rounds of the same step over that much smaller graph end it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrove.session import settle

from .components import GROUP_EDGES, components
from .images import _lower_envelope, both_sides, voxel_id
from .rag import faces

AXES = ("x", "y", "z")
#: Lines that a task holds at once.
BUNDLE = 64
CHUNK = (64, 64, 64)


def _along(rows: DataFrame, axis: int, pitch: float, bundle: int) -> DataFrame:
    """x, y, z, d2: d2 after one pass along an axis."""
    me, (a, b) = AXES[axis], (AXES[k] for k in range(3) if k != axis)
    infinite = float("inf")

    def run(key, t):
        n, m = (np.asarray(t.column(c)) for c in (me, a))
        f = np.asarray(t.column("d2").fill_null(infinite))
        at, low = n - n.min(), m - m.min()
        grid = np.full((int(at.max()) + 1, int(low.max()) + 1), np.inf)
        grid[at, low] = f
        out = _lower_envelope(grid, pitch)[at, low]
        return pa.table({me: n, a: m, b: t.column(b), "d2": pa.array(out, mask=~np.isfinite(out))}).select([*AXES, "d2"])

    keyed = rows.select(*AXES, "d2", F.floor(F.col(a) / bundle).alias("__bundle"), F.col(b).alias("__line"))
    return keyed.groupBy("__line", "__bundle").applyInArrow(run, "x long, y long, z long, d2 double")


def squared_distances(voxels: DataFrame, on: str, pitch: tuple = (1.0, 1.0, 1.0), axes: tuple = (0, 1, 2), bundle: int = BUNDLE) -> DataFrame:
    """x, y, z, d2: squared distance of every voxel to the nearest one whose column ``on`` is true, over the given axes only
    (others part the volume); null where there is none. A null in ``on`` counts as false."""
    rows = voxels.select(*(F.col(c).cast("long").alias(c) for c in AXES), F.when(F.col(on), F.lit(0.0)).alias("d2"))
    for axis in axes:
        rows = _along(rows, axis, float(pitch[axis]), bundle)
    return rows


def signed_distances(voxels: DataFrame, on: str, pitch: tuple = (1.0, 1.0, 1.0), axes: tuple = (0, 1, 2)) -> DataFrame:
    """x, y, z, outside, inside, distance: squared distances to the nearest voxel that is on and to the nearest that is not,
    and the first's root less what the second's root is over 1; null where the volume has none of them."""
    v = settle(voxels.select(*AXES, F.coalesce(F.col(on), F.lit(False)).alias("on")).withColumn("off", ~F.col("on")))
    out = squared_distances(v, "on", pitch, axes).withColumnRenamed("d2", "outside")
    both = out.join(squared_distances(v, "off", pitch, axes).withColumnRenamed("d2", "inside"), list(AXES))
    return both.withColumn("distance", F.sqrt("outside") - F.greatest(F.coalesce(F.sqrt("inside"), F.lit(0.0)) - 1, F.lit(0.0)))


def _inside_runs(f: np.ndarray, label: np.ndarray, at: np.ndarray, line: np.ndarray, pitch: float) -> np.ndarray:
    """One pass of distances to other labels along lines (sorted by line, at): a run of one label is an envelope of its own
    between two other voxels, so nothing beyond its ends counts. Runs of about equal length are worked on together."""
    new = np.ones(len(f), bool)
    new[1:] = (label[1:] != label[:-1]) | (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(f)))
    out = np.empty(len(f))
    for power in np.unique(np.ceil(np.log2(size))).astype(int):
        some = np.flatnonzero(np.ceil(np.log2(size)).astype(int) == power)
        for lo in range(0, len(some), max(1, (1 << 20) >> power)):
            k = some[lo : lo + max(1, (1 << 20) >> power)]
            grid = np.full((int(size[k].max()) + 2, len(k)), np.inf)
            col = np.repeat(np.arange(len(k)), size[k])
            row = np.arange(len(col)) - np.repeat(np.cumsum(size[k]) - size[k], size[k]) + 1
            own = np.repeat(first[k], size[k]) + row - 1
            grid[row, col] = f[own]
            grid[0], grid[size[k] + 1, np.arange(len(k))] = 0.0, 0.0
            out[own] = _lower_envelope(grid, pitch)[row, col]
    return out


def label_distances(voxels: DataFrame, label: str, pitch: tuple = (1.0, 1.0, 1.0), bundle: int = BUNDLE) -> DataFrame:
    """x, y, z, label, d2: squared distance of every voxel to the nearest one of another label; missing voxels and what is
    beyond the volume are another label. All labels in one pass an axis, a task holds a bundle of lines."""
    rows = voxels.select(*(F.col(c).cast("long").alias(c) for c in AXES), F.col(label).cast("long").alias("label"), F.lit(float("inf")).alias("d2"))
    for axis in range(3):
        me, (a, b) = AXES[axis], [AXES[k] for k in range(3) if k != axis]
        keyed = rows.select(*AXES, "label", "d2", F.floor(F.col(a) / bundle).alias("__bundle"), F.col(b).alias("__line"))
        rows = keyed.groupBy("__line", "__bundle").applyInArrow(_label_pass(me, a, float(pitch[axis])), "x long, y long, z long, label long, d2 double")
    return rows


def _label_pass(me: str, a: str, pitch: float):
    def run(key, t):
        order = np.lexsort((np.asarray(t.column(me)), np.asarray(t.column(a))))
        t = t.take(pa.array(order))
        f, label, at, line = (np.asarray(t.column(c)) for c in ("d2", "label", me, a))
        return pa.table({**{c: t.column(c) for c in (*AXES, "label")}, "d2": _inside_runs(f, label, at, line, pitch)})

    return run


def edge_distances(voxels: DataFrame) -> DataFrame:
    """x, y, z, d2: squared in-plane distance to the nearest voxel beside a label change of its slice."""
    edge = both_sides(faces(voxels).filter("axis < 2")).distinct().withColumn("edge", F.lit(True))
    rows = voxels.select(*AXES).join(edge, list(AXES), "left").select(*AXES, F.coalesce("edge", F.lit(False)).alias("edge"))
    return squared_distances(rows, "edge", axes=(0, 1)).filter("d2 IS NOT NULL").select(*AXES, F.col("d2").cast("long").alias("d2"))


def forest_parts(n: int, u: np.ndarray, v: np.ndarray, rank: np.ndarray, seeded: np.ndarray, frozen: np.ndarray) -> np.ndarray:
    """The part of every point: parts without a seed join along their lightest edge, unless it leads to a frozen point.

    rank: places of the edges in the total order. A part is named by one of its points, a seeded one where it has one.
    """
    part = np.arange(n)
    order = np.argsort(rank)
    u, v = u[order], v[order]
    while len(u):
        cu, cv = part[u], part[v]
        apart = cu != cv
        u, v, cu, cv = u[apart], v[apart], cu[apart], cv[apart]
        if not len(u):
            break
        best = np.full(n, len(u))
        at = np.arange(len(u))
        np.minimum.at(best, cu, at)
        np.minimum.at(best, cv, at)
        asks = np.flatnonzero((best < len(u)) & ~seeded & ~frozen)
        other = np.where(cu[best[asks]] == asks, cv[best[asks]], cu[best[asks]])
        asks, other = asks[~frozen[other]], other[~frozen[other]]
        if not len(asks):
            break
        parent = np.arange(n)
        parent[asks] = other
        mutual = asks[(parent[parent[asks]] == asks) & (asks < parent[asks])]
        parent[mutual] = mutual
        while ((up := parent[parent]) != parent).any():
            parent = up
        part = parent[part]
    return part


def _links(ids: np.ndarray, heights: np.ndarray, steps: tuple) -> tuple[np.ndarray, ...]:
    """Edges of a set of voxels (sorted ids): both ends, axis, and their place in the total order."""
    u, v, axis = [], [], []
    for k, step in steps:
        j = np.searchsorted(ids, ids + step)
        i = np.flatnonzero((j < len(ids)) & (ids[np.minimum(j, len(ids) - 1)] == ids + step))
        u.append(i)
        v.append(j[i])
        axis.append(np.full(len(i), k))
    u, v, axis = np.concatenate(u), np.concatenate(v), np.concatenate(axis)
    high, low = np.maximum(heights[u], heights[v]), np.minimum(heights[u], heights[v])
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((axis, ids[u], low, high))] = np.arange(len(u))
    return u, v, axis, rank, high, low


def _steps(axes: tuple) -> tuple:
    return tuple((k, (1, 1 << 21, 1 << 42)[k]) for k in axes)


def flood(ids: np.ndarray, heights: np.ndarray, seeds: np.ndarray, axes: tuple = (0, 1, 2)) -> np.ndarray:
    """The watershed of a set of voxels in one go: the seed label of every voxel, 0 where no seed leads."""
    order = np.argsort(ids)
    ids, heights, marks = ids[order], heights[order], seeds[order]
    u, v, _, rank, *_ = _links(ids, heights, _steps(axes))
    part = forest_parts(len(ids), u, v, rank, marks > 0, np.zeros(len(ids), bool))
    out = np.empty(len(ids), np.int64)
    out[order] = marks[part]
    return out


WEIGHT = "high double, low double, id long, axis int"


def watershed(voxels: DataFrame, height: str, seed: str, axes: tuple = (0, 1, 2), chunk: tuple = CHUNK, most: int = GROUP_EDGES, rounds: int = 60) -> DataFrame:
    """x, y, z, label of voxels(x, y, z, height, seed): the label of the seed whose forest holds the voxel, 0 where there is none.

    Seeds are labels over 0; coordinates are under 2^21 and not negative. Neighbours are along ``axes`` only: (0, 1) floods every
    slice on its own. Missing voxels are walls. A task holds a chunk; once at most ``most`` edges between parts are left, one
    task ends it. Neither changes the result.
    """
    steps = _steps(axes)
    v = voxels.select(*(F.col(c).cast("long").alias(c) for c in AXES), voxel_id().alias("vid"), F.col(height).cast("double").alias("h"), F.coalesce(F.col(seed), F.lit(0)).cast("long").alias("seed"))
    own = [F.expr(f"{c} div {chunk[k]}") for k, c in enumerate(AXES)]
    homes = [F.struct(*(o.alias(c) for o, c in zip(own, AXES)))]
    # a voxel goes to its own chunk, and, as a height beyond the border, to each chunk that a step away from it begins
    for k in axes:
        for way in (-1, 1):
            there = [F.expr(f"({c} + {way if i == k else 0}) div {chunk[i]}") for i, c in enumerate(AXES)]
            homes.append(F.when(F.expr(f"({AXES[k]} + {way}) >= 0 AND ({AXES[k]} + {way}) div {chunk[k]} <> {AXES[k]} div {chunk[k]}"), F.struct(*(o.alias(c) for o, c in zip(there, AXES)))))
    dealt = v.select("vid", "h", "seed", homes[0].alias("own"), F.explode(F.array_compact(F.array(*homes))).alias("chunk"))
    dealt = dealt.select("chunk", "vid", "h", "seed", (F.col("own") != F.col("chunk")).alias("beyond"))

    def run(key, t):
        ids, h, marks, beyond = (np.asarray(t.column(c)) for c in ("vid", "h", "seed", "beyond"))
        order = np.argsort(ids)
        ids, h, marks, beyond = ids[order], h[order], marks[order], beyond[order].astype(bool)
        u, w, axis, rank, high, low = _links(ids, h, steps)
        mine = ~(beyond[u] & beyond[w])
        u, w, axis, rank, high, low = (x[mine] for x in (u, w, axis, rank, high, low))
        part = forest_parts(len(ids), u, w, rank, (marks > 0) & ~beyond, beyond)
        own_at = np.flatnonzero(~beyond)
        pu, pw = part[u], part[w]
        # between parts the lightest edge only; an edge that leaves belongs to the chunk of its lower end
        keep = (pu != pw) & ~beyond[u]
        inner = np.flatnonzero(keep & ~beyond[w])
        a, b = np.minimum(pu[inner], pw[inner]), np.maximum(pu[inner], pw[inner])
        first = inner[np.lexsort((rank[inner], b, a))]
        a, b = np.minimum(pu[first], pw[first]), np.maximum(pu[first], pw[first])
        light = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(first) else np.zeros(0, bool)
        e = np.concatenate([first[light], np.flatnonzero(keep & beyond[w])])
        n, m = len(own_at), len(e)
        pad = lambda x, before: np.concatenate([np.zeros(before, x.dtype), x, np.zeros(n + m - before - len(x), x.dtype)])
        return pa.table({
            "kind": pad(np.ones(m, np.int32), n), "a": np.concatenate([ids[own_at], ids[part[u[e]]]]), "b": np.concatenate([ids[part[own_at]], ids[part[w[e]]]]),
            "seed": pad(marks[part[own_at]], 0), "high": pad(high[e], n), "low": pad(low[e], n), "id": pad(ids[u[e]], n), "axis": pad(axis[e].astype(np.int32), n), "out": pad(beyond[w[e]], n)})

    made = settle(dealt.groupBy("chunk").applyInArrow(run, f"kind int, a long, b long, seed long, {WEIGHT}, out boolean"))
    parts = made.filter("kind = 0").select(F.col("a").alias("vid"), F.col("b").alias("part"), "seed")
    links = made.filter("kind = 1").select("a", "b", "high", "low", "id", "axis", "out")
    # an edge that leaves its chunk ends at a voxel, whose part its own chunk knows
    ends = parts.select(F.col("vid").alias("b"), "part")
    links = settle(links.join(ends, "b", "left").select("a", F.when(F.col("out"), F.col("part")).otherwise(F.col("b")).alias("b"), "high", "low", "id", "axis"))
    nodes = settle(parts.groupBy("part").agg(F.max("seed").alias("seed")))
    roots = _ended(nodes, links, most, rounds)
    found = parts.join(roots, "part").select("vid", "label")
    at = [F.shiftright(F.col("vid"), by).bitwiseAND((1 << 21) - 1).alias(c) for c, by in zip(AXES, (0, 21, 42))]
    return found.select(*at, "label")


def _ended(nodes: DataFrame, links: DataFrame, most: int, rounds: int) -> DataFrame:
    """(part, label) of parts(part, seed) after all joins along links(a, b, weight)."""
    weight = F.struct("high", "low", "id", "axis")
    names = nodes.select("part", F.col("part").alias("root"))
    state = nodes.withColumnRenamed("part", "root")
    for _ in range(rounds):
        if links.count() <= most:
            break
        both = links.select(F.col("a").alias("root"), F.col("b").alias("to"), weight.alias("w")).unionByName(links.select(F.col("b").alias("root"), F.col("a").alias("to"), weight.alias("w")))
        picks = both.groupBy("root").agg(F.min_by("to", "w").alias("to")).join(state.filter("seed = 0").select("root"), "root", "left_semi")
        joined = settle(components(settle(picks.select(F.col("root").alias("a"), F.col("to").alias("b")))).withColumnsRenamed({"node": "root", "component": "new"}))
        if joined.isEmpty():
            break
        renamed = lambda df, c: df.join(joined.withColumnRenamed("root", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: E731, B023
        names = settle(renamed(names, "root"))
        state = settle(renamed(state, "root").groupBy("root").agg(F.max("seed").alias("seed")))
        links = renamed(renamed(links, "a"), "b").filter("a <> b")
        links = settle(links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(weight).alias("w")).select("a", "b", "w.*"))

    def run(key, t):
        kind, a, b, seed = (np.asarray(t.column(c)) for c in ("kind", "a", "b", "seed"))
        ids = np.sort(a[kind == 0])
        marks = np.zeros(len(ids), np.int64)
        marks[np.searchsorted(ids, a[kind == 0])] = seed[kind == 0]
        e = kind == 1
        u, w = np.searchsorted(ids, a[e]), np.searchsorted(ids, b[e])
        rank = np.empty(len(u), np.int64)
        rank[np.lexsort([np.asarray(t.column(c))[e] for c in ("axis", "id", "low", "high")])] = np.arange(len(u))
        part = forest_parts(len(ids), u, w, rank, marks > 0, np.zeros(len(ids), bool))
        return pa.table({"root": ids, "label": marks[part]})

    rest = links.filter("a <> b")
    touched = rest.select(F.explode(F.array("a", "b")).alias("root")).distinct()
    live = state.join(touched, "root", "left_semi").select(F.lit(0).alias("kind"), F.col("root").alias("a"), F.lit(0).cast("long").alias("b"), "seed", F.lit(0.0).alias("high"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("axis"))
    edges = rest.select(F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("seed"), "high", "low", "id", "axis")
    ended = live.unionByName(edges).groupBy(F.lit(0).alias("all")).applyInArrow(run, "root long, label long")
    labels = state.join(ended, "root", "left").select("root", F.coalesce("label", "seed").alias("label"))
    return names.join(labels, "root").select("part", "label")


def two_pass_watershed(voxels: DataFrame, height: str, seed: str, least: int, **kw) -> DataFrame:
    """The watershed, labels of under ``least`` voxels dropped, and the watershed again from what is left (if anything is)."""
    first = settle(watershed(voxels, height, seed, **kw))
    kept = settle(first.groupBy("label").count().filter((F.col("count") >= least) & (F.col("label") > 0)).select("label", F.lit(True).alias("kept")))
    if kept.isEmpty():
        return first
    again = voxels.select(*AXES, height).join(first.join(kept, "label", "left"), list(AXES)).withColumn("__seed", F.when(F.col("kept"), F.col("label")).otherwise(0))
    return watershed(again, height, "__seed", **kw)
