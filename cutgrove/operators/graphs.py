"""Graph operators as bounded join loops; kernels per component where the order of steps matters."""

from __future__ import annotations

import heapq
import itertools
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cutgrove.session import cut, settle

from .components import components
from .relabel import dense_ids, running_offsets


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    return edges.select("u", "v", *cols).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *cols))


def k_hop(edges: DataFrame, upper: int, lower: int = 1) -> DataFrame:
    """(u, v, hops) with u < v and lower < hops <= upper: shortest hop counts, one join a hop."""
    step = cut(both_ways(edges).distinct())
    reached = frontier = step.withColumn("hops", F.lit(1))
    for h in range(2, upper + 1):
        grown = frontier.select("u", F.col("v").alias("m")).join(step.withColumnRenamed("u", "m"), "m").filter("u <> v").select("u", "v").distinct()
        frontier = cut(grown.join(reached, ["u", "v"], "left_anti").withColumn("hops", F.lit(h)))
        reached = reached.unionByName(frontier)
    return reached.filter((F.col("hops") > lower) & (F.col("u") < F.col("v")))


#: Edges that one search holds; beyond that searches run as joins. It changes the plan, not the result.
SEARCH_EDGES = 1 << 20
#: Directed edges at the nodes of a range that one task searches inside.
PART_STEPS = 1 << 16


def _search(rows: list[tuple], source: int, hops: int | None = None) -> tuple[dict, dict]:
    """Least costs from the source and the node before each on a cheapest path (ties: the smaller node)."""
    near: dict[int, list] = {}
    for u, v, c in rows:
        near.setdefault(u, []).append((v, c))
    if hops is not None:  # costs over paths of at most so many edges: by rounds
        best, by, frontier = {source: 0}, {}, {source: 0}
        for _ in range(hops):
            new: dict[int, float] = {}
            for a, d in frontier.items():
                for b, c in near.get(a, ()):
                    if d + c < min(best.get(b, d + c + 1), new.get(b, d + c + 1)):
                        new[b] = d + c
            best |= new
            frontier = new
        return best, by
    best, by, heap = {source: 0}, {}, [(0, source)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a]:
            continue
        for b, c in near.get(a, ()):
            n = d + c
            if b not in best or n < best[b]:
                best[b], by[b] = n, a
                heapq.heappush(heap, (n, b))
            elif n == best[b] and b in by and a < by[b]:
                by[b] = a
    return best, by


def _in_one_task(step: DataFrame, kernel, schema: str, kinds: list) -> DataFrame:
    """A kernel over all (u, v, c) rows of a step table whose size was checked."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        out = kernel(sorted(rows))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return step.select("u", "v", "c").coalesce(1).mapInArrow(run, schema)


def _spread(near: dict, starts: dict) -> dict:
    """Least costs from nodes with given costs."""
    best = dict(starts)
    heap = [(d, a) for a, d in starts.items()]
    heapq.heapify(heap)
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a]:
            continue
        for b, c in near.get(a, ()):
            n = d + c
            if b not in best or n < best[b]:
                best[b] = n
                heapq.heappush(heap, (n, b))
    return best


def _between_borders(step: DataFrame, source: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps(u, v, c) with the same costs between fewer nodes; the steps (part, u, v, c) left out; their borders (part, node).

    Nodes are dealt into ranges by the number of their steps. A node with a step to another range is a border, the source
    too. Where a range has few borders, the costs between them inside the range stand for its own steps; the others keep
    theirs.
    """
    kind = step.schema["c"].dataType
    degree = step.groupBy("u").agg(F.count("*").alias("n"))
    part = settle(running_offsets(degree, "u", "n").select(F.col("u").alias("node"), F.floor(F.col("off") / PART_STEPS).alias("part")))
    both = step.join(part.select(F.col("node").alias("u"), F.col("part").alias("part")), "u")
    both = settle(both.join(part.select(F.col("node").alias("v"), F.col("part").alias("other")), "v"))
    border = settle(both.filter((F.col("part") != F.col("other")) | (F.col("u") == source)).select("part", F.col("u").alias("node")).distinct())
    own = both.filter("part = other").select("part", "u", "v", "c")
    few = border.groupBy("part").agg(F.count("*").alias("k"))
    few = own.groupBy("part").agg(F.count("*").alias("m")).join(few, "part", "left").filter("k is null or k * (k - 1) * 2 <= m").select("part")
    inside = settle(own.join(few, "part", "left_semi"))
    asked = inside.unionByName(border.join(few, "part", "left_semi").select("part", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast(kind).alias("c")))

    def run(key, t):
        near, rim = _steps_and_marks(t)
        out = [(a, b, d) for a in sorted(rim) for b, d in _spread(near, {a: 0}).items() if b in rim and b != a]
        return pa.table({"u": pa.array([r[0] for r in out], pa.int64()), "v": pa.array([r[1] for r in out], pa.int64()), "c": pa.array([r[2] for r in out], to_arrow_type(kind))})

    short = asked.groupBy("part").applyInArrow(run, f"u long, v long, c {kind.simpleString()}")
    kept = both.filter("part <> other").select("u", "v", "c").unionByName(own.join(few, "part", "left_anti").select("u", "v", "c"))
    return settle(kept.unionByName(short)), inside, border.join(few, "part", "left_semi")


def _steps_and_marks(t: pa.Table) -> tuple[dict, dict]:
    """Neighbours with their costs, and the values of rows without a second node."""
    near: dict[int, list] = {}
    marks: dict = {}
    for u, v, c in zip(*(t.column(c).to_pylist() for c in ("u", "v", "c"))):
        if v is None:
            marks[u] = c
        else:
            near.setdefault(u, []).append((v, c))
    return near, marks


def _into_ranges(best: DataFrame, inside: DataFrame, border: DataFrame) -> DataFrame:
    """(node, dist) of all nodes of ranges that were left out, from the distances of their borders."""
    kind = inside.schema["c"].dataType
    starts = border.join(best, "node").select("part", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.col("dist").alias("c"))

    def run(key, t):
        near, known = _steps_and_marks(t)
        out = [(a, d) for a, d in _spread(near, known).items() if a not in known]
        return pa.table({"node": pa.array([r[0] for r in out], pa.int64()), "dist": pa.array([r[1] for r in out], to_arrow_type(kind))})

    return settle(best.unionByName(inside.unionByName(starts).groupBy("part").applyInArrow(run, f"node long, dist {kind.simpleString()}")))


def distances(edges: DataFrame, source: int, hops: int | None = None, cost: str | None = None, limit: int = 100_000) -> DataFrame:
    """(node, dist) from one source: hop counts, or path costs of not negative edges, over paths of at most ``hops`` edges if given.

    Up to SEARCH_EDGES edges one task searches with a heap. Beyond that whole-number costs are searched inside ranges of
    nodes, each a task, then between their borders, level by level while that halves the steps, and back down. What is
    still larger (ids say nothing about neighbours, so paths have few hops) runs until nothing improves, one round of joins
    a hop; raises where that takes more than ``limit`` rounds.
    """
    step = cut(both_ways(edges.withColumn("c", F.col(cost) if cost else F.lit(1).cast("long")), "c").groupBy("u", "v").agg(F.min("c").alias("c")))
    kind = step.schema["c"].dataType
    size, left_out = step.count(), []
    while size > max(SEARCH_EDGES, PART_STEPS) and hops is None and isinstance(kind, T.IntegralType):  # sums of doubles depend on their order
        smaller, inside, border = _between_borders(step, source)
        if (fewer := smaller.count()) > size // 2:
            break
        step, size = smaller, fewer
        left_out.append((inside, border))
    best = _searched(edges, step, source, hops, limit, kind, size <= SEARCH_EDGES)
    for inside, border in reversed(left_out):
        best = _into_ranges(best, inside, border)
    return best


def _searched(edges: DataFrame, step: DataFrame, source: int, hops: int | None, limit: int, kind: T.DataType, few: bool) -> DataFrame:
    """(node, dist) over steps: in one task, or one round of joins a hop."""
    if few:
        return _in_one_task(step, lambda rows: list(_search(rows, source, hops)[0].items()), f"node long, dist {kind.simpleString()}", [pa.int64(), to_arrow_type(kind)])
    best = frontier = edges.sparkSession.createDataFrame([(source,)], "node long").withColumn("dist", F.lit(0).cast(kind))
    for done in itertools.count():
        if done == hops:
            break
        if done == limit:
            raise RuntimeError(f"distances still improve after {limit} rounds")
        offered = frontier.join(step, frontier.node == step.u).groupBy(F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("c")).alias("new"))
        joined = cut(best.join(offered, "node", "full"))
        frontier = joined.filter("new is not null and (dist is null or new < dist)").select("node", F.col("new").alias("dist"))
        if frontier.isEmpty():
            break
        best = joined.select("node", F.least("dist", "new").alias("dist"))
    return best.select("node", "dist")


def shortest_path(edges: DataFrame, source: int, target: int, cost: str | None = None) -> DataFrame:
    """(seq, a, b, cost): the edges of a cheapest path in order, by hops where no cost is named; none where there is no path.

    Distances come from ``distances``; the path is walked back over edges that lie on some cheapest path, the smaller node
    first, one look-up a step on the driver, which holds the path alone.
    """
    dist = cut(distances(edges, source, cost=cost))
    step = cut(both_ways(edges.withColumn("c", F.col(cost) if cost else F.lit(1).cast("long")), "c").groupBy("u", "v").agg(F.min("c").alias("c")))
    tight = step.join(dist.select(F.col("node").alias("u"), F.col("dist").alias("du")), "u").join(dist.select(F.col("node").alias("v"), F.col("dist").alias("dv")), "v").filter(F.col("du") + F.col("c") == F.col("dv"))
    back = cut(tight.groupBy("v").agg(F.min(F.struct("u", "c")).alias("by")).select("v", "by.u", "by.c"))  # a tree: one parent a node
    kind = back.schema["c"].dataType
    if back.count() <= SEARCH_EDGES:

        def walk(rows):
            by = {v: (u, c) for u, v, c in rows}
            path, a = [], target
            while a != source and a in by:
                path.append((by[a][0], a, by[a][1]))
                a = by[a][0]
            return [(i, *e) for i, e in enumerate(reversed(path))] if a == source else []

        return _in_one_task(back, walk, f"seq long, a long, b long, cost {kind.simpleString()}", [pa.int64()] * 3 + [to_arrow_type(kind)])
    # pointers double: after k rounds a node points 2^k steps back; the path is what the target reaches
    up, on = back.select("v", F.col("u").alias("up")), edges.sparkSession.createDataFrame([(target,)], "v long")
    while True:
        grown = cut(on.unionByName(on.join(up, "v").select(F.col("up").alias("v"))).distinct())
        if grown.count() == on.count():
            break
        on, up = grown, cut(up.join(up.select(F.col("v").alias("up"), F.col("up").alias("far")), "up", "left").select("v", F.coalesce("far", "up").alias("up")))
    steps = back.join(on, "v").join(dist.select(F.col("node").alias("v"), "dist"), "v")
    return steps.select((F.rank().over(Window.orderBy("dist")) - 1).cast("long").alias("seq"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("c").alias("cost"))


def lifted_distances(edges: DataFrame, upper: int) -> DataFrame:
    """(u, v, cost): cheapest path of at most ``upper`` edges for pairs that are no edge; edges keep their own cost."""
    step = cut(both_ways(edges, "cost"))
    best = step
    for _ in range(upper - 1):
        more = best.select("u", F.col("v").alias("m"), F.col("cost").alias("c1")).join(step.select(F.col("u").alias("m"), "v", "cost"), "m").filter("u <> v").select("u", "v", (F.col("c1") + F.col("cost")).alias("cost"))
        best = cut(best.unionByName(more).groupBy("u", "v").agg(F.min("cost").alias("cost")))
    far = best.join(step.select("u", "v"), ["u", "v"], "left_anti")
    return far.unionByName(step).filter("u < v")


def minimum_spanning_forest(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Boruvka: each component takes its cheapest outgoing edge (ties by u, v); edges(u, v, cost) of the forest."""
    rows = cut(edges.select("u", "v", "cost"))
    label = components(rows.select(F.explode(F.array("u", "v")).alias("a")).select("a", F.col("a").alias("b")))
    taken = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"the forest still grows after {rounds} rounds")
        left, right = label.select(F.col("node").alias("u"), F.col("component").alias("cu")), label.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        out = rows.join(left, "u").join(right, "v").filter("cu <> cv")
        least = out.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("cost", "u", "v").alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        new = cut(least.select("e.u", "e.v", "e.cost").distinct())
        if new.isEmpty():
            break
        taken = new if taken is None else cut(taken.unionByName(new))
        merged = components(taken.select(F.col("u").alias("a"), F.col("v").alias("b")))
        label = cut(label.select("node").join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    return taken if taken is not None else rows.limit(0)


def _by_component(edges: DataFrame, kernel, schema: str, cols: tuple = ()) -> DataFrame:
    comp = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    rows = edges.select("u", "v", *cols).join(comp.withColumnRenamed("node", "u"), "u")

    def run(key, t):
        out = kernel(sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", *cols)))))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})

    return rows.groupBy("component").applyInArrow(run, schema)


def lowlink(edges: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Bridges and cut vertices of one component, without recursion; parallel edges are no bridges."""
    near: dict[int, list] = {}
    for i, (u, v, *_) in enumerate(edges):
        near.setdefault(u, []).append((v, i))
        near.setdefault(v, []).append((u, i))
    order, low, bridges, cuts = {}, {}, [], set()
    for r in sorted(near):
        if r in order:
            continue
        order[r] = low[r] = len(order)
        stack, children = [(r, -1, iter(near[r]))], 0
        while stack:
            a, by, it = stack[-1]
            for b, i in it:
                if i == by:
                    continue
                if b in order:
                    low[a] = min(low[a], order[b])
                else:
                    children += a == r
                    order[b] = low[b] = len(order)
                    stack.append((b, i, iter(near[b])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[a])
                    if low[a] > order[p]:
                        bridges.append((min(a, p), max(a, p)))
                    if p != r and low[a] >= order[p]:
                        cuts.add(p)
        if children > 1:
            cuts.add(r)
    return sorted(bridges), sorted(cuts)


def bridges(edges: DataFrame) -> DataFrame:
    return _by_component(edges, lambda rows: lowlink(rows)[0], "u long, v long")


def cut_vertices(edges: DataFrame) -> DataFrame:
    return _by_component(edges, lambda rows: [(a,) for a in lowlink(rows)[1]], "node long")


def dfs_order(edges: DataFrame) -> DataFrame:
    """(node, seq, depth): depth-first visit of each component from its smallest node, smaller neighbours first."""

    def kernel(rows):
        near: dict[int, set] = {}
        for u, v in rows:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        seen, out, stack = set(), [], [(min(near), 0)]
        while stack:
            a, d = stack.pop()
            if a not in seen:
                seen.add(a)
                out.append((a, len(out), d))
                stack += [(b, d + 1) for b in sorted(near[a] - seen, reverse=True)]
        return out

    return _by_component(edges, kernel, "node long, seq long, depth long")


def max_flow(edges: list[tuple], source: int, sink: int) -> tuple[float, list[float]]:
    """Shortest augmenting paths: value and flow of each directed edge (u, v, capacity)."""
    near: dict[int, list] = {}
    left = []
    for u, v, c in edges:
        near.setdefault(u, []).append(len(left))
        left.append([v, c])
        near.setdefault(v, []).append(len(left))
        left.append([u, 0])
    value = 0
    while True:
        by, queue = {source: -1}, [source]
        for a in queue:
            for i in near.get(a, []):
                b, c = left[i]
                if c > 0 and b not in by:
                    by[b] = i
                    queue.append(b)
        if sink not in by:
            return value, [left[2 * i + 1][1] for i in range(len(edges))]
        path, a = [], sink
        while a != source:
            path.append(by[a])
            a = left[by[a] ^ 1][0]
        push = min(left[i][1] for i in path)
        for i in path:
            left[i][1] -= push
            left[i ^ 1][1] += push
        value += push


def grid_path(cost: dict[tuple, float], start: tuple, goal: tuple) -> list[tuple]:
    """Cheapest path through voxels of a masked volume (6 neighbours, cost of entered voxels); empty if there is none."""
    best, by, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if a == goal:
            path = [a]
            while a in by:
                a = by[a]
                path.append(a)
            return path[::-1]
        if d > best[a]:
            continue
        for k in range(3):
            for s in (-1, 1):
                b = a[:k] + (a[k] + s,) + a[k + 1 :]
                if b in cost and (n := d + cost[b]) < best.get(b, float("inf")):
                    best[b], by[b] = n, a
                    heapq.heappush(heap, (n, b))
    return []


def push_relabel(edges: list[tuple], source: int, sink: int) -> tuple[float, set]:
    """Maximum flow by first-in first-out push-relabel, and the source side of a least cut. edges: directed (u, v, capacity)."""
    left: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for u, v, c in edges:
        left.setdefault(u, {})[v] = left.get(u, {}).get(v, 0) + c
        left.setdefault(v, {}).setdefault(u, 0)
    n = len(left)
    height, excess = dict.fromkeys(left, 0), dict.fromkeys(left, 0)
    height[source] = n
    active: deque = deque()
    for b, c in list(left[source].items()):
        if c > 0 and b != source:
            left[source][b] = 0
            left[b][source] += c
            excess[b] += c
            if b != sink:
                active.append(b)
    while active:
        a = active.popleft()
        while excess[a] > 0:
            low = None
            for b, c in left[a].items():
                if c <= 0:
                    continue
                if height[a] == height[b] + 1:
                    push = min(c, excess[a])
                    left[a][b] -= push
                    left[b][a] += push
                    if not excess[b] and b not in (source, sink):
                        active.append(b)
                    excess[a] -= push
                    excess[b] += push
                    if not excess[a]:
                        break
                elif low is None or height[b] < low:
                    low = height[b]
            if excess[a]:
                height[a] = low + 1
    side, todo = {source}, [source]
    while todo:
        a = todo.pop()
        for b, c in left[a].items():
            if c > 0 and b not in side:
                side.add(b)
                todo.append(b)
    return excess[sink], side


def component_flows(edges: DataFrame) -> DataFrame:
    """(first, last, push, augment, cut) of every component of edges(u, v, n): flow from its first to its last node, both ways."""

    def kernel(rows):
        first, last = min(r[0] for r in rows), max(r[1] for r in rows)
        both = [x for u, v, c in rows for x in ((u, v, c), (v, u, c))]
        push, side = push_relabel(both, first, last)
        return [(first, last, push, max_flow(both, first, last)[0], sum(c for u, v, c in both if u in side and v not in side))]

    return _by_component(edges, kernel, "first long, last long, push long, augment long, cut long", ("n",))


def grid_pairs(voxels: DataFrame, upper: int, lower: int, metric: str = "l2") -> DataFrame:
    """(x, y, z, dx, dy): pairs of a slice's pixels with lower < distance <= upper, each once; metric l2 or path (city block).

    The other pixel is found by its offset, one equi-join for a bounded list of offsets.
    """
    size = lambda a, b: (a * a + b * b) ** 0.5 if metric == "l2" else abs(a) + abs(b)
    offsets = [(a, b) for b in range(upper + 1) for a in range(-upper, upper + 1) if (b > 0 or a > 0) and lower < size(a, b) <= upper]
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets))).alias("m")
    asked = voxels.select("x", "y", "z", moves).select("x", "y", "z", "m.dx", "m.dy")
    there = voxels.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    return asked.join(there, (asked.x + asked.dx == there.x2) & (asked.y + asked.dy == there.y2) & (asked.z == there.z2), "left_semi")


def erase_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without an end among gone(seg)."""
    for side in "uv":
        edges = edges.join(gone.withColumnRenamed("seg", side), side, "left_anti")
    return edges.select("u", "v")


def insert_edges(edges: DataFrame, new: DataFrame, multiple: bool = False) -> DataFrame:
    """Edges with more of them; without ``multiple`` an edge that is there already is not added again."""
    both = edges.unionByName(new.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return both if multiple else both.distinct()


def grid_graph(spark, shape: tuple) -> DataFrame:
    """(u, v) of a grid graph of any dimension; vertex = x + w * (y + h * z)."""
    strides = [1]
    for n in shape:
        strides.append(strides[-1] * n)
    nodes = spark.range(strides[-1]).withColumnRenamed("id", "u")
    steps = F.array_compact(F.array(*(F.when(F.floor(F.col("u") / s) % n < n - 1, F.col("u") + s) for s, n in zip(strides, shape))))
    return nodes.select("u", F.explode(steps).alias("v"))


def far_pairs(edges: DataFrame, nodes: DataFrame, hops: int, draws: int) -> DataFrame:
    """(u, v): a sample of the pairs more than ``hops`` apart, from ``draws`` other nodes for each of nodes(seg).

    All far pairs are the square of the nodes. Draws are spread over all nodes by a fixed linear rule on dense ids.
    """
    ids = cut(dense_ids(nodes, "seg").withColumnRenamed("new_label", "i"))
    n = ids.count()
    drawn = ids.select("seg", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k"), "i").select("seg", ((F.col("i") * 7919 + F.col("k") * 104729 + 17) % max(1, n)).alias("i"))
    pairs = drawn.join(ids.withColumnRenamed("seg", "other"), "i").filter("seg <> other").select(F.least("seg", "other").alias("u"), F.greatest("seg", "other").alias("v")).distinct()
    return pairs.join(k_hop(edges, hops, 0).select("u", "v"), ["u", "v"], "left_anti")


def long_range_costs(voxels: DataFrame, col: str, reach: int, scale: float) -> DataFrame:
    """(x, y, z, cost): every pixel and the one ``reach`` further along x, the logit of the largest value on the line between."""
    w = Window.partitionBy("z", "y").orderBy("x")
    p = F.greatest(F.col(col), *(F.lead(col, k).over(w) for k in range(1, reach + 1))) * scale
    rows = voxels.select("x", "y", "z", p.alias("p"), F.lead("x", reach).over(w).alias("end"))
    return rows.filter(F.col("end") == F.col("x") + reach).select("x", "y", "z", F.ln((1 - F.col("p")) / F.col("p")).alias("cost"))


def window_distances(cost: np.ndarray, reach: int) -> np.ndarray:
    """Cheapest path from every pixel to those within ``reach`` along either axis, inside that window: (w, h, 2 reach + 1, 2 reach + 1).

    A step costs the sum of both pixels. All pixels relax at once until nothing changes; pixels beyond the image are walls.
    """
    side = 2 * reach + 1
    padded = np.pad(cost.astype(float), reach, constant_values=np.inf)
    near = np.lib.stride_tricks.sliding_window_view(padded, (side, side))
    d = np.full(near.shape, np.inf)
    d[:, :, reach, reach] = np.where(np.isfinite(cost), 0.0, np.inf)
    while True:
        new = d.copy()
        for axis in (2, 3):
            first, second = (np.take(d, range(side - 1), axis), np.take(d, range(1, side), axis))
            a, b = (np.take(near, range(side - 1), axis), np.take(near, range(1, side), axis))
            low, high = [slice(None)] * 4, [slice(None)] * 4
            low[axis], high[axis] = slice(0, side - 1), slice(1, side)
            np.minimum(new[tuple(high)], first + (a + b), out=new[tuple(high)])
            np.minimum(new[tuple(low)], second + (a + b), out=new[tuple(low)])
        if np.array_equal(new, d):
            return d
        d = new


def lifted_grid_distances(voxels: DataFrame, col: str, upper: int, tile: int = 64) -> DataFrame:
    """(x, y, z, dx, dy, cost): every pair of a slice's pixels at most ``upper`` apart (the straight distance) and over one step, each once, with
    the cheapest path between them inside the window of ``upper`` pixels around the first. A task holds a tile and that window."""
    offsets = [(a, b) for b in range(upper + 1) for a in range(-upper, upper + 1) if (b > 0 or a > 0) and 1 < a * a + b * b <= upper * upper]
    at = lambda c: F.explode(F.expr(f"sequence(greatest(0, {c} - {upper}) div {tile}, ({c} + {upper}) div {tile})"))
    dealt = voxels.select("x", "y", "z", col).withColumn("tx", at("x")).withColumn("ty", at("y"))

    def run(key, t):
        x, y, c = np.asarray(t.column("x")), np.asarray(t.column("y")), np.asarray(t.column(col)).astype(float)
        grid = np.full((int(np.ptp(x)) + 1, int(np.ptp(y)) + 1), np.inf)
        grid[x - x.min(), y - y.min()] = c
        own = (x // tile == key[1].as_py()) & (y // tile == key[2].as_py())
        d = window_distances(grid, upper)[x[own] - x.min(), y[own] - y.min()]
        found = np.stack([d[:, a + upper, b + upper] for a, b in offsets], 1) if own.any() else np.zeros((0, len(offsets)))
        i, k = np.nonzero(np.isfinite(found))
        moves = np.array(offsets)[k] if len(k) else np.zeros((0, 2), np.int64)
        return pa.table({"x": x[own][i], "y": y[own][i], "z": pa.array([key[0].as_py()] * len(i), pa.int64()), "dx": moves[:, 0].astype(np.int64), "dy": moves[:, 1].astype(np.int64), "cost": found[i, k]})

    return dealt.groupBy("z", "tx", "ty").applyInArrow(run, "x long, y long, z long, dx long, dy long, cost double")
