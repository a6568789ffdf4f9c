"""Whole workflows: learnt multicuts, plain and lifted, with bad slices, in slices, and the repair of false merges."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutgrove.functions import energies as en
from cutgrove.session import cut, settle

from . import features, graphs, grids, images, learning, multicut, paths, rag, superpixels
from .components import components
from .relabel import running_offsets

#: What the lifted features vary.
BETAS, WEIGHTS = (0.4, 0.45, 0.5, 0.55, 0.65), (12.0, 16.0, 25.0)
WARDNESS = (0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)


def costs(p: DataFrame, beta: float = 0.5, scheme: str = "z", weight: float = 16.0) -> DataFrame:
    """(u, v, cost) of edges(u, v, n, kind, p)."""
    return en.weigh(p.withColumn("cost", en.energy(F.col("p"), beta)), scheme, weight, e="cost").select("u", "v", "cost")


def multicut_workflow(volumes: list[DataFrame], test: DataFrame, solver: str = "kl", scheme: str = "z") -> DataFrame:
    """(node, label) of the test volume, weights learnt on others."""
    return multicut.solve(costs(cut(learning.learn_and_predict(volumes, test)), scheme=scheme), solver)


def defect_workflow(volumes: list[DataFrame], test: DataFrame, bad: tuple, solver: str = "kl", train_bad: tuple = ()) -> DataFrame:
    """The same over the edges that bad slices leave, skip edges included; ignored edges repel most."""
    p = cut(learning.learn_with_defects(volumes, test, bad, train_bad=train_bad))
    e = cut(en.weigh(p.withColumn("cost", en.energy(F.col("p"))), "z", e="cost").select("u", "v", "ignore", "cost"))
    low = e.agg(F.min("cost")).first()[0] or 0.0
    return multicut.solve(e.select("u", "v", F.when(F.col("ignore") == 1, F.lit(2 * low)).otherwise(F.col("cost")).alias("cost")), solver)


def slicewise(edges: DataFrame, node_z: DataFrame, solver: str = "kl") -> DataFrame:
    """(node, label): the multicut of every slice's own graph of edges(u, v, cost), a task a slice."""
    e = rag.ends(edges, node_z, ("z",)).filter("z_u = z_v")

    def run(key, t):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", "cost"))))
        labels = multicut.SOLVERS[solver](rows, [])
        return pa.table({"node": pa.array(list(labels), pa.int64()), "label": pa.array(list(labels.values()), pa.int64())})

    return e.select(F.col("z_u").alias("z"), "u", "v", "cost").groupBy("z").applyInArrow(run, "node long, label long")


def _copies(rows: DataFrame, n: int, nodes: int) -> DataFrame:
    """Rows(u, v, ...) once for each number k under n, with nodes of their own: node + k * nodes."""
    shift = F.col("k") * nodes
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumns({"u": F.col("u") + shift, "v": F.col("v") + shift})


def multicut_states(p: DataFrame, pairs: DataFrame, scheme: str = "z") -> DataFrame:
    """(u, v, mc_0 .. mc_14, mc_sum): whether multicuts for all betas and weights separate a lifted pair.

    The fifteen problems are one graph of fifteen copies, solved in one run.
    """
    settings = [(b, w) for b in BETAS for w in WEIGHTS]
    nodes = (p.agg(F.max("v")).first()[0] or 0) + 1
    parts = [costs(p, b, scheme, w).withColumns({"u": F.col("u") + k * nodes, "v": F.col("v") + k * nodes}) for k, (b, w) in enumerate(settings)]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    labels = cut(multicut.solve(whole))
    asked = _copies(pairs.select("u", "v"), len(settings), nodes)
    both = asked.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
    apart = (F.coalesce("lu", "u") != F.coalesce("lv", "v")).cast("int")
    out = both.select((F.col("u") - F.col("k") * nodes).alias("u"), (F.col("v") - F.col("k") * nodes).alias("v"), "k", apart.alias("s"))
    return out.groupBy("u", "v").agg(*(F.max(F.when(F.col("k") == k, F.col("s"))).alias(f"mc_{k}") for k in range(len(settings))), F.sum("s").alias("mc_sum"))


def perturbed(p: DataFrame, pairs: DataFrame, n: int, spread: float, seed: int = 42) -> DataFrame:
    """(u, v, share): the share of ``n`` multicuts with noise on their costs that separate a pair.

    The noise is logistic with scale ``spread``, made from a hash of the edge, so it is the same in every run.
    """
    nodes = (p.agg(F.max("v")).first()[0] or 0) + 1
    whole = _copies(costs(p), n, nodes)
    unit = (F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    labels = cut(multicut.solve(whole.withColumn("cost", F.col("cost") + spread * F.ln(unit / (1 - unit))).select("u", "v", "cost")))
    asked = _copies(pairs.select("u", "v"), n, nodes)
    both = asked.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
    back = both.select((F.col("u") - F.col("k") * nodes).alias("u"), (F.col("v") - F.col("k") * nodes).alias("v"), (F.coalesce("lu", "u") != F.coalesce("lv", "v")).cast("double").alias("s"))
    return back.groupBy("u", "v").agg(F.avg("s").alias("share"))


def merge_heights(rows: list[tuple], sizes: dict, wardness: float, pairs: list[tuple]) -> list[float]:
    """The height at which hierarchical clustering of edges (u, v, p, n) joins each pair; the last height where it never does.

    An edge's height is its mean p by length times the harmonic mean of both sizes to the power ``wardness``. Heights only grow
    with sizes, so what was pushed for a pair is a bound: only edges of the smaller cluster are pushed again by a join.
    """
    near: dict[int, dict[int, tuple]] = {}
    for u, v, p, n in rows:
        near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = (p * n, n)
    size, members = dict(sizes), {a: [a] for a in near}
    asked: dict[int, list] = {}
    for i, (u, v) in enumerate(pairs):
        asked.setdefault(u, []).append((v, i))
        asked.setdefault(v, []).append((u, i))
    name = {a: a for a in near}
    height = lambda u, v: near[u][v][0] / near[u][v][1] * 2 / (size[u] ** -wardness + size[v] ** -wardness)
    heap = [(height(u, v), u, v) for u in near for v in near[u] if u < v]
    heapq.heapify(heap)
    out, top = [None] * len(pairs), 0.0
    while heap:
        h, u, v = heapq.heappop(heap)
        if u not in near or v not in near[u]:
            continue
        if h != (now := height(u, v)):  # it has grown since with a cluster's size
            heapq.heappush(heap, (now, u, v))
            continue
        top = max(top, h)
        if len(members[u]) < len(members[v]):
            u, v = v, u
        for a in members[v]:
            for b, i in asked.get(a, ()):
                if name.get(b) == u:
                    out[i] = h
        for a in members[v]:
            name[a] = u
        members[u] += members.pop(v)
        size[u] += size[v]
        for w, (s, n) in near.pop(v).items():
            del near[w][v]
            if w != u:
                s0, n0 = near[u].get(w, (0.0, 0))
                near[u][w] = near[w][u] = (s + s0, n + n0)
                heapq.heappush(heap, (height(u, w), min(u, w), max(u, w)))
    return [top if x is None else x for x in out]


#: Edges that clusterings hold in a task.
HEIGHT_EDGES = 60_000
#: Edges at the nodes of a range beyond that: the work of a range grows faster than its edges.
HEIGHT_RANGE = 15_000


def safe_merges(edges: list[tuple], pairs: list[tuple], part: int, copy: int) -> list[tuple]:
    """What hierarchical clustering joins inside a part, whatever other parts join: (node, name, size, members, top) of every
    node in a joined cluster, and (u, v, height, 0, 0) of every pair (u, v, a, b) whose nodes a and b are joined.

    edges: (u, v, s, n, size, members and top of u, the same of v, part of u, part of v) of all edges at the part's nodes.
    A join never brings a cluster closer to a third than the nearer of the two was. So the least edge of a node inside may
    be joined unless it leads out of the part or to a node that waits for such an edge; then the node waits too.
    Nodes of copy i are i * copy and more, with the wardness of that number.
    """
    near: dict[int, dict[int, tuple]] = {}
    size, count, top, outside = {}, {}, {}, set()
    for u, v, s, n, *x, pu, pv in edges:
        near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = (s, n)
        size[u], count[u], top[u], size[v], count[v], top[v] = x
        outside.update(a for a, p in ((u, pu), (v, pv)) if p != part)
    members, name, waits = {a: [a] for a in near}, {a: a for a in near}, set(outside)
    asked: dict[int, list] = {}
    for i, (_, _, a, b) in enumerate(pairs):
        asked.setdefault(a, []).append((b, i))
        asked.setdefault(b, []).append((a, i))
    power = {a: size[a] ** -WARDNESS[a // copy] for a in near}
    height = lambda u, v: near[u][v][0] / near[u][v][1] * 2 / (power[u] + power[v])
    heap = [(height(u, v), u, v) for u in near for v in near[u] if u < v]
    heapq.heapify(heap)
    out = []
    while heap:
        h, u, v = heapq.heappop(heap)
        if u not in near or v not in near[u]:
            continue
        if h != (now := height(u, v)):  # it has grown since with a cluster's size
            heapq.heappush(heap, (now, u, v))
            continue
        if u in waits or v in waits:
            waits |= {u, v}
            continue
        if count[u] < count[v]:
            u, v = v, u
        few, many = (u, v) if len(members[u]) < len(members[v]) else (v, u)
        for a in members[few]:
            for b, i in asked.get(a, ()):
                if name.get(b) == many:
                    out.append((*pairs[i][:2], h, 0, 0.0))
        moved, joined = len(members[few]), members.pop(many)
        joined += members.pop(few)
        members[u] = joined
        for a in joined if many != u else joined[-moved:]:
            name[a] = u
        size[u] += size[v]
        count[u] += count[v]
        top[u] = max(top[u], top[v], h)
        power[u] = size[u] ** -WARDNESS[u // copy]
        for w, (s, n) in near.pop(v).items():
            del near[w][v]
            if w != u:
                s0, n0 = near[u].get(w, (0.0, 0))
                near[u][w] = near[w][u] = (s + s0, n + n0)
                heapq.heappush(heap, (height(u, w), min(u, w), max(u, w)))
    return out + [(a, u, size[u], count[u], top[u]) for u, all_of in members.items() if len(all_of) > 1 for a in all_of]


def heights_by_ranges(p: DataFrame, sizes: DataFrame, pairs: DataFrame, most: int, rounds: int = 200) -> DataFrame:
    """(u, v, k, h) of lifted pairs for all wardness values, in ranges of nodes of about ``most`` edges, a task each.

    Clusterings of all values are one graph of copies. Every round joins what is safe inside the ranges, sums parallel edges
    and shifts the ranges; where they join nothing, pairs that are each other's nearest are parts of their own for a round.
    """
    copy = (p.agg(F.max("v")).first()[0] or 0) + 1
    edges = settle(_copies(p.select("u", "v", (F.col("p") * F.col("n")).cast("double").alias("s"), F.col("n").cast("double").alias("n")), len(WARDNESS), copy).drop("k"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(WARDNESS) - 1).cast("long"))).alias("k")
    nodes = p.select(F.explode(F.array("u", "v")).alias("seg")).distinct().join(sizes, "seg").select("seg", F.col("size").cast("double").alias("size"), k)
    nodes = settle(nodes.select((F.col("seg") + F.col("k") * copy).alias("node"), "size", F.lit(1).cast("long").alias("members"), F.lit(0.0).alias("top")))
    known = nodes.select("node")
    open_pairs = settle(_copies(pairs.select("u", "v"), len(WARDNESS), copy).select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")).join(known.withColumnRenamed("node", "a"), "a", "left_semi"))
    spark = p.sparkSession  # ranges are few bytes and much work: they are dealt to tasks by number and not joined by their size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found, stuck = [], 0
    for turn in range(rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
        if stuck < 2:
            at = running_offsets(ends.groupBy("node").agg(F.count("*").alias("n")), "node", "n")
            part = at.select("node", F.floor(F.col("off") / (2 * most) + 0.5 * (turn % 2)).alias("part"))
        else:
            part = _mutual_parts(edges, nodes, copy)
        held = settle(nodes.join(part, "node"))
        both = edges
        for side in "uv":
            both = both.join(held.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("size", "members", "top", "part"))), side)
        cols = ("u", "v", "s", "n", "size_u", "members_u", "top_u", "size_v", "members_v", "top_v", "part_u", "part_v")
        none = F.lit(None).cast("long")
        rows = both.select(F.explode(F.array_distinct(F.array("part_u", "part_v"))).alias("part"), *cols, none.alias("a"), none.alias("b"))
        where = held.select("node", "part")
        inside = open_pairs.join(where.withColumnsRenamed({"node": "a", "part": "pa"}), "a").join(where.withColumnsRenamed({"node": "b", "part": "pb"}), "b").filter("pa = pb")
        rows = rows.unionByName(inside.select(F.col("pa").alias("part"), "u", "v", "a", "b"), allowMissingColumns=True)

        def run(key, t):
            got = [t.column(c).to_pylist() for c in (*cols, "a", "b")]
            own = sorted(r[:-2] for r in zip(*got) if r[-1] is None)
            asked = sorted((r[0], r[1], r[-2], r[-1]) for r in zip(*got) if r[-1] is not None)
            out = safe_merges(own, asked, key[0].as_py(), copy)
            kinds = (("x", pa.int64()), ("y", pa.int64()), ("h", pa.float64()), ("members", pa.int64()), ("top", pa.float64()))
            return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(kinds)})

        done = settle(rows.repartition(tasks, "part").groupBy("part").applyInArrow(run, "x long, y long, h double, members long, top double"))
        found.append(done.filter("members = 0").select("x", "y", "h"))
        names = done.filter("members > 0")
        if names.isEmpty():
            stuck += 1
            continue
        stuck = 0 if stuck < 2 else 2  # once ids say nothing about neighbours, they won't later
        to = names.select(F.col("x").alias("node"), F.col("y").alias("to"))
        changed = names.select(F.col("x").alias("node"), F.col("y").alias("to"), F.col("h").alias("size2"), F.col("members").alias("members2"), F.col("top").alias("top2"))
        nodes = nodes.join(changed, "node", "left").filter("to is null or to = node")
        nodes = settle(nodes.select("node", *(F.coalesce(f"{c}2", c).alias(c) for c in ("size", "members", "top"))))
        for side in "uv":
            edges = edges.join(to.withColumnsRenamed({"node": side}), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = settle(edges.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
        for side in "ab":
            open_pairs = open_pairs.join(to.withColumnsRenamed({"node": side}), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        open_pairs = settle(open_pairs.filter("a <> b"))
    else:
        raise RuntimeError(f"clusterings did not end in {rounds} rounds")
    found.append(open_pairs.join(nodes.withColumnRenamed("node", "a"), "a").select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("top").alias("h")))  # never joined
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    number = F.floor(F.col("x") / copy).cast("int")
    return out.select((F.col("x") % copy).alias("u"), (F.col("y") % copy).alias("v"), number.alias("k"), "h")


def _mutual_parts(edges: DataFrame, nodes: DataFrame, copy: int) -> DataFrame:
    """(node, part): the smaller of two nodes that are each other's nearest, or the node itself."""
    both = edges
    for side in "uv":
        both = both.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}")), side)
    ward = F.element_at(F.array(*(F.lit(-w) for w in WARDNESS)), (F.floor(F.col("u") / copy) + 1).cast("int"))
    height = F.col("s") / F.col("n") * 2 / (F.pow("size_u", ward) + F.pow("size_v", ward))
    edge = F.struct(height.alias("h"), "u", "v")
    best = settle(both.select(F.explode(F.array("u", "v")).alias("node"), edge.alias("e")).groupBy("node").agg(F.min("e").alias("e")).select("node", "e.u", "e.v"))
    mutual = best.groupBy("u", "v").agg(F.count("*").alias("n")).filter("n = 2").select("u", F.col("v").alias("node"))
    return nodes.select("node").join(mutual, "node", "left").select("node", F.coalesce("u", "node").alias("part"))


def _by_components(p: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, k, h) of lifted pairs for all wardness values; a task holds one component."""
    comp = cut(components(p.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    of = lambda c: comp.select(F.col("node").alias(c), "component")
    k = F.explode(F.sequence(F.lit(0), F.lit(len(WARDNESS) - 1))).alias("k")
    none = F.lit(None).cast("double")
    e = p.join(of("u"), "u").select("component", "u", "v", F.col("p").cast("double").alias("p"), F.col("n").cast("double").alias("n"))
    s = sizes.select(F.col("seg").alias("u"), F.col("size").cast("double").alias("n")).join(of("u"), "u").select("component", "u", F.lit(None).cast("long").alias("v"), none.alias("p"), "n")
    f = pairs.select("u", "v").join(of("u"), "u").select("component", "u", "v", none.alias("p"), none.alias("n"))

    def run(key, t):
        rows = list(zip(*(t.column(c).to_pylist() for c in ("u", "v", "p", "n"))))
        own = sorted(r for r in rows if r[1] is not None and r[2] is not None)
        size = {r[0]: r[3] for r in rows if r[1] is None}
        asked = sorted((r[0], r[1]) for r in rows if r[1] is not None and r[2] is None)
        got = merge_heights(own, size, WARDNESS[key[1].as_py()], asked)
        return pa.table({"u": pa.array([a for a, _ in asked], pa.int64()), "v": pa.array([b for _, b in asked], pa.int64()), "k": pa.array([key[1].as_py()] * len(asked), pa.int32()), "h": pa.array(got, pa.float64())})

    rows = e.unionByName(s).unionByName(f).select("*", k)
    return rows.groupBy("component", "k").applyInArrow(run, "u long, v long, k int, h double")


def cluster_heights(p: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, cl_0 .. cl_7, cl_mean, cl_dev): heights of lifted pairs for all wardness values.

    Up to HEIGHT_EDGES edges a task holds one component; beyond that it goes by ranges of nodes.
    """
    out = _by_components(p, sizes, pairs) if p.count() <= HEIGHT_EDGES else heights_by_ranges(p, sizes, pairs, min(HEIGHT_EDGES, HEIGHT_RANGE))
    return out.groupBy("u", "v").agg(*(F.max(F.when(F.col("k") == i, F.col("h"))).alias(f"cl_{i}") for i in range(len(WARDNESS))), F.avg("h").alias("cl_mean"), F.stddev_pop("h").alias("cl_dev"))


def lifted_features(voxels: DataFrame, p: DataFrame, pairs: DataFrame, kinds: tuple = ("mc", "cluster", "reg")) -> DataFrame:
    """(u, v, f_...) of lifted pairs: multicut states, cluster heights, region statistics, and the distance along z."""
    z = voxels.groupBy("seg").agg(F.max("z").alias("z"), F.count("*").alias("size"))
    wide = rag.ends(pairs.select("u", "v"), z, ("z",)).select("u", "v", F.abs(F.col("z_u") - F.col("z_v")).alias("dz"))
    if "mc" in kinds:
        wide = wide.join(multicut_states(p, pairs), ["u", "v"])
    if "cluster" in kinds:
        wide = wide.join(cluster_heights(p, z.select("seg", "size"), pairs), ["u", "v"])
    if "reg" in kinds:
        wide = wide.join(features.pair_statistics(pairs, features.region_statistics(voxels)), ["u", "v"])
    return learning.fine(wide, ("u", "v"))


def lifted_pairs(edges: DataFrame, hops: int) -> DataFrame:
    return cut(graphs.k_hop(edges.select("u", "v"), hops).select("u", "v"))


def lifted_probabilities(train: DataFrame, test: DataFrame, hops: int = 2, kinds: tuple = ("mc", "cluster", "reg")) -> tuple[DataFrame, DataFrame]:
    """Lifted (u, v, p) and local (u, v, n, kind, p) of the test volume.

    The training volume is cut in three along z; the middle's local probabilities come from a forest over the outer two,
    and on its lifted pairs a forest of depth 10 is learnt. The test volume's local ones come from the outer two as well.
    """
    low, middle, high = learning.z_cutouts(train, (0.35, 0.65))
    local = learning.train(learning.training_rows([low, high]))  # judges the middle and the test volume
    p_middle = cut(learning.judged(local, middle))
    pairs = lifted_pairs(p_middle, hops)
    rows = lifted_features(middle, p_middle, pairs, kinds).join(learning.edge_labels(pairs, middle), ["u", "v"]).drop("u", "v")
    model = learning.train(rows, learning.Forest(depth=10))
    p_test = cut(learning.judged(local, test))
    far = lifted_pairs(p_test, hops)
    return cut(learning.predict(model, lifted_features(test, p_test, far, kinds)).select("u", "v", "p")), p_test


def lifted_workflow(train: DataFrame, test: DataFrame, hops: int = 2, beta: float = 0.5, gamma: float = 1.0, kinds: tuple = ("mc", "cluster", "reg"), solver: str = "lifted") -> DataFrame:
    """(node, label) of the test volume by a lifted multicut; both kinds of energies are divided by their number."""
    far, p = lifted_probabilities(train, test, hops, kinds)
    z = test.groupBy("seg").agg(F.max("z").alias("z"))
    lifted = rag.ends(far, z, ("z",)).select("u", "v", (en.energy(F.col("p"), beta) / gamma / (F.abs(F.col("z_u") - F.col("z_v")) + 1)).alias("e"))
    both = cut(en.balanced(costs(p).withColumnRenamed("cost", "e"), cut(lifted)))
    part = lambda k: both.filter(F.col("is_local") == k).select("u", "v", F.col("e").alias("cost"))
    return multicut.solve(part(1), solver, part(0))


def lifted_defect_workflow(volumes: list[DataFrame], test: DataFrame, bad: tuple, hops: int = 2, train_bad: tuple = ()) -> DataFrame:
    """Lifted multicut over modified edges: lifted energies from the weakest edge on the best path; pairs at bad slices repel most."""
    p = cut(learning.learn_with_defects(volumes, test, bad, train_bad=train_bad))
    e = cut(en.weigh(p.withColumn("cost", en.energy(F.col("p"))), "z", e="cost").select("u", "v", "ignore", "cost"))
    low = e.agg(F.min("cost")).first()[0] or 0.0
    local = cut(e.select("u", "v", F.when(F.col("ignore") == 1, F.lit(2 * low)).otherwise(F.col("cost")).alias("cost")))
    bad_nodes = test.filter(F.col("z").isin(*bad)).select("seg").distinct().withColumn("bad", F.lit(1))
    far = lifted_pairs(local, hops)
    steps = graphs.both_ways(local, "cost")
    via = steps.select("u", F.col("v").alias("m"), F.col("cost").alias("c1")).join(steps.select(F.col("u").alias("m"), "v", "cost"), "m").filter("u < v").groupBy("u", "v").agg(F.max(F.least("c1", "cost")).alias("cost"))
    lifted = far.join(via, ["u", "v"])
    for side in "uv":
        lifted = lifted.join(bad_nodes.withColumnsRenamed({"seg": side, "bad": f"bad_{side}"}), side, "left")
    lifted = lifted.select("u", "v", F.when(F.coalesce("bad_u", "bad_v").isNotNull(), F.lit(2 * low)).otherwise(F.col("cost")).alias("e"))
    both = cut(en.balanced(local.withColumnRenamed("cost", "e"), cut(lifted)))
    part = lambda k: both.filter(F.col("is_local") == k).select("u", "v", F.col("e").alias("cost"))
    return multicut.solve(part(1), "lifted", part(0))


# ---- false merges


def path_ends(voxels: DataFrame, last_x: int, last_y: int) -> DataFrame:
    """(obj, x, y, z): the innermost voxel of each place where an object leaves the volume; where the mean of several such
    voxels lies outside the object, the nearest of its voxels on that side."""
    found = superpixels.face_centroids(voxels, "obj", last_x, last_y)
    contacts = images.border_contacts(voxels.select("x", "y", "z", F.col("obj").alias("seg")), last_x, last_y).withColumnsRenamed({"seg": "obj", "a": "ca", "b": "cb"})
    gap = (F.col("a") - F.col("ca")) * (F.col("a") - F.col("ca")) + (F.col("b") - F.col("cb")) * (F.col("b") - F.col("cb"))
    near = found.join(contacts, ["obj", "face"]).groupBy("obj", "face", "piece").agg(F.min(F.struct(gap.alias("gap"), "ca", "cb")).alias("n")).select("obj", "face", F.col("n.ca").alias("a"), F.col("n.cb").alias("z"))
    side = lambda axis, last: F.when(F.col("face") == f"{axis}0", 0).when(F.col("face") == f"{axis}1", last).otherwise(F.col("a")).cast("long").alias(axis)
    return near.select("obj", side("x", last_x), side("y", last_y), "z").distinct()


def object_paths(voxels: DataFrame, obj: str, last_x: int, last_y: int, pitch: float = 5.0, power: int = 10, chunk: tuple = paths.CHUNK) -> DataFrame:
    """(obj, path, seq, x, y, z, depth): cheapest paths inside every object between the places where it leaves the volume.

    The cost falls off towards the middle of the object: (1 - distance to its surface / the largest) ** power; depth is that
    distance. Distances go by lines and paths by chunks, so an object spreads over many tasks.
    """
    rows = voxels.select("x", "y", "z", F.col(obj).cast("long").alias("obj"))
    d = settle(grids.label_distances(rows, "obj", (1.0, 1.0, pitch)).select("x", "y", "z", F.col("label").alias("obj"), F.sqrt("d2").alias("depth")))
    deepest = d.groupBy("obj").agg(F.max("depth").alias("most"))
    cost = F.pow(1 - F.col("depth") / F.col("most"), F.lit(power)) + 1e-3
    priced = settle(d.join(deepest, "obj").select("x", "y", "z", "obj", cost.alias("cost")))
    ends = path_ends(rows, last_x, last_y)
    place = F.struct("z", "y", "x")
    a, b = ends.select("obj", place.alias("a")), ends.select("obj", place.alias("b"))
    pairs = settle(a.join(b, "obj").filter("a < b").withColumn("pair", F.monotonically_increasing_id()))
    mine = priced.join(pairs.select("obj", "pair"), "obj").select("x", "y", "z", F.col("pair").alias("obj"), "cost")
    end = lambda c: pairs.select(*(F.col(f"{c}.{k}").alias(k) for k in "xyz"), F.col("pair").alias("obj"))
    steps = settle(paths.traced(paths.distances(mine, end("a"), chunk), end("b")).withColumnRenamed("obj", "pair"))
    named = steps.select("pair").distinct().join(pairs, "pair").select("pair", "obj", (F.row_number().over(Window.partitionBy("obj").orderBy("a", "b")) - 1).cast("long").alias("path"))
    return steps.join(named, "pair").join(d, ["x", "y", "z", "obj"]).select("obj", "path", "seq", "x", "y", "z", "depth")


def path_features(paths: DataFrame, voxels: DataFrame, pitch: float = 5.0) -> DataFrame:
    """(obj, path, f_...): seven statistics of raw, pm and depth along every path, its length, and label = 1 if it meets several gt objects."""
    on = paths.join(voxels.select("x", "y", "z", "raw", "pm", "gt"), ["x", "y", "z"])
    seven = features.EDGE_STATS[:7]
    stats = [c.alias(f"{n}_{s}") for n, v in (("raw", F.col("raw")), ("pm", F.col("pm")), ("depth", F.col("depth"))) for s, c in zip(seven, features.statistics(v))]
    found = on.groupBy("obj", "path").agg(*stats, F.count("*").alias("n"), (F.countDistinct("gt") > 1).cast("double").alias("label"))
    return learning.fine(found.drop("label"), ("obj", "path")).join(found.select("obj", "path", "label"), ["obj", "path"])


def false_merges(train: DataFrame, test: DataFrame, obj: str, last_x: int, last_y: int) -> tuple[DataFrame, DataFrame]:
    """(obj, path, p) of the test volume's paths, p that the object is a false merge along it, and the paths themselves."""
    rows = path_features(cut(object_paths(train, obj, last_x, last_y)), train)
    paths = cut(object_paths(test, obj, last_x, last_y))
    model = learning.train(rows.drop("obj", "path"))
    return learning.predict(model, path_features(paths, test)).select("obj", "path", "p"), paths


def resolve_merges(test: DataFrame, obj: str, probabilities: DataFrame, paths: DataFrame, local: DataFrame, least: float = 0.5) -> DataFrame:
    """(obj, seg, part): objects with a path of probability ``least`` or more solved anew as lifted multicuts.

    Every path lifts the pair of segments at its ends, with the path's probability as the energy to cut; local edges
    (u, v, cost) inside the object keep theirs. One task holds one object.
    """
    bad = probabilities.filter(F.col("p") >= least).select("obj").distinct()
    seg = test.select("x", "y", "z", "seg")
    ends = paths.join(bad, "obj", "left_semi").groupBy("obj", "path").agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("a"), F.max_by(F.struct("x", "y", "z"), "seq").alias("b"))
    for k in "ab":
        ends = ends.withColumns({c: F.col(f"{k}.{c}") for c in "xyz"}).join(seg.withColumnRenamed("seg", f"seg_{k}"), ["x", "y", "z"]).drop("x", "y", "z")
    lifted = ends.join(probabilities, ["obj", "path"]).filter("seg_a <> seg_b").groupBy("obj", F.least("seg_a", "seg_b").alias("u"), F.greatest("seg_a", "seg_b").alias("v")).agg(F.max("p").alias("p"))
    nodes = test.select("seg", F.col(obj).alias("obj")).distinct().join(bad, "obj", "left_semi")
    inside = local.join(nodes.withColumnsRenamed({"seg": "u"}), "u").join(nodes.withColumnsRenamed({"seg": "v", "obj": "obj_v"}), "v").filter("obj = obj_v")
    rows = inside.select("obj", "u", "v", "cost", F.lit(True).alias("is_local")).unionByName(lifted.select("obj", "u", "v", en.energy(F.col("p")).alias("cost"), F.lit(False).alias("is_local")))

    def run(key, t):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", "cost", "is_local"))))
        e, f = [r[:3] for r in rows if r[3]], [r[:3] for r in rows if not r[3]]
        known = {a for r in e for a in r[:2]}
        labels = multicut.optimize_lifted(e, [r for r in f if r[0] in known and r[1] in known]) if e else {}
        names = {k: i for i, k in enumerate(sorted(set(labels.values())))}
        return pa.table({"obj": pa.array([key[0].as_py()] * len(labels), pa.int64()), "seg": pa.array(list(labels), pa.int64()), "part": pa.array([names[k] for k in labels.values()], pa.int64())})

    return rows.groupBy("obj").applyInArrow(run, "obj long, seg long, part long")
