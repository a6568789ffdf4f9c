"""Multicut and lifted multicut: minimise the cost of cut edges. Costs over 0 attract.

Attractive components are solved apart, each by a kernel in one task: every edge between them is repulsive and cut in
any optimum of the plain problem. Larger problems are contracted first and improved in blocks of whole parts. Kernels are plain Python over one component's edges with a fixed order of ties.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutgrove.session import cut, settle

from .components import components


def gaec(edges: list[tuple], lifted: list[tuple] = ()) -> dict[int, int]:
    """Greedy additive contraction along local edges, heaviest first while not repulsive; ties by fewer neighbours, then (u, v).

    Lifted edges add their cost to a pair but never allow a contraction by themselves. Returns node -> smallest node.
    """
    cost: dict[int, dict[int, float]] = {}
    local: dict[int, set] = {}
    for kind, rows in ((1, edges), (0, lifted)):
        for u, v, c in rows:
            for a, b in ((u, v), (v, u)):
                cost.setdefault(a, {})
                local.setdefault(a, set())
                if a != b:
                    cost[a][b] = cost[a].get(b, 0.0) + c
                    if kind:
                        local[a].add(b)
    label = {a: a for a in cost}
    heap = [(-c, len(cost[u]) + len(cost[v]), u, v) for u in cost for v, c in cost[u].items() if u < v and v in local[u]]
    heapq.heapify(heap)
    while heap:
        c, _, u, v = heapq.heappop(heap)
        if u not in cost or v not in cost or v not in local[u] or cost[u].get(v) != -c:
            continue
        if c > 0:
            break
        keep, gone = (u, v) if len(cost[u]) >= len(cost[v]) else (v, u)
        label[gone] = keep
        for w, x in cost.pop(gone).items():
            if w == keep:
                continue
            del cost[w][gone]
            near = w in local[gone] or w in local[keep]
            local[w].discard(gone)
            cost[keep][w] = cost[w][keep] = cost[keep].get(w, 0.0) + x
            if near:
                local[keep].add(w)
                local[w].add(keep)
                heapq.heappush(heap, (-cost[keep][w], len(cost[keep]) + len(cost[w]), min(keep, w), max(keep, w)))
        del cost[keep][gone]
        local[keep].discard(gone)
        local.pop(gone)

    def root(a):
        while label[a] != a:
            label[a] = a = label[label[a]]
        return a

    low: dict[int, int] = {}
    for a in sorted(label):
        low.setdefault(root(a), a)
    return {a: low[root(a)] for a in label}


def cut_energy(edges, labels: dict[int, int]) -> float:
    return sum(c for u, v, c in edges if labels[u] != labels[v])


def connected_labels(edges, labels: dict[int, int]) -> dict[int, int]:
    """Splits labels into parts that are connected by local edges; names are smallest nodes."""
    near: dict[int, list] = {a: [] for a in labels}
    for u, v, _ in edges:
        if labels[u] == labels[v]:
            near[u].append(v)
            near[v].append(u)
    out: dict[int, int] = {}
    for a in sorted(labels):
        if a not in out:
            todo = [a]
            out[a] = a
            while todo:
                for b in near[todo.pop()]:
                    if b not in out:
                        out[b] = a
                        todo.append(b)
    return out


def adjacency(labels, edges, lifted=()) -> tuple[dict, dict]:
    """Costs of all pairs and neighbours by local edges, as dictionaries of dictionaries and of sets."""
    cost: dict[int, dict[int, float]] = {a: {} for a in labels}
    near: dict[int, set] = {a: set() for a in labels}
    for rows, local in ((edges, True), (lifted, False)):
        for u, v, c in rows:
            if u != v:
                cost[u][v] = cost[u].get(v, 0.0) + c
                cost[v][u] = cost[v].get(u, 0.0) + c
                if local:
                    near[u].add(v)
                    near[v].add(u)
    return cost, near


def two_cut(a: set, b: set, cost: dict, near: dict, eps: float, fixed: set = frozenset()) -> tuple[float, list, bool]:
    """The best sequence of moves between two parts: (gain, moved nodes, whether both parts should rather be one).

    Nodes move one by one, the largest gain first (ties: the smaller node), each at most once and only where a local
    neighbour is on the other side; with b empty any node may start it. The best prefix of the whole sequence counts. Fixed
    nodes pull but stay, and parts with fixed nodes are never made one.
    """
    side = dict.fromkeys(a, 0) | dict.fromkeys(b, 1)
    inside, gain, across = {}, {}, {}  # pairs in these two parts, gain of a move, local neighbours on the other side
    between = 0.0
    for v, own in side.items():
        g, n, local = 0.0, 0, near[v]
        inside[v] = pairs = [(w, c) for w, c in cost[v].items() if w in side]
        for w, c in pairs:
            if side[w] != own:
                g += c
                if not own:
                    between += c
                if w in local:
                    n += 1
            else:
                g -= c
        gain[v], across[v] = g, n
    start = a if not b else [v for v in side if across[v]]
    heap = [(-gain[v], v) for v in start if v not in fixed]
    heapq.heapify(heap)
    moved, total, best, prefix, done = [], 0.0, 0.0, 0, {v for v in side if v in fixed}
    whole = not done
    while heap:
        g, v = heapq.heappop(heap)
        if v in done or -g != gain[v]:
            continue
        if moved and not across[v]:
            continue
        done.add(v)
        moved.append(v)
        total -= g
        side[v] = now = 1 - side[v]
        if total > best + eps:
            best, prefix = total, len(moved)
        local = near[v]
        for w, c in inside[v]:
            same = side[w] == now
            is_local = w in local
            if is_local:
                across[w] += -1 if same else 1
            if w not in done:
                gain[w] += -2 * c if same else 2 * c
                if is_local or across[w]:
                    heapq.heappush(heap, (-gain[w], w))
    if b and whole and between > best + eps:
        return between, [], True
    return best, moved[:prefix], False


def kernighan_lin(edges: list[tuple], labels: dict[int, int], lifted: list[tuple] = (), rounds: int = 100, eps: float = 1e-7, tried: dict | None = None) -> dict[int, int]:
    """Improves a labelling by two-cut moves: between every pair of touching parts, joins included, and from a part to a new one.

    Rounds go on while the energy falls; pairs of parts that did not change since they were last tried are skipped.
    tried: by node, the run of such moves that left the node's part as it is; two parts of one run are not tried until one changes.
    """
    cost, near = adjacency(labels, edges, lifted)
    labels = connected_labels(edges, labels)
    both = [*edges, *lifted]
    value = cut_energy(both, labels)
    parts: dict[int, set] = {}
    for v, k in labels.items():
        parts.setdefault(k, set()).add(v)
    fresh = max(labels, default=0) + 1
    changed = set(parts)
    run_of = {k: tried[k] for k in parts if tried.get(k) is not None} if tried else {}
    best = dict(labels)
    for _ in range(rounds):
        now: set = set()
        touching = sorted({(min(labels[u], labels[v]), max(labels[u], labels[v])) for u, v, _ in edges if labels[u] != labels[v]})
        for k, m in touching:
            if not (k in changed or m in changed) or not parts.get(k) or not parts.get(m):
                continue
            if k in run_of and run_of[k] == run_of.get(m):
                continue
            gain, moved, join = two_cut(parts[k], parts[m], cost, near, eps)
            if gain <= eps:
                continue
            if join:
                for v in parts[m]:
                    labels[v] = k
                parts[k] |= parts.pop(m)
            else:
                for v in moved:
                    to = m if labels[v] == k else k
                    parts[labels[v]].discard(v)
                    parts[to].add(v)
                    labels[v] = to
            now |= {k, m}
            run_of.pop(k, None)
            run_of.pop(m, None)
        for k in sorted(k for k in parts if (k in changed or k in now) and k not in run_of):
            while len(parts[k]) > 1:
                gain, moved, _ = two_cut(parts[k], set(), cost, near, eps)
                if gain <= eps or len(moved) == len(parts[k]):
                    break
                parts[fresh] = set(moved)
                parts[k] -= parts[fresh]
                for v in moved:
                    labels[v] = fresh
                now |= {k, fresh}
                fresh += 1
        parts = {k: s for k, s in parts.items() if s}
        # moves may take a part to pieces: those become parts of their own
        split = connected_labels(edges, labels)
        pieces: dict[int, set] = {}
        for v, k in split.items():
            pieces.setdefault(k, set()).add(v)
        before = {frozenset(s): k for k, s in parts.items()}
        changed = {k for k, s in pieces.items() if before.get(frozenset(s)) in now or frozenset(s) not in before}
        labels, parts, run_of = split, pieces, {}
        energy = cut_energy(both, labels)
        if energy >= value - eps:
            break
        best, value = dict(labels), energy
    return best


def contracted(edges, labels: dict[int, int], lifted=()) -> tuple[list, list]:
    """Local and lifted edges between labels, with summed costs."""
    out = []
    for rows in (edges, lifted):
        sums: dict[tuple, float] = {}
        for u, v, c in rows:
            k = (min(labels[u], labels[v]), max(labels[u], labels[v]))
            if k[0] != k[1]:
                sums[k] = sums.get(k, 0.0) + c
        out.append([(u, v, c) for (u, v), c in sorted(sums.items())])
    return out[0], out[1]


def branch_and_bound(edges: list[tuple], lifted: list[tuple] = (), most: int = 50_000) -> dict[int, int] | None:
    """The optimum, by joining or cutting the pair with the largest cost first; None after ``most`` open problems.

    A problem is a contracted graph and its pairs that must stay cut; its bound is the cost cut so far plus all negative
    costs left, which no partition can go under. Only locally connected parts count.
    """
    nodes = sorted({a for u, v, _ in [*edges, *lifted] for a in (u, v)})
    start = kernighan_lin(edges, gaec(edges, lifted), lifted)
    start = {a: start.get(a, a) for a in nodes}
    best, value, opened = start, cut_energy([*edges, *lifted], start), 0
    stack = [({a: a for a in nodes}, frozenset())]
    while stack:
        labels, apart = stack.pop()
        opened += 1
        if opened > most:
            return None
        local, far = contracted(edges, labels, lifted)
        total: dict[tuple, float] = {}
        for u, v, c in [*local, *far]:
            total[u, v] = total.get((u, v), 0.0) + c
        if any(p not in total and p[0] == p[1] for p in apart):
            continue
        bound = sum(c if p in apart else min(0.0, c) for p, c in total.items())
        if bound >= value - 1e-9:
            continue
        open_pairs = [(abs(total[u, v]), -u, -v) for u, v, _ in local if (u, v) not in apart]
        here = cut_energy([*edges, *lifted], labels)
        if here < value - 1e-9:
            best, value = labels, here
        if not open_pairs:
            continue
        _, u, v = max(open_pairs)
        u, v = -u, -v
        joined = {a: u if k == v else k for a, k in labels.items()}
        names = lambda p: tuple(sorted(u if x == v else x for x in p))
        first, second = (joined, frozenset(map(names, apart))), (labels, apart | {(u, v)})
        ok = all(p[0] != p[1] for p in first[1])
        for x in (second, first) if total[u, v] > 0 else (first, second):
            if x is not first or ok:
                stack.append(x)
    return {a: min(b for b in nodes if best[b] == best[a]) for a in nodes}


def brute_force(edges: list[tuple], lifted: list[tuple] = (), most: int = 9) -> dict[int, int] | None:
    """The optimum over all partitions into connected parts; None where there are more than ``most`` nodes."""
    nodes = sorted({a for u, v, _ in [*edges, *lifted] for a in (u, v)})
    if len(nodes) > most:
        return None
    best = None

    def grow(i, labels, names):
        nonlocal best
        if i == len(nodes):
            if connected_labels(edges, labels) == labels:
                e = cut_energy([*edges, *lifted], labels)
                if best is None or e < best[0] - 1e-12:
                    best = (e, dict(labels))
            return
        for k in [*names, nodes[i]]:
            labels[nodes[i]] = k
            grow(i + 1, labels, names if k != nodes[i] else [*names, k])
        del labels[nodes[i]]

    grow(0, {}, [])
    return best[1]


def fuse(edges, first: dict, second: dict, lifted=()) -> dict[int, int]:
    """Contracts what neither labelling cuts, solves the rest, returns the best of the three."""
    names: dict[tuple, int] = {}
    for a in sorted(first):
        names.setdefault((first[a], second[a]), a)
    start = connected_labels(edges, {a: names[first[a], second[a]] for a in first})
    local, far = contracted(edges, start, lifted)
    solved = kernighan_lin(local, gaec(local, far), far) if local else {}
    fused = {a: solved.get(k, k) for a, k in start.items()}
    return min((fused, first, second), key=lambda x: cut_energy([*edges, *lifted], x))


def noisy_proposal(edges, lifted, r: random.Random, sigma: float) -> dict[int, int]:
    """Greedy contraction of costs with Gaussian noise of ``sigma`` times their spread."""
    spread = sigma * (sum(c * c for _, _, c in edges) / max(1, len(edges))) ** 0.5
    return gaec([(u, v, c + r.gauss(0, spread)) for u, v, c in edges], lifted)


def watershed_proposal(edges, r: random.Random, sigma: float, seed_fraction: float) -> dict[int, int]:
    """Random seeds grown over the heaviest noisy edges first: a spanning forest with one seed a tree."""
    nodes = sorted({a for u, v, _ in edges for a in (u, v)})
    label = {a: a for a in nodes}
    seeds = set(r.sample(nodes, max(1, int(seed_fraction * len(nodes)))))

    def root(a):
        while label[a] != a:
            label[a] = a = label[label[a]]
        return a

    for _, u, v in sorted((-(c + r.gauss(0, sigma)), u, v) for u, v, c in edges):
        a, b = root(u), root(v)
        if a != b and not (a in seeds and b in seeds):
            label[a if b in seeds else b] = b if b in seeds else a
    return connected_labels(edges, {a: root(a) for a in nodes})


def subgraph_proposal(edges, lifted, labels: dict, near: dict, r: random.Random, radius: int) -> dict[int, int]:
    """The labelling with a ball around a random node solved anew while the rest keeps its labels."""
    start = r.choice(sorted(labels))
    ball, rim = {start}, {start}
    for _ in range(radius):
        rim = {b for a in rim for b in near[a]} - ball
        ball |= rim
    inside = [(u, v, c) for u, v, c in edges if u in ball and v in ball]
    far = [(u, v, c) for u, v, c in lifted if u in ball and v in ball]
    if not inside:
        return labels
    own = kernighan_lin(inside, gaec(inside, far), far)
    shift = max(labels.values()) + 1
    return connected_labels(edges, {a: own[a] + shift if a in own else k for a, k in labels.items()})


@dataclass(frozen=True)
class FusionSettings:
    """Fusion moves: the kind of proposals (noise, watershed, subgraph), how many a round, when to stop, and their shape."""

    kind: str = "watershed"
    rounds: int = 10
    proposals: int = 2
    stale: int = 3
    sigma: float = 1.0
    seed_fraction: float = 0.1
    radius: int = 5
    seed: int = 42


def propose(edges, lifted, best: dict, settings: FusionSettings, turn: int, number: int) -> dict[int, int]:
    """The numbered proposal of a round: a function of the settings and the best labelling only, wherever it is made."""
    r = random.Random(f"{settings.seed} {turn} {number}")
    if settings.kind == "noise":
        return noisy_proposal(edges, lifted, r, settings.sigma)
    if settings.kind == "watershed":
        return watershed_proposal(edges, r, settings.sigma, settings.seed_fraction)
    return subgraph_proposal(edges, lifted, best, adjacency(best, edges)[1], r, settings.radius)


def fusion_moves(edges, labels: dict, lifted=(), settings: FusionSettings = FusionSettings(), extra: list[dict] = ()) -> dict[int, int]:
    """Fuses proposals with the best labelling and with one another, pair by pair, until ``stale`` rounds gain nothing.

    extra: labellings from outside that are fused first. The energy never rises.
    """
    both = [*edges, *lifted]
    best, value, stale = labels, cut_energy(both, labels), 0
    for k in range(settings.rounds):
        made = [*(extra if not k else ()), *(propose(edges, lifted, best, settings, k, i) for i in range(settings.proposals))]
        pool = [fuse(edges, best, m, lifted) for m in made]
        while len(pool) > 1:  # a tree of fusions
            pool = [fuse(edges, pool[i], pool[i + 1], lifted) if i + 1 < len(pool) else pool[i] for i in range(0, len(pool), 2)]
        energy = cut_energy(both, pool[0])
        if energy < value - 1e-9:
            best, value, stale = pool[0], energy, 0
        elif (stale := stale + 1) >= settings.stale:
            break
    return best


def boundary_moves(edges: list[tuple], labels: dict, fixed: set, lifted: list[tuple] = (), rounds: int = 20, eps: float = 1e-7) -> dict:
    """Two-cut moves between touching parts and into new parts; fixed nodes keep their labels. New labels are under 0."""
    cost, near = adjacency(labels, edges, lifted)
    labels = dict(labels)
    parts: dict[int, set] = {}
    for v, k in labels.items():
        parts.setdefault(k, set()).add(v)
    changed = set(parts)
    for _ in range(rounds):
        now: set = set()
        touching = sorted({(min(labels[u], labels[v]), max(labels[u], labels[v])) for u, v, _ in edges if labels[u] != labels[v]})
        for k, m in touching:
            if (k in changed or m in changed) and parts.get(k) and parts.get(m):
                gain, moved, join = two_cut(parts[k], parts[m], cost, near, eps, fixed)
                if gain <= eps:
                    continue
                for v in parts[m].copy() if join else moved:
                    to = k if join or labels[v] == m else m
                    parts[labels[v]].discard(v)
                    parts[to].add(v)
                    labels[v] = to
                now |= {k, m}
        for k in sorted(k for k in parts if k in changed or k in now):
            gain, moved, _ = two_cut(parts[k], set(), cost, near, eps, fixed)
            if gain > eps and len(moved) < len(parts[k]):
                new = -1 - min(moved)
                while new in parts:
                    new -= 1 << 40
                parts[new] = set(moved)
                parts[k] -= parts[new]
                labels.update(dict.fromkeys(moved, new))
                now |= {k, new}
        changed = now
        if not now:
            break
    return labels


def block_icm(edges, labels: dict, lifted=(), radius: int = 2, rounds: int = 3) -> dict[int, int]:
    """Local search: balls around one node after the other are solved anew and kept where the energy falls.

    Only edges that touch the ball are read. The ball's own solution is improved by moves between its parts and those
    around it, whose nodes stay, so the change of the energy is that of these edges.
    """
    _, near = adjacency(labels, edges)
    at: tuple[dict, dict] = ({}, {})
    for rows, by in zip((edges, lifted), at):
        for r in rows:
            for a in r[:2]:
                by.setdefault(a, []).append(r)
    best, fresh = connected_labels(edges, labels), max(labels, default=0) + 1
    for _ in range(rounds):
        gained = False
        for a in sorted(labels):
            if all(best[b] == best[a] for b in near[a]):
                continue
            ball = rim = {a}
            for _ in range(radius):
                rim = {b for x in rim for b in near[x]} - ball
                ball = ball | rim
            touching, far = (sorted({r for x in ball for r in by.get(x, ())}) for by in at)
            inside, own_far = ([r for r in rows if r[0] in ball and r[1] in ball] for rows in (touching, far))
            own = kernighan_lin(inside, gaec(inside, own_far), own_far)
            here = {x: best[x] for r in (*touching, *far) for x in r[:2]}
            both = [*touching, *far]
            value, kept = cut_energy(both, here), None
            for start in ({x: fresh + own[x] if x in own else k for x, k in here.items()}, here):
                got = boundary_moves(touching, start, here.keys() - ball, far)
                if (energy := cut_energy(both, got)) < value - 1e-9:
                    value, kept = energy, got
            if kept is not None:
                names = {k: i for i, k in enumerate({kept[x] for x in ball} - {here[x] for x in here}, fresh)}
                best.update({x: names.get(kept[x], kept[x]) for x in ball})
                fresh += len(names)
                gained = True
        if not gained:
            break
    out = connected_labels(edges, best)
    both = [*edges, *lifted]
    return min((out, connected_labels(edges, labels)), key=lambda x: cut_energy(both, x))


def optimize_lifted(edges, lifted, start: dict | None = None, tried: dict | None = None) -> dict[int, int]:
    """Greedy contraction (or a given start), two-cut moves, one round of noisy proposals, three of subgraph proposals."""
    labels = kernighan_lin(edges, start or gaec(edges, lifted), lifted, tried=tried)
    labels = fusion_moves(edges, labels, lifted, FusionSettings("noise", rounds=1, proposals=2, sigma=0.5, seed=42))
    return fusion_moves(edges, labels, lifted, FusionSettings("subgraph", rounds=3, proposals=10, radius=5, seed=43))


#: What improves a labelling of one problem's local and lifted edges; never worse than its start. ``t`` as in kernighan_lin.
IMPROVERS = {
    "kl": lambda e, f, x, t=None: kernighan_lin(e, x, f, tried=t),
    "exact": lambda e, f, x, t=None: (branch_and_bound(e, f, 2_000) if len(e) <= 60 else None) or kernighan_lin(e, x, f, tried=t),
    "fusion": lambda e, f, x, t=None: fusion_moves(e, kernighan_lin(e, x, f, tried=t), f),
    "noise": lambda e, f, x, t=None: fusion_moves(e, kernighan_lin(e, x, f, tried=t), f, FusionSettings("noise", rounds=3, sigma=0.5)),
    "subgraph": lambda e, f, x, t=None: fusion_moves(e, kernighan_lin(e, x, f, tried=t), f, FusionSettings("subgraph", rounds=3, radius=3)),
    "icm": lambda e, f, x, t=None: block_icm(e, x, f, rounds=1),
    "lifted": lambda e, f, x, t=None: optimize_lifted(e, f, x, t),
}
#: Kernels over one component's local and lifted edges: greedy contraction, and what improves it.
SOLVERS = {"gaec": gaec} | {name: lambda e, f, better=better: better(e, f, gaec(e, f)) for name, better in IMPROVERS.items()}


def attractive_components(edges: DataFrame, lifted: DataFrame | None = None) -> DataFrame:
    """(node, component) over edges whose cost is not negative; lone nodes are components of their own."""
    pairs = edges.filter("cost >= 0").select(F.col("u").alias("a"), F.col("v").alias("b"))
    if lifted is not None:
        pairs = pairs.unionByName(lifted.filter("cost >= 0").select(F.col("u").alias("a"), F.col("v").alias("b")))
    alone = edges.select(F.explode(F.array("u", "v")).alias("a")).distinct().select("a", F.col("a").alias("b"))
    return components(pairs.unionByName(alone))


#: Edges that greedy contraction takes at once; beyond that it goes by ranges of nodes.
KERNEL_EDGES = 500_000
#: Edges of a range of nodes in greedy contraction.
RANGE_EDGES = 100_000
#: Rounds of mutual best neighbours that join less than this share of the nodes give way to kernels.
FEW_JOINS = 0.05
#: Edges of a problem that the other kernels, whose work grows with the square of a part, take whole.
WHOLE_EDGES = 5_000
#: Edges of the blocks of whole parts into which they deal a larger one. A part is never divided: it may be larger.
PART_EDGES = 2_000


def _renamed(edges: DataFrame, match: DataFrame) -> DataFrame:
    """Edges between the nodes that are left after v became u for match(u, v); parallel ones are summed."""
    for side in "uv":
        edges = edges.join(match.select(F.col("v").alias(side), F.col("u").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    ends = (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return settle(edges.filter("u <> v").groupBy(*ends).agg(F.sum("cost").alias("cost")))


def contract_mutual(edges: DataFrame, lifted: DataFrame | None, most: int, rounds: int = 200) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Greedy contraction in parallel until at most ``most`` local edges or no attractive pair is left: edges, lifted, (node, label).

    A round joins every pair of nodes each of which is the other's most attractive local neighbour, lifted costs included:
    what greedy contraction does next at all these places, as long as sums of parallel edges don't overtake them. A large
    part has many neighbours and takes one a round; so when rounds join few nodes, greedy contraction ends every attractive
    component of at most RANGE_EDGES edges in a task of its own, as no join leads out of it. Rounds go on in larger ones.
    """
    names = settle(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    left, ended = names.count(), False
    for _ in range(rounds):
        if edges.count() <= most:
            break
        pull = edges if lifted is None else edges.join(lifted.withColumnRenamed("cost", "far"), ["u", "v"], "left").select("u", "v", (F.col("cost") + F.coalesce("far", F.lit(0.0))).alias("cost"))
        pull = pull.filter("cost > 0")
        both = pull.unionByName(pull.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost"))
        best = settle(both.groupBy("u").agg(F.max_by("v", F.struct("cost", (-F.col("v")).alias("v"))).alias("v")))
        match = settle(best.filter("u < v").join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi"))
        joined = match.count()
        if not joined:
            break
        if joined < FEW_JOINS * left and not ended:
            match, ended = _ended(edges, lifted), True
            joined = match.count()
            if not joined:
                continue
        left -= joined
        edges, lifted = _renamed(edges, match), None if lifted is None else _renamed(lifted, match)
        names = settle(names.join(match.select(F.col("v").alias("label"), F.col("u").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    return edges, lifted, names


def _ended(edges: DataFrame, lifted: DataFrame | None) -> DataFrame:
    """(u, v): nodes v that greedy contraction joins to u in attractive components of at most RANGE_EDGES edges."""
    blocks = settle(attractive_components(edges, lifted).select(F.col("node").alias("label"), F.col("component").alias("block")))
    inside = settle(_inside(_rows(edges, lifted), blocks.select(F.col("label").alias("node"), "label"), blocks))
    small = inside.groupBy("block").count().filter(F.col("count") <= RANGE_EDGES).select("block")
    labels = _block_labels(inside.join(small, "block", "left_semi"), lambda e, f, x, t: gaec(e, f))
    return settle(labels.filter("node <> to").select(F.col("to").alias("u"), F.col("node").alias("v")))


def _rows(edges: DataFrame, lifted: DataFrame | None) -> DataFrame:
    rows = edges.select("u", "v", F.col("cost").cast("double").alias("cost"), F.lit(True).alias("is_local"))
    if lifted is not None:
        rows = rows.unionByName(lifted.select("u", "v", F.col("cost").cast("double").alias("cost"), F.lit(False).alias("is_local")))
    return rows


def deal(rows: DataFrame, labels: DataFrame, most: int, shift: float = 0.0) -> DataFrame:
    """(label, block): whole parts in the order of their labels, a block for every ``most`` edges, offset by ``shift`` of a block.

    An edge counts for the part of its smaller end. Running sums are windows inside ranges of labels plus the sums before.
    """
    held = rows.join(labels.withColumnRenamed("node", "u"), "u").groupBy("label").agg(F.count("*").alias("n"))
    parts = settle(labels.select("label").distinct().join(held, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n")))
    low, high = parts.agg(F.min("label"), F.max("label")).first()
    width = ((high or 0) - (low or 0)) // 4096 + 1
    parts = parts.withColumn("range", F.floor((F.col("label") - F.lit(low or 0)) / width))
    sums = parts.groupBy("range").agg(F.sum("n").alias("s"))
    before = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("label"))
    return parts.join(before, "range").select("label", F.floor((running + shift * most) / most).cast("long").alias("block"))


def _inside(rows: DataFrame, labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges whose ends are in the same block, with both labels and, where labels have it, the run that made them."""
    of = labels.join(blocks, "label")
    if "run" not in of.columns:
        of = of.withColumn("run", F.lit(None).cast("long"))
    for side in "uv":
        rows = rows.join(of.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"), F.col("block").alias(f"b_{side}"), F.col("run").alias(f"r_{side}")), side)
    return rows.filter("b_u = b_v").select(F.col("b_u").alias("block"), "u", "v", "cost", "is_local", "l_u", "l_v", "r_u", "r_v")


def _named(labels: dict[int, int]) -> dict[int, int]:
    low: dict = {}
    for a in sorted(labels):
        low.setdefault(labels[a], a)
    return {a: low[k] for a, k in labels.items()}


def _block_labels(inside: DataFrame, better: Callable) -> DataFrame:
    """(node, to, block) of every block: ``better`` of its local edges, lifted edges, labels and runs; parts are named by
    smallest nodes. Blocks are few bytes and much work, so they are dealt to tasks by number and not joined by their size."""

    def run(key, t):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", "is_local", "cost", "l_u", "l_v", "r_u", "r_v"))), key=lambda r: r[:4])
        local = [(r[0], r[1], r[3]) for r in rows if r[2]]
        known = {r[i]: r[4 + i] for r in rows if r[2] for i in (0, 1)}
        runs = {r[i]: r[6 + i] for r in rows if r[2] for i in (0, 1)}
        far = [(r[0], r[1], r[3]) for r in rows if not r[2] and r[0] in known and r[1] in known]
        labels = _named(better(local, far, dict(sorted(known.items())), runs)) if local else {}
        return pa.table({"node": pa.array(list(labels), pa.int64()), "to": pa.array(list(labels.values()), pa.int64()), "block": pa.array([key[0].as_py()] * len(labels), pa.int64())})

    spark = inside.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return inside.repartition(tasks, "block").groupBy("block").applyInArrow(run, "node long, to long, block long")


def greedy(edges: DataFrame, lifted: DataFrame | None = None, most: int = KERNEL_EDGES, levels: int = 40) -> DataFrame:
    """(node, label) by greedy contraction: whole in one task up to ``most`` edges, else by ranges of nodes, level by level.

    Every range of nodes is contracted in a task, edges between what is left are summed, and ranges shifted by half a range
    follow, until one task can hold the rest or no range contracts anything. Where ids say nothing about neighbours, mutual
    best neighbours go on.
    """
    names = settle(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    idle = 0
    for k in range(levels):
        rows = _rows(edges, lifted)
        if rows.count() <= most or idle == 2:
            break
        own = settle(names.select(F.col("label").alias("node")).distinct().select("node", F.col("node").alias("label")))
        inside = _inside(rows, own, deal(rows, own, min(most, RANGE_EDGES), 0.5 * (k % 2)))
        match = settle(_block_labels(inside, lambda e, f, x, t: gaec(e, f)).filter("node <> to").select(F.col("to").alias("u"), F.col("node").alias("v")))
        if match.isEmpty():
            idle += 1
            continue
        idle = 0
        edges, lifted = _renamed(edges, match), None if lifted is None else _renamed(lifted, match)
        names = settle(names.join(match.select(F.col("v").alias("label"), F.col("u").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    if _rows(edges, lifted).count() > most:
        edges, lifted, more = contract_mutual(edges, lifted, most)
        names = settle(names.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        if edges.count() > most:  # no attractive pair is left
            return names
    one = _rows(edges, lifted).withColumns({"block": F.lit(0).cast("long"), "l_u": F.col("u"), "l_v": F.col("v"), "r_u": F.lit(None).cast("long"), "r_v": F.lit(None).cast("long")})
    top = _block_labels(one, lambda e, f, x, t: gaec(e, f)).select(F.col("node").alias("label"), "to")
    return settle(names.join(top, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def improved(edges: DataFrame, lifted: DataFrame | None, labels: DataFrame, names: tuple, most: int = PART_EDGES, rounds: int = 2) -> DataFrame:
    """(node, label) of less or equal energy: blocks of whole parts are solved anew from their labels, each in a task, by each
    of the named IMPROVERS.

    Edges between blocks are cut before and after, whatever a block does, so energies of blocks add up. Each round shifts
    the blocks by half, so that parts meet that were in different blocks. Parts that two-cut moves left together in a block
    are not tried against each other again by the round that follows.
    """
    rows = settle(_rows(edges, lifted))
    for name in names:

        def no_worse(e, f, start, runs, better=IMPROVERS[name]):
            out = better(e, f, start, runs)
            return out if cut_energy([*e, *f], out) <= cut_energy([*e, *f], start) else start

        for k in range(rounds):
            moved = settle(_block_labels(_inside(rows, labels, deal(rows, labels, most, 0.5 * (k % 2))), no_worse))
            run = F.col("block") if name == "kl" else F.lit(None).cast("long")
            labels = settle(labels.join(moved, "node", "left").select("node", F.coalesce("to", "label").alias("label"), run.alias("run")))
    return labels.select("node", "label")


def problems(edges: DataFrame, lifted: DataFrame | None = None, whole: int = WHOLE_EDGES) -> DataFrame:
    """(node, component): what kernels solve apart. Attractive components, or blocks of parts of the greedy contraction where
    there are more than ``whole`` edges."""
    rows = _rows(edges, lifted)
    if rows.count() <= whole:
        return attractive_components(edges, lifted)
    labels = greedy(edges, lifted)
    return labels.join(deal(rows, labels, PART_EDGES), "label").select("node", F.col("block").alias("component"))


def solve(edges: DataFrame, solver: str | Callable = "kl", lifted: DataFrame | None = None, most: int | None = KERNEL_EDGES) -> DataFrame:
    """node_labels(node, label) of edges(u, v, cost) and lifted edges of the same form; labels are smallest nodes.

    solver: a name in SOLVERS, or a function of local and lifted edges that returns labels by node.
    Up to WHOLE_EDGES edges every attractive component is one kernel in one task (``most`` None: any number). Beyond that
    greedy contraction takes at most ``most`` edges at once, and the other solvers improve its labels in blocks of whole
    parts. A function solves every attractive component in one task, of any number of edges.
    """
    edges = cut(edges.select("u", "v", F.col("cost").cast("double").alias("cost")))
    if lifted is not None:
        lifted = cut(lifted.select("u", "v", F.col("cost").cast("double").alias("cost")))
    top = _rows(edges, lifted).agg(F.max(F.abs("cost"))).first()[0] or 1.0
    if 0 < top < 1:  # kernels stop at fixed small gains: costs divided by the number of edges would all be under them
        scale = 2.0 ** -math.floor(math.log2(top))
        edges, lifted = (x if x is None else x.withColumn("cost", F.col("cost") * F.lit(scale)) for x in (edges, lifted))
    rows = _rows(edges, lifted)
    if most is not None and isinstance(solver, str) and rows.count() > min(most, WHOLE_EDGES):
        start = greedy(edges, lifted, most)
        if solver == "gaec":
            return start
        names = (solver,) if solver in ("kl", "icm") else ("kl", solver)  # the others are never worse than two-cut moves
        return improved(edges, lifted, start, names, min(most, PART_EDGES))
    kernel = SOLVERS[solver] if isinstance(solver, str) else solver
    comp = cut(attractive_components(edges, lifted))
    left, right = comp.select(F.col("node").alias("u"), F.col("component").alias("cu")), comp.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    inner = rows.join(left, "u").join(right, "v").filter("cu = cv").select(F.col("cu").alias("component"), "u", "v", "cost", "is_local")

    def run(key, t):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("u", "v", "cost", "is_local"))))
        local, more = [r[:3] for r in rows if r[3]], [r[:3] for r in rows if not r[3]]
        labels = kernel(local, more)
        return pa.table({"node": pa.array(list(labels), pa.int64()), "label": pa.array(list(labels.values()), pa.int64())})

    solved = inner.groupBy("component").applyInArrow(run, "node long, label long")
    return comp.join(solved, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """Labels renumbered 1, 2, ... in the order of their smallest node."""
    from .relabel import consecutive

    return consecutive(labels, "label", 1).select("node", F.col("new_label").alias("label"))


def cut_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with cut = 1 where the end labels differ."""
    both = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    return both.withColumn("cut", (F.col("lu") != F.col("lv")).cast("int")).drop("lu", "lv")


def node_labels(cut_table: DataFrame) -> DataFrame:
    """(node, label) from edges(u, v, cut): parts joined by uncut edges, named by their smallest node."""
    alone = cut_table.select(F.explode(F.array("u", "v")).alias("a")).distinct().select("a", F.col("a").alias("b"))
    uncut = cut_table.filter("cut = 0").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return components(uncut.unionByName(alone)).withColumnRenamed("component", "label")
