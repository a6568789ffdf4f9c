"""Embedding near-duplicates over hierarchical navigable small-world graphs, one a shard.

Equal vectors are one class. Classes are dealt to shards of at most SHARD_ROWS by a hash of their id; each shard's task
builds a layered graph (batch insertion, diverse neighbours) and audits it, see ``Graph.audited``. Every class then
queries every shard, in chunks of CHUNK_ROWS: a best-first search with the audited beam finds the nearest nodes, and a
query whose beam holds nothing but matches goes on as a sweep over the graph, from match to neighbour, until no new match
turns up. Queries that end in one place are swept together, so a cluster of near copies costs one matrix product a visited
slice and at worst one over the shard. Every link is decided by cosine in double precision. A task folds its matches
into counts and a spanning forest block by block and never holds or returns all pairs.

The lowest recall that the audits measured is returned in ``audited_recall``; in a shard where no
sampled vector has a partner it is that of the true nearest neighbours (null where no shard has two vectors).

Null, empty and zero vectors and those with null or non-finite components link with nothing, and so do rows whose vec_id
is null (component_id null, kept true); vectors of different lengths never link; equal vectors link with each other;
repeated rows count as vectors of their own. Rows that share a vec_id but not the vector are one vertex with several
vectors: they have one component, links are counted for each vector and never among themselves. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutgrove.operators.components import components

from .common import cut

LEAST_SHARDS = 8
SHARD_ROWS = 65_536
CHUNK_ROWS = 32_768
DEGREE = 16
BUILD_BEAM = 48
BEAM = 32
#: Audited queries of the shard's own members and of other shards, the least mean recall, and the bounds of the draws.
AUDIT = 96
AUDIT_RECALL = 0.995
AUDIT_DRAWS = 8_192
FOREIGN = 2_048
LOCKSTEP = 512
SWEEP = 256
SEEN_BYTES = 64 << 20
#: Where no audited query has a partner: how many true nearest neighbours are looked for, and the least recall of those.
NEAREST, NEAREST_RECALL = 10, 0.9
#: Searches in single precision take this much less than the threshold; double precision decides.
SLACK = 1e-4
#: A vector repeated more often than this, and than in a thousandth of all rows, is joined in parts.
HOT_COPIES = 256


class Graph:
    """Layer 0 holds every vector, each layer above about 1/DEGREE of the one below; nodes are rows of x (unit length)."""

    def __init__(self, exact: np.ndarray, seed: int = 1):
        self.exact, self.x = exact, np.ascontiguousarray(exact, np.float32)
        n = len(exact)
        top = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(DEGREE)).astype(int)
        self.layers: list[np.ndarray] = []  # adjacency per layer, -1 where there is none
        self.start = int(top.argmax())
        for level in range(int(top.max()), -1, -1):
            nodes = np.flatnonzero(top >= level)
            # nodes of upper layers first: searches enter there
            self.layers.insert(0, self._layer(nodes[np.argsort(-top[nodes], kind="stable")], 2 * DEGREE if level == 0 else DEGREE))

    def _layer(self, nodes: np.ndarray, width: int) -> np.ndarray:
        """Adjacency among nodes. Lists take links until twice the width is full and are then thinned, and at the end."""
        adj, degree = np.full((len(self.x), 2 * width), -1, np.int32), np.zeros(len(self.x), np.int64)
        nodes = np.concatenate(([self.start], nodes[nodes != self.start]))
        done = 1
        while done < len(nodes):
            batch = nodes[done : done + max(1, min(LOCKSTEP, done))]
            entry = self._descend(self.x[batch], self.layers)
            ids, _ = self._beam(self.x[batch], entry, adj, BUILD_BEAM)
            peers = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(peers, -2)
            k = min(DEGREE, len(batch) - 1)
            near = batch[np.argpartition(-peers, k - 1, 1)[:, :k]] if k else np.empty((len(batch), 0), np.int64)
            early = adj[batch, : degree[batch].max()]  # links to an entry that is only now inserted
            chosen = self._choose(batch, np.concatenate([ids, near, early], 1), DEGREE)
            adj[batch] = -1
            adj[batch, :DEGREE] = chosen
            degree[batch] = (adj[batch] >= 0).sum(1)
            self._back(adj, degree, batch, width)
            done += len(batch)
        over = np.flatnonzero(degree > width)
        adj[over, :width] = self._choose(over, adj[over], width)
        return np.ascontiguousarray(adj[:, :width])

    def _back(self, adj, degree, batch, width) -> None:
        """Links back to the batch from the nodes that it chose."""
        to, frm = adj[batch, :DEGREE].ravel(), np.repeat(batch, DEGREE)
        ok = to >= 0
        to, frm = to[ok], frm[ok]
        ok = ~(adj[to] == frm[:, None]).any(1)
        to, frm = to[ok], frm[ok]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, many = np.unique(to, return_index=True, return_counts=True)
        at = np.arange(len(to)) - np.repeat(first, many)
        fits = degree[nodes] + many <= adj.shape[1]
        ok = np.repeat(fits, many)
        adj[to[ok], degree[to[ok]] + at[ok]] = frm[ok]
        degree[nodes[fits]] += many[fits]
        nodes, first, many = nodes[~fits], first[~fits], many[~fits]
        for size in range(0, int(many.max(initial=0)), width):  # a hub takes its new links in several rounds
            part = many > size
            cols = size + np.arange(width)
            extra = np.where(cols < many[part, None], frm[np.minimum(first[part, None] + cols, len(frm) - 1)], -1)
            own = nodes[part]
            chosen = self._choose(own, np.concatenate([adj[own], extra], 1), width)
            adj[own] = -1
            adj[own, :width] = chosen
            degree[own] = (chosen >= 0).sum(1)

    def _choose(self, nodes, options, width) -> np.ndarray:
        """Up to width neighbours of each node: first those nearer to it than to any chosen one, then the nearest left."""
        out = np.full((len(nodes), width), -1, np.int32)
        for lo in range(0, len(nodes), 256):
            own, opt = nodes[lo : lo + 256], options[lo : lo + 256]
            opt = np.sort(opt, 1)
            bad = (opt < 0) | (opt == own[:, None])
            bad[:, 1:] |= opt[:, 1:] == opt[:, :-1]
            v = self.x[np.where(bad, 0, opt)]
            sim = np.where(bad, -4.0, np.einsum("gcd,gd->gc", v, self.x[own], optimize=True))
            order = np.argsort(-sim, 1)
            sim, opt, v = np.take_along_axis(sim, order, 1), np.take_along_axis(opt, order, 1), np.take_along_axis(v, order[:, :, None], 1)
            among = v @ v.transpose(0, 2, 1)
            keep = np.zeros(sim.shape, bool)
            for c in range(sim.shape[1]):
                close = (np.where(keep, among[:, c, :], -4.0) > sim[:, c, None]).any(1)
                keep[:, c] = ~close & (sim[:, c] > -3) & (keep.sum(1) < width // 2)
            rank = np.argsort(np.where(sim > -3, np.where(keep, 0, 1), 2), 1, kind="stable")[:, :width]
            chosen = np.where(np.take_along_axis(sim, rank, 1) > -3, np.take_along_axis(opt, rank, 1), -1)
            out[lo : lo + 256, : chosen.shape[1]] = chosen
        return out

    def _descend(self, q, layers) -> np.ndarray:
        at = np.full(len(q), self.start)
        for adj in reversed(layers):
            at = self._beam(q, at, adj, 4)[0][:, 0]
        return at

    def _beam(self, q, entry, adj, width) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in lockstep: ids (-1 where none) and similarities, best first."""
        n = len(q)
        rows = np.arange(n)
        seen = np.zeros((n, len(self.x)), bool)
        ids, sim, open_ = np.full((n, width), -1, np.int64), np.full((n, width), -4, np.float32), np.zeros((n, width), bool)
        ids[:, 0], sim[:, 0], open_[:, 0] = entry, np.einsum("qd,qd->q", q, self.x[entry]), True
        seen[rows, entry] = True
        live = rows
        while len(live):
            best = np.where(open_[live], sim[live], -5).argmax(1)
            go = open_[live, best]
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            near = adj[ids[live, best]]
            new = near >= 0
            new &= ~seen[live[:, None], near]
            r, c = np.nonzero(new)
            nodes, own = near[r, c], live[r]
            seen[own, nodes] = True
            s = np.full(near.shape, -4, np.float32)
            s[r, c] = np.einsum("pd,pd->p", self.x[nodes], q[own])
            all_s = np.concatenate([sim[live], s], 1)
            top = np.argpartition(-all_s, width - 1, 1)[:, :width]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
            sim[live] = np.take_along_axis(all_s, top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new], 1), top, 1)
            ids[live] = np.where(sim[live] > -3, ids[live], -1)
        order = np.argsort(-sim, 1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def matches(self, q: np.ndarray, least: float, width: int):
        """Blocks of (query rows, nodes) with a cosine of at least ``least``; q holds unit vectors in double precision."""
        fine = np.ascontiguousarray(q, np.float32)
        step, width = max(8, min(LOCKSTEP, SEEN_BYTES // len(self.x))), min(width, len(self.x))
        for lo in range(0, len(q), step):
            part = fine[lo : lo + step]
            ids, sim = self._beam(part, self._descend(part, self.layers[1:]), self.layers[0], width)
            hit = (sim >= least - SLACK) & (ids >= 0)
            full = hit.all(1)
            r, c = np.nonzero(hit & ~full[:, None])
            c = ids[r, c]
            ok = np.einsum("pd,pd->p", q[lo + r], self.exact[c]) >= least
            yield lo + r[ok], c[ok]
            more = np.flatnonzero(full)
            more = more[np.argsort(ids[more, 0], kind="stable")]
            for at in range(0, len(more), SWEEP):
                rows = more[at : at + SWEEP]
                yield from self._sweep(q, lo + rows, np.unique(ids[rows]), least)

    def _sweep(self, q, rows, front, least):
        """Matches of a few queries: from the nodes in front along links for as long as a node matches any of the queries."""
        own, seen = q[rows], np.zeros(len(self.x), bool)
        seen[front] = True
        while len(front):
            live = np.zeros(len(front), bool)
            for lo in range(0, len(front), 4096):
                r, c = np.nonzero(own @ self.exact[front[lo : lo + 4096]].T >= least)
                live[lo + c] = True
                yield rows[r], front[lo + c]
            near = self.layers[0][front[live]]
            front = np.unique(near[near >= 0])
            front = front[~seen[front]]
            seen[front] = True

    def audited(self, reps: np.ndarray, foreign: np.ndarray, least: float) -> tuple[int, float | None]:
        """The beam at which sampled queries find AUDIT_RECALL of what brute force over this shard finds, and that recall.

        The queries are members in random order, until AUDIT of them have a partner or AUDIT_DRAWS are drawn, and as many
        vectors of other shards. A member's match with itself doesn't count; recall is the mean over queries, so a large
        cluster weighs no more than a pair. Either kind of query must reach the recall.
        """
        order = np.random.default_rng(2).permutation(len(reps))[:AUDIT_DRAWS]
        groups = []
        for own, vectors in ((order, self.exact[order]), (None, foreign)):
            queries, selves, wanted = [], [], []
            for lo in range(0, len(vectors), SWEEP):
                if sum(map(len, queries)) >= AUDIT:
                    break
                part = vectors[lo : lo + SWEEP]
                true = (part @ self.exact.T >= least).sum(1)
                me = np.full(len(part), -1) if own is None else own[lo : lo + SWEEP]
                true -= me >= 0
                queries.append(part[true > 0])
                selves.append(me[true > 0])
                wanted.append(true[true > 0])
            if sum(map(len, queries)):
                groups.append((np.concatenate(queries)[:AUDIT], np.concatenate(selves)[:AUDIT], np.concatenate(wanted)[:AUDIT]))
        width = BEAM
        while groups:
            recall = []
            for q, me, true in groups:
                found = np.zeros(len(q), np.int64)
                for r, c in self.matches(q, least, width):
                    found += np.bincount(r[me[r] != c], minlength=len(q))
                recall.append(float((found / true).mean()))
            if min(recall) >= AUDIT_RECALL or width >= len(reps):
                return width, min(recall)
            width *= 2
        return self._nearest_audit(order[:AUDIT], width)

    def _nearest_audit(self, own: np.ndarray, width: int) -> tuple[int, float | None]:
        """The beam and the recall of the true nearest neighbours of members, none of which has a partner over the threshold."""
        k = min(NEAREST, len(self.x) - 1)
        if k < 1:
            return width, None
        sims = self.exact[own] @ self.exact.T
        sims[np.arange(len(own)), own] = -np.inf
        bar = -np.partition(-sims, k - 1, 1)[:, k - 1]
        step = max(8, min(LOCKSTEP, SEEN_BYTES // len(self.x)))
        while True:
            hits = []
            for lo in range(0, len(own), step):
                part = self.x[own[lo : lo + step]]
                ids = self._beam(part, self._descend(part, self.layers[1:]), self.layers[0], min(max(width, k + 1), len(self.x)))[0]
                near = np.where(ids >= 0, np.take_along_axis(sims[lo : lo + step], np.maximum(ids, 0), 1), -np.inf)
                hits.append(np.minimum(k, (near >= bar[lo : lo + step, None]).sum(1)))
            recall = float(np.concatenate(hits).mean() / k)
            if recall >= NEAREST_RECALL or width >= len(self.x):
                return width, recall
            width *= 2


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # squares of the largest doubles would overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten()) for c in chunks]).reshape(-1, dim)


class Fold:
    """Counts of links per query and a spanning forest over queries and nodes, fed block by block."""

    def __init__(self, own: np.ndarray, reps: np.ndarray, copies: np.ndarray):
        self.own, self.reps, self.copies, self.n = own, reps, copies, len(reps)
        self.links, self.parent = np.zeros(len(own), np.int64), np.arange(len(reps) + len(own))
        at = np.minimum(np.searchsorted(reps, own), len(reps) - 1)
        inside = reps[at] == own
        self.parent[self.n + np.flatnonzero(inside)] = at[inside]
        self.a: list[int] = []
        self.b: list[int] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while ((up := self.parent[p]) != p).any():
            p = up
        self.parent[x] = p
        return p

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        other = self.own[r] != self.reps[c]
        r, c = r[other], c[other]
        self.links += np.bincount(r, self.copies[c], len(self.own)).astype(np.int64)
        apart = self.roots(self.n + r) != self.roots(c)
        r, c = r[apart], c[apart]
        order = np.argsort(r, kind="stable")
        r, c = r[order], c[order]
        rows, first = np.unique(r, return_index=True)
        for i, nodes in zip(rows.tolist(), np.split(c, first[1:])):
            me = int(self.roots(np.array([self.n + i]))[0])
            found, at = np.unique(self.roots(nodes), return_index=True)
            at = at[found != me]
            self.parent[found] = me
            self.a += [int(self.own[i])] * len(at)
            self.b += self.reps[nodes[at]].tolist()


def near_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall: a row for each row of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    kind = "float" if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType(), rows.schema["embedding"].dataType.containsNull) else "double"
    number = np.float32 if kind == "float" else np.float64
    # -0.0 becomes 0.0, which makes equal vectors equal as keys
    vec = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), vec).alias("v"))
    classes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.select("rep", "copies", "v", F.size("v").alias("dim")))
    n = classes.count()
    shards, chunks = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n / CHUNK_ROWS))
    asked_first = classes.orderBy(F.xxhash64("rep", F.lit(2)), "rep").select("rep", "v").limit(FOREIGN).collect()
    sample = spark.sparkContext.broadcast([(r["rep"], np.array(r["v"], number)) for r in asked_first])

    def build(key, t):
        dim = key[0].as_py()
        order = np.argsort(np.asarray(t.column("rep")), kind="stable")
        raw, reps = _matrix(t.column("v"), dim)[order], np.asarray(t.column("rep"))[order].astype(np.int64)
        g = Graph(_unit(raw))
        mine = set(reps.tolist())
        foreign = [v for r, v in sample.value if len(v) == dim and r not in mine]
        beam, recall = g.audited(reps, _unit(np.array(foreign)) if foreign else np.empty((0, dim)), least)
        layers = [a[np.flatnonzero((a >= 0).any(1))] if i else a for i, a in enumerate(g.layers)]
        held = [np.flatnonzero((a >= 0).any(1)).astype(np.int32) for a in g.layers]
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "beam": pa.array([beam], pa.int32()), "recall": pa.array([recall], pa.float64()), "start": pa.array([g.start], pa.int32()),
            "reps": pa.array([reps.tobytes()], pa.binary()), "copies": pa.array([np.asarray(t.column("copies"))[order].astype(np.int64).tobytes()], pa.binary()), "raw": pa.array([raw.astype(number).tobytes()], pa.binary()),
            "held": pa.array([[h.tobytes() for h in held]], pa.list_(pa.binary())), "layers": pa.array([[a.tobytes() for a in layers]], pa.list_(pa.binary()))})

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    graphs = cut(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, beam int, recall double, start int, reps binary, copies binary, raw binary, held array<binary>, layers array<binary>"))
    recall = graphs.agg(F.min("recall")).first()[0]

    def query(key, left, right):
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        g = left.to_pylist()[0]
        reps, copies = np.frombuffer(g["reps"], np.int64), np.frombuffer(g["copies"], np.int64)
        graph = Graph.__new__(Graph)
        graph.exact, graph.start, graph.layers = _unit(np.frombuffer(g["raw"], number).reshape(-1, g["dim"])), g["start"], []
        graph.x = graph.exact.astype(np.float32)
        for i, (h, a) in enumerate(zip(g["held"], g["layers"])):
            a = np.frombuffer(a, np.int32).reshape(-1, DEGREE if i else 2 * DEGREE)
            full = a if not i else np.full((len(reps), DEGREE), -1, np.int32)
            if i:
                full[np.frombuffer(h, np.int32)] = a
            graph.layers.append(full)
        own = np.asarray(right.column("rep")).astype(np.int64)
        fold = Fold(own, reps, copies)
        for r, c in graph.matches(_unit(_matrix(right.column("v"), g["dim"])), least, g["beam"]):
            fold.add(r, c)
        some = np.flatnonzero(fold.links)
        return pa.table({"a": pa.array(np.concatenate([fold.a, own[some]]).astype(np.int64)), "b": pa.array([*fold.b, *[None] * len(some)], pa.int64()), "links": pa.array([*[0] * len(fold.a), *fold.links[some].tolist()], pa.int64())})

    asked = classes.select("dim", "rep", "v", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sent = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    key = ("dim", "shard", "chunk")
    hits = cut(sent.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(query, "a long, b long, links long"))
    counts = hits.groupBy("a").agg(F.sum("links").alias("links"))
    comps = components(hits.filter("b is not null").select("a", "b"))  # nodes are the least vec_id of their class
    named = classes.select("rep", "copies", "v").join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("low"), "copies")
    # fewer than 1,000 classes, by the bound itself, have so many rows: their side of the join is repeated for each part
    most = max(HOT_COPIES, classes.agg(F.sum("copies")).first()[0] // 1000 if n else 0)
    hot = classes.filter(F.col("copies") > most).select("v", F.ceil(F.col("copies") / most).cast("int").alias("parts"))
    spread = F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.lit(1), F.when(F.col("copies") > most, F.col("copies") / most).otherwise(1))).cast("int") - 1))
    named = cut(named.withColumn("part", spread).drop("copies"))
    rows = rows.join(F.broadcast(hot), "v", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0)).cast("int"))
    component = F.coalesce("low", "vec_id")
    out = rows.join(named, ["v", "part"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
