"""Fusion moves with proposals as rows: every proposal of a component is a task of its own, fused pair by pair in a tree.

A round makes ``proposals`` labellings of each component from the best one so far, each in its own task, where it is also
fused with the best; then pairs are fused, log2 rounds of tasks, until one is left. A proposal depends on the settings, the
round, its number and the best labelling only, so the result is that of ``multicut.fusion_moves`` in one task, and a lost
executor's proposals are made again. Components that have gained nothing for ``stale`` rounds take no further part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrove.session import settle

from . import multicut

_FIELDS = "component long, k int, node long, label long, value double"


def _table(component: int, k: int, labels: dict, value: float) -> pa.Table:
    n = len(labels)
    return pa.table({"component": pa.array([component] * n, pa.int64()), "k": pa.array([k] * n, pa.int32()), "node": pa.array(list(labels), pa.int64()), "label": pa.array(list(labels.values()), pa.int64()), "value": pa.array([value] * n, pa.float64())})


def _problem(t: pa.Table) -> tuple[list, list, dict]:
    """Local edges, lifted edges, and labellings by number, of rows that are edges (kind 1, 0) or labels (kind 2)."""
    rows = zip(*(t.column(c).to_pylist() for c in ("kind", "a", "b", "cost", "of")))
    local, lifted, labels = [], [], {}
    for kind, a, b, cost, of in rows:
        if kind == 2:
            labels.setdefault(of, {})[a] = b
        else:
            (local if kind else lifted).append((a, b, cost))
    return sorted(local), sorted(lifted), {of: dict(sorted(x.items())) for of, x in sorted(labels.items())}


def _maker(settings: multicut.FusionSettings, turn: int):
    def make(key, t):
        local, far, known = _problem(t)
        first, number = known[0], key[1].as_py()
        fused = multicut.fuse(local, first, multicut.propose(local, far, first, settings, turn, number), far)
        return _table(key[0].as_py(), number, fused, multicut.cut_energy([*local, *far], fused))

    return make


def _fused(key, t):
    local, far, known = _problem(t)
    labels = known[0] if len(known) == 1 else multicut.fuse(local, known[0], known[1], far)
    return _table(key[0].as_py(), key[1].as_py(), labels, multicut.cut_energy([*local, *far], labels))


def parallel_fusion(edges: DataFrame, settings: multicut.FusionSettings = multicut.FusionSettings(), lifted: DataFrame | None = None, start: str = "kl") -> DataFrame:
    """(node, label) of edges(u, v, cost), labels are smallest nodes of parts. Attractive components are solved whole, of any size."""
    e = settle(edges.select("u", "v", F.col("cost").cast("double").alias("cost")))
    comp = settle(multicut.attractive_components(e, lifted))
    kinds = [(e, 1)] + ([(lifted.select("u", "v", F.col("cost").cast("double").alias("cost")), 0)] if lifted is not None else [])
    rows = None
    for part, kind in kinds:
        inner = part.join(comp.select(F.col("node").alias("u"), "component"), "u").join(comp.select(F.col("node").alias("v"), F.col("component").alias("c2")), "v").filter("component = c2")
        inner = inner.select("component", F.lit(kind).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), "cost")
        rows = inner if rows is None else rows.unionByName(inner)
    rows = settle(rows)
    solver = multicut.SOLVERS[start]

    def begin(key, t):
        local, far, _ = _problem(t)
        labels = dict(sorted(solver(local, far).items()))
        return _table(key[0].as_py(), 0, labels, multicut.cut_energy([*local, *far], labels))

    best = settle(rows.withColumn("of", F.lit(0)).groupBy("component").applyInArrow(begin, _FIELDS))
    state = settle(best.groupBy("component").agg(F.max("value").alias("best"), F.lit(0).alias("stale")))
    for turn in range(settings.rounds):
        open_ones = state.filter(F.col("stale") < settings.stale).select("component")
        if open_ones.isEmpty():
            break
        here = rows.join(open_ones, "component", "left_semi")
        as_rows = lambda labels, of: labels.select("component", F.lit(2).alias("kind"), F.col("node").alias("a"), F.col("label").alias("b"), F.lit(0.0).alias("cost"), of.alias("of"), "k")
        numbers = F.explode(F.sequence(F.lit(0), F.lit(settings.proposals - 1))).alias("k")
        asked = here.select("*", F.lit(0).alias("of"), numbers)
        mine = as_rows(best.join(open_ones, "component", "left_semi").drop("k").select("*", numbers), F.lit(0))
        pool, left = asked.unionByName(mine).groupBy("component", "k").applyInArrow(_maker(settings, turn), _FIELDS), settings.proposals
        while left > 1:
            left = (left + 1) // 2
            pairs = F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("k")
            made = as_rows(pool.withColumns({"of": F.col("k") % 2, "k": F.expr("k div 2").cast("int")}), F.col("of"))
            pool = here.select("*", F.lit(0).alias("of"), pairs).unionByName(made).groupBy("component", "k").applyInArrow(_fused, _FIELDS)
        pool = settle(pool)
        new = pool.groupBy("component").agg(F.max("value").alias("value"))
        gains = F.col("value") < F.col("best") - 1e-9
        state = settle(state.join(new, "component", "left").select("component", F.when(gains, F.col("value")).otherwise(F.col("best")).alias("best"), F.when(gains, 0).when(F.col("value").isNotNull(), F.col("stale") + 1).otherwise(F.col("stale")).alias("stale"), F.coalesce(gains, F.lit(False)).alias("gained")))
        gained = state.filter("gained").select("component")
        best = settle(pool.join(gained, "component", "left_semi").unionByName(best.join(gained, "component", "left_anti")))
        state = state.drop("gained")
    named = settle(best.groupBy("component", "label").agg(F.min("node").alias("low")))
    solved = best.join(named, ["component", "label"]).select("node", F.col("low").alias("label"))
    return comp.select("node").join(solved, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
