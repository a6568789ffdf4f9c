"""Edge probabilities, energies and weights. Positive energies attract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The clamp p' = LOW + SPAN * p.
LOW, SPAN = 0.001, 0.998


def clamp(p: Column) -> Column:
    return F.lit(SPAN) * p + F.lit(LOW)


def energy(p: Column, beta: float = 0.5) -> Column:
    """ln((1 - p) / p) + ln((1 - beta) / beta) of a clamped boundary probability."""
    q = clamp(p)
    return F.ln((1 - q) / q) + F.ln(F.lit((1 - beta) / beta))


def affinity_energy(c: Column, beta: float = 0.5) -> Column:
    q = clamp(c)
    return F.ln(q / (1 - q)) + F.ln(F.lit((1 - beta) / beta))


def weigh(edges: DataFrame, scheme: str, weight: float = 16.0, e: str = "e", length: str = "n", kind: str = "kind") -> DataFrame:
    """Energies weighed by edge length: none, z (between planes only), xyz (each kind by its own longest edge), all."""
    if scheme == "none":
        return edges
    top = {r[0]: r[1] for r in edges.groupBy(kind).agg(F.max(length)).collect()}  # one row for either kind
    if scheme == "all":
        top = dict.fromkeys(top, max(top.values(), default=1))
    if scheme == "z":
        top = {k: v for k, v in top.items() if k == 0}
    factor = F.lit(1.0)
    for k, v in top.items():
        factor = F.when(F.col(kind) == k, F.lit(weight) * F.col(length) / F.lit(float(v))).otherwise(factor)
    return edges.withColumn(e, F.col(e) * factor)


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def negative_log_ratio(p: Column, eps: float = 1 / 255) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln((1 - q) / q)


def logistic_prior(p: Column, prior: float) -> Column:
    from math import log

    return 1 / (1 + F.exp(-(logit(p)) - F.lit(log(prior / (1 - prior)))))


def finite(c: Column, instead: float = 0.0) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(instead)).otherwise(c)


def balanced(local: DataFrame, lifted: DataFrame, e: str = "e") -> DataFrame:
    """Local and lifted energies, each divided by the number of rows of its kind: (u, v, is_local, e)."""
    parts = []
    for kind, df in ((1, local), (0, lifted)):
        n = max(1, df.count())
        parts.append(df.select("u", "v", F.lit(kind).alias("is_local"), (F.col(e) / F.lit(n)).alias(e)))
    return parts[0].unionByName(parts[1])


def fused(pairs: DataFrame, votes: list[tuple[Column, float]], low: float = 0.001) -> DataFrame:
    """cost = logit of the weighted share of labellings that separate a pair; votes: (separates, weight)."""
    total = sum(w for _, w in votes)
    p = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in votes), F.lit(0.0)) / F.lit(total)
    q = F.greatest(F.lit(low), F.least(F.lit(1 - low), p))
    return pairs.withColumn("cost", F.ln((1 - q) / q))
