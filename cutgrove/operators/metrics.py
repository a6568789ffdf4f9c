"""Segmentation scores from the contingency table of two labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str = "seg", b: str = "gt") -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    """One row: total N, sums of squares and of n ln n for pairs and both margins."""
    m = F.col("n").cast("double")
    part = lambda df, k: df.agg(F.sum("n").alias(f"n_{k}"), F.sum(F.col("n") * F.col("n")).alias(f"q_{k}"), F.sum(m * F.ln(m)).alias(f"l_{k}"))
    rows = [part(table, "ab"), *(part(table.groupBy(k).agg(F.sum("n").alias("n")), k) for k in "ab")]
    one = rows[0].withColumn("k", F.lit(1))
    for r in rows[1:]:  # joins of one-row tables
        one = one.join(r.withColumn("k", F.lit(1)), "k")
    return one.drop("k")


def rand_vi(table: DataFrame) -> DataFrame:
    """agree: voxel pairs on which both labelings agree; rand; vi split H(a|b), merge H(b|a) and their sum, natural log."""
    s = _sums(table)
    n = F.col("n_ab")
    pairs = n * (n - 1) / 2
    agree = (2 * F.col("q_ab") + n * n - F.col("q_a") - F.col("q_b") - n) / 2
    split, merge = (F.col("l_b") - F.col("l_ab")) / n, (F.col("l_a") - F.col("l_ab")) / n
    return s.select(agree.cast("long").alias("agree"), F.round(agree / pairs, 9).alias("rand"), F.round(split, 6).alias("vi_split"), F.round(merge, 6).alias("vi_merge"), F.round(split + merge, 6).alias("vi"))


def adapted_rand(table: DataFrame) -> DataFrame:
    """a = seg, b = gt. gt 0 is ignored; voxels of seg 0 count as segments of one voxel. precision, recall, error."""
    t = table.filter("b <> 0")
    inner = t.filter("a <> 0")
    single = t.filter("a = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alone"), F.lit(1).alias("k"))
    both = inner.agg(F.sum(F.col("n") * F.col("n")).alias("q_ab"), F.lit(1).alias("k"))
    a = inner.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q_a"), F.lit(1).alias("k"))
    b = t.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q_b"), F.lit(1).alias("k"))
    s = both.join(a, "k").join(b, "k").join(single, "k")
    hit = (F.col("q_ab") + F.col("alone")).cast("double")
    p, r = hit / (F.col("q_a") + F.col("alone")), hit / F.col("q_b")
    return s.select(F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(1 - 2 * p * r / (p + r), 9).alias("are"))


def _entropies(table: DataFrame) -> tuple[DataFrame, dict]:
    """Sums and the entropies H(a), H(b), H(a|b), H(b|a) in nats as expressions over them."""
    s = _sums(table)
    n = F.col("n_ab")
    return s, {"a": F.ln(n) - F.col("l_a") / n, "b": F.ln(n) - F.col("l_b") / n, "a_b": (F.col("l_b") - F.col("l_ab")) / n, "b_a": (F.col("l_a") - F.col("l_ab")) / n}


def adapted_vi(table: DataFrame) -> DataFrame:
    """a = seg, b = gt: mutual information over H(seg) and over H(gt), and 1 - their harmonic mean.

    gt 0 is ignored; voxels of seg 0 count as segments of one voxel, which add nothing to the sums of n ln n.
    """
    table = table.filter("b > 0")
    m = F.col("n").cast("double")
    part = lambda df, k: df.agg(F.coalesce(F.sum(m * F.ln(m)), F.lit(0.0)).alias(f"l_{k}"), F.lit(1).alias("k"))
    by = lambda df, k: df.groupBy(k).agg(F.sum("n").alias("n"))
    some = table.filter("a <> 0")
    s = part(some, "ab").join(part(by(some, "a"), "a"), "k").join(part(by(table, "b"), "b"), "k").join(table.agg(F.sum("n").alias("n"), F.lit(1).alias("k")), "k")
    n = F.col("n")
    h_a, h_b, joint = F.ln(n) - F.col("l_a") / n, F.ln(n) - F.col("l_b") / n, F.ln(n) - F.col("l_ab") / n
    shared = h_a + h_b - joint
    return s.select(F.round(shared / h_a, 9).alias("precision"), F.round(shared / h_b, 9).alias("recall"), F.round(1 - 2 * shared / (h_a + h_b), 9).alias("error"))


def volume_scores(table: DataFrame) -> DataFrame:
    """voi_split H(seg|gt) and voi_merge H(gt|seg) in bits, and the adapted Rand error of the whole table."""
    s, h = _entropies(table)
    are = 1 - 2 * F.col("q_ab").cast("double") / (F.col("q_a") + F.col("q_b"))
    two = F.ln(F.lit(2.0))
    return s.select(F.round(h["a_b"] / two, 6).alias("voi_split"), F.round(h["b_a"] / two, 6).alias("voi_merge"), F.round(are, 9).alias("adapted_rand"))


def pair_counts(table: DataFrame) -> DataFrame:
    """Pairs of elements that both labellings join, that a joins, that b joins: by sums of squares, not by pairs."""
    s = _sums(table)
    pairs = lambda k: ((F.col(f"q_{k}") - F.col("n_ab")) / 2).cast("long")
    return s.select(pairs("ab").alias("in_both"), pairs("a").alias("in_a"), pairs("b").alias("in_b"))
