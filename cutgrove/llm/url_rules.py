"""URL filters as a sort-merge range join.

A rule (host, path) becomes the half-open interval of all keys that start with ``reversed host, tab, path``; two
intervals are disjoint or nested. Every url contributes one key per suffix of its host, as deep as the deepest rule
host. Rules and url keys are range-partitioned and swept in key order: the last rule passed carries the stack of rules
that enclose it, and the rules on that stack which still hold the key are the active ones.

Built-in functions only. Ties: of two fitting rules the longer (characters of host and path) wins, then the longer
host; of rules with one host and path but different verdicts the verdict first in the alphabet (allow before block). A null url or one without ``://`` has empty host and path, fits only a rule with an empty host, and otherwise gets
the default verdict. Repeated rows stay. An empty table gives no rows; no rules give the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts

RULE_SCHEMA = "rule_host string, rule_path string, verdict string"


def host_path(url: str = "url") -> list:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [lower.alias("host"), F.coalesce(path, F.lit("")).alias("path")]


def _key(labels, path):
    return F.concat_ws("\t", F.concat_ws(".", F.reverse(labels)), path)


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack of rules whose interval holds it, itself on top."""
    keyed = rules.select(
        _key(F.split("rule_host", r"\."), F.col("rule_path")).alias("key"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"),
            F.length("rule_host").alias("host_size"),
            F.concat("rule_host", "rule_path").alias("rule"),
            "verdict",
        ).alias("top"),
    ).groupBy("key").agg(F.min("top").alias("top"))
    own = keyed.select("key", F.explode(F.expr("transform(sequence(instr(key, '\t'), length(key)), n -> left(key, n))")).alias("prefix"))
    outer = keyed.select(F.col("key").alias("prefix"), F.struct(F.col("key"), "top").alias("held"))
    return own.join(outer, "prefix").groupBy("key").agg(F.sort_array(F.collect_list("held")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: tuple = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule (null if none fits), verdict; one row per row of ``pages``."""
    spark = pages.sparkSession
    rules = rules.select("rule_host", "rule_path", "verdict").na.drop()
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    kept = F.struct(*keep).alias("kept")
    base = pages.select(F.monotonically_increasing_id().alias("row"), kept, *host_path(url))
    labels = F.split("host", r"\.")
    keys = base.withColumn("labels", labels).select(
        "row", "kept", "host", "path",
        F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), F.size("labels"))))).alias("n"), "labels",
    ).select("row", "kept", "host", "path", _key(F.expr("slice(labels, -n, n)"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).alias("stack"))
    stacks = _stacks(rules).select(F.lit(-1).cast("long").alias("row"), F.lit(None).alias("kept"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", F.lit(0).alias("kind"), "stack")
    events = keys.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)).unionByName(stacks.withColumn("kept", F.lit(None).cast(keys.schema["kept"].dataType)))
    n = parts(spark)
    # the row number in the sort key lets a url that holds a third of all rows spread over partitions
    dealt = cut(events.repartitionByRange(n, "key", "kind", "row").withColumn("part", F.spark_partition_id()))
    last = dealt.filter("kind = 0").groupBy("part").agg(F.max(F.struct("key", "stack")).alias("last"))
    ends = spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("part")).join(F.broadcast(last), "part", "left")
    carried = ends.select("part", F.last("last.stack", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_rules = F.coalesce(F.last("stack", True).over(sweep), F.col("carried"))
    # one row per partition: the size of this broadcast is the number of partitions
    active = dealt.join(F.broadcast(carried), "part").withColumn("open", open_rules).filter("kind = 1")
    best = F.expr("element_at(filter(open, r -> startswith(key, r.key)), -1).top")
    best = F.when(F.size(F.expr("filter(open, r -> startswith(key, r.key))")) > 0, best)
    judged = active.withColumn("best", best).groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return judged.select("kept.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
