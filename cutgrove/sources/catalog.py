"""A catalogue of data sets and cached results, both as Parquet under one folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(name: str, params: dict) -> Column:
    """md5 of the name and the parameters in order of their names; parameters are columns or plain values."""
    parts = [F.lit(name)]
    for k in sorted(params):
        v = params[k]
        parts.append(F.concat(F.lit(f"{k}="), v.cast("string") if isinstance(v, Column) else F.lit(json.dumps(v, sort_keys=True) if not isinstance(v, str) else v)))
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def cached(spark: SparkSession, folder: str, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of (name, params), built and written where there is none yet."""
    key = spark.range(1).select(cache_key(name, params)).first()[0]
    path = f"{folder}/{name}-{key}"
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Catalogue:
    """Named entries, each a flat dictionary of strings; every change is a new row, the last row of a name stands."""

    SCHEMA = "name string, version long, gone boolean, fields map<string, string>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/catalogue"

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def _put(self, name: str, fields: dict | None) -> None:
        version = self._rows().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        self.spark.createDataFrame([(name, version, fields is None, {k: str(v) for k, v in (fields or {}).items()})], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        """name, fields of every entry that stands."""
        last = self._rows().groupBy("name").agg(F.max_by(F.struct("gone", "fields"), "version").alias("last"))
        return last.filter("not last.gone").select("name", "last.fields")

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.entries().select("name").collect())

    def get(self, name: str) -> dict:
        found = self.entries().filter(F.col("name") == name).first()
        if found is None:
            raise KeyError(name)
        return dict(found["fields"])

    def add(self, name: str, **fields) -> None:
        if name in self.names():
            raise ValueError(f"{name} is there already")
        self._put(name, fields)

    def update(self, name: str, **fields) -> None:
        self._put(name, self.get(name) | fields)

    def remove(self, name: str) -> None:
        self.get(name)
        self._put(name, None)
