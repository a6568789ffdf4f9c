"""Graphs on disk: Parquet edge tables, and binary mesh edge lists of (int32 u, int32 v, float64 p) records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = np.dtype([("u", "<i4"), ("v", "<i4"), ("p", "<f8")])


def save_graph(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """edges(u, v, p) of all files under path; a trailing partial record is an error."""
    return decode_mesh(spark.read.format("binaryFile").load(path))


def encode_mesh(edges: DataFrame) -> DataFrame:
    """(content): the rows of edges(u, v, p) as records, one piece a batch; pieces in any order make one edge list."""

    def run(batches):
        for batch in batches:
            rows = np.empty(batch.num_rows, RECORD)
            for name in RECORD.names:
                rows[name] = np.asarray(batch.column(batch.schema.get_field_index(name)))
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["content"])

    return edges.select("u", "v", "p").mapInArrow(run, "content binary")


def decode_mesh(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = np.frombuffer(raw.as_py(), RECORD)
                yield pa.RecordBatch.from_arrays([pa.array(rows["u"].astype(np.int64)), pa.array(rows["v"].astype(np.int64)), pa.array(rows["p"].copy())], names=["u", "v", "p"])

    return files.select("content").mapInArrow(run, "u long, v long, p double")


def save_arrays(arrays: dict[str, DataFrame], path: str) -> None:
    """Named tables (arrays, groups, scalars) under one folder, a table a name."""
    for name, df in arrays.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_array(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def model_costs(local: DataFrame, lifted: DataFrame) -> DataFrame:
    """(u, v, is_local, cost): two tables of cut probabilities, each turned into a logit once."""
    both = local.select("u", "v", "p", F.lit(1).alias("is_local")).unionByName(lifted.select("u", "v", "p", F.lit(0).alias("is_local")))
    return both.select("u", "v", "is_local", F.ln((1 - F.col("p")) / F.col("p")).alias("cost"))
