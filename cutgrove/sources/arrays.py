"""Volumes in folders of array chunks: a layer a column, a ``.npy`` file a chunk, shape and types in ``volume.json``.

Reading is a Python data source: one partition a chunk, or for every ``per_task`` chunks, the schema from the folder. Filters on x, y and z that compare with
a constant skip chunks before they are opened, where the session lets Python sources see filters
(``spark.sql.python.filterPushdown.enabled``); the options ``x``, ``y``, ``z`` ("3:" or ":10" or "3:10", half open) do so
always. Only the layers of the given schema are read. With ``counted`` every row also has ``opened``, the number of chunks
that the scan opens. Chunks are written to a name of their own and then moved, so a task
that runs again does no harm.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, EqualTo
from pyspark.sql.types import StructType

AXES = ("x", "y", "z")
META = "volume.json"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
OPENED = "opened"
#: Array types by Spark type.
KINDS = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool"}
_OPEN = (0, 1 << 62)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def _save(folder: str, name: str, data: bytes) -> None:
    store, root = _store(folder)
    part = f"{root}/{name}.{uuid4().hex}"
    store.create_dir(part.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{root}/{name}")


def _load(folder: str, name: str) -> bytes:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def _npy(a: np.ndarray) -> bytes:
    out = pa.BufferOutputStream()
    np.lib.format.write_array(out, a, allow_pickle=False)
    return out.getvalue().to_pybytes()


def save_volume(voxels: DataFrame, path: str, chunk: tuple = (64, 64, 64)) -> int:
    """Write voxels(x, y, z, columns of numbers) as chunks, missing voxels and nulls as 0; the number of chunk files."""
    layers = {f.name: KINDS[f.dataType.simpleString()] for f in voxels.schema if f.name not in AXES}
    ends = voxels.agg(*(F.max(c) for c in AXES)).first()
    shape = [0 if n is None else n + 1 for n in ends]
    _save(path, META, json.dumps({"shape": shape, "chunk": list(chunk), "layers": layers}).encode())

    def run(key, t):
        own = [k.as_py() for k in key]
        at = tuple(np.asarray(t.column(c)) - o * n for c, o, n in zip(AXES, own, chunk))
        size = tuple(min(n, s - o * n) for n, s, o in zip(chunk, shape, own))
        for name, kind in layers.items():
            a = np.zeros(size, kind)
            a[at] = np.asarray(t.column(name).fill_null(False if kind == "bool" else 0)).astype(kind)
            _save(path, f"{name}/{own[0]}.{own[1]}.{own[2]}.npy", _npy(a))
        return pa.table({"files": pa.array([len(layers)], pa.int64())})

    where = {f"__{c}": F.expr(f"{c} div {n}") for c, n in zip(AXES, chunk)}
    return voxels.withColumns(where).groupBy(*where).applyInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


@dataclass
class Chunks(InputPartition):
    at: list
    opened: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, meta: dict, schema: StructType, options: dict):
        self.path, self.meta, self.names = path, meta, schema.names
        self.ranges = {c: self._given(options.get(c, ":")) for c in AXES}
        self.per_task = int(options.get("per_task", "1"))

    @staticmethod
    def _given(text: str) -> tuple[int, int]:
        low, _, high = text.partition(":")
        return int(low or _OPEN[0]), int(high or _OPEN[1])

    def narrow(self, column: str, low: int, high: int) -> None:
        a, b = self.ranges[column]
        self.ranges[column] = max(a, low), min(b, high)

    def partitions(self):
        """The chunks that meet the ranges; one without any voxel's file is all zero."""
        at = []
        for c, n, size in zip(AXES, self.meta["shape"], self.meta["chunk"]):
            low, high = self.ranges[c]
            at.append(range(max(0, low) // size, (min(n, high) + size - 1) // size if min(n, high) > low else 0))
        every = list(product(*at))
        return [Chunks(every[i : i + self.per_task], len(every)) for i in range(0, len(every), self.per_task)] or [Chunks([], 0)]

    def read(self, partition):
        for at in partition.at:
            yield self._rows(at, partition.opened)

    def _rows(self, at: tuple, opened: int) -> pa.RecordBatch:
        start = [p * n for p, n in zip(at, self.meta["chunk"])]
        size = [min(n, s - o) for n, s, o in zip(self.meta["chunk"], self.meta["shape"], start)]
        inside = tuple(slice(max(0, self.ranges[c][0] - o), max(0, min(n, self.ranges[c][1] - o))) for c, o, n in zip(AXES, start, size))
        places = np.indices(size)
        cols = {c: (places[k][inside] + start[k]).ravel() for k, c in enumerate(AXES)}
        for name in self.names:
            if name == OPENED and name not in self.meta["layers"]:
                cols[name] = np.full(len(cols["x"]), opened)
            elif name not in AXES:
                try:
                    a = np.load(pa.BufferReader(_load(self.path, f"{name}/{'.'.join(map(str, at))}.npy")), allow_pickle=False)
                except FileNotFoundError:
                    a = np.zeros(size, self.meta["layers"][name])
                cols[name] = a[inside].ravel()
        return pa.RecordBatch.from_pydict({n: pa.array(cols[n]) for n in self.names})


class FilteredArrayReader(ArrayReader):
    """The same, where the session shows filters to Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 and f.attribute[0] in AXES and isinstance(f.value, int):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else _OPEN[0]
                high = f.value + (not isinstance(f, LessThan)) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else _OPEN[1]
                self.narrow(f.attribute[0], low, high)
            yield f  # Spark applies every filter again


class ArrayVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_volume"

    def _meta(self) -> dict:
        return json.loads(_load(self.options["path"], META))

    def schema(self) -> str:
        spark_type = {v: k for k, v in KINDS.items()}
        counted = [f"{OPENED} bigint"] if self.options.get("counted") == "true" else []
        return ", ".join([f"{c} bigint" for c in AXES] + [f"`{n}` {spark_type[k]}" for n, k in self._meta()["layers"].items()] + counted)

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteredArrayReader if self.options.get("pushdown") == "true" else ArrayReader
        return kind(self.options["path"], self._meta(), schema, self.options)


def load_volume(spark: SparkSession, path: str, per_task: int = 1, counted: bool = False, **ranges: str) -> DataFrame:
    """The voxels of a folder; ranges such as z="3:10". Small chunks go through a task ``per_task`` at a time."""
    spark.dataSource.register(ArrayVolume)
    seen = spark.conf.get(PUSHDOWN, "false").lower()
    return spark.read.format("array_volume").options(path=path, pushdown=seen, per_task=per_task, counted=counted, **ranges).load()
