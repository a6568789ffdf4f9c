"""Slices of a volume as image files: uncompressed grey TIFF and binary PGM/PPM, decoded and encoded in Arrow tasks."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: TIFF tags and the sizes of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4)}
KINDS = {1: "u", 2: "i", 3: "f"}


def encode_tiff(pages: list[np.ndarray]) -> bytes:
    """One file of grey pages (rows, columns); one strip a page, little-endian."""
    out, at = [b"II*\0"], 8
    bodies, heads = [], []
    for page in pages:
        raw = np.ascontiguousarray(page, page.dtype.newbyteorder("<"))
        kind = {"u": 1, "i": 2, "f": 3}[raw.dtype.kind]
        tags = [(WIDTH, 4, raw.shape[1]), (HEIGHT, 4, raw.shape[0]), (BITS, 3, 8 * raw.dtype.itemsize), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (STRIPS, 4, at), (SAMPLES, 3, 1), (ROWS, 4, raw.shape[0]), (COUNTS, 4, raw.nbytes), (FORMAT, 3, kind)]
        data = raw.tobytes() + b"\0" * (raw.nbytes % 2)
        bodies.append(data)
        heads.append(tags)
        at += len(data)
    out.append(struct.pack("<I", at))
    out += bodies
    for i, tags in enumerate(heads):
        at += 2 + 12 * len(tags) + 4
        out.append(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", at if i + 1 < len(heads) else 0))
    return b"".join(out)


def decode_tiff(raw: bytes) -> list[np.ndarray]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    pages = []
    while at:
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            code, size = SIZES.get(kind, ("B", 1))
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", raw, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("only uncompressed grey pages are read")
        dtype = np.dtype(f"{order}{KINDS[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
        counts = tags.get(COUNTS) or (tags[WIDTH][0] * tags[HEIGHT][0] * dtype.itemsize,)
        data = b"".join(raw[a : a + k] for a, k in zip(tags[STRIPS], counts))
        pages.append(np.frombuffer(data, dtype, tags[WIDTH][0] * tags[HEIGHT][0]).reshape(tags[HEIGHT][0], tags[WIDTH][0]))
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    return pages


def encode_pnm(pages: list[np.ndarray]) -> bytes:
    """One PGM (grey, up to 16 bits) or PPM (rows, columns, 3) image."""
    (page,) = pages
    top = 255 if page.dtype.itemsize == 1 else 65_535
    return f"P{6 if page.ndim == 3 else 5}\n{page.shape[1]} {page.shape[0]}\n{top}\n".encode() + page.astype(">u1" if top == 255 else ">u2").tobytes()


def decode_pnm(raw: bytes) -> list[np.ndarray]:
    m = re.match(rb"(P[2356])(?:\s+|#[^\n]*\n)*(\d+)(?:\s+|#[^\n]*\n)*(\d+)(?:\s+|#[^\n]*\n)*(\d+)\s", raw)
    if not m:
        raise ValueError("not a PGM or PPM file")
    kind, w, h, top = m.group(1), *map(int, m.groups()[1:])
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = int(np.prod(shape))
    if kind in (b"P2", b"P3"):
        return [np.array(raw[m.end() :].split()[:n], np.int64).reshape(shape)]
    return [np.frombuffer(raw, ">u1" if top < 256 else ">u2", n, m.end()).reshape(shape)]


CODECS = {"tiff": (encode_tiff, decode_tiff), "pnm": (encode_pnm, decode_pnm)}
SUFFIXES = {"tif": "tiff", "tiff": "tiff", "pgm": "pnm", "ppm": "pnm"}


def encode_slices(voxels: DataFrame, value: str, codec: str = "tiff", dtype: str = "<i4") -> DataFrame:
    """(z, content): one file a slice, rows y, columns x from 0."""

    def run(key, t):
        x, y = np.asarray(t.column("x")), np.asarray(t.column("y"))
        page = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype)
        page[y, x] = np.asarray(t.column("v"))
        return pa.table({"z": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([CODECS[codec][0]([page])], pa.binary())})

    return voxels.select("x", "y", "z", F.col(value).alias("v")).groupBy("z").applyInArrow(run, "z long, content binary")


def decode_slices(files: DataFrame, codec: str = "tiff") -> DataFrame:
    """(x, y, z, value) of files(z, content); the pages of one file are slices from its z on, a colour's channels one value each."""

    def run(batches):
        for batch in batches:
            for z, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, page in enumerate(CODECS[codec][1](raw.as_py())):
                    y, x, *c = np.indices(page.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int64()) for a in (x, y, np.full(x.shape, z + k), c[0] if c else np.zeros(x.shape))] + [pa.array(page.ravel().astype(np.float64))], names=["x", "y", "z", "channel", "value"])

    return files.select(F.col("z").cast("long"), "content").mapInArrow(run, "x long, y long, z long, channel long, value double")


def read_slices(spark: SparkSession, path: str, codec: str = "tiff") -> DataFrame:
    """(x, y, z, channel, value) of a file or a folder; a file's z is the last number in its name, 0 without one."""
    z = F.coalesce(F.expr("try_cast(regexp_extract(element_at(split(path, '/'), -1), '([0-9]+)[^0-9]*$', 1) AS bigint)"), F.lit(0))
    return decode_slices(spark.read.format("binaryFile").load(path).select(z.alias("z"), "content"), codec)


class _SliceWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", "tif")

    def write(self, rows):
        import os

        os.makedirs(self.folder, exist_ok=True)
        for r in rows:
            name = os.path.join(self.folder, f"slice_{r['z']:06d}.{self.suffix}")
            with open(f"{name}.tmp", "wb") as f:
                f.write(r["content"])
            os.replace(f"{name}.tmp", name)  # a repeated task writes the same file
        return WriterCommitMessage()


class SliceSink(DataSource):
    """df(z, content).write.format("slices").option("suffix", ..).save(folder): one file a row; the folder must be shared."""

    @classmethod
    def name(cls):
        return "slices"

    def writer(self, schema, overwrite):
        return _SliceWriter(self.options)


def write_slices(voxels: DataFrame, value: str, folder: str, suffix: str = "tif", dtype: str = "<i4") -> None:
    voxels.sparkSession.dataSource.register(SliceSink)
    encode_slices(voxels, value, SUFFIXES[suffix], dtype).write.format("slices").mode("append").option("suffix", suffix).save(folder)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by the path's suffix: Parquet, CSV or slices of images."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in SUFFIXES:
        return read_slices(spark, path, SUFFIXES[suffix])
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def save(df: DataFrame, path: str) -> None:
    """Parquet, CSV, or x, y, z, value as slices, by the path's suffix (a folder in each case)."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in SUFFIXES:
        write_slices(df, "value", path, suffix, "<f4" if SUFFIXES[suffix] == "tiff" else "<u2")
    elif suffix == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)
