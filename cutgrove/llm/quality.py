"""Compression classifier: zstandard dictionaries of good and bad labelled text.

Each text is cut into blocks of ``block`` bytes; every block is compressed once with either dictionary (raw content of
labelled texts) and the difference of the summed sizes, divided by the text's bytes, becomes a score through a logistic
calibration. Only the rows of the sample are bounded: the dictionaries are filled from at most ``max_rows`` labelled texts
a class, drawn by a hash of their ids, and the calibration is fitted on at most as many other whole labelled texts. Texts
are whole in the dictionaries where those of either class fit into ``dict_bytes``; otherwise both classes give the same
bytes per text, in pieces at hash-chosen offsets over whole texts. Only label and text are inputs.

Null texts count as empty. An empty text gets the score of a zero difference. Where a class has no labelled text the
score is the share of good labels (0.5 without any). Repeated rows stay.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MAX_ROWS = 3000
DICT_BYTES = 512 << 10
BLOCK = 1 << 10
LEVEL = 3


def sample_labelled(docs: DataFrame, pairs: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple]:
    """(label, text) of at most 2 * max_rows ids a class, with whole texts.

    Ids are drawn from the labels alone, by hash; the drawn ids, of bounded number, are broadcast to fetch their texts.
    """
    drawn = [pairs.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_rows) for k in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = [(r["label"], r["text"], r["doc_id"]) for r in found.toLocalIterator()]
    return [r[:2] for r in sorted(rows, key=lambda r: (r[0], zlib.crc32(str(r[2]).encode()), r[2]))]


class Compressor:
    def __init__(self, good: bytes, bad: bytes, block: int = BLOCK, level: int = LEVEL):
        self.block = block
        self.pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=params)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def difference(self, text: str) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes; above 0 where the good one fits better."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return 0.0
        good, bad = self.pair[0].compress, self.pair[1].compress
        total = 0
        for i in range(0, len(raw), self.block):
            x = raw[i : i + self.block]
            total += len(bad(x)) - len(good(x))
        return total / len(raw)


def common_share(classes: list[list[bytes]], size: int) -> int:
    """The most bytes that every text may give (shorter ones give all) so that each class fits into ``size``."""
    lengths = [np.array([len(t) for t in texts]) for texts in classes]
    low, high = 1, max(int(n.max()) for n in lengths)
    while low < high:
        mid = (low + high + 1) // 2
        if all((np.minimum(n, mid) + (n > mid) * (mid // BLOCK) + 1).sum() <= size for n in lengths):
            low = mid
        else:
            high = mid - 1
    return low


def pieces(raw: bytes, share: int) -> list[bytes]:
    """The text if it has at most ``share`` bytes, else ``share`` bytes in pieces of about BLOCK, each at a hash-chosen offset in its stretch."""
    if len(raw) <= share:
        return [raw]
    n, h = max(1, share // BLOCK), zlib.crc32(raw)
    out = []
    for i in range(n):
        lo, hi, k = len(raw) * i // n, len(raw) * (i + 1) // n, share * (i + 1) // n - share * i // n
        at = lo + zlib.crc32(b"%d" % i, h) % max(1, hi - lo - k + 1)
        out.append(raw[at : at + k])
    return out


def _dictionary(raws: list[bytes], share: int) -> bytes:
    return b"\n".join(p for raw in raws for p in pieces(raw, share)) or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 60) -> tuple[float, float, float, float]:
    """Logistic regression on one standardised input, the classes weighed as among all labels: mean, scale, weight, bias."""
    mean, scale = float(x.mean()), float(x.std() or 1.0)
    z = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-4 * w
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-4 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return mean, scale, float(w[0]), float(w[1])


def fit(rows: list[tuple], share: float = 0.5, block: int = BLOCK, dict_bytes: int = DICT_BYTES) -> dict:
    """Even rows of a class build its dictionary, odd rows fit the calibration."""
    by = {k: [t for label, t in rows if label == k and t] for k in (0, 1)}
    if not by[0] or not by[1]:
        n = len(by[0]) + len(by[1])
        return {"constant": len(by[1]) / n if n else 0.5}
    good, bad = ([t.encode("utf-8", "replace") for t in by[k][::2]] for k in (1, 0))
    each = common_share([good, bad], dict_bytes)
    model = {"good": _dictionary(good, each), "bad": _dictionary(bad, each), "block": block}
    c = Compressor(model["good"], model["bad"], block)
    held = [(k, t) for k in (0, 1) for t in (by[k][1::2] or by[k])]
    model["line"] = logistic(np.array([c.difference(t) for _, t in held]), np.array([k for k, _ in held]), share)
    return model


@lru_cache(maxsize=1)
def _compressor(good: bytes, bad: bytes, block: int) -> Compressor:
    return Compressor(good, bad, block)


def score_text(model: dict, text: str) -> float:
    if "constant" in model:
        return model["constant"]
    mean, scale, w, b = model["line"]
    x = (_compressor(model["good"], model["bad"], model["block"]).difference(text) - mean) / scale
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w * x + b))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """Fit on labelled documents whose crc32(doc_id) mod 3 is not 1; labels join by doc_id, once for each label row."""
    pairs = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1)).distinct()
    counts = {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(sample_labelled(docs, pairs, max_rows), share)


def score_quality(docs: DataFrame, model: dict, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and score, a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("score", "double")

    def run(batches):
        for batch in batches:
            scores = [score_text(shared.value, t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs with a score of at least ``least``; the text passes through Python once."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([score_text(shared.value, t.as_py() or "") >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
