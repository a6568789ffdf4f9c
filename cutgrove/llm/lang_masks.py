"""Language identification by bit-sliced Bloom filters over character n-grams.

The filter has a row of language bits for each position; an n-gram sets the bits of its languages in the rows of its hashes,
and the bitwise AND of those rows returns all languages that contain it at once. A text's distinct n-grams are looked up, the
bits of each language are counted, and each count is freed of the false hits that the fill of its column makes likely:
(hits - n * p) / (1 - p). The language with the largest count wins; equal counts go to the language with more learned
documents, then to the smaller name.

An n-gram counts as contained in a language if the share of the language's documents that hold it is at least ``least`` and
at least ``noise`` times the largest such share of any language, so that foreign words and wrong labels in a large
language do not mark the n-grams of the others. Shares cover all learned documents. The filter is bounded: of ``LEAST``
times 1, 2, 4, ... the first value is used whose n-grams and languages give at most MAX_BITS entries and at most MAX_BYTES
of rows; that number is limited by the distinct n-grams of an average document, not by the number of documents.

n-grams are of 1 to 4 characters of lower-cased words (letters and their marks), with one space at either end; they do not
span words. Texts are whole. The language of a null text, of one without a letter and of any text where nothing was learned
is ``und`` with score 0. The score is the share, with one added on either side, of the winner in what speaks for it or for the second
language alone; where no n-gram is known it is the share of the winner in the learned documents. Null languages are
not learned. A null id counts as the empty text. Repeated rows count and stay; other columns are ignored unless kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .words import mix

GRAMS = (1, 2, 3, 4)
LEAST = 0.002
NOISE = 0.1
MAX_BITS = 1 << 20
MAX_BYTES = 64 << 20
MAX_LANGUAGES = 4096
PROBES = 5
ROWS_PER_GRAM = 10
UNKNOWN = "und"
#: Characters of a text that are turned into n-grams at once, about: pieces end between words.
PIECE = 1 << 18
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 1 << 20
_rng = np.random.default_rng(77)
_BY_PLACE = _rng.integers(1, 1 << 63, max(GRAMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x9E6C63D0876A9A35)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """2 for letters, 1 for the marks that join them, 0 for all else, by code point."""
    kind = {"L": 2, "M": 1}
    return np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _piece(text: str) -> tuple[np.ndarray, bool]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds = _letters()[points]
    inside = kinds > 0
    if not (kinds == 2).any():
        return np.empty(0, np.uint64), False
    # one space before, between and after words
    inside = np.concatenate(([False], inside, [False]))
    points = np.where(inside, np.concatenate(([32], points, [32])), 32).astype(np.uint64)
    points = points[inside | np.concatenate(([True], inside[:-1]))]
    spaces = np.concatenate(([0], np.cumsum(points == 32)))
    out = []
    for n in GRAMS:
        k = len(points) - n + 1
        if k <= 0:
            continue
        h = np.full(k, n, np.uint64)
        for j in range(n):
            h += points[j : j + k] * _BY_PLACE[j]
        if n == 1:
            keep = points != 32
        else:
            keep = spaces[n - 1 : n - 1 + k] == spaces[1 : 1 + k]
        out.append(h[keep])
    return mix(np.unique(np.concatenate(out))), True


def grams(text: str | None) -> tuple[np.ndarray, bool]:
    """Hashes of the distinct n-grams of a text, and whether it has a letter."""
    if not text:
        return np.empty(0, np.uint64), False
    found, letter, at = [], False, 0
    while at < len(text):
        stop = len(text) if len(text) - at <= 2 * PIECE else next((i for i in range(at + PIECE, len(text)) if text[i].isspace()), len(text))
        h, has = _piece(text[at:stop])
        found.append(h)
        letter |= has
        at = stop
    return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))), letter


def learned(doc_id: Column, modulus: int = 3, held: int = 1) -> Column:
    """Whether a document may be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != held


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", held: int = HELD) -> DataFrame:
    """(h, lang, n): in how many documents of a language each n-gram occurs, added up inside tasks only."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def run(batches):
        kept: dict[str, list] = {}
        size = 0

        def fold() -> int:
            for name, parts in kept.items():
                h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                kept[name] = [(h, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]
            return sum(len(p[0][0]) for p in kept.values())

        def rows_of():
            for name, [(h, n)] in kept.items():
                for i in range(0, len(h), 65_536):
                    part = h[i : i + 65_536].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([name] * len(part)), pa.array(n[i : i + 65_536])], names=["h", "lang", "n"])
            kept.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, _ = grams(t.as_py())
                if len(h):
                    kept.setdefault(name, []).append((h, np.ones(len(h), np.int64)))
                    size += len(h)
                if size >= 4 * held:
                    size = fold()
                    if size >= held:
                        yield from rows_of()
                        size = 0
        fold()
        yield from rows_of()

    return rows.mapInArrow(lean(run), "h long, lang string, n long")


def _positions(h: np.ndarray, rows: int) -> np.ndarray:
    step = (h * _SECOND) >> np.uint64(17) | np.uint64(1)
    return (h[None, :] + step[None, :] * np.arange(PROBES, dtype=np.uint64)[:, None]) & np.uint64(rows - 1)


class Filter:
    """Rows of language bits: ``bits[row, word]``; all languages of an n-gram come from one look-up."""

    def __init__(self, names: list[str], shares: list[float], rows: int):
        self.names, self.shares, self.rows = names, shares, rows
        self.bits = np.zeros((rows, (len(names) + 63) // 64), np.uint64)
        self.wrong = np.zeros(len(names))

    def add(self, h: np.ndarray, language: np.ndarray) -> None:
        for at in _positions(h, self.rows):
            np.bitwise_or.at(self.bits, (at, language >> 6), np.uint64(1) << (language & 63).astype(np.uint64))

    def close(self) -> Filter:
        filled = [np.count_nonzero(self.bits[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) for i in range(len(self.names))]
        self.wrong = (np.array(filled) / self.rows) ** PROBES
        return self

    def masks(self, h: np.ndarray) -> np.ndarray:
        at = _positions(h, self.rows)
        out = self.bits[at[0]]
        for p in at[1:]:
            out &= self.bits[p]
        return out

    def decide(self, masks: np.ndarray) -> tuple[str, float]:
        n = len(masks)
        hits = np.array([np.count_nonzero(masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) for i in range(len(self.names))])
        counts = np.maximum(0.0, (hits - n * self.wrong) / np.maximum(1e-9, 1 - self.wrong))
        order = sorted(range(len(self.names)), key=lambda i: (-counts[i], -self.shares[i], self.names[i]))
        if counts[order[0]] <= 0:
            return self.names[order[0]], self.shares[order[0]]
        if len(order) == 1:
            return self.names[0], float(min(1.0, (counts[0] + 1) / (n + 1)))
        first, second = order[:2]
        has = [masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1) == 1 for i in (first, second)]
        both = np.count_nonzero(has[0] & has[1])
        only, other = max(0.0, counts[first] - both), max(0.0, counts[second] - both)
        return self.names[first], float((only + 1) / (only + other + 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", least: float = LEAST, noise: float = NOISE) -> Filter | None:
    """The filter of all given documents with a language; None where there is none.

    The driver holds the names of the languages (at most MAX_LANGUAGES) and at most MAX_BITS n-grams.
    """
    sizes = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    sizes = sorted((r["lang"], r["count"]) for r in sizes)
    names, total = [name for name, _ in sizes], sum(n for _, n in sizes)
    known = docs.sparkSession.createDataFrame([(name, i, n) for i, (name, n) in enumerate(sizes)], "lang string, i int, docs long")
    # all languages of an n-gram meet in one task: rows were added up inside tasks, and one n-gram has one row a task and language
    counted = gram_counts(docs, text, lang).repartition("h").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    shares = counted.join(F.broadcast(known), "lang").select("h", "i", (F.col("n") / F.col("docs")).alias("share")).filter(F.col("share") >= least)
    held = shares.groupBy("h").agg(F.collect_list(F.struct("i", "share")).alias("of"), F.max("share").alias("top"))
    pairs = cut(held.select("h", F.explode(F.filter("of", lambda x: x["share"] >= noise * F.col("top"))).alias("x")).select("h", "x.i", "x.share"))
    level = F.floor(F.log2(F.col("share") / least)).cast("int")
    steps: dict[tuple[int, int], int] = {(r["i"], r["level"]): r["count"] for r in pairs.groupBy("i", level.alias("level")).count().collect()}
    for step in range(64):
        each = [sum(n for (i, at), n in steps.items() if i == j and at >= step) for j in range(len(names))]
        rows = 1 << max(10, (max(each) * ROWS_PER_GRAM - 1).bit_length()) if max(each) else 1 << 10
        if sum(each) <= MAX_BITS and rows * 8 * ((len(names) + 63) // 64) <= MAX_BYTES:
            break
    made = Filter(names, [n / total for _, n in sizes], rows)
    chosen = pairs.filter(level >= step).select("h", "i").toArrow()
    made.add(chosen.column(0).to_numpy().view(np.uint64), chosen.column(1).to_numpy().astype(np.int64))
    return made.close()


def identify(docs: DataFrame, model: Filter | None, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, lang_pred and score, a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(len(keep)):
                h, letter = grams(t.as_py()) if shared.value else (None, False)
                out.append(shared.value.decide(shared.value.masks(h)) if letter else (UNKNOWN, 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=schema.names)

    return source.mapInArrow(lean(run), schema)
