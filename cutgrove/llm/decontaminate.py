"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space runs become one space. An item of m characters may differ by k = floor(rate * m)
edits. It is split into k + 1 pieces: where a document holds the item with at most k edits, at least one piece stands
there unchanged. An Aho-Corasick automaton finds exact piece hits and Myers' bit-parallel distance verifies the window
around each. Whole documents are searched.

Items are broadcast in chunks of at most ``chunk_chars`` characters (one longer item makes a chunk of its own), one pass
over the documents a chunk. With several chunks every pass is written and its broadcast given back before the next, so
neither a broadcast nor their sum grows with the benchmark.

An item of fewer than ``least_chars`` characters tells no leak from ordinary text: it is looked for without edits, its rows
are flagged ``short``, and ``drop_leaks`` lets them pass.

Null, empty or blank texts hold nothing and match nothing. Items with equal text are all reported, and those with a null
item_id as well. A document row that holds an item several times gives one row with the smallest distance and its first
place; repeated document rows are reported each. Empty tables give no rows. Other columns are not read, and kept by
``drop_leaks``.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

RATE = 0.05
CHUNK_CHARS = 2_000_000
LEAST_CHARS = 24
#: Up to so many leaking texts (16 bytes each) the rows to drop are found by a broadcast join, beyond it by a shuffled one.
BROADCAST_ROWS = 500_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 intervals of nearly equal length that cover 0..m."""
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(item: str, window: str, k: int) -> tuple[int, int]:
    """Smallest edit distance of the item to any substring of the window, if at most k (else k + 1), and where that one ends."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, k + 1, -1
    for j, c in enumerate(window):
        x = masks.get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        x = (hp << 1) & full  # a match may begin anywhere: nothing comes in at the top row
        vn = x & d0
        vp = ((hn << 1) & full) | (full & ~(x | d0))
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple], rate: float, least_chars: int = 0):
        self.items = []
        self.find = ahocorasick.Automaton()
        where: dict[str, list] = {}
        for key, text in items:
            m = len(text)
            k = min(int(rate * m), m - 1) if m >= least_chars else 0
            n = len(self.items)
            self.items.append((key, text, k))
            for a, b in pieces(m, k):
                where.setdefault(text[a:b], []).append((n, a, b - a))
        for piece, at in where.items():
            self.find.add_word(piece, at)
        self.find.make_automaton()

    def search(self, text: str) -> list[tuple]:
        """(item, distance, end, its length) for each item that the normalised text holds."""
        best: dict[int, tuple] = {}
        done: dict[int, int] = {}
        for last, at in self.find.iter(text):
            for n, a, size in at:
                key, item, k = self.items[n]
                if (b := best.get(n)) and b[0] == 0:
                    continue
                start = last + 1 - size - a
                # a hit on a diagonal whose window was just verified tells nothing new
                if (seen := done.get(n)) is not None and seen == start:
                    continue
                done[n] = start
                lo = max(0, start - k)
                d, end = myers(item, text[lo : start + len(item) + k], k)
                if d <= k and (b is None or (d, lo + end) < b):
                    best[n] = (d, lo + end)
        return [(self.items[n][0], d, end, len(self.items[n][1])) for n, (d, end) in sorted(best.items())]


@lru_cache(maxsize=1)
def _matcher(items: tuple, rate: float, least_chars: int) -> Matcher:
    return Matcher(list(items), rate, least_chars)


def _chunks(benchmark: DataFrame, chunk_chars: int):
    chunk, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if not (t := normal(r["text"])):
            continue
        if chunk and size + len(t) > chunk_chars:
            yield tuple(chunk)
            chunk, size = [], 0
        chunk.append((r["item_id"], t))
        size += len(t)
    if chunk:
        yield tuple(chunk)


def _passes(benchmark: DataFrame, chunk_chars: int):
    """(items, whether they are all)."""
    chunks = _chunks(benchmark, chunk_chars)
    first, second = next(chunks, None), next(chunks, None)
    if first is not None:
        yield first, second is None
    if second is not None:
        yield from ((items, False) for items in chain([second], chunks))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chunk_chars: int = CHUNK_CHARS, keep: tuple = ("doc_id",), text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """keep columns, item_id, distance, end_char, short: one row for each document row and item that it holds."""
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("item_id", "long").add("distance", "integer").add("end_char", "integer").add("short", "boolean")
    sc = docs.sparkSession.sparkContext
    found = []
    for items, alone in _passes(benchmark, chunk_chars):
        shared = sc.broadcast(items)

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, rate, least_chars)
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column(len(keep))):
                    for h in matcher.search(normal(t.as_py())):
                        rows.append(i)
                        hits.append(h)
                if rows:
                    taken = batch.take(pa.array(rows, pa.int64()))
                    ids, ds, ends, sizes = zip(*hits)
                    yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in range(len(keep))), pa.array(ids, pa.int64()), pa.array(ds, pa.int32()), pa.array(ends, pa.int32()), pa.array([n < least_chars for n in sizes], pa.bool_())], names=schema.names)

        found.append(source.mapInArrow(lean(run), schema))
        if not alone:
            found[-1] = cut(found[-1])
            shared.unpersist()
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chunk_chars: int = CHUNK_CHARS, least_chars: int = LEAST_CHARS, text: str = "text") -> DataFrame:
    """The document rows that hold no benchmark item of at least ``least_chars`` characters.

    A benchmark of one chunk takes one pass without a join. Otherwise leaking texts, known by two hashes of 64 bits, are
    gathered chunk by chunk and the rows that hold them go.
    """
    sc = docs.sparkSession.sparkContext
    passes = _passes(benchmark, chunk_chars)
    first = next(passes, None)
    if first is None:
        return docs
    if first[1]:
        shared, at = sc.broadcast(first[0]), docs.columns.index(text)

        def run(batches):
            matcher = _matcher(shared.value, rate, least_chars)
            for batch in batches:
                yield batch.filter(pa.array([all(h[3] < least_chars for h in matcher.search(normal(t.as_py()))) for t in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(lean(run), docs.schema)
    keyed = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})
    gone = find_leaks(keyed, benchmark, rate, chunk_chars, ("__h1", "__h2"), text, least_chars)
    gone = cut(gone.filter("not short").select("__h1", "__h2").distinct())
    return keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["__h1", "__h2"], "left_anti").select(*docs.columns)
