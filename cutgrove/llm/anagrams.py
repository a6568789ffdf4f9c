"""Spelling variants by anagram hashing.

The anagram key of a word is the sum of a power of its letters, so all orders of the same letters share it. A word that has
one letter more meets the other where its key less that letter's value equals the other's key; two words that differ by an
exchange meet where both keys, each less the value of the letter given up, are equal. Every word therefore posts its own
key and its key less each of its letters; equal keys are joined. Equal keys only say that the letters agree, not their
order: the letters before and after the place given up are compared by two positional hashes (polynomials modulo a prime
of 127 bits, so equal hashes mean equal letters but for a chance of about words squared over 2**127). Order and place are part of the join's keys:
anagrams of one key, of which there may be thousands, are never listed as pairs, and rows of one key spread over tasks. A
joined group holds words that differ from each other in one place only, at most one for each letter of the alphabet.

Counts cover all words of all texts. A word's form is its near word of largest count (ties: the smallest in code-point
order) if that is at least ``ratio`` times its own; forms are followed to the last. Each step multiplies the count by
``ratio``, so a chain is as long as a logarithm of the largest count and pointer doubling takes a number of rounds known
beforehand.

Null texts have no words and a null id counts as the empty text. Repeated rows count each time. Words and texts have no
greatest length. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
POWER = 5
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D_5851F42D4C957F2D_14057B7 % PRIME
#: Distinct words that a task holds before it passes its counts on, and code points of text that are split at once, about.
HELD = 1 << 20
PIECE = 1 << 20
ROWS = 1 << 16


def _pieces(text: str):
    """The text in pieces that end where a run of letters ends."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > 2 * PIECE:
            run = RUN.match(text, at + PIECE)
            stop = run.end() if run else at + PIECE
        yield text[at:stop]
        at = stop


def altered_words(doc_id: str, text: str, divisor: int) -> dict[str, int]:
    """Counts of the lower-cased runs of letters of a text; a run whose crc32 with the id is divisible loses a letter."""
    runs: dict[str, int] = {}
    for piece in _pieces(text):
        for run in RUN.findall(piece.encode("utf-8", "replace").translate(_LOWER).decode()):
            runs[run] = runs.get(run, 0) + 1
    if not divisor:
        return runs
    head, out = zlib.crc32(f"{doc_id}:".encode()), {}
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if h % divisor == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        out[run] = out.get(run, 0) + n
    return out


def word_counts(docs: DataFrame, min_len: int = 6, min_count: int = 5, divisor: int = 0, text: str = "text", doc_id: str = "doc_id", held: int = HELD) -> DataFrame:
    """(word, n) of all words of at least ``min_len`` letters and ``min_count`` occurrences, added up inside tasks first."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        counts: dict[str, int] = {}

        def out():
            words = list(counts)
            for i in range(0, len(words), ROWS):
                part = words[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                for word, n in altered_words(i.as_py(), t.as_py(), divisor).items():
                    if len(word) >= min_len:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= held:
                    yield from out()
        yield from out()

    return rows.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def anagram_key(word: str) -> int:
    return sum(ord(c) ** POWER for c in word)


def postings(word: str) -> list[tuple[int, int, int, bool]]:
    """(key, hash of the letters in order, place given up or -1, whether a removal is counted here) of a word.

    Removing any letter of a run of equal letters leaves the same word: only the first of a run counts as a removal.
    """
    n, key = len(word), anagram_key(word)
    after, h = [0] * (n + 1), 0
    for i in range(n - 1, -1, -1):
        h = (h * BASE + ord(word[i])) % PRIME
        after[i] = h
    out = [(key, after[0], -1, False)]
    before, scale = 0, 1
    for i, c in enumerate(word):
        out.append((key - ord(c) ** POWER, (before + scale * after[i + 1]) % PRIME, i, i == 0 or word[i - 1] != c))
        before = (before + scale * ord(c)) % PRIME
        scale = scale * BASE % PRIME
    return out


def posted(words: DataFrame) -> DataFrame:
    """(key, h1, h2, place, removes, id, n) of words (id, word, n): one row for a word itself and one for each of its letters."""
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, w, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for key, h, place, removes in postings(w):
                    for c, x in zip(cols, (wrap(key), wrap(h), h >> 64, place, removes, i, n)):
                        c.append(x)
                if len(cols[0]) >= ROWS:
                    yield _posted(cols)
                    cols = [[] for _ in range(7)]
            if cols[0]:
                yield _posted(cols)

    return words.select("id", "word", "n").mapInArrow(lean(run), "key long, h1 long, h2 long, place int, removes boolean, id long, n long")


def _posted(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "h1", "h2", "place", "removes", "id", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_b) in both directions for all words (id, word, n) at an edit distance of one; each pair once a direction."""
    same = ["key", "h1", "h2"]
    # all rows with the same letters in the same order, at most one of them a whole word and a few hundred with a letter given up
    rows = posted(words).groupBy(*same).agg(F.collect_list(F.struct("place", "removes", "id", "n")).alias("of")).filter(F.size("of") > 1)
    of = F.col("of")
    listed = rows.select(F.explode(of).alias("a"), "of")
    met = listed.select("a", F.explode(F.filter("of", lambda b: (b["id"] != F.col("a.id")) & (
        (b["place"] == F.col("a.place")) | ((F.col("a.place") == -1) & b["removes"]) | ((b["place"] == -1) & F.col("a.removes"))))).alias("b"))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("b.n").alias("n_b"))


def spelling_groups(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words: ratio is 2 or more")
    words = cut(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(words)
    named = pairs.hint("merge").join(words.select(F.col("id").alias("b"), "word").hint("merge"), "b")
    best = named.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("down"), F.col("word").alias("form"))).alias("best"))
    own = words.hint("merge").join(best.withColumnRenamed("a", "id").hint("merge"), "id", "left")
    is_form = -F.col("best.down") >= ratio * F.col("n")
    formed = cut(own.select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.down")).alias("form_n")))
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top = formed.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(top, 2), ratio)))
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.hint("merge").join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = formed.hint("merge").join(links.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
