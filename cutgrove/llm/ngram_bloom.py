"""Language-model scores from a log-frequency Bloom filter.

Training documents (crc32 of doc_id as text, mod 7, not 2) give counts of words, word pairs and word triples. A count is
quantised down to 1, 2, 3, 4, 6, 8, 12, 16, ... and stored by entering the n-gram once for every level up to its own; a
reader probes level 1, 2, ... until one is absent. A text's probability is the product over its tokens of

    p(w | u v) = (c(u v w) + M3 p(w | v)) / (c(u v) + M3),    p(w | v) = (c(v w) + M2 p(w)) / (c(v) + M2),
    p(w) = (c(w) + 1) / (N + V + 1)

with all counts read from the filter and no count above that of its context; a text's first token has no triple.

1. Documents are packed into groups of at most GROUP_BYTES of text, written compressed, with the levels that each group's
   training documents alone would enter into the filter. Levels of a sum of counts are no more than the sum of their levels,
   so the sum over groups bounds the whole filter before it is built (see ``filter_bound``). A group's distinct words and
   n-grams go to shards (ranges of hashes), one packed row a shard, with how often the group's training documents hold them. A word
   or n-gram that fills a third of the corpus is one entry a group.
2. A shard holds about SHARD_BYTES of text. Its task adds the counts up, builds its part of the filter, and answers every
   group with the exact counts of its words, for the base score.
3. If that bound is at most BROADCAST_BYTES, the filter is broadcast. Beyond that no broadcast can keep up with the corpus: a
   shard's task probes its part with every group's words and n-grams, and the
   levels go back with the answers. Both ways read the same bits and give the same scores.
4. A group's task has its texts and all answers and scores its documents: one pass over the texts whatever the size.

Everything that is written or shuffled grows with the text; rows grow with groups times shards, of which either grows with
the text: the product is 12 million rows at 30 GB of text and 8 billion at 1 TB. Groups and shards must grow beyond that.

Null and empty texts are one end token. A null id is a training id. Repeated rows are scored each. Other columns are not
read. An empty table gives no rows; without training rows every count is 0 and p(w) = 1.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small_batches
from .words import hash_texts, mix

GROUP_BYTES = 8 << 20
GROUP_ROWS = 60_000
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 64
BROADCAST_BYTES = 64 << 20
BITS = 12
PROBES = 5
#: Pseudo-counts of the lower model in the pair and in the triple model.
M2, M3 = 20.0, 2.0
#: Counts that levels stand for: powers of two and halfway between.
VALUES = np.array(sorted({1, *(2**k for k in range(1, 40)), *(3 * 2**k for k in range(40))}), np.int64)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR, _TRIPLE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_U32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_END_ROW = np.array([END])


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def flat_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, an end after each text, and where each text begins."""
    words = hash_texts(texts)
    parts = [x for w in words for x in (w, _END_ROW)]
    return np.concatenate(parts), np.cumsum([0] + [len(w) + 1 for w in words[:-1]])


def before(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each one, START at the texts' first tokens."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[starts] = START
    return out


def ngrams(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the pair and of the triple that end at each token, and a mask of the tokens that have a triple."""
    one = before(tokens, starts)
    two = before(one, starts)
    has = np.ones(len(tokens), bool)
    has[starts] = False
    pair = one * _PAIR + tokens
    return mix(pair), mix((two * _PAIR + one) * _TRIPLE + tokens), has


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U32) * np.uint64(shards)) >> _U32


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(VALUES, counts, "right")


def _place(key: np.ndarray, level: int, size: np.ndarray | int):
    """Word of the filter and bit mask for each key (32 bits) at a level; all PROBES bits lie in one 64-bit word."""
    x = mix((key & _LOW) + np.uint64(level * int(_LEVEL) % (1 << 64)))
    at = ((x >> _U32) * np.asarray(size, np.uint64)) >> _U32
    mask = np.zeros(len(key), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return at, mask


def build(key: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Filter words for distinct keys with counts over 0."""
    level = levels(counts)
    out = np.zeros(max(1, int(level.sum()) * bits // 64 + 1), np.uint64)
    for k in range(1, int(level.max(initial=0)) + 1):
        at, mask = _place(key[level >= k], k, len(out))
        np.bitwise_or.at(out, at, mask)
    return out


class Filter:
    """Filter parts of all shards in one array, or of one shard."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes.astype(np.uint64)
        self.offsets = (np.cumsum(sizes) - sizes).astype(np.uint64)

    def levels(self, h: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
        """The last level of each hash's key before one is absent."""
        shard = shard_of(h, len(self.sizes)) if shard is None else shard
        out = np.zeros(len(h), np.uint8)
        left, level = np.flatnonzero(self.sizes[shard] > 0), 1
        while len(left) and level <= len(VALUES):
            x = shard[left]
            at, mask = _place(h[left], level, self.sizes[x])
            left = left[(self.words[self.offsets[x] + at] & mask) == mask]
            out[left] = level
            level += 1
        return out


_COUNT = np.concatenate(([0], VALUES)).astype(np.float64)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw)


def _unpack(raw: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<i8", len(types), 8)
    at, out = 8 * (len(types) + 1), []
    for n, kind in zip(sizes, types):
        out.append(np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def _short(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes; those from 255 on follow apart."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.uint32)


def _long(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _distinct(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sum of their weights. h: not empty."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(weight[order].astype(np.int64), first)


def _located(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and where each of h stands among them. h: not empty."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def _key(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32-bit key in one number."""
    return (shard_of(h, shards) << _U32) | (h & _LOW)


def _keys(h: np.ndarray, train: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of 32 bits by shard, how often they are marked, and where each shard begins. h: not empty."""
    ranked = np.sort((_key(h, shards) << np.uint64(1)) | train.astype(np.uint64))  # shards are far under 2^31
    u = ranked >> np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    c = np.add.reduceat((ranked & np.uint64(1)).astype(np.int64), first)
    u = u[first]
    return (u & _LOW).astype(np.uint32), c, np.searchsorted(u, np.arange(shards + 1, dtype=np.uint64) << _U32)


def _thin(keys: np.ndarray) -> bytes:
    """Sorted integers as compressed planes of the bytes of their differences."""
    step = np.diff(keys, prepend=keys.dtype.type(0))
    planes = step.view(np.uint8).reshape(-1, keys.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _thick(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def _small(counts: np.ndarray) -> bytes:
    small, large = _short(counts)
    return zstandard.ZstdCompressor(level=1).compress(small.tobytes() + large.tobytes())


def _large(raw: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return _long(np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, np.uint32, (len(raw) - n) // 4, n))


def _groups(batches):
    """(ids, texts) of at most GROUP_ROWS rows and about GROUP_BYTES of text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= GROUP_BYTES or len(ids) >= GROUP_ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


NAMES = ["shard", "gid", "data"]


def entries(ids: list, texts: list[str]) -> int:
    """How many levels of words, pairs and triples the training texts among these enter into a filter of their own."""
    tokens, starts = flat_tokens(texts)
    pair, triple, has = ngrams(tokens, starts)
    train = np.repeat([not held_out(i) for i in ids], np.diff(np.append(starts, len(tokens))))
    return sum(int(levels(np.unique(h, return_counts=True)[1]).sum()) for h in (tokens[train], pair[train], triple[has & train]))


def _packed(docs: DataFrame) -> DataFrame:
    """(gid, data, size, entries): ids and compressed texts of every group, their bytes and their ``entries``."""

    def run(batches):
        part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        for n, (ids, texts) in enumerate(_groups(batches)):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            known = np.array([i is not None for i in ids])
            lengths = np.array(list(map(len, raw)), np.int64)
            data = _pack(np.array([i or 0 for i in ids], np.int64), known, lengths, _bytes(pack.compress(b"".join(raw))))
            columns = [pa.array([part * (1 << 24) + n], pa.int64()), pa.array([data], pa.binary()), pa.array([lengths.sum()], pa.int64()), pa.array([entries(ids, texts)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*NAMES[1:], "size", "entries"])

    return docs.mapInArrow(lean(run), "gid long, data binary, size long, entries long")


def _texts(data: bytes) -> tuple[list, list[str]]:
    ids, known, lengths, raw = _unpack(data, np.int64, np.bool_, np.int64, np.uint8)
    raw, ends = zstandard.ZstdDecompressor().decompress(raw.tobytes(), int(lengths.sum()) or 1), np.cumsum(lengths)
    texts = [raw[e - k : e].decode("utf-8", "surrogatepass") for e, k in zip(ends.tolist(), lengths.tolist())]
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], texts


def _gather(packed: DataFrame, shards: int) -> DataFrame:
    """(shard, gid, data): words and n-grams of every group for every shard."""

    def run(batches):
        for batch in batches:
            for gid, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, texts = _texts(data.as_py())
                tokens, starts = flat_tokens(texts)
                pair, triple, has = ngrams(tokens, starts)
                train = np.repeat([not held_out(i) for i in ids], np.diff(np.append(starts, len(tokens))))
                words, counts = _distinct(tokens, train)
                edges = np.searchsorted(shard_of(words, shards), np.arange(shards + 1))
                keys, grams, at = _keys(np.concatenate([pair, triple[has]]), np.concatenate([train, train[has]]), shards)
                rows = []
                for s in range(shards):
                    a, b, c, d = edges[s], edges[s + 1], at[s], at[s + 1]
                    rows.append(_pack(*(_bytes(x) for x in (_thin(words[a:b]), _small(counts[a:b]), _thin(keys[c:d]), _small(grams[c:d])))))
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([gid] * shards, pa.int64()), pa.array(rows, pa.binary())], names=NAMES)

    return packed.mapInArrow(lean(run), "shard int, gid long, data binary")


def _read(data: bytes):
    """A group's words and n-gram keys in one shard, each with counts."""
    words, counts, keys, grams = (x.tobytes() for x in _unpack(data, *[np.uint8] * 4))
    words, keys = _thick(words, np.uint64), _thick(keys, np.uint32)
    return words, _large(counts, len(words)), keys, _large(grams, len(keys))


def _counter(bits: int, probe: bool):
    """One shard: its tokens and distinct words (gid -1), and for every group the counts of its words.

    With ``probe`` the levels of the group's words and n-grams come with the counts; without it the filter part under gid -1.
    """

    def count(key, rows):
        gids, read = rows.column("gid").to_pylist(), [_read(b.as_py()) for b in rows.column("data")]
        words, counts = _total([r[0] for r in read], [r[1] for r in read])
        grams, gram_counts = _total([r[2] for r in read], [r[3] for r in read])
        seen, some = counts > 0, gram_counts > 0
        # words and n-grams share a part; words are told apart by their own constant
        keys = np.concatenate([word_key(words[seen]), grams[some].astype(np.uint64)])
        part = build(keys, np.concatenate([counts[seen], gram_counts[some]]), bits) if len(keys) else np.empty(0, np.uint64)
        one, out, pack = Filter(part, np.array([len(part)])), [b"" if probe else part.tobytes()], zstandard.ZstdCompressor(level=1)
        for own, _, own_keys, _ in read:
            level = b""
            if probe:
                asked = np.concatenate([word_key(own), own_keys.astype(np.uint64)])
                level = pack.compress(one.levels(asked, np.zeros(len(asked), np.int64)).tobytes())
            out.append(_pack(_bytes(_small(counts[np.searchsorted(words, own)])), _bytes(level)))
        extra = [0] * len(gids)
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([-1, *gids], pa.int64()), pa.array(out, pa.binary()), pa.array([int(counts.sum()), *extra], pa.int64()), pa.array([int(seen.sum()), *extra], pa.int64())], names=[*NAMES, "tokens", "distinct"])

    return count


def _total(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    return _distinct(keys, counts) if len(keys) else (keys, counts.astype(np.int64))


def word_key(h: np.ndarray) -> np.ndarray:
    return mix(h + _TRIPLE) & _LOW


def score_tokens(own, pairs, triples, ends, starts, has, train_tokens: int, vocabulary: int) -> np.ndarray:
    """log10 probability of each text from the quantised counts of its tokens, pairs, triples (where it has them) and of ends."""
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[starts] = ends  # as many texts begin as end
    above = np.zeros_like(own)  # the count of the pair before the token
    above[1:] = pairs[:-1]
    above = above[has]
    p = (own + 1) / (train_tokens + vocabulary + 1)
    p = (np.minimum(pairs, context) + M2 * p) / (context + M2)
    p[has] = (np.minimum(triples, above) + M3 * p[has]) / (above + M3)
    return np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)


def _scorer(shards: int, n: int, v: int, shared):
    """Scores one group from its texts, the answers on its words and, without a broadcast filter, their levels."""

    def run(key, rows):
        answers: dict[int, bytes] = dict(zip(rows.column("shard").to_pylist(), rows.column("data").to_pylist()))
        ids, texts = _texts(answers.pop(-1))
        tokens, starts = flat_tokens(texts)
        pair, triple, has = ngrams(tokens, starts)
        words, at = _located(tokens)
        cuts = np.searchsorted(shard_of(words, shards), np.arange(shards + 1))
        many = np.diff(cuts)
        got = [[x.tobytes() for x in _unpack(answers[s], np.uint8, np.uint8)] for s in range(shards)]
        exact = np.concatenate([_large(c, k) for (c, _), k in zip(got, many.tolist())])[at]
        sizes = np.diff(np.append(starts, len(tokens)))
        base = np.add.reduceat(np.log10(exact + 1.0), starts) - sizes * math.log10(n + v + 1)
        if shared is not None:
            whole = Filter(*shared.value)
            own = whole.levels(word_key(words), shard_of(words, shards))
            pairs, triples = whole.levels(pair), whole.levels(triple[has])
        else:
            _, place = _located(_key(np.concatenate([pair, triple[has]]), shards))
            level = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for _, x in got]
            own = np.concatenate([x[:k] for x, k in zip(level, many)])
            grams = np.concatenate([x[k:] for x, k in zip(level, many)])[place]
            pairs, triples = grams[: len(pair)], grams[len(pair) :]
        ends = _COUNT[own[np.searchsorted(words, END)]]  # every text has an end
        score = score_tokens(_COUNT[own[at]], _COUNT[pairs], _COUNT[triples], ends, starts, has, n, v)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": [held_out(i) for i in ids], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(np.add.reduceat((exact > 0).astype(np.int64), starts)), "base_score": base, "score": score})

    return run


def filter_bound(entered: int, shards: int, bits: int = BITS) -> int:
    """The most bytes that the filter takes: ``entered`` is the sum of the groups' ``entries``; a part is rounded up to a word."""
    return entered * bits // 8 + 8 * shards


def score_documents(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of docs."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        packed = cut(_packed(docs))
    size, entered = (x or 0 for x in packed.agg(F.sum("size"), F.sum("entries")).first())
    shards = max(LEAST_SHARDS, math.ceil(size / shard_bytes))
    small = filter_bound(entered, shards, bits) <= broadcast_bytes
    counted = cut(_gather(packed.select("gid", "data"), shards).groupBy("shard").applyInArrow(_counter(bits, not small), "shard int, gid long, data binary, tokens long, distinct long"))
    parts = counted.filter("gid = -1")
    n, v = (x or 0 for x in parts.agg(F.sum("tokens"), F.sum("distinct")).first())
    shared = None
    if small:
        found = dict((r["shard"], np.frombuffer(bytes(r["data"]), np.uint64)) for r in parts.select("shard", "data").toLocalIterator())
        whole = [found.get(s, np.empty(0, np.uint64)) for s in range(shards)]
        shared = sc.broadcast((np.concatenate(whole), np.array(list(map(len, whole)))))
    answers = packed.select("gid", F.lit(-1).alias("shard"), "data").unionByName(counted.filter("gid >= 0").select("gid", "shard", "data"))
    scored = answers.groupBy("gid").applyInArrow(_scorer(shards, n, v, shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
