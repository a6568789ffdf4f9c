"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read on the driver and broadcast: its size is checked against ``max_rank_bytes``. Texts over
``piece_chars`` are cut at safe boundaries, where a non-space character meets white space: no match of the pattern
spans such a place and none looks across it. Single matches longer than ``long_match`` go through a heap-based merge
that gives the same ids in n log n steps.

Null and empty texts have no ids. Repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

MAX_RANK_BYTES = 64 << 20
PIECE_CHARS = 200_000
LONG_MATCH = 2_000


def read_ranks(path: str, max_rank_bytes: int = MAX_RANK_BYTES) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(max_rank_bytes + 1)
    if len(raw) > max_rank_bytes:
        raise ValueError(f"{path} is larger than {max_rank_bytes} bytes")
    return raw


def merge_long(piece: bytes, ranks: dict) -> list[int]:
    """Ids of one match: always merge the pair of lowest rank, leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Codec:
    def __init__(self, raw: bytes, pattern: str, piece_chars: int = PIECE_CHARS, long_match: int = LONG_MATCH):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.bpe = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.safe = regex.compile(r"(?<=\S)(?=\s)")
        self.run = regex.compile(rf"\s{{{long_match},}}")
        self.piece_chars, self.long_match = piece_chars, long_match

    def pieces(self, text: str):
        at = 0
        while len(text) - at > self.piece_chars:
            m = self.safe.search(text, at + self.piece_chars)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def has_run(self, piece: str) -> bool:
        longest = max(map(len, piece.split()), default=0)
        return longest >= self.long_match or ("  " in piece or "\n\n" in piece) and self.run.search(piece) is not None

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for piece in self.pieces(text) if len(text) > self.piece_chars else (text,):
            if len(piece) >= self.long_match and self.has_run(piece):
                for m in self.pattern.finditer(piece):
                    word = m.group()
                    if len(word) > self.long_match:
                        ids += merge_long(word.encode("utf-8"), self.ranks)
                    else:
                        ids += self.bpe.encode_ordinary(word)
            else:
                ids += self.bpe.encode_ordinary(piece)
        return np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bpe.decode_bytes(ids.tolist())


@lru_cache(maxsize=1)
def _codec(raw: bytes, pattern: str, piece_chars: int, long_match: int) -> Codec:
    return Codec(raw, pattern, piece_chars, long_match)


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple = ("doc_id",), piece_chars: int = PIECE_CHARS, long_match: int = LONG_MATCH, with_ids: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 (and the ids where asked for), a row for each row."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches):
        codec = _codec(raw.value, pattern, piece_chars, long_match)
        for batch in batches:
            n, a, b, all_ids = [], [], [], []
            for t in batch.column(len(keep)):
                ids = codec.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype("int64"))
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(lean(run), schema)
