"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass hashes every text to its set of word shingles: a 64-bit class id of the set, and COORDINATES min-hashes.
   Documents with one set are one class from here on, however many they are.
2. Classes are posted under each (coordinate, value) pair and postings counted. A value that one class holds can
   collide with nothing: a class with fewer than ``least`` shared values has no partner at the match threshold and goes.
3. Prefix: two classes that agree in ``least`` coordinates share one of the first size - least + 1 values of either,
   rarest first. Classes joined through prefix values form families, whose posting lists one task can hold.
4. Merging: a family's task inverts its signatures to posting lists. Members are taken in turn as pivots; the pivot's
   shortest lists, its prefix, are merged and give the candidates, whose collisions are then counted in the longer lists
   by look-up, skipping candidates that can't reach ``least`` any more. Pairs at or above ``least`` are confirmed on full
   shingle sets. Members of one component need no further links among each other.
5. Families over ``block`` members are dealt to blocks by hash, each with a few leaders of the family, so near copies meet
   in one component after one linear pass. Only members outside the family's largest component are then held against all
   other blocks. No pair of members in different components is left out. Where most of a family stays unlinked (texts
   that share much but less than the threshold), this second pass moves members times family size / block sets.
6. Links of distinct classes join into components.

``least`` is set so that a pair at the similarity threshold is missed with a probability of about 1e-6.

Null, empty and blank texts have no shingles and link with nothing; a text of fewer words than a shingle is one
shingle; repeated rows are linked to each other; an empty table gives no rows. Rows are told apart by id and text: rows of
one id with different texts are rows of their own. A row with a null id is linked like any other; its component_id is
the smallest id that can be reached, null where none is, and kept compares the two (null equals null).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutgrove.operators.components import components

from .common import cut, lean, small_batches
from .words import hash_texts, shingles

COORDINATES = 48
#: Members of a family that one task holds, and leaders that every block of a larger family gets. They change the plan, not the result.
BLOCK = 512
LEADERS = 4
#: Up to so many candidate classes (at most 60 bytes each) the text lookup is a broadcast join, beyond it a shuffled one.
BROADCAST_ROWS = 200_000
_rng = np.random.default_rng(42)
_XOR = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GROUP = 64


def least_matches(percent: int, k: int = COORDINATES, miss: float = 1e-6) -> int:
    """The largest count that Binomial(k, percent/100) falls short of with probability under ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        if below + (mass := math.comb(k, t) * p**t * (1 - p) ** (k - t)) > miss:
            return t
        below += mass
    return k


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 min-hashes, a row for each non-empty set."""
    flat, at = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at) >> np.uint64(32)
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def hashed(docs: DataFrame, keep: tuple, text: str = "text") -> DataFrame:
    """keep columns, n_shingles, node (null without shingles), sig."""
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("n_shingles", "long").add("node", "long").add("sig", T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                sets = [shingles(h) for h in hash_texts([t or "" for t in part.column(len(keep)).to_pylist()])]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full).view(np.int32)) if full else iter(())
                sigs = [next(rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=schema.names)

    return source.mapInArrow(lean(run), schema)


class Postings:
    """Posting lists of a family's signatures: the members that hold a value in a coordinate."""

    def __init__(self, sigs: np.ndarray):
        self.sigs = sigs
        key = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32) | sigs
        _, self.ids, size = np.unique(key, return_inverse=True, return_counts=True)
        self.ids = self.ids.reshape(sigs.shape)
        self.members = np.argsort(self.ids.ravel(), kind="stable") // COORDINATES
        self.start = np.concatenate(([0], np.cumsum(size)))

    def collisions(self, p: int, wanted: np.ndarray, least: int) -> np.ndarray:
        """The wanted members (a mask) that agree with member p in at least ``least`` coordinates."""
        own = self.ids[p]
        size = self.start[own + 1] - self.start[own]
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 1]
        if len(order) < least:
            return np.empty(0, np.int64)
        short, long = order[: len(order) - least + 1], order[len(order) - least + 1 :]
        count = np.bincount(np.concatenate([self.members[self.start[i] : self.start[i + 1]] for i in own[short]]), minlength=len(self.sigs))
        found = np.flatnonzero((count > 0) & wanted)
        count = count[found]
        for lo in range(0, len(long), 8):  # eight lists at a time, shortest first
            ks = long[lo : lo + 8]
            count = count + (self.sigs[found[:, None], ks] == self.sigs[p, ks]).sum(1)
            able = count + len(long) - lo - len(ks) >= least
            found, count = found[able], count[able]
        return found[count >= least]


def link_members(nodes, sets, sigs, side, comp, least: int, percent: int) -> list[tuple[int, int]]:
    """Links that span the components among members.

    side: only pairs of different sides count, None where all do; comp: what is known to be linked already has one label.
    """
    n, posted = len(nodes), Postings(sigs)
    size = np.diff(posted.start)
    first = np.searchsorted(posted.ids.min(0), np.arange(len(size)), "right") - 1  # the coordinate of each list
    best = np.zeros(COORDINATES, np.int64)
    np.maximum.at(best, first, size)
    order = np.argsort(-(size[posted.ids] == best).sum(1), kind="stable")  # pivots: closest to the commonest values first
    sizes = np.array([len(s) for s in sets])
    comp, done, links = np.unique(comp, return_inverse=True)[1].copy(), np.zeros(n, bool), []
    for p in order:
        done[p] = True
        wanted = (comp != comp[p]) & ~done
        if side is not None:
            wanted &= side != side[p]
        wanted &= 100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p])
        if not wanted.any() or not len(at := posted.collisions(p, wanted, least)):
            continue
        flat, own = np.concatenate([sets[i] for i in at]), sets[p]
        pos = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[pos] == flat).astype(np.int64), np.cumsum([0, *sizes[at][:-1]]))
        for i in at[100 * both >= percent * (sizes[at] + sizes[p] - both)]:
            if comp[i] != comp[p]:
                links.append((int(nodes[p]), int(nodes[i])))
                comp[comp == comp[i]] = comp[p]
    return links


def _match(least: int, percent: int):
    def match(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(rows.column("node")), kind="stable")
        take = lambda c: np.asarray(rows.column(c))[order]
        items, sig = rows.column("items").to_pylist(), rows.column("sig").to_pylist()
        sets = [np.frombuffer(items[i], np.uint64) for i in order]
        side = take("side")
        links = link_members(take("node"), sets, np.stack([np.frombuffer(sig[i], np.uint32) for i in order]), side if len(np.unique(side)) > 1 else None, take("comp"), least, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return match


#: What tells a row: its id and two hashes of its text.
KEY = ("doc_id", "__h1", "__h2")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})


def _on_key(left: DataFrame, right: DataFrame, how: str, near: bool) -> DataFrame:
    """Null-safe join on KEY; the right side's key columns go."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in KEY})
    same = left["doc_id"].eqNullSafe(right["__r_doc_id"]) & (left["__h1"] == right["__r___h1"]) & (left["__h2"] == right["__r___h2"])
    return left.join(F.broadcast(right) if near else right, same, how).drop(*(f"__r_{k}" for k in KEY))


def _links(docs: DataFrame, reps: DataFrame, percent: int, least: int, block: int, text: str) -> DataFrame:
    """(a, b): links between distinct classes that span every component. docs: keyed; reps: node, KEY of one row, sig."""
    posted = reps.select("node", F.posexplode("sig").alias("k", "value")).select("node", (F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))).alias("posting"))
    shared = cut(posted.groupBy("posting").agg(F.count("*").alias("df")).filter("df > 1"))
    held = posted.join(shared, "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "posting"))).alias("held"))
    prefix = cut(held.filter(F.size("held") >= least).select("node", F.explode(F.expr(f"slice(held, 1, size(held) - {least} + 1)")).alias("p")).select("node", F.col("p.posting").alias("posting")))
    firsts = cut(prefix.groupBy("posting").agg(F.min("node").alias("leader")))
    family = cut(components(prefix.join(firsts, "posting").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()))
    family = family.withColumnRenamed("component", "family")
    sizes = cut(family.groupBy("family").count().filter("count > 1"))
    # blocks by hash: a family of n members has about n / block of them
    members = family.join(sizes, "family").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("count")
    members = cut(members.join(reps.select("node", *KEY), "node"))
    large = members.filter("blocks > 1").select("family", "node")
    split = not large.isEmpty()
    lead = large.groupBy("family", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS)).alias("k")).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("lead"))
    members = members.join(lead, "node", "left") if split else members.withColumn("lead", F.lit(False))
    found = _on_key(docs, members, "inner", members.count() <= BROADCAST_ROWS)
    found = found.select("family", "node", "blocks", "mine", F.coalesce("lead", F.lit(False)).alias("lead"), text)

    def prepare(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                sets = [shingles(h) for h in hash_texts([t or "" for t in part.column(5).to_pylist()])]
                keep = [i for i, s in enumerate(sets) if len(s) and set_id(s) == part.column(1)[i].as_py()]
                if keep:
                    rows = part.take(pa.array(keep, pa.int64()))
                    sig = signatures([sets[i] for i in keep])
                    yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(5)), pa.array([sets[i].tobytes() for i in keep], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["family", "node", "blocks", "mine", "lead", "items", "sig"])

    full = found.mapInArrow(lean(prepare), "family long, node long, blocks int, mine int, lead boolean, items binary, sig binary").dropDuplicates(["node"])
    full, match = cut(full) if split else full, _match(least, percent)
    at = F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))).alias("at")
    inside = full.select("family", "node", "items", "sig", F.lit(0).alias("side"), F.col("node").alias("comp"), at)
    links = inside.groupBy("family", "at").applyInArrow(match, "a long, b long")
    if not split:
        return links
    links = cut(links)
    # what a large family's first pass left outside its largest component meets all other blocks of the family
    known = components(links.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    known = cut(large.join(known, "node", "left").select("family", "node", F.coalesce("component", "node").alias("comp")))
    counts = known.groupBy("family", "comp").count()
    top = cut(counts.groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.max("count").alias("n_top"), F.sum("count").alias("n")).filter("n > n_top"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    left = known.join(top, "family").withColumn("out", F.col("comp") != F.col("top")).withColumn("n_out", F.col("n") - F.col("n_top"))
    left = left.withColumns({"tops": blocks("n_top"), "outs": blocks("n_out")}).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("out"), F.col("outs")).otherwise(F.col("tops"))).cast("int"))
    pairs = "transform(sequence(0, {0}s - 1), k -> struct({1} AS i, {2} AS kind, {3} AS j, {4} AS side))"
    meet = F.when(F.col("out"), F.concat(F.expr(pairs.format("top", "own", "'top'", "k", "0")), F.expr(pairs.format("out", "least(own, k)", "'out'", "greatest(own, k)", "if(own = k, 0, own + 1)"))))
    meet = F.explode(meet.otherwise(F.expr(pairs.format("out", "k", "'top'", "own", "-1")))).alias("m")
    across = left.select("family", "node", "comp", meet).select("family", "node", "comp", "m.*").join(full.select("node", "items", "sig"), "node")
    return links.unionByName(across.groupBy("family", "i", "kind", "j").applyInArrow(match, "a long, b long"))


def _linked(docs: DataFrame, percent: int, block: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(KEY, n_shingles, node) of every row, and (node, group, low): a class's component and the smallest id in it."""
    docs = _keyed(docs.select("doc_id", text), text)
    with small_batches(docs.sparkSession):
        rows = cut(hashed(docs.select(*KEY, text), KEY, text))
    # ids in order, null last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *KEY))
    reps = rows.filter("node is not null").groupBy("node").agg(least.alias("key"), F.first("sig").alias("sig"))
    reps = cut(reps.select("node", *(f"key.{k}" for k in KEY), "sig"))
    with small_batches(docs.sparkSession):
        links = cut(_links(docs, reps, percent, least_matches(percent), block, text))
    named = cut(components(links).join(reps.select("node", "doc_id"), "node"))
    lows = cut(named.groupBy("component").agg(F.min("doc_id").alias("low")))
    found = named.join(lows, "component").select("node", F.col("component").alias("group"), "low")
    return rows.drop("sig"), cut(reps.select("node", "doc_id").join(found, "node", "left").select("node", F.coalesce("group", "node").alias("group"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("low")))


def near_duplicates(docs: DataFrame, percent: int = 80, block: int = BLOCK, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept; a row for each row of docs."""
    rows, groups = _linked(docs, percent, block, text)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return rows.join(groups, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Null ids come last; rows of one id with near copies are one row, the one with the smaller hash of its text; of fully
    repeated rows one stays, the smallest by its other columns. Rows without words all stay.
    """
    rows, groups = _linked(docs, percent, BLOCK, text)
    rows = cut(rows.filter("node is not null").join(groups, "node").groupBy("group", *KEY).agg(F.count("*").alias("copies")))
    first = cut(rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *KEY)).alias("key")))
    rows = cut(rows.join(first, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("key.doc_id")) & (F.col("__h1") == F.col("key.__h1")) & (F.col("__h2") == F.col("key.__h2"))))
    gone, twice = rows.filter("not stays").select(*KEY), rows.filter("stays and copies > 1").select(*KEY)
    cols, keyed = docs.columns, _keyed(docs, text)
    left = _on_key(keyed, gone, "left_anti", gone.count() <= 2 * BROADCAST_ROWS)
    some = twice.count()
    if not some:
        return left.select(*cols)
    once = _on_key(left, twice, "left_anti", some <= BROADCAST_ROWS).select(*cols)
    whole = F.struct(*cols)
    one = F.first(whole) if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema) else F.min(whole)
    again = _on_key(left, twice, "left_semi", some <= BROADCAST_ROWS).groupBy(*KEY).agg(one.alias("row")).select("row.*")
    return once.unionByName(again)
