"""Interval overlap join: offline dominance counting of Allen's relations, without listing a pair.

``relate`` compares left intervals with right intervals of the same key. A left interval's partners fall into nine classes
by how the two starts and the two ends compare. Each class is a difference of dominance sums (right intervals that start
before a and end before b) and of sums over one end alone, so a class needs counts and sums, never its pairs. A task sweeps
the intervals of its keys by start over a Fenwick tree of end ranks, whose nodes hold how many intervals, the sums of their
starts and ends, and the sum of a value; the sweep is offline: node by node, the running sums of what lies in it, in order
of start, are searched for every query at once.

Right intervals with equal key and ends are added up before the shuffle. A key with many left intervals is cut by start into
chunks of about ``chunk`` rows (one start range that alone holds more, by hash); the right intervals of the key go to each of
its chunks. For right intervals that are disjoint within their key, such as sessions, these are at most four for each slot,
so a chunk's task is bounded by the calendar and by ``chunk``, not by the rows. Where right intervals overlap each other,
the bound is the number of distinct (start, end) of a key.

Rows with a null key or start, and intervals that end before they start, pair with nothing. A null end is open: infinite,
and equal to any other open end. Repeated rows count each time; left rows with the same id are summed. Other columns of the
inputs are ignored, whatever their names. Empty inputs give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

#: Left intervals in one chunk of a key, about.
CHUNK = 4_096
#: Rows that a task sweeps at once (whole groups).
SWEEP_ROWS = 1 << 18
#: Starts, in slots, that are counted together when a key is cut into chunks.
RANGE = 24
OPEN = np.int64(1) << np.int64(60)
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")


def micros(ts: Column) -> Column:
    """Whole microseconds from 1970 to a timestamp without a zone, whatever the session's zone."""
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def floored(x: Column, width: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width))


def sessions(clicks: DataFrame, gap: int = 600_000_000) -> DataFrame:
    """(client_id, first, last, open): clicks of a client with at most ``gap`` microseconds between neighbours.

    All clicks of a client within one stretch of ``gap`` belong together, so they are added up map-side first; what is left
    of a client is at most one row a stretch, however many clicks it has.
    """
    # exact for gap-long stretches: two clicks in one differ by less than gap
    at = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL").select("client_id", micros(F.col("ts")).alias("t"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("buys"))
    near = at.groupBy("client_id", floored(F.col("t"), gap).alias("stretch")).agg(F.min("t").alias("first"), F.max(F.struct("t", "buys")).alias("end"))
    w = Window.partitionBy("client_id").orderBy("stretch")
    begins = F.coalesce(F.col("first") - F.lag(F.col("end.t")).over(w) > gap, F.lit(True))
    marked = near.select("client_id", "stretch", "first", "end", begins.alias("begins"))
    numbered = marked.select("client_id", "first", "end", F.sum(F.col("begins").cast("int")).over(w).alias("nr"))
    return numbered.groupBy("client_id", "nr").agg(F.min("first").alias("first"), F.max("end").alias("end")).select("client_id", "first", F.col("end.t").alias("last"), F.col("end.buys").alias("open"))


def sale_spans(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, first, last, open) of each sale with a client and a time; sales without lines end where they start."""
    shipped = lines.filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max(micros(F.col("shipped_at"))).alias("shipped"), F.max(F.col("shipped_at").isNull()).alias("open"))
    own = sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", "client_id", micros(F.col("sold_at")).alias("first"))
    return own.hint("merge").join(shipped.hint("merge"), "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), F.coalesce("open", F.lit(False)).alias("open"))


def slots(spans: DataFrame, width: int) -> tuple[Column, Column]:
    """Start and end of first/last/open rows in slots; null for an open end."""
    return floored(spans["first"], width), F.when(~spans["open"], floored(spans["last"], width))


def dominated(t: np.ndarray, r: np.ndarray, group: np.ndarray, begin: np.ndarray, weights: np.ndarray, qt: np.ndarray, qr: np.ndarray, qg: np.ndarray) -> np.ndarray:
    """For each query, the weights of the points of its group with time under qt and rank under qr.

    t: the points' places in order of (group, start), r: their ranks by end within the group, begin: the first place of each
    group. A query's Fenwick nodes are those of the set bits of qr; at each level, points are laid out by (node, time).
    """
    out = np.zeros((len(qt), weights.shape[1]), np.int64)
    n = np.int64(len(t) + 1)
    for level in range(int(qr.max(initial=0)).bit_length()):
        base = (begin >> level) + np.arange(len(begin))
        left = (r >> level) & 1 == 0
        place = (base[group[left]] + (r[left] >> level)) * n + t[left]
        order = np.argsort(place, kind="stable")
        place = place[order]
        sums = np.zeros((len(order) + 1, weights.shape[1]), np.int64)
        np.cumsum(weights[left][order], axis=0, out=sums[1:])
        ask = np.flatnonzero((qr >> level) & 1)
        node = (base[qg[ask]] + (qr[ask] >> level) - 1) * n
        out[ask] += sums[np.searchsorted(place, node + qt[ask])] - sums[np.searchsorted(place, node)]
    return out


def sweep(pg: np.ndarray, ps: np.ndarray, pe: np.ndarray, weight: np.ndarray, value: np.ndarray, qg: np.ndarray, qs: np.ndarray, qe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts, overlaps and sums of the nine relations: arrays (queries, 9, 3), and where the overlap is infinite (queries, 9).

    Points (groups ``pg``, starts, ends, how many, their summed value) and queries; ends of OPEN are infinite.
    """
    groups = int(max(pg.max(initial=0), qg.max(initial=0))) + 1
    codes = np.unique(np.concatenate([ps, pe, qs, qe]))
    m = np.int64(len(codes) + 1)
    by_start, by_end = pg * m + np.searchsorted(codes, ps), pg * m + np.searchsorted(codes, pe)
    o = np.lexsort((by_end, by_start))
    pg, ps, pe, by_start, by_end, weight, value = (x[o] for x in (pg, ps, pe, by_start, by_end, weight, value))
    w = np.stack([weight, weight * ps, np.where(pe < OPEN, weight * pe, 0), value], 1)
    ends = np.argsort(by_end, kind="stable")
    begin = np.searchsorted(pg, np.arange(groups))
    rank = np.empty(len(pg), np.int64)
    rank[ends] = np.arange(len(pg))
    rank -= begin[pg]
    starts_sum, ends_sum = np.zeros((len(pg) + 1, 4), np.int64), np.zeros((len(pg) + 1, 4), np.int64)
    np.cumsum(w, axis=0, out=starts_sum[1:])
    np.cumsum(w[ends], axis=0, out=ends_sum[1:])
    end_sorted = by_end[ends]
    s, e, first = qg * m + np.searchsorted(codes, qs), qg * m + np.searchsorted(codes, qe), begin[qg]
    t = [np.searchsorted(by_start, s, side) for side in ("left", "right")]
    r = [np.searchsorted(end_sorted, e, side) for side in ("left", "right")]
    # before[a][b]: starts under (0) or up to (1) the query's start, ends under or up to its end
    asked = dominated(np.arange(len(pg)), rank, pg, begin, w, np.concatenate([t[0], t[0], t[1], t[1]]), np.concatenate([r[0], r[1], r[0], r[1]]) - np.tile(first, 4), np.tile(qg, 4))
    (ll, le), (el, ee) = (asked[i : i + 2 * len(qg)].reshape(2, len(qg), 4) for i in (0, 2 * len(qg)))
    total = starts_sum[np.searchsorted(pg, qg, "right")] - starts_sum[first]
    started = [starts_sum[x] - starts_sum[first] for x in t]
    ended = [ends_sum[x] - ends_sum[first] for x in r]
    begun = starts_sum[np.searchsorted(by_start, e, "right")] - starts_sum[first]
    gone = ends_sum[np.searchsorted(end_sorted, s, "left")] - ends_sum[first]
    later_lt, later_le = ended[0] - el, ended[1] - ee
    same_lt, same_le = el - ll, ee - le
    classes = np.stack([
        total - started[1] - later_le - (total - begun), later_le - later_lt, later_lt,
        started[1] - started[0] - same_le, same_le - same_lt, same_lt,
        started[0] - le, le - ll, ll - gone,
    ], 1)
    n, sum_s, sum_e, sum_v = (classes[:, :, i] for i in range(4))
    whole = (qe - qs + 1)[:, None]
    up_to, back = np.where(qe < OPEN, qe + 1, 0)[:, None], (1 - qs)[:, None]
    shared = np.concatenate([
        n[:, :2] * up_to - sum_s[:, :2], sum_e[:, 2:3] - sum_s[:, 2:3] + n[:, 2:3],
        n[:, 3:5] * np.where(qe[:, None] < OPEN, whole, 0), sum_e[:, 5:6] + n[:, 5:6] * back,
        n[:, 6:8] * np.where(qe[:, None] < OPEN, whole, 0), sum_e[:, 8:] + n[:, 8:] * back,
    ], 1)
    infinite = (qe >= OPEN)[:, None] & np.isin(np.arange(9), (1, 4, 7))[None, :]
    return np.stack([n, shared, sum_v], 2), infinite


def _answers(batch: pa.Table, names: list[str]) -> pa.RecordBatch:
    """The relations of the left rows of a run of whole groups (sorted by their first three columns)."""
    change = np.zeros(len(batch), np.int64)
    for c in range(3):
        col = batch.column(c)
        change[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(batch) - 1)).to_numpy().astype(np.int64)
    group = np.cumsum(change)
    col = lambda name: pc.fill_null(batch.column(name), int(OPEN) if name == "e" else 0).to_numpy()
    is_point, s, e = col("n") > 0, col("s"), col("e")
    asks = np.flatnonzero(~is_point)
    results, infinite = sweep(group[is_point], s[is_point], e[is_point], col("n")[is_point], col("v")[is_point], group[asks], s[asks], e[asks])
    q, rel = np.nonzero(results[:, :, 0])
    found = results[q, rel]
    return pa.RecordBatch.from_arrays([
        batch.column("id").take(pa.array(asks[q])).combine_chunks(), pa.array(np.array(RELATIONS, object)[rel], pa.string()),
        pa.array(found[:, 0]), pa.array(found[:, 1], mask=infinite[q, rel]), pa.array(found[:, 2])], names=names)


def relate(left: DataFrame, right: DataFrame, chunk: int = CHUNK, span: int = RANGE, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """(id, relation, n_pairs, overlap, total) of left (key, id, s, e) with right (key, s, e, v): whole numbers, both ends
    inclusive, e null where open; ``overlap`` sums the shared slots (null where both are open), ``total`` the partners' v."""
    ok = "key IS NOT NULL AND s IS NOT NULL AND (e IS NULL OR e >= s)"
    own = left.filter(ok).select("key", "id", "s", "e", floored(F.col("s"), span).alias("range"))
    w = Window.partitionBy("key").orderBy("range")
    counted = own.groupBy("key", "range").agg(F.count("*").alias("n"))
    dealt = counted.select("key", "range", F.floor((F.sum("n").over(w) - F.col("n")) / chunk).alias("part"), F.ceil(F.col("n") / chunk).alias("subs"))
    asks = own.hint("merge").join(dealt.hint("merge"), ["key", "range"]).select("key", "part", F.pmod(F.xxhash64("id", "s", "e"), F.col("subs")).alias("sub"), "id", "s", "e", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v"))
    summed = right.filter(ok).groupBy("key", "s", "e").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("v"), F.lit(0)).cast("long")).alias("v"))
    places = dealt.select("key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub")).distinct()
    points = summed.hint("merge").join(places.hint("merge"), "key").select("key", "part", "sub", F.lit(None).cast(own.schema["id"].dataType).alias("id"), "s", "e", "n", "v")
    rows = asks.unionByName(points).repartition("key", "part", "sub").sortWithinPartitions("key", "part", "sub")
    names = ["id", "relation", "n_pairs", "overlap", "total"]
    schema = rows.select("id").schema.add("relation", "string").add("n_pairs", "long").add("overlap", "long").add("total", "long")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < sweep_rows:
                continue
            all_rows = pa.Table.from_batches(held)
            last = [all_rows.column(c)[size - 1] for c in range(3)]
            same = np.logical_and.reduce([pc.equal(all_rows.column(c), last[c]).to_numpy() for c in range(3)])
            stop = int(np.argmax(same))  # sorted: the last group is what follows its first row
            if stop:
                yield _answers(all_rows.slice(0, stop), names)
            held, size = all_rows.slice(stop).to_batches(), size - stop
        if size:
            yield _answers(pa.Table.from_batches(held), names)

    found = rows.mapInArrow(lean(run), schema)
    return found.groupBy("id", "relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("overlap").alias("overlap"), F.sum("total").alias("total"))


def sale_relations(sales: DataFrame, lines: DataFrame, clicks: DataFrame, width: int = 3_600_000_000, gap: int = 600_000_000, chunk: int = CHUNK) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc): sales against the click sessions of the same client."""
    own, other = sale_spans(sales, lines), sessions(clicks, gap)
    s, e = slots(own, width)
    s2, e2 = slots(other, width)
    left = own.select(F.col("client_id").alias("key"), F.col("sale_id").alias("id"), s.alias("s"), e.alias("e"))
    right = other.select(F.col("client_id").alias("key"), s2.alias("s"), e2.alias("e"), F.crc32(F.col("first").cast("string").cast("binary")).alias("v"))
    out = relate(left, right, chunk)
    return out.select(F.col("id").alias("sale_id"), "relation", "n_pairs", F.col("overlap").alias("overlap_slots"), F.col("total").alias("sessions_crc"))
