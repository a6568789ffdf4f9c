"""Feature tables of edges and regions, all as built-in aggregates and expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rag
from .components import components
from cutgrove.session import cut

#: The twelve statistics over a boundary, in order.
EDGE_STATS = ("mean", "total", "low", "high", "var", "skew", "kurt", "q10", "q25", "q50", "q75", "q90")
EDGE_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
REGION_QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
#: The seventeen statistics of a region that its pairs combine, in order; then six coordinates of its centres.
REGION_STATS = ("n", "kurt", "high", "low", *(f"q{int(100 * q)}" for q in REGION_QUANTILES), "r1", "r2", "r3", "skew", "total", "var")
CENTRES = ("wx", "wy", "wz", "cx", "cy", "cz")


def moment(kind, value: Column) -> Column:
    """Skewness or kurtosis, 0 where all values are equal."""
    return F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(kind(value))


def statistics(value: Column, off: Column | None = None) -> list[Column]:
    """EDGE_STATS of a column; quantiles are exact, with linear interpolation.

    off: the value less its group's mean. With it moments are means of its powers, which running updates are not where
    values differ by their last bit alone.
    """
    spread = [F.var_pop(value), moment(F.skewness, value), moment(F.kurtosis, value)]
    if off is not None:
        m2, m3, m4 = (F.avg(F.pow(off, F.lit(k))) for k in (2, 3, 4))
        spread = [m2, moment(lambda _: m3 / F.pow(m2, F.lit(1.5)), value), moment(lambda _: m4 / F.pow(m2, F.lit(2)) - 3, value)]
    found = [F.avg(value), F.sum(value), F.min(value), F.max(value), *spread]
    return [c.alias(n) for c, n in zip([*found, *(F.percentile(value, q) for q in EDGE_QUANTILES)], EDGE_STATS)]


def edge_statistics(faces: DataFrame, value: Column) -> DataFrame:
    return faces.groupBy("u", "v").agg(*statistics(value))


def channel_faces(voxels: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """(u, v, axis, channel, w): faces with the mean of both voxels' value, for every channel."""
    wide = voxels.select("x", "y", "z", "seg", *(c.cast("double").alias(n) for n, c in channels.items()))
    pairs = rag.voxel_pairs(wide, ("seg", *channels)).filter("seg <> next_seg")
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), ((F.col(n) + F.col(f"next_{n}")) / 2).alias("w")) for n in channels))).alias("f")
    return pairs.select(F.least("seg", "next_seg").alias("u"), F.greatest("seg", "next_seg").alias("v"), "axis", values).select("u", "v", "axis", "f.*")


def channel_statistics(voxels: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """One row for each edge and channel: EDGE_STATS."""
    by = ("u", "v", "channel")
    found = channel_faces(voxels, channels).withColumn("off", F.col("w") - F.avg("w").over(Window.partitionBy(*by)))
    return found.groupBy(*by).agg(*statistics(F.col("w"), F.col("off")))


def wide_channels(found: DataFrame, names: list[str]) -> DataFrame:
    """One row an edge with columns <channel>_<statistic>; absent and odd values are 0."""
    fine = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")), 0.0).otherwise(c)
    one = [F.max(F.when(F.col("channel") == n, fine(F.col(s)))).alias(f"{n}_{s}") for n in names for s in EDGE_STATS]
    return found.groupBy("u", "v").agg(*one)


def whole_groups(batches, least: int = 1 << 16):
    """Tables of whole groups of equal (u, v) from batches sorted by them, of about ``least`` rows or one larger group."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        rows = pa.Table.from_batches(held)
        u, v = (np.asarray(rows.column(c)) for c in (0, 1))
        stop = int(np.argmax((u == u[-1]) & (v == v[-1])))
        if stop:
            yield rows.slice(0, stop)
        held, size = rows.slice(stop).to_batches(), size - stop
    if size:
        yield pa.Table.from_batches(held)


def group_statistics(x: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """EDGE_STATS of runs of x that begin at ``start``; moments of equal values are 0."""
    n = np.diff(np.append(start, len(x)))
    group = np.repeat(np.arange(len(start)), n)
    x = x[np.lexsort((x, group))]
    total = np.add.reduceat(x, start)
    mean, low, high = total / n, x[start], x[start + n - 1]
    d = x - mean[group]
    m2, m3, m4 = (np.add.reduceat(d**k, start) / n for k in (2, 3, 4))
    flat = (low == high) | (m2 <= 0)
    safe = np.where(flat, 1.0, m2)
    out = [mean, total, low, high, m2, np.where(flat, 0.0, m3 / safe**1.5), np.where(flat, 0.0, m4 / safe**2 - 3)]
    for q in EDGE_QUANTILES:
        at = q * (n - 1)
        below = np.floor(at).astype(np.int64)
        above = np.minimum(below + 1, n - 1)
        a, b = x[start + below], x[start + above]
        out.append(a + (at - below) * (b - a))
    return [np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0) for c in out]


def wide_statistics(voxels: DataFrame, channels: list[str]) -> DataFrame:
    """(u, v, <channel>_<statistic>) for numeric columns of voxels(x, y, z, seg, channels). Nulls count as 0."""
    # all channels of a voxel are one array: one column to sort and to look ahead to
    wide = voxels.selectExpr("x", "y", "z", "seg", "array(" + ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), 0D)" for c in channels) + ") AS w")
    pairs = rag.voxel_pairs(wide, ("seg", "w")).filter("seg <> next_seg")
    return face_statistics(pairs.selectExpr("least(seg, next_seg) AS u", "greatest(seg, next_seg) AS v", "zip_with(w, next_w, (a, b) -> (a + b) / 2) AS w"), channels)


def face_statistics(faces: DataFrame, channels: list[str], more: DataFrame | None = None) -> DataFrame:
    """(u, v, <channel>_<statistic>) of faces(u, v, w), whose w is an array of all channels, with the columns of the edges
    more(u, v, numbers), a row an edge; edges without a face or without such a row are left out.

    Faces are shuffled once to their edges, and the rows of ``more`` with them, so that no join shuffles the wide result; a task
    works through whole edges, as hundreds of exact quantiles a row are no load for one aggregate. It holds the faces of an edge.
    """
    names = [f"{c}_{s}" for c in channels for s in EDGE_STATS]
    extra = {} if more is None else {f.name: f.dataType for f in more.schema if f.name not in ("u", "v")}
    rows, joined = faces.selectExpr("u", "v", "w", "CAST(NULL AS ARRAY<DOUBLE>) AS own"), more is not None
    if joined:
        rows = rows.unionByName(more.selectExpr("u", "v", "CAST(NULL AS ARRAY<DOUBLE>) AS w", "array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in extra) + ") AS own"))

    def run(batches):
        for t in whole_groups(batches):
            u, v = (np.asarray(t.column(c)) for c in (0, 1))
            edge = np.cumsum(np.concatenate(([0], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            face = np.asarray(t.column("w").is_valid())
            own = np.flatnonzero(~face)
            group = edge[face]
            if not len(group):
                continue
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            w = np.asarray(t.column("w").combine_chunks().flatten()).reshape(-1, len(channels))
            found = [s for k in range(len(channels)) for s in group_statistics(np.ascontiguousarray(w[:, k]), start)]
            at = np.flatnonzero(face)[start]
            if joined:
                _, kept, with_ = np.intersect1d(group[start], edge[own], return_indices=True)
                x = np.asarray(t.column("own").combine_chunks().flatten()).reshape(-1, len(extra))[with_]
                at, found = at[kept], [*(f[kept] for f in found), *(np.ascontiguousarray(x[:, k]) for k in range(len(extra)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u[at], v[at], *found)], names=["u", "v", *names, *extra])

    out = rows.repartition("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long, " + ", ".join(f"`{n}` double" for n in (*names, *extra)))
    return out.select("u", "v", *names, *(F.col(c).cast(kind).alias(c) for c, kind in extra.items()))


def affinity_faces(faces: DataFrame, top: float) -> DataFrame:
    """Faces with w, or top - w between planes: affinities come from two maps."""
    return faces.withColumn("w", F.when(F.col("axis") < 2, F.col("w")).otherwise(F.lit(top) - F.col("w")))


def eigenvalues(a: list[list[Column]]) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix in descending order, in closed form."""
    mean = (a[0][0] + a[1][1] + a[2][2]) / 3
    off = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    d = [a[i][i] - mean for i in range(3)]
    p = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6)
    det = d[0] * (d[1] * d[2] - a[1][2] * a[1][2]) - a[0][1] * (a[0][1] * d[2] - a[1][2] * a[0][2]) + a[0][2] * (a[0][1] * a[1][2] - d[1] * a[0][2])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    high, low = mean + 2 * p * F.cos(angle), mean + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return [F.when(p == 0, mean).otherwise(x) for x in (high, 3 * mean - high - low, low)]


def region_statistics(voxels: DataFrame, value: str = "raw") -> DataFrame:
    """(seg, REGION_STATS, CENTRES); radii are roots of the eigenvalues of the coordinates' covariance."""
    v = F.col(value)
    quantiles = [F.percentile(v, q).alias(f"q{int(100 * q)}") for q in REGION_QUANTILES]
    spread = [F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    weighted = [(F.sum(F.col(c) * v) / F.sum(v)).alias(f"w{c}") for c in "xyz"]
    found = voxels.groupBy("seg").agg(
        F.count("*").alias("n"), moment(F.kurtosis, v).alias("kurt"), F.max(v).alias("high"), F.min(v).alias("low"), *quantiles, *spread, moment(F.skewness, v).alias("skew"), F.sum(v).alias("total"), F.var_pop(v).alias("var"),
        *weighted, *(F.avg(c).alias(f"c{c}") for c in "xyz"))
    c = lambda a, b: F.col(f"c_{min(a, b)}{max(a, b)}")
    roots = eigenvalues([[c(a, b) for b in "xyz"] for a in "xyz"])
    return found.withColumns({f"r{i}": F.sqrt(F.greatest(e, F.lit(0.0))) for i, e in enumerate(roots, 1)}).select("seg", *REGION_STATS, *CENTRES)


def pair_statistics(pairs: DataFrame, stats: DataFrame, names: tuple = REGION_STATS) -> DataFrame:
    """(u, v, lo_, hi_, diff_, sum_ of every statistic, squared differences of the centres) for edges or lifted pairs."""
    both = rag.ends(pairs.select("u", "v"), stats, (*names, *CENTRES))
    a, b = (lambda n: F.col(f"{n}_u")), (lambda n: F.col(f"{n}_v"))
    combine = {"lo": lambda n: F.least(a(n), b(n)), "hi": lambda n: F.greatest(a(n), b(n)), "diff": lambda n: F.abs(a(n) - b(n)), "sum": lambda n: a(n) + b(n)}
    apart = [((a(c) - b(c)) * (a(c) - b(c))).alias(f"d{c}") for c in CENTRES]
    return both.select("u", "v", *(f(n).alias(f"{k}_{n}") for k, f in combine.items() for n in names), *apart)


def topology(edges: DataFrame, voxels: DataFrame, in_plane: bool = True) -> DataFrame:
    """(u, v, len), and with in_plane: kind, uni, iou and the ends' shapes (size by in-plane perimeter) as lo, hi and difference.

    All but length and kind are filled between planes only and 0 elsewhere, as are quotients by zero.
    """
    e = edges.select("u", "v", F.col("n").alias("len"), "kind")
    if not in_plane:
        return e.drop("kind")
    around = e.filter("kind = 1").select(F.explode(F.array("u", "v")).alias("seg"), "len").groupBy("seg").agg(F.sum("len").alias("around"))
    sizes = voxels.groupBy("seg").agg(F.count("*").alias("size")).join(around, "seg", "left")
    nodes = sizes.select("seg", "size", F.coalesce(F.try_divide(F.col("size").cast("double"), F.col("around")), F.lit(0.0)).alias("shape"))
    both = rag.ends(e, nodes, ("size", "shape"))
    uni, a, b = F.col("size_u") + F.col("size_v") - F.col("len"), F.col("shape_u"), F.col("shape_v")
    z = lambda c, zero=0.0: F.when(F.col("kind") == 0, c).otherwise(F.lit(zero))
    iou = F.coalesce(F.try_divide(F.col("len").cast("double"), uni), F.lit(0.0))
    return both.select("u", "v", "len", "kind", z(uni, 0).alias("uni"), z(iou).alias("iou"), z(F.least(a, b)).alias("shape_lo"), z(F.greatest(a, b)).alias("shape_hi"), z(F.abs(a - b)).alias("shape_diff"))


def edge_parts(faces: DataFrame) -> DataFrame:
    """(u, v, parts): number of 26-connected pieces of each boundary."""
    f = cut(faces.select("u", "v", "x", "y", "z").distinct().withColumn("id", F.monotonically_increasing_id()))
    near = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda k: F.struct((F.col("x") + k % 3 - 1).alias("x"), (F.col("y") + F.floor(k / 3) % 3 - 1).alias("y"), (F.col("z") + F.floor(k / 9) - 1).alias("z")))
    moved = f.select("u", "v", F.col("id").alias("a"), F.explode(near).alias("p")).select("u", "v", "a", "p.*")
    pairs = moved.join(f.withColumnRenamed("id", "b"), ["u", "v", "x", "y", "z"]).select("a", "b")
    return components(pairs).filter("node = component").join(f.withColumnRenamed("id", "node"), "node").groupBy("u", "v").agg(F.count("*").alias("parts"))


def curvature(faces: DataFrame) -> DataFrame:
    """(u, v, mean, low, high, dev) of the curvature of every boundary; points are ordered along the boundary's longer axis.

    Curvature is (x' y'' - y' x'') / (x'^2 + y'^2)^1.5 by central differences; boundaries of under three points get 0.
    """

    def run(key, t):
        x, y = (np.asarray(t.column(c), np.float64) for c in "xy")
        order = np.lexsort((y, x) if np.ptp(x) >= np.ptp(y) else (x, y))
        x, y = x[order], y[order]
        k = np.zeros(1)
        if len(x) > 2:
            dx, dy = np.gradient(x), np.gradient(y)
            den = (dx * dx + dy * dy) ** 1.5
            k = np.divide(dx * np.gradient(dy) - dy * np.gradient(dx), den, out=np.zeros(len(x)), where=den > 0)
        return pa.table({"u": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([key[1].as_py()], pa.int64()), **{n: pa.array([float(f(k))]) for n, f in (("mean", np.mean), ("low", np.min), ("high", np.max), ("dev", np.std))}})

    return faces.select("u", "v", "x", "y").groupBy("u", "v").applyInArrow(run, "u long, v long, mean double, low double, high double, dev double")


def border_lines(pairs: DataFrame, voxels: DataFrame, value: str, samples: int) -> DataFrame:
    """(u, v, dist_.., line_..): distances from border to border, and what lies along the ``samples`` shortest lines.

    For pairs of regions in one slice. dist_: mean, low, high, median, deviation over the border voxels of either region of the
    distance to the other region, and their number. line_: mean, low, high, var of the values along the lines of the closest
    border pairs (ties: the smaller places), which end in u and v. One task holds one pair.
    """
    rim = cut(border_voxels(voxels))
    sent = pairs.select("u", "v", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("seg")), F.struct(F.lit(1).alias("side"), F.col("v").alias("seg")))).alias("s")).select("u", "v", "s.*")

    def run(key, t):
        side, x, y, z = (np.asarray(t.column(c)) for c in ("side", "x", "y", "z"))
        ends = [np.stack([x[side == k], y[side == k]], 1) for k in (0, 1)]
        order = [e[np.lexsort((e[:, 0], e[:, 1]))] for e in ends]
        least = [np.full(len(e), np.inf) for e in order]
        close: list = []
        for lo in range(0, len(order[0]), 512):
            gap = ((order[0][lo : lo + 512, None] - order[1][None]) ** 2).sum(2)
            least[0][lo : lo + 512] = gap.min(1)
            least[1] = np.minimum(least[1], gap.min(0))
            best = np.argsort(gap, axis=None, kind="stable")[:samples]
            i, j = np.unravel_index(best, gap.shape)
            close = sorted([*close, *((int(gap[a, b]), lo + int(a), int(b)) for a, b in zip(i, j))])[:samples]
        d = np.sqrt(np.concatenate(least))
        points = []
        for k, (_, a, b) in enumerate(close):
            p, q = order[0][a], order[1][b]
            steps = max(1, int(np.abs(p - q).max()))
            at = (2 * (p * steps + np.arange(steps + 1)[:, None] * (q - p)) + steps) // (2 * steps)
            points += [(k, int(i), int(j)) for i, j in at]
        stats = [float(f) for f in (d.mean(), d.min(), d.max(), np.median(d), d.std(), len(d))]
        n = len(points)
        own = {"u": pa.array([key[0].as_py()] * n, pa.int64()), "v": pa.array([key[1].as_py()] * n, pa.int64()), "z": pa.array([int(z[0])] * n, pa.int64())}
        return pa.table(own | {c: pa.array([p[i] for p in points], pa.int64()) for i, c in enumerate(("line", "x", "y"))} | {c: pa.array([s] * n) for c, s in zip(DISTANCES, stats)})

    rows = sent.join(rim, "seg").select("u", "v", "side", "x", "y", "z")
    lines = rows.groupBy("u", "v").applyInArrow(run, "u long, v long, z long, line long, x long, y long, " + ", ".join(f"{c} double" for c in DISTANCES))
    w = F.col(value)
    on = lines.join(voxels.select("x", "y", "z", value), ["x", "y", "z"])
    return on.groupBy("u", "v").agg(*(F.first(c).alias(c) for c in DISTANCES), F.avg(w).alias("line_mean"), F.min(w).alias("line_low"), F.max(w).alias("line_high"), F.var_pop(w).alias("line_var"))


#: Statistics of the distances between two borders.
DISTANCES = ("dist_mean", "dist_low", "dist_high", "dist_median", "dist_dev", "dist_n")


def border_voxels(voxels: DataFrame) -> DataFrame:
    """(seg, x, y, z) of the voxels beside another label of their slice, or at the slice's rim."""
    change = F.lit(False)
    for along, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(other, "z").orderBy(along)
        for f in (F.lead, F.lag):
            near = F.when(f(along).over(w) - F.col(along) == (1 if f is F.lead else -1), f("seg").over(w))
            change = change | F.coalesce(near != F.col("seg"), F.lit(True))
    return voxels.withColumn("on_rim", change).filter("on_rim").select("seg", "x", "y", "z")


def line_voxels(pairs: DataFrame, centres: DataFrame) -> DataFrame:
    """(u, v, at, x, y, z): voxels of the straight line between the centres(seg, x, y, z; whole numbers) of each pair, one a
    step along its longest axis, halves rounded up."""
    from .rag import ends

    e = ends(pairs.select("u", "v"), centres, ("x", "y", "z"))
    steps = F.greatest(*(F.abs(F.col(f"{c}_u") - F.col(f"{c}_v")) for c in "xyz"), F.lit(1))
    rows = e.withColumn("steps", steps.cast("long")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    place = lambda c: F.floor((2 * (F.col(f"{c}_u") * F.col("steps") + (F.col(f"{c}_v") - F.col(f"{c}_u")) * F.col("at")) + F.col("steps")) / (2 * F.col("steps"))).cast("long")
    return rows.select("u", "v", "at", *(place(c).alias(c) for c in "xyz"))


def step_fits(profiles: DataFrame, value: str) -> DataFrame:
    """(u, v, n, split, height, rest) of profiles(u, v, at, value): the best fit by two levels to each with three values or more.

    split: how many values belong to the first level (the least of equals), height: the step between both means, rest: the mean
    squared deviation. All splits come from running sums; whole values give exact sums.
    """
    w = Window.partitionBy("u", "v").orderBy("at")
    whole = Window.partitionBy("u", "v")
    x = F.col(value).cast("long")
    rows = profiles.select("u", "v", F.row_number().over(w).alias("k"), F.count("*").over(whole).alias("n"), F.sum(x).over(w).alias("s"), F.sum(x).over(whole).alias("all"), F.sum(x * x).over(whole).alias("squares"))
    left, right = F.col("s").cast("double"), (F.col("all") - F.col("s")).cast("double")
    k, rest = F.col("k"), F.col("n") - F.col("k")
    fitted = rows.filter("n >= 3 AND k < n").select("u", "v", "n", "k", (F.col("squares") - left * left / k - right * right / rest).alias("d"), F.abs(left / k - right / rest).alias("height"))
    best = fitted.groupBy("u", "v").agg(F.max("n").alias("n"), F.min(F.struct("d", "k", "height")).alias("b"))
    return best.select("u", "v", "n", F.col("b.k").cast("long").alias("split"), F.col("b.height").alias("height"), (F.col("b.d") / F.col("n")).alias("rest"))
