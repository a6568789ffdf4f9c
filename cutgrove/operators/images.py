"""Per-voxel maps, windows and image kernels. Kernels run per slice or chunk in grouped numpy tasks."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutgrove.session import cut

from .components import components
from .features import whole_groups
from .rag import faces, voxel_pairs

def _upper():
    return [F.when(F.col("axis") == a, F.col(c) + 1).otherwise(F.col(c)).alias(c) for a, c in enumerate("xyz")]


def both_sides(found: DataFrame, *cols: str) -> DataFrame:
    """The two voxels of each face."""
    return found.select("x", "y", "z", *cols).unionByName(found.select(*_upper(), *cols))


def paint_faces(labelled: DataFrame) -> DataFrame:
    """Face labels on both voxels, the larger where several meet."""
    return both_sides(labelled, "label").groupBy("x", "y", "z").agg(F.max("label").alias("label"))


def boundary_image(voxels: DataFrame) -> DataFrame:
    """val 0 on both sides of a label change, else 255."""
    edge = both_sides(faces(voxels)).distinct().withColumn("edge", F.lit(0))
    return voxels.select("x", "y", "z").join(edge, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("edge", F.lit(255)).alias("val"))


def drop_small(voxels: DataFrame, least: int) -> DataFrame:
    """(seg, label): segments under ``least`` voxels become 0, the others count from 1."""
    from .relabel import dense_ids

    sizes = voxels.groupBy("seg").count()
    kept = dense_ids(sizes.filter(F.col("count") >= least), "seg", 1)
    return sizes.join(kept, "seg", "left").select("seg", F.coalesce("new_label", F.lit(0)).cast("long").alias("label"))


def sliding_windows(voxels: DataFrame, size: int, stride: int, extent: int) -> DataFrame:
    """Each voxel once for every window that holds it; windows are found by arithmetic, not by a join."""
    starts = lambda c: F.filter(F.sequence(F.lit(0), F.lit(extent - size), F.lit(stride)), lambda s: (s <= F.col(c)) & (F.col(c) < s + size))
    return voxels.withColumn("x0", F.explode(starts("x"))).withColumn("y0", F.explode(starts("y")))


def augmented(voxels: DataFrame, extent: int) -> DataFrame:
    x, y, last = F.col("x"), F.col("y"), extent - 1
    moves = {"flip": (last - x, y), "rot90": (y, last - x), "transpose": (y, x)}
    moved = F.explode(F.array(*(F.struct(F.lit(k).alias("op"), a.alias("x2"), b.alias("y2")) for k, (a, b) in moves.items()))).alias("m")
    return voxels.select("z", "raw", moved).select("m.op", F.col("m.x2").alias("x"), F.col("m.y2").alias("y"), "z", "raw")


def weighted_average(predictions: DataFrame) -> DataFrame:
    """Overlapping predictions averaged by weight; weight 0 counts as 1."""
    total = F.sum("w")
    return predictions.groupBy("x", "y", "z").agg((F.sum(F.col("raw") * F.col("w")).cast("double") / F.when(total == 0, 1).otherwise(total)).alias("v"))


def reflect_pad_x(voxels: DataFrame, extent: int, pad: int) -> DataFrame:
    at = F.array_compact(F.array(F.col("x"), F.when(F.col("x").between(1, pad), -F.col("x")), F.when(F.col("x").between(extent - 1 - pad, extent - 2), 2 * (extent - 1) - F.col("x"))))
    return voxels.select(F.explode(at).alias("x"), "y", "z", "raw")


def border_contacts(voxels: DataFrame, last_x: int, last_y: int) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    found = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(name).alias("face"), a.alias("a"), z.alias("b"))) for name, on, a in (("x0", x == 0, y), ("x1", x == last_x, y), ("y0", y == 0, x), ("y1", y == last_y, x)))))
    return voxels.select("seg", F.explode(found).alias("f")).select("f.face", "seg", "f.a", "f.b")


def voxel_id() -> Column:
    """z, y, x in one long, in that order; coordinates are under 2^21 and not negative."""
    return F.shiftleft(F.col("z").cast("long"), 42) + F.shiftleft(F.col("y").cast("long"), 21) + F.col("x").cast("long")


def _part(c: str, by: int) -> Column:
    return F.shiftright(F.col(c), by).bitwiseAND((1 << 21) - 1)


def joined_voxels(voxels: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y, z, first_x, first_y, first_z: components of voxels over pairs(a, b) of voxel ids; lone voxels are their own."""
    alone = voxels.select(voxel_id().alias("a"), voxel_id().alias("b"))
    names = [(c, by) for c, by in (("x", 0), ("y", 21), ("z", 42))]
    return components(pairs.unionByName(alone)).select(*(_part("node", by).alias(c) for c, by in names), *(_part("component", by).alias(f"first_{c}") for c, by in names))


def label_volume(voxels: DataFrame, col: str) -> DataFrame:
    """Connected components (6 neighbours) of equal labels: x, y, z, component (z,y,x of its first voxel)."""
    pairs = voxel_pairs(voxels.withColumn("me", voxel_id()), (col, "me")).filter(F.col(col) == F.col(f"next_{col}")).select(F.col("me").alias("a"), F.col("next_me").alias("b"))
    return joined_voxels(voxels, pairs).select("x", "y", "z", F.concat_ws(",", "first_z", "first_y", "first_x").alias("component"))


def region_image(voxels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components of voxels over the uncut ones of pairs(x, y, z, axis, cut) with the next voxel along the axis."""
    uncut = pairs.filter(~F.col("cut"))
    low, high = uncut.select("x", "y", "z", "axis", voxel_id().alias("a")), [F.col(c) + (F.col("axis") == i).cast("int") for i, c in enumerate("xyz")]
    high_id = F.shiftleft(high[2].cast("long"), 42) + F.shiftleft(high[1].cast("long"), 21) + high[0].cast("long")
    return joined_voxels(voxels, low.select("a", high_id.alias("b")))


def sized_components(voxels: DataFrame, col: str, least: int, most: int, background: int = 0) -> DataFrame:
    """x, y, z, label: 1 in connected components of equal labels whose size is in range, else 0."""
    kept = voxels.filter(F.col(col) != background)
    pairs = voxel_pairs(kept.withColumn("me", voxel_id()), (col, "me")).filter(F.col(col) == F.col(f"next_{col}")).select(F.col("me").alias("a"), F.col("next_me").alias("b"))
    first = ["first_x", "first_y", "first_z"]
    found = cut(joined_voxels(kept, pairs))
    good = cut(found.groupBy(*first).count().filter(F.col("count").between(least, most)).select(*first))
    inside = found.join(good, first, "left_semi").select("x", "y", "z", F.lit(1).alias("label"))
    return voxels.select("x", "y", "z").join(inside, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("label", F.lit(0)).alias("label"))


def membrane(voxels: DataFrame, col: str = "seg") -> DataFrame:
    """1 where the label before and the one behind differ along x or y."""
    change = F.lit(False)
    for along, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(other, "z").orderBy(along)
        change = change | (F.coalesce(F.lead(col).over(w), F.col(col)) != F.coalesce(F.lag(col).over(w), F.col(col)))
    return voxels.select("x", "y", "z", change.cast("int").alias("membrane"))


def skip_pairs(voxels: DataFrame, starts: DataFrame) -> DataFrame:
    """x, y, z, u, v: labels over each other across starts(z, reach), on the lower slice; starts are one row a slice."""
    low = voxels.select("x", "y", "z", F.col("seg").alias("a")).join(starts, "z").withColumn("top", F.col("z") + F.col("reach"))
    return low.join(voxels.select("x", "y", F.col("z").alias("top"), F.col("seg").alias("b")), ["x", "y", "top"]).select("x", "y", "z", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def normalisations(voxels: DataFrame, col: str, bits: int, eps: float = 1e-6) -> DataFrame:
    """Standardised, cast to 32 bits, centred to -1..1, as a share of ``bits`` bits, scaled to the volume's range."""
    mean, dev, low, high = voxels.agg(F.avg(col), F.stddev_pop(col), F.min(col), F.max(col)).first()
    v = F.col(col)
    if mean is None:
        mean, dev, low, high = 0.0, 0.0, 0, 1
    return voxels.select("x", "y", "z", F.round((v - F.lit(mean)) / F.lit(dev + eps), 6).alias("batch"), v.cast("float").alias("cast32"), F.round(v / F.lit(float(high)) * 2 - 1, 6).alias("centred"), F.round(v / F.lit(float(2**bits - 1)), 9).alias("of_16_bit"), F.round((v - low) / F.lit(float(high - low or 1)), 6).alias("whole"))


def reflect_to_multiple(voxels: DataFrame, steps: dict[str, int]) -> DataFrame:
    """The far sides reflected until each extent is a multiple of its step."""
    out = voxels
    for c, step in steps.items():
        n = (voxels.agg(F.max(c)).first()[0] or 0) + 1
        pad = -n % step
        if pad:
            out = out.unionByName(out.filter(F.col(c).between(n - 1 - pad, n - 2)).withColumn(c, 2 * (n - 1) - F.col(c)))
    return out


def augmentations(voxels: DataFrame) -> DataFrame:
    """op, x, y, z, raw: pad, trim, flip_z, drop_slice, occlude, complement, shift and scale of one volume."""
    v = voxels.select("x", "y", "z", "raw")
    last_x, last_z, top = v.agg(F.max("x"), F.max("z"), F.max("raw")).first()
    x, y, z, raw = (F.col(c) for c in ("x", "y", "z", "raw"))
    zero = F.lit(0).cast("long")
    out = {
        "pad": v.unionByName(v.filter(x == 0).select(F.lit(-1).cast("long").alias("x"), "y", "z", zero.alias("raw"))),
        "trim": v.filter(x.between(2, 7) & y.between(2, 7)).select((x - 2).alias("x"), (y - 2).alias("y"), "z", "raw"),
        "flip_z": v.withColumn("z", F.lit(last_z) - z),
        "drop_slice": v.withColumn("raw", F.when(z % 10 == 3, zero).otherwise(raw)),
        "occlude": v.withColumn("raw", F.when(x.between(3, 5) & y.between(4, 6), zero).otherwise(raw)),
        "complement": v.withColumn("raw", F.lit(top) - raw),
        "shift": v.filter(x < last_x).withColumn("x", x + 1),
        "scale": v.groupBy(F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y"), "z").agg(F.max("raw").alias("raw")),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(op).alias("op"), "x", "y", "z", "raw") for op, df in out.items()))


def blocks(voxels: DataFrame, sizes: dict[str, int], halo: int) -> DataFrame:
    """Each voxel once for every block that holds it, blocks of the given sizes with a halo; block: a struct of both indices, bx and bz."""
    at = lambda c: F.expr(f"filter(sequence(greatest(0, ({c} - {halo}) div {sizes[c]} - 1), ({c} + {halo}) div {sizes[c]}), b -> {c} >= b * {sizes[c]} - {halo} and {c} < (b + 1) * {sizes[c]} + {halo})")
    last = {c: voxels.agg(F.max(c)).first()[0] or 0 for c in sizes}
    held = voxels.withColumn("bx", F.explode(at("x"))).withColumn("bz", F.explode(at("z")))
    inside = [F.col(f"b{c}") <= last[c] // sizes[c] for c in sizes]
    return held.filter(inside[0] & inside[1]).withColumn("block", F.struct(F.col("bx").cast("long").alias("bx"), F.col("bz").cast("long").alias("bz"))).drop("bx", "bz")


def march(slowness: np.ndarray, start: tuple, interpolate: bool = True) -> np.ndarray:
    """Arrival times on a grid from a start pixel; with interpolation by the upwind quadratic, else along edges only."""
    t, done, heap = np.full(slowness.shape, np.inf), np.zeros(slowness.shape, bool), [(0.0, *start)]
    t[start] = 0.0
    while heap:
        d, x, y = heapq.heappop(heap)
        if done[x, y]:
            continue
        done[x, y] = True
        for a, b in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            if not (0 <= a < t.shape[0] and 0 <= b < t.shape[1]) or done[a, b]:
                continue
            s = slowness[a, b]
            along = [min((t[i, j] for i, j in pair if 0 <= i < t.shape[0] and 0 <= j < t.shape[1] and done[i, j]), default=math.inf) for pair in (((a - 1, b), (a + 1, b)), ((a, b - 1), (a, b + 1)))]
            lo, hi = min(along), max(along)
            new = lo + s
            if interpolate and hi < new:
                new = (lo + hi + math.sqrt(2 * s * s - (hi - lo) ** 2)) / 2
            if new < t[a, b]:
                t[a, b] = new
                heapq.heappush(heap, (new, a, b))
    return t


def fast_marching(voxels: DataFrame, col: str, scale: float = 1.0) -> DataFrame:
    """x, y, z, straight, bent: arrival times in every slice from its first pixel, along edges and interpolated."""

    def run(key, t):
        x, y, ox, oy, (g,) = _grid(t, [col])
        times = {n: march(g * scale, (0, 0), k)[x - ox, y - oy] for n, k in (("straight", False), ("bent", True))}
        return pa.table({"x": x, "y": y, "z": pa.array([key[0].as_py()] * len(x), pa.int64()), **times})

    return voxels.select("x", "y", "z", col).groupBy("z").applyInArrow(run, "x long, y long, z long, straight double, bent double")


def _grid(t, cols):
    x, y = np.asarray(t.column("x")), np.asarray(t.column("y"))
    ox, oy = x.min(), y.min()
    shape = (int(x.max() - ox) + 1, int(y.max() - oy) + 1)
    out = []
    for c in cols:
        g = np.zeros(shape, np.float64)
        g[x - ox, y - oy] = np.asarray(t.column(c))
        out.append(g)
    return x, y, ox, oy, out


def _lower_envelope(f: np.ndarray, pitch: float) -> np.ndarray:
    """min over j of (pitch * (i - j))^2 + f[j] for every column of f: the parabolas that form the envelope, in linear memory."""
    n, m = f.shape
    at, cross = np.zeros((n, m), np.int64), np.full((n + 1, m), np.inf)  # parabolas on the envelope and where each takes over
    top, cols, step = np.full(m, -1), np.arange(m), pitch * pitch
    for q in range(n):
        todo = cols[np.isfinite(f[q])]
        while len(todo):
            first = todo[top[todo] < 0]
            top[first], at[0, first], cross[0, first] = 0, q, -np.inf
            todo = todo[~np.isin(todo, first)] if len(first) else todo
            if not len(todo):
                break
            k = top[todo]
            p = at[k, todo]
            s = ((f[q, todo] / step + q * q) - (f[p, todo] / step + p * p)) / (2 * (q - p))
            below = s <= cross[k, todo]
            done = todo[~below]
            top[done] += 1
            at[top[done], done], cross[top[done], done] = q, s[~below]
            todo = todo[below]
            top[todo] -= 1
    out, k = np.full((n, m), np.inf), np.zeros(m, np.int64)
    some = top >= 0
    for q in range(n):
        while (move := some & (k < top) & (cross[np.minimum(k + 1, n), cols] < q)).any():
            k[move] += 1
        p = at[k, cols]
        out[q, some] = (step * (q - p) ** 2 + f[p, cols])[some]
    return out


def squared_edt(on: np.ndarray, pitch: tuple = (1.0, 1.0)) -> np.ndarray:
    """Squared distance of every pixel or voxel to the nearest set one: lower envelopes of parabolas, one axis after the other."""
    f = np.where(on, 0.0, np.inf)
    for axis in range(on.ndim):
        g = np.moveaxis(f, axis, 0)
        f = np.moveaxis(_lower_envelope(np.ascontiguousarray(g.reshape(len(g), -1)), pitch[axis]).reshape(g.shape), 0, axis)
    return f


def gaussian(g: np.ndarray, sigma: float, order: int = 0, axis: int = 0) -> np.ndarray:
    """Separable Gaussian or derivative along one axis, reflected borders, 3 sigma wide."""
    r = max(1, math.ceil(3 * sigma))
    t = np.arange(-r, r + 1)
    k = np.exp(-(t**2) / (2 * sigma**2))
    k /= k.sum()
    if order == 1:
        k = -t / sigma**2 * k
    elif order == 2:
        k = (t**2 / sigma**4 - 1 / sigma**2) * k
        k -= k.mean()
    n = g.shape[axis]
    at = np.arange(-r, n + r) % max(1, 2 * n - 2) if n > 1 else np.zeros(n + 2 * r, int)
    at = np.where(at < n, at, 2 * n - 2 - at)
    padded = np.take(g, at, axis)
    return np.apply_along_axis(np.convolve, axis, padded, k[::-1], "valid")


def filters(g: np.ndarray, sigma: float | tuple) -> dict[str, np.ndarray]:
    """Smoothing, Laplacian and eigenvalues of the Hessian (largest first) in two or three dimensions; one width or one an axis."""
    widths = (sigma,) * g.ndim if np.isscalar(sigma) else sigma

    def s(*orders):
        out = g
        for axis, order in enumerate(orders):
            out = gaussian(out, widths[axis], order, axis)
        return out

    unit = np.eye(g.ndim, dtype=int)
    second = {(i, j): s(*(unit[i] + unit[j])) for i in range(g.ndim) for j in range(i, g.ndim)}
    trace = sum(second[i, i] for i in range(g.ndim))
    out = {"smooth": s(*[0] * g.ndim), "log": trace}
    if g.ndim == 2:
        mid, span = trace / 2, np.sqrt(((second[0, 0] - second[1, 1]) / 2) ** 2 + second[0, 1] ** 2)
        return out | {"hessian_high": mid + span, "hessian_low": mid - span}
    h = np.stack([np.stack([second[min(i, j), max(i, j)] for j in range(3)], -1) for i in range(3)], -2)
    e = np.linalg.eigvalsh(h)
    return out | {f"hessian_{k + 1}": e[..., 2 - k] for k in range(3)}


#: Scales of the filter bank, and the anisotropy from which filters work inside slices.
SIGMAS = (1.6, 4.2, 8.3)
FLAT = 20


def filter_bank(voxels: DataFrame, col: str, sigmas: tuple = SIGMAS, anisotropy: float = 25.0, depth: int = 32) -> DataFrame:
    """x, y, z and a column for each filter and scale.

    From FLAT on a task holds one slice. Below, filters are three-dimensional with a width of sigma / anisotropy along z; a
    task holds ``depth`` slices and as many on either side as the widest filter reaches, whole in x and y.
    """
    flat = anisotropy >= FLAT
    kinds = ("smooth", "log", "hessian_high", "hessian_low") if flat else ("smooth", "log", "hessian_1", "hessian_2", "hessian_3")
    names = [f"{n}_{str(s).replace('.', '_')}" for s in sigmas for n in kinds]
    fields = "x long, y long, z long, " + ", ".join(f"{n} double" for n in names)
    rows = voxels.select("x", "y", "z", col)

    def in_slice(key, t):
        x, y, ox, oy, (g,) = _grid(t, [col])
        values = [v for s in sigmas for v in filters(g, s).values()]
        return pa.table({"x": x, "y": y, "z": pa.array([key[0].as_py()] * len(x), pa.int64())} | {n: v[x - ox, y - oy] for n, v in zip(names, values)})

    if flat:
        return rows.groupBy("z").applyInArrow(in_slice, fields)
    halo = math.ceil(3 * max(sigmas) / anisotropy) + 1
    chunk = F.explode(F.expr(f"sequence(greatest(0, (z - {halo}) div {depth}), (z + {halo}) div {depth})")).alias("chunk")

    def in_chunk(key, t):
        x, y, z = (np.asarray(t.column(c)) for c in "xyz")
        ok = z // depth == key[0].as_py()
        o = (x.min(), y.min(), z.min())
        g = np.zeros((np.ptp(x) + 1, np.ptp(y) + 1, np.ptp(z) + 1))
        g[x - o[0], y - o[1], z - o[2]] = np.asarray(t.column(col))
        values = [v for s in sigmas for v in filters(g, (s, s, max(0.3, s / anisotropy))).values()]
        at = (x[ok] - o[0], y[ok] - o[1], z[ok] - o[2])
        return pa.table({"x": x[ok], "y": y[ok], "z": z[ok]} | {n: v[at] for n, v in zip(names, values)})

    return rows.select("*", chunk).groupBy("chunk").applyInArrow(in_chunk, fields)


def slice_filters(voxels: DataFrame, cols: tuple, keep: tuple = ("seg",), sigmas: tuple = SIGMAS) -> tuple[DataFrame, list[str]]:
    """x, y, z, the kept columns and every filter and scale of each column inside slices, as <column>_<filter>_<scale>, in one
    pass; and the names of those. A task holds one slice."""
    kinds = ("smooth", "log", "hessian_high", "hessian_low")
    names = [f"{c}_{n}_{str(s).replace('.', '_')}" for c in cols for s in sigmas for n in kinds]
    kinds_of = {f.name: f.dataType.simpleString() for f in voxels.schema}
    fields = ", ".join(["x long", "y long", "z long", *(f"{k} {kinds_of[k]}" for k in keep), *(f"{n} double" for n in names)])

    def run(key, t):
        x, y, ox, oy, grids = _grid(t, list(cols))
        values = [v[x - ox, y - oy] for g in grids for s in sigmas for v in filters(g, s).values()]
        return pa.table({"x": x, "y": y, "z": pa.array([key[0].as_py()] * len(x), pa.int64()), **{k: t.column(k) for k in keep}, **dict(zip(names, values))})

    return voxels.select("x", "y", "z", *keep, *cols).groupBy("z").applyInArrow(run, fields), names


#: Slices whose faces one stream makes, beside the first slice of the next slab.
SLAB = 16


def filter_faces(voxels: DataFrame, cols: tuple, sigmas: tuple = SIGMAS) -> tuple[DataFrame, list[str]]:
    """(u, v, w): faces between labels with the mean of both voxels in every filter and scale of each column, as an array; and
    the names of those. Slices pass as streams in order, so what is shuffled are the columns themselves, not their filters; a
    task holds two slices."""
    names = [f"{c}_{n}_{str(s).replace('.', '_')}" for c in cols for s in sigmas for n in ("smooth", "log", "hessian_high", "hessian_low")]
    slab = F.floor(F.col("z") / SLAB)
    slabs = F.explode(F.when(F.pmod("z", F.lit(SLAB)) == 0, F.array(slab, slab - 1)).otherwise(F.array(slab)))

    def between(a, b):
        """Of two equal boxes of (seg, there, w)."""
        differ = a[1] & b[1] & (a[0] != b[0])
        s, t = a[0][differ], b[0][differ]
        return np.minimum(s, t), np.maximum(s, t), (a[2][differ] + b[2][differ]) / 2

    def run(batches):
        before, done, size = None, [], 0
        for rows in whole_groups(batches):
            slabs, zs = (np.asarray(rows.column(c)) for c in ("slab", "z"))
            ends = [0, *(np.flatnonzero((slabs[1:] != slabs[:-1]) | (zs[1:] != zs[:-1])) + 1), len(zs)]
            for lo, hi in zip(ends, ends[1:]):
                t = rows.slice(lo, hi - lo)
                x, y, ox, oy, grids = _grid(t, list(cols))
                seg, there = np.zeros(grids[0].shape, np.int64), np.zeros(grids[0].shape, bool)
                seg[x - ox, y - oy], there[x - ox, y - oy] = np.asarray(t.column("seg").fill_null(0)), np.asarray(t.column("seg").is_valid())
                w = np.stack([v for g in grids for s in sigmas for v in filters(g, s).values()], axis=-1)
                here = (int(slabs[lo]), int(zs[lo]), int(ox), int(oy), (seg, there, w))
                box = lambda of, x0, x1, y0, y1: tuple(g[x0 - of[2] : x1 - of[2], y0 - of[3] : y1 - of[3]] for g in of[4])
                x0, y0, x1, y1 = ox, oy, ox + seg.shape[0], oy + seg.shape[1]
                if here[1] // SLAB == here[0]:  # else the next slab's first slice, whose own faces are made there
                    done.append(between(box(here, x0, x1 - 1, y0, y1), box(here, x0 + 1, x1, y0, y1)))
                    done.append(between(box(here, x0, x1, y0, y1 - 1), box(here, x0, x1, y0 + 1, y1)))
                if before is not None and before[:2] == (here[0], here[1] - 1):
                    bx, by, shape = before[2], before[3], before[4][0].shape
                    both = max(x0, bx), min(x1, bx + shape[0]), max(y0, by), min(y1, by + shape[1])
                    if both[0] < both[1] and both[2] < both[3]:
                        done.append(between(box(before, *both), box(here, *both)))
                before = here
                size += seg.size
                if size >= 1 << 12:
                    yield _face_batch(done)
                    done, size = [], 0
        if done:
            yield _face_batch(done)

    rows = voxels.select(slabs.alias("slab"), F.col("z").cast("long").alias("z"), "x", "y", F.col("seg").cast("long").alias("seg"), *cols)
    spark = voxels.sparkSession  # voxels are few bytes and much work: slabs are dealt to tasks by number and not joined by their size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "slab").sortWithinPartitions("slab", "z").mapInArrow(run, "u long, v long, w array<double>"), names


def _face_batch(done: list[tuple]) -> pa.RecordBatch:
    u, v, w = (np.concatenate(x) for x in zip(*done))
    flat = pa.array(np.ascontiguousarray(w).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * w.shape[1]), flat)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), lists], names=["u", "v", "w"])


def flood(heights: np.ndarray, seeds: np.ndarray, neighbours: int = 4) -> np.ndarray:
    """Seeded watershed with 4 or 8 neighbours: pixels in order of height, then of arrival."""
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if neighbours == 8 else [])
    out, heap, n = seeds.copy(), [], 0
    for x, y in zip(*np.nonzero(seeds)):
        heapq.heappush(heap, (heights[x, y], n, int(x), int(y)))
        n += 1
    while heap:
        _, _, x, y = heapq.heappop(heap)
        for i, j in steps:
            a, b = x + i, y + j
            if 0 <= a < out.shape[0] and 0 <= b < out.shape[1] and not out[a, b]:
                out[a, b] = out[x, y]
                heapq.heappush(heap, (max(heights[a, b], heights[x, y]), n, a, b))
                n += 1
    return out
