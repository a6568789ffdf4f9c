"""Superpixels: signed distances, seeds, watersheds and what is done with their pieces. A task holds a slice or a chunk."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grids, images
from .components import contract
from .relabel import running_offsets


@dataclass(frozen=True)
class Options:
    """threshold of the membrane; least sizes of membranes and segments; widths of smoothing; what seeds and weights are."""

    threshold: float
    least_membrane: int = 0
    least_segment: int = 0
    seed_sigma: float = 0.0
    weight_sigma: float = 0.0
    group_seeds: bool = False
    grow_on_map: bool = False


def half_steps(ndim: int, diagonal: bool) -> list[tuple]:
    steps = [s for s in product((-1, 0, 1), repeat=ndim) if s > (0,) * ndim]
    return steps if diagonal else [s for s in steps if sum(map(abs, s)) == 1]


def _shifted(shape: tuple, step: tuple):
    """Slices of both ends of every pair of grid points that are one step apart."""
    low = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(step, shape))
    high = tuple(slice(max(0, s), n - max(0, -s)) for s, n in zip(step, shape))
    return low, high


def label_grid(g: np.ndarray, background=None, diagonal: bool = False) -> np.ndarray:
    """Connected components of equal values: 1 + the flat index of the first point, 0 on the background."""
    index = np.arange(g.size).reshape(g.shape)
    a, b = [], []
    for step in half_steps(g.ndim, diagonal):
        low, high = _shifted(g.shape, step)
        same = g[low] == g[high]
        a.append(index[low][same])
        b.append(index[high][same])
    out = np.arange(1, g.size + 1)
    node, first = contract(np.concatenate(a), np.concatenate(b))
    out[node] = first + 1
    out = out.reshape(g.shape)
    return out if background is None else np.where(g == background, 0, out)


def drop_sizes(labels: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Labels under ``least`` or over ``most`` points become 0."""
    names, at, size = np.unique(labels, return_inverse=True, return_counts=True)
    bad = (size < least) | (size > most if most is not None else False)
    return np.where(bad[at].reshape(labels.shape), 0, labels)


def signed_distance(p: np.ndarray, threshold: float, least_membrane: int = 0, pitch: tuple | None = None) -> np.ndarray:
    """Distance to membrane (p >= threshold) outside; inside 1 - the distance to the rest. Small membranes don't count."""
    pitch = pitch or (1.0,) * p.ndim
    on = p >= threshold
    if least_membrane:
        on = drop_sizes(label_grid(on.astype(np.int8), 0), least_membrane) > 0
    far = float(np.linalg.norm([n * k for n, k in zip(p.shape, pitch)]))
    out, inside = (np.minimum(np.sqrt(images.squared_edt(x, pitch)), far) for x in (on, ~on))
    return out - np.where(inside > 0, inside - 1, 0)


def maxima(d: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Mask of local maxima in any dimension; plateaus count as one point and may touch the border."""
    plateau = label_grid(d, diagonal=diagonal)
    low = set()
    for step in half_steps(d.ndim, diagonal):
        a, b = _shifted(d.shape, step)
        low.update(np.unique(plateau[a][d[a] < d[b]]).tolist())
        low.update(np.unique(plateau[b][d[b] < d[a]]).tolist())
    return ~np.isin(plateau, np.fromiter(low, np.int64, len(low)))


def smooth(g: np.ndarray, sigma: float) -> np.ndarray:
    for axis in range(g.ndim if sigma else 0):
        g = images.gaussian(g, sigma, 0, axis)
    return g


def seed_mask(d: np.ndarray, sigma: float) -> np.ndarray:
    s = smooth(d, sigma)
    found = maxima(s) & (d > 0)
    if not found.any():
        found[np.unravel_index(d.argmax(), d.shape)] = True
    return found


def group_seeds(mask: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Labels of seeds: a and b are one group if their distance is under both their distances to membrane, and so on.

    Seeds are swept in order of the first axis; each is compared with those not farther along it than the largest distance.
    """
    at = np.argwhere(mask)
    reach = d[mask]
    a, b = [], []
    ahead = np.searchsorted(at[:, 0], at[:, 0] + reach, "left")
    for lo in range(0, len(at), 256):
        hi = min(lo + 256, len(at))
        end = int(ahead[lo:hi].max())
        gap = ((at[lo:hi, None] - at[None, lo:end]) ** 2).sum(2)
        i, j = np.nonzero((gap < reach[lo:hi, None] ** 2) & (gap < reach[None, lo:end] ** 2))
        a.append(i[i < j] + lo)
        b.append(j[i < j] + lo)
    label = np.arange(1, len(at) + 1)
    if a:
        node, first = contract(np.concatenate(a), np.concatenate(b))
        label[node] = first + 1
    out = np.zeros(mask.shape, np.int64)
    out[mask] = label
    return out


def watershed(p: np.ndarray, o: Options, d: np.ndarray | None = None) -> np.ndarray:
    d = signed_distance(p, o.threshold, o.least_membrane) if d is None else d
    mask = seed_mask(d, o.seed_sigma)
    seeds = group_seeds(mask, d) if o.group_seeds else label_grid(mask.astype(np.int8), 0, diagonal=True)
    weights = smooth(p if o.grow_on_map else -d, o.weight_sigma)
    out = images.flood(weights, seeds)
    if o.least_segment:
        kept = drop_sizes(out, o.least_segment)
        if kept.any():
            out = images.flood(weights, kept)
    return out


def _by_slice(voxels: DataFrame, cols: tuple, kernel, fields: str, key: str = "z") -> DataFrame:
    """x, y, z and the fields, arrays over a slice's grid that kernel(grids, z) returns."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(k, t):
        x, y, ox, oy, grids = images._grid(t, list(cols))
        out = kernel(grids, k[0].as_py())
        return pa.table({"x": x, "y": y, "z": pa.array([k[0].as_py()] * len(x), pa.int64()), **{n: g[x - ox, y - oy] for n, g in zip(names, out)}})

    return voxels.select("x", "y", "z", *cols).groupBy(key).applyInArrow(run, f"x long, y long, z long, {fields}")


def _apart(own: DataFrame) -> DataFrame:
    """Labels of slices made different by the offset of the slices before."""
    most = own.groupBy("z").agg(F.max("own").alias("m"))
    return own.join(running_offsets(most, "z", "m"), "z").select("x", "y", "z", F.when(F.col("own") > 0, F.col("own") + F.col("off")).otherwise(0).alias("label"))


def superpixels(voxels: DataFrame, col: str, o: Options) -> DataFrame:
    """x, y, z, label: superpixels of every slice."""
    return _apart(_by_slice(voxels, (col,), lambda g, z: (watershed(g[0], o),), "own long"))


def signed_distances(voxels: DataFrame, col: str, threshold: float, least_membrane: int = 0) -> DataFrame:
    return _by_slice(voxels, (col,), lambda g, z: (signed_distance(g[0], threshold, least_membrane),), "distance double")


def seeds(voxels: DataFrame, col: str, threshold: float, sigma: float) -> DataFrame:
    """The voxels that are seeds."""
    found = _by_slice(voxels, (col,), lambda g, z: (seed_mask(signed_distance(g[0], threshold), sigma).astype(np.int64),), "seed long")
    return found.filter("seed = 1").select("x", "y", "z")


def grouped_seeds(voxels: DataFrame, col: str, threshold: float, sigma: float = 0.0) -> DataFrame:
    """x, y, z, seed_group of every seed; groups are numbered inside their slice."""

    def kernel(g, z):
        d = signed_distance(g[0], threshold)
        return (group_seeds(seed_mask(d, sigma), d),)

    return _by_slice(voxels, (col,), kernel, "seed_group long").filter("seed_group > 0")


def pitched_superpixels(voxels: DataFrame, col: str, threshold: float, pitch: float) -> DataFrame:
    """x, y, z, label: distances over the whole volume with slices ``pitch`` apart, then seeds and watershed in every slice."""
    rows = voxels.select("x", "y", "z", F.col(col).cast("double").alias(col), (F.col(col) >= threshold).alias("__on"))
    extent = rows.agg(*((F.max(c) - F.min(c) + 1).alias(c) for c in "xyz")).first()
    far = float(np.linalg.norm([(n or 0) * k for n, k in zip(extent, (1.0, 1.0, pitch))]))
    d = grids.signed_distances(rows, "__on", (1.0, 1.0, pitch)).select("x", "y", "z", F.coalesce("distance", F.lit(far)).alias("__d"))
    o = Options(threshold, grow_on_map=True, weight_sigma=0.8)
    return _apart(_by_slice(rows.join(d, ["x", "y", "z"]), (col, "__d"), lambda g, z: (watershed(g[0], o, g[1]),), "own long"))


def smoothed_watershed(voxels: DataFrame, col: str, sigma: float) -> DataFrame:
    """x, y, z, label: watershed of the smoothed map from its minima, eight neighbours."""

    def kernel(g, z):
        s = smooth(g[0], sigma)
        return (images.flood(s, label_grid(maxima(-s).astype(np.int8), 0, diagonal=True), 8),)

    return _apart(_by_slice(voxels, (col,), kernel, "own long"))


def join_enclosed(labels: np.ndarray) -> np.ndarray:
    """Segments that touch exactly one other one and not the border are joined to it."""
    a, b = [], []
    for step in half_steps(2, False):
        low, high = _shifted(labels.shape, step)
        other = labels[low] != labels[high]
        a += [labels[low][other], labels[high][other]]
        b += [labels[high][other], labels[low][other]]
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    names, first, many = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    rim = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    inner = (many == 1) & ~np.isin(names, rim)
    out = labels.copy()
    for name, to in zip(names[inner], pairs[first[inner], 1]):
        out[labels == name] = to
    return out


def dense_ground_truth(voxels: DataFrame, label: str, col: str) -> DataFrame:
    """x, y, z, label: connected labels (0 is membrane) grown over the membrane on the map, enclosed ones joined."""

    def kernel(g, z):
        start = label_grid(g[0].astype(np.int64), 0)
        if not start.any():
            return (np.ones(start.shape, np.int64),)
        return (join_enclosed(images.flood(g[1], start)),)

    return _apart(_by_slice(voxels, (label, col), kernel, "own long"))


def _farthest(inside: set, start: tuple) -> tuple[tuple, dict]:
    by, queue = {start: None}, [start]
    for x, y in queue:
        for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            if p in inside and p not in by:
                by[p] = (x, y)
                queue.append(p)
    return queue[-1], by


def eccentricity_centres(voxels: DataFrame, col: str) -> DataFrame:
    """(col, x, y, z): the middle of the longest of the shortest paths found by two searches, in every slice's segment."""

    def run(key, t):
        inside = set(zip(t.column("x").to_pylist(), t.column("y").to_pylist()))
        a, _ = _farthest(inside, min(inside))
        b, by = _farthest(inside, a)
        path = [b]
        while by[path[-1]] is not None:
            path.append(by[path[-1]])
        x, y = path[len(path) // 2]
        return pa.table({col: pa.array([key[0].as_py()], pa.int64()), "x": pa.array([x], pa.int64()), "y": pa.array([y], pa.int64()), "z": pa.array([key[1].as_py()], pa.int64())})

    return voxels.select(col, "z", "x", "y").groupBy(col, "z").applyInArrow(run, f"{col} long, x long, y long, z long")


def label_slices(voxels: DataFrame, col: str, neighbours: int = 8) -> DataFrame:
    """x, y, z, component: 4- or 8-connected components in every slice, by the least of x + width * y."""
    width = (voxels.agg(F.max("x")).first()[0] or 0) + 1
    steps = [(dx, dy) for dx, dy in half_steps(2, neighbours == 8)]
    moved = voxels.select("z", col, images.voxel_id().alias("a"), "x", "y", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))).alias("m"))
    moved = moved.select("z", col, "a", (F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y"))
    pairs = moved.join(voxels.select("x", "y", "z", col, images.voxel_id().alias("b")), ["x", "y", "z", col]).select("a", "b")
    return images.joined_voxels(voxels, pairs).select("x", "y", "z", (F.col("first_x") + width * F.col("first_y")).alias("component"))


def face_centroids(voxels: DataFrame, col: str, last_x: int, last_y: int) -> DataFrame:
    """(face, col, piece, a, b): for every piece of a label on a side (8-connected) its innermost point, the mean of equals."""
    contacts = images.border_contacts(voxels.select("x", "y", "z", F.col(col).alias("seg")), last_x, last_y)
    # every face is one slice of a volume of faces
    number = F.array_position(F.array(*(F.lit(f) for f in ("x0", "x1", "y0", "y1"))), F.col("face")) - 1
    flat = contacts.select(F.col("a").alias("x"), F.col("b").alias("y"), number.cast("long").alias("z"), "seg")
    pieces = label_slices(flat, "seg").join(flat, ["x", "y", "z"])

    def run(batches):
        held = None
        for batch in batches:
            got = np.stack([np.asarray(c) for c in batch.columns])
            got = got if held is None else np.concatenate([held, got], axis=1)
            cuts = np.flatnonzero((got[:3, 1:] != got[:3, :-1]).any(0)) + 1
            if len(cuts):
                yield _innermost_of(got[:, : cuts[-1]], np.append(0, cuts), col)
            held = got[:, cuts[-1] :] if len(cuts) else got
        if held is not None and held.size:
            yield _innermost_of(held, np.array([0, held.shape[1]]), col)

    # pieces are many and small: a task goes through its own in order, holding one of them and a batch
    keys = ("z", "seg", "component")
    rows = pieces.select(*(F.col(c).cast("long").alias(c) for c in (*keys, "x", "y"))).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, f"face string, {col} long, piece long, a long, b long")


def _innermost_of(rows: np.ndarray, cuts: np.ndarray, col: str) -> pa.RecordBatch:
    """The mean innermost pixel of every piece of rows (face number, label, piece, x, y); a piece lies between two cuts."""
    x0, y0 = np.minimum.reduceat(rows[3], cuts[:-1]), np.minimum.reduceat(rows[4], cuts[:-1])
    x1, y1 = np.maximum.reduceat(rows[3], cuts[:-1]), np.maximum.reduceat(rows[4], cuts[:-1])
    at = np.empty((2, len(x0)), np.int64)
    known: dict[tuple, tuple] = {}
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        g = np.zeros((x1[k] - x0[k] + 3, y1[k] - y0[k] + 3), bool)
        g[rows[3, lo:hi] - x0[k] + 1, rows[4, lo:hi] - y0[k] + 1] = True
        shape = (g.shape, g.tobytes()) if g.size <= 256 else None
        mean = known.get(shape)
        if mean is None:
            d = images.squared_edt(~g)
            i, j = np.nonzero(d == d.max())
            mean = float(i.mean()), float(j.mean())
            if shape is not None:
                known[shape] = mean
        at[:, k] = round(mean[0] + x0[k] - 1), round(mean[1] + y0[k] - 1)
    first = rows[:, cuts[:-1]]
    names = np.array(["x0", "x1", "y0", "y1"])
    return pa.RecordBatch.from_arrays([pa.array(names[first[0]].tolist(), pa.string()), *(pa.array(c) for c in (first[1], first[2], *at))], names=["face", col, "piece", "a", "b"])


def elastic(voxels: DataFrame, col: str, strength: float, sigma: float, seed: int) -> DataFrame:
    """x, y, z, value: every slice sampled at smooth random displacements, drawn from the seed and the slice."""

    def kernel(g, z):
        r = np.random.default_rng((seed, z))
        at = []
        for axis, n in enumerate(g[0].shape):
            move = smooth(r.uniform(-1, 1, g[0].shape), sigma)
            move *= strength / max(1e-12, np.abs(move).max())
            at.append(np.clip(np.rint(np.indices(g[0].shape)[axis] + move), 0, n - 1).astype(int))
        return (g[0][tuple(at)],)

    return _by_slice(voxels, (col,), kernel, "value double")
