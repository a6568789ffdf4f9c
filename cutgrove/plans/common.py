"""What the query modules share: derived tables in both languages."""

from __future__ import annotations

from cutgrove.operators import rag
from cutgrove.sources.volumes import VOX_SQL, event_voxels

PAIRS_SQL = """pairs AS (
  SELECT a.*, b.seg AS next_seg, b.pm AS next_pm, b.raw AS next_raw, 0 AS axis FROM vox a JOIN vox b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z
  UNION ALL SELECT a.*, b.seg, b.pm, b.raw, 1 FROM vox a JOIN vox b ON b.x = a.x AND b.y = a.y + 1 AND b.z = a.z
  UNION ALL SELECT a.*, b.seg, b.pm, b.raw, 2 FROM vox a JOIN vox b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1)"""
FACES_SQL = "faces AS (SELECT least(seg, next_seg) AS u, greatest(seg, next_seg) AS v, axis, x, y, z, pm + next_pm AS w FROM pairs WHERE seg <> next_seg)"
EDGES_SQL = "edges AS (SELECT u, v, count(*) AS n, CASE WHEN max(axis) = 2 THEN 0 ELSE 1 END AS kind, CAST(sum(w) AS BIGINT) AS s FROM faces GROUP BY u, v)"
NODES_SQL = "nodes AS (SELECT seg, count(*) AS n, CAST(sum(raw) AS BIGINT) AS total, min(raw) AS low, max(raw) AS high, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM vox GROUP BY seg)"
GT_SQL = "node_gt AS (SELECT seg, gt, n FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, gt) AS r FROM (SELECT seg, gt, count(*) AS n FROM vox GROUP BY seg, gt)) WHERE r = 1)"
COST_SQL = "costs AS (SELECT *, ln((1 - q) / q) AS e FROM (SELECT *, 0.001 + 0.998 * (s / (n * 200000.0)) AS q FROM edges))"
WITH_VOX = f"WITH {VOX_SQL} "
WITH_PAIRS = f"WITH {VOX_SQL}, {PAIRS_SQL} "
WITH_FACES = f"WITH {VOX_SQL}, {PAIRS_SQL}, {FACES_SQL} "
WITH_EDGES = f"WITH RECURSIVE {VOX_SQL}, {PAIRS_SQL}, {FACES_SQL}, {EDGES_SQL}, {NODES_SQL}, {GT_SQL}, {COST_SQL} "


def vox(spark, sf_dir):
    return event_voxels(spark, sf_dir)


def faces(spark, sf_dir):
    return rag.faces(vox(spark, sf_dir))


def edges(spark, sf_dir):
    return rag.edges(faces(spark, sf_dir))


def bank_sql(col: str, scales: tuple, extent: int = 10) -> str:
    """CTE fb(x, y, z, scale, smooth, log, hessian_high, hessian_low): Gaussian filters of vox in every slice as weighted joins.

    ``weight`` says what a pixel at ``p`` adds to one at ``x`` along an axis, for the order of the derivative; borders are
    reflected, kernels reach three scales to either side, and the second derivative's weights sum to 0.
    """
    names = ", ".join(f"('{str(s).replace('.', '_')}', {s}::DOUBLE, {int(-(-3 * s // 1))})" for s in scales)
    turn = 2 * extent - 2
    return f"""scales(scale, s, r) AS (VALUES {names}), taps AS (SELECT scale, s, r, unnest(range(-r, r + 1)) AS t FROM scales),
  k0 AS (SELECT *, exp(-t * t / (2 * s * s)) / sum(exp(-t * t / (2 * s * s))) OVER (PARTITION BY scale) AS k FROM taps),
  kernel AS (SELECT scale, t, 0 AS o, k FROM k0 UNION ALL SELECT scale, t, 1, -t / (s * s) * k FROM k0
    UNION ALL SELECT scale, t, 2, (t * t / (s * s * s * s) - 1 / (s * s)) * k - avg((t * t / (s * s * s * s) - 1 / (s * s)) * k) OVER (PARTITION BY scale) FROM k0),
  hits AS (SELECT scale, o, x, (((x + t) % {turn}) + {turn}) % {turn} AS m, k FROM kernel, range({extent}) AS r(x)),
  weight AS (SELECT scale, o, x, CASE WHEN m < {extent} THEN m ELSE {turn} - m END AS p, sum(k) AS w FROM hits GROUP BY ALL),
  across AS (SELECT w.scale, w.o, w.x, v.y, v.z, sum(w.w * v.{col}) AS g FROM weight w JOIN vox v ON v.x = w.p GROUP BY ALL),
  both_axes AS (SELECT a.scale, a.o AS ox, w.o AS oy, a.x, w.x AS y, a.z, sum(w.w * a.g) AS g FROM across a JOIN weight w ON w.scale = a.scale AND w.p = a.y WHERE a.o + w.o IN (0, 2) GROUP BY ALL),
  parts AS (SELECT scale, x, y, z, max(g) FILTER (ox = 0 AND oy = 0) AS smooth, max(g) FILTER (ox = 2) AS xx, max(g) FILTER (oy = 2) AS yy, max(g) FILTER (ox = 1) AS xy FROM both_axes GROUP BY ALL),
  fb AS MATERIALIZED (SELECT x, y, z, scale, smooth, xx + yy AS log, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS hessian_high, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS hessian_low FROM parts)"""


BANK = ("smooth", "log", "hessian_high", "hessian_low")


def bank_names(scales: tuple) -> list[tuple[str, str, str]]:
    """(column, kind, scale) of every filter."""
    return [(f"{kind}_{s}", kind, s) for s in (str(s).replace(".", "_") for s in scales) for kind in BANK]
