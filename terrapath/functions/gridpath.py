"""Least-cost paths on one small search grid, all grades at once (runs inside Spark tasks)."""

from __future__ import annotations

import numpy as np

from terrapath import config as C
from terrapath.functions.tracing import destination, haversine

MOVES = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]  # fixed value: neighbour order
#: Nodes, counted once for each grade, that are relaxed together.
SWEPT_NODES = 200_000


def search_grid(lon, lat, tlon, tlat, direct, most=None):
    """Coordinates (n, n) of the rotated grid around start and target; ``most``: greatest n, beyond which the grid ends early."""
    extent = direct * (1 + 2 * C.GRID_BUFFER)
    n = int(extent / C.GRID_STEP_M) + 1
    n = n if most is None else min(n, most)
    mid_lon, mid_lat = (lon + tlon) / 2, (lat + tlat) / 2
    dlam = np.radians(tlon - mid_lon)
    p1, p2 = np.radians(mid_lat), np.radians(tlat)
    y = np.sin(dlam) * np.cos(p2)
    x = np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(dlam)
    ahead = (np.degrees(np.arctan2(y, x)) + 360.0) % 360.0
    turn = lambda d: np.radians((ahead + d) % 360.0)
    o_lon, o_lat = destination(mid_lon, mid_lat, turn(180.0), extent / 2)
    o_lon, o_lat = destination(o_lon, o_lat, turn(-90.0), extent / 2)
    along = np.arange(n) * C.GRID_STEP_M
    c_lon, c_lat = destination(o_lon, o_lat, turn(90.0), along)
    return destination(c_lon[None, :], c_lat[None, :], turn(0.0), along[:, None])


def _views(n: int, dr: int, dc: int):
    """Slices of all cells that have the neighbour (source) and of those neighbours (destination)."""
    cut = lambda d: (slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d)))
    (r0, r1), (c0, c1) = cut(dr), cut(dc)
    return (r0, c0), (r1, c1)


def edge_cost(dist, drop, target):
    """Distance weighted by slope deviation and, uphill, by the climb; infinite for a null step."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        slope = drop / dist * 100.0
        cost = dist * np.exp(np.abs(slope - target) / C.COST_SIGMA)
        cost = np.where(slope < 0, cost * np.exp(np.abs(slope) / C.COST_SIGMA), cost)
    return np.where(dist < C.MIN_EDGE_M, np.inf, cost)


def edge_means(lons, lats, z, target):
    """Number of directed edges between neighbours, mean distance, mean slope (absolute) and mean logarithm of the cost.

    Edges without a slope (an elevation is missing, or no distance) count in the first two only.
    """
    n, far, steep, dear, seen, priced = 0, 0.0, 0.0, 0.0, 0, 0
    for dr, dc in MOVES:
        a, b = _views(lons.shape[0], dr, dc)
        d, drop = haversine(lons[a], lats[a], lons[b], lats[b]), z[a] - z[b]
        n, far = n + d.size, far + d.sum()
        known = ~np.isnan(drop) & (d > 0)
        d, drop = d[known], drop[known]
        seen, steep = seen + d.size, steep + np.abs(drop / d * 100.0).sum()
        wide = d >= C.MIN_EDGE_M
        priced, dear = priced + int(wide.sum()), dear + np.log(edge_cost(d[wide], drop[wide], target)).sum()
    mean = lambda total, count: float(total / count) if count else None
    return n, mean(far, n), mean(steep, seen), mean(dear, priced)


def nearest(lons, lats, lon, lat):
    """Row-major first grid node closest to a point."""
    return np.unravel_index(int(np.argmin(haversine(lons, lats, lon, lat))), lons.shape)


def least_cost(lons, lats, z, start, target, grades):
    """Relax all edges until nothing improves; returns per grade (cost, rows, cols) or None.

    Grades do not touch each other: those of a large grid are relaxed a few at a time, so that some 100 bytes a node are held.
    """
    n = lons.shape[0]
    many = max(1, SWEPT_NODES // (n * n))
    if many < len(grades):
        return [hit for i in range(0, len(grades), many) for hit in least_cost(lons, lats, z, start, target, grades[i : i + many])]
    t = np.asarray(grades)[:, None, None]
    moves = []
    for dr, dc in MOVES:
        a, b = _views(n, dr, dc)
        d = haversine(lons[a], lats[a], lons[b], lats[b])
        moves.append((a, b, edge_cost(d[None], (z[a] - z[b])[None], t)))
    best = np.full((len(grades), n, n), np.inf)
    best[:, start[0], start[1]] = 0.0
    back = np.full(best.shape, -1, dtype=np.int8)
    changed = True
    while changed:
        changed = False
        for k, (a, b, cost) in enumerate(moves):
            here, move = best[(slice(None), *b)], back[(slice(None), *b)]
            offer = best[(slice(None), *a)] + cost
            # only a strict gain moves the predecessor: tiny edges behind a huge one stay free of cycles
            gain = offer < here
            if gain.any():
                changed = True
                np.copyto(here, offer, where=gain)
                move[gain] = k
    out = []
    for g in range(len(grades)):
        if not np.isfinite(best[g, target[0], target[1]]):
            out.append(None)
            continue
        r, c = target
        rows, cols = [int(r)], [int(c)]
        while (r, c) != tuple(start):
            dr, dc = MOVES[back[g, r, c]]
            r, c = r - dr, c - dc
            rows.append(int(r))
            cols.append(int(c))
        out.append((float(best[g, target[0], target[1]]), rows[::-1], cols[::-1]))
    return out
