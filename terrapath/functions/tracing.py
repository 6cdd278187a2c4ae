"""Vectorised step rule for downhill traces on one raster patch (runs inside Spark tasks)."""

from __future__ import annotations

import numpy as np

from terrapath import config as C
from terrapath.sources.dem import DemMeta

RING_R = np.repeat([r for r, _ in C.RINGS], len(C.RING_BEARINGS))
RING_W = np.repeat([w for _, w in C.RINGS], len(C.RING_BEARINGS))
RING_B = np.radians(np.tile(C.RING_BEARINGS, len(C.RINGS)))


def destination(lon, lat, theta, dist):
    """Point on a bearing (radians) at a distance; degrees in and out."""
    delta = dist / C.EARTH_RADIUS_M
    phi = np.radians(lat)
    sin_phi2 = np.sin(phi) * np.cos(delta) + np.cos(phi) * np.sin(delta) * np.cos(theta)
    lam = np.radians(lon) + np.arctan2(
        np.sin(theta) * np.sin(delta) * np.cos(phi), np.cos(delta) - np.sin(phi) * sin_phi2
    )
    return np.degrees(lam), np.degrees(np.arcsin(sin_phi2))


def haversine(lon1, lat1, lon2, lat2):
    a = (
        np.sin(np.radians(lat2 - lat1) / 2) ** 2
        + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * C.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


class Patch:
    """A window of the raster held as a dense array; NaN marks missing cells."""

    def __init__(self, meta: DemMeta, rows, cols, heights):
        """``cols``, ``heights``: per raster row its columns, ascending, and their elevations."""
        self.meta = meta
        self.r0, self.c0 = int(min(rows)), int(min(c[0] for c in cols))
        width = int(max(c[-1] for c in cols)) - self.c0 + 1
        self.z = np.full((int(max(rows)) - self.r0 + 1, width), np.nan)
        for row, col, z in zip(rows, cols, heights, strict=True):
            self.z[row - self.r0, np.asarray(col) - self.c0] = np.asarray(z, dtype=float)

    @classmethod
    def of(cls, meta: DemMeta, strips):
        """From the rows of ``tile_strips``."""
        return cls(meta, strips["row"].to_numpy(), strips["cols"].tolist(), strips["heights"].tolist())

    def inside(self, lon, lat):
        west, south, east, north = self.meta.bounds
        return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)

    def elevation(self, lon, lat):
        m = self.meta
        row = np.trunc((m.y0 - lat * m.scale) / m.dy).astype(np.int64)
        col = np.trunc((lon * m.scale - m.x0) / m.dx).astype(np.int64)
        ok = (row >= 0) & (row < m.n_rows) & (col >= 0) & (col < m.n_cols)
        r, c = np.where(ok, row - self.r0, 0), np.where(ok, col - self.c0, 0)
        if r.size and (r.min() < 0 or c.min() < 0 or r.max() >= self.z.shape[0] or c.max() >= self.z.shape[1]):
            raise IndexError("trace left its raster patch: the halo is too small for this path length")
        return np.where(ok, self.z[r, c], np.nan)

    def gradient(self, lon, lat, z):
        """Slope % and fall line from 16 ring samples around each point."""
        slon, slat = destination(lon[:, None], lat[:, None], RING_B, RING_R)
        sz = self.elevation(slon, slat)
        seen = self.inside(slon, slat) & ~np.isnan(sz)
        slope = np.where(seen, (z[:, None] - sz) / RING_R * 100.0, 0.0) * RING_W
        weight = np.where(seen, RING_W, 0.0).sum(axis=1)
        safe = np.where(weight > 0, weight, 1.0)
        gx, gy = (slope * np.sin(RING_B)).sum(axis=1) / safe, (slope * np.cos(RING_B)).sum(axis=1) / safe
        return np.hypot(gx, gy), np.mod(np.degrees(np.arctan2(gx, gy)) + 360.0, 360.0)


def wrap(turn):
    """Into [-180, 180] keeping both ends."""
    turn = np.where(turn > 180, turn - 360, turn)
    return np.where(turn < -180, turn + 360, turn)


def trace(patch: Patch, lon, lat, target, sign, length, gauss=None):
    """Trace many paths at once; returns (n, steps+1) arrays of lon, lat, z padded with NaN."""
    n, steps = len(lon), int(np.ceil(length.max() / C.STEP_M)) + 1 if len(lon) else 0
    out = np.full((3, n, steps + 1), np.nan)
    z = patch.elevation(lon, lat)
    out[:, :, 0] = lon, lat, z
    dist, fallen = np.zeros(n), np.zeros(n)
    recent, seen = np.zeros((n, C.BEARING_MEMORY)), np.zeros(n, dtype=int)
    live = np.flatnonzero(~np.isnan(z) & (length > 0))
    for step in range(1, steps + 1):
        live = live[dist[live] < length[live]]
        if not live.size:
            break
        x, y, h, t = out[0, live, step - 1], out[1, live, step - 1], out[2, live, step - 1], target[live]
        left = length[live] - dist[live]
        wanted = (t / 100.0 * length[live] - fallen[live]) / left * 100.0
        wanted = np.where(left > C.STEP_M, np.maximum(C.MIN_SKIABLE_PCT, np.minimum(t * 2.5, wanted)), t)
        slope, fall = patch.gradient(x, y, h)
        steep = (slope > 0) & (wanted < slope)
        ratio = np.clip(np.where(steep, wanted / np.where(slope > 0, slope, 1.0), 1.0), -1.0, 1.0)
        angle = np.where(
            steep, np.clip(np.degrees(np.arccos(ratio)), C.MIN_TRAVERSE_DEG, C.MAX_TRAVERSE_DEG), C.MIN_TRAVERSE_DEG
        )
        bearing = fall + sign[live] * angle
        if gauss is not None:
            bearing = bearing + gauss[live, step - 1] * C.BASE_NOISE_DEG * np.maximum(0.0, (90.0 - angle) / 90.0)
        bearing = np.mod(bearing, 360.0)
        # momentum on flat ground
        count = np.minimum(seen[live], C.BEARING_MEMORY)
        known = np.arange(C.BEARING_MEMORY) < count[:, None]
        rad = np.radians(recent[live])
        mean = np.mod(
            np.degrees(np.arctan2(np.where(known, np.sin(rad), 0).sum(axis=1), np.where(known, np.cos(rad), 0).sum(axis=1))),
            360.0,
        )
        pull = C.MOMENTUM_WEIGHT * (1.0 - slope / C.FLAT_TERRAIN_PCT)
        blended = np.mod(mean + (1.0 - pull) * wrap(bearing - mean), 360.0)
        bearing = np.where((slope < C.FLAT_TERRAIN_PCT) & (count >= 2), blended, bearing)
        # bounded turn
        last = recent[live, (seen[live] - 1) % C.BEARING_MEMORY]
        turn = wrap(bearing - last)
        sharp = (seen[live] > 0) & (np.abs(turn) > C.MAX_TURN_DEG)
        bearing = np.where(sharp, np.mod(last + np.sign(turn) * C.MAX_TURN_DEG, 360.0), bearing)
        recent[live, seen[live] % C.BEARING_MEMORY] = bearing
        seen[live] += 1
        nx, ny = destination(x, y, np.radians(bearing), C.STEP_M)
        nz = np.where(patch.inside(nx, ny), patch.elevation(nx, ny), np.nan)
        go = ~np.isnan(nz)
        live, nx, ny, nz = live[go], nx[go], ny[go], nz[go]
        dist[live] += haversine(x[go], y[go], nx, ny)
        fallen[live] += h[go] - nz
        out[:, live, step] = nx, ny, nz
    return out, dist
