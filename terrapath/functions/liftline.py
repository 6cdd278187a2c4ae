"""Lift lines and pylon search inside tasks: stations to line points, elevations to pylon indices.

Line points use the C library through ``math``, so that their last bits do not hang on the engine: a sample on the
edge of a raster cell or a tie on level ground would else be told differently.  The search takes all lifts of a
batch at once.
"""

from __future__ import annotations

import math

import numpy as np

from terrapath import config as C


def line_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    if not all(map(math.isfinite, (lat1, lon1, lat2, lon2))):
        return math.nan
    a = math.pow(math.sin(math.radians(lat2 - lat1) / 2), 2.0) + math.cos(math.radians(lat1)) * math.cos(
        math.radians(lat2)
    ) * math.pow(math.sin(math.radians(lon2 - lon1) / 2), 2.0)
    return 2 * C.EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1.0 - a)))


def line_points(lon1: float, lat1: float, lon2: float, lat2: float) -> tuple[list, list]:
    """Longitudes and latitudes every 30 m from station to station; three points, the middle unknown, where an end is."""
    if any(v is None or not math.isfinite(v) for v in (lon1, lat1, lon2, lat2)):
        return [lon1, None, lon2], [lat1, None, lat2]
    d = line_m(lat1, lon1, lat2, lon2)
    n = 1 if d < C.LIFT_SAMPLE_M else max(2, int(d / C.LIFT_SAMPLE_M))
    lons, lats = [lon1], [lat1]
    if n > 1:
        lam, phi, dlam, phi2 = math.radians(lon1), math.radians(lat1), math.radians(lon2 - lon1), math.radians(lat2)
        sin_phi, cos_phi = math.sin(phi), math.cos(phi)
        y = math.sin(dlam) * math.cos(phi2)
        x = cos_phi * math.sin(phi2) - sin_phi * math.cos(phi2) * math.cos(dlam)
        bearing = math.radians(math.fmod(math.fmod(math.degrees(math.atan2(y, x)) + 360.0, 360.0) + 360.0, 360.0))
        sin_b, cos_b = math.sin(bearing), math.cos(bearing)
        for i in range(1, n):
            delta = d * (i / n) / C.EARTH_RADIUS_M
            sin_d, cos_d = math.sin(delta), math.cos(delta)
            to = math.asin(sin_phi * cos_d + cos_phi * sin_d * cos_b)
            lons.append(math.degrees(lam + math.atan2(sin_b * sin_d * cos_phi, cos_d - sin_phi * math.sin(to))))
            lats.append(math.degrees(to))
    return [*lons, lon2], [*lats, lat2]


def _clear(lift, s, e, zs, ze, z, first, par):
    """Where pylons are needed in spans s..e of ``lift`` so that the cable keeps its clearance: (lift, index).

    The worst violation of a span gets a pylon, and both halves are looked at in the next round.
    """
    none = np.array([], dtype=np.int64)
    found = [(none, none)]
    while lift.size:
        lo, hi = s + par["min_idx"][lift], e - par["min_idx"][lift]
        open_ = lo <= hi
        lift, s, e, zs, ze, lo, hi = (a[open_] for a in (lift, s, e, zs, ze, lo, hi))
        if not lift.size:
            break
        size = hi - lo + 1
        start = np.cumsum(size) - size
        span = np.repeat(np.arange(lift.size), size)
        i = np.arange(span.size) - start[span] + lo[span]
        t = (i - s[span]) / (e - s)[span]
        width = par["sag"][lift] * ((e - s) * par["step"][lift])
        cable = (1 - t) * zs[span] + t * ze[span] - 4.0 * width[span] * t * (1 - t)
        gap = par["clearance"][lift][span] - (cable - z[first[lift][span] + i])
        worst = np.fmax.reduceat(gap, start)
        hit = np.flatnonzero((gap == worst[span]) & (gap > 0))
        hit = hit[np.diff(span[hit], prepend=-1) > 0]
        k, w = span[hit], i[hit]
        found.append((lift[k], w))
        top = z[first[lift[k]] + w] + par["height"][lift[k]]
        two = lambda a, b: np.concatenate([a, b])
        lift, s, e, zs, ze = two(lift[k], lift[k]), two(s[k], w), two(w, e[k]), two(zs[k], top), two(top, ze[k])
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def pylon_search(z, sizes, length_m, min_spacing, max_spacing, clearance, height, station, sag):
    """Pylon indices of many lifts after the clearance pass, after spacing and after the last clearance pass.

    ``z``: elevations of all lifts in a row, ``sizes`` of them each; the rest one value a lift.  Returns three pairs
    (lift, index), ordered.  Lifts below three points have none; an unknown value asks for no pylon.
    """
    first = np.cumsum(sizes) - sizes
    with np.errstate(divide="ignore", invalid="ignore"):
        step = length_m / (sizes - 1)
        whole = lambda v, unknown: np.trunc(np.clip(np.where(np.isnan(v), unknown, v), 0, 2**31 - 1)).astype(np.int64)
        min_idx, max_idx = np.maximum(2, whole(min_spacing / step, 0)), whole(max_spacing / step, 2**31 - 1)
    par = {"step": step, "min_idx": min_idx, "clearance": clearance, "height": height, "sag": sag}
    lifts = np.flatnonzero(sizes >= 3)
    width = int(sizes.max(initial=0)) + 1
    ends = np.concatenate([lifts * width, lifts * width + sizes[lifts] - 1])

    def spans(keys):
        """Spans between neighbouring anchors: lift, start, end."""
        keys = np.union1d(ends, keys)
        lift, idx = keys // width, keys % width
        same = lift[1:] == lift[:-1]
        return lift[1:][same], idx[:-1][same], idx[1:][same]

    def clear(keys):
        lift, s, e = spans(keys)

        def level(i):
            at_end = (i == 0) | (i == sizes[lift] - 1)
            return z[first[lift] + i] + np.where(at_end, station[lift], height[lift])

        k, w = _clear(lift, s, e, level(s), level(e), z, first, par)
        return np.union1d(keys, k * width + w)

    one = clear(np.array([], dtype=np.int64))
    two = one
    for _ in range(C.SPACING_ROUNDS):
        lift, s, e = spans(two)
        mid = (s + e) // 2
        more = (e - s > max_idx[lift]) & (mid > s)
        if not more.any():
            break
        two = np.union1d(two, (lift * width + mid)[more])
    return [(keys // width, keys % width) for keys in (one, two, clear(two))]


def cable_points(lon, lat, sizes, length_m, x, y, anchors, y_start, y_end, sag):
    """Cable vertices of many lifts: parabolic sag between the stations and pylon tops, one part per 20 m, at least ten.

    ``lon``, ``lat``: line points of all lifts in a row, ``sizes`` of them each; ``x``, ``y``: distance and top of the
    pylons, ``anchors`` of them each; the rest one value a lift.  Returns lift, lon, lat and elevation of each vertex.
    """
    n_lifts = len(sizes)
    every = np.arange(n_lifts)
    owner = np.concatenate([every, np.repeat(every, anchors), every])
    kind = np.repeat([0, 1, 2], [n_lifts, len(x), n_lifts])
    x, y = np.concatenate([np.zeros(n_lifts), x, length_m]), np.concatenate([y_start, y, y_end])
    order = np.lexsort((x, kind, owner))
    owner, kind, x, y = owner[order], kind[order], x[order], y[order]
    width = x[1:] - x[:-1]
    with np.errstate(invalid="ignore"):
        a = np.flatnonzero((owner[1:] == owner[:-1]) & (width > 0) & (sizes[owner[1:]] > 0))
    width, lift = width[a], owner[a]
    pieces = np.maximum(10, (width / 20.0).astype(np.int64))
    from_ = np.where(kind[a] > 0, 1, 0)
    count = pieces + 1 - from_
    span = np.repeat(np.arange(len(a)), count)
    i = np.arange(len(span)) - (np.cumsum(count) - count - from_)[span]
    lift, width, pieces, a = lift[span], width[span], pieces[span], a[span]
    pos = (x[a] + width * i / pieces) / length_m[lift] * (sizes[lift] - 1)
    low = np.minimum(pos.astype(np.int64), sizes[lift] - 1)
    first = (np.cumsum(sizes) - sizes)[lift]
    p, q, f = first + low, first + np.minimum(low + 1, sizes[lift] - 1), pos - low
    t = i / pieces
    z = (1 - t) * y[a] + t * y[a + 1] - 4.0 * (sag[lift] * width) * t * (1 - t)
    return lift, lon[p] + (lon[q] - lon[p]) * f, lat[p] + (lat[q] - lat[p]) * f, z
