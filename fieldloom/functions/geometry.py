"""Geometry of single rings, arrays of (lat, lng) structs, as Column expressions; clipping and simplification as Arrow UDFs. Polygons of parts with holes are in ``polygons``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.mathx import bind, col, lng_scale, mercator

RING = "array<struct<lat:double,lng:double>>"


def point(lat, lng) -> Column:
    return F.struct(col(lat).cast("double").alias("lat"), col(lng).cast("double").alias("lng"))


def rectangle(lat, lng, half_lat, half_lng) -> Column:
    """The ring of a rectangle, from its lower left corner on, counter-clockwise."""
    lat, lng, a, b = map(col, (lat, lng, half_lat, half_lng))
    return F.array(point(lat - a, lng - b), point(lat - a, lng + b), point(lat + a, lng + b), point(lat + a, lng - b))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def following(ring: Column) -> Column:
    """Each point's successor."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def preceding(ring: Column) -> Column:
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def normalize(ring: Column) -> Column:
    """Valid points, without a closing duplicate; null if fewer than three are valid."""
    valid = F.filter(
        ring,
        lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lng"].between(-180, 180) & ~F.isnan(p["lat"]) & ~F.isnan(p["lng"]), F.lit(False)),
    )

    def opened(ok: Column) -> Column:
        first, last = F.get(ok, 0), F.get(ok, F.size(ok) - 1)
        closed = (first["lat"] == last["lat"]) & (first["lng"] == last["lng"])
        return F.when(F.size(ok) >= 3, F.when(closed, F.slice(ok, 1, F.size(ok) - 1)).otherwise(ok))

    return bind(valid, opened)


def close(ring: Column) -> Column:
    """Coordinates (lng, lat) of the closed ring."""
    return F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["lng"], p["lat"]))


def signed_deg2(ring: Column) -> Column:
    """Area in square degrees, positive if the ring runs counter-clockwise; relative to the first point so that no digits cancel."""

    def area(r: Column) -> Column:
        x, y = F.get(r, 0)["lng"], F.get(r, 0)["lat"]
        return total(F.zip_with(r, following(r), lambda a, b: (a["lng"] - x) * (b["lat"] - y) - (b["lng"] - x) * (a["lat"] - y))) / 2

    return bind(ring, area)


def centroid(ring: Column) -> Column:
    """Mean of the vertices."""
    return bind(ring, lambda r: point(total(F.transform(r, lambda p: p["lat"])) / F.size(r), total(F.transform(r, lambda p: p["lng"])) / F.size(r)))


def _metric(ring: Column, center: Column | None, use) -> Column:
    """use(points (x, y) in metres around a centre), each computed once a row."""
    both = F.struct(ring.alias("r"), (centroid(ring) if center is None else center).alias("c"))

    def scaled(b: Column) -> Column:
        return F.struct(b["r"].alias("r"), b["c"].alias("c"), (K.M_PER_DEG * F.cos(F.radians(b["c"]["lat"]))).alias("s"))

    def moved(b: Column) -> Column:
        return F.transform(b["r"], lambda p: F.struct(((p["lng"] - b["c"]["lng"]) * b["s"]).alias("x"), ((p["lat"] - b["c"]["lat"]) * K.M_PER_DEG).alias("y")))

    return bind(bind(bind(both, scaled), moved), use)


def area_m2(ring: Column, center: Column | None = None) -> Column:
    """Shoelace area in metres around the mean vertex; 0 of fewer than three points."""
    area = _metric(ring, center, lambda p: F.abs(total(F.zip_with(p, following(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))) / 2)
    return F.when(F.size(ring) >= 3, area).otherwise(0.0)


def area_deg2(ring: Column) -> Column:
    """Shoelace area in square degrees."""
    return F.abs(signed_deg2(ring))


def area_ha(ring: Column, lat: Column) -> Column:
    """Hectares of the area in degrees, with the lengths of a degree at a latitude."""
    return area_deg2(ring) * K.M_PER_DEG_LAT_HA * (K.M_PER_DEG * F.cos(F.radians(lat))) / 10_000


def perimeter_m(ring: Column, center: Column | None = None) -> Column:
    return _metric(ring, center, lambda p: total(F.zip_with(p, following(p), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))))


def compactness(area: Column, perimeter: Column) -> Column:
    """4 pi area over squared perimeter: 1 of a circle."""
    return F.try_divide(4 * math.pi * area, perimeter * perimeter)


def aspect_ratio(ring: Column) -> Column:
    """Longer over shorter side of the bounding box in metres."""
    lats, lngs = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lng"])
    width = (F.array_max(lngs) - F.array_min(lngs)) * K.M_PER_DEG * lng_scale(total(lats) / F.size(ring))
    height = (F.array_max(lats) - F.array_min(lats)) * 110_574.0
    return F.try_divide(F.greatest(width, height), F.least(width, height))


def contains(ring: Column, lat, lng) -> Column:
    """Even-odd rule."""
    y, x = col(lat), col(lng)
    crosses = F.zip_with(
        ring,
        preceding(ring),
        lambda i, j: ((i["lat"] > y) != (j["lat"] > y)) & F.coalesce(x < F.try_divide((j["lng"] - i["lng"]) * (y - i["lat"]), j["lat"] - i["lat"]) + i["lng"], F.lit(False)),
    )
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def meets_circle(ring: Column, lat, lng, radius_km) -> Column:
    """Whether a polygon holds the centre, or comes within the radius with a vertex or an edge."""
    y, x, r = col(lat), col(lng), col(radius_km)
    scale = K.KM_PER_DEG_LNG * F.cos(F.radians(y))
    p = F.transform(ring, lambda q: F.struct(((q["lng"] - x) * scale).alias("x"), ((q["lat"] - y) * K.KM_PER_DEG_LAT).alias("y")))
    near = F.zip_with(p, following(p), lambda a, b: (F.hypot(a["x"], a["y"]) <= r) | (segment_distance(0.0, 0.0, a["x"], a["y"], b["x"], b["y"]) <= r))
    return contains(ring, y, x) | F.exists(near, lambda v: v)


def offset(lat, lng, east_km, north_km) -> Column:
    return point(col(lat) + col(north_km) / K.KM_PER_DEG_LAT, col(lng) + col(east_km) / (K.KM_PER_DEG_LNG * lng_scale(lat)))


def square_around(lat, lng, half_km) -> Column:
    h = col(half_km)
    return F.array(offset(lat, lng, -h, -h), offset(lat, lng, h, -h), offset(lat, lng, h, h), offset(lat, lng, -h, h))


def circle(lat, lng, radius_km, vertices: int = 48) -> Column:
    """Vertices of a circle, from the east on, counter-clockwise."""
    y, x, r = col(lat), col(lng), col(radius_km) * 1000
    scale = lng_scale(y)
    angles = F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda k: k / vertices * (2 * math.pi))
    return F.transform(angles, lambda a: point(y + F.sin(a) * r / 110_574.0, x + F.cos(a) * r / (K.M_PER_DEG * scale)))


def pixel_grid(ring: Column) -> dict[str, Column]:
    """Mercator grid around a ring: a pixel of about ten metres, a pixel of margin, at most 400 pixels a side."""
    xs = F.transform(ring, lambda p: mercator(p["lng"], p["lat"])[0])
    ys = F.transform(ring, lambda p: mercator(p["lng"], p["lat"])[1])
    pad = K.ZONING_SCALE_M
    x0, x1, y0, y1 = F.array_min(xs) - pad, F.array_max(xs) + pad, F.array_min(ys) - pad, F.array_max(ys) + pad
    scale = pad * F.greatest(F.lit(1.0), F.greatest((x1 - x0) / pad, (y1 - y0) / pad) / K.ZONING_MAX_PX)
    size = lambda a, b: F.greatest(F.lit(2).cast("long"), F.floor((b - a) / scale + 0.5))
    return {"width_px": size(x0, x1), "height_px": size(y0, y1), "scale_m": scale, "origin_x": x0, "origin_y": y1}


# Operations that no composition of built-in functions expresses well: one Arrow batch at a time.


def _array(ring) -> np.ndarray:
    """(n, 2) of (lng, lat)."""
    return np.array([(p["lng"], p["lat"]) for p in ring], float).reshape(-1, 2)


def _axes(ring: Column) -> tuple[Column, Column]:
    """Longitudes and latitudes as plain arrays, which reach Python without an object for each point."""
    return F.transform(ring, lambda p: p["lng"]), F.transform(ring, lambda p: p["lat"])


def _joined(x, y) -> np.ndarray:
    return np.column_stack([x, y]) if x is not None and y is not None else np.zeros((0, 2))


def hull_area(p: np.ndarray) -> float:
    """Area of the convex hull (monotone chain)."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return 0.0

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return shoelace(np.array(half(pts) + half(pts[::-1])))


def shoelace(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def signed(points: list[tuple[float, float]]) -> float:
    """Area of a ring of (x, y), positive if it runs counter-clockwise."""
    p = np.array(points, float) - points[0]
    return float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2


def upright(ring: Column) -> Column:
    """Whether a ring is a rectangle along the axes."""
    p = [F.get(ring, k) for k in range(4)]
    along = lambda a, b: (p[0][a] == p[1][a]) & (p[1][b] == p[2][b]) & (p[2][a] == p[3][a]) & (p[3][b] == p[0][b])
    return F.coalesce((F.size(ring) == 4) & (along("lat", "lng") | along("lng", "lat")), F.lit(False))


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex counter-clockwise window, one half-plane after the other; those that hold the whole ring are passed over."""
    if not len(subject):
        return subject
    step = np.roll(window, -1, 0) - window
    sides = step[:, :1] * (subject[:, 1] - window[:, 1:]) - step[:, 1:] * (subject[:, 0] - window[:, :1])
    if (sides < 0).all(1).any():
        return subject[:0]
    out = subject
    for k in np.flatnonzero((sides < 0).any(1)):
        if not len(out):
            break
        a, d = window[k], step[k]
        side = d[0] * (out[:, 1] - a[1]) - d[1] * (out[:, 0] - a[0])
        before, side_before = np.roll(out, 1, 0), np.roll(side, 1)
        nxt = []
        for p, s, q, r in zip(out, side.tolist(), before, side_before.tolist(), strict=True):
            if (s >= 0) != (r >= 0):
                nxt.append(q + (p - q) * (r / (r - s)))
            if s >= 0:
                nxt.append(p)
        out = np.array(nxt).reshape(-1, 2)
    return out


#: Rings clipped at once, and the points up to which a ring is clipped with others.
CLIP_ROWS, CLIP_POINTS = 4_096, 16


def clip_each(subjects: list[np.ndarray], windows: np.ndarray) -> list[np.ndarray]:
    """``clip_convex`` of each ring with its own window (all of as many points), with the same numbers: small rings side by side in padded arrays, half-plane by half-plane."""
    out = [s if len(s) <= CLIP_POINTS else clip_convex(s, w) for s, w in zip(subjects, windows, strict=True)]
    small = np.flatnonzero([0 < len(s) <= CLIP_POINTS for s in subjects])
    for at in range(0, len(small), CLIP_ROWS):
        rows = small[at : at + CLIP_ROWS]
        n = np.array([len(subjects[r]) for r in rows])
        points = np.zeros((len(rows), n.max(), 2))
        points[np.arange(n.max()) < n[:, None]] = np.concatenate([subjects[r] for r in rows])
        window = windows[rows]
        step = np.roll(window, -1, 1) - window
        real = np.arange(n.max()) < n[:, None]
        off = step[:, :, :1] * (points[:, None, :, 1] - window[:, :, 1:]) - step[:, :, 1:] * (points[:, None, :, 0] - window[:, :, :1]) < 0
        n[(off | ~real[:, None]).all(2).any(1)] = 0
        cut = (off & real[:, None]).any(2)
        for k in range(window.shape[1]):
            rs = np.flatnonzero(cut[:, k] & (n > 0))
            if not len(rs):
                continue
            p, a, d = points[rs], window[rs, k], step[rs, k]
            place = np.arange(p.shape[1])
            real, before = place < n[rs, None], np.where(place > 0, place - 1, n[rs, None] - 1)
            s = d[:, :1] * (p[:, :, 1] - a[:, 1:]) - d[:, 1:] * (p[:, :, 0] - a[:, :1])
            q, r = np.take_along_axis(p, before[:, :, None], 1), np.take_along_axis(s, before, 1)
            crosses = ((s >= 0) != (r >= 0)) & real
            met = q + (p - q) * np.divide(r, r - s, out=np.zeros_like(s), where=crosses)[:, :, None]
            both = np.stack([met, p], 2).reshape(len(rs), -1, 2)
            stays = np.stack([crosses, (s >= 0) & real], 2).reshape(len(rs), -1)
            n[rs] = stays.sum(1)
            most = int(n[rs].max())
            first = np.argsort(~stays, 1, kind="stable")[:, :most]
            if most > points.shape[1]:
                points = np.pad(points, ((0, 0), (0, most - points.shape[1]), (0, 0)))
            points[rs, :most] = np.take_along_axis(both, first[:, :, None], 1)
        for r, p, m in zip(rows, points, n, strict=True):
            out[r] = p[:m]
    return out


def clip_to_circle(lat, lng, radius_km):
    """A ring's part inside a circle of 48 vertices (of constants or of each row's columns), as a ring, by an Arrow UDF; empty if there is none."""
    angle = np.arange(48) / 48 * 2 * math.pi
    unit = np.column_stack([np.cos(angle), np.sin(angle)])

    @F.pandas_udf("x array<double>, y array<double>")
    def run(xs: pd.Series, ys: pd.Series, lats: pd.Series, lngs: pd.Series, radii: pd.Series) -> pd.DataFrame:
        rings, frames = [], []
        for p, y, x in zip(map(_joined, xs, ys), lats, lngs, strict=True):
            if len(p) > 1 and (p[0] == p[-1]).all():
                p = p[:-1]
            scale, origin = np.array([K.M_PER_DEG * max(abs(math.cos(math.radians(y))), 0.1), 110_574.0]), np.array([x, y])
            rings.append((p - origin) * scale)
            frames.append((scale, origin))
        clipped = clip_each(rings, unit * radii.to_numpy(float)[:, None, None] * 1000)
        out = [c / scale + origin for c, (scale, origin) in zip(clipped, frames, strict=True)]
        return pd.DataFrame({"x": [o[:, 0] for o in out], "y": [o[:, 1] for o in out]})

    once = run.asNondeterministic()  # or else filters on the result would run it again
    return lambda ring: bind(once(*_axes(ring), col(lat), col(lng), col(radius_km)), lambda c: F.zip_with(c["x"], c["y"], lambda x, y: point(y, x)))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with a stack: points off the chord of their run by more than the tolerance stay."""
    n = len(points)
    if n <= 2:
        return points
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        inner = points[i + 1 : j] - a
        length = float(d @ d)
        away = inner if length == 0 else inner - np.outer(inner @ d / length, d)
        far = np.hypot(away[:, 0], away[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def simplified(tolerance: float):
    """Arrow UDF: the simplified ring."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"lat": float(y), "lng": float(x)} for x, y in simplify(_array(r), tolerance)] for r in rings], dtype=object)

    return run
