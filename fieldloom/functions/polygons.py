"""Polygons of parts and rings: shapes, arrays of parts, each an array of rings (the outer one, then holes) of (lat, lng) points.

Predicates and measures go edge by edge and ring by ring, in Columns. Shapes that cross themselves are repaired once, by an arrangement of their
edges; after that, a shape is cut into trapezoids between the ordinates of its vertices, and the area that two shapes share is a
sum over pairs of trapezoids in closed form, without Python.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions import geometry as G
from fieldloom.functions.mathx import bind, col, lng_scale

SHAPE = f"array<array<{G.RING}>>"
TRAPEZOID = "struct<y0:double,y1:double,l0:double,l1:double,r0:double,r1:double>"


def of_ring(ring: Column) -> Column:
    """The shape of one ring without holes."""
    return F.when(ring.isNotNull(), F.array(F.array(ring)))


def rings(shape: Column) -> Column:
    return F.flatten(shape)


def outers(shape: Column) -> Column:
    """The outer ring of each part."""
    return F.transform(shape, lambda part: F.get(part, 0))


def points(shape: Column) -> Column:
    return F.flatten(F.flatten(shape))


def edges(all_rings: Column) -> Column:
    """(x0, y0, x1, y1) of the edges of rings, each ring closed on itself."""
    edge = lambda a, b: F.struct(a["lng"].alias("x0"), a["lat"].alias("y0"), b["lng"].alias("x1"), b["lat"].alias("y1"))
    return F.flatten(F.transform(all_rings, lambda r: F.zip_with(r, G.following(r), edge)))


def area_deg2(shape: Column) -> Column:
    """Square degrees: outer rings less holes, whichever way they run."""
    part = lambda p: 2 * G.area_deg2(F.get(p, 0)) - G.total(F.transform(p, G.area_deg2))
    return bind(shape, lambda s: G.total(F.transform(s, part)))


def center(shape: Column) -> Column:
    """Mean of the vertices of the outer rings."""
    return G.centroid(F.flatten(outers(shape)))


def area_m2(shape: Column, at: Column | None = None) -> Column:
    """Square metres around a point, the mean vertex if none is given."""
    lat = (center(shape) if at is None else at)["lat"]
    return area_deg2(shape) * K.M_PER_DEG * K.M_PER_DEG * F.cos(F.radians(lat))


def area_ha(shape: Column, lat: Column) -> Column:
    return area_deg2(shape) * K.M_PER_DEG_LAT_HA * (K.M_PER_DEG * F.cos(F.radians(lat))) / 10_000


def perimeter_m(shape: Column, at: Column | None = None, holes: bool = True) -> Column:
    """Length of all rings, or of the outer ones."""
    scale = K.M_PER_DEG * F.cos(F.radians((center(shape) if at is None else at)["lat"]))
    length = lambda k: G.total(F.transform(edges(rings(shape) if holes else outers(shape)), lambda e: F.hypot((e["x1"] - e["x0"]) * k, (e["y1"] - e["y0"]) * K.M_PER_DEG)))
    return bind(scale, length)


def centroid(shape: Column) -> Column:
    """The centre of mass, holes left out; the mean of the outer vertices if there is no area."""

    def moments(ring: Column, x: Column, y: Column) -> Column:
        """Twice the area and six times its first moments around a point, area counted as positive."""
        term = lambda a, b: F.struct(((a["lng"] - x) * (b["lat"] - y) - (b["lng"] - x) * (a["lat"] - y)).alias("w"), (a["lng"] + b["lng"] - 2 * x).alias("x"), (a["lat"] + b["lat"] - 2 * y).alias("y"))
        sums = lambda t: F.struct(G.total(F.transform(t, lambda q: q["w"])).alias("w"), G.total(F.transform(t, lambda q: q["w"] * q["x"])).alias("x"), G.total(F.transform(t, lambda q: q["w"] * q["y"])).alias("y"))
        signed = bind(F.zip_with(ring, G.following(ring), term), sums)
        return bind(signed, lambda m: F.struct(F.abs(m["w"]).alias("w"), (m["x"] * F.signum(m["w"])).alias("x"), (m["y"] * F.signum(m["w"])).alias("y")))

    def of(s: Column) -> Column:
        first = F.get(F.get(F.get(s, 0), 0), 0)
        x, y = first["lng"], first["lat"]
        all_ = F.flatten(F.transform(s, lambda p: F.transform(p, lambda r, k: bind(moments(r, x, y), lambda m: F.transform(F.array(F.when(k == 0, 1.0).otherwise(-1.0)), lambda v: F.struct((m["w"] * v).alias("w"), (m["x"] * v).alias("x"), (m["y"] * v).alias("y")))))))
        flat = F.flatten(all_)
        sums = bind(flat, lambda m: F.struct(G.total(F.transform(m, lambda q: q["w"])).alias("w"), G.total(F.transform(m, lambda q: q["x"])).alias("x"), G.total(F.transform(m, lambda q: q["y"])).alias("y")))
        return bind(sums, lambda t: F.when(t["w"] > 0, G.point(y + t["y"] / (3 * t["w"]), x + t["x"] / (3 * t["w"]))).otherwise(center(s)))

    return bind(shape, of)


def bounds(shape: Column) -> Column:
    """The box (x0, y0, x1, y1) of a shape; holes don't count, as they lie inside."""
    lats = F.transform(F.flatten(outers(shape)), lambda p: p["lat"])
    lngs = F.transform(F.flatten(outers(shape)), lambda p: p["lng"])
    return F.struct(F.array_min(lngs).alias("x0"), F.array_min(lats).alias("y0"), F.array_max(lngs).alias("x1"), F.array_max(lats).alias("y1"))


def aspect_ratio(shape: Column) -> Column:
    """Longer over shorter side of the bounding box in metres."""

    def ratio(b: Column) -> Column:
        width = (b["x1"] - b["x0"]) * K.M_PER_DEG * lng_scale(center(shape)["lat"])
        height = (b["y1"] - b["y0"]) * 110_574.0
        return F.try_divide(F.greatest(width, height), F.least(width, height))

    return bind(bounds(shape), ratio)


def contains(shape: Column, lat, lng) -> Column:
    """Whether a point is in a part and in no hole: an odd number of edges to its right."""
    y, x = col(lat), col(lng)
    right = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < e["x0"] + (e["x1"] - e["x0"]) * F.try_divide(y - e["y0"], e["y1"] - e["y0"]))
    return F.size(F.filter(edges(rings(shape)), lambda e: F.coalesce(right(e), F.lit(False)))) % 2 == 1


def intersects(a: Column, b: Column) -> Column:
    """Whether two shapes have a point in common: edges that cross or touch, or a part of one inside the other."""

    def turn(px, py, qx, qy, rx, ry) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def between(e: Column, x: Column, y: Column) -> Column:
        return x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))

    def meet(e: Column, f: Column) -> Column:
        t = F.struct(
            turn(e["x0"], e["y0"], e["x1"], e["y1"], f["x0"], f["y0"]).alias("f0"),
            turn(e["x0"], e["y0"], e["x1"], e["y1"], f["x1"], f["y1"]).alias("f1"),
            turn(f["x0"], f["y0"], f["x1"], f["y1"], e["x0"], e["y0"]).alias("e0"),
            turn(f["x0"], f["y0"], f["x1"], f["y1"], e["x1"], e["y1"]).alias("e1"),
        )
        ends = lambda v: ((v["f0"] == 0) & between(e, f["x0"], f["y0"])) | ((v["f1"] == 0) & between(e, f["x1"], f["y1"])) | ((v["e0"] == 0) & between(f, e["x0"], e["y0"])) | ((v["e1"] == 0) & between(f, e["x1"], e["y1"]))
        return bind(t, lambda v: ((v["f0"] * v["f1"] < 0) & (v["e0"] * v["e1"] < 0)) | ends(v))

    def cross(both: Column) -> Column:
        return F.exists(both["a"], lambda e: F.exists(both["b"], lambda f: meet(e, f)))

    inside = lambda s, t: F.exists(outers(t), lambda r: contains(s, F.get(r, 0)["lat"], F.get(r, 0)["lng"]))
    return bind(F.struct(edges(rings(a)).alias("a"), edges(rings(b)).alias("b")), cross) | inside(a, b) | inside(b, a)


def quad_edges(shape: Column) -> Column:
    """Of a convex shape of four points its edges, counter-clockwise: where each starts (x, y) and its direction (ex, ey) of length 1; null of other shapes."""

    def edge(e: Column) -> Column:
        length = F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"])
        return F.struct(e["x0"].alias("x"), e["y0"].alias("y"), ((e["x1"] - e["x0"]) / length).alias("ex"), ((e["y1"] - e["y0"]) / length).alias("ey"))

    def of(ring: Column) -> Column:
        turned = F.when(G.signed_deg2(ring) > 0, ring).otherwise(F.reverse(ring))
        return bind(F.transform(edges(F.array(turned)), edge), lambda e: F.struct(*[F.get(e, k).alias(f"e{k}") for k in range(4)]))

    return F.when(convex(shape) & (F.size(F.get(F.get(shape, 0), 0)) == 4), bind(F.get(F.get(shape, 0), 0), of))


def quad_meets_box(quad: Column, quad_box: Column, box: Column) -> Column:
    """Whether a convex shape of four points (quad_edges, its bounds) and a rectangle along the axes have a point in common, by plain comparisons. Less than 1e-13 degrees apart, which is what rounding moves coordinates by, they touch."""
    # The corner of the box that lies furthest to the left of an edge.
    left = lambda e: e["ex"] * (F.when(e["ex"] > 0, box["y1"]).otherwise(box["y0"]) - e["y"]) - e["ey"] * (F.when(e["ey"] > 0, box["x0"]).otherwise(box["x1"]) - e["x"])
    return F.least(*[left(quad[f"e{k}"]) for k in range(4)]) >= -1e-13


def meets_circle(shape: Column, lat, lng, radius_km) -> Column:
    """Whether a shape holds the centre, or comes within the radius with a vertex or an edge of a ring."""
    y, x, r = col(lat), col(lng), col(radius_km)
    scale = K.KM_PER_DEG_LNG * F.cos(F.radians(y))
    km = lambda e, a, b: ((e[a] - x) * scale, (e[b] - y) * K.KM_PER_DEG_LAT)
    near = F.exists(edges(rings(shape)), lambda e: G.segment_distance(0.0, 0.0, *km(e, "x0", "y0"), *km(e, "x1", "y1")) <= r)
    return contains(shape, y, x) | near


def of_geojson(geometry: Column) -> Column:
    """The shape of a GeoJSON Polygon or MultiPolygon. Rings lose points off the globe and closing ones; parts whose outer ring has fewer than three points, and such holes, go; null if none stays."""

    def parse(text: Column) -> Column:
        kind, coordinates = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
        plain = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
        return F.when(kind == "Polygon", plain).when(kind == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>"))

    def ring(raw: Column) -> Column:
        whole = F.filter(raw, lambda c: (F.size(c) >= 2) & F.get(c, 0).isNotNull() & F.get(c, 1).isNotNull())
        return G.normalize(F.transform(whole, lambda c: G.point(F.get(c, 1), F.get(c, 0))))

    return bind(geometry, lambda text: _tidy(F.transform(parse(text), lambda part: F.transform(part, ring))))


def _tidy(parts: Column) -> Column:
    """Parts with an outer ring, and their rings that are none of null."""
    whole = F.filter(parts, lambda p: F.get(p, 0).isNotNull())
    kept = bind(whole, lambda s: F.transform(s, lambda p: F.filter(p, lambda r: r.isNotNull())))
    return F.when(F.size(whole) > 0, kept)


def _wound(shape: Column) -> Column:
    """Outer rings counter-clockwise, holes clockwise."""
    return F.transform(shape, lambda part: F.transform(part, lambda r, k: F.when((G.signed_deg2(r) > 0) == (k == 0), r).otherwise(F.reverse(r))))


def to_geojson(shape: Column) -> Column:
    """The geometry as text: a Polygon of one part, else a MultiPolygon."""

    def text(s: Column) -> Column:
        closed = F.transform(_wound(s), lambda part: F.transform(part, G.close))
        one = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.get(closed, 0)), F.lit("}"))
        return F.when(F.size(s) == 1, one).when(F.size(s) > 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(closed), F.lit("}")))

    return bind(shape, text)


def upright(shape: Column) -> Column:
    """Whether a shape is one rectangle along the axes."""
    return F.coalesce((F.size(shape) == 1) & (F.size(F.get(shape, 0)) == 1) & G.upright(F.get(F.get(shape, 0), 0)), F.lit(False))


def rectilinear(shape: Column) -> Column:
    """Whether all edges of a shape run along the axes."""
    return F.coalesce(upright(shape) | F.forall(edges(rings(shape)), lambda e: (e["x0"] == e["x1"]) | (e["y0"] == e["y1"])), F.lit(False))


def convex(shape: Column) -> Column:
    """Whether a shape is one ring that turns one way and only once: such a shape needs no repair."""

    def once(r: Column) -> Column:
        steps = F.zip_with(r, G.following(r), lambda a, b: F.struct((b["lng"] - a["lng"]).alias("x"), (b["lat"] - a["lat"]).alias("y")))

        def check(d: Column) -> Column:
            cross = F.zip_with(d, G.following(d), lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
            back = F.zip_with(d, G.following(d), lambda a, b: ((a["x"] > 0) | ((a["x"] == 0) & (a["y"] > 0))) != ((b["x"] > 0) | ((b["x"] == 0) & (b["y"] > 0))))
            moves = F.forall(d, lambda v: (v["x"] != 0) | (v["y"] != 0))
            return moves & (F.forall(cross, lambda c: c > 0) | F.forall(cross, lambda c: c < 0)) & (F.size(F.filter(back, lambda b: b)) == 2)

        return bind(steps, check)

    return F.coalesce((F.size(shape) == 1) & (F.size(F.get(shape, 0)) == 1) & once(F.get(F.get(shape, 0), 0)), F.lit(False))


# Arrow batches: shapes as flat arrays of points with the bounds of rings, parts and shapes.


class Flat:
    """Shapes of an Arrow column: points x and y, and for each ring, part and shape where its members begin (one bound more than members)."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        column = column.fill_null([]) if column.null_count else column
        self.shapes, parts = _bounds(column)
        self.parts, all_rings = _bounds(parts)
        self.rings, flat = _bounds(all_rings)
        self.x = flat.field("lng").to_numpy(zero_copy_only=False)
        self.y = flat.field("lat").to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.shapes) - 1

    def parts_of(self, k: int) -> list[list[np.ndarray]]:
        """Parts of a shape as lists of (n, 2) arrays of (x, y)."""
        ring = lambda r: np.column_stack([self.x[self.rings[r] : self.rings[r + 1]], self.y[self.rings[r] : self.rings[r + 1]]])
        return [[ring(r) for r in range(self.parts[p], self.parts[p + 1])] for p in range(self.shapes[k], self.shapes[k + 1])]


def _bounds(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    bounds = column.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], column.values.slice(bounds[0], bounds[-1] - bounds[0])


_POINT = pa.struct([("lat", pa.float64()), ("lng", pa.float64())])
_SHAPE = pa.list_(pa.list_(pa.list_(_POINT)))


def _column(shapes: list[list[list[np.ndarray]] | None]) -> pa.Array:
    """An Arrow column of shapes."""
    value = lambda r: [{"lat": y, "lng": x} for x, y in r.tolist()]
    return pa.array([None if s is None else [[value(r) for r in part] for part in s] for s in shapes], _SHAPE)


def _meetings(a: np.ndarray, b: np.ndarray, at_once: int = 1 << 20):
    """Where edges a[i]-b[i] meet: (edge, point) pairs of points inside an edge at which another edge crosses, touches or ends."""
    n = len(a)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    block = max(1, at_once // max(n, 1))
    for begin in range(0, n, block):
        rows = slice(begin, min(n, begin + block))
        boxes = (lo[rows, None] <= hi[None]).all(2) & (lo[None] <= hi[rows, None]).all(2)
        i, j = np.nonzero(boxes)
        i = i + begin
        i, j = i[i != j], j[i != j]
        d, e, w = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        den = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den
            u = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / den
        joined = [(p[i] == q[j]).all(1) for p in (a, b) for q in (a, b)]  # edges with a common end that aren't on one line meet there only
        cross = (den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1) & ~np.logical_or.reduce(joined)
        spot = a[i] + t[:, None] * d
        spot = np.where((u == 0)[:, None], a[j], np.where((u == 1)[:, None], b[j], spot))
        yield i[cross], spot[cross]
        # Edges on one line: the ends of one inside the other.
        size = np.abs(d).sum(1)
        line = (den == 0) & (np.abs(w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) <= 1e-14 * size * size)
        for end in (a[j], b[j]):
            s = ((end - a[i]) * d).sum(1)
            on = line & (s > 0) & (s < (d * d).sum(1))
            yield i[on], end[on]


def crosses_itself(parts: list[list[np.ndarray]]) -> bool:
    """Whether edges of a shape cross, lie on each other or touch elsewhere than in shared vertices, parts overlap, or a ring has too few points."""
    if any(len(r) < 3 for p in parts for r in p):
        return True
    a = np.concatenate([r for p in parts for r in p])
    b = np.concatenate([np.roll(r, -1, 0) for p in parts for r in p])
    if (a == b).all(1).any() or any(len(i) for i, _ in _meetings(a, b)):
        return True
    if any(len(np.unique(r, axis=0)) < len(r) for p in parts for r in p):
        return True
    # Rings meet in vertices at most: holes lie in their outer ring and in no other hole, parts outside each other or in a hole.
    inside = lambda p, r: bool(_odd(r, np.roll(r, -1, 0), (p[:1] + p[1:2]) / 2)[0])
    for k, part in enumerate(parts):
        if any(not inside(h, part[0]) for h in part[1:]) or any(inside(h, g) for h in part[1:] for g in part[1:] if g is not h):
            return True
        if any(inside(part[0], other[0]) and not any(inside(part[0], h) for h in other[1:]) for j, other in enumerate(parts) if j != k):
            return True
    return False


def _odd(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an odd number of edges is to the right of each point."""
    y, x = at[:, 1:2], at[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < a[:, 0] + (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]))
    return right.sum(1) % 2 == 1


def arranged(parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """A valid shape that covers what a shape covers: each part by the even-odd rule over its rings, parts together.

    Edges are split where they meet. A piece stays if just one of its sides is covered; it is turned so that this is its left side.
    From the end of a piece the walk goes on along the piece that turns most to the left, around one face, and is cut where it comes back to a point, so that rings
    meet in points only; rings that run counter-clockwise are outer ones, the others are holes of the least outer ring around them.
    """
    a = np.concatenate([r for p in parts for r in p])
    b = np.concatenate([np.roll(r, -1, 0) for p in parts for r in p])
    part = np.repeat(np.arange(len(parts)), [sum(map(len, p)) for p in parts])
    real = (a != b).any(1)
    a, b, part = a[real], b[real], part[real]
    if not len(a):
        return []
    cuts = [(np.arange(len(a)), a), (np.arange(len(a)), b), *_meetings(a, b)]
    edge, spot = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
    along = ((spot - a[edge]) * (b - a)[edge]).sum(1)
    by = np.lexsort((along, edge))
    edge, spot = edge[by], spot[by]
    # Points closer than a hundred-millionth of a degree's thousandth are one node.
    _, at, node = np.unique(np.round(spot * 1e11), axis=0, return_index=True, return_inverse=True)
    node, where = node.reshape(-1), spot[at]
    same = edge[1:] == edge[:-1]
    u, v, own = node[:-1][same], node[1:][same], part[edge[:-1][same]]
    u, v, own = u[u != v], v[u != v], own[u != v]
    low, high = np.minimum(u, v), np.maximum(u, v)
    pairs, piece = np.unique(np.column_stack([low, high]), axis=0, return_inverse=True)
    piece = piece.reshape(-1)
    p, q = where[pairs[:, 0]], where[pairs[:, 1]]
    middle = (p + q) / 2
    covered = np.zeros((2, len(pairs)), bool)  # to the left and to the right of p-q
    for k in range(len(parts)):
        mine = own == k
        on = np.bincount(piece[mine], minlength=len(pairs)) % 2 == 1  # crossing the piece changes sides
        ea, eb, of = where[u[mine]], where[v[mine]], piece[mine]
        # A ray to the right, upwards from pieces that are nearly level; the piece itself is left out.
        level = np.abs(q[:, 1] - p[:, 1]) < np.abs(q[:, 0] - p[:, 0])
        odd = np.empty(len(pairs), bool)
        for flat in (False, True):
            some = np.flatnonzero(level == flat)
            axes = [1, 0] if flat else [0, 1]
            for begin in range(0, len(some), 512):
                rows = some[begin : begin + 512]
                y, x = middle[rows][:, axes[1], None], middle[rows][:, axes[0], None]
                ya, yb, xa, xb = ea[:, axes[1]], eb[:, axes[1]], ea[:, axes[0]], eb[:, axes[0]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = ((ya > y) != (yb > y)) & (x < xa + (xb - xa) * (y - ya) / (yb - ya)) & (of != rows[:, None])
                odd[rows] = hit.sum(1) % 2 == 1
        # The ray leaves on the right of pieces that go up, and above, on the left of those that go to the right.
        leaves_left = np.where(level, q[:, 0] > p[:, 0], q[:, 1] < p[:, 1])
        covered[0] |= odd ^ (on & ~leaves_left)
        covered[1] |= odd ^ (on & leaves_left)
    left, right = covered
    start = np.concatenate([pairs[left & ~right, 0], pairs[right & ~left, 1]])
    stop = np.concatenate([pairs[left & ~right, 1], pairs[right & ~left, 0]])
    return _faces(start, stop, where)


def _faces(start: np.ndarray, stop: np.ndarray, where: np.ndarray) -> list[list[np.ndarray]]:
    """Parts whose boundary are the given pieces, covered to their left."""
    leaving: dict[int, list[int]] = {}
    for k, s in enumerate(start.tolist()):
        leaving.setdefault(s, []).append(k)
    angle = np.arctan2(*(where[stop] - where[start]).T[::-1])
    used = np.zeros(len(start), bool)
    found: list[list[int]] = []
    for first in range(len(start)):
        if used[first]:
            continue
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring.append(int(start[k]))
            back = angle[k] + math.pi
            open_ = [j for j in leaving[int(stop[k])] if not used[j]]
            if not open_:
                break
            # The least turn clockwise from the way back keeps to this face.
            k = max(open_, key=lambda j: -((back - angle[j]) % (2 * math.pi) or 2 * math.pi))
        found += [loop for loop in _loops(ring) if len(loop) >= 3]
    often = np.bincount(np.concatenate(found), minlength=len(where)) if found else None
    found = [_straight(where[loop], often[loop] > 1) for loop in found]
    sizes = [G.signed([tuple(p) for p in r]) for r in found]
    outer = sorted((r for r, s in zip(found, sizes, strict=True) if s > 0), key=lambda r: (-G.shoelace(r), r.tolist()))
    out = [[r] for r in outer]
    for hole, size in zip(found, sizes, strict=True):
        if size < 0:
            step = hole[1] - hole[0]
            probe = (hole[0] + hole[1]) / 2 + np.array([-step[1], step[0]]) * 1e-6  # to the left of a hole's edge is what it is cut from
            around = [k for k, o in enumerate(out) if _odd(o[0], np.roll(o[0], -1, 0), probe[None])[0]]
            if around:
                out[min(around, key=lambda k: G.shoelace(out[k][0]))].append(hole)
    return out


def _loops(nodes: list[int]) -> list[list[int]]:
    """A closed walk, cut wherever it comes back to a node."""
    out, path, place = [], [], {}
    for n in nodes:
        if n in place:
            begin = place[n]
            out.append(path[begin:])
            for m in path[begin:]:
                del place[m]
            del path[begin:]
        place[n] = len(path)
        path.append(n)
    return [*out, path]


def _straight(ring: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A ring without points that lie on the line between their neighbours, but for those that other rings share."""
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    cross = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]
    keep = shared | (np.abs(cross) > 1e-12 * np.abs(before).sum(1) * np.abs(after).sum(1))
    return ring[keep] if keep.sum() >= 3 else ring


def repaired():
    """Shapes that cover what they cover without crossings, by an Arrow UDF; convex ones stay in the engine as they are. Null if nothing is covered."""

    @F.arrow_udf(SHAPE)
    def run(shapes: pa.Array) -> pa.Array:
        flat, out = Flat(shapes), []
        for k in range(len(flat)):
            parts = None if flat.null[k] else flat.parts_of(k)
            if parts and crosses_itself(parts):
                parts = arranged(parts)
            out.append(parts or None)
        return _column(out)

    once = run.asNondeterministic()  # or else filters on the result would run it again

    def repair(shape: Column) -> Column:
        fine = convex(shape)
        return F.when(fine, shape).otherwise(once(F.when(~fine, shape)))

    return repair


def trapezoids_of(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(shape, row of y0, y1, l0, l1, r0, r1) of the trapezoids of all shapes of a batch.

    Each shape's distinct ordinates part it into strips. An edge passes the strips between its ends; in each strip the edges
    from left to right bound trapezoids in pairs.
    """
    per_ring = np.diff(flat.rings)
    ring_of = np.repeat(np.arange(len(per_ring)), per_ring)
    after = np.arange(len(flat.x)) + 1
    ends = flat.rings[1:][per_ring > 0]
    after[ends - 1] = flat.rings[:-1][per_ring > 0]
    shape_of = (np.repeat(np.arange(len(flat)), np.diff(flat.shapes)))[np.repeat(np.arange(len(flat.parts) - 1), np.diff(flat.parts))][ring_of]
    by = np.lexsort((flat.y, shape_of))
    new = np.ones(len(by), bool)
    new[1:] = (shape_of[by][1:] != shape_of[by][:-1]) | (flat.y[by][1:] != flat.y[by][:-1])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    level = flat.y[by][new]
    low, high = np.minimum(rank, rank[after]), np.maximum(rank, rank[after])
    down = rank > rank[after]
    bottom, top = np.where(down, after, np.arange(len(by))), np.where(down, np.arange(len(by)), after)
    spans = high - low
    edge = np.repeat(np.arange(len(by)), spans)
    strip = np.repeat(low, spans) + np.arange(len(edge)) - np.repeat(np.cumsum(spans) - spans, spans)
    y0, y1 = level[strip], level[strip + 1] if len(strip) else np.zeros(0)
    xb, xt, yb, yt = flat.x[bottom[edge]], flat.x[top[edge]], flat.y[bottom[edge]], flat.y[top[edge]]
    slope = (xt - xb) / (yt - yb)
    x0 = np.where(y0 == yb, xb, xb + slope * (y0 - yb))
    x1 = np.where(y1 == yt, xt, xb + slope * (y1 - yb))
    by = np.lexsort((x1, x0 + x1, strip))
    left, right = by[::2], by[1::2]
    return shape_of[edge[left]], np.column_stack([y0[left], y1[left], x0[left], x1[left], x0[right], x1[right]])


def stacked(of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same trapezoids, but rectangles of a shape that stand on each other, with the same sides, are one."""
    by = np.lexsort((rows[:, 0], rows[:, 4], rows[:, 2], of))
    of, rows = of[by], rows[by]
    plain = (rows[:, 2] == rows[:, 3]) & (rows[:, 4] == rows[:, 5])
    new = np.ones(len(rows), bool)
    new[1:] = (of[1:] != of[:-1]) | (rows[1:, 2] != rows[:-1, 2]) | (rows[1:, 4] != rows[:-1, 4]) | (rows[1:, 0] != rows[:-1, 1]) | ~plain[1:] | ~plain[:-1]
    begin = np.flatnonzero(new)
    out = rows[begin].copy()
    out[:, 1] = rows[np.append(begin[1:], len(rows))[: len(begin)] - 1, 1]
    return of[begin], out


def trapezoids():
    """The trapezoids of a valid shape: that of a rectangle along the axes in Columns, others by an Arrow UDF."""

    @F.arrow_udf(f"array<{TRAPEZOID}>")
    def run(shapes: pa.Array) -> pa.Array:
        flat = Flat(shapes)
        of, rows = stacked(*trapezoids_of(flat))
        by = np.argsort(of, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(flat)))]).astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(rows[by, k]) for k in range(6)], ["y0", "y1", "l0", "l1", "r0", "r1"])
        return pa.ListArray.from_arrays(pa.array(bounds), fields)

    once = run.asNondeterministic()

    def cut(shape: Column) -> Column:
        box = bounds(shape)
        whole = F.array(F.struct(box["y0"].alias("y0"), box["y1"].alias("y1"), box["x0"].alias("l0"), box["x0"].alias("l1"), box["x1"].alias("r0"), box["x1"].alias("r1")))
        plain = upright(shape)
        return F.when(plain, whole).otherwise(once(F.when(~plain, shape)))

    return cut


def trapezoids_share(a: Column, b: Column) -> Column:
    """Area that two trapezoids share. Between the ordinates where their sides cross, the shared width changes evenly."""
    low, high = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    upright_ = (a["l0"] == a["l1"]) & (a["r0"] == a["r1"]) & (b["l0"] == b["l1"]) & (b["r0"] == b["r1"])
    plain = F.greatest(F.least(a["r0"], b["r0"]) - F.greatest(a["l0"], b["l0"]), F.lit(0.0)) * (high - low)

    def sides(t: Column, y: Column) -> tuple[Column, Column]:
        s = (y - t["y0"]) / (t["y1"] - t["y0"])
        return t["l0"] + (t["l1"] - t["l0"]) * s, t["r0"] + (t["r1"] - t["r0"]) * s

    names = ("al0", "ar0", "bl0", "br0", "al1", "ar1", "bl1", "br1")
    ends = F.struct(*[v.alias(n) for n, v in zip(names, [*sides(a, low), *sides(b, low), *sides(a, high), *sides(b, high)], strict=True)])

    def general(e: Column) -> Column:
        def at(side: str, t: Column) -> Column:
            return e[f"{side}0"] + (e[f"{side}1"] - e[f"{side}0"]) * t

        def crossing(p: str, q: str) -> Column:
            begin, end = e[f"{p}0"] - e[f"{q}0"], e[f"{p}1"] - e[f"{q}1"]
            return F.when(begin * end < 0, begin / (begin - end)).otherwise(F.lit(0.0))

        width = lambda t: F.greatest(F.least(at("ar", t), at("br", t)) - F.greatest(at("al", t), at("bl", t)), F.lit(0.0))
        cuts = F.array_sort(F.array(F.lit(0.0), crossing("al", "bl"), crossing("ar", "br"), crossing("al", "br"), crossing("bl", "ar"), F.lit(1.0)))
        widths = bind(cuts, lambda c: F.transform(c, lambda t: F.struct(t.alias("t"), width(t).alias("w"))))
        pieces = bind(widths, lambda w: G.total(F.zip_with(F.slice(w, 1, 5), F.slice(w, 2, 5), lambda p, q: (p["w"] + q["w"]) / 2 * (q["t"] - p["t"]))))
        return pieces * (high - low)

    return F.when(high <= low, 0.0).when(upright_, plain).otherwise(bind(ends, general))


def pieces_in_box(df: DataFrame, pieces: list[dict[str, str]], box: str, to: str) -> DataFrame:
    """df with the area of trapezoids (names of the columns of y0, y1, l0, r0, and l1, r1 where sides are slanted) that a rectangle along the axes holds, by plain comparisons.

    Over the shared ordinates, the mean place of a side between the sides of the rectangle is a difference quotient of a parabola between two straight lines.
    It is worked out in steps, each a column used by the next, as one expression would hold the same parts many times over."""
    b, width = F.col(box), F.col(box)["x1"] - F.col(box)["x0"]
    name = lambda k, part: F.col(f"_p{k}{part}")
    steps: list[dict[str, Column]] = [{}, {}, {}, {}]
    areas = []
    for k, names in enumerate(pieces):
        t = {f: F.col(c) for f, c in names.items()}
        low, high = F.greatest(t["y0"], b["y0"]), F.least(t["y1"], b["y1"])
        if "l1" not in t:
            areas.append(F.greatest(F.least(t["r0"], b["x1"]) - F.greatest(t["l0"], b["x0"]), F.lit(0.0)) * F.greatest(high - low, F.lit(0.0)))
            continue
        tall = F.greatest(t["y1"] - t["y0"], F.lit(1e-300))  # pieces without a height, which hold nothing, divide by no zero
        steps[0] |= {f"_p{k}low": (low - t["y0"]) / tall, f"_p{k}part": (high - low) / tall, f"_p{k}high": high - low}
        for side in "lr":
            lean = t[f"{side}1"] - t[f"{side}0"]
            steps[1] |= {f"_p{k}{side}": t[f"{side}0"] + lean * name(k, "low") - b["x0"], f"_p{k}{side}d": lean * name(k, "part")}
            held = lambda v: F.least(F.greatest(v, F.lit(0.0)), width)
            begin, end = name(k, side), name(k, side) + name(k, f"{side}d")
            steps[2] |= {f"_p{k}{side}b": held(begin), f"_p{k}{side}e": held(end), f"_p{k}{side}o": F.greatest(end - width, F.lit(0.0)) - F.greatest(begin - width, F.lit(0.0))}
            at, to_, over, step = name(k, f"{side}b"), name(k, f"{side}e"), name(k, f"{side}o"), name(k, f"{side}d")
            steps[3] |= {f"_p{k}{side}m": F.when(step == 0, at).otherwise(((to_ - at) * (to_ + at) / 2 + width * over) / step)}
        areas.append(F.when(name(k, "high") > 0, F.greatest(name(k, "rm") - name(k, "lm"), F.lit(0.0)) * name(k, "high")).otherwise(0.0))
    for step in steps:
        df = df.withColumns(step) if step else df
    return df.withColumn(to, sum(areas[1:], areas[0]) if areas else F.lit(0.0)).drop(*[c for step in steps for c in step])


def _cut_rows(box: pa.StructArray, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(trapezoids of each row, y0, y1, l0, l1, r0, r1 of all of them in order); a row with an empty list has its box."""
    own = cut.value_lengths().to_numpy(zero_copy_only=False)
    plain = own == 0
    counts = np.where(plain, 1, own)
    out = np.empty((counts.sum(), 6))
    whole = np.repeat(plain, counts)
    x0, y0, x1, y1 = (box.field(k).to_numpy(zero_copy_only=False)[plain] for k in ("x0", "y0", "x1", "y1"))
    out[whole] = np.column_stack([y0, y1, x0, x0, x1, x1])
    flat = cut.flatten()
    out[~whole] = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("y0", "y1", "l0", "l1", "r0", "r1")])
    return counts, out


def trapezoids_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that pairs of trapezoids (rows of y0, y1, l0, l1, r0, r1) share, as ``trapezoids_share`` has them."""
    low, high = np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 1], b[:, 1])
    meet = (low < high) & (np.minimum(a[:, 2], a[:, 3]) < np.maximum(b[:, 4], b[:, 5])) & (np.minimum(b[:, 2], b[:, 3]) < np.maximum(a[:, 4], a[:, 5]))
    out = np.zeros(len(a))
    a, b, low, high = a[meet], b[meet], low[meet], high[meet]

    def side(t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        slope = (t[:, k + 1] - t[:, k]) / (t[:, 1] - t[:, 0])
        return t[:, k] + slope * (low - t[:, 0]), t[:, k] + slope * (high - t[:, 0])

    al, ar, bl, br = side(a, 2), side(a, 4), side(b, 2), side(b, 4)

    def crossing(p: tuple, q: tuple) -> np.ndarray:
        begin, end = p[0] - q[0], p[1] - q[1]
        return np.divide(begin, begin - end, out=np.zeros(len(begin)), where=begin * end < 0)

    cuts = np.sort(np.stack([np.zeros(len(low)), crossing(al, bl), crossing(ar, br), crossing(al, br), crossing(bl, ar), np.ones(len(low))]), axis=0)
    at = lambda s: s[0] + (s[1] - s[0]) * cuts
    width = np.maximum(np.minimum(at(ar), at(br)) - np.maximum(at(al), at(bl)), 0.0)
    out[meet] = ((width[1:] + width[:-1]) / 2 * np.diff(cuts, axis=0)).sum(0) * (high - low)
    return out


#: Pairs of trapezoids held at once.
PAIRS_AT_ONCE = 100_000


def _cuts_share():
    """Arrow UDF: the area that two shapes share, of their boxes and trapezoids, whole batches of pairs at once."""

    @F.arrow_udf("double")
    def run(a_box: pa.Array, a_cut: pa.Array, b_box: pa.Array, b_cut: pa.Array) -> pa.Array:
        (na, a), (nb, b) = _cut_rows(a_box, a_cut), _cut_rows(b_box, b_cut)
        per_row = na * nb
        first_a, first_b, ends = np.cumsum(na) - na, np.cumsum(nb) - nb, np.cumsum(per_row)
        out, begin = np.zeros(len(na)), 0
        while begin < len(na):
            done = ends[begin] - per_row[begin]
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
            own = per_row[begin:end]
            row = np.repeat(np.arange(begin, end), own)
            k = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            areas = trapezoids_shared(a[first_a[row] + k // nb[row]], b[first_b[row] + k % nb[row]])
            out[begin:end] = np.bincount(row - begin, areas, end - begin)
            begin = end
        return pa.array(out)

    return run.asNondeterministic()  # or else filters on the area would run it again


def shared_by_cut(a_box: str, a_cut: str | None, b_box: str, b_cut: str | None) -> Column:
    """Area that two shapes share, each given by its box and its trapezoids; those are null (or None for all) of a rectangle along the axes, which is its box.

    Of rectangles alone in Columns, else by an Arrow UDF."""
    a, b = F.col(a_box), F.col(b_box)
    if a_cut is None and b_cut is None:
        side = lambda k: F.greatest(F.least(a[f"{k}1"], b[f"{k}1"]) - F.greatest(a[f"{k}0"], b[f"{k}0"]), F.lit(0.0))
        return side("x") * side("y")
    # Empty lists, as Spark's Arrow writer goes through all rows since the last list for each null one.
    none = F.array().cast(f"array<{TRAPEZOID}>")
    cut = lambda name: none if name is None else F.coalesce(F.col(name), none)
    return _cuts_share()(a, cut(a_cut), b, cut(b_cut))


def hull_ratio():
    """A shape's area over that of the convex hull of its outer rings, by an Arrow UDF."""

    @F.arrow_udf("double")
    def run(shapes: pa.Array) -> pa.Array:
        flat, out = Flat(shapes), []
        for k in range(len(flat)):
            parts = flat.parts_of(k)
            hull = G.hull_area(np.concatenate([p[0] for p in parts])) if parts else 0.0
            own = sum(2 * G.shoelace(p[0]) - sum(map(G.shoelace, p)) for p in parts)
            out.append(own / hull if hull > 0 else 0.0)
        return pa.array(out, pa.float64())

    return run


def to_wkb():
    """Arrow UDF: WKB of a shape, a polygon of one part, else a multi-polygon."""

    @F.arrow_udf("binary")
    def run(shapes: pa.Array) -> pa.Array:
        def polygon(part: list[np.ndarray]) -> bytes:
            out = struct.pack("<BII", 1, 3, len(part))
            for k, ring in enumerate(part):
                ring = ring if (G.signed([tuple(p) for p in ring]) > 0) == (k == 0) else ring[::-1]
                out += struct.pack("<I", len(ring) + 1) + np.ascontiguousarray(np.vstack([ring, ring[:1]]), "<f8").tobytes()
            return out

        flat = Flat(shapes)
        made = []
        for k in range(len(flat)):
            parts = flat.parts_of(k)
            body = [polygon(p) for p in parts]
            made.append(None if not parts else body[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(body))
        return pa.array(made, pa.binary())

    return run


def _wkb_parts(raw: bytes, at: int = 0) -> tuple[list[list[np.ndarray]], int]:
    """Parts of a WKB polygon or multi-polygon that starts at a byte, and where it ends."""
    order = "<" if raw[at] == 1 else ">"
    kind, n = struct.unpack_from(f"{order}II", raw, at + 1)
    at, out = at + 9, []
    if kind % 1000 == 6:
        for _ in range(n):
            more, at = _wkb_parts(raw, at)
            out += more
    elif kind % 1000 == 3:
        part = []
        for _ in range(n):
            (size,) = struct.unpack_from(f"{order}I", raw, at)
            ring = np.frombuffer(raw, f"{order}f8", 2 * size, at + 4).astype(float).reshape(-1, 2)
            at += 4 + 16 * size
            ring = ring[np.isfinite(ring).all(1)]
            part.append(ring[:-1] if len(ring) > 3 and (ring[0] == ring[-1]).all() else ring)
        if part and len(part[0]) >= 3:
            out.append([r for r in part if len(r) >= 3])
    return out, at


def of_wkb():
    """Arrow UDF: the shape of a WKB polygon or multi-polygon, null of anything else."""

    @F.arrow_udf(SHAPE)
    def run(blobs: pa.Array) -> pa.Array:
        raws = blobs.to_pylist()
        return _column([(_wkb_parts(r)[0] or None) if r is not None and len(r) >= 9 else None for r in raws])

    return run
