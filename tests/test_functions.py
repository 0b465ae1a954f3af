"""Rounding, distances, geometry, indices and texts on hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import mathx as M
from fieldloom.functions import spectral as X
from fieldloom.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def ring(*points):
    return F.array(*[G.point(float(a), float(b)) for a, b in points])


def test_rounding_ties_and_nulls(spark):
    r = one(spark, a=M.round_up(F.lit(-2.5)), b=M.round_up(F.lit(2.5)), c=M.round_even(F.lit(2.5)), d=M.clamp(F.lit(None).cast("double"), 0, 1), e=M.haversine_m(F.lit(None).cast("double"), 0.0, 1.0, 1.0))
    assert (r.a, r.b, r.c, r.d, r.e) == (-2, 3, 2, None, None)


def test_projection_round_trip(spark):
    x, y = M.mercator(47.0, -19.85)
    lng, lat = M.from_mercator(x, y)
    r = one(spark, lng=lng, lat=lat, h=M.haversine_m(0.0, 0.0, 0.0, 90.0))
    assert r.lng == pytest.approx(47.0) and r.lat == pytest.approx(-19.85)
    assert r.h == pytest.approx(math.pi / 2 * 6_371_000)


def test_polygon_normalize_quirks(spark):
    closed = ring((0, 0), (0, 1), (1, 1), (0, 0))
    three = ring((0, 0), (0, 1), (0, 0))
    bad = ring((0, 0), (95, 1), (1, 1))
    r = one(spark, a=F.size(G.normalize(closed)), b=F.size(G.normalize(three)), c=G.normalize(bad), d=F.size(G.close(closed)))
    assert (r.a, r.b, r.c, r.d) == (3, 2, None, 5)


def test_contains_concave(spark):
    shape = ring((0, 0), (0, 4), (4, 4), (4, 3), (1, 3), (1, 1), (4, 1), (4, 0))  # a C open to the north
    r = one(spark, a=G.contains(shape, 0.5, 2.0), b=G.contains(shape, 2.0, 2.0), c=G.contains(shape, 2.0, 0.5), d=G.contains(shape, 5.0, 5.0))
    assert (r.a, r.b, r.c, r.d) == (True, False, True, False)


def test_square_plausible_spiky_not(spark):
    from fieldloom.operators.registry import plausible_field

    square = [(0, 0), (0, 1), (1, 1), (1, 0)]
    spiky = [(math.sin(k / 10 * 2 * math.pi) * (1 if k % 2 else 0.15), math.cos(k / 10 * 2 * math.pi) * (1 if k % 2 else 0.15)) for k in range(10)]
    rows = [Row(id=i, ring=[Row(lat=float(a), lng=float(b)) for a, b in p]) for i, p in enumerate((square, spiky, square[:2]))]
    df = spark.createDataFrame(rows, f"id int, ring {G.RING}")
    assert [r.plausible for r in plausible_field(df).orderBy("id").collect()] == [True, False, False]


def test_clip_never_grows(spark):
    d = 0.01
    inside, half = [(-d / 2, -d / 2), (-d / 2, d / 2), (d / 2, d / 2), (d / 2, -d / 2)], [(-1, -1), (-1, 1), (1, 1), (1, -1)]
    df = spark.createDataFrame([Row(ring=[Row(lat=float(a), lng=float(b)) for a, b in p]) for p in (inside, half)], f"ring {G.RING}")
    rows = df.select(G.area_m2(F.col("ring")).alias("a"), G.area_m2(G.clip_to_circle(0.0, 0.0, 2.0)(F.col("ring"))).alias("b")).collect()
    assert rows[0].a == pytest.approx(rows[0].b, rel=1e-6)
    assert rows[1].b < rows[1].a and rows[1].b == pytest.approx(48 / 2 * math.sin(2 * math.pi / 48) * 4e6, rel=0.02)


def test_simplify_keeps_corners():
    line = np.array([(0, 0), (1, 0.01), (2, 0), (2, 2), (1, 2.01), (0, 2)], float)
    assert G.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]
    assert len(G.simplify(line[:2], 0.1)) == 2


def test_indices_without_data(spark):
    n = F.lit(None).cast("double")
    r = one(spark, a=X.clean_index(F.lit(0.0), F.lit(1.0)), b=X.normalized(F.lit(0.0), F.lit(0.0)), c=X.reflectance(F.lit(0.0)), d=X.reflectance(F.lit(float("nan"))), e=X.first_set(F.lit(0.0), n, F.lit(0.0)), f=X.soil_type(F.lit(3.0), F.lit(2.0)), z=X.ndvi_zone(F.lit(2.0)), y=X.ndvi_zone(F.lit(0.75)), x=X.ndvi_zone(F.lit(0.35)), w=X.ndvi_zone(n))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (None, None, None, None, 0.0, "Sol limoneux")
    assert (r.z, r.y, r.x, r.w) == ("low", "high", "mid", None)


def test_snapshot_formula(spark):
    v = X.snapshot(F.lit(3000.0), F.lit(1000.0), F.lit(800.0), F.lit(500.0))
    r = one(spark, **v)
    assert r.ndvi == 50 and r.ndwi == pytest.approx(-0.579) and r.savi == pytest.approx(75.0)
    assert r.evi == pytest.approx(math.floor(2.5 * 2000 / (3000 + 6000 - 3750 + 10_000) * 1000 + 0.5) / 10)


def test_texts(spark):
    r = one(
        spark,
        green=T.kml_label(F.lit("ff00ff00")),
        red=T.kml_label(F.lit("ff0000ff")),
        blue=T.kml_label(F.lit("ffff0000")),
        none=T.kml_label(F.lit("bad")),
        joined=T.joined(" · ", F.lit(""), F.lit(None).cast("string")),
        number=T.as_number(F.lit("NaN")),
        season=T.season(F.lit(-1.0), F.lit(3)),
    )
    assert (r.green, r.red, r.blue, r.none, r.joined, r.number, r.season) == (1, 0, None, None, None, None, "Jachère")


def test_rings_clipped_side_by_side_equal_those_clipped_alone(monkeypatch):
    rng = np.random.default_rng(5)
    angle = np.arange(48) / 48 * 2 * np.pi
    unit = np.column_stack([np.cos(angle), np.sin(angle)])
    rings = [rng.normal(0, 1, (int(n), 2)) * rng.uniform(0.1, 2) + rng.normal(0, 0.8, 2) for n in rng.integers(0, 25, 600)]
    rings += [np.array([[-2.0, -2], [2, -2], [2, 2], [-2, 2]]), np.array([[1.0, 0], [2, 0], [2, 1]]), np.array([[3.0, 3], [4, 3], [4, 4]]), np.array([[0.0, 0]]), np.zeros((0, 2)), np.array([[np.nan, 0], [0, 1], [2, 0]])]
    windows = unit * rng.uniform(0.3, 1.5, len(rings))[:, None, None]
    alone = [G.clip_convex(r, w) for r, w in zip(rings, windows, strict=True)]
    single = []
    plain = G.clip_convex
    monkeypatch.setattr(G, "clip_convex", lambda r, w: single.append(len(r)) or plain(r, w))
    monkeypatch.setattr(G, "CLIP_ROWS", 100)
    found = G.clip_each(rings, windows)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(alone, found, strict=True))
    assert {len(a) for a in alone} >= {0, 1, 3, 4, 5, 6, 48} and min(single) > G.CLIP_POINTS
    assert G.clip_each([], np.zeros((0, 48, 2))) == []
