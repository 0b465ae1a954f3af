"""Polygons of parts and rings, held against point samples, plain sums and hand-made figures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.operators import spatial as S
from fieldloom.operators.registry import plausible_field
from fieldloom.plans import geo
from fieldloom.sources import files

KM = 1 / 111.32


def box(x, y, s, t=None):
    t = s if t is None else t
    return [(x, y), (x + s, y), (x + s, y + t), (x, y + t)]


def frame(spark, shapes):
    value = lambda s: None if s is None else [[[(float(y), float(x)) for x, y in ring] for ring in part] for part in s]
    return spark.createDataFrame([(k, value(s)) for k, s in enumerate(shapes)], f"k int, ring {P.SHAPE}")


def odd(ring, at):
    """Even-odd rule, point by point."""
    out = np.zeros(len(at), bool)
    for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]], strict=True):
        for k, (x, y) in enumerate(at):
            if (ya > y) != (yb > y) and x < xa + (xb - xa) * (y - ya) / (yb - ya):
                out[k] = ~out[k]
    return out


def covered(shape, at):
    out = np.zeros(len(at), bool)
    for part in shape:
        out |= np.logical_xor.reduce([odd(r, at) for r in part])
    return out


def area(shape):
    return sum(2 * G.shoelace(np.array(p[0], float)) - sum(G.shoelace(np.array(r, float)) for r in p) for p in shape)


def test_measures_of_parts_far_apart_and_of_holes(spark):
    far = [[box(0, 0, KM)], [box(20 * KM, 0, KM)]]
    holed = [[box(0, 0, KM), box(0.4 * KM, 0.4 * KM, 0.2 * KM)]]
    df = frame(spark, [far, holed]).withColumn("at", G.point(F.lit(0.0), F.lit(0.0)))
    s = F.col("ring")
    got = df.select(P.perimeter_m(s, F.col("at")).alias("l"), P.perimeter_m(s, F.col("at"), holes=False).alias("o"), P.area_m2(s, F.col("at")).alias("a"), P.meets_circle(s, KM / 2, 10 * KM, 0.5).alias("gap"), P.meets_circle(s, KM / 2, 10 * KM, 9.1).alias("near"), P.meets_circle(s, KM / 2, KM / 2, 0.05).alias("in_hole"), P.meets_circle(s, KM / 2, KM / 2, 0.11).alias("at_hole")).collect()
    assert [round(r.l) for r in got] == [8000, 4800] and [round(r.o) for r in got] == [8000, 4000]
    assert [r.a for r in got] == [pytest.approx(2e6, rel=1e-6), pytest.approx(0.96e6, rel=1e-6)]
    assert [(r.gap, r.near, r.in_hole, r.at_hole) for r in got] == [(False, True, True, True), (False, True, False, True)]
    field = plausible_field(frame(spark, [holed, far, [[box(0, 0, KM)]]])).orderBy("k").collect()
    assert [r.plausible for r in field] == [True, False, True]
    assert field[0].compactness == pytest.approx(math.pi / 4, rel=1e-6) and field[0].hull_ratio == pytest.approx(1)


def test_parsing_drops_what_is_no_ring(spark):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    texts = [
        {"type": "Polygon", "coordinates": [square, [[0.5, 0.5], [1, 0.5]]]},
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 1]]], [square, [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [500, 0], [2, 0], [2, 2]]]},
        {"type": "Point", "coordinates": [1, 2]},
        {"type": "Polygon", "coordinates": []},
        {"type": "Polygon"},
    ]
    df = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)] + [(9, None), (10, "no json")], "k int, t string")
    got = {r.k: r["s"] and [[len(ring) for ring in part] for part in r["s"]] for r in df.select("k", P.of_geojson(F.col("t")).alias("s")).collect()}
    assert got == {0: [[4]], 1: [[4, 3]], 2: [[3]], 3: None, 4: None, 5: None, 9: None, 10: None}


def test_sinks_keep_parts_and_holes(spark):
    shapes = [[[box(0, 0, 4)[::-1], box(1, 1, 1)]], [[box(0, 0, 4), box(1, 1, 2)], [box(6, 0, 1)]], [[box(1, 1, 1)]]]
    df = frame(spark, shapes).orderBy("k")
    doc = json.loads(files.to_geojson(df, "k").first().geojson)
    kinds = {f["properties"]["k"]: f["geometry"]["type"] for f in doc["features"]}
    assert kinds == {0: "Polygon", 1: "MultiPolygon", 2: "Polygon"}
    for f in doc["features"]:
        parts = f["geometry"]["coordinates"] if f["geometry"]["type"] == "MultiPolygon" else [f["geometry"]["coordinates"]]
        for part in parts:
            assert all(r[0] == r[-1] for r in part)
            assert [G.signed([tuple(p) for p in r[:-1]]) > 0 for r in part] == [True] + [False] * (len(part) - 1)
    back = df.withColumn("w", P.of_wkb()(P.to_wkb()(F.col("ring"))))
    assert [r.a for r in back.select(P.area_deg2(F.col("w")).alias("a")).collect()] == [15, 13, 1]


def test_bow_ties_keep_their_area(spark):
    bow = [[(0, 0), (2, 2), (2, 0), (0, 2)]]
    eight = [[(0, 0), (4, 0), (4, 2), (2, 0), (0, 2)]]  # touches itself
    twice = [[[*box(0, 0, 2), *box(0, 0, 2)]], [box(5, 5, 1)]]  # the same way walked twice covers nothing
    outside = [[box(0, 0, 2), box(1, 1, 2)]]
    overlapping = [[box(0, 0, 2)], [box(1, 0, 2)]]
    flat = [[[(0, 0), (1, 1), (2, 2)]]]
    df = frame(spark, [[b] for b in (bow, eight)] + [twice, outside, overlapping, flat, None, [[box(0, 0, 1)]], [[box(0, 0, 3), box(1, 1, 1)]]])
    got = df.select("k", P.repaired()(F.col("ring")).alias("s")).select("k", F.size("s").alias("n"), P.area_deg2(F.col("s")).alias("a")).orderBy("k").collect()
    assert [(r.n if r.n and r.n > 0 else None, r.a) for r in got] == [(2, 2.0), (2, 4.0), (1, 1.0), (2, 6.0), (1, 6.0), (None, None), (None, None), (1, 1.0), (1, 8.0)]


@pytest.mark.parametrize("kind", ["free", "grid", "parts"])
def test_repair_covers_the_same_points_and_leaves_no_crossing(kind):
    rng = np.random.default_rng(4)
    some = lambda n: rng.random((n, 2)) if kind != "grid" else rng.integers(0, 5, (n, 2)) / 4
    for _ in range(60):
        parts = [[some(rng.integers(3, 9))]] if kind == "free" else [[some(6), some(4)], [some(4)]]
        out = P.arranged(parts)
        at = rng.random((300, 2)) * 1.02 - 0.01
        assert (covered([[r.tolist() for r in p] for p in parts], at) == covered([[r.tolist() for r in p] for p in out], at)).all()
        for k, part in enumerate(out):
            assert not P.crosses_itself([part])
            assert G.signed([tuple(p) for p in part[0]]) > 0 and all(G.signed([tuple(p) for p in h]) < 0 for h in part[1:])
            others = np.logical_or.reduce([covered([[r.tolist() for r in p]], at) for j, p in enumerate(out) if j != k] or [np.zeros(len(at), bool)])
            assert not (others & covered([[r.tolist() for r in part]], at)).any()
        assert not out or not P.crosses_itself(out)


def test_shared_areas_of_any_shapes(spark):
    rng = np.random.default_rng(7)
    make = lambda n: [P.arranged([[rng.random((5, 2)), rng.random((4, 2))], [rng.random((4, 2))]]) for _ in range(n)]
    a, b = make(12), [*make(10), [[np.array(box(0.2, 0.2, 0.5))]], [[np.array(box(3, 3, 1))]]]
    left, right = frame(spark, a).withColumnRenamed("k", "a"), frame(spark, b).withColumnRenamed("k", "b")
    got = {(r.a, r.r_b): r.shared for r in S.shared_areas(left, right, "a", "b").collect()}
    side = 120
    at = (np.stack(np.meshgrid(np.arange(side), np.arange(side)), -1).reshape(-1, 2) + 0.5) / side
    fill = lambda s: np.logical_or.reduce([np.logical_xor.reduce([P._odd(r, np.roll(r, -1, 0), at) for r in p]) for p in s])
    fa, fb = [fill(s) for s in a], [fill(s) for s in b]
    for i in range(len(a)):
        for j in range(len(b)):
            assert got.get((i, j), 0.0) == pytest.approx((fa[i] & fb[j]).mean(), abs=0.004)
    assert not any(j == 11 for _, j in got)
    whole = {r.a: r.shared for r in S.shared_areas(left, left.withColumnRenamed("a", "b"), "a", "b").where("a = r_b").collect()}
    assert whole == {k: pytest.approx(area([[r.tolist() for r in p] for p in s]), rel=1e-9) for k, s in enumerate(a)}


def test_an_ell_and_a_square_share_an_exact_area(spark):
    ell = [[[[(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]]]]
    rows = S.shared_areas(frame(spark, ell), frame(spark, [[[box(0.5, 0.5, 1.5)]]]).withColumnRenamed("k", "b"), "k", "b").collect()
    assert [r.shared for r in rows] == [pytest.approx(1.25)]


def test_each_side_is_cut_by_python_once(spark):
    """Rectangles never reach Python's cutting, others once a side, whatever filters follow."""
    for name, most in (("geo_overlap", 2), ("geo_holes_shared", 2), ("geo_repaired", 1), ("geo_holes_hold", 0)):
        plan = geo.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") <= most, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_containment_minds_holes_and_parts(spark):
    shapes = frame(spark, [[[box(0, 0, 4), box(1, 1, 2)], [box(1.5, 1.5, 1)]], [[box(6, 0, 1)]]])
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.2, 1.2), (2, 2.0, 2.0), (3, 0.5, 6.5), (4, 9.0, 9.0)], "p int, center_lat double, center_lng double")
    assert sorted((r.p, r.k) for r in S.containing(points, shapes, 0.7).collect()) == [(0, 0), (2, 0), (3, 1)]
    gone = S.not_within(points.select("p", F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng")), shapes, 0.7)
    assert sorted(r.p for r in gone.collect()) == [1, 4]


def test_shapes_intersect_as_their_areas_and_edges_tell(spark):
    rng = np.random.default_rng(9)
    shapes = [P.arranged([[rng.random((4, 2)) * 0.4 + rng.random(2)]]) for _ in range(40)]
    a = frame(spark, shapes).withColumnRenamed("k", "a")
    pairs = a.crossJoin(a.select(F.col("a").alias("b"), F.col("ring").alias("other"))).withColumn("hit", P.intersects(F.col("ring"), F.col("other")))
    hits = {(r.a, r.b) for r in pairs.where("hit").select("a", "b").collect()}
    shared = {(r.a, r.r_b) for r in S.shared_areas(a, a.withColumnRenamed("a", "b"), "a", "b").where("shared > 1e-12").collect()}
    assert hits == shared and len(hits) < 1600
    touching = [[[box(0, 0, 1)]], [[box(1, 0, 1)]], [[box(1, 1, 1)]], [[box(5, 5, 1)]], [[box(-1, -1, 4), box(-0.5, -0.5, 3.2)]], [[box(0.2, 0.2, 0.1)]]]
    b = frame(spark, touching)
    pairs = b.crossJoin(b.select(F.col("k").alias("j"), F.col("ring").alias("other"))).where(P.intersects(F.col("ring"), F.col("other")) & (F.col("k") < F.col("j")))
    assert sorted((r.k, r.j) for r in pairs.collect()) == [(0, 1), (0, 2), (0, 5), (1, 2)]


def test_boxes_of_very_different_sizes_meet_without_many_rows(spark):
    """From a metre to a continent on both sides: all pairs, each once, and at most four rows a level."""
    rng = np.random.default_rng(12)

    def boxes(n, name):
        side = 10.0 ** rng.uniform(-5, 1.5, n)
        side[: n // 3] = 0.001
        x, y = rng.uniform(-2, 2, n), rng.uniform(-2, 2, n)
        return [(k, (float(a), float(b), float(a + s), float(b + s * t))) for k, (a, b, s, t) in enumerate(zip(x, y, side, rng.random(n), strict=True))], f"{name} int, {name}_box struct<x0:double,y0:double,x1:double,y1:double>"

    (rows_a, kind_a), (rows_b, kind_b) = boxes(150, "a"), boxes(170, "b")
    rows_a += [(900, (0.0, 0.0, 0.0, 0.0)), (901, (-180.0, -90.0, 180.0, 90.0))]
    a, b = spark.createDataFrame(rows_a, kind_a), spark.createDataFrame(rows_b, kind_b)
    got = [(r.a, r.b) for r in S.box_pairs(a, b, "a_box", "b_box").select("a", "b").collect()]
    want = {(i, j) for i, p in rows_a for j, q in rows_b if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}
    assert len(got) == len(set(got)) and set(got) == want
    most = S._at_levels(a, "a_box", F.array(S.level_of(F.col("a_box")))).groupBy("a").count().agg(F.max("count")).first()[0]
    assert most <= 4


def test_containment_by_quadtree_equals_that_by_grid(spark):
    rng = np.random.default_rng(2)
    shapes = frame(spark, [[[box(*rng.random(2), 10.0 ** rng.uniform(-3, 0))]] for _ in range(40)])
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rng.random((300, 2)) * 1.5)], "p int, center_lat double, center_lng double")
    by_tree = {(r.p, r.k) for r in S.containing(points, shapes).collect()}
    assert by_tree == {(r.p, r.k) for r in S.containing(points, shapes, 0.1).collect()} and len(by_tree) > 100


def test_pairs_of_small_shapes_share_areas_without_a_shuffle_of_pairs(spark):
    """Small shapes, a circle of many trapezoids and an id of two rows: the same areas, and no sums by pair where all shapes are small."""
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False) + 0.01
    circle = [[np.column_stack([0.5 + 0.4 * np.sin(turn), 0.5 + 0.4 * np.cos(turn)]).tolist()]]
    shapes = [[[box(0, 0, 1)]], [[[(0, 0), (0, 1), (1, 0)]]], circle, [[box(0.25, 0.25, 0.5)]]]
    left = frame(spark, shapes).withColumnRenamed("k", "a")
    right = left.withColumnRenamed("a", "b")
    got = {(r.a, r.r_b): r.shared for r in S.shared_areas(left, right, "a", "b").collect()}
    assert len(got) == 16 and all(got[i, j] == pytest.approx(got[j, i]) for i in range(4) for j in range(4))
    assert [got[0, j] for j in range(4)] == [pytest.approx(v) for v in (1, 0.5, area(shapes[2]), 0.25)] and got[1, 3] == pytest.approx(0.125)
    twice = S.shared_areas(left.where("a <> 2").withColumn("a", F.when(F.col("a") == 3, 0).otherwise(F.col("a"))), right.where("b = 0"), "a", "b").collect()
    assert sorted((r.a, r.shared) for r in twice) == [(0, pytest.approx(1.25)), (1, pytest.approx(0.5))]
    small = S.shared_areas(left.where("a <> 2"), right.where("b <> 2"), "a", "b")
    assert "Aggregate" not in small._jdf.queryExecution().executedPlan().toString()


def test_rectangles_hold_points_by_comparisons(spark):
    """Lower and left sides belong to a rectangle, and its edges are not walked along."""
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.5), (2, 0.5, 1.0), (3, 0.5, 0.5)], "p int, center_lat double, center_lng double")
    held = S.containing(points, frame(spark, [[[box(0, 0, 1)]]]))
    assert sorted(r.p for r in held.collect()) == [0, 3]
    assert "CASE WHEN _plain" in held._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_small_file_are_parsed_by_all_cores(spark):
    assert len(geo.with_holes(spark, "/root/testdata/sf0.001").inputFiles()) == spark.sparkContext.defaultParallelism


def test_containment_goes_by_tile_and_sends_no_side_through_the_driver(spark):
    points = spark.range(2000).select(F.col("id").alias("p"), (F.col("id") % 41 / 10.0).alias("center_lat"), (F.col("id") % 53 / 13.0).alias("center_lng"))
    squares = frame(spark, [[[box(k % 4, k // 4, 0.9)]] for k in range(16)])
    held = S.containing(points, squares)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # one a side, before rows take their cells
    assert held.count() == points.crossJoin(squares).where(P.contains(F.col("ring"), "center_lat", "center_lng")).count()


def test_shapes_along_the_axes_hold_points_as_the_walk_along_their_edges_has_it(spark):
    holed = [[box(0, 0, 4), box(1, 1, 1), box(2, 2, 1)], [box(5, 1, 1, 2)]]
    ell = [[[(0, 5), (4, 5), (4, 6), (2, 6), (2, 8), (0, 8)]]]
    slanted = [[[(5, 5), (8, 5), (8, 8)]]]
    shapes = frame(spark, [holed, ell, slanted])
    points = spark.range(19 * 19).select(F.col("id").alias("p"), (F.floor(F.col("id") / 19) / 2.0 - 0.25 * (F.col("id") % 2)).alias("center_lat"), (F.col("id") % 19 / 2.0).alias("center_lng"))
    want = {(r.p, r.k) for r in points.crossJoin(shapes).where(P.contains(F.col("ring"), "center_lat", "center_lng")).collect()}
    got = [(r.p, r.k) for r in S.containing(points, shapes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for _, k in want} == {0, 1, 2}
    only = S.containing(points, shapes.where("k < 2")).select("p", "k")
    assert "ring" not in only._jdf.queryExecution().executedPlan().toString()  # rectangles hold them


@pytest.mark.parametrize("kind", ["along the axes", "slanted"])
def test_few_pieces_and_rectangles_share_areas_without_python(spark, kind):
    rng = np.random.default_rng(5)
    holed = [[box(0, 0, 4), box(1, 1, 1), box(2, 2, 1)], [box(5, 1, 1, 2)]]
    ell = [[[(0, 5), (4, 5), (4, 6), (2, 6), (2, 8), (0, 8)]]]
    slanted = [[[[(5, 5), (8, 5), (8, 8)]]], [[[(0, 0), (3, 1), (1, 3)]]], [[[(4, 0), (6, 2), (4, 4), (2, 2)]]]]
    shapes = [holed, ell, [[box(1, 1, 2)]]] if kind == "along the axes" else [*slanted, [[box(1, 1, 2)]]]
    boxes = [(x, y, w, h) for x, y, w, h in zip(*rng.uniform(-1, 8, (2, 80)), *rng.uniform(0.1, 4, (2, 80)), strict=True)] + [(0, 0, 4, 4), (5, 5, 3, 3), (1, 1, 1, 1), (4, 1, 1, 1)]
    right = frame(spark, [[[box(x, y, w, h)]] for x, y, w, h in boxes]).withColumnRenamed("k", "b")
    found = S.shared_areas(frame(spark, shapes), right, "k", "b")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.r_b): r.shared for r in found.collect()}
    turned = {(r.r_k, r.b): r.shared for r in S.shared_areas(right, frame(spark, shapes), "b", "k").collect()}
    _, rows = zip(*[P.trapezoids_of(P.Flat(P._column([[[np.array(r, float) for r in part] for part in s]]))) for s in shapes], strict=True)
    want = {}
    for k, pieces in enumerate(rows):
        for b, (x, y, w, h) in enumerate(boxes):
            shared = P.trapezoids_shared(pieces, np.tile([y, y + h, x, x, x + w, x + w], (len(pieces), 1)).astype(float)).sum()
            if shared > 1e-12:
                want[k, b] = pytest.approx(shared, rel=1e-9, abs=1e-12)
    large = lambda pairs: {k: v for k, v in pairs.items() if v > 1e-12}
    assert large(got) == want and large(turned) == want and len(want) > 50


def test_tasks_of_pairs_grow_with_the_rows_that_they_sort(spark, monkeypatch):
    import re

    squares = frame(spark, [[[box(k % 20 * 0.002, k // 20 * 0.002, 0.003)]] for k in range(200)])
    tasks = lambda: min(map(int, re.findall(r"hashpartitioning\(_cell#\d+, (\d+)\)", S.shared_areas(squares, squares.withColumnRenamed("k", "b"), "k", "b")._jdf.queryExecution().executedPlan().toString())))
    few = tasks()
    monkeypatch.setattr(S, "ROWS_A_TASK", 50)
    assert tasks() > 2 * few
