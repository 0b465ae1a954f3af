"""Ties, gaps, boundaries and ordered operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.operators import raster as A
from fieldloom.operators import registry as R
from fieldloom.operators import scoring as C
from fieldloom.operators import series as E
from fieldloom.operators import spatial as S
from fieldloom.operators import zones as Z


def series(spark, ndvi, vv=None):
    vv = vv or [None] * len(ndvi)
    return spark.createDataFrame([(1, f"2025-{k + 1:02d}", None if n is None else float(n), v) for k, (n, v) in enumerate(zip(ndvi, vv, strict=True))], "parcel_id long, month_key string, ndvi double, vv double")


@pytest.mark.parametrize(
    ("ndvi", "month"),
    [([10, 25, 20], "2025-02"), ([10, 24, 20], "2025-02"), ([10, 14, 15], None), ([20, 20, 20], None), ([10, 25, 10, 25], "2025-02"), ([30, None, 46], "2025-03"), ([30], None)],
)
def test_planting_month(spark, ndvi, month):
    row = E.planting(series(spark, ndvi), "2025-12-01").first()
    assert row.planting_date == (dt.date.fromisoformat(f"{month}-10") if month else None)
    if month is None:
        assert row.planting_confidence == 0 and row.days_since_planting is None


def test_planting_alignment(spark):
    # The second month is missing, so the jump's place among valid months is one before its month.
    s = series(spark, [10, None, 40], [-12.0, -11.0, -11.2])
    assert E.planting(s, "2025-12-01").first().planting_confidence == 70
    s = series(spark, [10, None, 40], [-12.0, -12.1, -11.2])
    assert E.planting(s, "2025-12-01", align="month").first().planting_confidence == 70
    assert E.planting(s, "2025-12-01").first().planting_confidence == 60


def test_degree_days_may_fall(spark):
    w = spark.createDataFrame([(1, dt.date(2024, 1, 1), 10.0, 0.0), (1, dt.date(2024, 1, 2), -10.0, -20.0), (1, dt.date(2024, 1, 3), 30.0, None)], "site_id long, obs_date date, tmax double, tmin double")
    t = E.degree_day_totals(w, 0.0, 0.0).first()
    assert (t.cumulative, t.detected, t.n_days, t.end_date) == (-10.0, False, 2, dt.date(2024, 1, 3))
    assert [r.running for r in E.degree_days(w, 0.0).orderBy("obs_date").collect()] == [5.0, -10.0]


def test_greedy_thinning(spark):
    at = [0.0, 0.003, 0.006, 0.010, 0.0115]
    df = spark.createDataFrame([(1, f"c{k}", k / 110.574, 0.0) for k in at], "q long, candidate_id string, center_lat double, center_lng double")
    kept = R.thin(df, "q", "candidate_id", apart_km=0.005)
    assert sorted(r.candidate_id for r in kept.collect()) == ["c0.0", "c0.006", "c0.0115"]


def test_hybrid_boundaries(spark):
    def verdict(cnn, yes, agro):
        v = C.hybrid(F.lit(float(cnn)), F.lit(yes), F.lit(float(agro)))
        return spark.range(1).select(*[c.alias(k) for k, c in v.items()]).first()

    assert verdict(50, True, 50).is_barley is False and verdict(51, True, 50).is_barley is True
    at, over = verdict(75, True, 20), verdict(76, True, 20)
    assert "désaccord" not in at.verdict and "désaccord" in over.verdict
    assert over.confidence == np.floor(over.score - 56 * 0.08 + 0.5)


def test_forest_levels(spark):
    cases = [(0.90, 0.20, 210.0, "ORGE"), (0.90, 0.80, 210.0, "A_VERIFIER"), (0.05, 0.20, 210.0, "NON_ORGE"), (0.20, 0.20, 210.0, "A_VERIFIER")]
    for p, n, d, want in cases:
        assert spark.range(1).select(C.forest_level(F.lit(p), F.lit(n), F.lit(d)).alias("v")).first().v == want


def test_seasonal_features_of_twelve_months(spark):
    rows = []
    for k in range(12):
        year, month = (2025, 10 + k) if k < 3 else (2026, k - 2)
        ndvi = 0.18 + 0.55 * np.exp(-((k - 8) ** 2) / 5)
        b8 = 0.38 + 0.2 * ndvi
        rows.append((1, f"{year}-{month:02d}", 0.05, float(b8 * (1 - ndvi) / (1 + ndvi)), 0.1, 0.2, float(b8), 0.15))
    rows[2] = (1, rows[2][1], None, None, None, None, None, None)
    f = C.seasonal_features(spark.createDataFrame(rows, "parcel_id long, month_key string, B2 double, B4 double, B5 double, B6 double, B8 double, B11 double"))
    out = f.orderBy("month_key").collect()
    assert len(out) == 12 and all(v is not None for r in out for v in r)
    assert out[2].NDVI == 0.0 and out[0].NDVI_max == pytest.approx(0.73, abs=1e-3) and out[0].doy_max_ndvi == 152
    assert C.seasonal_features(spark.createDataFrame([], f.sparkSession.createDataFrame(rows, "parcel_id long, month_key string, B2 double, B4 double, B5 double, B6 double, B8 double, B11 double").schema)).count() == 0


def test_logistic_fit_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(60, 9, 60)
    y = (x + rng.normal(0, 6, 60) > 60).astype(float)
    m = C.fit_logistic(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "ndvi double, y double"), ["ndvi"], "y")
    z, w, b = (x - x.mean()) / x.std(), 0.0, 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(z * w + b)))
        w, b = w - 0.1 * ((z @ (p - y)) / 60 + w / 60), b - 0.1 * np.mean(p - y)
    assert m["coef"][0] == pytest.approx(w, abs=1e-3) and m["intercept"] == pytest.approx(b, abs=1e-3)


def test_best_by_id(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (1, 2, 0.5), (2, 3, 0.1), (2, 4, 0.9), (None, 5, 0.1), (None, 6, 0.1)], "parcel_id long, ord int, confidence double")
    assert sorted((r.parcel_id or 0, r.ord, r.pos) for r in Z.best_by_id(df).collect()) == [(0, 5, 5), (0, 6, 6), (1, 0, 0), (2, 4, 3)]


def test_zero_confidence_and_no_crops_filter_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, None, "a"), (2, 0.0, 0.001, 0.4, None)], "parcel_id long, center_lat double, center_lng double, confidence double, crop_pred string")
    assert Z.crops_in_circle(df, 0, 0, 1000, 0.0, []).count() == 2
    assert Z.crops_in_circle(df, 0, 0, 1000, 0.3).count() == 1


def test_size_classes(spark):
    v = [r.c for r in spark.createDataFrame([(0.0,), (0.1,), (0.5,), (1.0,), (None,)], "a double").select(Z.size_class(F.col("a")).alias("c")).collect()]
    assert v == ["< 0,1 ha", "0,1-0,5 ha", "0,5-1 ha", "> 1 ha", None]
    assert [r.n_parcels for r in Z.size_histogram(spark.createDataFrame([], "area_ha double")).orderBy("rank").collect()] == [0, 0, 0, 0]


def test_cell_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)

    def boxes(n, name, big):
        rows = [(k, float(a), float(b), float(h), float(w)) for k, (a, b, h, w) in enumerate(np.column_stack([rng.random((n, 2)), rng.random((n, 2)) * big]).tolist())]
        return spark.createDataFrame(rows, f"{name} long, lat double, lng double, h double, w double").withColumn("ring", G.rectangle("lat", "lng", "h", "w"))

    a, b = boxes(60, "a", 0.1), boxes(80, "b", 0.02)
    got = S.overlapping(a.select("a", "ring"), b.select("b", "ring"), "a", "b").select("a", "r_b").collect()
    want = a.alias("x").join(b.alias("y"), (F.abs(F.col("x.lat") - F.col("y.lat")) <= F.col("x.h") + F.col("y.h")) & (F.abs(F.col("x.lng") - F.col("y.lng")) <= F.col("x.w") + F.col("y.w"))).select("x.a", "y.b").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {tuple(r) for r in want}


def test_watershed_and_outline(spark):
    s = np.full((6, 9), 0.9)
    s[1:5, 1:4] = 0.1 + np.arange(12).reshape(4, 3) * 1e-3
    s[1:5, 5:8] = 0.2 + np.arange(12).reshape(4, 3) * 1e-3
    s += np.arange(54).reshape(6, 9) * 1e-6
    wall = np.zeros((6, 9), bool)
    wall[0, 8] = True
    labels = A.flood(s, wall, share=0.42)
    assert labels[0, 8] == 0 and set(np.unique(labels)) == {0, 1, 2} and labels[2, 2] == 1 and labels[2, 6] == 2 and (labels > 0).sum() == 53
    square = np.zeros((5, 5), int)
    square[1:4, 1:4] = 7
    assert A.outline(square, 7) == [(1, 1), (2, 1), (3, 1), (3, 2), (3, 3), (2, 3), (1, 3), (1, 2)]
    assert A.outline(square, 3) == [] and (A.flood(s, np.ones_like(wall)) == 0).all()


def test_outline_is_the_border_that_faces_outside():
    rng = np.random.default_rng(8)
    for _ in range(60):
        mask = np.zeros((14, 16), bool)
        for _ in range(4):  # overlapping blocks, two pixels wide at least, with holes at times
            y, x = rng.integers(0, 9), rng.integers(0, 10)
            mask[y : y + rng.integers(2, 6), x : x + rng.integers(2, 7)] = True
        path = A.outline(mask * 5, 5)
        reach = {path[0]}
        for x, y in (todo := [path[0]]):
            for q in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if q not in reach and 0 <= q[0] < 16 and 0 <= q[1] < 14 and mask[q[1], q[0]]:
                    reach.add(q)
                    todo.append(q)
        outside = {(-1, -1)}
        for x, y in (todo := [(-1, -1)]):
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q not in outside and -1 <= q[0] <= 16 and -1 <= q[1] <= 14 and q not in reach:
                    outside.add(q)
                    todo.append(q)
        border = {(x, y) for x, y in reach if outside & {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)}}
        assert set(path) == border and path[0] == min(reach, key=lambda q: (q[1], q[0]))
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:] + path[:1]))


def test_outline_of_thin_parts():
    assert A.outline(np.array([[0, 3]]), 3) == [(1, 0)]
    assert A.outline(np.array([[3, 3, 3]]), 3) == [(0, 0), (1, 0), (2, 0), (1, 0)]
    assert A.outline(np.array([[0, 3, 0], [3, 0, 3]]), 3) == [(1, 0), (2, 1)]  # ends at its first pixel
    assert A.outline(np.array([[3, 0], [0, 3]]), 3) == [(0, 0), (1, 1)]


def test_equal_strengths_flood_in_reading_order():
    rng = np.random.default_rng(12)
    for _ in range(20):
        s = rng.integers(0, 4, (7, 8)) / 4
        wall = rng.random((7, 8)) < 0.1
        seeds = A.flood(s, wall | (s > 0), share=1.0 - 1e-9, least_seed=3)  # no more than the groups of the lowest value
        if not seeds.any():
            continue
        want = seeds.copy()
        beside = lambda y, x: [(y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)]
        inside = lambda y, x: 0 <= y < 7 and 0 <= x < 8
        while True:
            open_ = [(s[y, x], y, x) for y in range(7) for x in range(8) if not want[y, x] and not wall[y, x] and any(inside(*q) and want[q] for q in beside(y, x))]
            if not open_:
                break
            _, y, x = min(open_)
            want[y, x] = next(want[q] for q in beside(y, x) if inside(*q) and want[q])
        got = A.flood(s, wall, share=((s == 0) & ~wall).sum() / (~wall).sum() - 1e-9, least_seed=3)
        assert (got == want).all()


def test_upsert_and_guarded_delete(spark):
    old = spark.createDataFrame([(1, "a", 1.0, "auto"), (2, "b", 2.0, "Tracé automatique corrigé"), (3, "c", 3.0, None)], "parcel_id long, label string, v double, data_source string")
    new = spark.createDataFrame([("b", None), ("d", 9.0)], "label string, v double")
    got = {r.label: (r.parcel_id, r.v) for r in R.upsert(old, new, "label", ["label", "v"]).collect()}
    assert got == {"a": (1, 1.0), "b": (2, None), "c": (3, 3.0), "d": (None, 9.0)}
    stay, outcome = R.delete(old, spark.createDataFrame([(1,), (2,), (9,)], "parcel_id long"))
    assert {r.parcel_id: r.outcome for r in outcome.collect()} == {1: "deleted", 2: "refused", 9: "missing"}
    assert sorted(r.parcel_id for r in stay.collect()) == [2, 3]


def test_windows_hop_and_tumble(spark):
    hop = E.month_windows(spark, "2025-03-15", 3, 2).orderBy("label").collect()
    assert [(r.label, r.end.isoformat()) for r in hop] == [("2025-01", "2025-02-28"), ("2025-02", "2025-03-31"), ("2025-03", "2025-04-30")]
    rows = spark.createDataFrame([(dt.datetime(2025, 2, 10),), (dt.datetime(2025, 2, 28),)], "ts timestamp")
    assert sorted(r.label for r in E.in_month_windows(rows, "ts", "2025-03-15", 3, 2).collect()) == ["2025-01", "2025-02", "2025-02"]
    assert [r.label for r in E.in_month_windows(rows, "ts", "2025-03-15", 3, 1).collect()] == ["2025-02"]


def test_thinning_by_rounds_equals_the_fold(spark):
    """Also where a third of all points lie in one place, near the poles and over the date line's edge."""
    rng = np.random.default_rng(6)
    lat = np.concatenate([rng.normal(-19.8, 0.01, 150), np.full(120, -19.8), rng.uniform(80, 89.9, 60), rng.uniform(-0.01, 0.01, 60)])
    lng = np.concatenate([rng.normal(47, 0.01, 150), 47 + rng.normal(0, 1e-5, 120), rng.uniform(-180, 180, 60), rng.uniform(-0.01, 0.01, 60)])
    rows = [(int(k % 2), int(rng.integers(0, 4)), f"c{k:04d}", float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lng, strict=True))]
    df = spark.createDataFrame(rows, "q int, source_rank int, candidate_id string, center_lat double, center_lng double")
    for apart in (0.3, 2.0):
        folded = {(r.q, r.candidate_id) for r in R.thin(df, "q", "source_rank", "candidate_id", apart_km=apart).collect()}
        mixed = {(r.q, r.candidate_id) for r in R.thin(df, "q", "source_rank", "candidate_id", apart_km=apart, fold_rows=10).collect()}
        assert folded == mixed and 10 < len(folded) < len(rows)


def test_a_stored_forest_scores_as_mllib_and_as_a_plain_walk(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, v), float(v[0] + 0.5 * v[1] > 0.2)) for k, v in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, label double")
    model = C.train_forest(df, "label", ["a", "b", "c"], trees=7, depth=5)
    model.stages[-1].save(str(tmp_path / "m"))
    nodes = C.read_forest(spark, str(tmp_path / "m" / "data"))
    want = {r.k: r.p for r in C.forest_probability(model, df).collect()}
    for most in (200_000, 20):  # all trees at once, and one after the other
        C.MOST_NODES, before = most, C.MOST_NODES
        got = {r.k: r.p for r in C.forest_scores(df, nodes, ["a", "b", "c"]).collect()}
        C.MOST_NODES = before
        assert got == {k: pytest.approx(p, abs=1e-9) for k, p in want.items()}
    C.write_forest(nodes, str(tmp_path / "n"))
    held = {(n.tree, n.node): n for n in C.read_forest(spark, str(tmp_path / "n")).collect()}

    def walk(x):
        total = 0.0
        for tree in range(7):
            n = held[tree, 0]
            while n.feature is not None:
                n = held[tree, n.left_child if x[n.feature] <= n.threshold else n.right_child]
            total += n.value
        return total / 7

    assert {r[0]: pytest.approx(walk(r[1:4])) for r in rows} == want
    missing = spark.createDataFrame([(1, None, 0.3, None)], "k int, a double, b double, c double")
    assert C.forest_scores(missing, nodes, ["a", "b", "c"]).first().p == pytest.approx(walk((0.0, 0.3, 0.0)))


def test_an_upsert_rewrites_only_buckets_that_change(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry = R.Registry(spark, path, "label", buckets=8)
    assert registry.read() is None
    old = spark.createDataFrame([(f"p{k}", float(k), f"note {k}") for k in range(200)], "label string, confidence double, note string")
    registry.write(old)
    before = {b: sorted(p.name for p in (tmp_path / "registry" / f).iterdir()) for b, f in registry.manifest()[1].items()}
    new = spark.createDataFrame([("p3", 90.0, 1), ("p3", 91.0, 2), ("fresh", 5.0, 1)], "label string, confidence double, seen int")
    with pytest.raises(ValueError, match="1 rows repeat"):
        registry.upsert(new, ["label", "confidence"])
    changed = registry.upsert(new, ["label", "confidence"], latest="seen")
    version, now = registry.manifest()
    assert version == 2 and 1 <= len(changed) <= 2
    for b, files_ in before.items():
        assert b in changed or sorted(p.name for p in (tmp_path / "registry" / now[b]).iterdir()) == files_ and now[b].startswith("data/v1-")
    rows = {r.label: (r.confidence, r.note) for r in registry.read().collect()}
    want = {f"p{k}": (float(k), f"note {k}") for k in range(200)} | {"p3": (91.0, "note 3"), "fresh": (5.0, None)}
    assert rows == want and registry.read().count() == 201
    with pytest.raises(ValueError, match="1 keys are null"):
        registry.upsert(spark.createDataFrame([(None, 1.0)], "label string, confidence double"), ["label", "confidence"])
    with pytest.raises(RuntimeError):  # of two writers of one version the second fails
        registry._publish(2, {})
    assert {r.label: (r.confidence, r.note) for r in registry.read().collect()} == want
    assert registry.upsert(new.limit(0).drop("seen"), ["label", "confidence"]) == set() and registry.manifest()[0] == 2


def _left_out(x, y):
    """Hits of plain leave-one-out: a fit over all others of each row."""
    import numpy as np

    hits = 0
    for k in range(len(y)):
        rest = np.arange(len(y)) != k
        m, s = x[rest].mean(0), x[rest].std(0)
        s[s == 0] = 1.0
        z = np.column_stack([np.ones(rest.sum()), (x[rest] - m) / s])
        w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * (z.shape[1] - 1))
        for _ in range(25):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - y[rest]) + ridge @ w)
        hits += int((np.append(1.0, (x[k] - m) / s) @ w >= 0) == (y[k] == 1))
    return hits


def test_leave_one_out_equals_a_fit_for_each_row(spark):
    import numpy as np

    from fieldloom.operators import scoring as C

    rng = np.random.default_rng(5)
    for n, noise in ((60, 2.0), (300, 6.0)):
        x = np.round(rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 100, 3], 2)
        y = (x[:, 0] + rng.normal(size=n) * noise > 0.2).astype(float)
        x[:, 2] = 3.0
        x[0, 2] = 3.5 if n == 60 else 3.0  # of the others' values all are equal
        x[1:4, 0] = x[1, 0]
        table = [(k, float(y[k]), *map(float, x[k]), None if k % 4 == 0 else 1.0) for k in range(n)]
        rows = spark.createDataFrame(table, "key long, y double, a double, b double, c double, d double")
        sets = [["a"], ["a", "b"], ["b", "c"], ["d"], ["c"]]
        found = {r["rank"]: r for r in C.leave_one_out(rows, sets, "y", "key").collect()}
        assert sorted(found) == [0, 1, 2, 4]
        for r in found:
            at = ["abc".index(c) for c in sets[r]]
            assert (found[r]["n_rows"], round(found[r]["accuracy"] * n)) == (n, _left_out(x[:, at], y)), (n, r)
    one = spark.createDataFrame([(k, 1.0 if k else 0.0, float(k)) for k in range(5)], "key long, y double, a double")
    assert C.leave_one_out(one, [["a"]], "y", "key").first()["accuracy"] == 0.8
    assert C.leave_one_out(one.where("key > 0"), [["a"]], "y", "key").first()["accuracy"] == 1.0
    assert C.leave_one_out(one.where("key = 0"), [["a"]], "y", "key").isEmpty()


def test_leave_one_out_takes_tables_of_any_size(spark):
    from fieldloom.operators import scoring as C

    rows = spark.range(6_000).selectExpr("id", "cast(id % 997 * 7 % 100 + id % 3 * 30 > 80 as double) as y", "cast(id % 997 * 7 % 100 as double) as a")
    found = C.leave_one_out(rows, [["a"]], "y", "id").first()
    assert found["n_rows"] == 6_000 and found["accuracy"] > found["majority"]


def test_images_meet_regions_by_sides_as_by_edges(spark):
    import random

    from fieldloom.functions import geometry as G
    from fieldloom.functions import polygons as P
    from fieldloom.operators import series as E

    rnd = random.Random(3)
    rhombus = lambda y, x, a, b: [(y - a, x), (y, x + b), (y + a, x), (y, x - b)]
    points = lambda p: [{"lat": y, "lng": x} for y, x in p]
    shapes = [rhombus(rnd.uniform(0, 0.02), rnd.uniform(0, 0.02), rnd.uniform(0.001, 0.004), rnd.uniform(0.001, 0.004)) for _ in range(60)]
    shapes += [s[::-1] for s in shapes[:20]] + [s[:3] for s in shapes[:20]] + [rhombus(0.5, 0.5, 0.25, 0.25)]
    images = spark.createDataFrame([(k, points(s), "2025-01-02", 5) for k, s in enumerate(shapes)], f"image_id long, footprint {G.RING}, ts string, cloud_pct int")
    boxes = [(rnd.uniform(0, 0.02), rnd.uniform(0, 0.02), rnd.uniform(0.0002, 0.003), rnd.uniform(0.0002, 0.003)) for _ in range(60)] + [(0.625, 0.625, 0.0, 0.0), (0.875, 0.5, 0.125, 0.125)]  # the last touch
    regions = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "region_id long, y double, x double, h double, w double").select("region_id", G.rectangle("y", "x", "h", "w").alias("ring"))
    both = regions.crossJoin(images).where(P.intersects(P.of_ring(F.col("ring")), P.of_ring(F.col("footprint"))))
    right = {tuple(r) for r in both.select("image_id", "region_id").collect()}
    found = [tuple(r) for r in E.images_over(images, regions, "2025-01-01", "2025-02-01", 30).collect()]
    assert len(found) == len(set(found)) and set(found) == right and {(100, 60), (100, 61)} <= right
    # Rectangles and convex quadrilaterals meet without a walk along their edges.
    only = E.images_over(images.where("image_id < 80 or image_id = 100"), regions, "2025-01-01", "2025-02-01", 30)
    assert "exists(" not in only._jdf.queryExecution().optimizedPlan().toString()


def test_circles_are_narrowed_to_what_holds_their_nearest(spark):
    from fieldloom.operators import zones as Z

    rng = np.random.default_rng(4)
    at = np.concatenate([rng.uniform(0, 0.05, (3_000, 2)), np.full((300, 2), 0.02), rng.uniform(0.3, 0.5, (20, 2))])
    parcels = spark.createDataFrame([(k, 50.0, 1.0, float(x), float(y), float(x), float(y)) for k, (x, y) in enumerate(at)], "ftw_id long, confidence double, area_ha double, xmin double, ymin double, xmax double, ymax double")
    spots = np.concatenate([rng.uniform(-0.002, 0.052, (40, 2)), [[0.02, 0.02], [0.4, 0.4], [2.0, 2.0]]])
    circles = spark.createDataFrame([(k, float(y), float(x), 3_000.0 + k) for k, (x, y) in enumerate(spots)], "query_id long, lat double, lng double, radius_m double")
    found = {(r["query_id"], r["rank"]): r["ftw_id"] for r in Z.traced_in_circles(parcels, circles, limit=5).collect()}
    rad = np.radians
    for k, (x, y) in enumerate(spots):
        h = np.sin(rad(at[:, 1] - y) / 2) ** 2 + np.cos(rad(y)) * np.cos(rad(at[:, 1])) * np.sin(rad(at[:, 0] - x) / 2) ** 2
        km = 2 * 6_371_000 * np.arcsin(np.sqrt(h))
        right = [i for i in np.lexsort((np.arange(len(at)), km)) if km[i] <= 3_000 + k][:5]
        assert [found.get((k, n + 1)) for n in range(len(right))] == right and (k, len(right) + 1) not in found
    q = circles.selectExpr("query_id", "lat as _lat", "lng as _lng", "radius_m as _r").withColumn("_circle", S.circle_box("_lat", "_lng", "_r"))
    placed = parcels.selectExpr("ftw_id", "struct(xmin as x0, ymin as y0, xmax as x1, ymax as y1) as _spot")
    narrow = {r["query_id"]: r["_r"] for r in Z._narrowed(q, placed, 5).collect()}
    assert len(narrow) == 43 and narrow[42] == 3_042 and np.median(list(narrow.values())) < 1_500


def test_small_files_are_worked_on_by_all_cores(spark):
    from fieldloom.plans import geo, registers, tables

    d = "/root/testdata/sf0.001"
    for plan in (geo.geo_plausible, geo.geo_repaired, registers.geojson_parsed, tables.rings_simplified, tables.files_shapes, tables.files_traced_rings):
        assert plan(spark, d).rdd.getNumPartitions() >= 4, plan.__name__


def _candidates(spark, spots, source):
    """Squares of about 40 m around spots (lat, lng)."""
    from fieldloom.operators import discovery as D

    df = spark.createDataFrame([(f"{source}-{k}", float(y), float(x)) for k, (y, x) in enumerate(spots)], "name string, y double, x double")
    return D.as_candidates(df.withColumn("ring", G.rectangle("y", "x", F.lit(0.0002), F.lit(0.0002))), source, F.col("name"))


def test_requests_with_one_circle_are_discovered_once(spark, tmp_path, monkeypatch):
    from fieldloom.operators import discovery as D
    from fieldloom.plans import discoveries as Q

    for name in ("customer", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(1, 303).where("id % 100 < 3").select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    asked, plain = [], D.discover
    monkeypatch.setattr(D, "discover", lambda requests, *a: asked.append(requests.count()) or plain(requests, *a))
    rows = {(r["query_id"], r["rank"]): (r["candidate_id"], r["source"], r["n_points"]) for r in Q.candidates_discovered(spark, str(tmp_path)).collect()}
    assert asked == [3]
    ids = {q for q, _ in rows}
    assert ids == {1, 2, 100, 101, 102, 200, 201, 202, 300, 301, 302}
    for q, rank in rows:
        assert rows[q, rank] == rows[q % 100 + 100, rank] and (q % 100 + 100, rank) in rows
    assert sum(q % 100 == 1 for q, _ in rows) == 4 * sum(q == 101 for q, _ in rows)


def test_full_requests_ask_no_later_sources(spark):
    from fieldloom.operators import discovery as D

    rng = np.random.default_rng(7)
    first = _candidates(spark, np.concatenate([rng.uniform(-0.003, 0.003, (120, 2)), rng.uniform(0.297, 0.303, (12, 2))]), "first")
    spots = np.concatenate([rng.uniform(-0.003, 0.003, (60, 2)), rng.uniform(0.297, 0.303, (12, 2))])
    second, aside = _candidates(spark, spots, "second"), _candidates(spark, spots + 0.0001, "aside")
    requests = spark.createDataFrame([(1, 0.0, 0.0, 0.4), (2, 0.3, 0.3, 0.4), (3, 0.8, 0.8, 0.4)], "query_id long, lat double, lng double, radius_km double")
    asked = []

    def segments(short):
        asked.append(sorted(r["query_id"] for r in short.collect()))
        return D.meeting(aside, short)

    found = D.discover(requests, [first, second], segments)
    rows = sorted((r["query_id"], r["rank"], r["source_rank"]) for r in found.collect())
    assert asked == [[2, 3]]
    assert [r[1:] for r in rows if r[0] == 1] == [(k, 0) for k in range(1, 49)]
    assert {r[2] for r in rows if r[0] == 2} == {0, 1, 2, 99} and {r[2] for r in rows if r[0] == 3} == {99}
    # Segments given as a table, and a source that can't be read but isn't needed.
    again = D.discover(requests, [first, second], segments(requests.select("query_id", "lat", "lng", "radius_km")).select("query_id", *D.COLUMNS))
    assert sorted((r["query_id"], r["rank"], r["source_rank"]) for r in again.collect()) == rows
    broken = second.withColumn("candidate_id", F.raise_error(F.lit("read without need")).cast("string"))
    assert D.discover(requests.where("query_id = 1"), [first, broken]).count() == 48


def test_pairs_of_images_and_regions_never_go_through_the_driver(spark):
    at = lambda y, x: G.point(F.lit(y), F.lit(x))
    images = spark.range(60).select(F.col("id").alias("image_id"), F.lit("2025-01-10").cast("timestamp").alias("ts"), F.lit(0).alias("cloud_pct"), F.array(at(0.0, 0.004), at(0.004, 0.008), at(0.008, 0.004), at(0.004, 0.0)).alias("footprint"))
    regions = spark.range(70).select(F.col("id").alias("region_id"), G.rectangle(F.lit(0.004), F.lit(0.004), F.lit(0.001), F.lit(0.001)).alias("ring"))
    pairs = E.images_over(images, regions, "2025-01-01", "2025-02-01", 30)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert pairs.distinct().count() == pairs.count() == 60 * 70
