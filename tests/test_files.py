"""File sources and sinks, artefact checks and streams."""

import io
import datetime as dt
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.operators import raster as A
from fieldloom.operators import zones as Z
from fieldloom.sources import files
from fieldloom.streaming import weather as SW


def test_geojson_round_trip(spark, tmp_path):
    square = [[47.0, -19.0], [47.1, -19.0], [47.1, -18.9], [47.0, -18.9], [47.0, -19.0]]
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square]}, "properties": {"parcel_id": "a", "confidence": 0.5, "extra": 1}},
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"parcel_id": "b"}},
            {"type": "Feature", "geometry": None, "properties": {"parcel_id": "c"}},
        ],
    }
    (tmp_path / "p.geojson").write_text(json.dumps(doc))
    df = files.read_geojson(spark, str(tmp_path / "p.geojson"), "parcel_id string, confidence double, crop_pred string")
    rows = df.collect()
    assert [(r.parcel_id, r.confidence, r.crop_pred, len(r["shape"][0][0])) for r in rows] == [("a", 0.5, None, 4)]
    back = json.loads(files.to_geojson(df, "parcel_id", polygon="shape").first().geojson)
    assert back["features"][0]["geometry"]["coordinates"][0] == square and back["features"][0]["properties"] == {"parcel_id": "a"}


def test_kml(spark, tmp_path):
    mark = "<Placemark><name> {0} </name><Style><LineStyle><color>{1}</color></LineStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>47.0,-19.0,0 47.1,-19.0,0 47.1,-18.9,0 47.0,-19.0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    (tmp_path / "a.kml").write_text("<kml><Document>" + mark.format("g", "ff00ff00") + mark.format("r", "ff0000ff") + mark.format("b", "ffff0000") + "</Document></kml>")
    rows = files.read_kml(spark, str(tmp_path / "a.kml")).orderBy("name").collect()
    assert [(r.name, r.label, len(r.ring)) for r in rows] == [("g", 1, 3), ("r", 0, 3)]


def test_overpass(spark, tmp_path):
    way = {"type": "way", "id": 5, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}], "tags": {"landuse": "farmland"}}
    (tmp_path / "o.json").write_text(json.dumps({"elements": [way, {"type": "relation", "id": 6}, {"type": "way", "id": 7, "geometry": [{"lat": 0, "lon": 0}]}]}))
    rows = files.read_overpass(spark, str(tmp_path / "o.json")).collect()
    assert [(r.candidate_id, len(r.ring), r.tags["landuse"]) for r in rows] == [("osm-way-5", 3, "farmland")]


def test_traced_files_prune_and_decode(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("ftw_id"), (F.col("id") % 100).cast("double").alias("confidence"), F.lit(0.3).alias("area_ha"), G.rectangle(-20 + F.col("id") % 20 / 10, 47 + F.floor(F.col("id") / 20) / 10, F.lit(0.001), F.lit(0.001)).alias("ring"))
    files.write_traced(df, str(tmp_path / "t"), rows_a_file=100)
    read = files.read_traced(spark, str(tmp_path / "t"))
    assert read.count() == 400
    ring = read.where("ftw_id = 21").select(P.of_wkb()(F.col("geometry")).alias("r")).first().r[0][0]
    assert len(ring) == 4 and abs(ring[0]["lat"] + 19.901) < 1e-9
    near = Z.traced_in_circle(read, -19.9, 47.1, 500)
    assert [r.ftw_id for r in near.collect()] == [21]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(xmax" in plan and "geometry" not in plan.split("ReadSchema")[1].split("\n")[0]


def _wkb(rings):
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    return out


def test_holes_and_parts_of_wkb(spark):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    blobs = [_wkb([box(0, 0, 4), box(1, 1, 2)]), struct.pack("<BII", 1, 6, 2) + _wkb([box(0, 0, 4)[::-1], box(1, 1, 1)]) + _wkb([box(6, 0, 1)]), _wkb([box(0, 0, 4)]), struct.pack("<BIdd", 1, 1, 0.0, 0.0), None, b""]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(blobs)], "k int, b binary").withColumn("shape", P.of_wkb()(F.col("b")))
    inside = lambda x, y: P.contains(F.col("shape"), F.lit(y), F.lit(x))
    got = rows.where("shape is not null").orderBy("k").select("k", P.area_deg2(F.col("shape")).alias("a"), inside(0.5, 0.5).alias("p"), inside(1.5, 1.5).alias("q"), inside(6.5, 0.5).alias("r")).collect()
    assert [tuple(r) for r in got] == [(0, 12.0, True, False, False), (1, 16.0, True, False, True), (2, 16.0, True, True, False)]


def test_features_keep_their_order_over_files(spark, tmp_path):
    square = [[[47.0, -19.0], [47.1, -19.0], [47.1, -18.9], [47.0, -19.0]]]
    for name, ids in (("b", [3, 1]), ("a", [1, 2])):
        doc = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": square}, "properties": {"parcel_id": i, "confidence": 0.5}} for i in ids]}
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc))
    rows = Z.best_by_id(files.read_geojson(spark, str(tmp_path), "parcel_id long, confidence double")).orderBy("pos").collect()
    assert [(r.parcel_id, r.ord) for r in rows] == [(1, 0), (2, 1), (3, 1 << 32)]


def test_footer_threshold_and_inventory(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}).replace_schema_metadata({"extent": "46.9"}), str(tmp_path / "t.parquet"))
    assert files.footer(str(tmp_path / "t.parquet"))["extent"] == "46.9" == files.footer(f"file://{tmp_path}/t.parquet")["extent"]
    for model, parts in {"one": {"bundle.json": {"threshold": 0.4}, "threshold_selection.json": {"seuil_retenu": 0.3268}}, "two": {"threshold_selection.json": {"seuil_retenu": 0.3268}}, "three": {"metrics.json": {}}}.items():
        (tmp_path / "models" / model).mkdir(parents=True)
        for name, body in parts.items():
            (tmp_path / "models" / model / name).write_text(json.dumps(body))
    found = files.read_artefacts(spark, str(tmp_path / "models"))
    assert {r.model: r.threshold for r in files.chosen_threshold(found, 0.5).collect()} == {"one": 0.4, "two": 0.3268, "three": 0.5}
    assert {r.model: (r.n_files, r.missing, r.healthy) for r in files.inventory(found, ["bundle.json"]).collect()} == {"one": (2, [], True), "two": (1, ["bundle.json"], False), "three": (1, ["bundle.json"], False)}


def test_npy_plain_and_structured(spark, tmp_path):
    def npy(a):
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    both = np.zeros((2, 3), [("NDVI", "f4"), ("grad", "f4")])
    both["NDVI"] = [[1, 2, np.nan], [4, 5, 6]]
    (tmp_path / "a.npy").write_bytes(npy(both))
    (tmp_path / "b.npy").write_bytes(npy(np.arange(4, dtype="f4").reshape(2, 2)))
    df = A.read_npy(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {(r.band, r.row, r.col): r.value for r in df.collect()}
    assert len(got) == 16 and got["NDVI", 0, 2] is None and got["NDVI", 1, 1] == 5 and got["value", 1, 0] == 2


def test_artefacts(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"threshold": 0.3}')
    row = files.read_artefacts(spark, str(tmp_path)).first()
    assert row.size == 18 and len(row.sha256) == 64 and json.loads(row.body)["threshold"] == 0.3
    models = spark.createDataFrame([("RandomForestClassifier", ["f"] * 48, 0.3), ("RandomForestClassifier", [str(k) for k in range(48)], 0.3), ("Other", ["a"], 1.5)], "kind string, features array<string>, threshold double")
    assert [r.errors for r in files.check_artefacts(models).collect()] == [["unique"], [], ["kind", "features", "threshold"]]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = SW.event_stream(spark, str(tmp_path / "in"), events.schema)
    query = SW.daily_weather(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.site_id, r.obs_date): r.tmax for r in spark.table("daily").collect()}
    want = events.groupBy("user_id", F.to_date("ts").alias("d")).agg((F.max("value") / 10).alias("m")).collect()
    assert got == {(r.user_id, r.d): r.m for r in want}


def test_streamed_days_make_the_months_and_are_given_out_once(spark, tmp_path):
    """In append mode a day comes out when the watermark has passed it; its state goes."""
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * k), float(k)) for k in range(120) for s in (1, 2)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    for k in range(6):
        events.where((F.col("value") >= 20 * k) & (F.col("value") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SW.daily_totals(SW.event_stream(spark, str(tmp_path / "in"), events.schema))
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "days"))
    query.awaitTermination(180)
    days = spark.read.schema("site_id long, day date, value double").parquet(str(tmp_path / "days"))
    assert days.count() == days.select("site_id", "day").distinct().count() > 60
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 12
    through = days.agg(F.max("day")).first()[0]
    got = {(r.site_id, r.month): r.value for r in SW.monthly_totals(days).collect()}
    want = events.where(F.to_date("ts") <= F.lit(through)).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("m")).agg(F.sum("value").alias("v")).collect()
    assert got == {(r.user_id, r.m): r.v for r in want}


def test_an_index_of_boxes_spares_files(spark, tmp_path):
    """A table of circles reads the files whose row groups meet one of them, and no others."""
    df = spark.range(400).select(F.col("id").alias("ftw_id"), (F.col("id") % 100).cast("double").alias("confidence"), F.lit(0.3).alias("area_ha"), G.rectangle(-20 + F.col("id") % 20 / 10, 47 + F.floor(F.col("id") / 20) / 10, F.lit(0.001), F.lit(0.001)).alias("ring"))
    path = str(tmp_path / "t")
    files.write_traced(df, path)
    index = files.index_traced(spark, path)
    assert index.agg(F.sum("n_rows")).first()[0] == 400
    circles = spark.createDataFrame([(1, -19.9, 47.1, 500.0), (2, -19.9, 47.2, 15_000.0), (3, 10.0, 10.0, 900.0)], "query_id int, lat double, lng double, radius_m double")
    near = files.read_traced_near(spark, path, index, circles)
    everything = spark.read.parquet(path)
    assert 0 < len(near.inputFiles()) < len(everything.inputFiles())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(xmax" in plan
    got = {(r.query_id, r.ftw_id) for r in Z.traced_in_circles(near, circles).collect()}
    assert got == {(q.query_id, r.ftw_id) for q in circles.collect() for r in Z.traced_in_circle(everything, q.lat, q.lng, q.radius_m).collect()} and len(got) > 4
    assert files.read_traced_near(spark, path, index, circles.where("query_id = 3")).count() == 0
