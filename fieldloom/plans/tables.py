"""Queries that write tables to files of each format and read them back, and queries over single operators of the registry, scenes and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.functions import text as T
from fieldloom.functions.mathx import round_up
from fieldloom.operators import registry as R
from fieldloom.operators import scoring as C
from fieldloom.operators import series as E
from fieldloom.operators import zones as Z
from fieldloom.plans.geo import LAT, LNG, hav, r, with_holes
from fieldloom.plans.registers import REGISTRY, _registry, _requests
from fieldloom.plans.zone import RADIUS, ZONE_TRACED
from fieldloom.sources import files
from fieldloom.sources.fixtures import table, with_, with_ring
from fieldloom.sources.shared import new_folder, spread, written
from fieldloom.streaming import weather as SW

#: Documents of a written feature collection, at least, and items of one, about.
DOCUMENTS, ITEMS = 16, 2_000


def files_traced(spark: SparkSession, d: str) -> DataFrame:
    """Traced parcels of a circle, read from a file along a Z-order curve: bounds skip row groups, and the geometry is not read."""
    t = with_ring(spread(table(spark, d, "traced")))
    folder = new_folder(spark)
    files.write_traced(t.select(F.col("traced_id").alias("ftw_id"), "confidence", round_up(G.area_ha(F.col("ring"), F.col("center_lat")), 6).alias("area_ha"), "ring"), folder)
    return Z.traced_in_circle(files.read_traced(spark, folder), LAT, LNG, RADIUS, 20, 0.05)


def files_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The nearest five traced parcels of a circle around each supplier, from the files that an index of row-group boxes says may hold some."""
    t, folder = with_ring(spread(table(spark, d, "traced"))), new_folder(spark)
    area = round_up(G.area_ha(F.col("ring"), F.col("center_lat")), 6)
    files.write_traced(t.select(F.col("traced_id").alias("ftw_id"), "confidence", area.alias("area_ha"), "ring"), folder)
    k = F.col("s_suppkey")
    circles = spark.read.parquet(f"{d}/supplier.parquet").select(k.cast("long").alias("query_id"), (-19.9 + (k * 41 % 100) / 1000.0).alias("lat"), (46.98 + (k * 59 % 100) / 1000.0).alias("lng"), (300.0 + k % 7 * 100).alias("radius_m"))
    index = written(files.index_traced(spark, folder))
    found = Z.traced_in_circles(files.read_traced_near(spark, folder, index, circles), circles, 20, 0.05, 5)
    return found.select("query_id", "ftw_id", "confidence", "area_ha", "distance_m", F.col("rank").cast("long").alias("rank"))


FILES_INDEXED = with_("traced") + f""", c as (select cast(s_suppkey as bigint) as query_id, -19.9e0+(s_suppkey*41%100)/1000e0 as lat, 46.98e0+(s_suppkey*59%100)/1000e0 as lng, 300e0+s_suppkey%7*100 as radius_m from supplier),
t as (select *, floor(4*half_lat*half_lng*111132e0*111320e0*cos(radians(center_lat))/10000*1e6+0.5e0)/1e6 as area from traced),
n as (select query_id, traced_id as ftw_id, confidence, area, {hav('lng', 'lat', 'center_lng', 'center_lat')} as dist, radius_m from c join t on abs(center_lat-lat) < 0.02e0 and abs(center_lng-lng) < 0.02e0 where confidence >= 20 and area >= 0.05e0)
select query_id, ftw_id, {r('confidence', 1)} as confidence, {r('area', 4)} as area_ha, cast(floor(dist) as integer) as distance_m, row_number() over (partition by query_id order by dist, ftw_id) as rank from n where dist <= radius_m qualify rank <= 5
"""


def files_traced_rings(spark: SparkSession, d: str) -> DataFrame:
    """Geometries that went to WKB and back."""
    folder = new_folder(spark)
    t = with_ring(spread(table(spark, d, "traced")))
    files.write_traced(t.select(F.col("traced_id").alias("ftw_id"), "confidence", F.lit(0.0).alias("area_ha"), "ring"), folder)
    shape = spread(files.read_traced(spark, folder).select("ftw_id", "geometry")).select("ftw_id", P.of_wkb()(F.col("geometry")).alias("shape"))
    return shape.select("ftw_id", F.size(P.points(F.col("shape"))).cast("long").alias("n_points"), round_up(P.area_deg2(F.col("shape")) * 1e6, 6).alias("area"))


FILES_TRACED_RINGS = with_("traced") + f"select traced_id as ftw_id, cast(4 as bigint) as n_points, {r('4*half_lat*half_lng*1e6', 6)} as area from traced"


def _documents(df: DataFrame, item: str, key: str, start: str, end: str, folder: str) -> None:
    """Writes texts as documents, a file each, that enclose a list of their items; a document has some ITEMS however many there are."""
    grouped = df.groupBy(F.pmod(F.xxhash64(key), F.lit(max(DOCUMENTS, df.count() // ITEMS))).alias("_d")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    grouped.select(F.concat(F.lit(start), F.array_join("items", "," if start.startswith("{") else ""), F.lit(end)).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def files_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Polygons with a hole and a second part, written as GeoJSON and as WKB and read back: each comes back with its parts and rings, outer ones counter-clockwise."""
    shaped = with_holes(spark, d).select("parcel_id", F.col("ring").alias("shape"))
    folder = new_folder(spark)
    shaped.select("parcel_id", P.to_geojson(F.col("shape")).alias("text"), P.to_wkb()(F.col("shape")).alias("wkb")).write.parquet(folder)
    back = spread(spark.read.parquet(folder))
    both = back.select("parcel_id", F.lit("geojson").alias("kind"), P.of_geojson(F.col("text")).alias("shape")).unionByName(back.select("parcel_id", F.lit("wkb").alias("kind"), P.of_wkb()(F.col("wkb")).alias("shape")))
    turns = F.transform(P.rings(F.col("shape")), lambda ring: F.when(G.signed_deg2(ring) > 0, "+").otherwise("-"))
    return both.select("parcel_id", "kind", F.size("shape").cast("long").alias("n_parts"), F.array_join(turns, "").alias("turns"), round_up(P.area_deg2(F.col("shape")) * 1e6, 6).alias("area"))


FILES_SHAPES = with_("parcels") + f"select parcel_id, kind, cast(2 as bigint) as n_parts, '+-+' as turns, {r('4.75e0*half_lat*half_lng*1e6', 6)} as area from parcels, (select unnest(['geojson', 'wkb']) as kind)"


def files_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Parcels written as feature collections and read back, the most confident of each id."""
    p = with_ring(spread(table(spark, d, "parcels")))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(G.close(F.col("ring"))).alias("coordinates")).alias("geometry"), F.struct("parcel_id", "crop_pred", "confidence").alias("properties")))
    folder = new_folder(spark)
    _documents(p.withColumn("f", feature), "f", "parcel_id", '{"type":"FeatureCollection","features":[', "]}", folder)
    read = Z.best_by_id(files.read_geojson(spark, folder, "parcel_id long, crop_pred string, confidence double"))
    return read.select("parcel_id", "crop_pred", "confidence", round_up(P.area_deg2(F.col("shape")) * 1e6, 6).alias("area"))


FILES_GEOJSON = with_("parcels") + f"select parcel_id, crop_pred, confidence, {r('4*half_lat*half_lng*1e6', 6)} as area from parcels"


def files_kml(spark: SparkSession, d: str) -> DataFrame:
    """Placemarks whose colour tells the crop."""
    p = with_ring(table(spark, d, "parcels"))
    color = F.when(F.col("crop_pred") == "BUILDING", "ff00ff00").when(F.col("crop_pred") == "MACHINERY", "ff0000ff").otherwise("ffff0000")
    points = F.array_join(F.transform(G.close(F.col("ring")), lambda c: F.concat(c[0].cast("string"), F.lit(","), c[1].cast("string"), F.lit(",0"))), " ")
    mark = F.concat(F.lit("<Placemark><name> p-"), F.col("parcel_id").cast("string"), F.lit(" </name><Style><LineStyle><color>"), color, F.lit("</color></LineStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>"), points, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    folder = new_folder(spark)
    _documents(p.withColumn("m", mark), "m", "parcel_id", "<kml><Document>", "</Document></kml>", folder)
    return files.read_kml(spark, folder).select("name", F.col("label").cast("int").alias("label"), F.size("ring").cast("long").alias("n_points"))


FILES_KML = with_("parcels") + "select 'p-' || cast(parcel_id as varchar) as name, cast(case crop_pred when 'BUILDING' then 1 else 0 end as integer) as label, cast(4 as bigint) as n_points from parcels where crop_pred in ('BUILDING', 'MACHINERY')"


def files_overpass(spark: SparkSession, d: str) -> DataFrame:
    """Ways of written answers; relations between them are left out."""
    t = with_ring(table(spark, d, "traced"))
    geometry = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lon")))
    element = F.to_json(F.struct(F.when(F.col("confidence").isNull(), "relation").otherwise("way").alias("type"), F.col("traced_id").alias("id"), geometry.alias("geometry"), F.struct(F.lit("farmland").alias("landuse")).alias("tags")))
    folder = new_folder(spark)
    _documents(t.withColumn("e", element), "e", "traced_id", '{"elements":[', "]}", folder)
    return files.read_overpass(spark, folder).select("candidate_id", F.size("ring").cast("long").alias("n_points"), F.col("tags")["landuse"].alias("landuse"))


FILES_OVERPASS = with_("traced") + "select 'osm-way-' || cast(traced_id as varchar) as candidate_id, cast(4 as bigint) as n_points, 'farmland' as landuse from traced where confidence is not null"


def runs_appended(spark: SparkSession, d: str) -> DataFrame:
    """Scan runs of a log to which two lots were added."""
    runs, folder = table(spark, d, "scan_runs"), new_folder(spark)
    first = F.col("created_at") < "1997-01-01"
    for lot in (first, ~first):
        files.append_log(runs.where(lot), folder)
    return spark.read.parquet(folder).groupBy(F.to_date("created_at").alias("run_day")).agg(F.count(F.lit(1)).alias("n_runs"), round_up(F.sum("score"), 2).alias("score"))


RUNS_APPENDED = with_("scan_runs") + f"select cast(created_at as date) as run_day, count(*) as n_runs, {r('sum(score)', 2)} as score from scan_runs group by 1"


def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.lookup(_registry(spark, d), label="p-77", data_source="auto").select("parcel_id", "label", "crop_pred")


REGISTRY_LOOKUP = REGISTRY + " select parcel_id, label, crop_pred from registry where label = 'p-77' and data_source = 'auto'"


def registry_inserted(spark: SparkSession, d: str) -> DataFrame:
    """The registry with new parcels, whose other columns are null."""
    old = _registry(spark, d).withColumn("created_at", F.lit("2025-01-01").cast("date")).select("parcel_id", "label", "confidence", "created_at")
    new = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("label"), F.lit(0.5).alias("confidence"))
    return R.insert(old, new, F.lit("2026-02-05").cast("date"))


REGISTRY_INSERTED = REGISTRY + """ select parcel_id, label, confidence, date '2025-01-01' as created_at from registry
union all select null, 'n-' || cast(n_nationkey as varchar), 0.5e0, date '2026-02-05' from nation"""


def requests_split(spark: SparkSession, d: str) -> DataFrame:
    """Circle requests: how many are valid, and how many break each rule."""
    q = _requests(spark, d).select("request_id", "radius", F.col("confidence_threshold").alias("min_confidence"))
    good, bad = R.split_valid(q, "zone")
    broken = bad.select(F.explode("errors").alias("rule"))
    return good.select(F.lit("none").alias("rule")).unionByName(broken).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


REQUESTS_SPLIT = """with q as (select o_orderkey%30000 as radius, case when o_orderkey%7=0 then null else (o_orderkey%100)/100e0 end as c from orders), b as (select radius > 0 and radius <= 20000 as r_ok, coalesce(c between 0 and 1, false) as c_ok from q)
select 'none' as rule, count(*) as n from b where r_ok and c_ok having count(*) > 0 union all select 'radius', count(*) from b where not r_ok having count(*) > 0 union all select 'min_confidence', count(*) from b where not c_ok having count(*) > 0
"""


def scenes_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of an interval, of one mode and not too cloudy, by region."""
    s = table(spark, d, "scene_pixels").withColumn("instrument_mode", F.when(F.col("pixel_id") == 0, "EW").otherwise("IW"))
    chosen = E.scenes_of(s, "1995-03-01", "1995-06-01", 35, "IW")
    return chosen.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.max("cloud_pct").alias("most_cloud"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


SCENES_CHOSEN = with_("scene_pixels") + """select region_id, count(*) as n, max(cloud_pct) as most_cloud, cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day
from scene_pixels where ts >= '1995-03-01' and ts < '1995-06-01' and cloud_pct < 35 and pixel_id <> 0 group by 1"""


def months_zipped(spark: SparkSession, d: str) -> DataFrame:
    """Lists of results in the order of months, a row a month; lists may be too short."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 5 + 1).cast("int")), lambda k: (k * 10).cast("double")).alias("values"))
    return E.month_results(s, E.month_windows(spark, "2025-06-15", 6)).withColumnRenamed("label", "month_key")


MONTHS_ZIPPED = """select s_suppkey as id, '2025-0' || cast(k as varchar) as month_key, case when k <= s_suppkey%5+1 then k*10e0 end as value from supplier, (select unnest(range(1, 7)) as k)"""


def network_answers(spark: SparkSession, d: str) -> DataFrame:
    """A network's answers that are whole, and the barley contours that follow from them."""
    a = with_ring(table(spark, d, "parcels")).join(table(spark, d, "analyses").select("parcel_id", "cnn_confidence", "cnn_is_barley", "rf_probability", "ndvi"), "parcel_id")
    p = F.when(F.col("rf_probability").isNull(), F.lit(float("nan"))).otherwise(F.col("rf_probability"))
    a = a.withColumn("answer", C.network_answer(F.col("cnn_confidence"), F.col("cnn_is_barley"), p, 1 - p))
    a = a.withColumn("contour", C.segment(F.col("ring"), F.col("answer.is_barley"), F.col("answer.confidence"), F.col("ndvi"), G.area_deg2(F.col("ring")) * 1e10, 70))
    return a.where("answer is not null").select("parcel_id", F.col("answer.is_barley").alias("is_barley"), F.col("contour.confidence").alias("confidence"), F.size("contour.coordinates").cast("long").alias("n_points"), F.col("contour.ndvi").alias("ndvi"), round_up(F.col("contour.area_ha"), 1).alias("area_ha"))


NETWORK_ANSWERS = with_("parcels", "analyses") + f""", a as (select p.parcel_id, cnn_is_barley as is_barley, cnn_confidence as c, a.ndvi, 4*half_lat*half_lng*1e6 as area, cnn_is_barley and cnn_confidence >= 70 as yes
  from parcels p join analyses a using (parcel_id) where cnn_confidence is not null and rf_probability is not null)
select parcel_id, is_barley, case when yes then {r('c', 0)} end as confidence, case when yes then cast(4 as bigint) end as n_points, case when yes then ndvi/100 end as ndvi, case when yes then {r(r('area', 2), 1)} end as area_ha from a
"""


def rings_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Rings with a point in the middle of each side, without those that are not needed."""
    t = with_ring(spread(table(spark, d, "traced")))
    middle = lambda a, b: G.point((a["lat"] + b["lat"]) / 2, (a["lng"] + b["lng"]) / 2)
    doubled = F.flatten(F.zip_with("ring", G.following(F.col("ring")), lambda a, b: F.array(a, middle(a, b))))
    return t.select("traced_id", G.simplified(1e-9)(doubled).alias("ring")).select("traced_id", F.size("ring").cast("long").alias("n_points"), round_up(G.area_deg2(F.col("ring")) * 1e6, 6).alias("area"))


# The line runs from the first corner to the last middle, so that the latter stays as its end.
RINGS_SIMPLIFIED = with_("traced") + f"select traced_id, cast(5 as bigint) as n_points, {r('4*half_lat*half_lng*1e6', 6)} as area from traced"


def texts_listed(spark: SparkSession, d: str) -> DataFrame:
    """Lists of texts without their nulls; a missing list is empty."""
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.when(F.col("n_regionkey") > 0, F.array(F.col("n_name"), F.nullif(F.lit("x"), F.when(F.col("n_regionkey") == 2, "x").otherwise("")))).alias("v"))
    return n.select(F.col("n_nationkey").cast("long").alias("k"), F.concat_ws("|", T.as_texts(F.col("v"))).alias("texts"), F.size(T.as_texts(F.col("v"))).cast("long").alias("n"))


TEXTS_LISTED = """select cast(n_nationkey as bigint) as k, case when n_regionkey = 0 then '' when n_regionkey = 2 then n_name else n_name || '|x' end as texts, cast(case when n_regionkey = 0 then 0 when n_regionkey = 2 then 1 else 2 end as bigint) as n from nation"""


def events_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The streaming sums of months, run over a whole table at once."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return SW.monthly_totals(SW.daily_totals(e)).select("site_id", F.col("month").alias("month_key"), round_up(F.col("value"), 3).alias("total"))


EVENTS_MONTHLY = f"select user_id as site_id, strftime(ts, '%Y-%m') as month_key, {r('sum(value)', 3)} as total from events group by 1, 2"

QUERIES = {
    "files_traced": (files_traced, ZONE_TRACED),
    "files_indexed": (files_indexed, FILES_INDEXED),
    "files_traced_rings": (files_traced_rings, FILES_TRACED_RINGS),
    "files_shapes": (files_shapes, FILES_SHAPES),
    "files_geojson": (files_geojson, FILES_GEOJSON),
    "files_kml": (files_kml, FILES_KML),
    "files_overpass": (files_overpass, FILES_OVERPASS),
    "runs_appended": (runs_appended, RUNS_APPENDED),
    "registry_lookup": (registry_lookup, REGISTRY_LOOKUP),
    "registry_inserted": (registry_inserted, REGISTRY_INSERTED),
    "requests_split": (requests_split, REQUESTS_SPLIT),
    "scenes_chosen": (scenes_chosen, SCENES_CHOSEN),
    "months_zipped": (months_zipped, MONTHS_ZIPPED),
    "network_answers": (network_answers, NETWORK_ANSWERS),
    "rings_simplified": (rings_simplified, RINGS_SIMPLIFIED),
    "texts_listed": (texts_listed, TEXTS_LISTED),
    "events_monthly": (events_monthly, EVENTS_MONTHLY),
}
