"""Queries over the registry of parcels, scan runs and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.functions.mathx import round_up
from fieldloom.operators import registry as R
from fieldloom.plans.geo import LAT, LNG, r
from fieldloom.sources import files
from fieldloom.sources.fixtures import table, with_, with_ring
from fieldloom.sources.shared import new_folder, spread


def _registry(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcels")
    return p.select(
        "parcel_id",
        F.concat(F.lit("p-"), F.col("parcel_id").cast("string")).alias("label"),
        "center_lat",
        "center_lng",
        "crop_pred",
        "confidence",
        F.when(F.col("parcel_id") % 10 == 0, K.PROTECTED_SOURCE).when(F.col("parcel_id") % 10 == 1, F.lit(None)).otherwise("auto").alias("data_source"),
    )


REGISTRY = with_("parcels") + f""", registry as (select parcel_id, 'p-' || cast(parcel_id as varchar) as label, center_lat, center_lng, crop_pred, confidence, case when parcel_id%10=0 then '{K.PROTECTED_SOURCE}' when parcel_id%10=1 then null else 'auto' end as data_source from parcels)"""


def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _registry(spark, d)
    new = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p-"), (F.col("p_partkey") + 500).cast("string")).alias("label"), F.col("p_partkey").cast("double").alias("confidence"), F.lit("NEW").alias("crop_pred"))
    return R.upsert(old, new, "label", ["label", "confidence", "crop_pred"])


REGISTRY_UPSERT = REGISTRY + """, fresh as (select 'p-' || cast(p_partkey+500 as varchar) as label, cast(p_partkey as double) as confidence from part)
select r.parcel_id, coalesce(r.label, f.label) as label, r.center_lat, r.center_lng, case when f.label is not null then 'NEW' else r.crop_pred end as crop_pred, case when f.label is not null then f.confidence else r.confidence end as confidence, r.data_source
from registry r full outer join fresh f on f.label = r.label
"""


def registry_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same upsert on a registry kept in buckets, of which it rewrites those that new rows fall into; rows of new that repeat a key are settled by the last."""
    registry = R.Registry(spark, new_folder(spark), "label", buckets=16)
    registry.write(_registry(spark, d))
    fresh = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p-"), (F.col("p_partkey") + 500).cast("string")).alias("label"), F.explode(F.array(F.lit(1), F.lit(0))).alias("seen"), F.col("p_partkey").cast("double").alias("p"))
    fresh = fresh.select("label", "seen", (F.col("p") * F.col("seen")).alias("confidence"), F.lit("NEW").alias("crop_pred"))
    registry.upsert(fresh, ["label", "confidence", "crop_pred"], latest="seen")
    return registry.read()


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") * 17).alias("parcel_id"))


def registry_delete(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each id that is to go."""
    return R.delete(_registry(spark, d), _wanted(spark, d))[1]


REGISTRY_DELETE = REGISTRY + f""", ids as (select s_suppkey*17 as parcel_id from supplier)
select i.parcel_id, case when r.parcel_id is null then 'missing' when r.data_source = '{K.PROTECTED_SOURCE}' then 'refused' else 'deleted' end as outcome from ids i left join registry r using (parcel_id)
"""


def registry_remaining(spark: SparkSession, d: str) -> DataFrame:
    return R.delete(_registry(spark, d), _wanted(spark, d))[0]


REGISTRY_REMAINING = REGISTRY + f""" select * from registry where parcel_id not in (select s_suppkey*17 from supplier) or coalesce(data_source = '{K.PROTECTED_SOURCE}', false)"""


def registry_near(spark: SparkSession, d: str) -> DataFrame:
    """Registered parcels that meet a circle, the box first."""
    p = R.near_box(table(spark, d, "parcels"), LAT, LNG, 2.5)
    return with_ring(p).where(G.meets_circle(F.col("ring"), LAT, LNG, 2.5)).select("parcel_id")


REGISTRY_NEAR = with_("parcels") + """
select parcel_id from parcels where abs(center_lat+19.85e0) <= 2.5e0/110.574e0 and abs(center_lng-47.03e0) <= 2.5e0/(111.32e0*cos(radians(-19.85e0)))
and sqrt(pow(greatest(abs(center_lng-47.03e0)-half_lng, 0e0)*111.32e0*cos(radians(-19.85e0)),2) + pow(greatest(abs(center_lat+19.85e0)-half_lat, 0e0)*110.574e0,2)) <= 2.5e0
"""


def runs_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_run(table(spark, d, "scan_runs"), "v1", LAT, LNG, 0.05)


RUNS_LATEST = with_("scan_runs") + "select * from scan_runs where version = 'v1' and abs(center_lat+19.85e0) <= 0.05e0 and abs(center_lng-47.03e0) <= 0.05e0 order by created_at desc, run_id desc limit 1"


def runs_serialised(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "scan_runs").withColumn("updated_at", F.col("created_at"))
    return R.newest_first(R.serialise(runs), "run_id")


RUNS_SERIALISED = with_("scan_runs") + "select run_id, version, center_lat, center_lng, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, score from scan_runs"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        o.alias("request_id"),
        (o % 200 - 100).cast("double").alias("latitude"),
        (o % 400 - 200).cast("double").alias("longitude"),
        (o % 30_000).cast("double").alias("radius"),
        F.when(o % 7 == 0, F.lit(None)).otherwise((o % 100) / 100.0).alias("confidence_threshold"),
        ((o % 700) / 100.0).alias("min_area_ha"),
        (o % 60 - 25).cast("double").alias("base_temperature"),
        (o % 12_000).cast("double").alias("threshold"),
        (o % 800).alias("period_days"),
    )


def requests_checked(spark: SparkSession, d: str) -> DataFrame:
    checked = R.validate(_requests(spark, d), R.REQUESTS["analyze"]())
    return checked.select("request_id", F.concat_ws(",", "errors").alias("errors"))


REQUESTS_CHECKED = """
select o_orderkey as request_id, concat_ws(',', case when not (o_orderkey%200-100 between -90 and 90) then 'latitude' end, case when not (o_orderkey%400-200 between -180 and 180) then 'longitude' end,
  case when not (o_orderkey%30000 between 50 and 20000) then 'radius' end, case when o_orderkey%7=0 or not ((o_orderkey%100)/100e0 between 0.5e0 and 0.95e0) then 'confidence_threshold' end,
  case when not ((o_orderkey%700)/100e0 between 0.01e0 and 5) then 'min_area_ha' end, case when not (o_orderkey%60-25 between -20 and 30) then 'base_temperature' end,
  case when not (o_orderkey%12000 between 2000 and 10000) then 'threshold' end, case when not (o_orderkey%800 between 1 and 730) then 'period_days' end) as errors from orders
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of 90 queries from three sources of falling priority, which serve different queries."""
    named = lambda name, id, query: table(spark, d, name).select(query.alias("query_id"), F.col(id).cast("string").alias("candidate_id"), "center_lat", "center_lng")
    t, p, c = named("traced", "traced_id", F.col("traced_id") % 60), named("parcels", "parcel_id", F.col("parcel_id") % 40 + 30), named("parcels", "parcel_id", F.col("parcel_id") % 90)
    prefixed = lambda df, prefix: df.withColumn("candidate_id", F.concat(F.lit(prefix), "candidate_id"))
    return R.rank_sources(prefixed(t, "vhr-"), prefixed(p, "db-"), prefixed(c, "cell-"))


CANDIDATES = with_("parcels", "traced") + """, cand as (
  select traced_id%60 as query_id, 'vhr-' || cast(traced_id as varchar) as candidate_id, center_lat, center_lng, 0 as source_rank from traced
  union all select parcel_id%40+30, 'db-' || cast(parcel_id as varchar), center_lat, center_lng, 1 from parcels
  union all select parcel_id%90, 'cell-' || cast(parcel_id as varchar), center_lat, center_lng, 2 from parcels)"""


def candidates_first_source(spark: SparkSession, d: str) -> DataFrame:
    return R.first_available(_candidates(spark, d), "query_id").select("query_id", "candidate_id", F.col("source_rank").cast("long").alias("source_rank"))


CANDIDATES_FIRST_SOURCE = CANDIDATES + " select query_id, candidate_id, cast(source_rank as bigint) as source_rank from (select *, min(source_rank) over (partition by query_id) as m from cand) where source_rank = m"


def candidates_thinned(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query without those close to one kept before."""
    return R.thin(_candidates(spark, d), "query_id", "source_rank", "candidate_id", apart_km=0.4).select("query_id", "candidate_id")


#: A query's candidates in their order: one stays if it is far from all those that stayed, whose places a list holds.
CANDIDATES_THINNED = CANDIDATES.replace("with ", "with recursive ", 1) + """, c as materialized (select *, row_number() over (partition by query_id order by source_rank, candidate_id) as k from cand),
walk(query_id, k, kept, lats, lngs) as (
  select query_id, 1::bigint, candidate_id, [center_lat], [center_lng] from c where k = 1
  union all
  select w.query_id, c.k, case when far then c.candidate_id end, case when far then list_append(w.lats, c.center_lat) else w.lats end, case when far then list_append(w.lngs, c.center_lng) else w.lngs end
  from walk w join c on c.query_id = w.query_id and c.k = w.k + 1
  cross join lateral (select coalesce(min(sqrt(pow((c.center_lng-o.lng)*111.32e0*greatest(abs(cos(radians(o.lat))), 0.1e0), 2)+pow((c.center_lat-o.lat)*110.574e0, 2))), 1e9) >= 0.4e0 as far from (select unnest(w.lats) as lat, unnest(w.lngs) as lng) o))
select query_id, kept as candidate_id from walk where kept is not null
"""


def candidates_analysed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their results, ranked in their query; those without one say why."""
    from pyspark.sql import Window as W

    c = _candidates(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("source_rank", "candidate_id")))
    results = table(spark, d, "parcels").select(F.concat(F.lit("db-"), F.col("parcel_id").cast("string")).alias("candidate_id"), F.col("crop_pred").alias("analysis")).where("analysis in ('MACHINERY', 'BUILDING')")
    return R.with_results(c, results).select("query_id", "candidate_id", F.col("rank").cast("long").alias("place"), "analysis", "analysis_error")


CANDIDATES_ANALYSED = CANDIDATES + """, ranked as (select *, row_number() over (partition by query_id order by source_rank, candidate_id) as place from cand),
res as (select 'db-' || cast(parcel_id as varchar) as candidate_id, crop_pred as analysis from parcels where crop_pred in ('MACHINERY', 'BUILDING'))
select query_id, candidate_id, place, analysis, case when analysis is null then case when place > 48 then 'Analyse IA non exécutée pour cette parcelle.' else 'Analyse IA non exécutée : délai de recherche automatique dépassé (trop de parcelles candidates).' end end as analysis_error
from ranked left join res using (candidate_id)
"""


def geojson_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Features and bare geometries as texts, parsed back to rings."""
    p = with_ring(spread(table(spark, d, "traced")))
    coords = F.to_json(F.array(G.close(F.col("ring"))))
    bare = F.concat(F.lit('{"type":"Polygon","coordinates":'), coords, F.lit("}"))
    text = F.when(F.col("traced_id") % 4 == 0, bare).when(F.col("traced_id") % 4 == 1, F.concat(F.lit('{"type":"Feature","geometry":'), bare, F.lit("}"))).when(F.col("traced_id") % 4 == 2, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), coords, F.lit("]}"))).otherwise('{"type":"Point","coordinates":[1,2]}')
    out = files.parse_traced(p.select("traced_id", text.alias("feature")))
    return out.select("traced_id", F.size(P.points(F.col("shape"))).cast("long").alias("n_points"), round_up(P.area_deg2(F.col("shape")) * 1e6, 6).alias("area"))


GEOJSON_PARSED = with_("traced") + f"select traced_id, cast(4 as bigint) as n_points, {r('4*half_lat*half_lng*1e6', 6)} as area from traced where traced_id%4 <> 3"

QUERIES = {
    "registry_buckets": (registry_buckets, REGISTRY_UPSERT),
    "registry_upsert": (registry_upsert, REGISTRY_UPSERT),
    "registry_delete": (registry_delete, REGISTRY_DELETE),
    "registry_remaining": (registry_remaining, REGISTRY_REMAINING),
    "registry_near": (registry_near, REGISTRY_NEAR),
    "runs_latest": (runs_latest, RUNS_LATEST),
    "runs_serialised": (runs_serialised, RUNS_SERIALISED),
    "requests_checked": (requests_checked, REQUESTS_CHECKED),
    "candidates_first_source": (candidates_first_source, CANDIDATES_FIRST_SOURCE),
    "candidates_thinned": (candidates_thinned, CANDIDATES_THINNED),
    "candidates_analysed": (candidates_analysed, CANDIDATES_ANALYSED),
    "geojson_parsed": (geojson_parsed, GEOJSON_PARSED),
}
