"""Queries over zones: crops and traced parcels of a circle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions.mathx import round_up
from fieldloom.operators import spatial as S
from fieldloom.operators import zones as Z
from fieldloom.plans.geo import LAT, LNG, hav, r
from fieldloom.sources.fixtures import table, with_, with_ring

RADIUS = 3000.0
MEASURED = "4*half_lat*half_lng*111132e0*111320e0*cos(radians(center_lat))/10000"


def _parcels(spark: SparkSession, d: str) -> DataFrame:
    """Parcels once each, some without an area."""
    raw = with_ring(Z.best_by_id(table(spark, d, "parcels_raw")))
    return raw.withColumn("area_ha", F.when(F.col("ord") % 13 != 0, round_up(G.area_ha(F.col("ring"), F.col("center_lat")), 4)))


BEST = with_("parcels_raw") + """, ranked as (
  select *, row_number() over (partition by parcel_id order by coalesce(confidence, 0) desc, ord) as rn from parcels_raw),
best as (select * from ranked where rn = 1 or parcel_id is null)"""
FOUND = BEST + f""", found as (
  select *, {hav('47.03e0', '-19.85e0', 'center_lng', 'center_lat')} as dist, case when ord%13<>0 then {r(MEASURED, 4)} end as area_ha, {MEASURED} as measured from best),
near as (select *, cast(round_even(dist, 0) as bigint) as distance_m, case when coalesce(area_ha, measured) <= 2 then 'parcelle' else 'bloc' end as granularity from found where dist <= 3000)"""


def parcels_best(spark: SparkSession, d: str) -> DataFrame:
    return Z.best_by_id(table(spark, d, "parcels_raw")).select("parcel_id", "ord", "crop_pred", "confidence", "pos", "unnamed")


PARCELS_BEST = BEST + """, firsts as (select parcel_id, min(ord) as pos from parcels_raw where parcel_id is not null group by 1)
select b.parcel_id, b.ord, b.crop_pred, b.confidence, case when b.parcel_id is null then b.ord else f.pos end as pos, cast(case when b.parcel_id is null then 1 else 0 end as integer) as unnamed
from best b left join firsts f using (parcel_id)
"""


def zone_crops_summary(spark: SparkSession, d: str) -> DataFrame:
    return Z.crop_summary(Z.zone_crops(_parcels(spark, d), LAT, LNG, RADIUS))


ZONE_CROPS_SUMMARY = FOUND + f"""
select coalesce(nullif(crop_pred, ''), '(non predit)') as crop, count(*) as n_parcels, {r('sum(coalesce(area_ha, 0e0))', 2)} as area_ha from near where granularity <> 'bloc' group by 1
"""


def zone_crops_features(spark: SparkSession, d: str) -> DataFrame:
    crops = ["BUILDING", "MACHINERY", "SECOND"]
    found = Z.zone_crops(_parcels(spark, d), LAT, LNG, RADIUS, min_confidence=0.3, crops=crops)
    return Z.ordered(found).select("parcel_id", "crop_pred", "area_ha", "distance_m", "granularity", "geometry_source")


ZONE_CROPS_FEATURES = FOUND + """
select parcel_id, crop_pred, area_ha, distance_m, granularity, 'JECAM' as geometry_source from near where coalesce(confidence, 0) >= 0.3e0 and crop_pred in ('BUILDING', 'MACHINERY', 'SECOND')
"""


def zone_crops_totals(spark: SparkSession, d: str) -> DataFrame:
    return Z.zone_totals(Z.zone_crops(_parcels(spark, d), LAT, LNG, RADIUS), LAT, LNG)


ZONE_CROPS_TOTALS = FOUND + f"""
select count(*) filter (where granularity <> 'bloc') as n_parcels, cast(0 as bigint) as n_from_traced, count(*) filter (where granularity = 'bloc') as n_blocs,
  {r("sum(case when granularity <> 'bloc' then coalesce(area_ha, 0e0) end)", 2)} as area_ha_total, false as outside_coverage from near
"""


def zone_crops_traced(spark: SparkSession, d: str) -> DataFrame:
    plain = with_ring(table(spark, d, "parcels")).withColumn("area_ha", round_up(G.area_ha(F.col("ring"), F.col("center_lat")), 4))
    t = F.col("traced_id")
    area, source = F.when(t % 4 == 0, t % 90 / 32).when(t % 4 == 1, F.lit(0.0)), F.when(t % 5 == 0, "FTW").when(t % 5 == 1, "")
    traced = with_ring(table(spark, d, "traced")).select("traced_id", "ring", "center_lat", "center_lng", area.alias("area_ha"), source.alias("source"))
    return Z.zone_crops(plain, LAT, LNG, RADIUS, traced=traced).select("parcel_id", "source_id", "crop_pred", "area_ha", "distance_m", "cover_ratio", "granularity", "geometry_source")


ZONE_CROPS_TRACED = with_("parcels", "traced") + f""", near as (
  select *, {hav('47.03e0', '-19.85e0', 'center_lng', 'center_lat')} as dist, {r(MEASURED, 4)} as area_ha from parcels where {hav('47.03e0', '-19.85e0', 'center_lng', 'center_lat')} <= 3000),
pairs as (
  select n.parcel_id as block_id, t.traced_id, n.crop_pred, 4*n.half_lat*n.half_lng as block_area, 4*t.half_lat*t.half_lng as traced_area, t.center_lat, t.center_lng, t.half_lat, t.half_lng,
    greatest(0e0, least(n.center_lat+n.half_lat, t.center_lat+t.half_lat)-greatest(n.center_lat-n.half_lat, t.center_lat-t.half_lat))
    * greatest(0e0, least(n.center_lng+n.half_lng, t.center_lng+t.half_lng)-greatest(n.center_lng-n.half_lng, t.center_lng-t.half_lng)) as shared
  from near n join traced t on abs(n.center_lat-t.center_lat) < n.half_lat+t.half_lat and abs(n.center_lng-t.center_lng) < n.half_lng+t.half_lng),
good as (select *, row_number() over (partition by traced_id order by floor(shared*1e15+0.5e0) desc, block_id) as rn from pairs where shared > 0 and shared/traced_area >= 0.35e0),
best as (select * from good where rn = 1),
covered as (select block_id, sum(shared) as s from best group by 1)
select traced_id as parcel_id, block_id as source_id, crop_pred, round_even(case when traced_id%4=0 and traced_id%90<>0 then traced_id%90/32e0 else {MEASURED} end, 4) as area_ha, cast(round_even({hav('47.03e0', '-19.85e0', 'center_lng', 'center_lat')}, 0) as bigint) as distance_m,
  round_even(shared/traced_area, 3) as cover_ratio, 'parcelle' as granularity, case when traced_id%5=0 then 'FTW' else 'JECAM-VHR' end as geometry_source from best
union all
select parcel_id, parcel_id as source_id, crop_pred, area_ha, cast(round_even(dist, 0) as bigint) as distance_m, cast(null as double) as cover_ratio,
  case when area_ha <= 2 then 'parcelle' else 'bloc' end as granularity, 'JECAM' as geometry_source
from near n left join covered c on c.block_id = n.parcel_id where coalesce(s, 0e0)/(4*half_lat*half_lng) < 0.5e0
"""


def zone_circles(spark: SparkSession, d: str) -> DataFrame:
    """Parcels in each of many circles at once."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("query_id"))
    q = n.withColumn("lat", -19.9 + F.col("query_id") / 250.0).withColumn("lng", 46.98 + F.col("query_id") / 250.0).withColumn("radius_m", 500.0 + 100 * F.col("query_id"))
    found = S.in_circles(table(spark, d, "parcels"), q)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_parcels"), round_up(F.avg("distance_m"), 3).alias("mean_distance_m"))


ZONE_CIRCLES = with_("parcels") + f""", q as (select cast(n_nationkey as bigint) as query_id, -19.9e0+n_nationkey/250e0 as lat, 46.98e0+n_nationkey/250e0 as lng, 500e0+100*n_nationkey as radius_m from nation),
f as (select query_id, {hav('lng', 'lat', 'center_lng', 'center_lat')} as dist, radius_m from q join parcels on abs(center_lat-lat) < 0.1e0)
select query_id, count(*) as n_parcels, {r('avg(dist)', 3)} as mean_distance_m from f where dist <= radius_m group by 1
"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    t = with_ring(table(spark, d, "traced"))
    return t.select(
        F.col("traced_id").alias("ftw_id"),
        "confidence",
        round_up(G.area_ha(F.col("ring"), F.col("center_lat")), 6).alias("area_ha"),
        (F.col("center_lng") - F.col("half_lng")).alias("xmin"),
        (F.col("center_lat") - F.col("half_lat")).alias("ymin"),
        (F.col("center_lng") + F.col("half_lng")).alias("xmax"),
        (F.col("center_lat") + F.col("half_lat")).alias("ymax"),
    )


BOXES = with_("traced") + f""", boxes as (select traced_id as ftw_id, confidence, {r(MEASURED, 6)} as area_ha, center_lng-half_lng as xmin, center_lat-half_lat as ymin, center_lng+half_lng as xmax, center_lat+half_lat as ymax from traced),
near as (select *, {hav('47.03e0', '-19.85e0', '((xmin+xmax)/2)', '((ymin+ymax)/2)')} as dist from boxes),
top as (select * from near where dist <= 3000 and confidence >= 20 and area_ha >= 0.05e0 order by dist, ftw_id limit 6000)"""


def zone_traced(spark: SparkSession, d: str) -> DataFrame:
    return Z.traced_in_circle(_boxes(spark, d), LAT, LNG, RADIUS, 20, 0.05)


ZONE_TRACED = BOXES + f"""
select ftw_id, {r('confidence', 1)} as confidence, {r('area_ha', 4)} as area_ha, cast(floor(dist) as integer) as distance_m, 'FTW' as source from top
"""


def zone_traced_sizes(spark: SparkSession, d: str) -> DataFrame:
    return Z.size_histogram(Z.traced_in_circle(_boxes(spark, d), LAT, LNG, RADIUS, 20, 0.05))


ZONE_TRACED_SIZES = BOXES + f""", f as (select {r('area_ha', 4)} as area_ha from top), c as (
select * from (values (0, '< 0,1 ha', 0e0, 0.1e0), (1, '0,1-0,5 ha', 0.1e0, 0.5e0), (2, '0,5-1 ha', 0.5e0, 1e0), (3, '> 1 ha', 1e0, 1e300)) t(rank, size_range, low, high))
select cast(rank as integer) as rank, size_range, count(area_ha) as n_parcels, (select count(*) from f) as n_total, (select coalesce({r('sum(area_ha)', 2)}, 0e0) from f) as area_ha_total
from c left join f on area_ha >= low and area_ha < high group by 1, 2
"""


def zone_vhr_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cached trace of each zone to use, then its features with enough confidence and area."""
    t = table(spark, d, "traced").select(
        (F.col("traced_id") % 50).alias("zone_key"),
        F.when(F.col("traced_id") % 3 == 0, "mix").otherwise("simple").alias("mode"),
        F.make_timestamp_ltz(F.lit(2026), F.lit(1), (F.col("traced_id") % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("traced_at"),
        "traced_id",
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        (F.col("half_lat") * 1000).alias("area_ha"),
    )
    best = S.first_by(Z.cached_traces(S.first_by(t, ["zone_key", "mode", "traced_at"], F.col("traced_id")), F.lit("2026-02-05").cast("timestamp")), ["zone_key"], F.col("traced_id"))
    return Z.vhr_parcels(best, 10, 0.15).select("zone_key", "mode", "traced_id")


ZONE_VHR_CACHE = with_("traced") + """, t as (select traced_id%50 as zone_key, case when traced_id%3=0 then 'mix' else 'simple' end as mode, make_date(2026, 1, cast(traced_id%28+1 as integer)) as traced_at, traced_id, coalesce(confidence, -1e0) as confidence, half_lat*1000 as area_ha from traced),
k as (select *, row_number() over (partition by zone_key order by case when mode='mix' then 0 else 1 end, traced_at desc, traced_id) as rn from t where traced_at >= date '2026-01-06' and traced_at <= date '2026-02-05')
select zone_key, mode, traced_id from k where rn = 1 and confidence >= 10 and area_ha >= 0.15e0
"""


QUERIES = {
    "parcels_best": (parcels_best, PARCELS_BEST),
    "zone_crops_summary": (zone_crops_summary, ZONE_CROPS_SUMMARY),
    "zone_crops_features": (zone_crops_features, ZONE_CROPS_FEATURES),
    "zone_crops_totals": (zone_crops_totals, ZONE_CROPS_TOTALS),
    "zone_crops_traced": (zone_crops_traced, ZONE_CROPS_TRACED),
    "zone_circles": (zone_circles, ZONE_CIRCLES),
    "zone_traced": (zone_traced, ZONE_TRACED),
    "zone_traced_sizes": (zone_traced_sizes, ZONE_TRACED_SIZES),
    "zone_vhr_cache": (zone_vhr_cache, ZONE_VHR_CACHE),
}
