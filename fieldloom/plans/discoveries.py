"""Queries over candidate discovery and series summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.mathx import round_up
from fieldloom.operators import discovery as D
from fieldloom.operators import registry as R
from fieldloom.operators import series as E
from fieldloom.plans.geo import LAT, LNG, r
from fieldloom.sources.fixtures import table, with_, with_ring
from fieldloom.sources.shared import spread


def parcels_in_reach(spark: SparkSession, d: str) -> DataFrame:
    p = with_ring(table(spark, d, "traced")).select(F.col("traced_id").alias("parcel_id"), "ring")
    return D.in_reach(p, LAT, LNG, 4000.0, 1.0).select("parcel_id", round_up(F.col("area_m2"), 1).alias("area_m2"), round_up(F.col("distance_m"), 2).alias("distance_m"))


PARCELS_IN_REACH = with_("traced") + f""", q as (select traced_id as parcel_id, 4*half_lng*half_lat*111320e0*111320e0*cos(radians(center_lat)) as a, sqrt(pow((center_lng-47.03e0)*111320e0*cos(radians(-19.85e0)),2)+pow((center_lat+19.85e0)*111320e0,2)) as d from traced)
select parcel_id, {r('a', 1)} as area_m2, {r('d', 2)} as distance_m from q where a >= 10000 and a <= 800000 and d <= 4000
"""


def parcels_to_classify(spark: SparkSession, d: str) -> DataFrame:
    p = with_ring(spread(table(spark, d, "traced"))).select(F.col("traced_id").alias("parcel_id"), "ring")
    return D.to_classify(p, LAT, LNG, 4000.0, 1.0).select("parcel_id", round_up(F.col("area_m2"), 1).alias("area_m2"), round_up(F.col("distance_m"), 2).alias("distance_m"))


PARCELS_TO_CLASSIFY = with_("traced", recursive=True) + f""", q as (select traced_id as parcel_id, center_lat, center_lng, 4*half_lng*half_lat*111320e0*111320e0*cos(radians(center_lat)) as a, sqrt(pow((center_lng-47.03e0)*111320e0*cos(radians(-19.85e0)),2)+pow((center_lat+19.85e0)*111320e0,2)) as d from traced),
c as materialized (select *, row_number() over (order by d, parcel_id) as k from q where a >= 10000 and a <= 800000 and d <= 4000),
walk(k, kept, lats, lngs) as (
  select 1::bigint, parcel_id, [center_lat], [center_lng] from c where k = 1
  union all
  select c.k, case when far then c.parcel_id end, case when far then list_append(w.lats, c.center_lat) else w.lats end, case when far then list_append(w.lngs, c.center_lng) else w.lngs end
  from walk w join c on c.k = w.k + 1
  cross join lateral (select min(sqrt(pow((c.center_lng-o.lng)*111320e0*greatest(abs(cos(radians(o.lat))), 0.1e0), 2)+pow((c.center_lat-o.lat)*111320e0, 2))) >= 15 as far from (select unnest(w.lats) as lat, unnest(w.lngs) as lng) o)
  where len(w.lats) < 20)
select parcel_id, {r('a', 1)} as area_m2, {r('d', 2)} as distance_m from c where parcel_id in (select kept from walk)
"""

def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A request of each supplier, with radii from 300 to 700 m."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.cast("long").alias("query_id"), (-19.9 + (k * 37 % 100) / 1000.0).alias("lat"), (46.98 + (k * 53 % 100) / 1000.0).alias("lng"), (0.3 + k % 5 / 10.0).alias("radius_km"))


def candidates_discovered(spark: SparkSession, d: str) -> DataFrame:
    """The cascade for a table of requests: registered and traced parcels, where they cover too little the segments of the request (parcels a little aside), search cells."""
    shifted = F.col("center_lat") + F.when(F.col("parcel_id") % 2 == 0, 0.00002).otherwise(0.001)  # two metres: near duplicates
    parcels = spread(table(spark, d, "parcels"))
    database = D.as_candidates(with_ring(parcels), "database", F.concat(F.lit("db-"), F.col("parcel_id").cast("string")))
    traced = D.as_candidates(with_ring(spread(table(spark, d, "traced"))), "osm", F.concat(F.lit("osm-"), F.col("traced_id").cast("string")))
    segments = D.as_candidates(with_ring(parcels.withColumn("center_lat", shifted)), "segment", F.concat(F.lit("seg-"), F.col("parcel_id").cast("string")))
    found = D.once_a_circle(_requests(spark, d), lambda circles: D.discover(circles, [traced, database], lambda short: D.meeting(segments, short)))
    return found.select("query_id", "candidate_id", "source", F.size("ring").cast("long").alias("n_points"), F.col("rank").cast("long").alias("rank"))


def _walk(name: str, source: str, order: str) -> str:
    """SQL that thins the candidates of each query in an order: those of ``source`` that stay, as a table of that name."""
    return f""", c_{name} as materialized (select *, row_number() over (partition by query_id order by {order}) as k from {source}),
w_{name}(query_id, k, kept, lats, lngs) as (
  select query_id, 1::bigint, candidate_id, [center_lat], [center_lng] from c_{name} where k = 1
  union all
  select w.query_id, c.k, case when far then c.candidate_id end, case when far then list_append(w.lats, c.center_lat) else w.lats end, case when far then list_append(w.lngs, c.center_lng) else w.lngs end
  from w_{name} w join c_{name} c on c.query_id = w.query_id and c.k = w.k + 1
  cross join lateral (select coalesce(min(sqrt(pow((c.center_lng-o.lng)*111.32e0*greatest(abs(cos(radians(o.lat))), 0.1e0), 2)+pow((c.center_lat-o.lat)*110.574e0, 2))), 1e9) >= 0.005e0 as far from (select unnest(w.lats) as lat, unnest(w.lngs) as lng) o)),
{name} as materialized (select c.* exclude (k) from c_{name} c join w_{name} w on c.query_id = w.query_id and c.candidate_id = w.kept)"""


def _clips(name: str, source: str) -> str:
    """SQL that clips the circle of each row's request to the row's rectangle, one side after the other: a row each with n_points, area and the mean point (mx, my)."""
    out = f""", {name}0 as (select query_id, candidate_id, center_lat, center_lng, half_lat, half_lng, i as k, lng+cos(i/48e0*2*pi())*radius_km*1000/(111320e0*greatest(abs(cos(radians(lat))),0.1e0)) as x, lat+sin(i/48e0*2*pi())*radius_km*1000/110574e0 as y
  from {source} join requests using (query_id), (select unnest(range(48)) as i))"""
    keys = "query_id, candidate_id"
    for n, side in enumerate(("x-(center_lng-half_lng)", "center_lng+half_lng-x", "y-(center_lat-half_lat)", "center_lat+half_lat-y")):
        out += f""", {name}s{n} as (select *, {side} as s from {name}{n}), {name}e{n} as (select *, coalesce(lag(x) over o, last_value(x) over w) as px, coalesce(lag(y) over o, last_value(y) over w) as py, coalesce(lag(s) over o, last_value(s) over w) as ps from {name}s{n}
  window o as (partition by {keys} order by k), w as (partition by {keys} order by k rows between unbounded preceding and unbounded following)),
  {name}{n + 1} as (select {keys}, center_lat, center_lng, half_lat, half_lng, row_number() over (partition by {keys} order by j) as k, x, y from (
    select *, 2*k as j from (select {keys}, center_lat, center_lng, half_lat, half_lng, k, px+(x-px)*ps/(ps-s) as x, py+(y-py)*ps/(ps-s) as y from {name}e{n} where (s >= 0) <> (ps >= 0))
    union all select {keys}, center_lat, center_lng, half_lat, half_lng, k, x, y, 2*k+1 from {name}e{n} where s >= 0))"""
    return out + f""", {name}m as (select {keys}, avg(x) as mx, avg(y) as my, count(*) as n_points from {name}4 group by all having count(*) >= 3),
  {name}l as (select {keys}, k, n_points, mx, my, (x-mx)*111320e0*cos(radians(my)) as x, (y-my)*111320e0 as y from {name}4 join {name}m using (query_id, candidate_id)),
  {name}p as (select *, coalesce(lead(x) over (partition by {keys} order by k), first_value(x) over (partition by {keys} order by k)) as nx, coalesce(lead(y) over (partition by {keys} order by k), first_value(y) over (partition by {keys} order by k)) as ny from {name}l),
  {name} as materialized (select {keys}, n_points, mx, my, abs(sum(x*ny-nx*y))/2 as area from {name}p group by {keys}, n_points, mx, my)"""


def _meets(name: str, id: str, source: str, prefix: str, rank: int) -> str:
    """SQL of the rectangles that meet each request's circle."""
    km = "sqrt(pow(greatest(abs(center_lng-lng)-half_lng, 0e0)*111.32e0*cos(radians(lat)),2) + pow(greatest(abs(center_lat-lat)-half_lat, 0e0)*110.574e0,2))"
    flat = "sqrt(pow((center_lng-lng)*111.32e0*greatest(abs(cos(radians(lat))),0.1e0),2)+pow((center_lat-lat)*110.574e0,2))"
    return f""", {name}_all as (select query_id, '{prefix}-' || cast({id} as varchar) as candidate_id, center_lat, center_lng, half_lat, half_lng, {rank} as source_rank, {flat} as distance_km
  from {source} join requests on abs(center_lat-lat) < 0.01e0+half_lat and abs(center_lng-lng) < 0.01e0+half_lng where {km} <= radius_km)""" + _walk(name, f"{name}_all", "distance_km, candidate_id")


CANDIDATES_DISCOVERED = (
    with_("parcels", "traced", recursive=True)
    + """, requests as (select cast(s_suppkey as bigint) as query_id, -19.9e0+(s_suppkey*37%100)/1000e0 as lat, 46.98e0+(s_suppkey*53%100)/1000e0 as lng, 0.3e0+s_suppkey%5/10e0 as radius_km from supplier),
shifted as (select parcel_id, center_lat + case when parcel_id%2=0 then 0.00002e0 else 0.001e0 end as center_lat, center_lng, half_lat, half_lng from parcels)"""
    + _meets("near_traced", "traced_id", "traced", "osm", 0)
    + _meets("near_known", "parcel_id", "parcels", "db", 1)
    + _meets("near_shifted", "parcel_id", "shifted", "seg", 2)
    + ", both_ as (select * from near_traced union all select * from near_known)"
    + _walk("known", "both_", "source_rank, candidate_id")
    + _clips("kc", "known")
    + """, short as (select query_id from requests left join (select query_id, sum(area) as area from kc group by 1) using (query_id) where coalesce(area, 0e0)/(pi()*pow(radius_km*1000, 2)) < 0.6e0),
more as (select * from known union all select * from near_shifted where query_id in (select query_id from short))"""
    + _walk("found", "more", "source_rank, candidate_id")
    + _clips("fc", "found")
    + """, centred as (select query_id, candidate_id, my as center_lat, mx as center_lng, f.center_lat as lat0, f.center_lng as lng0, half_lat, half_lng, source_rank, n_points from found f join fc using (query_id, candidate_id))"""
    + _walk("clipped", "centred", "source_rank, candidate_id")
    + """, sized as (select *, greatest(0.1e0, radius_km/sqrt(36/pi())) as s from requests), steps as (select unnest(range(-10, 11)) as i),
g as (select query_id, lat, lng, radius_km, s, a.i as row, b.i as col, lat+a.i*s/110.574e0 as cell_lat, lng+b.i*s/(111.32e0*greatest(abs(cos(radians(lat))),0.1e0)) as cell_lng from sized, steps a, steps b where abs(a.i) <= ceil(radius_km/s) and abs(b.i) <= ceil(radius_km/s)),
e as (select *, floor(sqrt(pow((cell_lng-lng)*111.32e0*greatest(abs(cos(radians(lat))),0.1e0),2)+pow((cell_lat-lat)*110.574e0,2))*1e9+0.5e0)/1e9 as km from g),
grid as (select query_id, 'satellite-search-cell_'||row||'_'||col as candidate_id, cell_lat as center_lat, cell_lng as center_lng, s/2/110.574e0 as half_lat, s/2/(111.32e0*greatest(abs(cos(radians(cell_lat))),0.1e0)) as half_lng
  from e where km <= radius_km+s/2 qualify row_number() over (partition by query_id order by km, row, col) <= 36)"""
    + _clips("gc", "grid")
    + """, spare as (select query_id, candidate_id, my as center_lat, mx as center_lng, n_points from gc where not exists (select 1 from clipped c where c.query_id = gc.query_id and abs(my-c.lat0) < c.half_lat and abs(mx-c.lng0) < c.half_lng)),
all_ as (select query_id, candidate_id, case source_rank when 0 then 'osm' when 1 then 'database' else 'segment' end as source, n_points, source_rank, center_lat, center_lng from clipped
  union all select query_id, candidate_id, 'satellite-search-cell', n_points, 99, center_lat, center_lng from spare)
select query_id, candidate_id, source, n_points, row_number() over (partition by query_id order by source_rank, floor(sqrt(pow((center_lng-lng)*111.32e0*greatest(abs(cos(radians(lat))),0.1e0),2)+pow((center_lat-lat)*110.574e0,2))*1e9+0.5e0)/1e9, candidate_id) as rank
from all_ join requests using (query_id) qualify rank <= 48
"""
)


def series_spread(spark: SparkSession, d: str) -> DataFrame:
    s = E.spread(table(spark, d, "series"))
    return s.select("parcel_id", "n_ndvi", "ndvi_range", "ndvi_median", round_up(F.col("ndvi_q10"), 6).alias("ndvi_q10"), round_up(F.col("ndvi_q90"), 6).alias("ndvi_q90"))


SERIES_SPREAD = with_("series") + f"""select parcel_id, count(ndvi) as n_ndvi, max(ndvi)-min(ndvi) as ndvi_range, median(ndvi) as ndvi_median, {r('quantile_cont(ndvi, 0.1)', 6)} as ndvi_q10, {r('quantile_cont(ndvi, 0.9)', 6)} as ndvi_q90 from series group by 1"""

QUERIES = {
    "parcels_in_reach": (parcels_in_reach, PARCELS_IN_REACH),
    "parcels_to_classify": (parcels_to_classify, PARCELS_TO_CLASSIFY),
    "candidates_discovered": (candidates_discovered, CANDIDATES_DISCOVERED),
    "series_spread": (series_spread, SERIES_SPREAD),
}
