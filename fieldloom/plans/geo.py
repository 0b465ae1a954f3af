"""Queries over geometry and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import mathx as M
from fieldloom.functions import polygons as P
from fieldloom.operators import registry as R
from fieldloom.operators import spatial as S
from fieldloom.sources import files
from fieldloom.sources.fixtures import table, with_, with_ring
from fieldloom.sources.shared import spread, written

LAT, LNG = -19.85, 47.03


def r(x: str, digits: int) -> str:
    """SQL that rounds as the operators do."""
    return f"floor(({x})*1e{digits}+0.5e0)/1e{digits}"


def hav(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (
        f"(2*6371000e0*asin(least(1e0, sqrt(pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lng2})-({lng1}))/2),2)))))"
    )


def geo_distances(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parcels")
    x, y = M.mercator("center_lng", "center_lat")
    lng, lat = M.from_mercator(x, y)
    d_lng, d_lat = M.degrees_for_metres(1000.0, "center_lat")
    return p.select(
        "parcel_id",
        M.round_up(M.haversine_m(LNG, LAT, "center_lng", "center_lat"), 3).alias("haversine_m"),
        M.round_up(M.flat_km(LAT, LNG, "center_lat", "center_lng"), 6).alias("flat_km"),
        M.round_up(M.flat_m(LAT, LNG, "center_lat", "center_lng"), 3).alias("flat_m"),
        M.round_up(x, 2).alias("x"),
        M.round_up(y, 2).alias("y"),
        M.round_up(lng, 7).alias("lng"),
        M.round_up(lat, 7).alias("lat"),
        M.round_up(d_lng, 8).alias("d_lng"),
        M.round_up(d_lat, 8).alias("d_lat"),
        M.round_up(M.metres_per_pixel("center_lat", 15.0), 5).alias("m_per_px"),
    )


GEO_DISTANCES = with_("parcels") + f"""
select parcel_id, {r(hav('47.03e0', '-19.85e0', 'center_lng', 'center_lat'), 3)} as haversine_m,
  {r('sqrt(pow((center_lng-47.03e0)*111.32e0*greatest(abs(cos(radians(-19.85e0))),0.1e0),2)+pow((center_lat+19.85e0)*110.574e0,2))', 6)} as flat_km,
  {r('sqrt(pow((center_lng-47.03e0)*111320e0*cos(radians(-19.85e0)),2)+pow((center_lat+19.85e0)*111320e0,2))', 3)} as flat_m,
  {r('6378137e0*radians(center_lng)', 2)} as x, {r('6378137e0*ln(tan(pi()/4+radians(center_lat)/2))', 2)} as y,
  {r('center_lng', 7)} as lng, {r('center_lat', 7)} as lat,
  {r('degrees(1000e0/6371000e0)/cos(radians(center_lat))', 8)} as d_lng, {r('degrees(1000e0/6371000e0)', 8)} as d_lat,
  {r('156543.03392e0*cos(radians(center_lat))/pow(2e0,15)', 5)} as m_per_px
from parcels
"""


def geo_polygons(spark: SparkSession, d: str) -> DataFrame:
    p = with_ring(table(spark, d, "parcels"))
    ring, c = F.col("ring"), F.col("c")
    p = p.withColumn("c", G.centroid(ring)).withColumn("a", G.area_m2(ring, c)).withColumn("l", G.perimeter_m(ring, c))
    g = G.pixel_grid(ring)
    return p.select(
        "parcel_id",
        M.round_up(c["lat"], 7).alias("lat"),
        M.round_up(c["lng"], 7).alias("lng"),
        M.round_up(F.col("a"), 2).alias("area_m2"),
        M.round_up(G.area_ha(ring, F.col("center_lat")), 5).alias("area_ha"),
        M.round_up(F.col("l"), 3).alias("perimeter_m"),
        M.round_up(G.compactness(F.col("a"), F.col("l")), 6).alias("compactness"),
        M.round_up(G.aspect_ratio(ring), 6).alias("aspect"),
        F.size(G.close(ring)).cast("long").alias("n_closed"),
        M.zoom_for_area("a", "center_lat", 15).cast("long").alias("zoom"),
        g["width_px"].alias("width_px"),
        g["height_px"].alias("height_px"),
        M.round_up(g["scale_m"], 6).alias("scale_m"),
    )


GEO_POLYGONS = with_("parcels") + f""", q as (
  select *, 2*half_lng*111320e0*cos(radians(center_lat)) as w, 2*half_lat*111320e0 as h,
    2*half_lng*111320e0*greatest(abs(cos(radians(center_lat))),0.1e0) as bw, 2*half_lat*110574e0 as bh,
    6378137e0*radians(2*half_lng) + 20 as mx,
    6378137e0*(ln(tan(pi()/4+radians(center_lat+half_lat)/2))-ln(tan(pi()/4+radians(center_lat-half_lat)/2))) + 20 as my
  from parcels), g as (select *, 10e0*greatest(1e0, greatest(mx/10, my/10)/400) as s from q)
select parcel_id, {r('center_lat', 7)} as lat, {r('center_lng', 7)} as lng, {r('w*h', 2)} as area_m2,
  {r('4*half_lat*half_lng*111132e0*111320e0*cos(radians(center_lat))/10000', 5)} as area_ha, {r('2*(w+h)', 3)} as perimeter_m,
  {r('4*pi()*w*h/pow(2*(w+h),2)', 6)} as compactness, {r('greatest(bw,bh)/least(bw,bh)', 6)} as aspect, cast(5 as bigint) as n_closed,
  cast(greatest(15, least(20, floor(log2(156543.03392e0*cos(radians(center_lat))*640/greatest(180e0, sqrt(w*h)*2.2e0))))) as bigint) as zoom,
  cast(greatest(2, floor(mx/s+0.5e0)) as bigint) as width_px, cast(greatest(2, floor(my/s+0.5e0)) as bigint) as height_px, {r('s', 6)} as scale_m
from g
"""


def geo_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = with_ring(table(spark, d, "parcels"))
    bad = F.array(G.point(95.0, 47.0))
    none = F.array().cast(G.RING)
    base = F.when(F.col("parcel_id") % 5 == 0, F.slice("ring", 1, 2)).otherwise(F.col("ring"))
    raw = F.concat(F.when(F.col("parcel_id") % 3 == 0, bad).otherwise(none), base, F.when(F.col("parcel_id") % 2 == 0, F.slice("ring", 1, 1)).otherwise(none))
    clean = G.normalize(raw)
    return p.select("parcel_id", F.size(raw).cast("long").alias("n_raw"), F.when(clean.isNotNull(), F.size(clean)).cast("long").alias("n_points"))


GEO_NORMALIZE = with_("parcels") + """, q as (select parcel_id, case when parcel_id%5=0 then 2 else 4 end as b, case when parcel_id%2=0 then 1 else 0 end as c, case when parcel_id%3=0 then 1 else 0 end as v from parcels)
select parcel_id, cast(b+c+v as bigint) as n_raw, cast(case when b+c<3 then null else b end as bigint) as n_points from q
"""


def geo_contains(spark: SparkSession, d: str) -> DataFrame:
    """Traced centres inside parcels."""
    parcels = with_ring(table(spark, d, "parcels")).select("parcel_id", "ring")
    points = table(spark, d, "traced").select("traced_id", "center_lat", "center_lng")
    return S.containing(points, parcels).select("parcel_id", "traced_id")


GEO_CONTAINS = with_("parcels", "traced") + """
select p.parcel_id, t.traced_id from parcels p join traced t
on t.center_lat >= p.center_lat-p.half_lat and t.center_lat < p.center_lat+p.half_lat and t.center_lng >= p.center_lng-p.half_lng and t.center_lng < p.center_lng+p.half_lng
"""


def geo_outside(spark: SparkSession, d: str) -> DataFrame:
    """Traced centres in no parcel."""
    parcels = with_ring(table(spark, d, "parcels")).select("ring")
    points = table(spark, d, "traced").select("traced_id", F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    return S.not_within(points, parcels).select("traced_id")


GEO_OUTSIDE = with_("parcels", "traced") + """
select traced_id from traced t where not exists (select 1 from parcels p where
t.center_lat >= p.center_lat-p.half_lat and t.center_lat < p.center_lat+p.half_lat and t.center_lng >= p.center_lng-p.half_lng and t.center_lng < p.center_lng+p.half_lng)
"""


def geo_circle_hits(spark: SparkSession, d: str) -> DataFrame:
    p = with_ring(table(spark, d, "parcels"))
    return p.where(G.meets_circle(F.col("ring"), LAT, LNG, 2.0)).select("parcel_id")


GEO_CIRCLE_HITS = with_("parcels") + """
select parcel_id from parcels where sqrt(
  pow(greatest(abs(center_lng-47.03e0)-half_lng, 0e0)*111.32e0*cos(radians(-19.85e0)),2) + pow(greatest(abs(center_lat+19.85e0)-half_lat, 0e0)*110.574e0,2)) <= 2
"""


def geo_circle_ring(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    at = n.withColumn("lat", -19.9 + F.col("k") / 100.0).withColumn("lng", 47 + F.col("k") / 50.0)
    rows = at.select("k", F.posexplode(G.circle("lat", "lng", 1.5)).alias("i", "p"))
    return rows.select(F.col("k").cast("long").alias("k"), F.col("i").cast("long").alias("i"), M.round_up(F.col("p.lat"), 7).alias("lat"), M.round_up(F.col("p.lng"), 7).alias("lng"))


GEO_CIRCLE_RING = f"""
with c as (select cast(n_nationkey as bigint) as k, -19.9e0+n_nationkey/100e0 as lat, 47+n_nationkey/50e0 as lng from nation), v as (select unnest(range(48)) as i)
select k, cast(i as bigint) as i, {r('lat+sin(i/48e0*2*pi())*1500/110574e0', 7)} as lat, {r('lng+cos(i/48e0*2*pi())*1500/(111320e0*greatest(abs(cos(radians(lat))),0.1e0))', 7)} as lng from c cross join v
"""


def geo_tiles(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("double").alias("k"))
    g = M.tile_grid(F.col("k") % 5 + 10, F.col("k") * 3, F.col("k") * 7)
    return n.select(F.col("k").cast("long").alias("k"), *[M.round_up(v, 3).alias(name) for name, v in g.items()])


GEO_TILES = f"""
with t as (select cast(n_nationkey as bigint) as k, 2*pi()*6378137e0/pow(2e0, n_nationkey%5+10) as side from nation)
select k, {r('k*3*side-pi()*6378137e0', 3)} as origin_x, {r('pi()*6378137e0-k*7*side', 3)} as origin_y, {r('side/256', 3)} as scale from t
"""


def geo_search_cells(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("query_id"))
    q = n.withColumn("lat", -19.9 + F.col("query_id") / 100.0).withColumn("lng", 47 + F.col("query_id") / 50.0)
    cells = R.search_cells(q, 1.5)
    return cells.select("query_id", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column_no"), M.round_up(F.col("cell_lat"), 7).alias("cell_lat"), M.round_up(F.col("cell_lng"), 7).alias("cell_lng"))


GEO_SEARCH_CELLS = f"""
with q as (select cast(n_nationkey as bigint) as query_id, -19.9e0+n_nationkey/100e0 as lat, 47+n_nationkey/50e0 as lng, 1.5e0/sqrt(36/pi()) as s, cast(ceil(1.5e0/(1.5e0/sqrt(36/pi()))) as bigint) as n from nation),
steps as (select unnest(range(-10, 11)) as i),
g as (select query_id, lat, lng, s, a.i as row, b.i as col, lat+a.i*s/110.574e0 as cell_lat, lng+b.i*s/(111.32e0*greatest(abs(cos(radians(lat))),0.1e0)) as cell_lng from q, steps a, steps b where abs(a.i)<=n and abs(b.i)<=n),
e as (select *, floor(sqrt(pow((cell_lng-lng)*111.32e0*greatest(abs(cos(radians(lat))),0.1e0),2)+pow((cell_lat-lat)*110.574e0,2))*1e9+0.5e0)/1e9 as km from g),
k as (select *, row_number() over (partition by query_id order by km, row, col) as rn from e where km <= 1.5e0+s/2)
select query_id, cast(row as bigint) as row, cast(col as bigint) as column_no, {r('cell_lat', 7)} as cell_lat, {r('cell_lng', 7)} as cell_lng from k where rn <= 36
"""


def geo_overlap(spark: SparkSession, d: str) -> DataFrame:
    parcels = with_ring(table(spark, d, "parcels")).select("parcel_id", "ring")
    traced = with_ring(table(spark, d, "traced")).select("traced_id", "ring")
    pairs = S.shared_areas(parcels, traced, "parcel_id", "traced_id")
    return pairs.where("shared > 1e-12").select("parcel_id", F.col("r_traced_id").alias("traced_id"), M.round_up(F.col("shared") * 1e6, 6).alias("shared"))


GEO_OVERLAP = with_("parcels", "traced") + f""", o as (
  select parcel_id, traced_id,
    greatest(0e0, least(p.center_lat+p.half_lat, t.center_lat+t.half_lat)-greatest(p.center_lat-p.half_lat, t.center_lat-t.half_lat)) as h,
    greatest(0e0, least(p.center_lng+p.half_lng, t.center_lng+t.half_lng)-greatest(p.center_lng-p.half_lng, t.center_lng-t.half_lng)) as w
  from parcels p join traced t on abs(p.center_lat-t.center_lat) < p.half_lat+t.half_lat and abs(p.center_lng-t.center_lng) < p.half_lng+t.half_lng)
select parcel_id, traced_id, {r('w*h*1e6', 6)} as shared from o where w*h > 1e-12
"""


def geo_plausible(spark: SparkSession, d: str) -> DataFrame:
    p = R.plausible_field(with_ring(spread(table(spark, d, "parcels"))))
    return p.select("parcel_id", M.round_up(F.col("compactness"), 6).alias("compactness"), M.round_up(F.col("hull_ratio"), 6).alias("hull_ratio"), M.round_up(F.col("aspect"), 6).alias("aspect"), "plausible")


GEO_PLAUSIBLE = with_("parcels") + f""", q as (
  select parcel_id, 2*half_lng*111320e0*cos(radians(center_lat)) as w, 2*half_lat*111320e0 as h,
    2*half_lng*111320e0*greatest(abs(cos(radians(center_lat))),0.1e0) as bw, 2*half_lat*110574e0 as bh from parcels),
m as (select parcel_id, 4*pi()*w*h/pow(2*(w+h),2) as c, greatest(bw,bh)/least(bw,bh) as a from q)
select parcel_id, {r('c', 6)} as compactness, 1e0 as hull_ratio, {r('a', 6)} as aspect, c >= 0.35e0 and a <= 12 as plausible from m
"""


def geo_clip(spark: SparkSession, d: str) -> DataFrame:
    """Parcels clipped to a circle: the part inside it."""
    p = with_ring(table(spark, d, "parcels")).withColumn("clip", G.clip_to_circle(LAT, LNG, 3.0)(F.col("ring")))
    return p.where(F.size("clip") >= 3).select("parcel_id", F.size("clip").cast("long").alias("n_points"), M.round_up(G.area_m2(F.col("clip")), 1).alias("area_m2"))


def _clipped() -> str:
    """SQL for the 48-gon of the circle clipped to each parcel, one side of the rectangle after the other: k4 has the points, in degrees and in order."""
    out = with_("parcels") + """, k0 as (select parcel_id, center_lat, center_lng, half_lat, half_lng, i as k,
  47.03e0+cos(i/48e0*2*pi())*3000/(111320e0*cos(radians(-19.85e0))) as x, -19.85e0+sin(i/48e0*2*pi())*3000/110574e0 as y from parcels, (select unnest(range(48)) as i)
  where abs(center_lng-47.03e0) < 0.03e0+half_lng and abs(center_lat+19.85e0) < 0.03e0+half_lat)"""
    for n, side in enumerate(("x-(center_lng-half_lng)", "center_lng+half_lng-x", "y-(center_lat-half_lat)", "center_lat+half_lat-y")):
        out += f""", s{n} as (select *, {side} as s from k{n}), e{n} as (select *, last_value(k) over w as kl, coalesce(lag(x) over o, last_value(x) over w) as px, coalesce(lag(y) over o, last_value(y) over w) as py, coalesce(lag(s) over o, last_value(s) over w) as ps from s{n}
  window o as (partition by parcel_id order by k), w as (partition by parcel_id order by k rows between unbounded preceding and unbounded following)),
  k{n + 1} as (select parcel_id, center_lat, center_lng, half_lat, half_lng, row_number() over (partition by parcel_id order by j) as k, x, y from (
    select *, 2*k as j from (select parcel_id, center_lat, center_lng, half_lat, half_lng, k, px+(x-px)*ps/(ps-s) as x, py+(y-py)*ps/(ps-s) as y from e{n} where (s >= 0) <> (ps >= 0))
    union all select parcel_id, center_lat, center_lng, half_lat, half_lng, k, x, y, 2*k+1 from e{n} where s >= 0))"""
    return out + """, means as (select parcel_id, avg(x) as mx, avg(y) as my, count(*) as n_points from k4 group by 1),
  local as (select parcel_id, k, n_points, (x-mx)*111320e0*cos(radians(my)) as x, (y-my)*111320e0 as y from k4 join means using (parcel_id)),
  parts as (select *, coalesce(lead(x) over (partition by parcel_id order by k), first_value(x) over (partition by parcel_id order by k)) as nx, coalesce(lead(y) over (partition by parcel_id order by k), first_value(y) over (partition by parcel_id order by k)) as ny from local),
  clipped as (select parcel_id, n_points, abs(sum(x*ny-nx*y))/2 as area from parts where n_points >= 3 group by 1, 2)"""


GEO_CLIP = _clipped() + f" select parcel_id, n_points, {r('area', 1)} as area_m2 from clipped where area > 0"


def geo_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(with_ring(table(spark, d, "parcels")), LAT, LNG, 3.0).select(M.round_up(F.col("coverage"), 6).alias("coverage"))


GEO_COVERAGE = _clipped() + f" select coalesce({r('sum(area)/(pi()*9e6)', 6)}, 0e0) as coverage from clipped"


def _texts(shape: list[list[Column]], turned: Column) -> Column:
    """The text of a GeoJSON MultiPolygon of parts of rings, the other way round where ``turned`` holds."""
    ring = lambda x: F.to_json(F.when(turned, F.reverse(G.close(x))).otherwise(G.close(x)))
    parts = [F.concat(F.lit("["), F.concat_ws(",", *map(ring, part)), F.lit("]")) for part in shape]
    return F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.concat_ws(",", *parts), F.lit("]}"))


def with_holes(spark: SparkSession, d: str) -> DataFrame:
    """Parcels read from GeoJSON texts of two parts, the first with a hole in its upper right quarter, the second beside it; every third has its rings the other way round.

    Texts are parsed once, into a written table."""
    p = table(spark, d, "parcels").repartition(spark.sparkContext.defaultParallelism)  # a small file's rows, but much work each
    lat, lng, a, b = (F.col(c) for c in ("center_lat", "center_lng", "half_lat", "half_lng"))
    first, hole, second = G.rectangle(lat, lng, a, b), G.rectangle(lat + a / 2, lng + b / 2, a / 4, b / 4), G.rectangle(lat, lng + 2 * b, a / 2, b / 2)
    text = _texts([[first, hole], [second]], F.col("parcel_id") % 3 == 0)
    return written(p.withColumn("ring", P.of_geojson(text)))


def geo_holes(spark: SparkSession, d: str) -> DataFrame:
    """Area and centre of mass of parcels with a hole and a second part."""
    shape = F.col("ring")
    p = with_holes(spark, d).withColumn("c", P.centroid(shape))
    return p.select("parcel_id", F.size(P.points(shape)).cast("long").alias("n_points"), M.round_up(P.area_deg2(shape) * 1e6, 6).alias("area"), M.round_up(F.col("c.lat"), 9).alias("lat"), M.round_up(F.col("c.lng"), 9).alias("lng"))


# Areas in units of half_lat * half_lng: 4 of the first part, 1/4 of the hole, 1 of the second part.
GEO_HOLES = with_("parcels") + f"""select parcel_id, cast(12 as bigint) as n_points, {r('4.75e0*half_lat*half_lng*1e6', 6)} as area,
  {r('center_lat-0.25e0*half_lat/2/4.75e0', 9)} as lat, {r('center_lng+(2-0.125e0)*half_lng/4.75e0', 9)} as lng from parcels
"""


def geo_parts(spark: SparkSession, d: str) -> DataFrame:
    """Of the same parcels the length of all rings and of the outer ones, shape figures of the outline, and whether they meet a circle: with an edge of a part or of a hole, not across the gap between parts."""
    shape = F.col("ring")
    p = R.plausible_field(with_holes(spark, d))
    at = G.point("center_lat", "center_lng")
    near = P.meets_circle(shape, LAT, LNG, 1.2)
    return p.select("parcel_id", M.round_up(P.perimeter_m(shape, at), 3).alias("length_m"), M.round_up(P.perimeter_m(shape, at, holes=False), 3).alias("outer_m"), M.round_up(F.col("hull_ratio"), 6).alias("hull_ratio"), M.round_up(F.col("aspect"), 6).alias("aspect"), M.round_up(F.col("compactness"), 6).alias("compactness"), near.alias("near"))


# The outline is 2 by 2 and 1 by 1 half sides, from -1 to 2.5; its hull adds two triangles and what is between the parts.
GEO_PARTS = with_("parcels") + f""", q as (
  select *, half_lng*111320e0*cos(radians(center_lat)) as w, half_lat*111320e0 as h, 3.5e0*half_lng*111320e0*greatest(abs(cos(radians(center_lat))),0.1e0) as bw, 2*half_lat*110574e0 as bh,
    (center_lng-47.03e0)*111.32e0*cos(radians(-19.85e0)) as x, (center_lat+19.85e0)*110.574e0 as y, half_lng*111.32e0*cos(radians(-19.85e0)) as kx, half_lat*110.574e0 as ky from parcels),
s as (select *, 4*(w+h)+2*(w+h) as outer_m, 4*(w+h)+2*(w+h)+(w+h) as length_m, 5/6.25e0 as hull,
  -- distances to the sides of the hole if the centre is in it, else to the parts
  abs(x+kx/2) < kx/4 and abs(y+ky/2) < ky/4 as in_hole,
  least(kx/4-abs(x+kx/2), ky/4-abs(y+ky/2)) as hole_km,
  least(sqrt(pow(greatest(abs(x)-kx, 0e0),2)+pow(greatest(abs(y)-ky, 0e0),2)), sqrt(pow(greatest(abs(x+2*kx)-kx/2, 0e0),2)+pow(greatest(abs(y)-ky/2, 0e0),2))) as km from q)
select parcel_id, {r('length_m', 3)} as length_m, {r('outer_m', 3)} as outer_m, {r('hull', 6)} as hull_ratio, {r('greatest(bw,bh)/least(bw,bh)', 6)} as aspect,
  {r('4*pi()*5*w*h/pow(outer_m,2)', 6)} as compactness,
  case when in_hole then hole_km else km end <= 1.2e0 as near from s
"""


def geo_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Parcels traced as bow-ties, with a part that overlaps them, or with a hole that reaches outside, repaired: what they cover stays."""
    p = spread(table(spark, d, "parcels"))
    lat, lng, a, b = (F.col(c) for c in ("center_lat", "center_lng", "half_lat", "half_lng"))
    x = G.rectangle(lat, lng, a, b)
    bow = F.array(F.get(x, 0), F.get(x, 2), F.get(x, 1), F.get(x, 3))
    beside, below = G.rectangle(lat, lng + b, a / 2, b / 2), G.rectangle(lat - a, lng, a / 2, b / 2)
    kind, turned = F.col("parcel_id") % 3, F.col("parcel_id") % 2 == 0
    text = F.when(kind == 0, _texts([[bow]], turned)).when(kind == 1, _texts([[x], [beside]], turned)).otherwise(_texts([[x, below]], turned))
    shape = F.col("shape")
    found = files.parse_traced(p.select("parcel_id", "center_lat", text.alias("feature"))).withColumn("c", P.centroid(shape))
    return found.select("parcel_id", F.size(shape).cast("long").alias("n_parts"), F.size(P.points(shape)).cast("long").alias("n_points"), M.round_up(P.area_deg2(shape) * 1e6, 6).alias("area"), M.round_up(F.col("c.lat"), 8).alias("lat"), M.round_up(F.col("c.lng"), 8).alias("lng"))


# In units of half sides: two triangles of 1; 4 and half of a square of 1 that sticks out; 4 less half of such a square, and by the even-odd rule the half outside. The last touches itself in two points and falls into two parts.
GEO_REPAIRED = with_("parcels") + f"""select parcel_id, cast(case when parcel_id%3=1 then 1 else 2 end as bigint) as n_parts, cast(case parcel_id%3 when 0 then 6 when 1 then 8 else 12 end as bigint) as n_points,
  {r('case parcel_id%3 when 0 then 2e0 when 1 then 4.5e0 else 4e0 end*half_lat*half_lng*1e6', 6)} as area,
  {r('center_lat+half_lat*case parcel_id%3 when 2 then (0.5e0*0.75e0-0.5e0*1.25e0)/4 else 0e0 end', 8)} as lat, {r('center_lng+half_lng*case parcel_id%3 when 1 then 0.5e0*1.25e0/4.5e0 else 0e0 end', 8)} as lng from parcels
"""


def geo_concave_shared(spark: SparkSession, d: str) -> DataFrame:
    """What traced rectangles share with parcels that lack their upper right quarter, and with the triangles below their rising diagonal."""
    p = table(spark, d, "parcels")
    lat, lng, a, b = (F.col(c) for c in ("center_lat", "center_lng", "half_lat", "half_lng"))
    at = lambda k, m: G.point(lat + a * k, lng + b * m)
    ell = F.array(at(-1, -1), at(-1, 1), at(0, 1), at(0, 0), at(1, 0), at(1, -1))
    half = F.array(at(-1, -1), at(-1, 1), at(1, 1))
    both = p.select("parcel_id", F.explode(F.array(F.struct(F.lit("ell").alias("kind"), ell.alias("ring")), F.struct(F.lit("half").alias("kind"), half.alias("ring")))).alias("s"))
    named = both.select(F.concat_ws("-", "s.kind", F.col("parcel_id").cast("string")).alias("shape_id"), "s.ring")
    pairs = S.shared_areas(named, with_ring(table(spark, d, "traced")).select("traced_id", "ring"), "shape_id", "traced_id")
    return pairs.where("shared > 1e-12").select("shape_id", F.col("r_traced_id").alias("traced_id"), M.round_up(F.col("shared") * 1e6, 5).alias("shared"))


# The triangle in half sides is v <= u: over a box from u0, v0 to u1, v1 its area is that of the integral of clamp(u, v0, v1) - v0 over u.
GEO_CONCAVE_SHARED = with_("parcels", "traced") + f""", o as (
  select p.*, traced_id, greatest(-1e0, (t.center_lng-t.half_lng-p.center_lng)/p.half_lng) as u0, least(1e0, (t.center_lng+t.half_lng-p.center_lng)/p.half_lng) as u1,
    greatest(-1e0, (t.center_lat-t.half_lat-p.center_lat)/p.half_lat) as v0, least(1e0, (t.center_lat+t.half_lat-p.center_lat)/p.half_lat) as v1
  from parcels p join (select traced_id, center_lat, center_lng, half_lat, half_lng from traced) t on abs(p.center_lat-t.center_lat) < p.half_lat+t.half_lat and abs(p.center_lng-t.center_lng) < p.half_lng+t.half_lng),
s as (select 'ell-'||parcel_id as shape_id, traced_id, ((u1-u0)*(v1-v0)-greatest(0e0, u1-greatest(u0, 0e0))*greatest(0e0, v1-greatest(v0, 0e0)))*half_lat*half_lng as shared from o
  union all select 'half-'||parcel_id, traced_id, (greatest(0e0, u1-greatest(u0, v1))*(v1-v0) + (pow(greatest(v0, least(v1, u1))-v0, 2)-pow(greatest(v0, least(v1, u0))-v0, 2))/2)*half_lat*half_lng from o)
select shape_id, traced_id, {r('shared*1e6', 5)} as shared from s where shared > 1e-12
"""


def geo_holes_shared(spark: SparkSession, d: str) -> DataFrame:
    """What traced rectangles share with such parcels."""
    parcels = with_holes(spark, d).select("parcel_id", "ring")
    traced = with_ring(table(spark, d, "traced")).select("traced_id", "ring")
    pairs = S.shared_areas(parcels, traced, "parcel_id", "traced_id")
    return pairs.where("shared > 1e-12").select("parcel_id", F.col("r_traced_id").alias("traced_id"), M.round_up(F.col("shared") * 1e6, 5).alias("shared"))


GEO_HOLES_SHARED = with_("parcels", "traced") + """, w as (select parcel_id, 1 as sign, center_lat as y, center_lng as x, half_lat as a, half_lng as b from parcels
  union all select parcel_id, -1, center_lat+half_lat/2, center_lng+half_lng/2, half_lat/4, half_lng/4 from parcels union all select parcel_id, 1, center_lat, center_lng+2*half_lng, half_lat/2, half_lng/2 from parcels),
o as (select parcel_id, traced_id, sum(sign*greatest(0e0, least(y+a, center_lat+half_lat)-greatest(y-a, center_lat-half_lat))*greatest(0e0, least(x+b, center_lng+half_lng)-greatest(x-b, center_lng-half_lng))) as shared
  from w join traced on abs(y-center_lat) < a+half_lat and abs(x-center_lng) < b+half_lng group by 1, 2)
select parcel_id, traced_id, """ + r("shared*1e6", 5) + """ as shared from o where shared > 1e-12
"""


def geo_holes_hold(spark: SparkSession, d: str) -> DataFrame:
    """Traced centres inside such parcels, and not in their holes."""
    points = table(spark, d, "traced").select("traced_id", "center_lat", "center_lng")
    return S.containing(points, with_holes(spark, d).select("parcel_id", "ring")).select("parcel_id", "traced_id")


GEO_HOLES_HOLD = with_("parcels", "traced") + """
select p.parcel_id, t.traced_id from parcels p join traced t on abs(t.center_lat-p.center_lat) < p.half_lat and t.center_lng > p.center_lng-p.half_lng and t.center_lng < p.center_lng+2.5e0*p.half_lng
where (abs(t.center_lng-p.center_lng) < p.half_lng and not (abs(t.center_lat-p.center_lat-p.half_lat/2) < p.half_lat/4 and abs(t.center_lng-p.center_lng-p.half_lng/2) < p.half_lng/4))
  or (abs(t.center_lat-p.center_lat) < p.half_lat/2 and abs(t.center_lng-p.center_lng-2*p.half_lng) < p.half_lng/2)
"""

QUERIES = {
    "geo_holes": (geo_holes, GEO_HOLES),
    "geo_parts": (geo_parts, GEO_PARTS),
    "geo_repaired": (geo_repaired, GEO_REPAIRED),
    "geo_concave_shared": (geo_concave_shared, GEO_CONCAVE_SHARED),
    "geo_holes_shared": (geo_holes_shared, GEO_HOLES_SHARED),
    "geo_holes_hold": (geo_holes_hold, GEO_HOLES_HOLD),
    "geo_distances": (geo_distances, GEO_DISTANCES),
    "geo_polygons": (geo_polygons, GEO_POLYGONS),
    "geo_normalize": (geo_normalize, GEO_NORMALIZE),
    "geo_contains": (geo_contains, GEO_CONTAINS),
    "geo_outside": (geo_outside, GEO_OUTSIDE),
    "geo_circle_hits": (geo_circle_hits, GEO_CIRCLE_HITS),
    "geo_circle_ring": (geo_circle_ring, GEO_CIRCLE_RING),
    "geo_tiles": (geo_tiles, GEO_TILES),
    "geo_search_cells": (geo_search_cells, GEO_SEARCH_CELLS),
    "geo_overlap": (geo_overlap, GEO_OVERLAP),
    "geo_plausible": (geo_plausible, GEO_PLAUSIBLE),
    "geo_clip": (geo_clip, GEO_CLIP),
    "geo_coverage": (geo_coverage, GEO_COVERAGE),
}
