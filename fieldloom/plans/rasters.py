"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions.mathx import round_up
from fieldloom.operators import raster as A
from fieldloom.plans.geo import r
from fieldloom.sources import npy
from fieldloom.sources.fixtures import table, with_
from fieldloom.sources.shared import new_folder, written

#: Tiles of 20 by 20 pixels.
PIXELS = """
select (p_partkey%5) + 5*cast(floor(p_partkey/2000e0) as bigint) as raster_id, cast(floor((p_partkey%2000)/100e0) as integer) as row, cast(floor(((p_partkey%2000)%100)/5e0) as integer) as col,
  case when p_partkey%41=0 then null else ((p_partkey*37)%120-10)/100e0 end as ndvi,
  case when p_partkey%53=0 then 1000000e0 else ((p_partkey*7919)%1000)/1000e0 end as grad, ((p_partkey*104729)%1000)/500e0 as tstd
from part
"""
SQL = f"with pixels as ({PIXELS}) "


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PIXELS.replace("from part", "from {part}"), part=spark.read.parquet(f"{d}/part.parquet"))


def zone_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.zone_statistics(_pixels(spark, d), 10.0, "raster_id")


ZONE_STATISTICS = SQL + f""", z as (select raster_id, ndvi, case when ndvi >= 0.75e0 and ndvi < 1.01e0 then 'high' when ndvi >= 0.35e0 and ndvi < 0.75e0 then 'mid' else 'low' end as zone from pixels where ndvi is not null),
n as (select * from (values (0, 'high'), (1, 'mid'), (2, 'low')) t(rank, zone)), i as (select distinct raster_id from z),
s as (select i.raster_id, n.rank, n.zone, {r('avg(z.ndvi)', 2)} as avg_ndvi, count(z.ndvi) as n_pixels, {r('count(z.ndvi)*100/10000e0', 2)} as area_ha from i cross join n left join z on z.raster_id = i.raster_id and z.zone = n.zone group by 1, 2, 3)
select raster_id, cast(rank as integer) as rank, zone, avg_ndvi, n_pixels, area_ha, {r('sum(area_ha) over (partition by raster_id)', 2)} as total_area_ha from s
"""


def boundary_strength(spark: SparkSession, d: str) -> DataFrame:
    return A.boundary_strength(_pixels(spark, d)).select("raster_id", "row", "col", "barrier", round_up(F.col("strength"), 6).alias("strength"))


STRENGTH = SQL + """, lim as (select raster_id, min(grad) filter (where grad < 1e6) as gl, max(grad) filter (where grad < 1e6) as gh, min(tstd) filter (where grad < 1e6) as tl, max(tstd) filter (where grad < 1e6) as th from pixels group by 1),
st as (select raster_id, row, col, grad >= 1e6 as barrier, case when grad >= 1e6 then 1e6 else 0.6e0*(grad-gl)/greatest(gh-gl, 1e-9)+0.4e0*(tstd-tl)/greatest(th-tl, 1e-9) end as strength from pixels join lim using (raster_id))
"""
BOUNDARY_STRENGTH = STRENGTH + f"select raster_id, row, col, barrier, {r('strength', 6)} as strength from st"


def seed_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return A.seed_threshold(A.boundary_strength(_pixels(spark, d))).select("raster_id", round_up(F.col("threshold"), 6).alias("threshold"))


SEED_THRESHOLDS = STRENGTH + f""", k as (select raster_id, strength, row_number() over (partition by raster_id order by strength) - 1 as i, count(*) over (partition by raster_id) as n from st where not barrier)
select raster_id, {r('strength', 6)} as threshold from k where i = floor(n*0.2e0)
"""


def gradients(spark: SparkSession, d: str) -> DataFrame:
    g = A.gradient(_pixels(spark, d).withColumn("value", F.coalesce("ndvi", F.lit(0.0))).drop("grad"))
    return g.select("raster_id", "row", "col", round_up(F.col("grad"), 6).alias("grad"))


GRADIENTS = SQL + f""", v as (select raster_id, row, col, coalesce(ndvi, 0e0) as v from pixels), g as (select raster_id, row, col,
  coalesce((lead(v) over a - lag(v) over a)/2, 0e0) as dx, coalesce((lead(v) over b - lag(v) over b)/2, 0e0) as dy from v window a as (partition by raster_id, row order by col), b as (partition by raster_id, col order by row))
select raster_id, row, col, {r('sqrt(dx*dx+dy*dy)', 6)} as grad from g
"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Watershed of smooth tiles and its contours."""
    p = _pixels(spark, d).select("raster_id", "row", "col", F.lit(False).alias("barrier"), ((F.sin(F.col("row") / 3.0) + F.cos(F.col("col") / 4.0)) + F.col("col") * 1e-5 + F.col("row") * 1e-4).alias("strength"))
    return A.segment(p).select("raster_id", "label", "n_pixels", F.size("contour").alias("n_points"))


def mask_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "traced").select((F.col("traced_id") % 20).alias("image"), (F.col("traced_id") % 7).alias("instance"), (F.col("traced_id") * 13 % 50).alias("pixel"), ((F.col("traced_id") * 31 % 100) / 250.0).alias("confidence"))
    return A.mask_summary(m, "image")


MASK_SUMMARY = with_("traced") + """, m as (select traced_id%20 as image, traced_id%7 as instance, traced_id*13%50 as pixel, (traced_id*31%100)/250e0 as confidence from traced),
p as (select image, pixel, max(confidence) filter (where confidence >= 0.1e0) as best from m group by 1, 2),
s as (select image, floor(avg(case when best is not null then 1e0 else 0e0 end)*10000+0.5e0)/100 as selected_percent, max(best) as max_confidence from p group by 1),
k as (select image, count(distinct instance) as n from m where confidence >= 0.1e0 group by 1)
select image, selected_percent, max_confidence, coalesce(n, 0) as n_instances from s left join k using (image)
"""


def pixels_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Pixels inside the polygon of their raster, counted by raster."""
    p = _pixels(spark, d)
    base = p.select("raster_id").distinct()
    scale = 0.5 / 111_319.49079327358
    polygons = base.select("raster_id", G.rectangle(0.0 * F.col("raster_id"), 0.0 * F.col("raster_id"), F.lit(scale * 10.1), F.lit(scale * 5.3)).alias("ring"))
    grids = base.select("raster_id", F.lit(-10.0).alias("origin_x"), F.lit(10.0).alias("origin_y"), F.lit(1.0).alias("scale_m"))
    return A.zone_pixels(p, grids, polygons, "raster_id").groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_pixels"))


PIXELS_IN_POLYGON = SQL + "select raster_id, count(*) as n_pixels from pixels where abs(-10+col+0.5e0) < 2.65e0 and abs(10-row-0.5e0) < 5.05e0 group by 1"

def rasters_read(spark: SparkSession, d: str) -> DataFrame:
    """Rasters written as NPY files of three bands and two of these read back, each pixel by its place in the file."""
    folder = new_folder(spark)
    made = written(npy.write_rasters(_pixels(spark, d), folder, "raster_id", "ndvi", "grad", "tstd"))
    read = npy.read_rasters(spark, folder, "ndvi", "tstd").join(F.broadcast(made.select("raster_id", "path", "height", "width")) if made.count() <= 50_000 else made.select("raster_id", "path", "height", "width"), "path")
    checks = (F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), round_up(F.sum("value"), 2).alias("total"), round_up(F.sum(F.col("value") * (F.col("row") + 1)), 1).alias("by_row"), round_up(F.sum(F.col("value") * (F.col("col") + 1)), 1).alias("by_col"))
    return read.groupBy("raster_id", "band", "height", "width").agg(*checks)


# Values go through four bytes; pixels that no row has are NaN, read as null.
RASTERS_READ = SQL + f""", b as (select raster_id, row, col, 'ndvi' as band, cast(cast(ndvi as float) as double) as v from pixels union all select raster_id, row, col, 'tstd', cast(cast(tstd as float) as double) from pixels),
s as (select raster_id, cast(max(row)+1 as integer) as height, cast(max(col)+1 as integer) as width from pixels group by 1)
select raster_id, band, height, width, count(v) as n, height*width-count(v) as n_null, {r('sum(v)', 2)} as total, {r('sum(v*(row+1))', 1)} as by_row, {r('sum(v*(col+1))', 1)} as by_col from b join s using (raster_id) group by raster_id, band, height, width
"""

QUERIES = {
    "rasters_read": (rasters_read, RASTERS_READ),
    "zone_statistics": (zone_statistics, ZONE_STATISTICS),
    "boundary_strength": (boundary_strength, BOUNDARY_STRENGTH),
    "seed_thresholds": (seed_thresholds, SEED_THRESHOLDS),
    "gradients": (gradients, GRADIENTS),
    "segments": (segments, None),
    "mask_summary": (mask_summary, MASK_SUMMARY),
    "pixels_in_polygon": (pixels_in_polygon, PIXELS_IN_POLYGON),
}
