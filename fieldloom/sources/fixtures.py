"""Parcel tables derived from the generic test tables. Each text is valid in Spark SQL and in DuckDB, so queries and oracles see equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.functions import geometry as G

BASE = ("customer", "part", "events", "lineitem", "orders", "supplier", "nation", "region")

PARCELS = """
select c_custkey as parcel_id, 0 as ord,
  -19.9e0 + ((c_custkey*7919)%9973)/99730e0 as center_lat,
  46.98e0 + ((c_custkey*104729)%10007)/100070e0 as center_lng,
  (2 + c_custkey%13)/10000e0 as half_lat, (2 + c_custkey%17)/10000e0 as half_lng,
  c_mktsegment as crop_pred,
  case when c_custkey%11=0 then null else ((c_custkey*31)%100)/100e0 end as confidence
from customer
"""
#: Some ids twice, with another crop and confidence, and some rows without an id.
PARCELS_RAW = """
select case when parcel_id%97=0 then null else parcel_id end as parcel_id, parcel_id*2 as ord, center_lat, center_lng, half_lat, half_lng, crop_pred, confidence from parcels
union all
select parcel_id, parcel_id*2+1, center_lat, center_lng, half_lat, half_lng, 'SECOND', ((parcel_id*17)%100)/100e0 from parcels where parcel_id%7=0
"""
TRACED = """
select p_partkey as traced_id,
  -19.9e0 + ((p_partkey*5279)%9973)/99730e0 as center_lat,
  46.98e0 + ((p_partkey*88799)%10007)/100070e0 as center_lng,
  (1 + p_partkey%7)/10000e0 as half_lat, (1 + p_partkey%5)/10000e0 as half_lng,
  case when p_partkey%9=0 then null else ((p_partkey*37)%1000)/10e0 end as confidence
from part
"""
WEATHER = """
select user_id as site_id, cast(ts as date) as obs_date, max(value)/10e0 as tmax,
  case when user_id%10=3 and min(value)<1 then null else min(value)/10e0 end as tmin, sum(value)/10e0 as precipitation_mm
from events group by user_id, cast(ts as date)
"""
SCENE_PIXELS = """
select l_orderkey*10+l_linenumber as scene_id, l_suppkey as region_id, cast(l_shipdate as timestamp) as ts,
  l_partkey%4 as pixel_id, (l_orderkey*37)%100 as cloud_pct,
  2000e0+l_quantity*60e0 as b8, 400e0+l_discount*10000e0 as b4, 300e0+l_tax*5000e0 as b2,
  500e0+l_tax*4000e0 as b3, 900e0+l_discount*8000e0 as b5, 1500e0+l_quantity*20e0 as b11,
  -8e0-(l_partkey%70)/10e0 as vv, -13e0-(l_suppkey%90)/10e0 as vh
from lineitem
"""
SCAN_RUNS = """
select o_orderkey as run_id, 'v' || cast(o_orderkey%3 as varchar(10)) as version,
  -19.9e0 + ((o_custkey*7919)%9973)/99730e0 as center_lat, 46.98e0 + ((o_custkey*104729)%10007)/100070e0 as center_lng,
  cast(o_orderdate as timestamp) as created_at, o_totalprice as score
from orders
"""
#: A monthly series of each parcel, with gaps: NDVI in percent and radar.
SERIES = """
select s_suppkey as parcel_id, k.m as m, '2025-' || lpad(cast(k.m as varchar(2)), 2, '0') as month_key,
  case when (s_suppkey*7+k.m*13)%9=0 then null else cast((s_suppkey*31+k.m*k.m*17+k.m*s_suppkey)%70+10 as double) end as ndvi,
  case when (s_suppkey+k.m)%11=0 then null else -15e0+((s_suppkey*5+k.m*7)%40)/10e0 end as vv,
  -19.9e0 + (s_suppkey%100)/1000e0 as lat
from supplier cross join (select 1 as m union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) k
"""
#: Twelve months of reflectances for the seasonal features, with cloudy months.
BANDS = """
select s_suppkey as parcel_id, k.m as m, '2025-' || lpad(cast(k.m as varchar(2)), 2, '0') as month_key,
  case when (s_suppkey+k.m*5)%8=0 then null else 1000e0+((s_suppkey*37+k.m*k.m*91)%3000) end as b8,
  case when (s_suppkey+k.m*5)%8=0 then null else 300e0+((s_suppkey*53+k.m*29)%900) end as b4,
  case when (s_suppkey+k.m*5)%8=0 then null else 200e0+((s_suppkey*11+k.m*7)%500) end as b2,
  case when (s_suppkey+k.m*5)%8=0 then null else 350e0+((s_suppkey*13+k.m*43)%700) end as b3,
  case when (s_suppkey+k.m*5)%8=0 then null else 500e0+((s_suppkey*17+k.m*3)%900) end as b5,
  case when (s_suppkey+k.m*5)%8=0 then null else 600e0+((s_suppkey*23+k.m*19)%900) end as b6,
  case when (s_suppkey+k.m*5)%8=0 then null else 700e0+((s_suppkey*29+k.m*47)%900) end as b7,
  case when (s_suppkey+k.m*5)%8=0 then null else 1100e0+((s_suppkey*59+k.m*61)%2500) end as b8a,
  case when (s_suppkey+k.m*5)%8=0 then null else 900e0+((s_suppkey*41+k.m*31)%1500) end as b11,
  case when (s_suppkey+k.m*5)%8=0 then null else 800e0+((s_suppkey*67+k.m*23)%1100) end as b12
from supplier cross join (select 1 as m union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7
  union all select 8 union all select 9 union all select 10 union all select 11 union all select 12) k
"""
#: What a parcel's analysis starts from.
ANALYSES = """
select c_custkey as parcel_id, -19.9e0 + ((c_custkey*7919)%9973)/99730e0 as lat,
  case when c_custkey%13=0 then null else cast((c_custkey*29)%101 as double) end as ndvi,
  case when c_custkey%17=0 then null else cast((c_custkey*3)%150-5 as integer) end as days_since_planting,
  case when c_custkey%7=0 then null else -7e0-((c_custkey*11)%100)/10e0 end as vv,
  case when c_custkey%7=0 then null else -12e0-((c_custkey*19)%130)/10e0 end as vh,
  case when c_custkey%5=0 then null else cast((c_custkey*23)%40 as double) end as ndvi_range,
  c_custkey%6 as n_ndvi,
  case when c_custkey%3=0 then null else cast((c_custkey*41)%1000 as double)/10e0 end as cnn_confidence, c_custkey%2=0 as cnn_is_barley,
  case when c_custkey%4<>0 then null else cast((c_custkey*43)%1000 as double)/1000e0 end as rf_probability,
  cast((c_custkey*7)%100 as double)/100e0 as ndvi_oct, cast(150+(c_custkey*13)%160 as double) as doy_peak,
  case when c_custkey%9=0 then null else c_custkey%2=1 end as gdd_detected
from customer
"""
ALL = {
    "parcels": PARCELS, "parcels_raw": PARCELS_RAW, "traced": TRACED, "weather": WEATHER, "scene_pixels": SCENE_PIXELS,
    "scan_runs": SCAN_RUNS, "series": SERIES, "bands": BANDS, "analyses": ANALYSES,
}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause that an oracle starts with; a table's own sources come before it."""
    need = {"parcels_raw": ["parcels"]}
    order: list[str] = []
    for n in names:
        for x in [*need.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "with " + ("recursive " if recursive else "") + ", ".join(f"{n} as ({ALL[n]})" for n in order) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its base tables are read from Parquet, so filters and columns reach the scan."""
    text = ALL[name]
    own = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if b in text}
    if name == "parcels_raw":
        return spark.sql(text.replace("from parcels", "from {parcels}"), parcels=table(spark, sf_dir, "parcels"))
    for b in own:
        text = text.replace(f"from {b}", "from {" + b + "}")
    return spark.sql(text, **own)


def with_ring(df: DataFrame) -> DataFrame:
    """df with the rectangle's ring."""
    return df.withColumn("ring", G.rectangle("center_lat", "center_lng", "half_lat", "half_lng"))
