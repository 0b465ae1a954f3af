"""Zone queries: crops of a circle, automatically traced parcels of a circle, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions import geometry as G
from fieldloom.functions.mathx import haversine_m, round_even, round_up
from fieldloom.operators import spatial as S
from fieldloom.sources.shared import written


def best_by_id(parcels: DataFrame, id: str = "parcel_id", order: str = "ord") -> DataFrame:
    """One row of each id, the most confident (of equals the first); rows without an id all stay. ``pos`` has the place in the result: that of an id's first row, then rows without ids."""
    has = F.col(id).isNotNull() & (F.col(id).cast("string") != "")
    named = parcels.where(has)
    firsts = named.groupBy(id).agg(F.min(order).alias("pos"))
    kept = S.first_by(named, [id], F.coalesce("confidence", F.lit(0.0)).desc(), F.col(order)).join(firsts, id)
    return kept.withColumn("unnamed", F.lit(0)).unionByName(parcels.where(~F.coalesce(has, F.lit(False))).withColumn("pos", F.col(order)).withColumn("unnamed", F.lit(1)))


def crops_in_circle(parcels: DataFrame, lat: float, lng: float, radius_m: float, min_confidence: float = 0.0, crops: list[str] | None = None) -> DataFrame:
    """Parcels whose centre is in a circle, with distance_m. A confidence of 0 and an empty list of crops filter nothing."""
    found = S.in_circle(parcels, lat, lng, min(float(radius_m), K.MAX_RADIUS_M))
    if min_confidence:
        found = found.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    if crops:
        found = found.where(F.col("crop_pred").isin(*crops))
    return found.withColumn("distance_m", round_even(F.col("distance_m")).cast("long"))


def granularity(area_ha: Column, ring: Column, lat: Column) -> Column:
    """A parcel up to two hectares, a block beyond; an area that is missing is measured."""
    return F.when(F.coalesce(area_ha, G.area_ha(ring, lat)) <= K.PARCEL_MAX_HA, "parcelle").otherwise("bloc")


def zone_crops(parcels: DataFrame, lat: float, lng: float, radius_m: float, min_confidence: float = 0.0, crops: list[str] | None = None, traced: DataFrame | None = None) -> DataFrame:
    """Features of a circle: (parcel_id, source_id, crop_pred, area_ha, distance_m, cover_ratio, granularity, geometry_source, source_rank).

    With traced parcels each takes the crop of the block that covers it most; blocks covered enough go. A traced parcel keeps its own
    ``area_ha`` (unless that is 0) and ``source`` if the table has them; other areas are measured.
    """
    blocks = crops_in_circle(parcels, lat, lng, radius_m, min_confidence, crops).withColumn("source_id", F.col("parcel_id"))
    whole = blocks
    halves = None
    if traced is not None:
        ranked = blocks.select(F.col("parcel_id").alias("block_id"), F.col("parcel_id").alias("block_rank"), "ring")
        mine = traced.select(F.col("traced_id").alias("parcel_id"), "ring")
        assigned = S.assign_by_overlap(ranked, mine)
        left = S.uncovered(ranked, assigned).select(F.col("block_id").alias("parcel_id"))
        whole = blocks.join(left, "parcel_id", "left_semi")
        from fieldloom.functions.mathx import haversine_m

        own = lambda c: F.col(f"own_{c}") if c in traced.columns else F.lit(None)
        given = traced.select(F.col("traced_id").alias("parcel_id"), "ring", "center_lat", "center_lng", *[F.col(c).alias(f"own_{c}") for c in ("area_ha", "source") if c in traced.columns])
        halves = (
            assigned.join(given, "parcel_id")
            .join(blocks.select(F.col("source_id").alias("block_id"), "crop_pred"), "block_id")
            .select(
                F.col("parcel_id"),
                F.col("block_id").alias("source_id"),
                "crop_pred",
                round_even(F.coalesce(F.nullif(own("area_ha").cast("double"), F.lit(0.0)), G.area_ha(F.col("ring"), F.col("center_lat"))), 4).alias("area_ha"),
                round_even(haversine_m(F.lit(lng), F.lit(lat), "center_lng", "center_lat")).cast("long").alias("distance_m"),
                round_even(F.col("cover_ratio"), 3).alias("cover_ratio"),
                F.lit("parcelle").alias("granularity"),
                F.coalesce(F.nullif(own("source").cast("string"), F.lit("")), F.lit("JECAM-VHR")).alias("geometry_source"),
                F.lit(0).alias("source_rank"),
            )
        )
    out = whole.select(
        "parcel_id",
        "source_id",
        "crop_pred",
        "area_ha",
        "distance_m",
        F.lit(None).cast("double").alias("cover_ratio"),
        granularity(F.col("area_ha"), F.col("ring"), F.col("center_lat")).alias("granularity"),
        F.lit("JECAM").alias("geometry_source"),
        F.lit(1).alias("source_rank"),
    )
    return halves.unionByName(out) if halves is not None else out


def crop_summary(features: DataFrame) -> DataFrame:
    """Parcels and hectares of each crop, the most frequent first; blocks don't count, missing areas are 0."""
    crop = F.coalesce(F.nullif(F.col("crop_pred"), F.lit("")), F.lit(K.NO_CROP))
    counted = features.where("granularity <> 'bloc'").groupBy(crop.alias("crop")).agg(F.count(F.lit(1)).alias("n_parcels"), round_up(F.sum(F.coalesce("area_ha", F.lit(0.0))), 2).alias("area_ha"), F.min(F.struct("distance_m", "source_rank", "parcel_id")).alias("first"))
    return counted.orderBy(F.desc("n_parcels"), "first").select("crop", "n_parcels", "area_ha")


def ordered(features: DataFrame) -> DataFrame:
    return features.orderBy("distance_m", "source_rank", "parcel_id")


def zone_totals(features: DataFrame, lat: float, lng: float) -> DataFrame:
    """One row: parcels, parcels from traced ones, blocks, hectares, and whether the point is outside the covered region."""
    x0, y0, x1, y1 = K.COVERAGE_BBOX
    outside = not (x0 <= lng <= x1 and y0 <= lat <= y1)
    parcel = F.col("granularity") != "bloc"
    return features.agg(
        F.count_if(parcel).alias("n_parcels"),
        F.count_if(F.col("source_rank") == 0).alias("n_from_traced"),
        F.count_if(~parcel).alias("n_blocs"),
        F.coalesce(round_up(F.sum(F.when(parcel, F.coalesce("area_ha", F.lit(0.0)))), 2), F.lit(0.0)).alias("area_ha_total"),
    ).withColumn("outside_coverage", F.lit(outside))


def size_class(area_ha: Column) -> Column:
    out = None
    for name, low, high in K.SIZE_CLASSES:
        hit = (area_ha >= low) & (area_ha < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def traced_in_circle(parcels: DataFrame, lat: float, lng: float, radius_m: float, min_confidence: float = 0.0, min_area_ha: float = 0.0, limit: int = K.MAX_FEATURES) -> DataFrame:
    """The nearest traced parcels (ftw_id, confidence, area_ha, xmin, ymin, xmax, ymax) whose box centre is in a circle.

    All bounds reach the Parquet scan; confidence and area are filtered only if asked for, so nulls stay otherwise.
    """
    from fieldloom.functions.mathx import degrees_of, haversine_m

    radius_m = min(float(radius_m), K.MAX_RADIUS_M)
    d_lng, d_lat = degrees_of(radius_m, lat)
    found = parcels.where((F.col("xmax") >= lng - d_lng) & (F.col("xmin") <= lng + d_lng) & (F.col("ymax") >= lat - d_lat) & (F.col("ymin") <= lat + d_lat))
    if min_confidence:
        found = found.where(F.col("confidence") >= float(min_confidence))
    if min_area_ha:
        found = found.where(F.col("area_ha") >= float(min_area_ha))
    d = haversine_m(F.lit(lng), F.lit(lat), (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    found = S.nearest(found.withColumn("_d", d).where(F.col("_d") <= radius_m), "_d", "ftw_id", limit)
    return found.select("ftw_id", round_up(F.col("confidence"), 1).alias("confidence"), round_up(F.col("area_ha"), 4).alias("area_ha"), F.col("_d").cast("int").alias("distance_m"), F.lit("FTW").alias("source"))


def traced_in_circles(parcels: DataFrame, circles: DataFrame, min_confidence: float = 0.0, min_area_ha: float = 0.0, limit: int = K.MAX_FEATURES) -> DataFrame:
    """The same for a table of circles (query_id, lat, lng, radius_m): the nearest of each, at most ``limit``, with query_id and rank.

    Box centres and circles meet by the cells of a quadtree; circles are first narrowed to what holds ``limit`` centres (``_narrowed``).
    """
    q = circles.select("query_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.least(F.col("radius_m").cast("double"), F.lit(K.MAX_RADIUS_M)).alias("_r"))
    q = written(q.withColumn("_circle", S.circle_box("_lat", "_lng", "_r")))
    if min_confidence:
        parcels = parcels.where(F.col("confidence") >= float(min_confidence))
    if min_area_ha:
        parcels = parcels.where(F.col("area_ha") >= float(min_area_ha))
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    spots = parcels.select("ftw_id", "confidence", "area_ha", F.struct(x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1")).alias("_spot"))
    spots = written(spots.withColumn("_n", F.row_number().over(W.partitionBy("_spot").orderBy("ftw_id"))).where(F.col("_n") <= limit).drop("_n"))  # of centres in one place the first are nearest
    q = written(_narrowed(q, spots, limit))
    near = S.box_pairs(spots, q, "_spot", "_circle").withColumn("_d", haversine_m("_lng", "_lat", F.col("_spot.x0"), F.col("_spot.y0"))).where(F.col("_d") <= F.col("_r"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_d", "ftw_id"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "ftw_id", round_up(F.col("confidence"), 1).alias("confidence"), round_up(F.col("area_ha"), 4).alias("area_ha"), F.col("_d").cast("int").alias("distance_m"), "rank")


#: Cells that circles are narrowed by: the finest are so many degrees wide, each level's twice as wide.
_FINE, _STEPS = S.FINEST / 32, 14


def _narrowed(q: DataFrame, spots: DataFrame, limit: int) -> DataFrame:
    """Circles (_lat, _lng, _r, _circle) with a radius within which at least ``limit`` spots lie, where that is less: what the smallest cell around its centre with so many spots is across.

    Thus a circle meets some multiple of ``limit`` spots, however many there are in all of it. Spots are counted by cell, circles find counts by an equi-join.
    """
    at = lambda v: F.floor(v / _FINE)
    steps = F.explode(F.sequence(F.lit(0), F.lit(_STEPS - 1))).alias("_k")
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("_k")).alias(c)
    fine = spots.groupBy(at(F.col("_spot.x0")).alias("_cx"), at(F.col("_spot.y0")).alias("_cy")).agg(F.count(F.lit(1)).alias("n"))
    full = fine.select("_cx", "_cy", "n", steps).select("_k", up("_cx"), up("_cy"), "n").groupBy("_k", "_cx", "_cy").agg(F.sum("n").alias("n")).where(F.col("n") >= limit).drop("n")
    places = q.select("_lat", "_lng").distinct()
    held = places.select("_lat", "_lng", at(F.col("_lng")).alias("_cx"), at(F.col("_lat")).alias("_cy"), steps).select("_lat", "_lng", "_k", up("_cx"), up("_cy"))
    best = held.join(full, ["_k", "_cx", "_cy"]).groupBy("_lat", "_lng").agg(F.min("_k").alias("_k"))
    across = F.radians(F.pow(F.lit(2.0), F.col("_k")) * _FINE) * (2**0.5 * 1.001 * K.EARTH_RADIUS_M)
    return q.join(best, ["_lat", "_lng"], "left").withColumn("_r", F.least("_r", across)).withColumn("_circle", S.circle_box("_lat", "_lng", "_r")).drop("_k")


def size_histogram(features: DataFrame) -> DataFrame:
    """Parcels of each size class, empty classes too, with the totals."""
    counts = [F.count_if((F.col("area_ha") >= low) & (F.col("area_ha") < high)).alias(f"c{k}") for k, (_, low, high) in enumerate(K.SIZE_CLASSES)]
    one = features.agg(*counts, F.count(F.lit(1)).alias("n_total"), F.coalesce(round_up(F.sum("area_ha"), 2), F.lit(0.0)).alias("area_ha_total"))
    rows = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("size_range"), F.col(f"c{k}").alias("n_parcels")) for k, (name, _, _) in enumerate(K.SIZE_CLASSES)])
    return one.select(F.explode(rows).alias("r"), "n_total", "area_ha_total").select("r.*", "n_total", "area_ha_total")


def cached_traces(traces: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Of each zone's cached traces the one to use: not older than so many days, mixed before simple, newest first. (zone_key, mode, traced_at, ...)"""
    fresh = traces.where((F.col("traced_at") <= as_of) & (F.col("traced_at") >= as_of - F.make_interval(days=F.lit(days))))
    return S.first_by(fresh, ["zone_key"], F.when(F.col("mode") == "mix", 0).otherwise(1), F.col("traced_at").desc())


def vhr_parcels(features: DataFrame, min_confidence: float = 0.0, min_area_ha: float = 0.0) -> DataFrame:
    """Features whose confidence and area reach both bounds; a null reaches none."""
    return features.where((F.col("confidence") >= min_confidence) & (F.col("area_ha") >= min_area_ha))
