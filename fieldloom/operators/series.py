"""Scenes, composites, weather sums and phenology, as grouped aggregates and windows over tables of all parcels at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import polygons as P
from fieldloom.functions import spectral as X
from fieldloom.functions.mathx import round_to, round_up
from fieldloom.functions.text import age_days, growth_stage
from fieldloom.operators import spatial as S
from fieldloom.sources.shared import written


def month_windows(spark: SparkSession, as_of: str, months: int, span: int = 1) -> DataFrame:
    """(label, start, end) of the last months up to that of a date, oldest first.

    With span 1 windows tumble, one calendar month each; with span 2 they hop: each is two months long and starts
    a month after the one before.
    """
    first = F.trunc(F.lit(as_of).cast("date"), "month")
    starts = spark.range(months, numPartitions=1).select(F.add_months(first, (F.col("id") - (months - 1)).cast("int")).alias("start"))
    return starts.select(F.date_format("start", "yyyy-MM").alias("label"), "start", F.last_day(F.add_months("start", span - 1)).alias("end"))


def in_month_windows(df: DataFrame, ts: str, as_of: str, months: int, span: int = 1) -> DataFrame:
    """Rows with the ``label`` of each month window that holds their time; a row falls into at most ``span`` windows, so no range join is needed. The last day of a window is left out of it, as date filters exclude their end."""
    day = F.col(ts).cast("date")
    last = F.trunc(F.lit(as_of).cast("date"), "month")
    first = F.add_months(last, 1 - months)
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.add_months(F.trunc(day, "month"), -k)))
    out = df.where((day >= first) & (day <= F.last_day(F.add_months(last, span - 1)))).withColumn("_s", start)
    out = out.where(F.col("_s").between(first, last) & (day < F.last_day(F.add_months("_s", span - 1))))
    return out.withColumn("label", F.date_format("_s", "yyyy-MM")).drop("_s")


def usable(scenes: DataFrame, max_cloud: float) -> DataFrame:
    return scenes.where(F.col("cloud_pct") < max_cloud)


def scenes_of(scenes: DataFrame, start: str, end: str, max_cloud: float | None = None, mode: str | None = None) -> DataFrame:
    """Scenes in [start, end), less cloudy than a bound, of an instrument mode; whatever is not asked for is not filtered."""
    out = scenes.where((F.col("ts") >= start) & (F.col("ts") < end))
    out = out if max_cloud is None else usable(out, max_cloud)
    return out if mode is None else out.where(F.col("instrument_mode") == mode)


def images_over(images: DataFrame, regions: DataFrame, start: str, end: str, max_cloud: float | None = None, mode: str | None = None) -> DataFrame:
    """(image_id, region_id) of the images (image_id, footprint, ts, ...) chosen as by ``scenes_of`` whose footprint has a point in common with a region (region_id, ring).

    Images are chosen before the join, where filters reach the scan; footprints and regions, rings or shapes, then meet by cell of their bounding
    boxes. Where boxes meet, a convex footprint of four points and a rectangle are compared by their sides; of other shapes edges are looked at.
    """
    chosen = scenes_of(images, start, end, max_cloud, mode).select("image_id", F.col("footprint").alias("ring"))
    shape, footprint = S.shape_of(regions, "ring"), S.shape_of(chosen, "ring")
    a = written(regions.select("region_id", "ring", P.bounds(shape).alias("_box"), P.upright(shape).alias("_plain")))
    b = written(chosen.select("image_id", F.col("ring").alias("r_ring"), P.bounds(footprint).alias("_r_box"), P.quad_edges(footprint).alias("_quad")))
    plain, quad = a.where("_plain").select("region_id", "_box"), b.where("_quad is not null").select("image_id", "_r_box", "_quad")
    # No array and no function over arrays in this join, which most pairs come from.
    out = S.box_pairs(plain, quad, "_box", "_r_box", salts=2).where(P.quad_meets_box(F.col("_quad"), F.col("_r_box"), F.col("_box"))).select("image_id", "region_id")
    odd = b.where("_quad is null")
    for left, right in ((a.where("_plain"), odd), (a.where("not _plain"), b)):
        if not left.isEmpty() and not right.isEmpty():
            pairs = S.box_pairs(left, right, "_box", "_r_box")
            out = out.unionByName(pairs.where(P.intersects(S.shape_of(pairs, "ring"), S.shape_of(pairs, "r_ring"))).select("image_id", "region_id"))
    return out


def pixels_over(pixels: DataFrame, pairs: DataFrame, regions: DataFrame, size: float | None = None) -> DataFrame:
    """Pixels (image_id, lat, lng of their centre, ...) with the regions of their image that hold their centre, met by image and grid cell."""
    wanted = pairs.join(regions.select("region_id", "ring"), "region_id").select(F.col("image_id").alias("_image"), "region_id", "ring")
    return S.containing(pixels, wanted, size, "lat", "lng", also=F.col("image_id") == F.col("_image")).drop("_image", "ring")


def composite(pixels: DataFrame, bands: list[str], *keys: str) -> DataFrame:
    """Per-pixel medians over the scenes of a group."""
    return pixels.groupBy(*keys, "pixel_id").agg(*[F.median(b).alias(b) for b in bands], F.count(F.lit(1)).alias("n_scenes"))


def region_mean(pixels: DataFrame, bands: list[str], *keys: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands], F.count(F.lit(1)).alias("n_pixels"))


def region_series(scenes: DataFrame, bands: list[str], as_of: str, months: int, span: int, max_cloud: float) -> DataFrame:
    """(region_id, label, bands): medians over time, then means over pixels, for each month window."""
    inside = in_month_windows(usable(scenes, max_cloud), "ts", as_of, months, span)
    return region_mean(composite(inside, bands, "region_id", "label"), bands, "region_id", "label")


def temporal_spread(scenes: DataFrame, as_of: str, days: int = 120, parts: int = 4) -> DataFrame:
    """Standard deviation (of the population) of a pixel's NDVI composites over equal parts of a season."""
    end = F.lit(as_of).cast("date")
    start = F.date_sub(end, days)
    day = F.col("ts").cast("date")
    part = F.floor(F.datediff(day, start) / (days / parts)).cast("int")
    medians = scenes.where((day >= start) & (day < end)).withColumn("part", part).groupBy("region_id", "pixel_id", "part").agg(F.median(X.normalized(F.col("b8"), F.col("b4"))).alias("ndvi"))
    return medians.groupBy("region_id", "pixel_id").agg(F.stddev_pop("ndvi").alias("tstd"), F.count("ndvi").alias("n_parts"))


def best_image(scenes: DataFrame, as_of: str, primary_days: int = 5, fallback_days: int = 10) -> DataFrame:
    """The least cloudy scene of each region in the last days, or, if there is none, in some days more; its date and age."""
    end = F.lit(as_of).cast("timestamp")
    age = F.datediff(end.cast("date"), F.col("ts").cast("date"))
    pick = lambda ok: F.min(F.when(ok, F.struct("cloud_pct", "ts", "scene_id")))
    found = scenes.where((age >= 1) & (age <= fallback_days)).groupBy("region_id").agg(pick(age <= primary_days).alias("p"), pick(age <= fallback_days).alias("f"))
    return found.select(
        "region_id",
        F.coalesce("p", "f")["scene_id"].alias("scene_id"),
        F.coalesce("p", "f")["cloud_pct"].cast("double").alias("cloud_pct"),
        F.coalesce("p", "f")["ts"].cast("date").alias("image_date"),
        age_days(F.coalesce("p", "f")["ts"], end).alias("image_age_days"),
        F.col("p").isNotNull().alias("is_primary"),
    )


def degree_days(weather: DataFrame, base: float) -> DataFrame:
    """Daily degree days (which may be negative) and their running sum of each site; days without both temperatures are left out."""
    days = weather.where(F.col("tmax").isNotNull() & F.col("tmin").isNotNull()).withColumn("dj", round_to((F.col("tmax") + F.col("tmin")) / 2 - base, 10, 10.0))
    run = W.partitionBy("site_id").orderBy("obs_date").rowsBetween(W.unboundedPreceding, 0)
    return days.withColumn("running", round_up(F.sum("dj").over(run), 1))


def degree_day_totals(weather: DataFrame, base: float, threshold: float) -> DataFrame:
    """(site_id, cumulative, detected, n_days, start_date, end_date); dates are those of all days. Sites without a valid day are absent."""
    dj = F.when(F.col("tmax").isNotNull() & F.col("tmin").isNotNull(), round_to((F.col("tmax") + F.col("tmin")) / 2 - base, 10, 10.0))
    found = weather.groupBy("site_id").agg(F.sum(dj).alias("s"), F.count(dj).alias("n_days"), F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date"))
    return found.where("n_days > 0").select("site_id", round_up(F.col("s"), 1).alias("cumulative"), (round_up(F.col("s"), 6) >= threshold).alias("detected"), "n_days", "start_date", "end_date")


def monthly_rain(weather: DataFrame, windows: DataFrame, as_of: str) -> DataFrame:
    """Rain of each site and month of a spine; a month without data is null. The last two days before ``as_of`` are not in the archive."""
    cut = F.date_sub(F.lit(as_of).cast("date"), 2)
    seen = weather.where(F.col("precipitation_mm").isNotNull() & (F.col("obs_date") <= cut))
    totals = seen.groupBy("site_id", F.date_format("obs_date", "yyyy-MM").alias("label")).agg(F.sum("precipitation_mm").alias("s"))
    spine = weather.select("site_id").distinct().crossJoin(F.broadcast(windows.select("label")))  # a handful of months
    return spine.join(totals, ["site_id", "label"], "left").select("site_id", "label", round_up(F.col("s"), 1).alias("precipitation_mm"))


def spread(series: DataFrame) -> DataFrame:
    """(parcel_id, n_ndvi, ndvi_range, and quantiles) of each parcel's months with NDVI."""
    v = F.col("ndvi")
    return series.groupBy("parcel_id").agg(
        F.count(v).alias("n_ndvi"),
        (F.max(v) - F.min(v)).alias("ndvi_range"),
        F.median(v).alias("ndvi_median"),
        F.percentile(v, 0.1).alias("ndvi_q10"),
        F.percentile(v, 0.9).alias("ndvi_q90"),
    )


def month_results(results: DataFrame, windows: DataFrame) -> DataFrame:
    """Results that come as a list in the order of months (id, values), a row a month; missing places are null."""
    names = windows.agg(F.array_sort(F.collect_list("label")).alias("labels"))
    both = results.crossJoin(F.broadcast(names)).select("id", F.explode(F.arrays_zip(F.col("labels").alias("label"), F.col("values").alias("value"))).alias("m"))
    return both.select("id", "m.label", "m.value").where("label is not null")


def planting(series: DataFrame, as_of: str, align: str = "position") -> DataFrame:
    """Estimated planting of each parcel from a monthly series (parcel_id, month_key, ndvi in percent, vv).

    The largest rise of NDVI of 15 points or more between months with data, else a rise of more than 5 after the lowest month. A
    rise of radar at the same place adds confidence; ``align`` tells whether places are counted among months with
    NDVI (position) or are months (month).
    """
    order = W.partitionBy("parcel_id").orderBy("month_key")
    numbered = series.withColumn("place", F.row_number().over(order) - 1)
    radar = numbered.select("parcel_id", F.col("place").alias("r_place"), F.col("month_key").alias("r_month"), F.col("vv").alias("vv_now"), F.lag("vv").over(order).alias("vv_before"))
    valid = numbered.where("ndvi is not null")
    valid = valid.withColumn("idx", F.row_number().over(order) - 1).withColumn("before", F.lag("ndvi").over(order)).withColumn("after", F.lead("ndvi").over(order)).withColumn("next_key", F.lead("month_key").over(order)).withColumn("rise", F.col("ndvi") - F.col("before"))
    picked = valid.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("rise") > 0, F.struct("rise", (-F.col("idx")).alias("o"), "month_key"))).alias("jump"),
        F.min(F.struct("ndvi", "idx", "after", "next_key")).alias("low"),
    )
    big = F.coalesce(F.col("jump.rise") >= 15, F.lit(False))
    small = F.coalesce(F.col("low.after") - F.col("low.ndvi") > 5, F.lit(False))
    found = picked.select(
        "parcel_id",
        F.when(F.col("n") >= 2, F.when(big, F.col("jump.rise")).when(small, F.col("low.after") - F.col("low.ndvi"))).alias("rise"),
        F.when(F.col("n") >= 2, F.when(big, -F.col("jump.o")).when(small, F.col("low.idx") + 1)).alias("at"),
        F.when(F.col("n") >= 2, F.when(big, F.col("jump.month_key")).when(small, F.col("low.next_key"))).alias("month"),
    )
    same = F.col("at") == F.col("r_place") if align == "position" else F.col("month") == F.col("r_month")
    both = found.join(radar.withColumnRenamed("parcel_id", "r_id"), (F.col("parcel_id") == F.col("r_id")) & same, "left")
    confidence = F.least(F.lit(90.0), round_up(F.col("rise") * 2))
    backed = F.coalesce(F.col("vv_now") - F.col("vv_before") > 0.5, F.lit(False))
    day = F.date_add(F.to_date("month", "yyyy-MM"), 9)
    days = F.datediff(F.lit(as_of).cast("date"), day)
    return both.select(
        "parcel_id",
        day.alias("planting_date"),
        F.date_add(day, 100).alias("harvest_date"),
        F.when(days > 0, days).when(days.isNotNull(), 0).alias("days_since_planting"),
        growth_stage(days).alias("growth_stage"),
        F.when(F.col("rise").isNull(), 0.0).when(backed, F.least(F.lit(95.0), confidence + 10)).otherwise(confidence).alias("planting_confidence"),
    )
