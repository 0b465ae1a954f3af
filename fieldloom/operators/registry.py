"""The parcel registry: scans, lookups, upserts, guarded deletes, validation and candidate discovery over tables."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.functions.mathx import col, flat_km, round_up
from fieldloom.operators.spatial import shape_of
from fieldloom.sources.shared import written


def newest_first(parcels: DataFrame, tie: str = "parcel_id") -> DataFrame:
    return parcels.orderBy(F.desc("created_at"), tie)


def lookup(parcels: DataFrame, **keys) -> DataFrame:
    """Rows with given values of columns, such as a label or a primary key; the filter reaches the scan."""
    for name, value in keys.items():
        parcels = parcels.where(F.col(name) == value)
    return parcels


def insert(parcels: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """parcels and new rows, with an id from their label and the time; columns that new lacks are null."""
    stamped = new.withColumn("created_at", as_of)
    return parcels.unionByName(stamped, allowMissingColumns=True).select(*parcels.columns)


def near_box(parcels: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """Rows whose centre is in the box around a circle; the bounds reach the scan."""
    d_lat = radius_km / K.KM_PER_DEG_LAT
    d_lng = radius_km / (K.KM_PER_DEG_LNG * max(abs(math.cos(math.radians(lat))), 0.1))
    return parcels.where(F.col("center_lat").between(lat - d_lat, lat + d_lat) & F.col("center_lng").between(lng - d_lng, lng + d_lng))


def latest_run(runs: DataFrame, version: str, lat: float, lng: float, reach: float = 0.01) -> DataFrame:
    """The last run of a version near a point."""
    near = runs.where((F.col("version") == version) & F.col("center_lat").between(lat - reach, lat + reach) & F.col("center_lng").between(lng - reach, lng + reach))
    return near.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


def upsert(old: DataFrame, new: DataFrame, key: str, listed: list[str]) -> DataFrame:
    """old with the listed columns of rows that new has by key, and new's other rows; columns that new lacks stay null in those. Keys of new are unique."""
    fresh = new.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in listed])
    both = old.join(fresh, F.col(key) == F.col("_key"), "full_outer")
    pick = lambda c: F.coalesce(key, "_key").alias(key) if c == key else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in listed else F.col(c)
    return both.select(*[pick(c) for c in old.columns])


class Registry:
    """A registry kept as Parquet in buckets of its key, of which an upsert rewrites only those that change.

    The folder holds data files of versions, never overwritten, and a manifest for each version that names each bucket's folder; a reader
    takes the newest manifest, so it sees the whole registry before or after an upsert, and a lost task or driver leaves at
    worst folders that no manifest names. One writer at a time: a version's manifest is created and never replaced, so of two
    writers the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict[int, str]]:
        """(newest version, folder of each bucket that has rows); version 0 is empty."""
        folder, fs = self._fs()
        if not fs.exists(folder):
            return 0, {}
        versions = [int(f.getPath().getName()[1:-5]) for f in fs.listStatus(folder) if re.fullmatch(r"v\d+\.json", f.getPath().getName())]
        if not versions:
            return 0, {}
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/v{max(versions)}.json", wholetext=True).collect())
        return max(versions), {int(k): v for k, v in json.loads(text).items()}

    def _publish(self, version: int, buckets: dict[int, str]) -> None:
        folder, fs = self._fs()
        fs.mkdirs(folder)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/v{version}.json")
        part = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.v{version}-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def read(self) -> DataFrame | None:
        """All rows; None of a registry without any."""
        _, buckets = self.manifest()
        return self.spark.read.parquet(*[f"{self.path}/{v}" for v in sorted(buckets.values())]) if buckets else None

    def write(self, rows: DataFrame) -> int:
        """The first version."""
        return self._write(rows, 1, {}, set(range(self.buckets)))

    def _write(self, rows: DataFrame, version: int, kept: dict[int, str], changed: set[int]) -> int:
        data = f"data/v{version}-{uuid.uuid4().hex}"
        split = rows.withColumn("_bucket", self._bucket(F.col(self.key)))
        split.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        found = {r["_bucket"] for r in self.spark.read.schema("_bucket int").parquet(f"{self.path}/{data}").select("_bucket").distinct().collect()} if changed else set()  # at most a row a bucket
        self._publish(version, {b: v for b, v in kept.items() if b not in changed} | {b: f"{data}/_bucket={b}" for b in found})
        return version

    def upsert(self, new: DataFrame, listed: list[str], latest: str | None = None) -> set[int]:
        """Overwrites the listed columns of rows that ``new`` has by key, adds its other rows, and returns the buckets that changed.

        Of rows of new with one key the last by ``latest`` counts; without such a column repeated keys are an error. Keys that are null are refused.
        """
        if latest is not None:
            new = new.withColumn("_n", F.row_number().over(W.partitionBy(self.key).orderBy(F.desc(latest), *[F.desc(c) for c in listed if c != latest]))).where("_n = 1").drop("_n")
        new = written(new)
        wrong = new.agg(F.count_if(F.col(self.key).isNull()).alias("nulls"), (F.count(self.key) - F.count_distinct(self.key)).alias("repeated")).first()
        if wrong["nulls"] or wrong["repeated"]:
            raise ValueError(f"{wrong['nulls']} keys are null, {wrong['repeated']} rows repeat a key")
        changed = {r["b"] for r in new.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()}  # at most a row a bucket
        version, buckets = self.manifest()
        touched = [f"{self.path}/{buckets[b]}" for b in sorted(changed) if b in buckets]
        whole = self.read()
        if whole is None:
            self.write(new)
            return changed
        old = self.spark.read.schema(whole.schema).parquet(*touched) if touched else whole.limit(0)
        if changed:
            self._write(upsert(old, new, self.key, listed), version + 1, buckets, changed)
        return changed


def delete(parcels: DataFrame, ids: DataFrame, key: str = "parcel_id") -> tuple[DataFrame, DataFrame]:
    """(what stays, outcome of each id): deleted, missing, or refused for parcels that were corrected by hand."""
    guarded = F.coalesce(F.col("data_source") == K.PROTECTED_SOURCE, F.lit(False))
    outcome = ids.join(parcels.select(key, guarded.alias("_g")), key, "left").select(key, F.when(F.col("_g").isNull(), "missing").when(F.col("_g"), "refused").otherwise("deleted").alias("outcome"))
    gone = outcome.where("outcome = 'deleted'").select(key)
    return parcels.join(gone, key, "left_anti"), outcome


def serialise(parcels: DataFrame, hidden: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Exposed columns, with times as ISO texts."""
    return parcels.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in parcels.dtypes if c not in hidden])


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with ``errors``: the names of the rules that a row breaks; a rule that is null is broken."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])))


def between(name: str, low: float, high: float, nullable: bool = False) -> Column:
    ok = F.col(name).between(low, high) & ~F.isnan(F.col(name).cast("double"))
    return F.col(name).isNull() | ok if nullable else ok


#: Bounds of each kind of request.
REQUESTS: dict[str, Callable[[], dict[str, Column]]] = {
    "analyze": lambda: {
        "latitude": between("latitude", -90, 90),
        "longitude": between("longitude", -180, 180),
        "radius": between("radius", 50, 20_000),
        "confidence_threshold": between("confidence_threshold", 0.5, 0.95),
        "min_area_ha": between("min_area_ha", 0.01, 5),
        "base_temperature": between("base_temperature", -20, 30),
        "threshold": between("threshold", 2_000, 10_000),
        "period_days": between("period_days", 1, 730),
    },
    "detect": lambda: {"lat": between("lat", -90, 90), "lng": between("lng", -180, 180), "radius_km": between("radius_km", 0.05, 20), "period_days": between("period_days", 1, 730)},
    "tile": lambda: {"z": between("z", 10, 19), "x": F.col("x") >= 0, "y": F.col("y") >= 0, "timestamp": F.col("timestamp") > 0},
    "planet": lambda: {"z": between("z", 0, 22), "x": (F.col("x") >= 0) & (F.col("x") < F.pow(F.lit(2.0), F.col("z"))), "y": (F.col("y") >= 0) & (F.col("y") < F.pow(F.lit(2.0), F.col("z")))},
    "zone": lambda: {"radius": (F.col("radius") > 0) & (F.col("radius") <= 20_000), "min_confidence": between("min_confidence", 0, 1)},
}


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with their errors)."""
    checked = validate(df, REQUESTS[kind]())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def rank_sources(*sources: DataFrame) -> DataFrame:
    """Ordered concatenation, with source_rank."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def _thinned(group: pd.DataFrame, apart_km: float, degree_km: tuple[float, float]) -> pd.DataFrame:
    """Ids that stay: a kept point is filed under its cell, and a new one is held only against those in the cells around."""
    lat, lng, ids = group["lat"].to_numpy(), group["lng"].to_numpy(), group["id"].to_numpy()
    scale = np.maximum(np.abs(np.cos(np.radians(lat))), 0.1)
    high, wide = apart_km / degree_km[0], apart_km / (degree_km[1] * scale.min())
    cells: dict[tuple[int, int], list[int]] = {}
    out = []
    for k in range(len(ids)):
        i, j = math.floor(lat[k] / high), math.floor(lng[k] / wide)
        near = (e for a in (-1, 0, 1) for b in (-1, 0, 1) for e in cells.get((i + a, j + b), ()))
        if not any(math.hypot((lng[k] - lng[e]) * degree_km[1] * scale[e], (lat[k] - lat[e]) * degree_km[0]) < apart_km for e in near):
            cells.setdefault((i, j), []).append(k)
            out.append(k)
    return group.iloc[out][["g", "id"]]


#: Groups of at most so many candidates are thinned by a fold in one task, larger ones by rounds; both give the same rows.
FOLD_ROWS = 5_000


def thin(candidates: DataFrame, group: str, *order: str, apart_km: float = K.CENTER_DUPLICATE_KM, id: str = "candidate_id", degree_km: tuple[float, float] = (K.KM_PER_DEG_LAT, K.KM_PER_DEG_LNG), fold_rows: int | None = None) -> DataFrame:
    """Greedy thinning of each query's candidates in an order: one stays if none that stayed is nearer than ``apart_km``.

    The order must tell a query's candidates apart. ``candidates`` are read several times, so they should be a table.
    """
    names = [f"o{k}" for k in range(len(order))]
    typed = candidates.select(F.col(group).alias("g"), F.col(id).alias("id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    types = dict(typed.dtypes)
    large = typed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (FOLD_ROWS if fold_rows is None else fold_rows)).select("g")
    several = not large.isEmpty()
    small = typed.join(large, typed["g"].eqNullSafe(large["g"]), "left_anti") if several else typed
    kept = small.groupBy("g").applyInPandas(lambda g: _thinned(g.sort_values(names, kind="stable"), apart_km, degree_km), f"g {types['g']}, id {types['id']}")
    if several:
        kept = kept.unionByName(_thinned_by_rounds(typed.join(large, "g", "left_semi"), names, apart_km, degree_km))
    return candidates.join(kept.select(F.col("g").alias(group), F.col("id").alias(id)), [group, id], "left_semi")


def _thinned_by_rounds(typed: DataFrame, names: list[str], apart_km: float, degree_km: tuple[float, float]) -> DataFrame:
    """The same for groups of any size: (g, id) of those that stay.

    Points lie in grid cells about as wide as they must be apart. Each round takes the first open point of every cell and holds it against
    the open points of the cells around: it stays if none of them that is near comes before it, and then those near it go.
    A round compares each open point with at most nine cells' firsts, so that points piled up in one place cost no pairs of
    all of them, and the first of all is always settled.
    """
    high = apart_km / degree_km[0]
    row = F.floor(F.col("lat") / high)

    def width(r: Column) -> Column:
        """Of the cells of a row, in degrees: no point in it or in a row beside has more degrees to the distance."""
        edge = (F.greatest(F.abs(r), F.abs(r + 1)) + 1) * high
        return apart_km / (degree_km[1] * F.greatest(F.abs(F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(0.1))) * 1.000001

    point = F.struct(*names, "id", "lat", "lng", F.greatest(F.abs(F.cos(F.radians("lat"))), F.lit(0.1)).alias("scale"))
    left = written(typed.withColumn("row", row).withColumn("cell", F.floor(F.col("lng") / width(F.col("row")))).select("g", "row", "cell", point.alias("p")))
    near = lambda a, b, scale: F.hypot((a["lng"] - b["lng"]) * degree_km[1] * scale, (a["lat"] - b["lat"]) * degree_km[0]) < apart_km
    stays = None
    while True:
        firsts = left.groupBy("g", "row", "cell").agg(F.min("p").alias("m"))
        around = firsts.select("g", "m", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"))
        span = [F.floor((F.col("m.lng") + k * width(F.col("row"))) / width(F.col("row"))) for k in (-1, 1)]
        around = around.withColumn("cell", F.explode(F.sequence(*span)))
        p, m = F.col("p"), F.col("m")
        before = p < m
        close = left.join(around, ["g", "row", "cell"]).where(near(p, m, F.when(before, p["scale"]).otherwise(m["scale"])))
        close = written(close.select("g", p["id"].alias("id"), m["id"].alias("first"), before.alias("before")))
        settled = written(close.groupBy("g", "first").agg(F.max("before").alias("waits")).where("not waits").select("g", "first"))
        new = settled.select("g", F.col("first").alias("id"))
        stays = new if stays is None else stays.unionByName(new)
        gone = close.join(settled, ["g", "first"], "left_semi").select(F.col("g"), F.col("id")).distinct()
        rest = left.withColumn("id", F.col("p.id")).join(gone, ["g", "id"], "left_anti").select("g", "row", "cell", "p")
        left = written(rest)
        if left.isEmpty():
            return stays


def first_available(options: DataFrame, group: str, priority: str = "source_rank") -> DataFrame:
    """Rows of each group's first source that has any."""
    return options.withColumn("_m", F.min(priority).over(W.partitionBy(group))).where(F.col(priority) == F.col("_m")).drop("_m")


def coverage(candidates: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """One row: share of the circle that candidates cover, overlaps counted each time."""
    part = candidates.withColumn("_clip", G.clip_to_circle(lat, lng, radius_km)(F.col("ring")))
    area = F.sum(F.when(F.size("_clip") >= 3, G.area_m2(F.col("_clip"))))
    return part.agg((F.coalesce(area, F.lit(0.0)) / (math.pi * (radius_km * 1000) ** 2)).alias("coverage"))


def coverages(candidates: DataFrame, clipped: str | None = None) -> DataFrame:
    """(query_id, coverage) of candidates with their query's circle (query_id, lat, lng, radius_km): the share that they cover, overlaps counted each time. ``clipped``: a column with their parts in the circle, if there is one."""
    part = candidates.withColumn("_clip", F.col(clipped) if clipped else G.clip_to_circle("lat", "lng", "radius_km")(F.col("ring")))
    area = F.when(F.size("_clip") >= 3, G.area_m2(F.col("_clip")))
    return part.groupBy("query_id").agg((F.coalesce(F.sum(area), F.lit(0.0)) / (math.pi * F.pow(F.any_value("radius_km") * 1000, F.lit(2)))).alias("coverage"))


def search_cells(df: DataFrame, radius_km: float | str, limit: int = K.MAX_CELLS) -> DataFrame:
    """Square search cells over the circle of each query (query_id, lat, lng), nearest first: its row, column, cell_lat, cell_lng. The radius is a constant or a column."""
    radius_km = col(radius_km)
    size = F.greatest(F.lit(0.1), radius_km / math.sqrt(limit / math.pi))
    n = F.ceil(radius_km / size).cast("int")
    steps = F.sequence(-n, n)
    grid = df.withColumn("row", F.explode(steps)).withColumn("column", F.explode(steps))
    c = G.offset("lat", "lng", F.col("column") * size, F.col("row") * size)
    grid = grid.withColumn("cell_lat", c["lat"]).withColumn("cell_lng", c["lng"]).withColumn("distance_km", round_up(flat_km("lat", "lng", "cell_lat", "cell_lng"), 9))
    inside = grid.where(F.col("distance_km") <= radius_km + size / 2)
    ranked = inside.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance_km", "row", "column")))
    return ranked.where(F.col("rank") <= limit)


def plausible_field(df: DataFrame) -> DataFrame:
    """df with compactness, hull_ratio, aspect and plausible of its rings or shapes; a shape's compactness is that of its outer rings, as holes don't change a field's outline."""
    shape = shape_of(df)
    df = df.withColumn("_s", F.transform(shape, lambda part: F.slice(part, 1, 1))).withColumn("_c", P.center(F.col("_s")))
    df = df.withColumn("compactness", G.compactness(P.area_m2(F.col("_s"), F.col("_c")), P.perimeter_m(F.col("_s"), F.col("_c"))))
    df = df.withColumn("hull_ratio", P.hull_ratio()(F.col("_s"))).withColumn("aspect", P.aspect_ratio(F.col("_s")))
    ok = F.exists("_s", lambda part: F.size(F.get(part, 0)) >= 3) & (F.col("compactness") >= K.MIN_COMPACTNESS) & (F.col("hull_ratio") >= K.MIN_HULL_RATIO) & (F.col("aspect") <= K.MAX_ASPECT)
    return df.withColumn("plausible", F.coalesce(ok, F.lit(False))).drop("_c", "_s")


def with_results(candidates: DataFrame, results: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates with their analyses; those without one get a message, whether they were beyond the limit or out of time."""
    message = F.when(F.col("rank") > K.MAX_CANDIDATES, "Analyse IA non exécutée pour cette parcelle.").otherwise("Analyse IA non exécutée : délai de recherche automatique dépassé (trop de parcelles candidates).")
    return candidates.join(results, key, "left").withColumn("analysis_error", F.when(F.col("analysis").isNull(), message))
