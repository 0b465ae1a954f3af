"""File sources and sinks: GeoJSON, KML, Overpass JSON, GeoParquet, NPY and model artefacts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.functions.text import kml_label
from fieldloom.operators.spatial import bounds_of, box_pairs, circle_box, shape_of, z_order
from fieldloom.sources.shared import written


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of FeatureCollections: (shape, properties..., ord); polygons that cross themselves are repaired, features without one are dropped.

    ``properties`` is the DDL of the properties wanted. ``ord`` grows with a feature's place in its file, and over several files
    with the order of their names, so that the first of equal ids is the same each time. A file is one document, read by one task.
    """
    schema = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>>>"
    # Documents as texts: the JSON source goes back over a document for each text in it, and to number the files it would parse them.
    documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = documents.select("path", F.from_json(F.regexp_replace("value", "^\ufeff", ""), schema)["features"].alias("features"))
    names = documents.select("path").distinct().select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("file"))  # one row a file
    rows = files.join(F.broadcast(names), "path").select("file", F.posexplode("features").alias("pos", "f")).withColumn("ord", F.col("file") * (1 << 32) + F.col("pos"))
    geometry = F.to_json(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")))
    raw = F.concat(F.lit('{"type":"'), F.col("f.geometry.type"), F.lit('","coordinates":'), F.col("f.geometry.coordinates"), F.lit("}"))
    shaped = rows.select(P.of_geojson(F.coalesce(raw, geometry)).alias("shape"), "f.properties.*", "ord").where("shape is not null")
    return shaped.withColumn("shape", P.repaired()(F.col("shape"))).where("shape is not null")


def parse_traced(rows: DataFrame, column: str = "feature") -> DataFrame:
    """Shapes of GeoJSON texts, each a Feature or a bare geometry; those that cross themselves are repaired, what covers nothing is dropped."""
    text = F.col(column)
    shape = P.of_geojson(F.coalesce(F.get_json_object(text, "$.geometry"), text))
    found = rows.withColumn("shape", shape).where("shape is not null")
    return found.withColumn("shape", P.repaired()(F.col("shape"))).where(F.col("shape").isNotNull() & (P.area_deg2(F.col("shape")) > 0))


def to_geojson(df: DataFrame, *properties: str, polygon: str = "ring") -> DataFrame:
    """One text: the FeatureCollection of rows with a polygon, a ring or a shape. The result is one document, so its rows should be a page of features."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), P.to_geojson(shape_of(df, polygon)), F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))
    return df.select(feature.alias("f")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("f")), F.lit("]}")).alias("geojson"))


def read_kml(spark: SparkSession, path: str, row_tag: str = "Placemark") -> DataFrame:
    """Placemarks with a polygon whose colour tells the crop: (name, color, label, ring)."""
    schema = "name string, Style struct<LineStyle:struct<color:string>>, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    marks = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    points = F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+")
    pair = lambda t: G.point(F.get(F.split(t, ","), 1).try_cast("double"), F.get(F.split(t, ","), 0).try_cast("double"))
    color = F.trim("Style.LineStyle.color")
    out = marks.select(F.trim("name").alias("name"), color.alias("color"), kml_label(color).alias("label"), G.normalize(F.transform(points, pair)).alias("ring"))
    return out.where("ring is not null and label is not null")


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Ways of an Overpass answer: (candidate_id, ring, tags); relations and open points are left out."""
    schema = "elements array<struct<type:string,id:long,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).where("e.type = 'way'")
    ring = G.normalize(F.transform("e.geometry", lambda p: G.point(p["lat"], p["lon"])))
    return e.select(F.concat(F.lit("osm-way-"), F.col("e.id").cast("string")).alias("candidate_id"), ring.alias("ring"), F.col("e.tags").alias("tags")).where("ring is not null")


def write_traced(parcels: DataFrame, path: str, rows_a_file: int = 1_000_000, rows_a_group: int = 20_000) -> None:
    """Parcels (ftw_id, confidence, area_ha, ring, which may be a shape) as GeoParquet-like files along a Z-order curve, so that box bounds skip row groups. The number of files follows a count."""
    box = bounds_of(parcels)
    out = parcels.select("ftw_id", "confidence", "area_ha", *[box[k].alias(n) for k, n in zip(("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"), strict=True)], P.to_wkb()(shape_of(parcels)).alias("geometry"))
    out = out.withColumn("_z", z_order((F.col("ymin") + F.col("ymax")) / 2, (F.col("xmin") + F.col("xmax")) / 2))
    files = max(8, -(-parcels.count() // rows_a_file))
    out.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.row.count.limit", rows_a_group).parquet(path)


def read_traced(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index_traced(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of the files that ``write_traced`` wrote: (file, row_group, n_rows, box), the box of each row group from the statistics in its footer. Footers are read by tasks; rows are not."""
    names = spark.read.parquet(path).inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name in batch.column(0).to_pylist():
                with _opened(name) as source:
                    meta = pq.ParquetFile(source).metadata
                    place = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        of = {c: group.column(place[c]).statistics for c in ("xmin", "ymin", "xmax", "ymax")}
                        known = all(s is not None and s.has_min_max for s in of.values())
                        out.append((name, g, group.num_rows, (of["xmin"].min, of["ymin"].min, of["xmax"].max, of["ymax"].max) if known else (-180.0, -90.0, 180.0, 90.0)))
            box = pa.StructArray.from_arrays([pa.array([r[3][k] for r in out], pa.float64()) for k in range(4)], ["x0", "y0", "x1", "y1"])
            columns = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), box]
            yield pa.RecordBatch.from_arrays(columns, ["file", "row_group", "n_rows", "box"])

    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(run, "file string, row_group int, n_rows long, box struct<x0:double,y0:double,x1:double,y1:double>")


def _opened(name: str):
    """A file as tasks open it."""
    from pyarrow import fs

    if name.startswith("file:") and not name.startswith("file://"):
        name = "file://" + name[len("file:") :]
    system, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
    return system.open_input_file(path)


def read_traced_near(spark: SparkSession, path: str, index: DataFrame, circles: DataFrame) -> DataFrame:
    """Traced parcels of the files that may hold some of any of the circles (query_id, lat, lng, radius_m): those with a row group whose box meets a circle's.

    The index meets circles by the cells of a quadtree; names of files reach the driver, as they do in any scan. The box around all circles goes down to the scan.
    """
    box = circle_box("lat", "lng", "radius_m")
    boxed = written(circles.select("query_id", box.alias("circle")))
    hit = [r["file"] for r in box_pairs(index.select("file", "box"), boxed, "box", "circle").select("file").distinct().collect()]
    whole = spark.read.parquet(path)
    if not hit:
        return whole.limit(0)
    all_ = boxed.agg(F.min("circle.x0"), F.min("circle.y0"), F.max("circle.x1"), F.max("circle.y1")).first()
    some = spark.read.schema(whole.schema).parquet(*sorted(hit))
    return some.where((F.col("xmax") >= all_[0]) & (F.col("ymax") >= all_[1]) & (F.col("xmin") <= all_[2]) & (F.col("ymin") <= all_[3]))


def read_registry(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 16, **options: str) -> DataFrame:
    """A registry in a database, read by ranges of a numeric key in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options)
    return reader.load()


def append_log(runs: DataFrame, path: str) -> None:
    """Adds scan runs to the log, a folder of Parquet files by month; a month's runs are spread over tasks by day, so that none writes many small files and a busy month is no single task."""
    dated = runs.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    dated.repartition("month", F.to_date("created_at")).write.mode("append").partitionBy("month").parquet(path)


def footer(path: str) -> dict[str, str]:
    """Key-value metadata in a Parquet file's footer, on whatever file system the path names; one small read on the driver."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return {k.decode(): v.decode() for k, v in (pq.read_schema(name, filesystem=system).metadata or {}).items()}


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """Model artefacts of a folder: (path, size, sha256, content as text)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("body"))


def chosen_threshold(artefacts: DataFrame, default: float) -> DataFrame:
    """(model, threshold): of each folder of artefacts the threshold of its bundle, else that of its selection file (``seuil_retenu``), else the default."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    value = lambda file, key: F.max(F.when(name == file, F.get_json_object("body", f"$.{key}").try_cast("double")))
    return artefacts.groupBy(folder.alias("model")).agg(F.coalesce(value("bundle.json", "threshold"), value("threshold_selection.json", "seuil_retenu"), F.lit(default)).alias("threshold"))


def inventory(artefacts: DataFrame, needed: list[str]) -> DataFrame:
    """(model, n_files, bytes, missing, healthy) of each folder of artefacts: whether it has all files that are needed."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    found = artefacts.groupBy(folder.alias("model")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.collect_set(F.regexp_extract("path", r"([^/]+)$", 1)).alias("names"))
    missing = F.array_except(F.array(*[F.lit(n) for n in needed]), F.col("names"))
    return found.select("model", "n_files", "bytes", F.array_sort(missing).alias("missing"), (F.size(missing) == 0).alias("healthy"))


def check_artefacts(models: DataFrame, n_features: int = 48) -> DataFrame:
    """Errors of model rows (kind, features, threshold)."""
    from fieldloom.operators.registry import validate

    return validate(models, {"kind": F.col("kind") == "RandomForestClassifier", "features": F.size("features") == n_features, "unique": F.size(F.array_distinct("features")) == F.size("features"), "threshold": F.col("threshold").between(0, 1)})
