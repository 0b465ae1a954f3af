"""NPY rasters as a Spark data source: ``spark.read.format("npy")``, and a writer of one file a raster."""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, band string, row int, col int, value double"
#: Bytes of a raster that one task reads, about.
STRIPE = 32 << 20
_FIELDS = [("path", pa.string()), ("band", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64())]


def _files(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(source) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, column by column, type of values, where values begin) of an open NPY file."""
    version = np.lib.format.read_magic(source)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"NPY version {version} is not read")
    shape, fortran, dtype = read(source)
    if dtype.hasobject:
        raise ValueError("NPY files of objects are not read")
    return shape, fortran, dtype, source.tell()


class Stripe(InputPartition):
    """Rows [low, high) of a raster."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class NpyReader(DataSourceReader):
    """Rows of pixels. A file is cut into stripes of whole rows, which tasks read by their place in the file; of values that hold several bands only the wanted ones are unpacked."""

    def __init__(self, path: str, bands: list[str] | None):
        self.path, self.bands = path, bands

    def _paths(self) -> list[str]:
        from pyarrow import fs

        system, base = _files(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [self.path]
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted(self.path.rstrip("/") + f.path[len(base.rstrip("/")) :] for f in found if f.is_file and f.path.endswith(".npy") and not posixpath.basename(f.path).startswith(("_", ".")))

    def partitions(self) -> list[Stripe]:
        out = []
        for path in self._paths():
            system, name = _files(path)
            with system.open_input_file(name) as source:
                shape, fortran, dtype, _ = _header(source)
            rows, width = (1, shape[0]) if len(shape) == 1 else (shape[0], int(np.prod(shape[1:]))) if shape else (1, 1)
            step = rows if fortran else max(1, STRIPE // max(1, width * dtype.itemsize))  # column by column, a file can't be cut by rows
            out += [Stripe(path, low, min(rows, low + step)) for low in range(0, rows, max(step, 1))]
        return out

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        system, name = _files(partition.path)
        with system.open_input_file(name) as source:
            shape, fortran, dtype, begin = _header(source)
            width = shape[0] if len(shape) == 1 else int(np.prod(shape[1:])) if shape else 1
            rows = partition.high - partition.low
            source.seek(begin + (0 if fortran else partition.low * width * dtype.itemsize))
            raw = source.read(rows * width * dtype.itemsize)
        data = np.frombuffer(raw, dtype)
        data = data.reshape(width, rows).T if fortran else data.reshape(rows, width)
        row = np.repeat(np.arange(partition.low, partition.high, dtype=np.int32), width)
        col = np.tile(np.arange(width, dtype=np.int32), rows)
        for band in dtype.names or ("value",):
            if self.bands is not None and band not in self.bands:
                continue
            v = np.asarray(data[band] if dtype.names else data, np.float64).ravel()
            columns = [pa.array([partition.path] * len(v)), pa.array([band] * len(v)), pa.array(row), pa.array(col), pa.array(v, mask=~np.isfinite(v))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_FIELDS))


class NpySource(DataSource):
    """NPY files of a path or a folder, with plain or structured values, in long form. ``bands``: names to read, by commas; plain values are the band "value". Values that aren't finite are null."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        bands = self.options.get("bands")
        return NpyReader(self.options["path"], [b.strip() for b in bands.split(",")] if bands else None)


def read_rasters(spark: SparkSession, path: str, *bands: str) -> DataFrame:
    """Pixels (path, band, row, col, value) of NPY files, of some bands or all."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy")
    return (reader.option("bands", ",".join(bands)) if bands else reader).load(path)


def write_rasters(pixels: DataFrame, path: str, key: str, *bands: str) -> DataFrame:
    """Writes each raster (key, row, col, bands) as a structured NPY file of the folder, named by its key; (key, path, height, width) of each. Missing pixels are NaN. A raster is one task's work.

    A file appears under its name at once, when it is whole, so a task that runs again leaves no half of it.
    """

    def run(table: pa.Table) -> pa.Table:
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        data = np.full((int(row.max()) + 1, int(col.max()) + 1), np.nan, [(b, "<f4") for b in bands]) if bands else None
        for b in bands:
            data[b][row, col] = table[b].to_numpy(zero_copy_only=False)
        buffer = io.BytesIO()
        np.save(buffer, data, allow_pickle=False)
        name = f"{path.rstrip('/')}/{table[key][0].as_py()}.npy"
        system, inner = _files(name)
        system.create_dir(posixpath.dirname(inner), recursive=True)
        with system.open_output_stream(inner + ".part") as out:
            out.write(buffer.getvalue())
        system.move(inner + ".part", inner)
        return pa.table({key: table[key].slice(0, 1), "path": [name], "height": pa.array([data.shape[0]], pa.int32()), "width": pa.array([data.shape[1]], pa.int32())})

    schema = StructType([pixels.schema[key], *StructType.fromDDL("path string, height int, width int").fields])
    typed = pixels.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(b).cast("double").alias(b) for b in bands])
    return typed.groupBy(key).applyInArrow(run, schema)
