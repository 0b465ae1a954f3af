"""What the corpus operators share: scratch tables in the shared folder, size-checked joins, word sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.shared import new_folder

#: A side of a join is broadcast only if it has at most so many rows (of a few dozen bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 50_000


#: Rows, and bytes, that go to a Python worker at once: texts may be long, and a worker's memory should not depend on luck.
ROWS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows and bytes of an Arrow batch to ROWS_AT_ONCE and BYTES_AT_ONCE, if more are set. A single row may still be larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """At a Python task's end: returns freed memory to the system, since the process stays and other work may follow in it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def settle(spark: SparkSession) -> None:
    """Between stages of long work: every executor collects its garbage, so that its heap shrinks before Python workers need the memory."""
    tasks = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, numPartitions=tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def shared_files(uri: str):
    """The file system of a folder in the shared one, as tasks use it, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs no long recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = new_folder(spark)
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read again."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def folder(self, name: str) -> str:
        """A folder for files of tasks; dropped like a table."""
        self.names.add(name)
        return self.path(name)

    def drop(self, name: str | None = None) -> None:
        """Deletes one table, or all."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names -= {name} if name else self.names

    def drop_but(self, *names: str) -> None:
        """Deletes all tables but these, once a result stands on these alone."""
        for name in self.names.difference(names):
            self.drop(name)


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Joins with ``small`` broadcast if a count shows that it has at most BROADCAST_ROWS rows, else by shuffle.

    ``small`` should be cheap to count: a scratch table or a literal. AQE splits hot keys of the shuffled form.
    """
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small table of literals, without Python on the executors."""
    def cell(v, t: str) -> Column:
        if isinstance(v, (list, tuple)):
            return (F.array(*[F.lit(x) for x in v]) if v else F.array()).cast(t)
        return F.lit(v).cast(t)

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    if not rows:
        return spark.createDataFrame([], schema)
    items = F.array(*[F.struct(*[cell(v, t).alias(n) for v, n, t in zip(r, names, types, strict=True)]) for r in rows])
    return spark.range(1, numPartitions=1).select(F.explode(items).alias("r")).select("r.*")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add; names match as Spark's resolver does, whatever their case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
