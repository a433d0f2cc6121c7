"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts of a batch that a worker holds as Python strings at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it isn't set, a session inside one machine (a local master) gets a
    temporary folder; on a cluster that is an error, as each machine would write
    to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows while actions run inside: bounds what a Python worker holds of wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables that this process has written to the shared folder, by their path.
_settled: dict[str, DataFrame] = {}


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is written inside go when it ends, and don't wait for the driver to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    Results that were made of it read it again, so it stays until ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        df.write.parquet(path)
    _settled[path] = table = spark.read.schema(df.schema).parquet(path)
    return table


def release(spark: SparkSession, *tables: DataFrame) -> int:
    """Delete what ``settle`` has written (or just these of its tables), once the results made of it are stored; gives the number of tables."""
    gone = [path for path, df in _settled.items() if not tables or any(df is t for t in tables)]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _settled[name]
    return len(gone)


def text_udf(schema: str, row_fn, start=None):
    """An Arrow UDF from one text to a struct.

    ``row_fn`` maps a str (or None) to a tuple in the order of ``schema``;
    ``start``, if given, is called in the worker and its result is passed as
    second argument, so that heavy state is made there and kept between batches.
    """
    struct = pa_struct(schema)
    names = [f.name for f in struct]

    def some(texts: pa.Array, state) -> pa.Array:
        rows = [row_fn(t, state) if start else row_fn(t) for t in texts.to_pylist()]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, struct)], names=names)

    def run(texts: pa.Array) -> pa.Array:
        state = start() if start else None
        out = pa.concat_arrays([some(texts.slice(i, SLICE), state) for i in range(0, max(1, len(texts)), SLICE)])
        pa.default_memory_pool().release_unused()
        return out

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<{schema}>")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
          "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def pa_struct(schema: str) -> list[pa.Field]:
    """Arrow fields of a flat ``name:type,...`` schema."""
    return [pa.field(n.strip(), _TYPES[t.strip()]) for n, t in (x.split(":") for x in schema.split(","))]


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str, rows_per_task: int = 200_000, rows: int | None = None) -> DataFrame:
    """Number the rows of each ``keys`` group from 0, gapless, in a fixed order, without one task for a group.

    Rows are dealt by (keys, hash bucket); a window numbers each bucket, and the
    counts of the buckets, summed up beside it, give where each bucket starts.
    The order is by bucket, then by ``order``; ties there get distinct numbers.
    ``rows`` is the number of rows, if it is known.
    """
    from pyspark.sql import Window as W

    n = df.count() if rows is None else rows
    buckets = max(1, -(-n // rows_per_task)) * 16
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (df.withColumn("_at", F.row_number().over(within) - 1)
            .join(starts, [*keys, "_bucket"])
            .withColumn(name, F.col("_start") + F.col("_at"))
            .drop("_bucket", "_at", "_start"))
