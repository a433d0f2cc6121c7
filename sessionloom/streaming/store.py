"""Stored events and live sessions, by hash bucket of the session.

A micro-batch writes its events to the partitions (bucket, batch) and replaces
what an earlier try of the same batch has left there.  Sessions are assembled
again for the buckets that a batch touches, from a read of these buckets'
folders alone, and their partitions are replaced as a whole, so that the work of
a batch follows the buckets it touches and a repeated batch changes nothing.
Many small batches of a bucket are put together by ``compact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assemble import assemble

#: Sessions are dealt to so many buckets; a list of them is small enough for the driver.
BUCKETS = 256


class SessionStore:
    """Below ``folder``: ``events`` by (bucket, batch), and one table by bucket for each result."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets

    def bucket(self, session: str = "session_id") -> Column:
        return F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("int")

    def _replace(self, rows: DataFrame, table: str, *keys: str) -> None:
        """Writes the partitions that ``rows`` has, and leaves the others."""
        rows.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.folder}/{table}")

    def add(self, batch: DataFrame, number: int) -> list[int]:
        """Stores a micro-batch; gives the buckets it touches."""
        rows = batch.withColumn("bucket", self.bucket())
        self._replace(rows.repartition("bucket").withColumn("batch", F.lit(number).cast("long")), "events", "bucket", "batch")
        root, files = self._events()
        return [b for b in range(self.buckets) if files.exists(root.suffix(f"/bucket={b}/batch={number}"))]  # as stored: the batch isn't read again

    def _events(self) -> tuple:
        """The folder of events, and the file system it is on."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/events")
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, buckets: list[int] | None) -> list[str]:
        """The folders of some buckets that are there."""
        root, files = self._events()
        there = {p.getPath().getName() for p in files.listStatus(root)} if files.exists(root) else set()
        wanted = [f"bucket={b}" for b in (range(self.buckets) if buckets is None else buckets)]
        return [f"{self.folder}/events/{w}" for w in wanted if w in there]

    def events(self, buckets: list[int] | None = None) -> DataFrame:
        """The stored events, of some buckets only if they are given: no other folder is listed or read."""
        folders = self._folders(buckets)
        schema = f"{self.schema}, bucket int, batch long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/events").parquet(*folders)

    def sessions_of(self, buckets: list[int], table: str = "steps") -> DataFrame:
        """The sessions of these buckets, assembled by the plan that batches have; one of the tables it makes."""
        made = getattr(assemble(self.events(buckets).drop("bucket", "batch")), table)
        return made.withColumn("bucket", self.bucket())

    def writer(self, tables: tuple[str, ...] = ("steps",)) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that stores a batch and replaces the results of the buckets it touches."""
        def each(batch: DataFrame, number: int) -> None:
            touched = self.add(batch, number)
            for table in tables if touched else ():
                self._replace(self.sessions_of(touched, table).repartition("bucket"), table, "bucket")
        return each

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}").drop("bucket")

    def compact(self, into: str) -> SessionStore:
        """The same events in another folder, one file a bucket, as batch -1; its results are made again by the next batches or by ``rebuild``."""
        out = SessionStore(self.spark, into, self.schema, self.buckets)
        out._replace(self.events().drop("batch").repartition(self.buckets, "bucket").withColumn("batch", F.lit(-1).cast("long")), "events", "bucket", "batch")
        return out

    def rebuild(self, tables: tuple[str, ...] = ("steps",)) -> None:
        """Results of all buckets, from the stored events."""
        for table in tables:
            self._replace(self.sessions_of(list(range(self.buckets)), table).repartition("bucket"), table, "bucket")
