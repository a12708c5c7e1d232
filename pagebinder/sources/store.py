"""A table by key in the shared storage, of which a write replaces only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import sessions as ss


class KeyedStore:
    """Rows with unique keys, last write wins. Keys are dealt by hash to `buckets` folders. Batch n writes the buckets that it touches, whole, to
    data/batch=n, then their list to ledger/batch=n, which makes it count: a bucket's rows are those of the last batch that lists it. A batch
    that counts already is left out, one that broke off before its ledger is written again, so replays are harmless. Numbers of batches
    rise; a store has one writer at a time. Null keys are equal to each other. vacuum() removes what later batches replaced."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _batches(self, pattern: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/{pattern}"))
        return sorted(int(str(s.getPath()).split("batch=")[1].split("/")[0]) for s in found or [])

    def committed(self) -> list[int]:
        return self._batches("ledger/batch=*/_SUCCESS")

    def _current(self) -> dict[int, int]:
        """The batch of each bucket."""
        paths = [f"{self.path}/ledger/batch={n}" for n in self.committed()]
        if not paths:
            return {}
        ledger = self.spark.read.schema("batch long, buckets array<int>").json(paths).select("batch", F.explode("buckets").alias("b"))
        return {r.b: r.n for r in ledger.groupBy("b").agg(F.max("batch").alias("n")).collect()}  # a row per bucket

    def read(self, schema: StructType, only: list[int] | None = None) -> DataFrame:
        """The rows, with these columns; of some buckets only."""
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(self._current().items()) if only is None or b in only]
        paths = [p for p in paths if self._exists(p)]  # a bucket may have become empty
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, touched: list[int], number: int) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        self.spark.createDataFrame([(number, touched)], "batch long, buckets array<int>").coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/batch={number}")

    def upsert(self, rows: DataFrame, number: int, order: list[Column]) -> list[int]:
        """Rows replace those of equal keys; of several with one key the first in `order` does. The buckets that were written. The rows are
        computed once: they are staged before the buckets are known."""
        if number in self.committed():
            return []
        staging = f"{self.path}/staging/batch={number}"
        ss.latest(rows, self.keys, order).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(staging)
        new = self.spark.read.schema(StructType([*rows.schema.fields, StructField("bucket", IntegerType())])).parquet(staging)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
        both = self.read(rows.schema, touched).withColumn("_new", F.lit(0)).unionByName(new.drop("bucket").withColumn("_new", F.lit(1)))
        self._commit(ss.latest(both, self.keys, [F.desc("_new")]).drop("_new"), touched, number)
        self._fs.delete(self._path(staging), True)
        return touched

    def purge(self, schema: StructType, expired: Column, number: int) -> list[int]:
        """Rows of which `expired` is true go. The buckets that were written: those without such rows stay as they are."""
        if number in self.committed():
            return []
        touched = [r.b for r in self.read(schema).where(expired).select(self._bucket().alias("b")).distinct().collect()]
        self._commit(self.read(schema, touched).where(~F.coalesce(expired, F.lit(False))), touched, number)
        return touched

    def vacuum(self) -> None:
        """Removes folders that no reader needs from now on."""
        current = self._current()
        for n in self._batches("data/batch=*"):
            for b in range(self.buckets):
                path = f"{self.path}/data/batch={n}/bucket={b}"
                if current.get(b) != n and n in self.committed() and self._exists(path):
                    self._fs.delete(self._path(path), True)
