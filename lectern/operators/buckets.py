"""Tables in buckets of a key, of which an upsert rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

BUCKET = "_bucket"
#: Touched buckets are listed by the driver, so a table has no more than so many.
MOST_BUCKETS = 1 << 16


class BucketTable:
    """Parquet at ``path``, partitioned by a hash of ``keys``: rows of equal keys lie in one bucket.

    A merge reads the buckets that its changes fall into, and replaces these folders (dynamic partition overwrite): what it
    reads and writes follows the changes, not the table. New files are staged and moved in at the job's commit. One
    writer at a time; a reader that began before a commit may have to begin again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64):
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _exists(self) -> bool:
        return self.fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.fs_path)

    def of(self):
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _write(self, rows: DataFrame, touched: int) -> None:
        dealt = rows.select(self.schema.names).withColumn(BUCKET, self.of()).repartition(max(1, touched), BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> BucketTable:
        self._write(rows, self.buckets)
        return self

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """``apply(rows, changes)`` on the buckets that hold the keys of ``changes``; returns how many were rewritten.

        ``apply`` may add and change rows but keeps a row's keys, and drops none to emptiness: a bucket without rows stays as it was.
        """
        touched = [r[0] for r in changes.select(self.of().alias("b")).distinct().collect()]
        if touched:
            self._write(apply(self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET), changes), len(touched))
        return len(touched)


class Counters:
    """Ids for new rows by bucket: bucket ``b`` of n gives b + 1, b + 1 + n, b + 1 + 2 n, ... from a stored number of ids given.

    Buckets count by themselves, so ids need no pass over the table. What is taken is counted before it is used: a merge that
    fails in between leaves a gap, never an id twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.table = BucketTable(spark, path, "bucket int, given long", ["bucket"], buckets)
        self.buckets = buckets

    def give(self, rows: DataFrame, bucket, order: list[str]) -> DataFrame:
        """``rows`` with an ``id`` each, numbered within their ``bucket`` by ``order``; counts them as given."""
        # read into the driver, a row a bucket: the table is about to be rewritten
        have = {r["bucket"]: r["given"] for r in self.table.read().collect()}
        start = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in have.items() for x in pair]), F.col("_b")), F.lit(0)) if have else F.lit(0)
        placed = rows.withColumn("_b", bucket)
        counts = placed.groupBy(F.col("_b").alias("bucket")).agg(F.count("*").alias("more"))
        add = lambda old, new: old.join(new, "bucket", "full").select("bucket", (F.coalesce("given", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("given"))
        self.table.merge(counts, add)
        n = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
        return placed.withColumn("id", (F.col("_b") + 1 + (start + n) * self.buckets).cast("long")).drop("_b")


SOURCE_KEY = ["source_type", "source_key"]


def merge_sources(table: BucketTable, counters: Counters, new: DataFrame) -> int:
    """``store.upsert_sources`` into a bucketed table of sources; sources that are new get their ids from ``counters``."""

    def apply(have: DataFrame, new: DataFrame) -> DataFrame:
        out, known = store.upsert_sources(have, new), have.select(SOURCE_KEY)
        fresh = counters.give(out.join(known, SOURCE_KEY, "left_anti").drop("id"), table.of(), SOURCE_KEY)
        return out.join(known, SOURCE_KEY, "left_semi").unionByName(fresh)

    return table.merge(new, apply)


def merge_names(table: BucketTable, new: DataFrame) -> int:
    """``store.upsert_names`` into a bucketed table of speaker names."""
    return table.merge(new, store.upsert_names)


def merge_fields(table: BucketTable, updates: DataFrame, fields: list[str], **how) -> int:
    """``store.update_fields`` in a bucketed table."""
    return table.merge(updates, lambda rows, u: store.update_fields(rows, u, fields, table.keys[0], **how))
