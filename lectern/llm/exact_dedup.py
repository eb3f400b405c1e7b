"""Exact deduplication with a log-structured merge index of text digests.

Arrivals are flushed as *runs*: Parquet tables whose files are sorted by digest and carry min/max statistics and Bloom
filters on it. Compaction merges the runs of a level into one run of the next level, one row per digest with the
identifier to keep (the smallest by default) and the number of copies. ``lookup`` asks for given digests: Parquet then skips
the row groups whose statistics or filter rule all of them out. Where every document is looked up, as in ``exact_dedup``, no
row group could be skipped; that is an equi-join with the index, narrowed to the digests of several rows. Every hit is then
verified byte by byte against the text of the document that stays, so equal digests alone never drop a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, free_name, scratch_path

#: Up to so many rows that take part in a comparison are broadcast to the scan of the texts (about 25 MB); more are joined.
BROADCAST_ROWS = 1 << 18
#: Copies compared with one replica of the kept text; a hot group gets one replica for each such slice.
COPIES_PER_REPLICA = 256
#: Batches of arrivals; each is aggregated in memory and flushed as one sorted run, and as many runs are merged.
MEMTABLES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII texts take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


class DigestIndex:
    """Runs of (digest, keep_id, copies) below one shared folder, by level."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min", fanout: int = 4):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.keep, self.fanout = spark, keep, fanout
        self.path = path or scratch_path(spark, "digest-index")
        self.levels: list[list[str]] = [[]]
        self.flushed = 0

    def _merge(self, rows: DataFrame) -> DataFrame:
        pick = F.min if self.keep == "min" else F.max
        return rows.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def _write(self, rows: DataFrame, level: int) -> str:
        self.flushed += 1
        path = f"{self.path}/level={level}/run-{self.flushed:06d}"
        (rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true")
         .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))
        return path

    def flush(self, arrivals: DataFrame) -> None:
        """``arrivals`` (digest binary, id): aggregated in memory per task and key, sorted, written as one run."""
        self.levels[0].append(self._write(self._merge(arrivals.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))), 0))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge all runs of ``level`` into one run of the next; readers of the old runs keep their files."""
        runs = self.levels[level]
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(self._merge(self.spark.read.parquet(*runs)), level + 1))
        self.levels[level] = []

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """(digest, keep_id, copies) of those of some ``digests`` that the index holds."""
        return self._merge(self._runs().where(F.col("digest").isin(digests)))

    def _runs(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        rows = self.spark.read.schema("digest binary, keep_id long, copies long")
        return rows.parquet(*runs) if runs else self.spark.createDataFrame([], "digest binary, keep_id long, copies long")

    def table(self) -> DataFrame:
        """One row per digest over all runs; a single run needs no merge."""
        return self._runs() if sum(map(len, self.levels)) == 1 else self._merge(self._runs())


def text_key(text: Column) -> Column:
    """Tells the texts of rows that repeat an id apart."""
    return F.xxhash64(text, F.lit(29))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=sha256_digest, index: DigestIndex | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    smallest (``keep='min'``) or largest id stays. Rows that repeat an id and a text are one document counted as often as it
    occurs, and each row comes back; rows that repeat an id with other texts go with the groups of their own texts. A null
    id is never dropped: it stands for itself with group_size 1. Other columns are ignored. An empty table gives no rows.
    """
    found = _grouped(docs, id_col, text_col, keep, digest, index)
    alone = F.col("id").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(~alone, F.col("keep")).alias("keep_id"), F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("group_size"),
        (alone | (F.col("keep") == F.col("id"))).alias("kept"), F.col("sha").alias("text_sha256"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, digest, index: DigestIndex | None) -> DataFrame:
    """(id, key, sha, keep, size) of every row, where key tells apart the texts of an id that repeats."""
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("raw"))
    norm = normalised(F.col("raw"))
    rows = durable(raw.select("id", text_key(F.col("raw")).alias("key"), F.sha2(norm.cast("binary"), 256).alias("sha"), digest(norm).alias("digest")), "digests")
    index = index or DigestIndex(spark, keep=keep)
    for batch in range(MEMTABLES):
        index.flush(rows.where("id is not null").where(F.pmod(F.xxhash64("id"), F.lit(MEMTABLES)) == batch).select("digest", "id"))
    found = rows.join(index.table().where("copies > 1"), "digest", "left")

    copies = found.where("copies > 1 and keep_id <> id").select("id", "digest", "keep_id", F.ceil(F.col("copies") / COPIES_PER_REPLICA).cast("int").alias("replicas")).distinct()
    keepers = copies.groupBy("keep_id", "digest").agg(F.max("replicas").alias("replicas")).select(F.col("keep_id").alias("id"), "digest", F.lit(None).cast("long").alias("keep_id"), "replicas")
    # every text that takes part crosses once by its id, spread evenly; only those then meet the text that stays
    part = durable(copies.unionByName(keepers), "compared")
    texts = raw.join(F.broadcast(part) if part.count() <= BROADCAST_ROWS else part, "id").withColumn("norm", norm)
    texts = texts.where(F.coalesce(digest(F.col("norm")) == F.col("digest"), F.lit(False)))  # no join key, so that only these texts are digested again
    left = texts.where("keep_id is not null").select("digest", F.pmod(F.xxhash64("id"), F.col("replicas")).cast("int").alias("slice"), "norm")
    right = texts.where("keep_id is null").select("digest", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)).alias("slice"), F.col("norm").alias("kept_norm"))
    wrong = durable(left.join(right, ["digest", "slice"]).where("norm <> kept_norm").select("digest").distinct(), "collisions")

    if not wrong.isEmpty():  # different texts under one digest: their groups are formed by the texts themselves
        ids = rows.join(wrong, "digest", "left_semi").where("id is not null").select("id").distinct()
        apart = raw.join(ids, "id", "left_semi").select("id", text_key(F.col("raw")).alias("key"), norm.alias("norm"))
        apart = apart.join(wrong, digest(F.col("norm")) == wrong["digest"], "left_semi")
        pick = F.min if keep == "min" else F.max
        true = apart.join(apart.groupBy("norm").agg(pick("id").alias("true_keep"), F.count("*").alias("true_copies")), "norm")
        found = found.join(true.select("id", "key", "true_keep", "true_copies").distinct(), ["id", "key"], "left")
    else:
        found = found.withColumns({"true_keep": F.lit(None).cast("long"), "true_copies": F.lit(None).cast("long")})
    return found.select("id", "key", "sha", F.coalesce("true_keep", "keep_id", "id").alias("keep"), F.coalesce("true_copies", "copies", F.lit(1)).alias("size"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of ``docs`` for each text, with its columns; all rows of a null id.

    A row goes for its own text: what else is stored under its id stays. Of rows that repeat the id that stays with an equal
    text, any one stays.
    """
    gone_id, gone_key = free_name(docs.columns, "drop_id"), free_name(docs.columns, "drop_key")
    copied = durable(_grouped(docs, id_col, text_col, keep, sha256_digest, None).where("id is not null and size > 1"), "copied")
    gone = durable(copied.where("keep <> id").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "dropped")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, (docs[id_col] == gone[gone_id]) & (text_key(docs[text_col]) == gone[gone_key]), "left_anti")
    repeated = durable(copied.where("keep = id").groupBy("id", "sha").count().where("count > 1").select(F.col("id").alias(gone_id)).distinct(), "repeated-rows")
    if repeated.isEmpty():
        return kept
    same = kept[id_col] == repeated[gone_id]
    text = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    single = kept.join(repeated, same, "left_semi").withColumn(gone_key, text).dropDuplicates([id_col, gone_key]).drop(gone_key)
    return kept.join(repeated, same, "left_anti").unionByName(single)
