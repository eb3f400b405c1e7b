"""Immutable shards with size-tiered compaction and a versioned manifest.

An append writes its shards as one *run*, a folder of Parquet files; compaction merges runs of about one size into a run of
files of the target size. A version is a manifest table (one row a shard) plus a small pointer file, which names the
runs; creating it commits the version: readers see the old or the new one whole. Runs are never changed; old ones go when no
kept version names them. Tiers keep the runs below the target few (``fanout`` a tier), so the driver handles the names
of runs, never those of shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
#: So many runs of a tier are merged; a tier holds runs within this factor of size, from ``BASE_BYTES`` up.
FANOUT, BASE_BYTES = 4, 1 << 20
#: A pointer that stays empty for so many seconds is of a writer that died between creating and filling it.
DEAD_SECONDS = 60.0
#: A table that arrives at once is taken as so many arrivals, and cut into so many files of the target size at least, none larger than ``TARGET_BYTES`` nor, as far as possible, smaller than ``LEAST_BYTES``.
ARRIVALS, LEAST_FILES, LEAST_BYTES = 8, 3, 1 << 17


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        if fanout < 2 or target_bytes < 1:
            raise ValueError("fanout is 2 or more, target_bytes positive")
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        """Committed versions; a pointer without content is one whose writer is at work or has died."""
        return [v for v, size in self._pointers() if size]

    def _pointers(self) -> list[tuple[int, int]]:
        folder = self._path(f"{self.root}/versions")
        if not self.fs.exists(folder):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(folder)]
        return sorted((int(n), size) for n, size in found if n.isdigit())

    def _pointer(self, version: int) -> dict:
        lines = self.spark.read.text(f"{self.root}/versions/{version:010d}").collect()
        return json.loads("".join(r[0] for r in lines))

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(path, rows, bytes, min_id, max_id, run) of the shards of a version, by default the last; None without any."""
        found = self.versions()
        if not found:
            return None
        return self.spark.read.parquet(self._pointer(found[-1] if version is None else version)["manifest"])

    def _commit(self, entries: DataFrame, schema: StructType, base: int, runs: list[dict]) -> int:
        """Write the manifest, then publish it by creating its pointer, which fails if another writer was first."""
        version = base + 1
        path = f"{self.root}/manifests/{version:010d}-{uuid.uuid4().hex}"
        entries.write.parquet(path)
        body = bytearray(json.dumps({"manifest": path, "runs": runs, "schema": json.loads(schema.json())}).encode())
        pointer = self._path(f"{self.root}/versions/{version:010d}")
        try:
            out = self.fs.create(pointer, False)
        except Py4JJavaError as e:
            if not self._dead(pointer):
                raise RuntimeError(f"version {version} was committed by another writer") from e
            self.fs.delete(pointer, False)
            out = self.fs.create(pointer, False)
        out.write(body)
        out.close()
        return version

    def _dead(self, pointer) -> bool:
        """Whether the writer of a pointer died before it filled it: others take its version over."""
        if not self.fs.exists(pointer):
            return False
        found = self.fs.getFileStatus(pointer)
        return found.getLen() == 0 and time.time() - found.getModificationTime() / 1000 >= DEAD_SECONDS

    def _entries(self, folder: str, schema: StructType, id_col: str) -> DataFrame:
        """One row for each shard file of ``folder`` that has rows, with the run it is in."""
        meta = F.col("_metadata")
        rows = self.spark.read.schema(schema).parquet(folder).groupBy(meta.file_path.alias("path")).agg(
            F.count("*").alias("rows"), F.max(meta.file_size).alias("bytes"), F.min(id_col).cast("long").alias("min_id"), F.max(id_col).cast("long").alias("max_id"))
        return rows.withColumn("run", F.lit(folder))

    def _run(self, folder: str, entries: DataFrame, least_tier: int = 0) -> list[dict]:
        """What the pointer says of a run: its size and tier; nothing of a run without rows."""
        size, shards = entries.agg(F.sum("bytes"), F.count("*")).first()
        if not shards:
            return []
        tier = max(least_tier, int(math.log(max(size / BASE_BYTES, 1), self.fanout) + 1e-9))
        return [{"path": folder, "bytes": size, "shards": shards, "tier": tier}]

    def append(self, docs: DataFrame, id_col: str = "doc_id") -> int:
        """Write ``docs`` as the shards of a new run, one for each of its partitions, and commit; returns the version."""
        found = self.versions()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        docs.write.parquet(folder)
        new, old = self._entries(folder, docs.schema, id_col), self.manifest()
        runs = self._pointer(found[-1])["runs"] if found else []
        return self._commit(new if old is None else old.unionByName(new), docs.schema, found[-1] if found else 0, runs + self._run(folder, new))

    def compact(self, id_col: str = "doc_id") -> list[dict]:
        """Merge tier by tier until none has ``fanout`` runs of shards below the target; each round commits a version.

        Runs whose shards are of half the target or more on average are done. Returns for each merge the version that it
        committed, the tier, and how many runs and shards went in and came out; a store without a version stays so.
        """
        merges: list[dict] = []
        while True:
            found = self.versions()
            if not found:
                return merges
            pointer = self._pointer(found[-1])
            schema = StructType.fromJson(pointer["schema"])
            tiers: dict[int, list[dict]] = {}
            for run in pointer["runs"]:
                if run["bytes"] / run["shards"] < self.target / 2:
                    tiers.setdefault(run["tier"], []).append(run)
            due = min((t for t, runs in tiers.items() if len(runs) >= self.fanout or len(runs) > 1 and sum(r["bytes"] for r in runs) >= self.target), default=None)
            if due is None:
                return merges
            merged = [r["path"] for r in tiers[due]]
            files = max(1, -(-sum(r["bytes"] for r in tiers[due]) // self.target))
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*merged).coalesce(files).write.parquet(folder)
            new = self._entries(folder, schema, id_col)
            kept = self.manifest(found[-1]).where(~F.col("run").isin(merged))
            # a merged run counts as one tier up at least, so every round makes progress
            made = self._run(folder, new, due + 1)
            runs = [r for r in pointer["runs"] if r["path"] not in merged] + made
            version = self._commit(kept.unionByName(new), schema, found[-1], runs)
            merges.append({"version": version, "tier": due, "runs_in": len(merged), "shards_in": sum(r["shards"] for r in tiers[due]), "shards_out": sum(r["shards"] for r in made)})

    def read(self, version: int | None = None) -> DataFrame | None:
        """The documents of a version, by default the last; None without any."""
        found = self.versions()
        if not found:
            return None
        pointer = self._pointer(found[-1] if version is None else version)
        schema = StructType.fromJson(pointer["schema"])
        paths = [r["path"] for r in pointer["runs"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete the runs that no kept version names; returns how many.

        To be run while nobody commits: pointers that dead writers left empty go as well.
        """
        for v, size in self._pointers():
            if not size:
                self.fs.delete(self._path(f"{self.root}/versions/{v:010d}"), False)
        found = self.versions()
        kept, old = found[-keep:], found[:-keep]
        runs = lambda versions: {r["path"] for v in versions for r in self._pointer(v)["runs"]}
        gone = runs(old) - runs(kept)
        for v in old:
            self.fs.delete(self._path(f"{self.root}/versions/{v:010d}"), False)
        for path in gone:
            self.fs.delete(self._path(path), True)
        return len(gone)


def shard_table(docs: DataFrame, root: str, arrivals: int = ARRIVALS, target_bytes: int | None = None, id_col: str = "doc_id") -> tuple[ShardStore, list[dict]]:
    """A store of ``docs``, which come in ``arrivals`` appends (by a hash of the id), and the merges it took.

    Compaction follows each append and frees what it replaced. Without ``target_bytes`` the target follows from the size of
    the first arrival. Every row is stored once, whatever it holds; null ids come first.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes or TARGET_BYTES)
    part = F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(arrivals)), F.lit(0))
    merges: list[dict] = []
    for k in range(arrivals):
        version = store.append(docs.where(part == k), id_col)
        if k == 0 and not target_bytes:
            size = arrivals * sum(r["bytes"] for r in store._pointer(version)["runs"])
            store.target = min(TARGET_BYTES, max(LEAST_BYTES, size // LEAST_FILES))
        merges += store.compact(id_col)
        store.vacuum()
    return store, merges


def placements(store: ShardStore, merges: list[dict] | None = None, id_col: str = "doc_id") -> DataFrame | None:
    """For each stored document its shard (named by its smallest id), the shard's rows, bytes and tier, the version, and of how many ``merges`` and merged shards it is the result; None without one."""
    found = store.versions()
    if not found:
        return None
    merges = merges or []
    docs, runs = store.read(found[-1]), store._pointer(found[-1])["runs"]
    tiers = store.spark.createDataFrame([(r["path"], r["tier"]) for r in runs], "run string, tier int")
    info = store.manifest(found[-1]).join(F.broadcast(tiers), "run").select("path", F.col("min_id").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier")
    state = [F.lit(found[-1]).alias("version"), F.lit(len(runs)).alias("runs"), F.lit(len(merges)).alias("merges"), F.lit(sum(m["shards_in"] for m in merges)).cast("long").alias("merged_shards")]
    if not runs:  # an empty table has no shards
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in info.schema.fields if f.name != "path"]
        return docs.select(id_col, *none, *state)
    return docs.select(id_col, F.col("_metadata.file_path").alias("path")).join(info, "path").drop("path").select("*", *state)
