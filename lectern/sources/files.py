"""Files of any store that Arrow reaches, read by tasks in blocks: digests and headers of media without a file in memory."""

from __future__ import annotations

import hashlib
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import MAX_CHUNKS, is_media, wav_format

#: Fixed value: media are digested in blocks of this size.
BLOCK = 64 * 1024
#: Other names of the stores that Arrow knows; a path without a scheme is local.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that holds ``uri`` and the path there; a scheme that tasks could not reach is an error."""
    scheme, _, rest = uri.partition(":") if ":/" in uri else ("", "", uri)
    if scheme not in SCHEMES:
        raise ValueError(f"no task can open {scheme}: addresses")
    known = SCHEMES[scheme]
    if known == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return fs.FileSystem.from_uri(f"{known}:{rest}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors see it, below ``spark.checkpoint.dir``; only a local session may do without that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"


def listed(spark: SparkSession, path: str, media: bool = True) -> DataFrame:
    """(path, length) of the files below ``path``, media only if so asked; no content is read. Spark's listing leaves empty files out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.where(is_media("path")) if media else found


def digest_of(file) -> str:
    """SHA-256 of an open file, block by block."""
    digest = hashlib.sha256()
    while block := file.read(BLOCK):
        digest.update(block)
    return digest.hexdigest()


def header_bytes(file) -> bytes:
    """The start of a WAVE file with the bodies of chunks before ``fmt `` left out: all that its format depends on.

    Bodies are passed over, so however large they are a few hundred bytes are read.
    """
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return head
    for _ in range(MAX_CHUNKS):
        chunk = file.read(8)
        if len(chunk) < 8:
            break
        kind, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if kind == b"fmt ":
            return head + chunk + file.read(min(size, 64))
        file.seek(file.tell() + size + size % 2)
    return head


def _each_file(files: DataFrame, work: Callable, names: list[str], columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """``files`` (path, ...) with what ``work`` returns of each opened file, and an error in place of it where that fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                try:
                    store, path = store_of(uri)
                    with store.open_input_file(path) as file:
                        rows.append((*work(file), None))
                except OSError as e:
                    rows.append((*[None] * len(names), f"Cannot read {uri}: {type(e).__name__}"))
            new = [pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.string()])] if rows else [pa.array([], k) for k in [*kinds, pa.string()]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names, "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{kept}, {columns}, error string")


def content_keys(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with content_key and error: digests of any size in blocks of 64 KiB, one file a time in a task."""
    return _each_file(files, lambda f: (digest_of(f),), ["content_key"], "content_key string", [pa.string()])


def wave_formats(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with channels, sample_rate, bits, fault (why it isn't usable audio) and error (why it can't be read)."""
    return _each_file(files, lambda f: wav_format(header_bytes(f)), ["channels", "sample_rate", "bits", "fault"], "channels int, sample_rate int, bits int, fault string", [pa.int32()] * 3 + [pa.string()])
