"""Helpers shared by the training-data operators: durable intermediates, Arrow maps, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python; long texts make larger batches costly.
ARROW_ROWS = 512
#: Bytes of text that one Python step works on at once.
STEP_CHARS = 1 << 22


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and everything runs on this machine (tests, a laptop) a temporary folder is used; on
    a cluster, where no executor would see the files of another, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:  # a table is one folder
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def return_memory() -> None:
    """Give memory that this Python process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def sweep(spark: SparkSession) -> None:
    """Let go of what no plan needs any more: shuffle files, which Spark deletes when the driver collects its garbage, and free memory of the driver.

    For operators of many steps, which else keep the shuffles of all steps on disk to the end.
    """
    gc.collect()
    spark._jvm.System.gc()
    return_memory()


_held: dict = {}
_asked: set = set()


def remembered(key, make: Callable):
    """``make()``, kept by this worker from task to task as long as the tasks that it runs ask for it."""
    _asked.add(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def forget_the_rest() -> None:
    """Let go of what the task that begins has not asked for: workers outlive operators."""
    for key in _held.keys() - _asked:
        del _held[key]
    _asked.clear()


def free_name(columns: list[str], want: str) -> str:
    """A column name that no input column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while want.lower() in taken:
        want += "_"
    return want


def crc_bucket(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def steps(lengths: list[int], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Spans of consecutive texts of about ``limit`` bytes in all; a longer text ends its span."""
    start = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def map_texts(df: DataFrame, text_col: str, make: Callable, schema: str, keep_text: bool = False) -> DataFrame:
    """``mapInArrow`` that hands ``make()``'s function the texts and the other columns, in bounded steps.

    ``make()`` runs once per task and returns ``f(texts) -> dict of new columns``; the columns of ``df``, without
    ``text_col`` unless ``keep_text``, are carried along in front. Workers outlive their tasks, so each task gives back
    what it has freed.
    """
    carried = [f for f in df.schema.fields if keep_text or f.name != text_col]
    fields = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in carried] + [schema])
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        forget_the_rest()
        for batch in batches:
            for lo, hi in steps([n or 0 for n in pc.binary_length(batch.column(text_col)).to_pylist()]):
                part = batch.slice(lo, hi - lo)
                new = work(part.column(text_col).to_pylist())
                columns = [part.column(n) for n in names] + list(new.values())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names + list(new))
        return_memory()

    return df.mapInArrow(run, fields)
