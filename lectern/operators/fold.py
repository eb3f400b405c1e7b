"""Folds over the rows of a key in their order, with bounded memory however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a fold hands back at once.
OUT_ROWS = 4096


def in_order(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Rows of one key in one partition, one after the other in their order; the sort spills where it must."""
    keys = [key] if isinstance(key, str) else key
    return rows.repartition(*keys).sortWithinPartitions(*keys, order)


def fold_rows(rows: DataFrame, fold: Callable[[Iterator[dict]], Iterator[tuple]], columns: list[tuple[str, str, pa.DataType]], key: str | list[str] = "transcript_id", order: str = "pos") -> DataFrame:
    """(key columns, place, *columns) of what ``fold`` yields from the rows of each key, which it reads one by one.

    ``columns`` are (name, Spark type, Arrow type); ``place`` is named as ``order`` and counts from 0 in each key. Only
    a batch of rows and what the fold itself remembers are in memory, so a key may hold any share of all rows.
    """
    keys = [key] if isinstance(key, str) else key
    names = [*keys, order, *[name for name, _, _ in columns]]
    schema = ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys], f"{order} long", *[f"{name} {kind}" for name, kind, _ in columns]])
    of_keys = itemgetter(*keys) if len(keys) > 1 else lambda r: (r[keys[0]],)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [*[first.schema.field(k).type for k in keys], pa.int64(), *[kind for _, _, kind in columns]]

        def records() -> Iterator[dict]:
            for batch in chain([first], batches):
                fields = batch.schema.names
                for values in zip(*(column.to_pylist() for column in batch.columns)):
                    yield dict(zip(fields, values))

        found = ((*k, i, *row) for k, group in groupby(records(), of_keys) for i, row in enumerate(fold(group)))
        while out := list(islice(found, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return in_order(rows, keys, order).mapInArrow(run, schema)
