"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ruleloom.llm import hashing

SLICE_BYTES = 1 << 20
# Where each row has its own result, smaller slices cost nothing and a worker needs less at a time.
ROW_SLICE_BYTES = 1 << 18
# Arrow batches by bytes, which the JVM holds twice; 10,000 long texts are far more.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
BROADCAST_ROWS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES, only: list[int] | None = None) -> Iterator[tuple[list, ...]]:
    """The columns of a batch (or some of them) as lists, a few rows at a time.

    `text` is the column that holds the long values; a slice ends once it has `limit`
    bytes, so that memory does not follow the number of rows in an Arrow batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes, 1):
        held += size
        if held >= limit or i == len(sizes):
            part = batch.slice(start, i - start)
            yield tuple(c.to_pylist() for c in (part.columns if only is None else map(part.column, only)))
            start, held = i, 0


class _Held:
    """What the running operator keeps in a Python worker from task to task."""

    key: object = None
    state: object = None


def kept_state(start: Callable[[], object] | None) -> object:
    """The state that `start` builds, kept in the worker until another operator runs there.

    Workers outlive tasks and stages. A tokenizer's cache is worth keeping for the next
    task of its stage, and must not lie beside what a later stage needs.
    """
    key = None if start is None else (start.func, start.args)
    if key != _Held.key:
        _Held.key = _Held.state = None
        if start is not None:
            _Held.key, _Held.state = key, start()
    return _Held.state


def map_slices(df: DataFrame, work: Callable[..., dict], schema: str, text: int, start: partial | None = None) -> DataFrame:
    """Run `work(state, *columns)` over slices of rows; it returns the output columns as lists.

    `start` builds the state, so that what a task needs beside its rows (vocabularies,
    caches) is built where it is used.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kept_state(start)
        for batch in batches:
            for columns in slices(batch, text, ROW_SLICE_BYTES):
                out = work(state, *columns)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        hand_back()

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, work: Callable[..., dict], schema: str, inputs: list[str], text: str, keep: str | None = None) -> DataFrame:
    """`df` with the columns that `work(*inputs)` returns as lists, a slice of rows at a time.

    The new columns come behind the others, which pass through as they are. With `keep`, a
    new column of that name tells which rows stay, and is not returned.
    """
    names = df.columns
    at, sized = [names.index(c) for c in inputs], names.index(text)
    new = to_arrow_schema(T.StructType.fromDDL(schema))
    out = T.StructType([*df.schema.fields, *[f for f in T.StructType.fromDDL(schema) if f.name != keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_state(None)
        for batch in batches:
            start = 0
            for columns in slices(batch, sized, ROW_SLICE_BYTES, at):
                part = batch.slice(start, len(columns[0]))
                start += len(columns[0])
                made = work(*columns)
                arrays = [*part.columns, *[pa.array(made[f.name], f.type) for f in new if f.name != keep]]
                done = pa.RecordBatch.from_arrays(arrays, names=out.names)
                yield done if keep is None else done.filter(pa.array(made[keep], pa.bool_()))
        hand_back()

    return df.mapInArrow(run, out)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hand_back() -> None:
    """Give what a task no longer uses back to the system: its Python worker goes on living."""
    hashing.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does already."""
    key, most = BATCH_BYTES
    if int(spark.conf.get(key, str((1 << 31) - 1))) > 1 << 30:
        spark.conf.set(key, str(most))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if it has at most so many rows, else as it is.

    Hand over a stored table of narrow rows: they are counted. Beyond the bound the join
    is a shuffled one with the same result.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")
