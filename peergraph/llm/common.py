"""What the training-data operators share: table access, lineage cuts, row iteration over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, few_threads, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    few_threads(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(documents: DataFrame, rows: int = 1000) -> None:
    """Whole texts go to Python by so many rows, unless the session has a setting of its own: both sides hold a batch at once."""
    conf, name = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(rows))


def utf8(text: pa.Array | pa.ChunkedArray) -> tuple[memoryview, list[int]]:
    """A string column's bytes and offsets (length rows + 1); a null text has length 0."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), offsets.tolist()


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts pass most_bytes; a single longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        begin = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or at[i + 1] - at[begin] > most_bytes:
                yield batch.slice(begin, i - begin)
                begin = i
    give_back()


def give_back() -> None:
    """Returns a finished task's memory to the system: the worker process waits for further tasks beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice that nothing refers to earlier shuffles any more, whose files it then deletes; else they stay until its heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(each: Column, none: str, add: Callable[[Column, Column], Column], moved: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Spans that a fold over each makes: add(acc, element) has acc.at (long, where it stands) and acc.spans (at first none).

    An array is copied whenever it grows, so blocks are folded on their own and their spans moved to where the block starts.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(none).alias("spans"))

    def of_blocks(e: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(e) - 1, F.lit(0)), F.lit(block)), lambda i: F.aggregate(F.slice(e, i + 1, F.lit(block)), start, add))

    def joined(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p.at)))
        return F.flatten(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), lambda p, at: F.transform(p.spans, lambda s: moved(s, at))))

    return let(let(each, of_blocks), joined)


def new_name(columns: list[str], name: str) -> str:
    """A column's name that can't clash with any of columns, since it is longer."""
    return max([*columns, ""], key=len) + f"_{name}"


def null_safe(*columns: str):
    """A join condition builder: equality of the named columns in which nulls are equal."""

    def on(a: DataFrame, b: DataFrame):
        out = F.lit(True)
        for c in columns:
            out = out & a[c].eqNullSafe(b[c])
        return out

    return on
