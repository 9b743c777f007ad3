"""What the operators of this folder share: checked broadcasts, label folds, and the engine's scratch tables."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.sources.scratch import bucketed, materialise, scratch_dir  # noqa: F401

#: Words of a text: runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of two or three narrow columns that may be broadcast (about 64 MB); larger tables are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else df, to be joined by a shuffle."""
    return F.broadcast(df) if rows <= most else df


def strings(column: pa.Array, most: int = 256) -> Iterator[str]:
    """A column's strings; most of them at a time are Python objects, so that a batch of long texts isn't held twice."""
    for start in range(0, len(column), most):
        yield from column.slice(start, most).to_pylist()


_released = 0.0


def release(every: float = 1.0) -> None:
    """Gives this worker's freed memory back to the machine, at most once in every seconds; workers outlive their tasks."""
    global _released
    if (now := time.monotonic()) - _released >= every:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc
            pass
        _released = now


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, a generator over batches, with release() at its end."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        release(0)

    return run


def bounded_batches(df: DataFrame, rows: int = 1000) -> None:
    """Has Spark hand whole texts to Python in batches of so many rows, unless the session says otherwise already.

    Spark's own 10,000 rows are tens of MB of text at a time on both sides. No result depends on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, rows)


def whole(text: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(3)


def marks_of(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label), an id once: of repeated rows the smallest label counts; null ids and labels take no part."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, learn_fold: bool) -> DataFrame:
    """(doc_id, text, lang, label) of docs that carry a label.

    With learn_fold, only ids whose fold isn't 1. The label side is broadcast only if its counted rows allow it.
    """
    side = docs.select("doc_id", whole().alias("text"), F.col("lang").cast("string").alias("lang"))
    if learn_fold:
        side = side.where(fold() != 1)
    return side.join(small(marks_of(labels, label), labels.count()), "doc_id").select("doc_id", "text", "lang", "label")
