"""Ordered sequences per key: islands, runs, epochs, carries, and folds that only a sequential pass can compute."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from framelake.sources.scratch import materialise


#: Bytes of a fold's results that leave a task together.
SENT = 16 << 20


def _upto(key: str, order: Sequence[str]) -> Window:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, key: str, order: Sequence[str], start: Column, end: Column, gap: int) -> DataFrame:
    """df with island (from 0): a new one where start is over gap after the previous row's end."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(start - F.lag(end).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(_upto(key, order))).drop("_new")


def run_length(df: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """(key, run): rows before the first whose flag is not set."""
    marked = df.select(key, *order, F.when(flag, 1).otherwise(0).alias("flag"))
    return marked.withColumn("open", F.min("flag").over(_upto(key, order))).groupBy(key).agg(F.sum("open").alias("run"))


def running_product(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Prefix products as exp of summed logarithms; zeros and signs are carried apart."""
    w = _upto(key, order)
    size = F.exp(F.sum(F.when(value != 0, F.ln(F.abs(value))).otherwise(0.0)).over(w))
    sign = 1 - 2 * F.pmod(F.sum(F.when(value < 0, 1).otherwise(0)).over(w), F.lit(2))
    return df.withColumn(name, F.when(F.max(F.when(value == 0, 1).otherwise(0)).over(w) == 1, 0.0).otherwise(size * sign))


def epochs(df: DataFrame, key: str, order: Sequence[str], reset: Column) -> DataFrame:
    """df with epoch: how many resets the key has seen, this row included."""
    return df.withColumn("epoch", F.sum(F.when(reset, 1).otherwise(0)).over(_upto(key, order)))


def carry(df: DataFrame, key: str, order: Sequence[str], value: Column, gate: Column, name: str) -> DataFrame:
    """The last value whose gate was open, this row included."""
    return df.withColumn(name, F.last(F.when(gate, value), ignorenulls=True).over(_upto(key, order)))


def first_carried(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The value of a key's first row that has one, on it and all rows after it."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(_upto(key, order)))


def best_so_far(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """df with best (running maximum) and improved (this row raised it)."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("improved", F.coalesce(F.col(value) > before, F.lit(True))).withColumn("best", F.max(value).over(_upto(key, order)))


def fold(df: DataFrame, key: str, order: Sequence[str], step: Callable[[object, pd.Series], tuple[object, tuple]], names: Sequence[str], schema: str) -> DataFrame:
    """A sequential fold per key: step(state, row) -> (state, values of names); state is None at a key's first row.

    Keys are dealt to tasks and rows sorted by Spark; a task streams through its rows, holds one state and sends on SENT
    bytes of results, so a key of any length needs no more memory than a short one.
    """

    # the window deals and sorts the rows, and says where a key, null or not, begins
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    made = StructType.fromDDL(schema)
    kinds = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out, held, begun = [], 0, 0

            def made_of(end: int, batch=batch) -> pa.RecordBatch:
                rows = batch.slice(begun, end - begun)
                columns = [pa.array([v[i] for v in out], k.type) for i, k in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], [*batch.schema.names[:-1], *names])

            for at, row in enumerate(batch.to_pandas(integer_object_nulls=True).itertuples(index=False)):
                state, values = step(None if row[-1] else state, row)
                out.append(values)
                held += sum(len(v) for v in values if isinstance(v, bytes))
                if held > SENT:
                    yield made_of(at + 1)
                    out, held, begun = [], 0, at + 1
            if out:
                yield made_of(batch.num_rows)

    return df.select(*df.columns, first.alias("_first")).mapInArrow(run, StructType([*df.schema.fields, *made.fields]))


def scan(df: DataFrame, key: str, order: Sequence[str], step: Callable[[tuple | None, object], tuple], combine: Callable[[tuple, tuple], tuple], names: Sequence[str], schema: str) -> DataFrame:
    """Prefixes of an associative operation per key, df with the columns names: a long key is spread over many tasks.

    step(state, row) adds a row to what is so far, None at first; combine(a, b) adds what b was added up to, from None on,
    to a. A state may carry a flag of its own for what starts anew, which combine heeds. Rows are dealt by ranges of key and
    order, so that a task has a stretch of them; each task makes the prefixes of its stretches, a fold over the few last
    ones of each key says what came before each stretch, and those are combined with its rows. order is unique in a key.
    """
    made, own_columns = StructType.fromDDL(schema), list(df.columns)
    kinds = to_arrow_schema(made)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, place, part = None, object(), 0, TaskContext.get().partitionId()
        for batch in batches:
            keys, out = batch.column(key).to_pylist(), []
            for k, row in zip(keys, batch.to_pandas(integer_object_nulls=True).itertuples(index=False)):
                if not (k == last or (k != k and last != last)):
                    state, last = None, k
                state = step(state, row)
                out.append(state)
            columns = [pa.array([v[i] for v in out], k.type) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([part] * len(out), pa.int32()), pa.array(np.arange(place, place + len(out)))], [*batch.schema.names, *names, "_part", "_place"])
            place += len(out)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    rows = materialise(dealt.mapInArrow(local, StructType([*df.schema.fields, *made.fields, StructField("_part", IntegerType()), StructField("_place", LongType())])), "stretches")
    ends = rows.groupBy(key, "_part").agg(F.max_by(F.struct(*names), "_place").alias("_end"), F.count("*").alias("_n"))
    several = F.count("*").over(Window.partitionBy(key)) > 1
    ends = ends.withColumn("_several", several).where("_several").select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *[F.col(f"_end.{n}").alias(n) for n in names])
    before = [f"_{n}" for n in names]

    def carry(state: tuple | None, row) -> tuple[tuple, tuple]:
        own = tuple(row[2 : 2 + len(names)])
        return (own if state is None else combine(state, own)), (tuple([None] * len(names)) if state is None else state) + (state is not None,)

    # a row for each stretch of a key that several tasks share: as many as tasks, and as many again at most
    carried = fold(ends, "_key", ["_of"], carry, [*before, "_carried"], ", ".join(f"_{f.name} {f.dataType.simpleString()}" for f in made) + ", _carried boolean").where("_carried").drop(*names, "_carried")
    both = rows.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")), "left").select(*df.columns, *names, *before, F.col("_of").isNotNull().alias("_carried"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = (list(zip(*(batch.column(c).to_pylist() for c in cs))) for cs in (names, before))
            out = [combine(h, o) if c else o for o, h, c in zip(own, held, batch.column("_carried").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns), *(pa.array([v[i] for v in out], k.type) for i, k in enumerate(kinds))], [*own_columns, *names])

    return both.mapInArrow(add, StructType([*df.schema.fields, *made.fields]))


def smooth_box(last: tuple | None, new: tuple, most: int = 20, share: float = 0.3, least_area: float = 0.6) -> tuple:
    """A box (x1, y1, x2, y2) after the last one: clamped to it by most, blended, and refused if it shrinks too far."""
    if last is None:
        return new
    clamped = [min(max(n, o - most), o + most) for n, o in zip(new, last)]
    x1, y1, x2, y2 = (round(share * n + (1 - share) * o) for n, o in zip(clamped, last))
    area = max(0, x2 - x1) * max(0, y2 - y1)
    if area == 0 or area < least_area * (last[2] - last[0]) * (last[3] - last[1]):
        return last
    return x1, y1, x2, y2


def dilated_sum(df: DataFrame, key: str, order: Sequence[str], value: str, kernel: Sequence[float], dilation: int) -> Column:
    """A kernel's weighted sum over rows dilation apart, its middle on the row; rows beyond the ends count as 0."""
    w, mid = Window.partitionBy(key).orderBy(*order), len(kernel) // 2
    out = F.lit(0.0)
    for i, k in enumerate(kernel):
        at = (i - mid) * dilation
        v = F.col(value) if at == 0 else F.lag(value, -at, 0.0).over(w) if at < 0 else F.lead(value, at, 0.0).over(w)
        out = out + k * v
    return out
