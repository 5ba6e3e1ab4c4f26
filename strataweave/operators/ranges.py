"""Range joins by ranks.

Points and the ends of spans are sorted together over the whole cluster and the
points numbered. A span's ends then are numbers too, and it holds just the points
between them: spans are spread over their numbers and meet points by an
equi-join. Work grows with the input and with the pairs found; no group, however
large, is compared with itself, and equal values spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

_LOW, _POINT, _HIGH = range(3)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, kind, part, upto``: how many points this task has seen, this row included."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        upto = seen + np.cumsum(batch.column(1).to_numpy() == _POINT)
        if batch.num_rows:
            seen = int(upto[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(upto.astype(np.int64))], ["id", "kind", "part", "upto"])


def between(points: DataFrame, spans: DataFrame, group: list[str], value: str, low: str, high: str) -> DataFrame:
    """All pairs of a point and a span of its group with ``low <= value <= high``: the columns of both, ``group`` once.

    Rows with a null in the group, the value or a bound match nothing, nor do
    spans whose low end is above the high one. Repeated rows count each time.
    Other columns must have different names.
    """
    there = lambda df, columns: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    points = written(there(points, [*group, value]).withColumn("_point", F.monotonically_increasing_id()), "range-points")
    spans = written(there(spans, [*group, low, high]).where(F.col(low) <= F.col(high)).withColumn("_span", F.monotonically_increasing_id()), "range-spans")
    mark = lambda df, column, kind, key: df.select(*group, F.col(column).alias("_at"), F.lit(kind).alias("kind"), F.col(key).alias("id"))
    marks = mark(points, value, _POINT, "_point").unionByName(mark(spans, low, _LOW, "_span")).unionByName(mark(spans, high, _HIGH, "_span"))
    order = [*group, "_at", "kind"]
    ordered = marks.repartitionByRange(*order, F.xxhash64("id")).sortWithinPartitions(*order, F.xxhash64("id"))
    numbers = written(ordered.select("id", "kind").mapInArrow(_numbered, "id long, kind int, part int, upto long"), "range-numbers")
    totals = numbers.groupBy("part").agg(F.max("upto").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    ranked = numbers.join(F.broadcast(offsets), "part").select("id", "kind", (F.col("offset") + F.col("upto")).alias("rank"))
    ends = ranked.where(f"kind = {_LOW}").select("id", (F.col("rank") + 1).alias("first")).join(ranked.where(f"kind = {_HIGH}").select("id", F.col("rank").alias("last")), "id").where("first <= last")
    pairs = ends.select(F.col("id").alias("_span"), F.explode(F.sequence("first", "last")).alias("rank")).join(ranked.where(f"kind = {_POINT}").select(F.col("id").alias("_point"), "rank"), "rank")
    return pairs.select("_span", "_point").join(points, "_point").join(spans.drop(*group), "_span").drop("_span", "_point")
