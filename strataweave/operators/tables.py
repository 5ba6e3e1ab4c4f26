"""Tables with merged cells: from cells to a full grid, and to Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PLACED = pa.schema([("table_id", pa.string()), ("row", pa.int32()), ("column", pa.int32()), ("row_span", pa.int32()), ("column_span", pa.int32()), ("text", pa.string()), ("n", pa.int64())])


def placed(cells: DataFrame) -> DataFrame:
    """The columns of cells that are only listed row by row: ``table_id, row, column, row_span, column_span, text, n``.

    ``cells`` has ``table_id`` (string), ``row`` (from 0), ``n`` (its order),
    ``row_span``, ``column_span`` (null or less than 1: 1) and ``text``. A cell
    takes the first columns of its row that no cell from above still covers: of
    an occupancy grid only the columns that are covered further down are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered: dict[int, int] = {}  # column -> first row that is free again
        table, row, at = object(), None, 0
        for batch in batches:
            columns = []
            for t, r, down, across in zip(*(batch.column(c).to_pylist() for c in ("table_id", "row", "row_span", "column_span"))):
                if t != table:
                    table, row, covered = t, None, {}
                if r != row:
                    row, at = r, 0
                    covered = {c: free for c, free in covered.items() if free > r}
                while any(covered.get(at + i, 0) > r for i in range(across)):
                    at += 1
                columns.append(at)
                for i in range(across):
                    covered[at + i] = r + down
                at += across
            yield pa.RecordBatch.from_arrays([batch.column("table_id"), batch.column("row"), pa.array(columns, pa.int32()), *(batch.column(c) for c in ("row_span", "column_span", "text", "n"))], schema=_PLACED)

    span = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("int").alias(c)
    rows = cells.select(F.col("table_id").cast("string").alias("table_id"), F.col("row").cast("int").alias("row"), span("row_span"), span("column_span"), "text", F.col("n").cast("long").alias("n"))
    # a task reads its tables one after the other: a group for each would cost more than its cells
    ordered = rows.where("row IS NOT NULL").repartition("table_id").sortWithinPartitions("table_id", "row", "n")
    return ordered.mapInArrow(work, "table_id string, row int, column int, row_span int, column_span int, text string, n long")


def grid(cells: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``table_id, row, column, text``: every place of every table, the content of merged cells at each of theirs.

    ``cells`` has the columns of :func:`placed` (without ``n``, cells that
    overlap have no order). ``sizes`` may give ``table_id, row_count,
    column_count``; a table without them is left out, cells beyond them are cut.
    Otherwise a table is as large as its cells' ends. Places without a cell are
    empty; of cells that overlap the later counts; cells without a place are
    left out.
    """
    order = F.col("n") if "n" in cells.columns else F.lit(0)
    one = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    if sizes is None:
        return _own_grid(cells.where("row >= 0 AND column >= 0").select("table_id", F.col("row").cast("int").alias("row"), F.col("column").cast("int").alias("column"), one("row_span").cast("int").alias("down"), one("column_span").cast("int").alias("across"), F.coalesce("text", F.lit("")).alias("text"), order.alias("n")))
    known = cells.where("row >= 0 AND column >= 0").select("table_id", "row", "column", (F.col("row") + one("row_span")).alias("row_end"), (F.col("column") + one("column_span")).alias("column_end"), F.coalesce("text", F.lit("")).alias("text"), order.alias("n"))
    sizes = sizes.where("row_count > 0 AND column_count > 0").select("table_id", "row_count", "column_count")
    inside = known.join(sizes, "table_id").where("row < row_count AND column < column_count")
    spread = inside.withColumn("row", F.explode(F.sequence("row", F.least("row_end", "row_count") - 1))).withColumn("column", F.explode(F.sequence("column", F.least("column_end", "column_count") - 1)))
    filled = spread.groupBy("table_id", "row", "column").agg(F.max_by("text", "n").alias("text"))
    places = sizes.select("table_id", F.explode(F.sequence(F.lit(0), F.col("row_count") - 1)).alias("row"), "column_count").select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("column_count") - 1)).alias("column"))
    return places.join(filled, ["table_id", "row", "column"], "left").select("table_id", F.col("row").cast("int").alias("row"), F.col("column").cast("int").alias("column"), F.coalesce("text", F.lit("")).alias("text"))


def _own_grid(known: DataFrame) -> DataFrame:
    """:func:`grid` of tables that are as large as their cells' ends: cells are dealt by table once, and no places are joined.

    The last cell that begins in a row adds the empty places of that row and of
    those up to the next row in which one begins, the first of a table those above.
    """
    table = Window.partitionBy("table_id")
    by_place = table.orderBy("row", "column", "n")
    ends = {"row_count": F.max(F.col("row") + F.col("down")).over(table), "column_count": F.max(F.col("column") + F.col("across")).over(table)}
    sized = known.where("table_id IS NOT NULL").withColumns(ends | {"_next": F.lead("row").over(by_place), "_first": F.lag("row").over(by_place).isNull()})
    until = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    c, zero = F.col, F.lit(0)
    box = lambda rows, columns, text, n: F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda k: F.struct(r.alias("row"), k.alias("column"), text.alias("text"), n.alias("n")))))
    own = box(until(c("row"), c("row") + c("down")), until(c("column"), c("column") + c("across")), c("text"), c("n"))
    empty = F.concat(F.when(c("_first"), until(zero, c("row"))).otherwise(F.array().cast("array<int>")), until(c("row"), F.coalesce("_next", "row_count")))
    empty = box(empty, until(zero, c("column_count")), F.lit(""), F.lit(None).cast(known.schema["n"].dataType))
    spread = sized.select("table_id", F.explode(F.concat(own, empty)).alias("p")).select("table_id", "p.*")
    filled = spread.groupBy("table_id", "row", "column").agg(F.max_by("text", "n").alias("text"))
    return filled.select("table_id", "row", "column", F.coalesce("text", F.lit("")).alias("text"))


def markdown(places: DataFrame) -> DataFrame:
    """``table_id, markdown``: the first row is the heading; line feeds in cells become spaces."""
    clean = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    listed = lambda key, column: F.transform(F.array_sort(F.collect_list(F.struct(key, column))), lambda x: x[column])
    rows = places.withColumn("text", clean).groupBy("table_id", "row").agg(listed("column", "text").alias("cells"))
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    first = F.min("row").over(Window.partitionBy("table_id"))
    rule = F.concat(F.lit("\n"), bar(F.transform("cells", lambda c: F.lit("---"))))
    lines = rows.select("table_id", "row", F.concat(bar(F.col("cells")), F.when(F.col("row") == first, rule).otherwise("")).alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(listed("row", "line"), "\n").alias("markdown"))
