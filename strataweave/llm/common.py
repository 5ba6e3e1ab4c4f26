"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The five columns of the table ``documents``.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_LOCAL_SCRATCH: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``. Where that is unset it is an error,
    but in one JVM (tests), where a temporary folder of this machine will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _LOCAL_SCRATCH.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="strataweave-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    Cuts the lineage: what is lost with an executor is read again, not computed
    again, and every reader sees the same rows.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows will reach Python in batches of a few MB: rows here may be long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, list[str]]]:
    """Rows of a text column in order, about ``most`` characters at a time.

    Gives the index of the first row and the texts (null: empty). A single text
    longer than ``most`` comes alone.
    """
    texts = batch.column(column)
    first, held, size = 0, [], 0
    for i in range(batch.num_rows):
        text = texts[i].as_py() or ""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held
