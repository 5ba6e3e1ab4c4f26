"""Token counts from an exact histogram of encoded lengths.

Each task encodes its documents and keeps one counter for each length; the
counters are summed over all tasks. The histogram has at most as many rows as
there are different lengths, and its suffix sums answer for *every* context
limit at once: how many documents fit, how many tokens a truncated corpus
keeps, and any quantile, all exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, slices
from .tokens import encoder

_SLICE = 1_000_000


def length_histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """One row per encoded length: ``n_tokens, n_docs``.

    Null and empty texts have length 0. Repeated rows count each time. An empty
    table gives no rows. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        encode = encoder(vocabulary).encode
        for batch in batches:
            for _, texts in slices(batch, 0, _SLICE):
                _, starts = encode(texts)
                found.update((starts[1:] - starts[:-1]).tolist())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    lengths = docs.select(F.col(text).alias("text")).transform(bounded).mapInArrow(count, "n_tokens long, n_docs long")
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length ``n_tokens`` taken as a context limit, one row:

    ``n_docs`` of that length, ``docs_within`` (not longer), ``docs_beyond``
    (longer), ``tokens_total`` of the corpus, ``tokens_within`` the limit in
    documents that fit, ``tokens_truncated`` (kept if longer documents are cut
    at the limit) and ``quantile`` (share of documents not longer). One task
    sums the histogram: its rows are the different lengths, not the documents.
    """
    upto = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy().orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        histogram.select(
            "n_tokens",
            "n_docs",
            F.sum("n_docs").over(upto).alias("docs_within"),
            F.sum(tokens).over(upto).alias("tokens_within"),
            F.sum("n_docs").over(whole).alias("_docs"),
            F.sum(tokens).over(whole).alias("tokens_total"),
        )
        .withColumn("docs_beyond", F.col("_docs") - F.col("docs_within"))
        .withColumn("tokens_truncated", F.col("tokens_within") + F.col("n_tokens") * F.col("docs_beyond"))
        .withColumn("quantile", F.col("docs_within") / F.col("_docs"))
        .drop("_docs")
    )


def truncated_total(sums: DataFrame, limit: int) -> Column | int:
    """Tokens kept if every document is cut at ``limit``, for any limit."""
    row = sums.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).select("tokens_within", "docs_beyond").head()
    if row is None:
        total = sums.select("docs_within", "docs_beyond").head()
        return 0 if total is None else limit * (total[0] + total[1])
    return row[0] + limit * row[1]


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of documents does not exceed."""
    row = sums.where(F.col("quantile") >= q).orderBy("n_tokens").select("n_tokens").head()
    return None if row is None else row[0]
