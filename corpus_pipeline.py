"""From raw documents to packed training sequences, stage by stage.

Each stage gets the rows that the one before it kept and returns the columns of
``documents``; the last returns pieces of sequences. For all of them: null texts
count as empty, empty texts are kept but for exact copies, of which one stays;
long texts are read whole; rows without doc_id are rows like others; rows
repeated in all columns are copies, so one is left after the second stage; other
columns than those of ``documents`` are dropped; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from strataweave.llm.common import DOCUMENT_COLUMNS, documents, written
from strataweave.llm.tokens import byte_bpe_path

#: A document goes if its calibrated probability to be toxic is at least this, as in the operator's own query.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels teach the model and are no input of the decision.

    Equal texts have equal scores and go or stay together; without labels of both
    kinds nearly every score is the share of the one kind.
    """
    model = toxicity.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest stays, then that of the smallest doc_id; one of null and empty texts."""
    return exact_dedup.keep_one(docs.select(*DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest doc_id stays, a missing one last; texts without words are no class."""
    return ngram_join.keep_one(docs.select(*DOCUMENT_COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens; an empty text is its end id alone."""
    return packing.pack(docs, byte_bpe_path(), 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage's model, the join and the tokenizer are beyond SQL; tests hold each stage against brute force, the first against its scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
