"""Places for models, each with a deterministic stand-in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class HashedWords:
    """Embeds a text as counts of hashed words of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                out[i, int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "little") % self.size] += 1
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).tolist()


class FirstSentence:
    """Completes a prompt with its first sentence."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [re.split(r"(?<=[.。!?])\s*", p, maxsplit=1)[0] for p in prompts]


class Unavailable:
    """A model that never answers, to see what works without one."""

    def complete(self, prompts: list[str]) -> list[str]:
        raise ConnectionError("no model")


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", batch: int = 256) -> DataFrame:
    """``df`` with a column ``embedding``; rows reach the embedder in batches."""
    schema = df.withColumn("embedding", F.array().cast("array<float>")).schema

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = [v for at in range(0, len(f), batch) for v in embedder.embed(f[text].fillna("").tolist()[at : at + batch])]
            yield f.assign(embedding=vectors)

    return df.mapInPandas(work, schema)


def completed(df: DataFrame, model: LanguageModel, prompt: str, name: str = "answer", tries: int = 3) -> DataFrame:
    """``df`` with a model's answers to the column ``prompt``; a failing batch is tried again, then null."""
    schema = df.withColumn(name, F.lit(None).cast("string")).schema

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers: list[str | None] = [None] * len(f)
            for _ in range(tries):
                try:
                    answers = list(model.complete(f[prompt].fillna("").tolist()))
                    break
                except Exception:  # noqa: BLE001  endpoints fail in many ways
                    continue
            yield f.assign(**{name: answers})

    return df.mapInPandas(work, schema)


def cooccurrence_triples(chunks: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stand-in for extraction: known names (``id``) in a chunk; neighbours in order are RELATED_TO each other.

    Names are matched as whole words, by an equi-join.
    """
    words = chunks.select("chunk_id", F.posexplode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("at", "word"))
    hits = words.join(entities.select("id", F.lower("id").alias("word")), "word").groupBy("chunk_id", "id").agg(F.min("at").alias("at"))
    listed = hits.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    pairs = listed.select("chunk_id", F.explode(F.arrays_zip(F.col("ids").alias("src"), F.slice("ids", 2, 1_000_000_000).alias("dst"))).alias("p")).where("p.dst IS NOT NULL")
    return pairs.select("p.src", F.lit("RELATED_TO").alias("type"), "p.dst", "chunk_id"), hits.select("chunk_id", F.col("id").alias("node_id"))


# The kinds of plan that a reading statement consists of, and functions that run other code.
READING = (
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias"
    " Tail Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases"
    " UnresolvedWith Unpivot Window WithWindowDefinition"
).split()
OTHER_CODE = "java_method reflect try_reflect".split()


def _all_of(items) -> Iterator:
    each = items.iterator()
    while each.hasNext():
        yield each.next()


def _kind(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1].rstrip("$")


def _functions(expression) -> Iterator[str]:
    if _kind(expression) == "UnresolvedFunction":
        yield expression.nameParts().last().lower()
    for part in _all_of(expression.children()):
        yield from _functions(part)


def statement_parts(plan) -> tuple[set[str], set[str], set[str]]:
    """The kinds of nodes of a parsed statement, subqueries included, its functions, and the relations that it reads."""
    kinds, functions, relations = {_kind(plan)}, set(), set()
    if _kind(plan) == "UnresolvedRelation":
        relations.add(plan.multipartIdentifier().mkString("."))
    if _kind(plan) == "UnresolvedWith":
        own = {pair._1() for pair in _all_of(plan.cteRelations())}
    else:
        own = set()
    for expression in _all_of(plan.expressions()):
        functions.update(_functions(expression))
    for part in [*_all_of(plan.children()), *_all_of(plan.innerChildren())]:
        for mine, other in zip((kinds, functions, relations), statement_parts(part)):
            mine |= other
    return kinds, functions, relations - own


def read_only_sql(spark, text: str, most: int = 500, views: list[str] | None = None) -> DataFrame:
    """Runs one reading statement, at most ``most`` rows; anything else is refused.

    Spark's parser tells what the statement is: every node of its plan, those of
    subqueries too, must be one that reads. Words in literals and names don't
    matter. ``views`` may name the only relations to be read (beside those that
    the statement defines itself). Functions that run other code are refused.
    """
    bare = re.sub(r"^```(?:sql)?|```$", "", text.strip(), flags=re.M).strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)
    except Exception as error:
        raise ValueError("the statement can't be parsed") from error
    kinds, functions, relations = statement_parts(plan)
    if wrong := kinds - set(READING):
        raise ValueError(f"only reading statements are allowed, not {', '.join(sorted(wrong))}")
    if wrong := functions & set(OTHER_CODE):
        raise ValueError(f"functions that run other code are not allowed: {', '.join(sorted(wrong))}")
    if views is not None and (wrong := {r.lower() for r in relations} - {v.lower() for v in views}):
        raise ValueError(f"not to be read: {', '.join(sorted(wrong))}")
    return spark.sql(bare).limit(most)
