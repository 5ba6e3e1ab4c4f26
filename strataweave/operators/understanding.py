"""From questions to the names and themes that retrieval enters the graph with."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from . import hooks

PROMPT = 'Which proper names and terms does this question name, and which themes is it about? Answer with JSON: {{"entities": [...], "themes": [...]}}\nQuestion: {question}'
# What a model says for nothing.
NOTHING = ["なし", "None", "N/A", "n/a"]
#: Themes of a question, names whose synonyms are looked up, synonyms of a name, and how near they must be.
THEMES, SOUGHT, SYNONYMS, NEAR = 6, 8, 3, 0.85
_READ = "names array<string>, themes array<string>, found_by string"


def read_answer(answer: str | None) -> tuple[list[str], list[str], str] | None:
    """Names, themes and how they were read from a model's answer: JSON, or else a list with commas; None without an answer."""
    if answer is None:
        return None
    clean = lambda xs: [s for s in (str(x).strip() for x in xs if x is not None) if s]
    found = re.search(r"\{.*\}", answer, re.S)
    try:
        data = json.loads(found[0]) if found else None
        names, themes, how = clean(data.get("entities") or []), clean(data.get("themes") or [])[:THEMES], "json"
    except (AttributeError, TypeError, ValueError):
        names, themes, how = clean(answer.split(",")), [], "list"
    return [n for n in dict.fromkeys(names) if n not in NOTHING], themes, how


def question_entities(questions: DataFrame, model: hooks.LanguageModel, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``questions`` (``question_id, text``) with ``names``, ``themes`` and ``found_by`` (json, list or words).

    Where the model does not answer, the names are the question's words of two
    and more characters, by ``tokenizer`` if that finds any, else by white space.
    """
    prompted = questions.withColumn("_prompt", F.replace(F.lit(PROMPT.replace("{{", "{").replace("}}", "}")), F.lit("{question}"), F.coalesce("text", F.lit(""))))
    answered = hooks.completed(prompted, model, "_prompt", "_answer")

    @F.pandas_udf(_READ)
    def read(answers: pd.Series) -> pd.DataFrame:
        rows = [read_answer(None if pd.isna(a) else a) or (None, None, None) for a in answers]
        return pd.DataFrame(rows, columns=["names", "themes", "found_by"])

    long = lambda words: F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))
    plain = long(F.split(F.coalesce("text", F.lit("")), r"\s+", -1))
    words = plain if tokenizer is None else F.when(F.size(long(tokenizer(F.col("text")))) > 0, long(tokenizer(F.col("text")))).otherwise(plain)
    out = answered.withColumn("_read", read("_answer")).withColumn("_words", words)
    return out.select(
        *questions.columns,
        F.coalesce("_read.names", "_words").alias("names"),
        F.coalesce("_read.themes", F.array().cast("array<string>")).alias("themes"),
        F.coalesce("_read.found_by", F.lit("words")).alias("found_by"),
    )


def with_synonyms(asked: DataFrame, entities: DataFrame, embedder: hooks.Embedder, least: float = NEAR, k: int = SYNONYMS, names: int = SOUGHT) -> DataFrame:
    """``asked`` with the entities nearest to its first ``names`` names added to ``names``, and alone in ``synonyms``.

    ``entities`` has ``id, embedding``. Names are embedded one by one, each
    different one once: a whole question would bring up general words. An entity
    counts from a similarity of ``least`` on; those that are names already don't.
    """
    each = asked.select("question_id", F.posexplode(F.slice("names", 1, names)).alias("at", "name"))
    different = hooks.embedded(each.select("name").distinct(), embedder, "name").withColumn("query_id", F.xxhash64("name"))
    numbered = entities.select(F.xxhash64("id").alias("vec_id"), F.col("id"), "embedding")
    near = vectors.top_k(numbered, different, k, least=least).join(numbered.select("vec_id", "id"), "vec_id").join(different.select("query_id", "name"), "query_id")
    hits = each.join(near.select("name", "id", "rank"), "name").join(asked.select("question_id", "names"), "question_id").where(~F.array_contains("names", F.col("id")))
    first = hits.groupBy("question_id", "id").agg(F.min(F.struct("at", "rank")).alias("place"))
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("place", "id"))
    listed = first.withColumn("n", order).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("synonyms"))
    joined = asked.join(listed, "question_id", "left").withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))
    return joined.withColumn("names", F.concat("names", "synonyms"))
