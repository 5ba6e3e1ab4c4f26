"""Facts that hold under conditions: storing them and routing questions to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .containment import containing


def reify(extracted: DataFrame, normalize=tx.normalize_entity) -> DataFrame:
    """Extracted facts with stable ids, each variant once.

    In: ``predicate, label, value, value_num, unit, source, chunk_id,
    conditions array<struct<axis,op,value>>``. Out: ``fact_id`` and the fields,
    ``conditions`` with ``norm_value, cond_id``, ``source_chunks``,
    ``extraction_count``.
    """
    rows = extracted.withColumn("_n", F.monotonically_increasing_id())
    conds = rows.select("_n", F.explode("conditions").alias("c")).withColumn("norm", normalize(F.col("c.value")))
    conds = conds.withColumn("cond_id", tx.condition_id(F.col("c.axis"), F.col("c.op"), F.col("norm")))
    listed = conds.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("cond_id", F.col("c.axis").alias("axis"), F.col("c.op").alias("op"), F.col("c.value").alias("value"), F.col("norm").alias("norm_value")))).alias("conds"))
    facts = rows.join(listed, "_n", "left").withColumn("conds", F.coalesce("conds", F.array().cast(listed.schema["conds"].dataType)))
    facts = facts.withColumn("fact_id", tx.fact_id(F.col("predicate"), F.col("value"), F.transform("conds", lambda c: c["cond_id"])))
    first = ("predicate", "label", "value", "value_num", "unit", "source")
    return facts.groupBy("fact_id").agg(
        *(F.min_by(c, F.col("chunk_id")).alias(c) for c in first),
        F.min_by("conds", F.col("chunk_id")).alias("conditions"),
        F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"),
        F.count(F.lit(1)).alias("extraction_count"),
    )


def fact_conditions(facts: DataFrame) -> DataFrame:
    """The bridge ``fact_id, cond_id, axis, op, value, norm_value``."""
    return facts.select("fact_id", F.explode("conditions").alias("c")).select("fact_id", "c.*").distinct()


def route(questions: DataFrame, facts: DataFrame, k: int = 20) -> DataFrame:
    """``question_id, fact_id, label, value_num, unit, source, conditions, rank`` for questions about conditions.

    Bound questions get facts of at least the number, the largest first (an
    unread number counts as 0); the others facts with a condition that holds one
    of the question's keys, the smallest first. Other questions get none here.
    """
    asked = questions.withColumn("intent", tx.condition_intent(F.col("text"))).where("intent <> 'none'")
    values = F.array_sort(F.array_distinct(F.transform("conditions", lambda c: c["value"])))
    plain = facts.select("fact_id", "label", "value_num", "unit", "source", values.alias("conds"), F.transform("conditions", lambda c: F.concat(c["value"], F.lit("\n"), F.coalesce(c["norm_value"], F.lit("")))).alias("texts"))
    bounds = asked.where("intent = 'rate_threshold'").select("question_id", tx.threshold(F.col("text")).alias("least"))
    # the k largest of those that reach a bound are the first of the k largest of all
    largest = plain.where("value_num IS NOT NULL").orderBy(F.desc("value_num"), "fact_id").limit(k)
    listed = largest.agg(F.collect_list(F.struct(*plain.columns)).alias("facts"))
    reached = bounds.crossJoin(F.broadcast(listed)).select("question_id", F.explode(F.filter("facts", lambda f: f["value_num"] >= F.col("least"))).alias("f"))  # one row of k facts
    by_number = reached.select("question_id", "f.*").withColumn("by", -F.col("value_num"))
    keys = asked.where("intent <> 'rate_threshold'").select("question_id", F.explode(tx.condition_keys(F.col("text"))).alias("key")).distinct()
    texts = plain.select("fact_id", F.explode("texts").alias("text")).distinct()
    # the first k of a question are among the first k of each of its keys: facts are cut before they meet questions
    held = containing(texts.select("text"), keys.select("key").distinct()).join(texts, "text").select("key", "fact_id").distinct()
    first = F.row_number().over(Window.partitionBy("key").orderBy("value_num", "fact_id"))
    few = plain.select("fact_id", "value_num").join(held, "fact_id").withColumn("n", first).where(F.col("n") <= k).select("key", "fact_id")
    hits = few.join(keys, "key").select("question_id", "fact_id").distinct()
    by_key = plain.join(hits, "fact_id").select("question_id", *plain.columns, F.col("value_num").alias("by"))
    both = by_number.unionByName(by_key)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("by", "fact_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "fact_id", "label", "value_num", "unit", "source", F.col("conds").alias("conditions"), "rank")


def block(routed: DataFrame) -> DataFrame:
    """``question_id, block``: the facts as lines between marks."""
    number = F.col("value_num").isNotNull() & (F.col("value_num") != -1)
    value = F.when(number, F.concat(F.col("value_num").cast("string"), F.coalesce("unit", F.lit("")))).otherwise(F.coalesce("label", F.lit("")))
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" [出典: "), "source", F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- "), F.coalesce("label", F.lit("")), F.lit(": "), value, F.lit(" （条件: "), F.array_join("conditions", " かつ "), F.lit("）"), source)
    lines = routed.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return lines.select("question_id", F.concat(F.lit("<CONDITION_FACTS>\n"), "lines", F.lit("\n</CONDITION_FACTS>")).alias("block"))
