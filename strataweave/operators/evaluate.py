"""Measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def _share(hit: Column) -> Column:
    return F.avg(hit.cast("double"))


def coverage(records: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``n, full_coverage, match_rate, micro_match_rate`` of ``predicted, correct`` arrays; records without gold don't count."""
    hits = F.size(F.array_intersect("predicted", "correct"))
    gold = F.size(F.array_distinct("correct"))
    rows = records.where(F.size("correct") > 0).withColumns({"_hits": hits, "_gold": gold})
    return rows.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"),
        _share(F.col("_hits") == F.col("_gold")).alias("full_coverage"),
        F.avg(F.col("_hits") / F.col("_gold")).alias("match_rate"),
        (F.sum("_hits") / F.sum("_gold")).alias("micro_match_rate"),
    )


def recall_at(gold: DataFrame, ranked: DataFrame, cutoffs: list[int]) -> DataFrame:
    """For each cutoff the mean recall of gold rows (``question_id, id``) and the share of questions found whole."""
    ranks = gold.distinct().join(ranked.groupBy("question_id", "id").agg(F.min("rank").alias("rank")), ["question_id", "id"], "left")
    each = ranks.select("question_id", "rank", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    per = each.groupBy("k", "question_id").agg(_share(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))).alias("recall"))
    return per.groupBy("k").agg(F.avg("recall").alias("recall"), _share(F.col("recall") == 1.0).alias("full"))


def rank_buckets(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """How many gold rows stand in which range of ranks."""
    ranks = gold.distinct().join(ranked.groupBy("question_id", "id").agg(F.min("rank").alias("rank")), ["question_id", "id"], "left")
    r = F.col("rank")
    bucket = F.when(r <= 5, "1-5").when(r <= 10, "6-10").when(r <= 20, "11-20").when(r <= 50, "21-50").when(r <= 100, "51-100").otherwise("missing")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def triple_scores(gold: DataFrame, found: DataFrame, symmetric: tuple[str, ...] = ("SAME_AS", "RELATED_TO")) -> DataFrame:
    """One row: precision, recall and F1 of triples ``s, p, o``; symmetric relations match either way."""
    turned = found.where(F.col("p").isin(list(symmetric))).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    known = found.select("s", "p", "o").unionByName(turned).distinct()
    given = gold.select("s", "p", "o").distinct()
    turned_gold = given.where(F.col("p").isin(list(symmetric))).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    hit = given.join(known, ["s", "p", "o"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    right = found.select("s", "p", "o").distinct().join(given.unionByName(turned_gold).distinct(), ["s", "p", "o"], "left_semi").agg(F.count(F.lit(1)).alias("right"))
    n_gold = given.agg(F.count(F.lit(1)).alias("gold"))
    n_found = found.select("s", "p", "o").distinct().agg(F.count(F.lit(1)).alias("found"))
    row = hit.join(F.broadcast(right)).join(F.broadcast(n_gold)).join(F.broadcast(n_found))  # one row each
    p = F.when(F.col("found") > 0, F.col("right") / F.col("found")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)
    return row.select("hits", "gold", "found", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def answer_scores(records: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Exact match, containment and character F1 of ``predicted`` against ``gold``, over all records of a group; yes and no in any words."""
    p, g = tx.folded_answer(F.col("predicted")), tx.folded_answer(F.col("gold"))
    rows = records.withColumns({"_p": p, "_g": g, "_n": F.monotonically_increasing_id()})
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    common = F.aggregate(
        F.array_distinct(letters(F.col("_p"))),
        F.lit(0),
        lambda s, x: s + F.least(F.size(F.filter(letters(F.col("_p")), lambda y: y == x)), F.size(F.filter(letters(F.col("_g")), lambda y: y == x))),
    )
    f1 = F.when(F.length("_p") + F.length("_g") > 0, 2 * common / (F.length("_p") + F.length("_g"))).otherwise(0.0)
    return rows.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"),
        _share(F.col("_p") == F.col("_g")).alias("exact"),
        _share(tx.answer_contained(F.col("gold"), F.col("predicted"))).alias("contained"),
        F.avg(f1).alias("f1"),
    )


def fact_coverage(records: DataFrame) -> DataFrame:
    """``coverage``: share of ``key_facts`` (separated by ;) that ``answer`` contains; null without facts."""
    facts = F.filter(F.transform(F.split(F.coalesce("key_facts", F.lit("")), ";"), tx.answer_form), lambda f: f != "")
    answer = tx.answer_form(F.col("answer"))
    rows = records.withColumns({"_facts": facts, "_answer": answer})
    found = F.size(F.filter("_facts", lambda f: F.contains(F.col("_answer"), f)))
    return rows.withColumn("coverage", F.when(F.size("_facts") > 0, found / F.size("_facts"))).drop("_facts", "_answer")


def crosstab(records: DataFrame, axes: list[str], condition: str, outcome: str, conditions: list[str]) -> DataFrame:
    """Mean outcome for each value of each axis and each condition, with the difference to the first."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))).alias("x")
    table = records.select(condition, outcome, pairs).groupBy(F.col("x.axis").alias("axis"), F.col("x.value").alias("value")).pivot(condition, conditions).agg(F.avg(outcome))
    return table.withColumns({f"delta_{c}": F.col(c) - F.col(conditions[0]) for c in conditions[1:]})


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of wins: questions (``question, ok``) right in both runs, one or none."""
    rows = a.select("question", F.col("ok").alias("a")).join(b.select("question", F.col("ok").alias("b")), "question")
    count = lambda c: F.count_if(c)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        count(F.col("a") & F.col("b")).alias("both"),
        count(F.col("a") & ~F.col("b")).alias("only_a"),
        count(~F.col("a") & F.col("b")).alias("only_b"),
        count(~F.col("a") & ~F.col("b")).alias("neither"),
    )


def judge_distribution(scores: DataFrame) -> DataFrame:
    """``category, n, mean, full, partial, none`` of judged scores 0 to 2."""
    s = F.col("score")
    return scores.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(s.cast("double")).alias("mean"), F.count_if(s == 2).alias("full"), F.count_if(s == 1).alias("partial"), F.count_if(s == 0).alias("none"))


def prediction_stats(records: DataFrame, refusal: str, group: list[str] | None = None) -> DataFrame:
    """``n, refusals, empty_references, mean_references`` of all records or of each group."""
    refs = F.size(F.coalesce("predicted", F.array().cast("array<string>")))
    return records.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer").rlike(refusal)).alias("refusals"), F.count_if(refs == 0).alias("empty_references"), F.avg(refs.cast("double")).alias("mean_references"))


def recurrence(keys: DataFrame, least: int = 2) -> DataFrame:
    """``key, documents, mentions`` of keys (``key, source``) in at least ``least`` documents."""
    return keys.groupBy("key").agg(F.count_distinct("source").alias("documents"), F.count(F.lit(1)).alias("mentions")).where(F.col("documents") >= least)


def recurrence_report(keys: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    """The ``top`` keys by documents: ``key, documents, mentions, examples, rank, rate``.

    ``keys`` has ``key, source, example``. ``examples`` are the first two by
    source; ``rate`` is the share of all keys that occur in at least ``least``
    documents.
    """
    counted = keys.groupBy("key").agg(F.count_distinct("source").alias("documents"), F.count(F.lit(1)).alias("mentions"))
    rate = counted.agg(F.avg((F.col("documents") >= least).cast("double")).alias("rate"))
    best = counted.where(F.col("documents") >= least).orderBy(F.desc("documents"), "key").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("documents"), "key")))  # at most top rows
    nth = F.row_number().over(Window.partitionBy("key").orderBy("source", "example"))
    some = keys.join(F.broadcast(best.select("key")), "key").select("key", "source", "example").distinct().withColumn("n", nth).where("n <= 2")
    shown = some.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", F.col("source").cast("string"), "example"))), "; ").alias("examples"))
    return ranked.join(shown, "key", "left").crossJoin(F.broadcast(rate))  # one row


def question_category(records: DataFrame) -> DataFrame:
    """``category`` by the answer, the context and its passages: refusal, table, reasoning, integration or single."""
    tables = F.size(F.filter(F.split("context", "\n"), lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 3)) >= 3
    n = F.size("positives")
    return records.withColumn("category", F.when(n == 0, "refusal").when(tables, "table").when((n >= 4) | F.col("question").rlike("なぜ|理由|why"), "reasoning").when(n >= 2, "integration").otherwise("single"))


def miss_cause(rows: DataFrame) -> DataFrame:
    """``cause, n, share`` by flags ``in_source, in_chunk, entity_a, entity_b, linked, related``, the first that explains a miss."""
    cause = (
        F.when(~F.col("in_source"), "not in source")
        .when(~F.col("in_chunk"), "lost in chunking")
        .when(~F.col("entity_a") & ~F.col("entity_b"), "both entities missing")
        .when(~F.col("entity_a") | ~F.col("entity_b"), "one entity missing")
        .when(F.col("linked"), "other relation")
        .when(F.col("related"), "indirect")
        .otherwise("no relation")
    )
    counts = rows.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("cause", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def is_multihop(records: DataFrame) -> DataFrame:
    """``multihop``: gold references on several pages or documents, or a question type that says so."""
    several = F.size(F.array_distinct("correct")) > 1
    named = F.lower(F.coalesce("question_type", F.lit(""))).rlike("multi|compositional|comparison") if "question_type" in records.columns else F.lit(False)
    return records.withColumn("multihop", several | named)


def source_triples(edges: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``source, s, p, o``: for each source the edges both of whose ends its chunks mention.

    Two joins on (node, source) pairs; the edges of a hub meet only the sources that mention it.
    """
    seen = mentions.join(chunks.select("chunk_id", "source"), "chunk_id").select("source", F.col("node_id").alias("s")).distinct()
    spo = edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o")).distinct()
    return spo.join(seen, "s").join(seen.withColumnRenamed("s", "o"), ["source", "o"], "left_semi").select("source", "s", "p", "o")


def _either_way(triples: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    spo = triples.select("s", "p", "o")
    turned = spo.where(F.col("p").isin(list(symmetric))).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return spo.unionByName(turned).distinct()


def graded_recall(gold: DataFrame, found: DataFrame, symmetric: tuple[str, ...] = ("SAME_AS", "RELATED_TO")) -> DataFrame:
    """``criticality, n, hits, recall`` of gold triples ``s, p, o, criticality``; symmetric relations match either way."""
    known = _either_way(found, symmetric).withColumn("_hit", F.lit(1))
    rows = gold.select("s", "p", "o", F.coalesce("criticality", F.lit("must_have")).alias("criticality")).distinct().join(known, ["s", "p", "o"], "left")
    counts = rows.groupBy("criticality").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits"))
    return counts.withColumn("recall", F.col("hits") / F.col("n"))


def triple_differences(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``s, p, o, kind``: hit, miss (in gold alone) or extra (found alone)."""
    both = gold.select("s", "p", "o").distinct().withColumn("_g", F.lit(1)).join(found.select("s", "p", "o").distinct().withColumn("_f", F.lit(1)), ["s", "p", "o"], "full")
    return both.select("s", "p", "o", F.when(F.col("_f").isNull(), "miss").when(F.col("_g").isNull(), "extra").otherwise("hit").alias("kind"))


def judge_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``n, agreed, share, kappa`` of two judges' verdicts (``question, ok``) on the questions both judged."""
    rows = a.select("question", F.col("ok").alias("a")).join(b.select("question", F.col("ok").alias("b")), "question")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"), F.count_if(F.col("a")).alias("_a"), F.count_if(F.col("b")).alias("_b"))
    n = F.col("n").cast("double")
    chance = (F.col("_a") * F.col("_b") + (n - F.col("_a")) * (n - F.col("_b"))) / (n * n)
    share = F.when(n > 0, F.col("agreed") / n)
    return one.select("n", "agreed", share.alias("share"), F.when(chance < 1, (share - chance) / (1 - chance)).alias("kappa"))
