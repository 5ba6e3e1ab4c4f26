"""Entity linking as a cascade: equal names, near names, near vectors, and a judge for what is left open.

Each pair of names is decided once, by the first stage that finds it, and the
ledger says by which. Names that must stay apart (other numbers, another sign at
the end, one inside the other, numbers alone) are never linked, whatever a later
stage thinks; names of different labels only by the judge. A judge sees the pairs
between two thresholds and those of different labels above, nothing else.

Names are not chained: each goes to the best of those it is linked to directly,
and from there at most one step on. A cluster of more than a few names is more
likely an error than a find and is given up whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.shared import written
from . import hooks, model
from .linking import fuzzy_pairs, numeric_like
from .vector_index import neighbours

PROMPT = (
    "Do these two names mean exactly the same thing? If in doubt, the answer is no: other sizes, numbers, roles, wider or narrower terms are not the same."
    "\nA: {a} ({a_label}; {a_context})\nB: {b} ({b_label}; {b_context})\nAnswer with one line of JSON: {\"same\": true or false, \"reason\": \"...\"}"
)
_SAME = r'"same"\s*:\s*(true|false)'


@dataclass
class Linked:
    """``mapping`` (old, new), ``ledger`` (a, b, stage, score, verdict), ``clusters`` (new, members, size, used), ``report`` (what, n)."""

    mapping: DataFrame
    ledger: DataFrame
    clusters: DataFrame
    report: DataFrame


def _numbers(name: Column) -> Column:
    return F.regexp_extract_all(F.translate(name, tx.FULL_WIDTH_DIGITS, tx.DIGITS), F.lit("[0-9]+"), 0)


def kept_apart(a: Column, b: Column) -> Column:
    """Why two names must not be linked, or null: numbers, contained, numeric or ending."""
    x, y = F.lower(a), F.lower(b)
    inside = (F.contains(x, y) | F.contains(y, x)) & (F.abs(F.length(x) - F.length(y)) > 1) & (F.least(F.length(x), F.length(y)) >= 2)
    stem = F.length(x) - 1
    ending = (F.length(x) == F.length(y)) & (x != y) & (F.substring(x, F.lit(1), stem) == F.substring(y, F.lit(1), stem))
    return F.when(numeric_like(a) | numeric_like(b), "numeric").when(_numbers(a) != _numbers(b), "numbers").when(inside, "contained").when(ending, "ending")


def _equal_names(names: DataFrame) -> DataFrame:
    """Pairs of names of one label that have the same normal form: each with the best of them."""
    keyed = names.withColumn("norm", tx.normalize_entity("id")).where("norm <> ''")
    best = keyed.groupBy("label", "norm").agg(F.max_by("id", "order").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(best, ["label", "norm"]).where("id <> best").select(F.least("id", "best").alias("a"), F.greatest("id", "best").alias("b"), F.lit(1.0).alias("score"))


def _near_vectors(names: DataFrame, low: float, k: int) -> DataFrame:
    numbered = names.where(F.col("embedding").isNotNull()).select(F.xxhash64("id").alias("vec_id"), "id", "embedding")
    found = neighbours(numbered.select("vec_id", "embedding"), k, least=low)
    ids = numbered.select("vec_id", "id")
    pairs = found.join(ids.toDF("query_id", "x"), "query_id").join(ids.toDF("key", "y"), "key")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"))


def _contexts(edges: DataFrame, each: int = 4) -> DataFrame:
    """``id, context``: a few relations of each name."""
    step = model.undirected(edges).select(F.col("a").alias("id"), F.when(F.col("a") == F.col("src"), F.concat(F.lit("-"), "type", F.lit("-> "), "dst")).otherwise(F.concat(F.lit("<-"), "type", F.lit("- "), "src")).alias("line"))
    few = step.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where(F.col("n") <= each)
    return few.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), ", ").alias("context"))


def judged(pairs: DataFrame, names: DataFrame, edges: DataFrame, judge: hooks.LanguageModel) -> DataFrame:
    """``pairs`` (``a, b``) with a column ``same``: what the judge says; null where its answer can't be read."""
    told = names.select("id", "label").join(_contexts(edges), "id", "left").withColumn("context", F.coalesce("context", F.lit("none")))
    side = lambda c: told.select(*(F.col(x).alias(c if x == "id" else f"{c}_{x}") for x in told.columns))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    prompt = reduce(lambda p, c: F.replace(p, F.lit(f"{{{c}}}"), F.col(c)), ("a_label", "b_label", "a_context", "b_context", "a", "b"), F.lit(PROMPT))
    answered = hooks.completed(full.withColumn("prompt", prompt), judge, "prompt", "answer")
    said = F.regexp_extract(F.coalesce("answer", F.lit("")), _SAME, 1)
    return answered.select(*pairs.columns, F.when(said != "", said == "true").alias("same"))


def link(entities: DataFrame, edges: DataFrame, judge: hooks.LanguageModel | None = None, high: float = 0.95, low: float = 0.85, k: int = 20, most: int = 5, numbers_apart: bool = True) -> Linked:
    """Links the names of ``entities`` (``id, label``; ``pagerank``, ``mention_count``, ``embedding`` if there are such columns).

    Of an id with several labels the first counts. The best name of a cluster
    has the highest pagerank, then the most mentions, then the shortest, then
    the first id. Without embeddings there is no vector stage; without a judge
    what it should see stays open. Without ``numbers_apart`` near names with
    different numbers do not meet, and the ledger lacks what is decided of them;
    as they are always kept apart, mapping and clusters are the same.
    """
    optional = {c: F.max(c) if c in entities.columns else F.lit(0.0) for c in ("pagerank", "mention_count")}
    vector = [F.first("embedding", ignorenulls=True).alias("embedding")] if "embedding" in entities.columns else []
    grouped = entities.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"), *(c.alias(n) for n, c in optional.items()), *vector)
    order = F.struct(F.coalesce("pagerank", F.lit(0.0)), F.coalesce("mention_count", F.lit(0)), (-F.length("id")).alias("short"), F.transform(F.split("id", ""), lambda c: -F.ascii(c)).alias("first"), F.col("id").alias("name"))
    names = written(grouped.withColumn("order", order), "link-names")
    group = F.col("label") if numbers_apart else F.concat("label", F.lit("\n"), F.array_join(_numbers(F.col("id")), ","))
    stages = [("normal", _equal_names(names)), ("fuzzy", fuzzy_pairs(names.select("id", group.alias("label"))).select("a", "b", (1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"))).alias("score")))]
    if vector:
        stages.append(("vector", _near_vectors(names, low, k)))
    listed = [df.select("a", "b", F.struct(F.lit(n).alias("n"), F.lit(stage).alias("stage"), F.col("score").alias("score")).alias("s")) for n, (stage, df) in enumerate(stages)]
    once = reduce(DataFrame.unionByName, listed).groupBy("a", "b").agg(F.min("s").alias("s")).select("a", "b", "s.stage", "s.score")
    labels = names.select("id", "label")
    both = once.join(labels.toDF("a", "a_label"), "a").join(labels.toDF("b", "b_label"), "b")
    apart = F.when(F.col("stage") == "normal", F.lit(None)).otherwise(kept_apart(F.col("a"), F.col("b")))
    sure = (F.col("stage") != "vector") | (F.col("score") >= high) & F.col("a_label").eqNullSafe(F.col("b_label"))
    found = written(both.select("a", "b", "stage", "score", F.coalesce(F.concat(F.lit("apart: "), apart), F.when(sure, "same").otherwise("open")).alias("verdict")), "link-pairs")
    if judge is not None:
        answers = judged(found.where("verdict = 'open'").select("a", "b"), names, edges, judge)
        said = F.when(F.col("same"), "same").when(~F.col("same"), "other").otherwise("open")
        open_pairs = found.where("verdict = 'open'").drop("verdict").join(answers, ["a", "b"]).select("a", "b", F.lit("judge").alias("stage"), "score", said.alias("verdict"))
        found = written(found.where("verdict <> 'open'").unionByName(open_pairs), "link-ledger")
    linked = found.where("verdict = 'same'").select("a", "b")
    clusters = written(_clusters(names, linked, most), "link-clusters")
    mapping = clusters.where("used").select(F.explode("members").alias("old"), "new").where("old <> new")
    return Linked(mapping, found, clusters, _report(names, found, clusters))


def _clusters(names: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``new, members, size, used``: clusters of two and more; those above ``most`` are not used, names apart from a better one are left out."""
    ranked = names.select("id", "order")
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a name's best is itself or the best of those it is linked to: a running maximum, however many there are
    best = ways.join(ranked.toDF("b", "other"), "b").groupBy("a").agg(F.max("other").alias("other")).join(ranked.toDF("a", "own"), "a")
    step = written(best.select(F.col("a").alias("id"), F.greatest("own", "other")["name"].alias("best")), "link-best")
    onward = step.join(step.toDF("best", "next"), "best", "left").select("id", F.coalesce("next", "best").alias("new"))
    sizes = onward.groupBy("new").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > most).select("new", F.array().cast("array<string>").alias("members"), "size", F.lit(False).alias("used"))
    small = onward.join(sizes.where((F.col("size") > 1) & (F.col("size") <= most)).select("new"), "new").join(ranked, "id")
    pairs = small.select("new", F.col("id").alias("x"), F.col("order").alias("x_order")).join(small.select("new", F.col("id").alias("y"), F.col("order").alias("y_order")), "new").where("x_order < y_order")
    out = pairs.where(kept_apart(F.col("x"), F.col("y")).isNotNull() & (tx.normalize_entity("x") != tx.normalize_entity("y"))).select("new", F.col("x").alias("id")).distinct()
    kept = small.join(out, ["new", "id"], "left_anti").groupBy("new").agg(F.array_sort(F.collect_list("id")).alias("members"))
    kept = kept.select("new", "members", F.size("members").cast("long").alias("size"), F.lit(True).alias("used")).where("size > 1")
    return kept.unionByName(large)


def _report(names: DataFrame, ledger: DataFrame, clusters: DataFrame) -> DataFrame:
    pairs = ledger.groupBy(F.concat_ws(": ", F.lit("pairs"), "stage", "verdict").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    kinds = clusters.groupBy(F.when(F.col("used"), "clusters").otherwise("clusters given up").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    merged = clusters.where("used").agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("n")).select(F.lit("names merged").alias("what"), "n")
    return pairs.unionByName(kinds).unionByName(merged).unionByName(names.agg(F.count(F.lit(1)).alias("n")).select(F.lit("names").alias("what"), "n"))


def merged_graph(nodes: DataFrame, edges: DataFrame, linked: Linked) -> tuple[DataFrame, DataFrame]:
    """Nodes without those that went into another, edges moved over to the others."""
    return nodes.join(linked.mapping.select(F.col("old").alias("id")), "id", "left_anti").select(*nodes.columns), model.rewire(edges, linked.mapping)
