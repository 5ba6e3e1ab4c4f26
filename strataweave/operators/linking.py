"""Entity linking: which names mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import containing


def numeric_like(name: Column, least: float = 0.5) -> Column:
    """At least half of the characters are digits."""
    digits = F.length(F.regexp_replace(name, "[^0-9０-９]", ""))
    return F.when(F.length(name) > 0, digits / F.length(name) >= least).otherwise(False)


def fuzzy_pairs(nodes: DataFrame, least: int = 4) -> DataFrame:
    """``a, b, distance`` of names (``id, label``) of one label within an edit distance of 20 % of the length, 1 to 2.

    Two names within two edits share a part if either is cut into three, so pairs
    meet by an equi-join on label, part number and part at near places, never
    all with all.
    """
    names = nodes.select("label", "id", F.lower("id").alias("name")).where(F.length("name") >= least).distinct()
    n = F.length("name")
    first, second = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    cut = lambda a, b: F.substring(F.col("name"), a + 1, b - a)
    parts = F.array(F.struct(F.lit(0).alias("at"), cut(F.lit(0), first).alias("part")), F.struct(first.alias("at"), cut(first, second).alias("part")), F.struct(second.alias("at"), cut(second, n).alias("part")))
    left = names.select("label", F.col("id").alias("a"), F.col("name").alias("x"), F.explode(parts).alias("p")).select("label", "a", "x", "p.at", "p.part", F.length("p.part").alias("size"))
    sizes = left.select("label", "size", "at").distinct()
    # the other name's substrings of the parts' sizes at places up to two off
    shifts = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    right = names.select("label", F.col("id").alias("b"), F.col("name").alias("y")).join(sizes, "label").select("label", "b", "y", "size", "at", shifts.alias("shift"))
    right = right.where((F.col("at") + F.col("shift") >= 0) & (F.col("at") + F.col("shift") + F.col("size") <= F.length("y")))
    right = right.withColumn("part", F.substring(F.col("y"), F.col("at") + F.col("shift") + 1, F.col("size"))).select("label", "b", "y", "size", "at", "part").distinct()
    pairs = left.join(right, ["label", "size", "at", "part"]).where("a <> b").select("label", "a", "b", "x", "y").distinct()
    most = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(0.2 * F.least(F.length("x"), F.length("y"))).cast("int")))
    near = pairs.where(F.abs(F.length("x") - F.length("y")) <= 2).withColumn("distance", F.levenshtein("x", "y")).where((F.col("distance") > 0) & (F.col("distance") <= most))
    return near.select("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def safe_merges(pairs: DataFrame) -> DataFrame:
    """Pairs (``a, b``) that may be merged unseen: not numbers, not one inside the other by one character, not a mere ending."""
    a, b = F.col("a"), F.col("b")
    inside = (F.contains(a, b) | F.contains(b, a)) & (F.abs(F.length(a) - F.length(b)) <= 1)
    stem = F.least(F.length(a), F.length(b)) - 1
    ending = (F.length(a) == F.length(b)) & (F.substring(a, F.lit(1), stem) == F.substring(b, F.lit(1), stem))
    return pairs.where(~numeric_like(a) & ~numeric_like(b) & ~inside & ~ending)


def presence(entities: DataFrame, names: DataFrame) -> DataFrame:
    """For each asked ``name``: present (a node of that id), split (several contain it), dispersed (one does) or missing."""
    exact = names.join(entities.select(F.col("id").alias("name")).distinct().withColumn("_e", F.lit(True)), "name", "left")
    pairs = containing(entities.select(F.col("id").alias("text")), names.select(F.col("name").alias("key"))).toDF("id", "name")
    part = pairs.where("id <> name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    joined = exact.join(part, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("name", F.when(F.col("_e"), "present").when(F.col("n") >= 2, "split").when(F.col("n") == 1, "dispersed").otherwise("missing").alias("status"))
