"""Which texts contain which keys, without comparing all with all.

A text that contains a key contains every gram of it. Each key is looked up by
the gram that fewest texts have, so texts and keys meet by an equi-join, and what
meets is verified. Keys of one or two characters have grams of that length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(df: DataFrame, column: str, size: int) -> DataFrame:
    """``column, gram``: the different grams of each text."""
    length = F.length(column)
    starts = F.sequence(F.lit(1), F.greatest(length - size + 1, F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(size))))
    return df.where(length >= size).select(column, F.explode(grams).alias("gram"))


def containing(texts: DataFrame, keys: DataFrame, verified: Column | None = None) -> DataFrame:
    """``text, key``: all pairs of a text (column ``text``) and a key (column ``key``) that it contains, each once.

    Empty keys and nulls match nothing. ``verified`` may put another condition on
    the two columns in the place of containment; the text must still contain the
    key's column ``part`` if there is one, or else the key.
    """
    parted = "part" in keys.columns
    wanted = keys.select("key", *(["part"] if parted else [F.col("key").alias("part")])).where(F.length("part") > 0).distinct()
    texts = texts.select("text").where(F.col("text").isNotNull()).distinct()
    found = []
    for size in range(1, GRAM + 1):
        some = wanted.where(F.length("part") == size if size < GRAM else F.length("part") >= GRAM)
        asked = _grams(some.select("part").distinct(), "part", size)
        known = _grams(texts, "text", size).join(asked.select("gram").distinct(), "gram", "left_semi")
        uses = known.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counted = asked.join(uses, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("gram"))
        found.append(known.join(some.join(counted, "part"), "gram").where(F.contains("text", "part") if verified is None else verified).select("text", "key"))
    return reduce(DataFrame.unionByName, found)


def like(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``text, word``: texts that a word matches as ``ILIKE '%word%'``, where ``%`` and ``_`` in the word stand for any characters.

    A word is looked up by the longest part of it without such signs. Words of
    nothing else match by length alone: each text that has as many characters.
    """
    words = words.select(F.col("word").alias("key")).where(F.length("key") > 0).distinct()
    parts = F.split(F.lower("key"), r"[%_\\]", -1)
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("part")))), -1)["part"]
    keyed = words.withColumn("part", longest)
    lower = texts.select(F.col("text").alias("own"), F.lower("text").alias("text")).where(F.col("text").isNotNull()).distinct()
    near = containing(lower, keyed.where("part <> ''"), F.contains("text", "part") & F.expr("text ILIKE concat('%', key, '%')"))
    plain = near.join(lower, "text").select(F.col("own").alias("text"), F.col("key").alias("word"))
    open_words = keyed.where("part = ''").select("key", F.length(F.replace("key", F.lit("%"), F.lit(""))).alias("least"))
    lengths = lower.select(F.length("own").alias("length")).distinct()
    fitting = lengths.join(F.broadcast(open_words.select("least").distinct()), F.col("length") >= F.col("least"))  # lengths by lengths
    by_length = fitting.join(open_words, "least").join(lower.withColumn("length", F.length("own")), "length").where(F.expr("own ILIKE concat('%', key, '%')"))
    return plain.unionByName(by_length.select(F.col("own").alias("text"), F.col("key").alias("word")))
