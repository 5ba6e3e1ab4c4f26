"""References between chunks: sections, pages, titles and short names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .ranges import between

# What counts as a heading, a short name, and a reference to a document, page or section.
HEADING = r"(?m)^\s*((?:[0-9]+\.){1,3}[0-9]+)\s*[ 　]?\S"
ALIAS = r"[（(]以下[、，]?\s*[「『]?([^」』）)、，\n]{2,25})[」』]?\s*(?:という|と称する|と呼ぶ|と記載|と略す)?[）)]"
DOCUMENT = r"[『]([^』]{3,40})[』][\s\S]{0,12}?(?:をご覧|を参照|参照して)"
# Page numbers have any number of digits: cut ones would name other pages.
PAGE_RANGE = r"P\.?\s?([0-9]+)\s?[〜~～-]\s?(?:P\.?\s?)?([0-9]+)"
PAGE = r"(?:→\s?P\.?\s?([0-9]+)|P\.?\s?([0-9]+)|([0-9]+)\s?ページ)"
SECTION_RANGE = r"((?:[0-9]+\.)+[0-9]+)\s?[〜~～]\s?((?:[0-9]+\.)+[0-9]+)"
SECTION = r"[「]?((?:[0-9]+\.){1,3}[0-9]+)[^」\n]{0,25}[」]?[^\n]{0,10}?(?:をご覧|を参照|参照|をお読み|→)"
TITLE_LINE = r"\A(?![0-9０-９])[^。、．]{4,30}\z"
MOST_REFERENCES = 12
MOST_DOCUMENTS = 3


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def inventory(chunks: DataFrame) -> dict[str, DataFrame]:
    """What can be referred to, from ``chunk_id, source, page, text``.

    ``sections`` (source, section, chunk_id: headings in the first 800
    characters), ``pages`` (source, page as text, chunk_id), ``titles`` (title in
    normal form, source: short lines of a document's first two pages; of equal
    titles the first source), ``aliases`` (source, alias, formal: the first
    definition of an alias in a document).
    """
    some = chunks.where("source IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    sections = some.select("source", "chunk_id", F.explode(_all(F.substring("text", 1, 800), HEADING, 1)).alias("section")).distinct()
    pages = some.where("page IS NOT NULL").select("source", F.col("page").cast("string").alias("page"), "chunk_id")
    first = Window.partitionBy("source")
    early = some.withColumn("first_page", F.min("page").over(first)).where(F.col("page") <= F.col("first_page") + 1)
    lines = early.select("source", F.explode(F.slice(F.split("text", "\r\n|[\n\r]"), 1, 30)).alias("line")).withColumn("line", F.trim("line"))
    titles = lines.where(F.col("line").rlike(TITLE_LINE)).select("source", tx.normalize_title("line").alias("title")).where(F.length("title") >= 4)
    titles = titles.groupBy("title").agg(F.min("source").alias("source"))
    return {"sections": sections, "pages": pages, "titles": titles, "aliases": aliases(some)}


def aliases(chunks: DataFrame) -> DataFrame:
    """``source, alias, formal``: the formal name is what stands before the definition, after the last mark, at most 40 characters."""
    found = _all(F.col("text"), ALIAS, 1)
    before = F.split("text", ALIAS, -1)
    rows = chunks.select("source", "page", "chunk_id", F.posexplode(F.arrays_zip(found.alias("alias"), before.alias("before"))).alias("at", "m")).where("m.alias IS NOT NULL")
    head = F.right(F.col("m.before"), F.lit(40))
    formal = F.trim(F.element_at(F.split(head, "[、。（）「」『』\n]"), -1))
    # the characters of the verb are taken off the end one by one
    alias = F.trim(F.regexp_replace(F.trim("m.alias"), "[という]+$", ""))
    rows = rows.select("source", "page", "chunk_id", "at", alias.alias("alias"), formal.alias("formal"))
    rows = rows.where((F.length("alias") >= 2) & (F.length("formal") >= 3) & (F.col("formal") != F.col("alias")))
    return rows.groupBy("source", "alias").agg(F.min_by("formal", F.struct("page", "chunk_id", "at")).alias("formal"))


def extract(chunks: DataFrame, found: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``src_chunk, dst_chunk, kind, ref_text`` and ``chunk_id, ref_docs`` (at most three).

    Each pair and kind once, at most twelve a chunk: page ranges of up to ten
    pages, single pages, section ranges (compared as text), sections.
    """
    some = chunks.where("source IS NOT NULL AND text IS NOT NULL").select("chunk_id", "source", "text")
    pages, sections = found["pages"], found["sections"]

    def zipped(pattern: str) -> Column:
        return F.arrays_zip(_all(F.col("text"), pattern, 0).alias("all"), _all(F.col("text"), pattern, 1).alias("a"), _all(F.col("text"), pattern, 2).alias("b"))

    ranges = some.select("chunk_id", "source", F.posexplode(zipped(PAGE_RANGE)).alias("at", "m"))
    ranges = ranges.select("chunk_id", "source", "at", F.col("m.all").alias("ref"), F.col("m.a").try_cast("int").alias("a"), F.col("m.b").try_cast("int").alias("b")).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= 10))
    spread = ranges.withColumn("page", F.explode(F.transform(F.sequence("a", "b"), lambda p: p.cast("string"))))
    by_range = spread.join(pages.withColumnRenamed("chunk_id", "dst"), ["source", "page"]).select("chunk_id", "dst", F.lit("page").alias("kind"), "ref", F.lit(0).alias("step"), "at", F.col("page").cast("int").alias("nth"))
    single = F.transform(_all(F.regexp_replace("text", PAGE_RANGE, " "), PAGE, 0), lambda m: F.regexp_extract(m, "[0-9]+", 0))
    one = some.select("chunk_id", "source", F.posexplode(single).alias("at", "page"))
    by_page = one.join(pages.withColumnRenamed("chunk_id", "dst"), ["source", "page"]).select("chunk_id", "dst", F.lit("page").alias("kind"), F.concat(F.lit("P."), "page").alias("ref"), F.lit(1).alias("step"), "at", F.lit(0).alias("nth"))
    spans = some.select("chunk_id", "source", F.posexplode(zipped(SECTION_RANGE)).alias("at", "m")).select("chunk_id", "source", "at", F.col("m.all").alias("ref"), F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    in_span = between(sections.withColumnRenamed("chunk_id", "dst"), spans, ["source"], "section", "a", "b").select("chunk_id", "dst", F.lit("section").alias("kind"), "ref", F.lit(2).alias("step"), "at", F.lit(0).alias("nth"))
    named = some.select("chunk_id", "source", F.posexplode(_all(F.col("text"), SECTION, 1)).alias("at", "section"))
    by_name = named.join(sections.withColumnRenamed("chunk_id", "dst"), ["source", "section"]).select("chunk_id", "dst", F.lit("section").alias("kind"), F.col("section").alias("ref"), F.lit(3).alias("step"), "at", F.lit(0).alias("nth"))
    edges = by_range.unionByName(by_page).unionByName(in_span).unionByName(by_name).where("chunk_id <> dst")
    once = edges.groupBy("chunk_id", "dst", "kind").agg(F.min(F.struct("step", "at", "nth", "ref")).alias("first"))
    order = F.row_number().over(Window.partitionBy("chunk_id").orderBy("first", "dst"))
    edges = once.withColumn("n", order).where(F.col("n") <= MOST_REFERENCES).select(F.col("chunk_id").alias("src_chunk"), F.col("dst").alias("dst_chunk"), "kind", F.col("first.ref").alias("ref_text"))
    titles = some.select("chunk_id", "source", F.posexplode(_all(F.col("text"), DOCUMENT, 1)).alias("at", "title")).withColumn("title", tx.normalize_title("title"))
    docs = titles.join(found["titles"].withColumnRenamed("source", "target"), "title").where("target <> source").groupBy("chunk_id", "target").agg(F.min("at").alias("at"))
    listed = docs.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("t"))
    return edges, listed.select("chunk_id", F.slice(F.transform("t", lambda x: x["target"]), 1, MOST_DOCUMENTS).alias("ref_docs"))


def follow(hits: DataFrame, chunks: DataFrame, references: DataFrame, least: int = 80) -> DataFrame:
    """Chunks that the hits' pages refer to: ``question_id, chunk_id``, without the hits' own pages and short texts.

    ``hits`` has ``question_id, source, page``; pages are compared as text.
    """
    at = chunks.select("chunk_id", "source", F.col("page").cast("string").alias("page"), "text")
    places = hits.select("question_id", "source", F.col("page").cast("string").alias("page")).distinct()
    sources = places.join(at, ["source", "page"]).select("question_id", F.col("chunk_id").alias("src_chunk"))
    targets = sources.join(references, "src_chunk").select("question_id", F.col("dst_chunk").alias("chunk_id")).distinct().join(at, "chunk_id")
    fresh = targets.where(F.length("text") >= least).join(places, ["question_id", "source", "page"], "left_anti")
    return fresh.select("question_id", "chunk_id").distinct()
