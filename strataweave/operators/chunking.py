"""Splitting Markdown into chunks with their headers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

SEPARATORS = ["\n\n", "\n", "。", "、", " ", ""]
_PART = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("h2", "h3", "text")]))


def split_sections(markdown: str) -> Iterator[tuple[str | None, str | None, str]]:
    """``h2, h3, text`` of the parts between headers of level 2 and 3; headers stay in the text, fenced code has none."""
    h2 = h3 = None
    lines: list[str] = []
    fence = ""
    for line in markdown.split("\n"):
        bare = line.strip()
        if fence:
            fence = "" if bare.startswith(fence) else fence
        elif bare.startswith(("```", "~~~")):
            fence = bare[:3]
        elif m := re.match(r"(#{2,3}) +(.*)", bare):
            if text := "\n".join(lines).strip():
                yield h2, h3, text
            lines = []
            if len(m[1]) == 2:
                h2, h3 = m[2].strip(), None
            else:
                h3 = m[2].strip()
        lines.append(bare)
    if text := "\n".join(lines).strip():
        yield h2, h3, text


#: Where long pages are cut, the first that does.
PAGE_SEPARATORS = ["\n\n", "\n", "。", "、", " ", ""]


def split_text(text: str, size: int = 1024, overlap: int = 100, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs, the next ones where a part is still too long.

    Pieces share up to ``overlap`` characters of whole parts; separators stay at
    the front of the part that follows.
    """
    separators = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for part in parts:
        if len(part) > size and rest:
            close()
            held = []
            out += split_text(part, size, overlap, rest)
            continue
        if held and sum(map(len, held)) + len(part) > size:
            close()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    close()
    return out


def markdown_chunks(docs: DataFrame, size: int = 1024, overlap: int = 100, breadcrumb: bool = True) -> DataFrame:
    """``source, h1, h2, h3, ordinal, text`` from ``source, text``.

    Headers of level 2 and 3 part the text, long parts are split again, and each
    chunk starts with the headers above it in brackets. Empty texts give none.
    """

    @F.pandas_udf(_PART)
    def pieces(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            return [{"h2": h2, "h3": h3, "text": p} for h2, h3, t in split_sections(text or "") for p in (split_text(t, size, overlap) if len(t) > size else [t])]

        return texts.map(one)

    rows = docs.select("source", tx.space_headers(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("source", tx.first_title(F.col("text")).alias("h1"), F.posexplode(pieces("text")).alias("ordinal", "p"))
    rows = rows.select("source", F.when(F.col("h1") != "", F.col("h1")).alias("h1"), "p.h2", "p.h3", "ordinal", F.col("p.text").alias("text"))
    crumb = F.concat_ws(" > ", "h1", "h2", "h3")
    with_crumb = F.when(F.lit(breadcrumb) & (crumb != ""), F.concat(F.lit("["), crumb, F.lit("]\n"), F.ltrim("text"))).otherwise(F.col("text"))
    return rows.select("source", "h1", "h2", "h3", "ordinal", with_crumb.alias("text"))


def line_chunks(docs: DataFrame) -> DataFrame:
    """``chunk_id, source, page, text``: the lines of documents (``doc_id, source, text``), each text of a source once."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("page", "text")).where(F.trim("text") != "")
    keyed = lines.withColumn("chunk_id", tx.chunk_id(F.col("source"), F.col("text")))
    first = F.min(F.struct("doc_id", "page"))
    return keyed.groupBy("chunk_id", "source", "text").agg(first.alias("f")).select("chunk_id", "source", F.col("f.page").alias("page"), "text")


def figure_chunks(docs: DataFrame) -> DataFrame:
    """``source, type, image_path, text`` of the figures of documents (``source, figures array<struct<index,caption,image_path>>``)."""
    rows = docs.select("source", F.explode("figures").alias("f"))
    caption = F.trim(F.coalesce("f.caption", F.lit("")))
    shown = F.when(caption != "", caption).otherwise("（キャプション生成失敗）")
    text = F.concat(F.lit("[図"), F.coalesce(F.col("f.index").cast("string"), F.lit("?")), F.lit("] "), shown)
    return rows.select("source", F.lit("figure").alias("type"), F.coalesce("f.image_path", F.lit("")).alias("image_path"), text.alias("text"))


def page_chunks(docs: DataFrame, thin: int = 100, fallback: DataFrame | None = None) -> DataFrame:
    """``source, page, text`` of texts with lines ``===== Page N =====``; pages of few characters take the fallback's text."""
    parts = F.split("text", r"(?m)^===== Page [0-9]+ =====[ \t]*$")
    numbers = F.regexp_extract_all("text", F.lit(r"(?m)^===== Page ([0-9]+) =====[ \t]*$"), 1)
    rows = docs.select("source", F.explode(F.arrays_zip(numbers.alias("page"), F.slice(parts, 2, 1_000_000_000).alias("text"))).alias("p"))
    rows = rows.select("source", F.col("p.page").cast("int").alias("page"), F.regexp_replace("p.text", r"\A\s+|\s+\z", "").alias("text"))
    if fallback is None:
        return rows
    other = fallback.select("source", "page", F.col("text").alias("other"))
    poor = F.length(F.regexp_replace("text", r"\s", "")) < thin
    return rows.join(other, ["source", "page"], "left").select("source", "page", F.when(poor, F.coalesce("other", "text")).otherwise(F.col("text")).alias("text"))


def split_pages(pages: DataFrame, most: int = 1000, overlap: int = 80) -> DataFrame:
    """``chunk_id, source, page, sub, text`` of pages (``source, page, text``): long ones in parts, empty ones left out.

    A part keeps its page's number; ``sub`` counts the parts of a page from 0. The
    id is a hash of source, page, part and the first 200 characters.
    """

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        whole = texts.fillna("").str.strip()
        return whole.map(lambda t: [t] if 0 < len(t) <= most else split_text(t, most, overlap, PAGE_SEPARATORS) if t else [])

    rows = pages.select("source", "page", F.posexplode(parts("text")).alias("sub", "text"))
    key = F.concat_ws("|", "source", F.col("page").cast("string"), F.col("sub").cast("string"), F.left("text", F.lit(200)))
    return rows.select(F.sha2(key, 256).alias("chunk_id"), "source", "page", "sub", "text")


def html_text(pages: DataFrame) -> DataFrame:
    """``url, title, text`` of web pages: scripts and styles dropped, headers as Markdown, tags gone, lines trimmed."""
    html = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    for n in (1, 2, 3):
        html = F.regexp_replace(html, rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ")
    html = F.regexp_replace(html, r"(?i)</?(?:p|div|br|li|tr|h[1-6])\b[^>]*>", "\n")
    plain = F.regexp_replace(html, r"<[^>]+>", " ")
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (" ", "&nbsp;"), ("&", "&amp;")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("url", title.alias("title"), F.array_join(lines, "\n").alias("text"))
