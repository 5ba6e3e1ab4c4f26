"""Theme words of relations, and the index that finds relations by theme."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import hooks

PROMPT = 'Give each relation two to four theme words under which one would look for it: topics, not the names again. Answer with JSON alone: [{"i": 1, "kw": ["...", "..."]}, ...]\n'
#: Relations of a prompt, words of a relation, characters of its chunk that the prompt shows.
BATCH, WORDS, SNIPPET = 20, 4, 140
_HEX = r"\A[0-9a-f]{32,}\z"


def read_keywords(answer: str | None, n: int) -> list[list[str] | None]:
    """The words of each of ``n`` relations from a model's answer; None where it says none, or can't be read."""
    out: list[list[str] | None] = [None] * n
    found = re.search(r"\[.*\]", answer or "", re.S)
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        return out
    for item in items if isinstance(items, list) else []:
        try:
            at = int(item["i"]) - 1
            words = [w for w in (str(k).strip() for k in item["kw"] or []) if w]
        except (KeyError, TypeError, ValueError):
            continue
        if 0 <= at < n and words:
            out[at] = words[:WORDS]
    return out


def to_annotate(edges: DataFrame, nodes: DataFrame, protected: str = "Qms") -> DataFrame:
    """Edges without keywords between entities: no hash ids, no end with a label that begins with ``protected``."""
    rows = edges.where(F.col("keywords").isNull() & ~F.col("src").rlike(_HEX) & ~F.col("dst").rlike(_HEX))
    if not protected:
        return rows
    kept = nodes.where(F.startswith("label", F.lit(protected))).select("id").distinct()
    return rows.join(kept.withColumnRenamed("id", "src"), "src", "left_anti").join(kept.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def annotate(edges: DataFrame, nodes: DataFrame, model: hooks.LanguageModel, chunks: DataFrame | None = None, batch: int = BATCH, protected: str = "Qms", tries: int = 3) -> DataFrame:
    """``edges`` with ``keywords`` where a model gives some; those that have some stay as they are.

    Up to ``batch`` relations go into a prompt, each with the beginning of its
    first chunk (``chunks``: ``chunk_id, text``). A prompt that fails ``tries``
    times leaves its relations without words, to be asked for again another time.
    """
    if "keywords" not in edges.columns:
        edges = edges.withColumn("keywords", F.lit(None).cast("array<string>"))
    ends = ["src", "type", "dst"]
    wanted = to_annotate(edges, nodes, protected).select(*ends, F.get(F.coalesce("source_chunks", F.array()), F.lit(0)).alias("chunk_id"))
    if chunks is None:
        shown = wanted.select(*ends, F.lit("").alias("snippet"))
    else:
        first = chunks.groupBy("chunk_id").agg(F.min(F.left("text", F.lit(SNIPPET))).alias("snippet"))
        shown = wanted.join(first, "chunk_id", "left").select(*ends, F.coalesce("snippet", F.lit("")).alias("snippet"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[list[str] | None] = []
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                lines = [f"{i}. {r.src} -[{r.type}]-> {r.dst}" + (f" (from: {r.snippet}...)" if r.snippet else "") for i, r in enumerate(some.itertuples(), 1)]
                answer = None
                for _ in range(tries):
                    try:
                        answer = model.complete([PROMPT + "\n".join(lines)])[0]
                        break
                    except Exception:  # noqa: BLE001  endpoints fail in many ways
                        continue
                found += read_keywords(answer, len(some))
            yield frame[ends].assign(_words=found)

    told = shown.mapInPandas(work, ", ".join(f"{c} string" for c in ends) + ", _words array<string>").where("_words IS NOT NULL").dropDuplicates(ends)
    return edges.join(told, ends, "left").withColumn("keywords", F.coalesce("keywords", "_words")).select(*edges.columns)


def documents(edges: DataFrame) -> DataFrame:
    """``relation_id, start, type, end, text``: what stands for each relation in the index."""
    text = tx.relation_document(F.col("keywords"), F.col("src"), F.col("type"), F.col("dst"))
    return edges.select(F.xxhash64("src", "type", "dst").alias("relation_id"), F.col("src").alias("start"), "type", F.col("dst").alias("end"), text.alias("text"))


def refreshed(edges: DataFrame, embedder: hooks.Embedder, index: DataFrame | None = None) -> DataFrame:
    """The index of these edges (``relation_id, start, type, end, text, embedding``), as themes search it.

    Of ``index``, an earlier one, rows whose text is the same keep their
    embedding; only new and changed relations reach the embedder, and those that
    are gone are dropped.
    """
    current = documents(edges)
    if index is None:
        return hooks.embedded(current, embedder)
    old = index.select("relation_id", "text", "embedding")
    kept = current.join(old, ["relation_id", "text"]).select(*current.columns, "embedding")
    new = hooks.embedded(current.join(old, ["relation_id", "text"], "left_anti").select(*current.columns), embedder)
    return kept.unionByName(new)
