"""Reading documents, edges, questions, dictionaries and schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other names of the columns of an edge list, and the relation without one.
EDGE_HEADERS = {"src": ["source", "from", "src"], "dst": ["target", "to", "dst"], "type": ["label", "relation", "rel"]}
DEFAULT_RELATION = "RELATED_TO"
DEFAULT_RELATIONS = ["IS_A", "BELONGS_TO_CATEGORY", "PART_OF", "HAS_STEP", "HAS_ATTRIBUTE", "RELATED_TO", "AFFECTS", "CAUSES", "DEPENDS_ON", "APPLIES_TO", "OWNED_BY", "SAME_AS"]
DEFAULT_NODE_TYPES = ["Term"]


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".txt", ".md"), parser: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """``source, text`` of the files in a folder and those below it; empty ones are dropped.

    ``parser(name, data)`` reads other formats such as PDF, in a Python worker
    with its own fallbacks; without it files are UTF-8, wrong bytes replaced.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    chosen = files.where(ending.isin(list(extensions))).select(name.alias("source"), "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            read = parser or (lambda _, data: data.decode("utf-8", "replace"))
            yield pd.DataFrame({"source": f["source"], "text": [read(n, bytes(c)) for n, c in zip(f["source"], f["content"])]})

    return chosen.mapInPandas(parse, "source string, text string").where(F.trim("text") != "")


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, type, dst`` of a CSV edge list under any of its headers; rows that lack an end are dropped."""
    rows = _renamed(spark.read.option("header", "true").option("inferSchema", "false").csv(path))
    filled = {c: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names if n in rows.columns), F.lit(None).cast("string")) for c, names in EDGE_HEADERS.items()}
    edges = rows.select(filled["src"].alias("src"), F.coalesce(filled["type"], F.lit(DEFAULT_RELATION)).alias("type"), filled["dst"].alias("dst"))
    return edges.where("src IS NOT NULL AND dst IS NOT NULL")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV with a column ``question``, blank ones dropped, other columns kept."""
    rows = _renamed(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path))
    if "question" not in rows.columns:
        raise ValueError("the file has no column 'question'")
    return rows.where(F.trim("question") != "")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``canonical, aliases, category, definition, notes`` from JSON (a list, or under ``entries``) or CSV (aliases parted by ``|``)."""
    fields = "canonical string, aliases array<string>, category string, definition string, notes string"
    if path.endswith(".csv"):
        rows = _renamed(spark.read.option("header", "true").csv(path))
        have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        aliases = F.filter(F.transform(F.split(F.coalesce(have("aliases"), F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
        rows = rows.select(have("canonical").alias("canonical"), aliases.alias("aliases"), *(have(c).alias(c) for c in ("category", "definition", "notes")))
    else:
        text = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.from_json("value", f"struct<entries:array<struct<{_colons(fields)}>>>")["entries"], F.from_json("value", f"array<struct<{_colons(fields)}>>"))
        rows = text.select(F.explode(listed).alias("e")).select("e.*")
    from ..functions.text import normalize_dictionary

    return rows.withColumn("canonical", normalize_dictionary("canonical")).withColumn("aliases", F.coalesce("aliases", F.array())).where("canonical <> ''")


def _colons(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(","))


def read_schema(spark: SparkSession, path: str | None) -> dict:
    """``domain, version, node_types, relations (name to description)``; the default where the file is missing or wrong."""
    default = {"domain": "default/builtin", "version": "builtin-v1", "node_types": DEFAULT_NODE_TYPES, "relations": {r: "" for r in DEFAULT_RELATIONS}}
    if not path:
        return default
    try:
        given = json.loads(spark.read.text(path, wholetext=True).head()[0])
        relations = {r["name"]: r.get("definition") or r.get("description") or "" for r in given["relations"]}
        return {"domain": given.get("domain", ""), "version": given.get("version", ""), "node_types": given.get("node_types") or DEFAULT_NODE_TYPES, "relations": relations} if relations else default
    except Exception:  # noqa: BLE001  a bad vocabulary never stops a run
        return default


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id, source, page, section, text`` of JSON lines with ``chunk_id, doc_id, page, section_path, text``."""
    rows = spark.read.schema("chunk_id string, doc_id string, page int, section_path array<string>, text string").json(path)
    return rows.select("chunk_id", F.col("doc_id").alias("source"), "page", F.array_join(F.coalesce("section_path", F.array()), " > ").alias("section"), "text")


def read_tasks(spark: SparkSession, text: str, axes: list[str]) -> DataFrame:
    """Benchmark tasks (JSON text of a list) with nested axis groups flattened into columns."""
    rows = json.loads(text)
    flat = [{"question": r.get("question"), **{a: _find(r, a) for a in axes}} for r in rows]
    return spark.createDataFrame([tuple(f.values()) for f in flat], T.StructType([T.StructField(c, T.StringType()) for c in ("question", *axes)]))


def _find(row: object, name: str) -> str | None:
    if isinstance(row, dict):
        if name in row:
            value = row[name]
            return str(value["value"]) if isinstance(value, dict) and "value" in value else str(value)
        for v in row.values():
            if (found := _find(v, name)) is not None:
                return found
    return None


def entity_texts(nodes: DataFrame, mentions: DataFrame, chunks: DataFrame, texts: int = 5, each: int = 500, most: int = 1000) -> DataFrame:
    """``id, context``: the beginnings of the first chunks that mention a node, joined."""
    joined = mentions.join(chunks.select("chunk_id", F.substring("text", 1, each).alias("text")), "chunk_id")
    listed = joined.groupBy(F.col("node_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.struct("chunk_id", "text"))), 1, texts).alias("t"))
    text = F.substring(F.array_join(F.transform("t", lambda x: x["text"]), " "), 1, most)
    return nodes.select("id").distinct().join(listed.select("id", text.alias("context")), "id", "left").select("id", F.coalesce("context", F.lit("")).alias("context"))


def renamed_profile(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A foreign graph's table under our column names (ours to theirs)."""
    return df.select(*(F.col(theirs).alias(ours) for ours, theirs in names.items()))
