"""The property graph, chunks and questions derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import line_chunks


class Tables:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _key(self, kind: str, column: str):
        return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))

    @property
    def nodes(self) -> DataFrame:
        """``id, label, name``: customers also under their market segment, so their ids repeat."""
        part = lambda t, kind, key, name: self.read(t).select(self._key(kind, key).alias("id"), F.lit(kind).alias("label"), F.col(name).alias("name"))
        rows = part("region", "region", "r_regionkey", "r_name")
        for args in (("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name")):
            rows = rows.unionByName(part(*args))
        segment = self.read("customer").where("c_custkey % 10 = 0").select(self._key("customer", "c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"))
        return rows.unionByName(segment)

    @property
    def sales(self) -> DataFrame:
        orders = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders, "l_orderkey")

    @property
    def edges(self) -> DataFrame:
        """``src, type, dst, extraction_count, source_chunks``."""
        none, one = F.lit(None).cast("array<string>"), F.lit(1).cast("long")
        plain = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), one.alias("extraction_count"), none.alias("source_chunks"))
        k = self._key
        rows = plain(self.read("nation"), k("nation", "n_nationkey"), "PART_OF", k("region", "n_regionkey"))
        rows = rows.unionByName(plain(self.read("customer"), k("customer", "c_custkey"), "BELONGS_TO_CATEGORY", k("nation", "c_nationkey")))
        rows = rows.unionByName(plain(self.read("supplier"), k("supplier", "s_suppkey"), "BELONGS_TO_CATEGORY", k("nation", "s_nationkey")))
        uses = self.sales.select(k("customer", "o_custkey").alias("src"), k("part", "l_partkey").alias("dst"), k("order", "l_orderkey").alias("chunk"))
        uses = uses.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("extraction_count"), F.array_sort(F.collect_set("chunk")).alias("source_chunks"))
        rows = rows.unionByName(uses.select("src", F.lit("USES").alias("type"), "dst", "extraction_count", "source_chunks"))
        parts = self.read("lineitem").select(k("supplier", "l_suppkey").alias("src"), k("part", "l_partkey").alias("dst")).distinct()
        return rows.unionByName(plain(parts, F.col("src"), "HAS_PART", F.col("dst")))

    @property
    def links(self) -> DataFrame:
        """``a, b``: the ends of all edges, as often as the tables have them."""
        k = self._key
        ends = lambda df, a, b: df.select(a.alias("a"), b.alias("b"))
        rows = ends(self.read("nation"), k("nation", "n_nationkey"), k("region", "n_regionkey"))
        rows = rows.unionByName(ends(self.read("customer"), k("customer", "c_custkey"), k("nation", "c_nationkey")))
        rows = rows.unionByName(ends(self.read("supplier"), k("supplier", "s_suppkey"), k("nation", "s_nationkey")))
        rows = rows.unionByName(ends(self.sales, k("customer", "o_custkey"), k("part", "l_partkey")))
        return rows.unionByName(ends(self.read("lineitem"), k("supplier", "l_suppkey"), k("part", "l_partkey")))

    @property
    def mentions(self) -> DataFrame:
        """Orders as chunks that mention their customer, parts and suppliers."""
        chunk = self._key("order", "l_orderkey")
        listed = F.explode(F.array(self._key("customer", "o_custkey"), self._key("part", "l_partkey"), self._key("supplier", "l_suppkey")))
        return self.sales.select(chunk.alias("chunk_id"), listed.alias("node_id")).distinct()

    @property
    def order_chunks(self) -> DataFrame:
        return self.read("orders").select(self._key("order", "o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("text"))

    @property
    def chunks(self) -> DataFrame:
        return line_chunks(self.read("documents"))

    @property
    def documents(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("id"), "text", "source")

    @property
    def questions(self) -> DataFrame:
        """``question_id, conv_id, text``: every user turn of every conversation."""
        key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        return self.read("conversations").where("role = 'user'").select(key.alias("question_id"), "conv_id", "text")


#: The same in DuckDB's SQL, to stand before a query.
PRELUDE = """
WITH nodes AS (
    SELECT 'region:' || r_regionkey AS id, 'region' AS label, r_name AS name FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part
    UNION ALL SELECT 'customer:' || c_custkey, c_mktsegment, c_name FROM customer WHERE c_custkey % 10 = 0),
sales AS (SELECT l_orderkey, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS MATERIALIZED (
    SELECT 'nation:' || n_nationkey AS src, 'PART_OF' AS type, 'region:' || n_regionkey AS dst, CAST(1 AS BIGINT) AS extraction_count, CAST(NULL AS VARCHAR[]) AS source_chunks FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'BELONGS_TO_CATEGORY', 'nation:' || c_nationkey, 1, NULL FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'BELONGS_TO_CATEGORY', 'nation:' || s_nationkey, 1, NULL FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'USES', 'part:' || l_partkey, count(*), list_sort(list(DISTINCT 'order:' || l_orderkey)) FROM sales GROUP BY o_custkey, l_partkey
    UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'HAS_PART', 'part:' || l_partkey, 1, NULL FROM lineitem),
mentions AS MATERIALIZED (
    SELECT 'order:' || l_orderkey AS chunk_id, 'customer:' || o_custkey AS node_id FROM sales
    UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM sales
    UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM sales),
order_chunks AS (SELECT 'order:' || o_orderkey AS chunk_id, o_orderpriority AS source, o_orderstatus AS text FROM orders),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents),
chunks AS (
    SELECT sha256(source || chr(10) || text) AS chunk_id, source, CAST(first(page ORDER BY doc_id, page) AS INTEGER) AS page, text
    FROM lines WHERE trim(text) <> '' GROUP BY source, text),
both_ways AS MATERIALIZED (
    SELECT src AS a, dst AS b, type, src || '|' || type || '|' || dst AS edge_id, extraction_count FROM edges
    UNION ALL SELECT dst, src, type, src || '|' || type || '|' || dst, extraction_count FROM edges WHERE src <> dst),
questions AS (SELECT conv_id || ':' || turn AS question_id, conv_id, text FROM conversations WHERE role = 'user')
"""
