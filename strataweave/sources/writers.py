"""Writing graphs, vectors, results and stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_collection(chunks: DataFrame, path: str, collection: str, replace: bool = False) -> None:
    """Chunks of one collection, a partition of the table; ``replace`` puts away what it held."""
    out = chunks.withColumn("collection", F.lit(collection)).write.partitionBy("collection")
    if replace:
        out.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        out.mode("append").parquet(path)


def read_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("collection") == collection)


def collections(spark: SparkSession, path: str) -> DataFrame:
    """``collection, n``, without those of entities."""
    return spark.read.parquet(path).groupBy("collection").agg(F.count(F.lit(1)).alias("n")).where(~F.col("collection").endswith("_entities"))


def with_tokens(chunks: DataFrame, tokens, reset: bool = False) -> DataFrame:
    """Chunks with a column ``tokens`` where it is null, or everywhere."""
    new = tokens(F.col("text"))
    old = F.col("tokens") if "tokens" in chunks.columns and not reset else F.lit(None).cast("array<string>")
    return chunks.withColumn("tokens", F.coalesce(old, new))


def export_keys(edges: DataFrame) -> DataFrame:
    """Edges with a running ``key`` from 0 among those of the same ends."""
    order = Window.partitionBy("src", "dst").orderBy("type")
    return edges.withColumn("key", F.row_number().over(order) - 1)


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, json`` of nodes and edges in node-link form, one a row."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", F.col("label").alias("type"))).alias("json"))
    b = export_keys(edges).select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "key")).alias("json"))
    return a.unionByName(b)


def backup(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 16) -> DataFrame:
    """JSON lines of both kinds, compressed, in parts by a hash of the row; returns the manifest ``kind, part, n, hash``.

    The manifest is written last: a backup without one is not whole.
    """
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("row"))
    b = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("row"))
    rows = a.unionByName(b).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    rows.write.partitionBy("kind", "part").option("compression", "gzip").json(f"{path}/rows")
    _checksums(_backed_up(nodes.sparkSession, f"{path}/rows")).coalesce(1).write.parquet(f"{path}/manifest")
    return nodes.sparkSession.read.parquet(f"{path}/manifest")


def _backed_up(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row string, kind string, part int").json(path)


def _checksums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row").cast("decimal(38, 0)")).cast("string").alias("hash"))


def resume(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Takes a backup over into ``target`` part by part: ``kind, part, n, state``.

    A part whose rows the target has whole, by count and hash, is left alone
    (``kept``), so what broke off goes on where it stopped; others are written
    anew (``written``). A part of the backup that is not as its manifest says is
    an error before anything of it is written.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    source, wanted = _backed_up(spark, f"{path}/rows"), sorted(manifest.collect())
    there = {}
    if _exists(spark, target):
        there = {(r.kind, r.part): (r.n, r.hash) for r in _checksums(_backed_up(spark, target)).collect()}
    found = {(r.kind, r.part): (r.n, r.hash) for r in _checksums(source).collect()}
    out = []
    for r in wanted:
        if there.get((r.kind, r.part)) == (r.n, r.hash):
            out.append((r.kind, r.part, r.n, "kept"))
            continue
        if found.get((r.kind, r.part)) != (r.n, r.hash):
            raise ValueError(f"part {r.part} of the {r.kind}s is not what the manifest says")
        rows = source.where((F.col("kind") == r.kind) & (F.col("part") == r.part)).select("row")
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{target}/kind={r.kind}/part={r.part}")
        out.append((r.kind, r.part, r.n, "written"))
    return spark.createDataFrame(out, "kind string, part int, n long, state string")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def wipe(spark: SparkSession, path: str) -> bool:
    """Removes a table's folder; whether there was one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def restore(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a backup, or of what :func:`resume` took over."""
    rows = _backed_up(spark, f"{path}/rows" if _exists(spark, f"{path}/rows") else path)
    part = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*")
    return part("node", nodes_schema), part("edge", edges_schema)


def wide(results: DataFrame, column: str, name: str, most: int) -> DataFrame:
    """``name_1`` to ``name_most`` from an array column, nulls beyond its end."""
    return results.select(*(c for c in results.columns if c != column), *(F.try_element_at(column, F.lit(i)).alias(f"{name}_{i}") for i in range(1, most + 1)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays joined by semicolons."""
    kinds = dict(df.dtypes)
    df.select(*(F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns)).write.option("header", "true").option("escape", '"').mode("overwrite").csv(path)


def stamp(spark: SparkSession, path: str, **fields: str | int) -> None:
    """A table of one row with the time it was written."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items()), F.current_timestamp().alias("stamped_at"))
    row.coalesce(1).write.mode("overwrite").parquet(path)


def merged_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries, each canonical name once; a missing definition is taken over from the old ones."""
    first = new.groupBy("canonical").agg(*(F.first(c).alias(c) for c in new.columns if c != "canonical"))
    kept = old.select("canonical", F.col("definition").alias("_old")).dropDuplicates(["canonical"])
    return first.join(kept, "canonical", "left").withColumn("definition", F.coalesce("definition", "_old")).select(*new.columns)


def mirror(target: DataFrame, source: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The target after taking over the source, and the keys that vanish."""
    return source, target.join(source, key, "left_anti").select(key)


def image_files(images: DataFrame) -> DataFrame:
    """``name, content``: images under the first 16 digits of their hash, each once."""
    return images.select(F.concat(F.substring(F.sha2("content", 256), 1, 16), F.lit(".png")).alias("name"), "content").dropDuplicates(["name"])


def clear_collection(spark: SparkSession, path: str, collection: str) -> int:
    """Takes a collection's rows out of a table; returns how many went. Other collections are not touched."""
    n = read_collection(spark, path, collection).count()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={collection}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of a list added to those stored, each (src, type, dst) once, stored ones first."""
    rows = stored.select("src", "type", "dst").withColumn("_n", F.lit(0)).unionByName(new.select("src", "type", "dst").withColumn("_n", F.lit(1)))
    return rows.groupBy("src", "type", "dst").agg(F.min("_n").alias("_n")).select("src", "type", "dst", (F.col("_n") == 1).alias("added"))
