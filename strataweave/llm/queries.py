"""The queries of the corpus operators over the table ``documents`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, pii, quality_rules, suffix_dedup, toxicity
from .collocations import collocations
from .common import documents
from .exact_dedup import exact_duplicates
from .ngram_join import near_duplicates
from .packing import pack
from .sharding import assign_shards
from .token_counts import length_histogram, suffix_sums
from .token_files import round_trip
from .tokens import byte_bpe_path


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), 16)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(documents(spark, sf_dir), byte_bpe_path()))


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), byte_bpe_path(), 1024)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), byte_bpe_path())


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir), 400)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), words=3, min_count=10, share=50, top=2000)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), byte_bpe_path(), alignment.piece_path())


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_jump_sharding": op2_jump_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op8_sequence_packing": op8_sequence_packing,
    "op9_token_files": op9_token_files,
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op7_pii": op7_pii,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {
    "op2_jump_sharding": r"""
        WITH RECURSIVE bits AS (
            SELECT CAST(range AS BIGINT) AS n, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
            UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        walk AS (
            SELECT doc_id, CAST(doc_id AS HUGEINT) AS state, CAST(0 AS BIGINT) AS place, 0 AS shard, 0 AS grown FROM (SELECT DISTINCT doc_id FROM documents)
            UNION ALL
            SELECT doc_id, next, far, CASE WHEN far < 16 THEN far ELSE shard END, CASE WHEN far <= 16 THEN far ELSE grown END
            FROM (SELECT *, CAST(floor((place + 1) * (2147483648.0::DOUBLE / (CAST(next // 8589934592 AS DOUBLE) + 1.0))) AS BIGINT) AS far
                  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM walk WHERE place <= 16))),
        shards AS (SELECT doc_id, CAST(max(shard) AS INTEGER) AS shard, CAST(max(grown) AS INTEGER) AS grown_shard FROM walk GROUP BY doc_id),
        sized AS (
            SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
                   xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
                       lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
            FROM documents, crc)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
        FROM sized JOIN shards USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH keyed AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        ranked AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM keyed)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
    """,
    "op11_phrase_collocations": r"""
        WITH pieces AS (
            SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS words
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
        occurrences AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM pieces),
        followed AS (SELECT lang, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM occurrences WINDOW p AS (PARTITION BY piece ORDER BY place)),
        f1 AS (SELECT lang, w, CAST(count(*) AS HUGEINT) AS f FROM followed GROUP BY ALL),
        f2 AS (SELECT lang, w, w2, CAST(count(*) AS HUGEINT) AS f FROM followed WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM followed WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (
            SELECT c.lang, c.w || ' ' || c.w2 AS phrase, 2 AS size, c.f AS a, 1 AS cut, l.f AS l, r.f AS r
            FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w = c.w JOIN f1 r ON r.lang = c.lang AND r.w = c.w2
            UNION ALL
            SELECT c.lang, c.w || ' ' || c.w2 || ' ' || c.w3, 3, c.f, 1, l.f, r.f
            FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w = c.w JOIN f2 r ON r.lang = c.lang AND r.w = c.w2 AND r.w2 = c.w3
            UNION ALL
            SELECT c.lang, c.w || ' ' || c.w2 || ' ' || c.w3, 3, c.f, 2, l.f, r.f
            FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.w = c.w AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.w = c.w3),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, cut) AS place
            FROM (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts)),
        longer AS (
            SELECT lang, phrase, max(f) AS f FROM (
                SELECT lang, w || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
        ranked AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
            FROM best b LEFT JOIN longer o ON b.size = 2 AND o.lang = b.lang AND o.phrase = b.phrase
            WHERE b.place = 1 AND (o.f IS NULL OR 100 * o.f < 50 * b.a)),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
