"""Queries of chunking, text functions, references and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grammar, lattice
from ..functions import text as tx
from ..operators import chunking, conditions, enrich, evaluate, hooks, ranges, references, tables
from ..sources.shared import scratch
from ..sources.snapshots import SnapshotStore
from ..streaming import revisions
from .registry import query
from .tables import Tables


@query("SELECT page_id, regexp_matches(url, '^[0-9]') AS is_value, lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))) AS norm, regexp_replace(url, '[^\\p{L}\\p{N}_]', '', 'g') AS label FROM pages", prelude=False)
def id_sanitize(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.read("pages").select("page_id", url.rlike("^[0-9]").alias("is_value"), tx.normalize_entity_ascii(url).alias("norm"), tx.safe_identifier(url).alias("label"))


_UNITS = ["円", "", "%", "年度", "年3月期", "牛乳", "版", "時間", "x", "年度第3四半期"]


@query("""SELECT id, regexp_matches(id, '^[0-9０-９,，.．%％~〜+±▲△一-九十百千万億兆年月日円人件台時分秒回歳割約-]+$') OR regexp_matches(id, '^(令和|平成|昭和)[0-9０-９元一-九十]*(年度?|年)?$')
    OR regexp_matches(id, '^[0-9０-９]{4}年?[0-9０-９]*月?(期|度)?(第[0-9０-９一-四]四半期)?$') AS is_value
    FROM (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN '約' WHEN 1 THEN '令和' ELSE '' END || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || (['""" + "', '".join(_UNITS) + "'])[event_id % 10 + 1] AS id FROM events)", prelude=False)
def value_flag(t: Tables) -> DataFrame:
    """Amounts of events with and without units, as node ids."""
    before = F.when(F.col("event_id") % 3 == 0, "約").when(F.col("event_id") % 3 == 1, "令和").otherwise("")
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("event_id") % 10 + 1).cast("int"))
    ids = t.read("events").select(F.concat(before, F.floor("value").cast("long").cast("string"), unit).alias("id")).distinct()
    return enrich.flag_values(ids)


_ASKED = ["割増が{}割以上の場合は", "手当をすべて列挙 {}", "年{}日以上取得できるか", "該当する条件{}は何か", "勤務時間{}は", "{}%を超える割増", "{}人と"]


@query("""SELECT event_id, CASE WHEN regexp_matches(q, '全て|すべて|全部|列挙|網羅|もれなく|漏れなく|どんな場合|どのような場合|いずれの') THEN 'enumerate_all'
    WHEN regexp_matches(q, '(以上|以下|未満|を超え|超える)') AND regexp_matches(q, '[0-9０-９]|％|%|割|倍') THEN 'rate_threshold'
    WHEN regexp_matches(q, '条件|が絡む|を含む|該当する') THEN 'condition_origin' ELSE 'none' END AS intent,
    coalesce(TRY_CAST(translate(regexp_extract(q, '([0-9０-９]+)\\s*(?:％|%|割|倍|日|円|時間|度)?\\s*(?:以上|を超え|超える|より大き)', 1), '０１２３４５６７８９', '0123456789') AS BIGINT), 0) AS threshold
    FROM (SELECT event_id, replace((['""" + "', '".join(_ASKED) + "'])[event_id % 7 + 1], '{}', translate(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '0123456789', CASE WHEN event_id % 2 = 0 THEN '０１２３４５６７８９' ELSE '0123456789' END)) AS q FROM events)", prelude=False)
def intent_classify(t: Tables) -> DataFrame:
    """Questions about the amounts of events, every other one in full-width digits."""
    number = F.floor("value").cast("long").cast("string")
    shown = F.when(F.col("event_id") % 2 == 0, F.translate(number, tx.DIGITS, tx.FULL_WIDTH_DIGITS)).otherwise(number)
    asked = F.replace(F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("event_id") % 7 + 1).cast("int")), F.lit("{}"), shown)
    return t.read("events").select("event_id", tx.condition_intent(asked).alias("intent"), tx.threshold(asked).alias("threshold"))


@query("""SELECT doc_id, sha256(source || chr(10) || text) AS chunk_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents""", prelude=False)
def content_ids(t: Tables) -> DataFrame:
    b = F.col("text").cast("binary")
    return t.read("documents").select("doc_id", tx.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"), F.md5(b).alias("md5"), F.sha1(b).alias("sha1"))


@query("""SELECT 'cf_' || substr(sha1('p' || event_id % 7 || '|' || event_type || '|' || CASE WHEN user_id % 2 = 0 THEN 'a|eq|x&b|gt|y' ELSE 'b|gt|y' END), 1, 20) AS fact_id, count(*) AS extraction_count FROM events GROUP BY ALL""", prelude=False)
def fact_ids(t: Tables) -> DataFrame:
    cond = lambda a, o, v: F.struct(F.lit(a).alias("axis"), F.lit(o).alias("op"), F.lit(v).alias("value"))
    both, one = F.array(cond("b", "gt", "y"), cond("a", "eq", "x")), F.array(cond("b", "gt", "y"))
    rows = t.read("events").select(
        F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("predicate"), F.col("event_type").alias("label"), F.col("event_type").alias("value"), F.lit(1).alias("value_num"), F.lit("").alias("unit"),
        F.lit("s").alias("source"), F.col("event_id").cast("string").alias("chunk_id"), F.when(F.col("user_id") % 2 == 0, both).otherwise(one).alias("conditions"),
    )
    return conditions.reify(rows, lambda c: c).select("fact_id", "extraction_count")


@query("""SELECT question_id, event_id, value_num FROM (
        SELECT c_custkey AS question_id, event_id, value_num, row_number() OVER (PARTITION BY c_custkey ORDER BY value_num DESC, CAST(event_id AS VARCHAR)) AS rank
        FROM customer JOIN (SELECT event_id, CAST(floor(value) AS BIGINT) AS value_num, row_number() OVER (ORDER BY floor(value) DESC, CAST(event_id AS VARCHAR)) AS n FROM events QUALIFY n <= 20)
        ON value_num >= greatest(0, CAST(floor(abs(c_acctbal)) AS BIGINT)) // 10) WHERE rank <= 20""", prelude=False)
def threshold_facts(t: Tables) -> DataFrame:
    """Every customer asks for amounts of a tenth of their balance or more."""
    none = F.array().cast("array<struct<value:string,norm_value:string>>")
    facts = t.read("events").select(F.col("event_id").cast("string").alias("fact_id"), F.lit("l").alias("label"), F.floor("value").cast("long").alias("value_num"), F.lit("%").alias("unit"), F.lit("s").alias("source"), none.alias("conditions"))
    least = F.floor(F.floor(F.abs("c_acctbal")) / 10).cast("long").cast("string")
    asked = t.read("customer").select(F.col("c_custkey").alias("question_id"), F.concat(least, F.lit("%以上の値は")).alias("text"))
    return conditions.route(asked, facts, 20).select("question_id", F.col("fact_id").cast("long").alias("event_id"), "value_num")


@query("""WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS fact_id, p_size AS value_num, p_type AS cond FROM part),
    q AS (SELECT CAST(s_suppkey AS VARCHAR) AS question_id, (['平日', '休日の場合', '深夜ー'])[s_suppkey % 3 + 1] || (['区分', '年度', '手当', '勤続'])[s_suppkey % 4 + 1] AS key FROM supplier),
    c AS (SELECT fact_id, value_num, (['平日', '休日の場合', '深夜ー'])[CAST(fact_id AS BIGINT) % 3 + 1] || (['区分', '年度', '手当', '勤続'])[CAST(fact_id AS BIGINT) % 4 + 1] || (['', '割増', '時'])[CAST(fact_id AS BIGINT) % 5 % 3 + 1] AS cond FROM f)
    SELECT question_id, fact_id FROM (SELECT question_id, fact_id, row_number() OVER (PARTITION BY question_id ORDER BY value_num, fact_id) AS rank FROM q JOIN c ON contains(cond, key)) WHERE rank <= 20""", prelude=False)
def condition_routes(t: Tables) -> DataFrame:
    """Suppliers ask about a condition; parts are facts that hold under one or a longer one."""
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))
    name = lambda key: F.concat(pick(["平日", "休日の場合", "深夜ー"], key), pick(["区分", "年度", "手当", "勤続"], key))
    k = F.col("p_partkey")
    cond = F.concat(name(k), pick(["", "割増", "時"], k % 5))
    facts = t.read("part").select(k.cast("string").alias("fact_id"), F.lit("l").alias("label"), F.col("p_size").cast("long").alias("value_num"), F.lit("").alias("unit"), F.lit("s").alias("source"), F.array(F.struct(cond.alias("value"), F.lit("").alias("norm_value"))).alias("conditions"))
    asked = t.read("supplier").select(F.col("s_suppkey").cast("string").alias("question_id"), F.concat(F.lit("A "), name(F.col("s_suppkey")), F.lit(" を含む")).alias("text"))
    return conditions.route(asked.withColumn("text", F.replace("text", F.lit(" を含む"), F.lit(" (を含む)"))), facts, 20).select("question_id", "fact_id")


@query("""WITH p AS (SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_orderkey, l_linenumber FROM lineitem),
    s AS (SELECT s_suppkey, '199' || (2 + s_suppkey % 6) || '-0' || (1 + s_suppkey % 9) || '-01' AS a, '199' || (2 + s_suppkey % 6) || '-12-' || (10 + s_suppkey % 20) AS b FROM supplier)
    SELECT s_suppkey, day, count(*) AS n FROM p JOIN s ON l_suppkey = s_suppkey AND day BETWEEN a AND b GROUP BY ALL""", prelude=False)
def section_ranges(t: Tables) -> DataFrame:
    """Shipments as sections of their supplier's document, by day as text; each supplier refers to a range of days."""
    k = F.col("s_suppkey")
    year = F.concat(F.lit("199"), (2 + k % 6).cast("string"))
    spans = t.read("supplier").select(k.alias("source"), F.concat(year, F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-01")).alias("a"), F.concat(year, F.lit("-12-"), (10 + k % 20).cast("string")).alias("b"))
    points = t.read("lineitem").select(F.col("l_suppkey").alias("source"), F.to_date("l_shipdate").cast("string").alias("section"))
    found = ranges.between(points, spans, ["source"], "section", "a", "b")
    return found.groupBy(F.col("source").alias("s_suppkey"), F.col("section").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT src, type, dst, CASE type WHEN 'PART_OF' THEN src || 'は' || dst || 'の一部である' WHEN 'USES' THEN src || 'は' || dst || 'を使用する' WHEN 'BELONGS_TO_CATEGORY' THEN src || 'は' || dst || 'に属する' ELSE src || 'は' || dst || 'を含む' END AS sentence FROM edges""")
def triple_sentences(t: Tables) -> DataFrame:
    return t.edges.select("src", "type", "dst", tx.triple_sentence(F.col("src"), F.col("type"), F.col("dst")).alias("sentence"))


@query("""SELECT doc_id, CASE WHEN source <> '' THEN source || ' > ' || lang ELSE lang END AS shown FROM documents""", prelude=False)
def chunk_sources(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", tx.chunk_source(F.col("source"), F.col("lang")).alias("shown"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""", prelude=False)
def event_windows(t: Tables) -> DataFrame:
    counts = revisions.event_counts(t.read("events"))
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", prelude=False)
def event_properties(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, 'Licensed under')) AS refusals, CAST(0 AS BIGINT) AS empty_references, 1.0::DOUBLE AS mean_references FROM documents GROUP BY source""", prelude=False)
def prediction_stats(t: Tables) -> DataFrame:
    rows = t.read("documents").select("source", F.col("text").alias("answer"), F.array("source").alias("predicted"))
    return evaluate.prediction_stats(rows, "Licensed under", ["source"])


@query("""WITH a AS (SELECT lang, lower(regexp_replace(d.text, '[\\s\\p{P}]', '', 'g')) AS p, lower(regexp_replace(b.text, '[\\s\\p{P}]', '', 'g')) AS g FROM documents d JOIN (SELECT row_number() OVER (ORDER BY item_id, text) - 1 AS at, text FROM benchmark) b ON b.at = d.doc_id % (SELECT count(*) FROM benchmark))
    SELECT lang, count(*) AS n, round(avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END), 9) AS exact, round(avg(CASE WHEN g <> '' AND contains(p, g) THEN 1.0 ELSE 0.0 END), 9) AS contained FROM a GROUP BY lang""", prelude=False)
def answer_matches(t: Tables) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id", "text")) - 1
    b = t.read("benchmark").select(at.alias("at"), F.col("text").alias("gold"))
    items = t.read("benchmark").agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("items"))
    rows = t.read("documents").join(F.broadcast(items)).select("lang", F.col("text").alias("predicted"), F.pmod("doc_id", "items").alias("at")).join(b, "at")  # one row
    return evaluate.answer_scores(rows, ["lang"]).select("lang", "n", F.round("exact", 9).alias("exact"), F.round("contained", 9).alias("contained"))


@query()
def nfkc_keys(t: Tables) -> DataFrame:
    rows = t.read("documents").select("doc_id", "text")
    norm = rows.withColumn("norm", tx.normalize_entity("text"))
    return norm.select("doc_id", "norm", tx.kana_skeleton(F.col("norm")).alias("skeleton"))


@query()
def chunk_markdown(t: Tables) -> DataFrame:
    pages = chunking.html_text(t.read("pages")).select(F.col("url").alias("source"), "text")
    return chunking.markdown_chunks(pages)


@query("""WITH n AS (SELECT greatest(1, count(*) // 50) AS pages FROM part),
    c AS (SELECT 'c' || p_partkey AS id, p_partkey % 50 AS doc, p_partkey // 50 + 1 AS page, (p_partkey // 50) * 3 % pages + 1 AS to_page, (p_partkey // 50) * 5 % pages + 1 AS to_section, pages FROM part, n),
    a AS (SELECT s.id AS src_chunk, d.id AS dst_chunk, 'page' AS kind, 'P.' || s.to_page AS ref_text FROM c s JOIN c d ON d.doc = s.doc AND d.page = s.to_page WHERE s.page % 7 <> 0
        UNION ALL SELECT s.id, d.id, 'section', '3.' || s.to_section FROM c s JOIN c d ON d.doc = s.doc AND d.page = s.to_section WHERE s.page % 7 <> 0
        UNION ALL SELECT s.id, d.id, 'section', '3.1〜3.12' FROM c s JOIN c d ON d.doc = s.doc AND '3.' || d.page BETWEEN '3.1' AND '3.12' WHERE s.page % 7 = 0)
    SELECT src_chunk, dst_chunk, kind, ref_text FROM (SELECT *, row_number() OVER (PARTITION BY src_chunk ORDER BY kind, dst_chunk) AS rank FROM a WHERE src_chunk <> dst_chunk) WHERE kind = 'page' OR rank <= 12""", prelude=False)
def reference_graph(t: Tables) -> DataFrame:
    """Parts as pages of fifty documents: each has a heading and refers to a page and to a section, or to a range of sections."""
    k = F.col("p_partkey")
    count = t.read("part").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 50)).alias("pages"))
    page = F.floor(k / 50)
    named = t.read("part").crossJoin(F.broadcast(count))  # one row
    shown = lambda c: c.cast("long").cast("string")
    one = F.concat(F.lit("P."), shown(page * 3 % F.col("pages") + 1), F.lit("を参照。\n詳細は3."), shown(page * 5 % F.col("pages") + 1), F.lit("を参照"))
    body = F.when((page + 1) % 7 == 0, "範囲は3.1〜3.12にある").otherwise(one)
    text = F.concat(F.lit("3."), shown(page + 1), F.lit(" 概要\n本文、"), body)
    chunks = named.select(F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.concat(F.lit("d"), (k % 50).cast("string")).alias("source"), (page + 1).cast("int").alias("page"), text.alias("text"))
    return references.extract(chunks, references.inventory(chunks))[0]


@query()
def embedded_chunks(t: Tables) -> DataFrame:
    return hooks.embedded(t.read("benchmark"), hooks.HashedWords(64))


@query("SELECT id, lower(id) AS norm_id, [lower(id), lower(name)] AS search_keys FROM nodes WHERE label = 'nation'")
def search_keys(t: Tables) -> DataFrame:
    nodes = t.nodes.where("label = 'nation'").select("id", F.array("name").alias("aliases"), F.col("name").alias("canonical_form"))
    return enrich.search_keys(nodes)


@query("""SELECT 'Entity: ' || c_name || chr(10) || 'Type: ' || c_mktsegment || chr(10) || 'nation: ' || c_nationkey || chr(10) || 'Context: c' || c_custkey AS text FROM customer""", prelude=False)
def entity_documents(t: Tables) -> DataFrame:
    properties = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"))
    return t.read("customer").select(tx.entity_document(F.col("c_name"), F.col("c_mktsegment"), properties, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("text"))


@query("SELECT src || '、k。' || src || ' ' || type || ' ' || dst AS text FROM edges")
def relation_documents(t: Tables) -> DataFrame:
    return t.edges.select(tx.relation_document(F.array("src", F.lit("k")), F.col("src"), F.col("type"), F.col("dst")).alias("text"))


@query("SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS words FROM part", prelude=False)
def segmented_names(t: Tables) -> DataFrame:
    """Names and types of parts written without spaces, cut by a lattice over the words of all of them."""
    words = t.read("part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word"))
    cut = lattice.tokenizer(lattice.lexicon(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))))
    joined = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_type"))
    return t.read("part").select("p_partkey", F.array_join(cut(joined), " ").alias("words"))


@query("""WITH e AS (SELECT event_id, CAST(value AS DECIMAL(18, 2)) AS v, event_id % 4 AS k FROM events)
    SELECT event_id, (['圧力', '寸法', '重量', '比率'])[k + 1] AS parameter, (['>=', '<=', '<', '>'])[k + 1] AS operator, CAST(v AS DOUBLE) AS value, (['kPa', 'mm', 'kg', '割'])[k + 1] AS unit,
        round(CAST(v AS DOUBLE) * (['1000', '0.001', '1000', '10'])[k + 1]::DOUBLE, 6) AS base_value, (['Pa', 'm', 'g', '%'])[k + 1] AS base_unit FROM e""", prelude=False)
def condition_predicates(t: Tables) -> DataFrame:
    """Amounts of events as conditions in a sentence, with decimals, every other one in full-width digits."""
    k = F.col("event_id") % 4
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (k + 1).cast("int"))
    amount = F.col("value").cast("decimal(18, 2)").cast("string")
    amount = F.when(F.col("event_id") % 2 == 0, F.translate(amount, tx.DIGITS + ".", tx.FULL_WIDTH_DIGITS + "．")).otherwise(amount)
    text = F.concat(F.lit("通常、"), pick("圧力", "寸法", "重量", "比率"), pick("が", "は", "の", "、"), amount, pick("kPa", "mm", "kg", "割"), pick("以上", "以下", "未満", "を超える"), F.lit("の場合"))
    found = t.read("events").select("event_id", F.explode(grammar.predicates(text)).alias("p")).select("event_id", "p.*")
    return found.select("event_id", "parameter", "operator", F.col("value").cast("double").alias("value"), "unit", F.round(F.col("base_value").cast("double"), 6).alias("base_value"), "base_unit")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) - 1 AS i FROM lineitem),
    r AS (SELECT l_orderkey, i, '| ' || l_orderkey || ' | ' || l_partkey || ' | ' || CAST(l_quantity AS BIGINT) || ' | ' || CASE WHEN i % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE 'q ' || i END || ' |' || CASE WHEN i = 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END AS line FROM l)
    SELECT CAST(l_orderkey AS VARCHAR) AS table_id, string_agg(line, chr(10) ORDER BY i) AS markdown FROM r GROUP BY l_orderkey""", prelude=False)
def merged_cell_tables(t: Tables) -> DataFrame:
    """An order as a table: its key beside all lines, each line's quantity in one cell or two."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_quantity")) - 1
    lines = t.read("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").cast("string").alias("q"), nth.alias("i"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("all"))
    cell = lambda n, down, across, text: F.struct(F.lit(n).alias("n"), down.cast("int").alias("row_span"), F.lit(across).alias("column_span"), text.alias("text"))
    one, i = F.lit(1), F.col("i")
    key, part = cell(0, F.col("all"), 1, F.col("l_orderkey").cast("string")), cell(1, one, 1, F.col("l_partkey").cast("string"))
    wide, narrow, note = cell(2, one, 2, F.col("q")), cell(2, one, 1, F.col("q")), cell(3, one, 1, F.concat(F.lit("q\n"), i.cast("string")))
    cells = F.concat(F.when(i == 0, F.array(key)).otherwise(F.array_remove(F.array(key), key)), F.array(part), F.when(i % 2 == 0, F.array(wide)).otherwise(F.array(narrow, note)))
    listed = lines.select(F.col("l_orderkey").alias("table_id"), i.alias("row"), F.explode(cells).alias("c")).select("table_id", "row", "c.*")
    return tables.markdown(tables.grid(tables.placed(listed)))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '^[^\n]*\n?', '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
    l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
    w AS (SELECT doc_id, line, string_split(line, ' ') AS w FROM l WHERE len(string_split(line, ' ')) > 1)
    SELECT w[1] AS src, w[2] AS dst, CAST(count(*) AS INTEGER) AS chunks FROM w GROUP BY ALL""", prelude=False)
def revisions_applied(t: Tables) -> DataFrame:
    """All documents as a first batch of revisions; then a third of them lose their first line and a seventh go; each batch comes twice."""
    store = SnapshotStore(t.spark, scratch(t.spark, "snapshots"))
    kinds = {"chunks": "chunk_id string, source string, page int, text string", "mentions": "chunk_id string, node_id string", "edges": "src string, type string, dst string, extraction_count long, source_chunks array<string>", "nodes": "id string"}
    revisions.begun(store, {name: t.spark.createDataFrame([], kind) for name, kind in kinds.items()})

    def chunker(docs: DataFrame) -> DataFrame:
        lines = docs.select("source", F.posexplode(F.split("text", "\n", -1)).alias("page", "text")).dropDuplicates(["source", "text"])
        return lines.select(tx.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"), "source", "page", "text")

    def extract(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        words = chunks.select("chunk_id", F.split("text", " ", -1).alias("w")).where("size(w) > 1")
        return words.select(F.get("w", F.lit(0)).alias("src"), F.lit("FOLLOWS").alias("type"), F.get("w", F.lit(1)).alias("dst"), "chunk_id"), words.select("chunk_id", F.get("w", F.lit(0)).alias("node_id"))

    update = revisions.applied(store, chunker, extract)
    docs = t.read("documents").select("doc_id", F.lit(1).cast("long").alias("version"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source"), "text")
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.regexp_replace("text", "^[^\n]*\n?", ""))
    changed = docs.where("doc_id % 3 = 0 OR doc_id % 7 = 0").withColumns({"version": F.lit(2).cast("long"), "text": text})
    for number, batch in ((0, docs), (0, docs), (1, changed), (1, changed)):
        update(batch, number)
    return store.tables()["edges"].select("src", "dst", F.size("source_chunks").alias("chunks"))


@query("""WITH p AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents)
    SELECT doc_id, sha256('d' || doc_id || '|' || doc_id % 90 || '|0|' || left(text, 200)) AS first_id FROM p WHERE length(text) BETWEEN 1 AND 1000""", prelude=False)
def short_pages(t: Tables) -> DataFrame:
    """Documents as pages; those that are not cut keep their text under the id of its first part."""
    pages = t.read("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), (F.col("doc_id") % 90).alias("page"), "text")
    cut = chunking.split_pages(pages)
    whole = cut.groupBy("source").agg(F.max("sub").alias("last"), F.max_by("chunk_id", -F.col("sub")).alias("first_id")).where("last = 0")
    return whole.select(F.substring("source", 2, 20).cast("long").alias("doc_id"), "first_id")

