import pytest
from pyspark.sql import functions as F

from strataweave.functions import text as tx
from strataweave.operators import chunking, conditions, hooks, references


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head()[0]


@pytest.mark.parametrize("text, expected", [("  ＡＢＣ　 Def ", "abc def"), (None, ""), ("", ""), ("①②", "12")])
def test_entity_normal_form(spark, text, expected):
    assert one(spark, text, tx.normalize_entity) == expected


def test_kana_pairs(spark):
    same = [("ガス軸受", "ガス軸受け"), ("データの連携", "データ連携"), ("サーバ", "サーバー"), ("問合せ先", "問い合わせ先"), ("取扱い", "取り扱い")]
    other = [("U7314", "U7414"), ("第3四半期", "第4四半期"), ("取締役", "監査役"), ("サーバー", "サバ"), ("", "a"), ("a", "a"), ("すべてのアプリ", "アプリ"), ("車あいうえ", "車"), (None, "車")]
    rows = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, same boolean")
    assert [tuple(r) for r in rows.where(tx.is_kana_variant("a", "b") != F.col("same")).collect()] == []


@pytest.mark.parametrize("name, value", [("210円", True), ("53", True), ("1,000", True), ("8.1%", True), ("令和6年度", True), ("2024年3月期", True), ("牛乳", False), ("第3版", False), ("53\n", False)])
def test_values(spark, name, value):
    assert one(spark, name, tx.is_value) is value


@pytest.mark.parametrize("name, value", [("本製品", True), ("その他の費用", True), ("これら", True), ("製品本体", False)])
def test_anaphora(spark, name, value):
    assert one(spark, name, tx.is_anaphor) is value


def test_headers_titles_and_spacing(spark):
    assert one(spark, "#a\n##b\n###c\n#### d", tx.space_headers) == "# a\n## b\n### c\n#### d"
    assert one(spark, "x\n## no\n# Yes it is \n# later", tx.first_title) == "Yes it is"
    assert one(spark, "事 業場 の A B", tx.japanese_spacing) == "事業場の A B"
    assert one(spark, "削 減 \n x", tx.layout_spacing) == "削減\nx"


def test_images_are_taken_out_in_order(spark):
    text = "a ![x](data:image/png;base64,aGVs\nbG8=) b ![](data:image/jpeg;base64,eA==)"
    assert [bytes(b) for b in one(spark, text, tx.embedded_images)] == [b"hello", b"x"]
    assert one(spark, text, tx.number_images) == "a [図1] b [図2]"


def test_paths_and_triples_in_words(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["R", "S"])], "n array<string>, r array<string>")
    assert row.select(tx.path_text(F.col("n"), F.col("r"))).head()[0] == "a -[R]-> b -[S]-> c"
    t = spark.createDataFrame([("x", "IS_A", "y"), ("x", "ODD", "y")], "s string, r string, o string")
    assert [r[0] for r in t.select(tx.triple_sentence(F.col("s"), F.col("r"), F.col("o"))).collect()] == ["xはyの一種である", "xとyはODDの関係にある"]


def test_markdown_chunks_carry_their_headers(spark):
    text = "# Top\nintro\n##One\nfirst\n### Deep\n" + "sentence of words. " * 80 + "\n```\n## not a header\n```\n## Two\nlast"
    rows = chunking.markdown_chunks(spark.createDataFrame([("s", text), ("t", ""), ("u", None)], "source string, text string")).collect()
    assert [(r.h2, r.h3) for r in rows][0] == (None, None) and {r.source for r in rows} == {"s"}
    assert rows[1].text.startswith("[Top > One]\n## One") and rows[-1].text == "[Top > Two]\n## Two\nlast"
    assert sum(r.h3 == "Deep" for r in rows) >= 2 and all(len(r.text) <= 1024 + 40 for r in rows)


def test_splitting_respects_size_and_overlap():
    text = "。".join(f"文{i}" * 5 for i in range(200))
    parts = chunking.split_text(text, 120, 30)
    assert all(len(p) <= 120 for p in parts) and len(parts) > 10
    assert chunking.split_text("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]


def test_figures_pages_and_html(spark):
    docs = spark.createDataFrame([("s", [(1, " cap ", "p.png"), (None, None, None)])], "source string, figures array<struct<index:int,caption:string,image_path:string>>")
    assert [r.text for r in chunking.figure_chunks(docs).collect()] == ["[図1] cap", "[図?] （キャプション生成失敗）"]
    pages = spark.createDataFrame([("s", "head\n===== Page 1 =====\nlong enough text\n===== Page 2 =====\nx")], "source string, text string")
    other = spark.createDataFrame([("s", 2, "from elsewhere")], "source string, page int, text string")
    assert [(r.page, r.text) for r in chunking.page_chunks(pages, 5, other).orderBy("page").collect()] == [(1, "long enough text"), (2, "from elsewhere")]
    html = spark.createDataFrame([("u", "<html><title>T</title><script>x()</script><h1>A &amp; B</h1><p>one<br>two</p></html>")], "url string, html string")
    r = chunking.html_text(html).head()
    assert r.title == "T" and r.text == "T\n# A & B\none\ntwo"


def test_references_are_found_and_followed(spark):
    long = "説明" * 50
    chunks = spark.createDataFrame(
        [
            ("c1", "manual", 1, "利用者ガイド\n3.2 準備\nP.3〜4を参照。3.10を参照\n" + long),
            ("c2", "manual", 2, "3.10 注意事項\n『基本操作集』をご覧ください\n" + long),
            ("c3", "manual", 3, "三頁目 " + long),
            ("c4", "manual", 4, "短い"),
            ("d1", "other", 1, "基本操作集\nネットワーク接続装置（以下「装置」という）を使う。"),
        ],
        "chunk_id string, source string, page int, text string",
    )
    found = references.inventory(chunks)
    assert {(r.section, r.chunk_id) for r in found["sections"].collect()} == {("3.2", "c1"), ("3.10", "c2")}
    assert {(r.alias, r.formal) for r in found["aliases"].collect()} == {("装置", "ネットワーク接続装置")}
    edges, docs = references.extract(chunks, found)
    assert {(r.src_chunk, r.dst_chunk, r.kind) for r in edges.collect()} == {("c1", "c3", "page"), ("c1", "c4", "page"), ("c1", "c2", "section")}
    assert {(r.chunk_id, tuple(r.ref_docs)) for r in docs.collect()} == {("c2", ("other",))}
    hits = spark.createDataFrame([(1, "manual", 1)], "question_id int, source string, page int")
    assert {r.chunk_id for r in references.follow(hits, chunks, edges).collect()} == {"c2", "c3"}


def test_conditions_are_shared_and_routed(spark):
    kind = "predicate string, label string, value string, value_num long, unit string, source string, chunk_id string, conditions array<struct<axis:string,op:string,value:string>>"
    night, holiday = ("時間帯", "eq", "深夜"), ("曜日区分", "eq", "休日")
    rows = [("割増", "割増率", "25", 25, "%", "規程", "k1", [night]), ("割増", "割増率", "25", 25, "%", "規程", "k2", [night]), ("割増", "割増率", "60", 60, "%", "規程", "k1", [night, holiday]), ("休暇", "休暇", "有", -1, None, "規程", "k3", [holiday])]
    facts = conditions.reify(spark.createDataFrame(rows, kind)).cache()
    assert sorted((r.value_num, r.extraction_count, len(r.conditions)) for r in facts.collect()) == [(-1, 1, 1), (25, 2, 1), (60, 1, 2)]
    assert conditions.fact_conditions(facts).select("cond_id").distinct().count() == 2
    asked = spark.createDataFrame([(1, "50%以上の割増は"), (2, "休日 の条件を全て列挙"), (3, "天気は")], "question_id int, text string")
    routed = conditions.route(asked, facts).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.value_num) for r in routed] == [(1, 60), (2, -1), (2, 60)]
    text = {r.question_id: r.block for r in conditions.block(conditions.route(asked, facts)).collect()}
    assert text[1] == "<CONDITION_FACTS>\n- 割増率: 60% （条件: 休日 かつ 深夜） [出典: 規程]\n</CONDITION_FACTS>"


def test_only_reading_statements_run(spark):
    spark.range(1000).createOrReplaceTempView("numbers")
    assert hooks.read_only_sql(spark, "```sql\nSELECT id FROM numbers\n```").count() == 500
    for bad in ("DROP TABLE numbers", "SELECT 1; SELECT 2", "INSERT INTO numbers VALUES (1)", "SHOW TABLES"):
        with pytest.raises(ValueError):
            hooks.read_only_sql(spark, bad)


@pytest.mark.parametrize("text, value", [("三十五", 35), ("百二十", 120), ("二千二十四", 2024), ("一億二千万", 120_000_000), ("１２", 12), ("1,000", 1000), ("十", 10), ("二〇二四", 2024), ("零", 0), ("本", None), ("", None), (None, None)])
def test_numbers_in_chinese_characters(text, value):
    assert tx.kanji_value(text) == value


def test_long_pages_are_cut_and_keep_their_number(spark):
    long = "。".join(f"文{i}は続く" for i in range(300))
    pages = spark.createDataFrame([("f.pdf", 1, "  short  "), ("f.pdf", 2, long), ("f.pdf", 3, " \n "), ("f.pdf", 4, None), ("f.pdf", 5, "x" * 2500)], "source string, page int, text string")
    found = chunking.split_pages(pages, 1000, 80).orderBy("page", "sub").collect()
    by_page = {n: [r for r in found if r.page == n] for n in range(1, 6)}
    assert [(r.sub, r.text) for r in by_page[1]] == [(0, "short")] and not by_page[3] and not by_page[4]
    assert [r.sub for r in by_page[2]] == list(range(len(by_page[2]))) and len(by_page[2]) >= 3
    assert all(len(r.text) <= 1000 for r in found) and all(f"文{i}は" in "".join(r.text for r in by_page[2]) for i in range(300))
    assert len(by_page[5]) >= 3 and len({r.chunk_id for r in found}) == len(found)

