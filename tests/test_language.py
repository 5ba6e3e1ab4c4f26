import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strataweave.functions import grammar, lattice
from strataweave.operators import retrieval, tables
from strataweave.operators.keyword_index import KeywordIndex

WORDS = [("東京", 3000, "noun", None), ("京都", 3000, "noun", None), ("東", 4000, "noun", None), ("都", 3500, "suffix", None), ("に", 500, "particle", None), ("住む", 3000, "verb", "住む"), ("住ん", 3000, "verb", "住む"), ("で", 600, "particle", None), ("いる", 900, "aux", "居る"), ("サーバ", 2500, "noun", "サーバー"), ("サーバー", 2500, "noun", None), ("ab", 100, "noun", None), ("abc", 250, "noun", None), ("c", 90, "noun", None)]
JOINS = {("noun", "suffix"): -500, ("particle", "particle"): 4000, ("", "suffix"): 2000}


def cheapest(held, text):
    """The cost of the cheapest way through a text, of all ways."""
    kinds = [lattice._kind(c) for c in text]

    def run_end(i):
        j = i
        while j < len(text) and kinds[j] == kinds[i]:
            j += 1
        return j

    def ways(i, before):
        if i == len(text):
            yield 0
            return
        for end, cost, kind, _ in held.edges(text, i, run_end(i)):
            for rest in ways(end, kind):
                yield cost + held.joins.get((before, kind), 0) + rest

    return min(ways(0, ""))


def price(held, text, path):
    """What a path costs, its words in the cheapest kinds."""
    best, at = {"": 0}, 0
    for surface, normal in path:
        found = {}
        for end, cost, kind, own in held.edges(text, at, at + len(surface)):
            if end == at + len(surface) and own == normal:
                found[kind] = min(found.get(kind, 10**9), min(c + held.joins.get((b, kind), 0) for b, c in best.items()) + cost)
        best, at = found, at + len(surface)
    assert at == len(text)
    return min(best.values())


@pytest.mark.parametrize("joins", [None, JOINS])
def test_path_is_the_cheapest_of_all(joins):
    held = lattice.Lattice(WORDS, joins)
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("東京都に住むんでいるサーバーabc1x") for _ in range(rng.randint(1, 8)))
        assert price(held, text, held.path(text)) == cheapest(held, text)
    assert held.path("") == []


def test_tokens_are_normal_forms_without_stop_words(spark):
    cut = lattice.tokenizer(spark.createDataFrame(WORDS, "surface string, cost int, kind string, normal string"))
    rows = spark.createDataFrame([("東京都に住んでいる。",), ("ＡＢＣ　サーバ サーバー",), (None,), ("",), ("！？",)], "t string")
    found = [r.w for r in rows.select(cut(F.col("t")).alias("w")).collect()]
    assert found == [["東京", "都", "住む"], ["ab", "c", "サーバー", "サーバー"], [], [], []]
    with pytest.raises(ValueError):
        lattice.tokenizer(spark.createDataFrame(WORDS, "surface string, cost int, kind string, normal string"), most=3)


def test_lattice_serves_a_keyword_index(spark):
    cut = lattice.tokenizer(spark.createDataFrame(WORDS, "surface string, cost int, kind string, normal string"))
    docs = spark.createDataFrame([(1, "東京に住む"), (2, "京都のサーバ"), (3, "サーバーで"), (4, "別の文"), (5, "文"), (6, "")], "id long, text string")
    asked = spark.createDataFrame([("a", "サーバー"), ("b", "東京で住んでいる")], "question_id string, text string")
    found = {(r.question_id, r.id) for r in KeywordIndex.build(docs, tokenizer=cut).search(asked, 5, cut).collect()}
    assert found == {("a", 2), ("a", 3), ("b", 1)}
    assert found == {(r.question_id, r.id) for r in retrieval.bm25_scores(docs, asked, cut).collect()}


def test_long_text_is_cut_in_time():
    held = lattice.Lattice(WORDS)
    assert len(held.tokens("東京都に住む" * 20_000, frozenset(), 1)) == 80_000
    assert held.tokens("x" * 3_000, frozenset(), 1) == ["x" * 3_000]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("設計圧力が０．２MPa以上の場合", [("設計圧力", ">=", "0.2", "MPa", "200000", "Pa")]),
        ("内径1,500.25ミリメートルを超え、温度は四十五度以下", [("内径", ">", "1500.25", "ミリメートル", "1.50025", "m"), ("温度", "<=", "45", "度", "45", "度")]),
        ("三・五割以上", [("?", ">=", "3.5", "割", "35", "%")]),
        ("従業員2万人超える。", [("従業員", ">", "20000", "人", "20000", "人")]),
        ("濃度 5‰未満 and pH 7以上", [("濃度", "<", "5", "‰", "0.5", "%")]),
        ("容量（TankA） 百二十リットル以下", [("TankA", "<=", "120", "リットル", "120", "L")]),
        ("千二百三十四万五千年以上", [("?", ">=", "12345000", "年", "12345000", "年")]),
        ("10以上", []),
        ("", []),
        (None, []),
    ],
)
def test_predicates(text, expected):
    found = [(p["parameter"], p["operator"], p["value"], p["unit"], p["base_value"], p["base_unit"]) for p in grammar.parse(text)]
    assert found == [(a, b, Decimal(c), d, Decimal(e), f) for a, b, c, d, e, f in expected]


def test_predicates_in_a_table(spark):
    rows = spark.createDataFrame([(1, "長期荷重が12.5kg以上"), (2, None), (3, "何も")], "id int, text string")
    found = rows.select("id", F.explode(grammar.predicates(F.col("text"))).alias("p")).select("id", "p.*").collect()
    assert [(r.id, r.parameter, r.value, r.base_value, r.base_unit) for r in found] == [(1, "長期荷重", Decimal("12.5"), Decimal(12500), "g")]


def occupied(rows):
    """A table's grid from its rows of (down, across, text), place by place."""
    taken = {}
    for r, row in enumerate(rows):
        c = 0
        for down, across, text in row:
            while any((r, c + i) in taken for i in range(across)):
                c += 1
            for i in range(down):
                for j in range(across):
                    taken[r + i, c + j] = text
            c += across
    return taken


def test_merged_cells_fill_their_places(spark):
    rng = random.Random(7)
    cells, expected = [], {}
    for table in range(25):
        rows = [[(rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2]), f"{table}-{r}-{n}") for n in range(rng.randint(0, 4))] for r in range(rng.randint(1, 5))]
        cells += [(str(table), r, n, down, across, text) for r, row in enumerate(rows) for n, (down, across, text) in enumerate(row)]
        for (r, c), text in occupied(rows).items():
            expected[str(table), r, c] = text
    frame = spark.createDataFrame(cells, "table_id string, row int, n long, row_span int, column_span int, text string").repartition(4)
    found = {(x.table_id, x.row, x["column"]): x.text for x in tables.grid(tables.placed(frame)).collect()}
    assert {k: v for k, v in found.items() if v} == expected


def test_cells_with_places_sizes_and_markdown(spark):
    kind = "table_id string, row int, column int, row_span int, column_span int, text string"
    cells = [("t", 0, 0, 1, 2, "a\nb"), ("t", 1, 0, 2, None, " c "), ("t", 1, 1, 1, 1, None), ("t", 2, 1, 5, 5, "d"), ("t", None, 0, 1, 1, "gone"), ("u", 0, 0, 1, 1, "x"), ("v", 0, 0, 1, 1, "no size")]
    sizes = spark.createDataFrame([("t", 3, 2), ("u", 1, 2), ("v", None, 2)], "table_id string, row_count int, column_count int")
    found = {r.table_id: r.markdown for r in tables.markdown(tables.grid(spark.createDataFrame(cells, kind), sizes)).collect()}
    assert found == {"t": "| a b | a b |\n| --- | --- |\n| c |  |\n| c | d |", "u": "| x |  |\n| --- | --- |"}
    assert tables.markdown(tables.grid(spark.createDataFrame([], kind))).count() == 0
