import json

import pytest
from pyspark.sql import functions as F

from strataweave.functions import text as tx
from strataweave.operators import hooks, understanding


def model():
    """Answers in JSON, with commas, with nothing, or not at all; made here, so that workers get it by value."""

    class Model:
        def complete(self, prompts):
            out = []
            for p in prompts:
                asked = p.split("Question: ")[1]
                if "json" in asked:
                    out.append("Sure:\n```json\n" + json.dumps({"entities": ["Pump", " ", "Valve", "Pump", 7], "themes": list("abcdefgh")}) + "\n```")
                elif "list" in asked:
                    out.append("Pump, N/A , 弁 ,")
                elif "nothing" in asked:
                    out.append('{"entities": null}')
                else:
                    out.append(None)
            return out

    return Model()


def test_names_by_json_by_list_and_by_words(spark):
    rows = [(1, "json please"), (2, "list please"), (3, "nothing"), (4, "a what is x9 what"), (5, None)]
    found = {r.question_id: (r.names, r.themes, r.found_by) for r in understanding.question_entities(spark.createDataFrame(rows, "question_id int, text string"), model()).collect()}
    assert found == {
        1: (["Pump", "Valve", "7"], list("abcdef"), "json"),
        2: (["Pump", "弁"], [], "list"),
        3: ([], [], "json"),
        4: (["what", "is", "x9"], [], "words"),
        5: ([], [], "words"),
    }


def test_words_by_a_tokenizer_if_it_finds_any(spark):
    rows = spark.createDataFrame([(1, "Pump-Station!"), (2, "!! ??")], "question_id int, text string")
    found = {r.question_id: r.names for r in understanding.question_entities(rows, hooks.Unavailable(), tx.tokens).collect()}
    assert found == {1: ["pump", "station"], 2: ["!!", "??"]}


@pytest.mark.parametrize("answer, expected", [("[1, 2]", (["[1", "2]"], [], "list")), ("{bad", (["{bad"], [], "list")), ("", ([], [], "list")), (None, None), ("なし", ([], [], "list"))])
def test_odd_answers(answer, expected):
    assert understanding.read_answer(answer) == expected


def test_synonyms_are_near_entities_that_are_no_names_yet(spark):
    embedder = hooks.HashedWords(64)
    entities = hooks.embedded(spark.createDataFrame([(n,) for n in ("feed pump", "pump feed", "main valve", "Valve", "other thing")], "id string"), embedder, "id")
    rows = [(1, ["feed pump", "valve", "nobody"]), (2, []), (3, ["Valve"])]
    asked = spark.createDataFrame(rows, "question_id int, names array<string>")
    found = {r.question_id: (r.names, r.synonyms) for r in understanding.with_synonyms(asked, entities, embedder).collect()}
    assert found == {1: (["feed pump", "valve", "nobody", "pump feed", "Valve"], ["pump feed", "Valve"]), 2: ([], []), 3: (["Valve"], [])}
    few = understanding.with_synonyms(asked, entities, embedder, names=1).where("question_id = 1").head()
    assert few.synonyms == ["pump feed"]
    assert understanding.with_synonyms(asked.limit(0), entities, embedder).select(F.count(F.lit(1))).head()[0] == 0
