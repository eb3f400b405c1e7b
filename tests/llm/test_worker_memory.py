"""What workers keep between tasks, and what crosses to the driver and the workers."""

from lectern.llm import common, language_id


def test_tables_go_when_another_operator_begins(spark):
    made = []

    def table():
        made.append(1)
        return object()

    asked = lambda: common.remembered("a", table)
    first = asked()
    common.forget_the_rest()
    assert asked() is first and made == [1]
    common.forget_the_rest()
    common.remembered("b", table)
    common.forget_the_rest()
    assert set(common._held) == {"b"}
    common.forget_the_rest()
    assert not common._held


def test_texts_are_sent_once_and_stay_in_place(spark):
    docs = spark.createDataFrame([("x", "die katze und der hund", 1), ("y", None, 2)], "source string, text string, doc_id long")
    learned = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 20)], "doc_id long, text string, lang string")
    found = language_id.identify(docs, language_id.fit(learned), keep_text=True)
    assert found.columns == ["source", "text", "doc_id", "lang_pred", "score", "ambiguous"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Project" not in plan, plan  # no second column of texts for the workers
    assert [(r["text"], r["doc_id"], r["lang_pred"]) for r in found.orderBy("doc_id").collect()] == [("die katze und der hund", 1, "de"), (None, 2, "und")]
