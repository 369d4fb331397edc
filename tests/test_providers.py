import pytest
from pyspark.sql import functions as F

from codexlake.operators.aggregates import answer_agreement
from codexlake.sources import providers


def test_vectors_depend_on_the_text_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string").repartition(3)
    got = {r.id: r.v for r in providers.served(df, "text", providers.stub_vectors(8), "v", "array<double>", batch_rows=1).collect()}
    assert got[1] == got[3] != got[2] and got[4] is None and sum(x * x for x in got[2]) == pytest.approx(1)


def test_samples_feed_agreement(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    asked = providers.served(df, "text", providers.stub_samples(["Yes.", " yes ", "no"], 9), "answers", "array<string>")
    row = answer_agreement(asked.select("id", F.explode("answers").alias("answer")), "id", "answer").first()
    assert row.n_samples == 9 and row.distinct_answers <= 2 and row.majority_answer in ("yes", "no")


def test_a_service_has_to_answer_every_question(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(Exception, match="0 answers to 1"):
        providers.served(df, "text", lambda: lambda texts: [], "v", "string").collect()


def test_a_service_is_asked_again_and_then_its_fallback(spark):
    calls = []

    def flaky(fails):
        def make():
            def answer(texts):
                calls.append(len(texts))
                if len(calls) <= fails:
                    raise ConnectionError("busy")
                return [f"first {t}" for t in texts]

            return answer

        return make

    def second():
        return lambda texts: [f"second {t}" for t in texts]

    pauses = []
    assert providers.resilient(flaky(2), second, pause=pauses.append)()(["a"]) == ["first a"] and pauses == [0, 1]
    calls.clear()
    assert providers.resilient(flaky(9), second, tries=2)()(["a"]) == ["second a"] and len(calls) == 2
    calls.clear()
    with pytest.raises(ConnectionError):
        providers.resilient(flaky(9))()(["a"])
    table = spark.createDataFrame([("x",), (None,)], "t string")
    got = providers.served(table, "t", providers.resilient(lambda: (lambda texts: 1 / 0), second), "answer", "string").collect()
    assert {(r.t, r.answer) for r in got} == {("x", "second x"), (None, "second None")}
