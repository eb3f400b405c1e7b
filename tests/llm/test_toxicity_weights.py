"""Weights of the labelled sample of the toxicity model."""

from lectern.llm import toxicity


def test_only_near_copies_share_a_weight(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, i % 2, f"common {text(i)}") for i in range(12)]  # all share a word and nothing else
    rows += [(20 + i, 0, f"{text(99)} tail{i}") for i in range(4)] + [(30, 1, f"{text(99)} tail9")]
    got = {r["id"]: r["weight"] for r in toxicity.weighted(spark.createDataFrame(rows, "id long, label int, words string")).collect()}
    assert got == {i: 1.0 for i in range(12)} | {20 + i: 0.25 for i in range(4)} | {30: 1.0}
