"""Near copies by word sets against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import one_of_each

from lectern.llm import components, exact_dedup, simhash, similar


@pytest.mark.parametrize("limit", [32, 3])
@pytest.mark.parametrize("line", ["", "one common line that opens every single text of this table. "])
def test_crowds_chains_and_odd_texts(spark, line, limit, monkeypatch):
    monkeypatch.setattr(similar, "GROUP_LIMIT", limit)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = {1: None, 2: "", 3: " \t\n", 4: "Two words", 5: "two\x0bWORDS ", 6: "two words more", 7: "É b c d e", 8: "é b c d e"}
    for start in range(100, 1000, 150):
        base = [word() for _ in range(rng.choice([12, 60, 150]))]
        for i in range(start, start + 60):  # a crowd, and from it a walk away that only neighbours connect
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            texts[i] = line + " ".join(copy)
            if i % 3 == 0:
                base = copy
    got = simhash.drop_similar_copies(spark.createDataFrame([*texts.items(), (None, "two words")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == one_of_each(texts)
    assert got.where("doc_id is null").count() == 1 and simhash.drop_similar_copies(got.limit(0)).count() == 0


def test_repeated_ids_lose_no_link(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near, nearer = base.replace("word30 ", "other "), base.replace("word30 ", "other ").replace("word50", "third")
    rows = [(1, base), (2, base), (2, "something else that is said by nobody but this one text"), (3, near), (4, nearer), (4, "alone in all respects and ways"), (4, "alone in all respects and ways")]
    got = sorted(map(tuple, simhash.drop_similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([rows[0], rows[2], rows[5], rows[6]])


def test_rows_that_repeat_both_id_and_text_are_one_document(spark):
    rows = [(4, "", 1), (4, "", 2), (4, "x y", 3), (5, "X y", 4), (5, "x Y", 5), (None, "x y", 6), (None, "x y", 7), (6, None, 8)]
    got = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, drop_id int"))
    assert got.columns == ["doc_id", "text", "drop_id"]
    assert sorted((r["doc_id"], (r["text"] or "").lower()) for r in got.where("doc_id is not null").collect()) == [(5, "x y"), (6, "")]
    assert got.where("doc_id is null").count() == 2


def test_crowds_end_without_pairs_of_all_their_members(spark, monkeypatch):
    """A passage in every text, and a second one in half of them: groups go on beyond their pivots until none is crowded."""
    monkeypatch.setattr(similar, "GROUP_LIMIT", 4)
    rng = random.Random(5)
    first, second = ([f"{c}{i}" for i in range(40)] for c in "pq")
    seen, plain = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, texts: seen.append(pairs.count()) or plain(pairs, texts))
    texts = {i: " ".join([*first, *(second if i % 2 else []), *[f"own{rng.randrange(10**9)}" for _ in range(12)]]) for i in range(120)}
    got = simhash.drop_similar_copies(spark.createDataFrame([*texts.items()], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == one_of_each(texts)
    assert max(seen) < 120 * 119 / 2


def test_parities_never_differ_in_more_bits_than_sets_in_members(spark):
    rng = np.random.default_rng(3)
    rows, apart = [], []
    for n, gone, new in [(1, 0, 0), (1, 1, 1), (2, 0, 1), (60, 6, 7), (64, 0, 1), (64, 1, 0), (500, 20, 60), (1000, 0, 200), (3000, 300, 300), (3000, 3000, 3000)]:
        a = rng.integers(0, 1 << 56, n, dtype=np.uint64)
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 56, new, dtype=np.uint64)])
        rows.append((len(rows), similar.parity(a).tolist(), similar.parity(b).tolist()))
        apart.append(gone + new)
    pairs = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    for x, y in ("ab", "ba"):
        bits = [r["d"] for r in pairs.select("i", similar.bits_apart(F.col(x), F.col(y)).alias("d")).orderBy("i").collect()]
        assert all(d <= n and (n - d) % 2 == 0 for d, n in zip(bits, apart)) and bits[0] == 0
        assert bits[-1] > 2 * 3000 / 9  # nothing in common: ruled out


def test_texts_are_not_dealt_out_to_drop_a_few(spark):
    """However small the tables are that Spark itself would broadcast."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base.replace("word30 ", "other ")), (3, "alone in all respects and ways")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simhash.drop_similar_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_few_edges_are_connected_without_shuffles(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    plans, plain = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(100, 200), (300, 200), (7, 7), (-5, 100)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 10 * ((i - 1) // 10) + 1 for i in range(1, 41)} | {n: -5 for n in (-5, 100, 200, 300)}
    assert dict(map(tuple, got.collect())) == want and got.count() == len(want)
    assert len(plans) > 2 and all(("Exchange hashpartitioning" in p) == (few == 0) for p in plans[1:])
