"""Personal data: base spans against plain patterns, reliabilities against drawn votes, what is added and what is left alone."""

import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pii, queries

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def passes(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and passes(digits), 8 <= len(digits) <= 15][kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a", "b.", "@", "1", "12", ".", "+", "-", " ", "(", ")", "4", "255", "256", "007", "é", "\n", "x@y.z", "+1 (", "5555", "1.2.3.4", "%", "4111 1111 1111 1111", "-0000"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_time_is_linear_in_long_texts():
    began = time.time()
    for piece in ["a", "1", "1 ", "1.", "@", "a@", "+1 ", "1:", "(1)", "a at b dot ", "1-", "ab:", "0.0.0.0.", "(at)"]:
        pii.found_in((piece * 400_000)[:400_000]) if piece in ("a", "1", "1-", "1.", "+1 ") else list(pii.candidates((piece * 400_000)[:400_000]))
    assert time.time() - began < 40


def test_reliabilities_are_those_of_the_drawn_votes():
    rng = np.random.default_rng(5)
    truth, right = rng.random(40_000) < 0.4, np.array([0.95, 0.9, 0.8, 0.7, 0.9, 0.6])
    voted = np.where(rng.random((40_000, 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    voted[rng.random(voted.shape) < 0.3] = 0
    kind, base = np.full(40_000, 2), np.zeros(40_000, bool)
    known = pii.estimate(kind, base, voted, np.ones(40_000))
    assert np.abs(known.favours[2, :, 1] - right).max() < 0.03 and np.abs(1 - known.favours[2, :, 0] - right).max() < 0.03
    assert abs(known.prior[2] - 0.4) < 0.03
    assert ((known.posterior(kind, voted) > 0.5) == truth).mean() > 0.9
    assert np.allclose(known.favours[0], [1 - pii.TRUST, pii.TRUST])  # a kind without candidates keeps what was believed before


ADDED = {
    "mail me: jane.roe (at) example (dot) com please": "email:9:40",
    "write to bob at example dot org now": "email:9:31",
    "tel 030 123 4567": "phone:4:16",
    "phone (212) 555-0199 or so": "phone:6:20",
    "please call 0049 30 1234567 today": "phone:12:27",
    "ip address 2001:db8:0:0:8a2e:370:7334:1 here": "ip:11:39",
    "server 10.0[.]0[.]7 is down": "ip:7:19",
    "visa 4111.1111.1111.1111 paid": "card:5:24",
    "card 3782 822463 10005 ok": "card:5:22",
}
LEFT = ["in 1999-2001 they had 1234 567 items", "order number 1234567 is 7654321", "version 1.2.3 of 20231105", "on 2023-11-05 at noon", "number 9807915762804491 fails", "we met at noon. the dot com boom", "", "x@y", "a = 12345678901234567890123"]


def test_further_spans_are_added_and_clean_texts_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = [(-i - 1, t) for i, t in enumerate([*ADDED, *LEFT])]
    found = {r["doc_id"]: r for r in pii.find(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()}
    assert [found[-i - 1]["spans"] for i in range(len(more))] == [*ADDED.values(), *[""] * len(LEFT)]
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in found.values())
    extra = [r for i, r in found.items() if i >= 0 and r["spans"] != r["base"]]
    assert len(extra) <= 2  # the prose has no data in other forms


def test_query_has_the_base_spans_of_every_whole_text(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op13_pii(spark, sf).collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        spans = plain(text[r["doc_id"]])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(filter(None, r["spans"].split(",")))


def test_edge_cases(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["word", "7", "a@b.cd", "+49 30 1234567"]) for _ in range(200_000))
    rows = [(1, "a@b.cd", "x", 1), (1, "a@b.cd", "x", 1), (2, None, None, 2), (None, "1.2.3.4", "y", 3), (3, "", "z", 4), (4, long, "w", 5), (5, "𝄞𝄞 a@b.cd", "v", 6)]
    kinds = "doc_id long, text string, spans string, N_IP int"
    got = pii.find(spark.createDataFrame(rows, kinds))
    assert got.columns == ["doc_id", "spans", "N_IP", "n_email", "n_ip_", "n_card", "n_phone", "base", "spans_"]
    found = got.collect()
    assert len(found) == 7
    by = {r["N_IP"]: r for r in found}
    assert by[1]["spans_"] == "email:0:6" and sum(r["N_IP"] == 1 for r in found) == 2
    assert by[2]["spans_"] == by[4]["base"] == "" and by[3]["spans_"] == "ip:0:7" and by[6]["base"] == "email:3:9"
    spans = plain(long)
    assert [by[5]["n_email"], by[5]["n_ip"], by[5]["n_card"], by[5]["n_phone"]] == [sum(k == j for k, _, _ in spans) for j in range(4)]
    assert pii.find(spark.createDataFrame([], kinds)).collect() == []
    assert [r["spans_"] for r in pii.find(spark.createDataFrame([(1, "no data", "x", 1)], kinds)).collect()] == [""]
