"""Operators against plain loops, library encoders and held-out labels."""

import hashlib
import os
import random
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import bpe, components, exact_dedup, exact_topk, mixing, queries, sharding, simhash, token_counts, toxicity
from lectern.llm.common import durable

SF = "/root/testdata/sf0.01"


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def word_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def one_of_each(texts):
    """The smallest id of each group that fingerprints within two bits or five-word sets of similarity 0.8 or more connect."""
    sets = {i: word_set(t) for i, t in texts.items()}
    fps = {i: simhash.fingerprint_bytes((t or "").encode()) for i, t in texts.items()}

    def near(a, b):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            return True
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small * 5 < large * 4:
            return False
        c = len(sets[a] & sets[b])
        return c * 5 >= 4 * (small + large - c)

    ids = sorted(texts)
    return sorted(set(groups(ids, [(a, b) for a in ids for b in ids if a < b and near(a, b)]).values()))


def test_exact_dedup_against_a_loop_and_under_collisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = texts(spark)
    by = {}
    for i, t in of.items():
        by.setdefault(lower(t), []).append(i)
    want = {i: (max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    few_bits = lambda norm: F.unhex(F.left(F.sha2(norm.cast("binary"), 256), F.lit(2)))
    for digest in (exact_dedup.sha256_digest, few_bits):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, keep="max", digest=digest).collect()}
        assert got == want


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op7_exact_dedup"]).fetchall())
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in queries.op7_exact_dedup(spark, SF).collect())
    assert got == want


def test_fingerprints_and_components_against_a_loop(spark):
    of = texts(spark, "/root/testdata/sf0.001")
    fps = {}
    for i, t in of.items():
        words = [w for w in lower(t).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    ids = sorted(fps)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: r for r in queries.op5_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert {i: int(got[i]["fingerprint"], 16) for i in ids} == fps and {i: got[i]["component_id"] for i in ids} == want


@pytest.mark.parametrize("limit", [64, 2])
def test_links_find_every_pair_within_two_bits(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "POINT_LIMIT", limit)
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    for f in list(fps):
        for flips in (1, 2, 2, 3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), flips)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(signed.index(r["u"]), signed.index(r["v"])) for r in simhash.links(table).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in edges)
    n = range(len(fps))
    assert groups(n, edges) == groups(n, [(a, b) for a in n for b in n if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tables = bpe.ByteBpe(bpe.read_tokenizer(path))
    return Tokenizer.from_file(path), tables, bpe.Encoder(tables), token_counts.PrefixCounter(tables)


PIECES = st.lists(st.sampled_from([*"abcdeé ß'  \n\t.!?<|>12٣😀 ", "'re", "'s", "the ", "<|endoftext|>", "ing", "  ", "x" * 40]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=60)))
def test_codec_and_counts_equal_the_library(codec, text):
    library, tables, encoder, counter = codec
    ids = library.encode(text, add_special_tokens=False).ids
    own = np.frombuffer(encoder.encode(text), "<u4").tolist()
    steps = counter.steps(text)
    assert own == ids and sum(n for _, n in counter.pieces(text)) == len(ids) and tables.decode(own) == library.decode(ids, skip_special_tokens=False)
    prefixes = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
    assert counter.prefixes(text) == prefixes and np.cumsum(np.frombuffer(steps, "<i2")).tolist() == prefixes[1:]
    whole, token_counts.BLOCK_CHARS = token_counts.BLOCK_CHARS, 3
    try:
        assert counter.steps(text) == steps
    finally:
        token_counts.BLOCK_CHARS = whole
    for budget in (0, 1, 5):
        assert token_counts.read_budget(steps, budget) == (len(ids), max(k for k, n in enumerate(prefixes) if n <= budget))


def test_long_words(codec):
    library, _, encoder, counter = codec
    rng = random.Random(1)
    for text in ("a" * 5000, "".join(rng.choice("abcéß") for _ in range(3000)), "!?" * 900):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids and token_counts.read_budget(counter.steps(text), 9)[0] == len(ids)


def test_topk_against_numpy(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op8_exact_topk(spark, SF).collect())
    rows = con.sql("select vec_id, embedding from embeddings order by 1").fetchall()
    x = np.floor(np.array([r[1] for r in rows], float) * 256).astype(np.int64)
    ids, want = np.array([r[0] for r in rows]), []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        want += [(int(ids[q]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert got == sorted(want)
    assert got == sorted(con.sql(queries.oracle_sql()["op8_exact_topk"]).fetchall())


def test_long_texts_are_encoded_and_decoded_in_bounded_memory():
    """50 MB of text in a process of its own: beside text, ids and decoded text little is held."""
    code = """
import resource, sys
sys.path.insert(0, %r)
from lectern.llm import bpe, queries
made = bpe.ByteBpe(bpe.read_tokenizer(queries.tokenizer_path()))
encoder, line = bpe.Encoder(made), "Some words of a longer text, 1234 of them; and so on.  \\n"
text = line * (50_000_000 // len(line))
packed = encoder.encode(text)
assert made.decode_packed(packed) == text and packed[:4000] == encoder.encode(text[:20000])[:4000]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
""" % os.path.dirname(os.path.dirname(bpe.__file__.replace("/llm/bpe.py", "/x")))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "a", "don't", "\n", " \n ", "é", "𝄞", "12", "<|endoftext|>", "\u00a0", "?!", "\x1c"]), max_size=60).map("".join))
def test_blocks_change_no_id(text):
    own = bpe.ByteBpe(bpe.read_tokenizer(queries.tokenizer_path())) if not _OWN else _OWN[0]
    _OWN[:] = [own]
    library = Tokenizer.from_file(queries.tokenizer_path())
    for size in (1, 3, 1 << 18):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bpe, "BLOCK_CHARS", size)
            m.setattr(bpe, "BLOCK_IDS", size)
            packed = bpe.Encoder(own).encode(text)
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            assert own.decode_packed(packed) == library.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False)


_OWN: list = []


def test_topk_over_many_shards_with_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (900, 4)) / 4
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in exact_topk.topk(v, v.where("vec_id % 50 = 0"), shard_rows=100).collect())
    y, want = np.floor(x * 256).astype(np.int64), []
    for q in range(0, 900, 50):
        s = y @ y[q]
        want += [(q, k + 1, int(j)) for k, j in enumerate([j for j in np.lexsort((np.arange(900), -s)) if j != q][:5])]
    assert got == sorted(want)


def test_topk_counts_every_row_that_repeats_an_id(spark):
    rng = np.random.default_rng(7)
    rows = [(i, list(map(float, rng.integers(-2, 3, 4) / 4))) for i in range(300)]
    rows += rows[:40] + [(i, list(map(float, rng.integers(-2, 3, 4) / 4))) for i in range(60)] + [(77, [0.5, 0.5, 0.5, 0.5])] * 150
    got = exact_topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame([r for r in rows if r[0] % 50 == 0], "vec_id long, embedding array<float>"), shard_rows=64)
    whole, want = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows], []
    for q in range(0, 300, 50):
        asks = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks, v)), i) for i, v in whole if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_sends_a_tree_once_for_many_queries(spark, monkeypatch):
    """The home visit moves at most shards x ceil(queries of the cell / block) trees, however many queries there are in all."""
    moved, plain = [], exact_topk.durable
    monkeypatch.setattr(exact_topk, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(exact_topk, "durable", lambda df, name: moved.append((name, df)) or plain(df, name))
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, list(map(float, rng.normal(size=6)))) for i in range(3000)], "vec_id long, embedding array<float>")
    exact_topk.topk(v, v.where("vec_id % 5 = 0"), shard_rows=200).collect()
    homes = next(df for name, df in moved if name == "query-homes")
    queries_of = {r["cell"]: r["count"] for r in homes.groupBy("cell").count().collect()}
    groups = homes.groupBy("cell", "slice", "block").count().count()
    assert len(queries_of) > 4 and groups <= sum(-(-n // 40) for n in queries_of.values())


def accuracy(rows, threshold, key):
    return np.mean([(r["score"] >= threshold) == bool(r[key]) for r in rows])


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = queries.op1_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert accuracy(toxic, 0.7, "toxic") > 0.97
    good = queries.op3_quality_mil(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert accuracy(good, 0.3, "quality") > 0.98
    langs = queries.op4_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in langs]) > 0.99


def test_disguised_words_are_restored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    read = toxicity.Restorer(toxicity.character_model(docs))
    for plain, hidden in (("idiot", "1d10t"), ("idiot", "i d i o t"), ("moron", "m-o-r-o-n"), ("stupid", "stuuuupid"), ("clown", "cl0wn!!"), ("scum", "$cum"), ("trash", "t.r.@.s.h"), ("loser", "LLOOSSERRR")):
        assert toxicity.plain_form(plain) in [toxicity.plain_form(w) for w in read.words(hidden)[0]], hidden
    assert read.words("The quiet words, as they are.")[0] == ["the", "quiet", "words", "as", "they", "are"]


def test_rates_meet_reachable_targets_and_stay_nonnegative(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 400)
    n = rng.integers(1, 900, 400)
    members = spark.createDataFrame([(i, int(a), list(map(float, b))) for i, (a, b) in enumerate(zip(n, p))], "id long, n_tokens long, posterior array<double>")
    have = (n[:, None] * p).sum(axis=0)
    rated, reached = mixing.fit_rates(members, ["a", "b", "c"], {"a": have[0] * 0.3, "b": have[1] * 1.5})
    rates = np.array([r["rate"] for r in rated.orderBy("id").collect()])
    assert (rates >= 0).all()
    assert np.allclose((rates[:, None] * n[:, None] * p).sum(axis=0), [have[0] * 0.3, have[1] * 1.5, have[2]], rtol=0.01)
    assert np.allclose(list(reached.values()), (rates[:, None] * n[:, None] * p).sum(axis=0))


def test_query_mix_meets_its_shares(spark):
    rows = queries.op2_mixing(spark, "/root/testdata/sf0.1").collect()
    total = sum(r["rate"] * r["n_tokens"] for r in rows)
    for name, share in queries.MIX_SHARES.items():
        assert abs(sum(r["rate"] * r["n_tokens"] for r in rows if r["domain"] == name) / total - share) < 0.02


def test_shards_keep_every_row_through_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((i, t) for i, t in texts(spark).items())
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=400_000)
    for k in range(6):
        store.append(docs.where(F.col("doc_id") % 6 == k).repartition(3))
    before = store.versions()
    store.compact()
    for version in (before[-1], store.versions()[-1]):
        assert sorted((r["doc_id"], r["text"]) for r in store.read(version).collect()) == want
    assert store.manifest().count() < store.manifest(before[-1]).count()
    assert sorted((r["doc_id"], r["text"]) for r in store.read(before[2]).collect()) == [w for w in want if w[0] % 6 < 3]
    assert store.vacuum() > 0 and sorted(r["doc_id"] for r in store.read().collect()) == [i for i, _ in want]
    last, runs = store.versions()[-1], store._pointer(store.versions()[-1])["runs"]
    assert len(runs) < 4 and sum(r["shards"] for r in runs) == store.manifest().count()
    with pytest.raises(RuntimeError):  # a second writer that began from the version before
        store._commit(store.manifest(), docs.schema, last - 1, runs)
    assert store.versions()[-1] == last
    rival = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=400_000)
    with ThreadPoolExecutor(2) as both:
        tries = [both.submit(s._commit, s.manifest(), docs.schema, last, runs) for s in (store, rival)]
    assert sorted(t.exception() is None for t in tries) == [False, True] and store.versions()[-1] == last + 1


def test_query_of_sharding_merges_tiers_into_files_near_the_target(spark):
    rows = queries.op6_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts(spark))
    assert {(r["merges"] >= 2, r["runs"] <= sharding.ARRIVALS / 2, r["version"] == sharding.ARRIVALS + r["merges"]) for r in rows} == {(True, True, True)}
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert all(len(held) == held[0]["shard_rows"] and min(r["doc_id"] for r in held) == shard for shard, held in shards.items())
    sizes = sorted(held[0]["shard_bytes"] for held in shards.values())
    assert 2 <= len(sizes) <= sharding.ARRIVALS and rows[0]["merged_shards"] >= 6 and max(sizes) < 0.5 * sum(sizes)
    assert {r["tier"] for r in rows} != {0}


def test_tiers_merge_as_the_rule_says(spark, tmp_path):
    """Equal arrivals: every fourth merges its tier, and the runs are always those of the counter in base 4."""
    docs = spark.range(64 * 17).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string").cast("binary"), 512).alias("text"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 40)
    for k in range(17):
        store.append(docs.where(F.col("doc_id") % 17 == k).coalesce(1))
        merges = store.compact()
        digits, n = 0, k + 1
        while n:
            digits, n = digits + n % 4, n // 4
        runs = store._pointer(store.versions()[-1])["runs"]
        assert len(runs) == digits and len(merges) == (0 if (k + 1) % 4 else 1 if (k + 1) % 16 else 2)
        assert all(m["runs_in"] == 4 for m in merges)
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(64 * 17))


def test_a_writer_that_died_before_it_filled_its_pointer_blocks_nobody(spark, tmp_path, monkeypatch):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.append(docs) == 1
    store.fs.create(store._path(f"file://{tmp_path}/s/versions/0000000002"), False).close()
    assert store.versions() == [1] and store.read().count() == 10
    with pytest.raises(RuntimeError):  # it may still be at work
        store.append(docs)
    monkeypatch.setattr(sharding, "DEAD_SECONDS", 0.0)
    assert store.append(docs) == 2 and store.versions() == [1, 2] and store.read().count() == 20


def test_store_without_a_version(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/none")
    assert store.compact() == [] and store.read() is None and store.manifest() is None and store.vacuum() == 0 and sharding.placements(store) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, durable(stage(spark, at, SF), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
            assert all(rows[r["doc_id"]] == r for r in at.collect())
        if name == "exact dedup":
            keep = {}
            for r in before.collect():
                keep[lower(r["text"])] = max(r["doc_id"], keep.get(lower(r["text"]), -1))
            assert sorted(keep.values()) == sorted(r["doc_id"] for r in at.collect())
        if name == "SimHash near-dedup":
            assert sorted(r["doc_id"] for r in at.collect()) == one_of_each({r["doc_id"]: r["text"] for r in before.collect()})
    assert all(r["decoded"] == rows[r["doc_id"]]["text"] for r in at.collect())
