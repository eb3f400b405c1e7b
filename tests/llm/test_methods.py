"""The methods inside the operators against enumeration, differences and other solvers; what rules about rows promise."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, common, exact_dedup, exact_topk, language_id, mixing, quality, queries, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reader(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return toxicity.Restorer(toxicity.character_model(docs))


def cost(read, options):
    """Channel costs and the 4-gram model over one reading, written apart from the search."""
    total = sum(extra for _, extra, _ in options)
    symbols = [toxicity.symbol(c) for o, _, _ in options for c in o] + [0]
    history = [0, 0, 0]
    for s in symbols:
        if s or history[-1]:
            h1 = history[-1]
            h2 = history[-2] if h1 else 0
            h3 = history[-3] if h2 else 0
            total += read.lp[((h3 * 28 + h2) * 28 + h1) * 28 + s]
        history.append(s)
    return total


@pytest.mark.parametrize("token", ["1d10t", "m-o-r-o-n", "stuuupid", "$cum!!", "h3ll0", "a1!b", "t.r.@.s.h", "x", "!", "11"])
def test_search_finds_the_cheapest_of_all_readings(reader, token):
    lattice = list(reader.nodes(token))
    every = list(itertools.product(*lattice))
    found = reader.search(lattice)
    best = min(cost(reader, options) for options in every)
    assert min(cost(reader, options) for options in every if "".join(o for o, _, _ in options) == found) == pytest.approx(best, abs=1e-9)


def test_long_lattices_are_read_whole(reader, monkeypatch):
    token = "1d10t5tup1d-m0r0n" * 9
    whole = reader.search(reader.nodes(token))
    for window in (1, 2, 7, 64):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert reader.search(reader.nodes(token)) == whole
    for before in (200, 250, 255, 256, 260, 511, 512):  # places where a search that starts anew would cut the word
        assert "stupid" in reader.token("ab" * (before // 2) + "-1d10t5tup1d").replace(" ", "")


def test_blocks_change_no_reading(reader, monkeypatch):
    text = "so st u pid, an idi ot i d i o t and m 0 r 0 n s  they said " * 30 + "a b c d e " * 40
    want = reader.words(text)
    for size in (1, 10, 57, 1000):
        monkeypatch.setattr(toxicity, "BLOCK_CHARS", size)
        assert reader.words(text) == want
    assert "idiot" in want[0] and "they" in want[0]


def test_words_in_pieces_are_joined_and_plain_ones_left(reader):
    assert reader.words("st u pid")[0] == ["stupid"] and reader.words("idi ot")[0] == ["idiot"]
    assert reader.words("in to the way of a man")[0] == "in to the way of a man".split()


def test_quality_gradients_by_differences():
    rng = np.random.default_rng(2)
    model = quality.QualityModel.fresh()
    model.p = {k: v.astype(float) + 0.01 for k, v in model.p.items()}
    x, starts, y, w = rng.random((9, quality.WIDTH)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def loss():
        p = model.forward(x, starts)["p"]
        penalty = sum(quality.DECAY / 2 * (model.p[k] ** 2).sum() for k in ("e", "v", "u", "c"))
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + penalty)

    got = model.gradients(x, starts, y, w)
    for name, g in got.items():
        flat = model.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            kept = flat[i]
            flat[i] = kept + 1e-5
            above = loss()
            flat[i] = kept - 1e-5
            below = loss()
            flat[i] = kept
            assert np.reshape(g, -1)[i] == pytest.approx((above - below) / 2e-5, rel=2e-3, abs=1e-6), name


def test_quality_reads_every_passage(monkeypatch):
    model = quality.QualityModel.fresh()
    text = "".join(chr(97 + i * i % 23) + (" " if i % 6 == 0 else "") for i in range(9000))
    x = quality.passages(text)
    f = model.forward(x, np.array([0]))
    for chunk in (1, 3, 2048):
        monkeypatch.setattr(quality, "CHUNK_PASSAGES", chunk)
        score, n, at, weight = model.read(text)
        assert n == len(x) and at == int(f["a"].argmax())
        assert score == pytest.approx(float(f["p"][0]), abs=1e-3) and weight == pytest.approx(float(f["a"].max()), abs=1e-3)


def test_nearest_codeword_by_enumeration():
    for n in (2, 3, 5, 9):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n
        rng = np.random.default_rng(n)
        model = language_id.LanguageModel([str(i) for i in range(n)], code, rng.normal(size=(4, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]) + 0.1)
        x = rng.normal(size=(20, 4))
        got = model.posteriors(x)
        for row, p in zip(x, got):
            z = row @ model.weights + model.bias
            loss = [sum(t * math.log1p(math.exp(-zz * c)) for t, zz, c in zip(model.trust, z, word)) for word in code]
            assert int(p.argmax()) == int(np.argmin(loss)) and p.sum() == pytest.approx(1)


def test_domain_posteriors_against_plain_bayes(spark):
    rng = np.random.default_rng(5)
    width, d = 13, 3
    model = mixing.DomainModel(list("abc"), [0.5, 0.3, 0.2], rng.random((d, width)).tolist(), (rng.random((d, width)) * 0.1 + 0.01).tolist())
    x = rng.random((30, width))
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, f array<double>")
    got = np.array([r["p"] for r in rows.select("id", model.posteriors(F.col("f")).alias("p")).orderBy("id").collect()])
    m, v = np.array(model.means), np.array(model.variances)
    logs = np.log(model.priors) + (-0.5 * np.log(v)[None] - (x[:, None] - m[None]) ** 2 / (2 * v[None])).sum(axis=2)
    want = np.exp(logs - logs.max(axis=1, keepdims=True))
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-9)


def test_rates_reach_the_least_misfit_of_a_plain_solver(spark):
    """Targets that cannot be met: as near as many plain projected steps come."""
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([0.6] * 2, 60), rng.integers(10, 90, 60)
    a = (p * n[:, None]).T
    wanted = np.array([a[0].sum() * 0.2, a[1].sum() * 4.0])
    rate = np.ones(60)
    for _ in range(20_000):
        rate = np.maximum(0, rate - a.T @ (a @ rate - wanted) / np.linalg.norm(a, 2) ** 2)
    members = spark.createDataFrame([(i, int(t), list(map(float, q))) for i, (t, q) in enumerate(zip(n, p))], "id long, n_tokens long, posterior array<double>")
    _, reached = mixing.fit_rates(members, ["a", "b"], dict(zip("ab", map(float, wanted))))
    assert np.allclose(list(reached.values()), a @ rate, rtol=0.05, atol=0.05 * wanted.max())


def test_domains_without_a_share_keep_their_tokens(spark):
    docs = spark.createDataFrame([(i, ("der hund und die katze " if i % 3 == 0 else "the dog and the cat " if i % 3 == 1 else "EL PERRO 99 ") * (3 + i % 5)) for i in range(90)], "doc_id long, text string")
    labelled = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).cast("string").alias("domain"))
    rows = mixing.mix(docs, labelled, shares={"0": 3.0, "1": 1.0}).collect()
    tokens = {d: sum(r["n_tokens"] * r["rate"] for r in rows if r["domain"] == d) for d in "012"}
    before = {d: sum(r["n_tokens"] for r in rows if r["domain"] == d) for d in "012"}
    assert tokens["2"] == pytest.approx(before["2"], rel=0.02) and tokens["0"] / tokens["1"] == pytest.approx(3, rel=0.05)
    assert all(r["targets_met"] for r in rows)


def test_token_queries_against_the_library(spark):
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    of = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in of.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    coded = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op9_bpe_codec(spark, SF).collect()}
    assert coded == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op10_token_counts(spark, SF).collect()}
    assert counted == {i: (len(of[i].encode()), len(x), len(x) > 512) for i, x in ids.items()}


def test_a_repeated_id_loses_no_other_text(spark):
    docs = spark.createDataFrame([(1, "aa"), (1, "only here"), (2, "AA"), (3, "aa b"), (None, "aa")], "doc_id long, text string")
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    assert texts(exact_dedup.drop_exact_copies(docs)) == [(0, "aa"), (1, "only here"), (2, "AA"), (3, "aa b")]
    none = lambda norm: F.lit(b"\0")
    for digest in (exact_dedup.sha256_digest, none):
        got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, keep="max", digest=digest).collect())
        assert got == [(0, 0, 1, True), (1, 1, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert texts(simhash.drop_near_copies(docs)) == [(0, "aa"), (1, "aa"), (1, "only here"), (3, "aa b")]
    assert ("only here" in dict((t, i) for i, t in texts(simhash.drop_similar_copies(docs)))) and (0, "aa") in texts(simhash.drop_similar_copies(docs))


def test_index_lookup(spark):
    index = exact_dedup.DigestIndex(spark, keep="min", fanout=3)
    rows = spark.createDataFrame([(bytes([i % 7]), i) for i in range(50)], "digest binary, id long")
    assert index.lookup([b"\1"]).count() == 0
    for k in range(5):
        index.flush(rows.where(F.col("id") % 5 == k))
    assert [(bytes(r["digest"]), r["keep_id"], r["copies"]) for r in index.lookup([b"\1", b"\x63"]).collect()] == [(b"\1", 1, 7)]


def test_topk_of_odd_vectors(spark):
    rows = [(0, [1e12, 1.0]), (0, [1e12, 1.0]), (1, [-1e12, 2.0]), (2, [5.0, 1.0]), (3, [1.0]), (4, [1.0, 2.0]), (50, [2.0, 1.0]), (100, [3.0]), (5, [2.0]), (6, [0.5, 0.25])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id in (50, 100)")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.topk(v, asked.unionByName(asked), k=3).collect())
    inner = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    of = dict(rows)
    want = [(50, 1, 0), (50, 2, 0), (50, 3, 2), (100, 1, 5), (100, 2, 3)]  # row 0 is there twice, and counts twice
    assert got == [(q, r, i, inner(of[q], of[i])) for q, r, i in want]
    with pytest.raises(Exception, match="too large"):
        exact_topk.topk(v.unionByName(spark.createDataFrame([(9, [1e17, 0.0])], v.schema)), asked).collect()


def test_no_folder_of_this_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_words_go_on_from_where_others_began_alike():
    text = bpe.read_tokenizer(queries.tokenizer_path())
    counter, fresh = token_counts.PrefixCounter(bpe.ByteBpe(text)), token_counts.PrefixCounter(bpe.ByteBpe(text))
    asked = []

    class Asked(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    counter.lengths = Asked(counter.lengths)
    assert counter.word(b" foundations")[-1] == len(counter.bpe.merge(b" foundations"))
    asked.clear()
    for word in (b" foundationx", b" foundry", b" found", b" fou", b" founding"):
        assert counter.word(word) == [len(fresh.bpe.merge(word[:k])) for k in range(len(word) + 1)]
    assert len(asked) == 2 + 4 + 2 + 0 + 5  # one a byte before, 39
    for t in ("a, b. so  c\n d", " lead, the word.", "end ", "x\t y  z!? ok's it", "déjà, vu: 12. a;", "", " ", ",", "two  \n  gaps. here "):
        assert [0, *np.cumsum(np.frombuffer(counter.steps(t), "<i2")).tolist()] == fresh.prefixes(t)


def test_which_tokens_follow_is_told_from_their_parts():
    b = bpe.ByteBpe(bpe.read_tokenizer(queries.tokenizer_path()))
    counter = token_counts.PrefixCounter(b)
    assert counter.parts
    ids, rng = sorted(counter.ids.values()), np.random.default_rng(5)
    merged, b.merge = b.merge, None  # not asked
    pairs = [*zip(rng.choice(ids, 20_000).tolist(), rng.choice(ids, 20_000).tolist()), *((x, y) for x in ids[:80] for y in ids[:80])]
    pairs += [(ids_of[0], ids_of[1]) for w in rng.choice(ids, 5_000).tolist() for k in (1, 2, 3) if len(ids_of := [counter.ids.get(part) for part in (b.token_bytes[w][:k], b.token_bytes[w][k:])]) and None not in ids_of]
    fits = [counter.fits(x, y) for x, y in pairs]
    assert fits == [merged(b.token_bytes[x] + b.token_bytes[y]) == [x, y] for x, y in pairs] and any(fits) and not all(fits)
