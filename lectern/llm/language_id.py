"""Language identification with error-correcting output codes over byte n-grams.

Every language gets a codeword; for each bit a logistic classifier over hashed byte trigrams predicts its value. A
text is decoded to the language of least weighted logistic loss over all bits, bits that train better counting more.
If the runner-up comes close, the row is flagged as ambiguous.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_texts, sweep
from .linear import Adam, sample_labelled, sigmoid, trigram_buckets

BITS = 13
#: Labelled documents to fit on, over all languages.
SAMPLE_DOCS = 1600
STEPS, RATE, DECAY = 200, 0.2, 1e-5
#: A text is ambiguous if its best and second posterior differ by less.
MARGIN = 0.2
NO_LANGUAGE = "und"


def codewords(n: int) -> np.ndarray:
    """An n x bits matrix of +1 and -1: all distinct splits of the languages if few, else a random code of wide rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, best, width = np.random.default_rng(7), None, int(np.ceil(12 * np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min(np.sum(a != b) for a, b in combinations(code, 2))
        if best is None or least > best[0]:
            best = least, code
    return best[1]


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of lower-cased text, one row a text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(out, texts):
        buckets = trigram_buckets(b" " + (text or "").lower().encode("utf-8", "replace") + b" ", BITS)
        if len(buckets):
            row += np.sqrt(np.bincount(buckets, minlength=1 << BITS) / len(buckets))
    return out


class LanguageModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """Softmax of the negative loss of every codeword."""
        z = x @ self.weights + self.bias
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows of ``docs``; the sample's trigram shares come to the driver, those that are not zero."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    n_labels = max(1, labelled.select("label").distinct().count())
    sample, counts = sample_labelled(labelled, "id", "label", max(1, sample_docs // n_labels))
    languages = sorted(counts)
    code = codewords(len(languages))
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) < 2:
        return LanguageModel(languages, code, w, b, np.ones(code.shape[1]))

    def make():
        def work(texts: list) -> dict:
            found = [(np.flatnonzero(r), r) for r in (features([t])[0].astype("<f2") for t in texts)]
            return {"at": pa.array([at.astype("<u2").tobytes() for at, _ in found], pa.binary()), "x": pa.array([r[at].tobytes() for at, r in found], pa.binary())}

        return work

    rows = map_texts(sample, "text", make, "at binary, x binary").select("label", "at", "x").toArrow()
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for row, at, v in zip(x, rows.column("at"), rows.column("x")):
        row[np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(v.as_buffer(), "<f2")
    y = code[[languages.index(v) for v in rows.column("label").to_pylist()]].astype(np.float32)
    adam = Adam({"w": w, "b": b}, RATE)
    for _ in range(STEPS):
        g = -y * sigmoid(-y * (x @ w + b)) / len(x)
        adam.step({"w": x.T @ g + DECAY * w, "b": g.sum(axis=0)})
    right = np.mean(y * (x @ w + b) > 0, axis=0)
    trust = np.maximum(right - 0.5, 1e-3)
    del rows, x, y  # what the sample took of the driver's memory goes before other operators run
    sweep(docs.sparkSession)
    return LanguageModel(languages, code, w, b, trust / trust.sum() * len(trust))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with lang_pred, score in 0..1 and ambiguous.

    Null texts and texts without a letter are ``und`` with score 0 and not ambiguous; so is everything if no language
    was learned. Names that are taken get a trailing underscore. Rows are independent; nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    others = docs.columns if keep_text else [c for c in docs.columns if c != text_col]
    pred, score, vague = (free_name(others, c) for c in ("lang_pred", "score", "ambiguous"))

    def make():
        model = shipped.value

        def work(texts: list) -> dict:
            names, scores, close = [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [False] * len(texts)
            some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
            for lo in range(0, len(some), 256):
                part = some[lo : lo + 256]
                p = model.posteriors(features([texts[i] for i in part]))
                order = np.sort(p, axis=1)
                for i, row, best in zip(part, p, order):
                    names[i], scores[i] = model.languages[int(row.argmax())], float(best[-1])
                    close[i] = len(best) > 1 and bool(best[-1] - best[-2] < MARGIN)
            return {pred: pa.array(names), score: pa.array(scores, pa.float64()), vague: pa.array(close)}

        return work

    return map_texts(docs, text_col, make, f"`{pred}` string, `{score}` double, `{vague}` boolean", keep_text)


def confident(pred: Column, ambiguous: Column) -> Column:
    """Rows the pipeline keeps: a language was found and no other comes close."""
    return (pred != NO_LANGUAGE) & ~ambiguous
