"""Document quality by gated attention over passages (multiple-instance learning).

A document is a bag of passages. Each passage is encoded from its byte trigrams and byte classes; gated attention
weights the encodings by w(tanh(V h) * sigmoid(U h)), normalised over the document, and a logistic layer scores the weighted
mean. Everything is learned from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, map_texts
from .linear import Adam, sample_labelled, sigmoid, trigram_buckets

PASSAGE_BYTES = 512
BITS = 10
HIDDEN, GATE = 24, 16
#: Labelled documents of each label to fit on, and passages of all these together: documents that go beyond are left
#: out of the sample whole, so that every bag in it has all its passages.
SAMPLE_PER_LABEL, SAMPLE_PASSAGES = 1500, 24_576
#: Passages that are encoded at once; a bag may have any number.
CHUNK_PASSAGES = 2048
STEPS, RATE, DECAY = 250, 0.01, 1e-4
CLASSES = 7
WIDTH = (1 << BITS) + CLASSES + 2


def _byte_classes() -> np.ndarray:
    """Upper, lower, digit, white space, sentence marks, other marks, beyond ASCII."""
    kind = np.full(256, 5, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = 6
        elif c.isupper():
            kind[b] = 0
        elif c.islower():
            kind[b] = 1
        elif c.isdigit():
            kind[b] = 2
        elif c.isspace():
            kind[b] = 3
        elif c in ".,;:?'\"-()":
            kind[b] = 4
    return kind


CLASS_OF = _byte_classes()


def n_passages(n_bytes: int) -> int:
    """Passages of a text of so many bytes: a short rest joins the last one, an empty text is one empty passage."""
    return max(1, (n_bytes + PASSAGE_BYTES // 2) // PASSAGE_BYTES)


def encode(data: bytes, after: bytes, n: int, length: int) -> np.ndarray:
    """One row of features for each of the ``n`` passages of ``data``, which ``after`` follows in a text of ``length`` bytes."""
    where = np.minimum(np.arange(len(data)) // PASSAGE_BYTES, n - 1)
    grams = trigram_buckets(data + after, BITS)
    counts = np.bincount(grams + (where[: len(grams)] << BITS), minlength=n << BITS).reshape(n, -1)
    kinds = np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)] + where * CLASSES, minlength=n * CLASSES).reshape(n, -1)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out = np.empty((n, WIDTH), np.float32)
    out[:, : 1 << BITS] = np.sqrt(counts / total)
    out[:, 1 << BITS : -2] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    out[:, -2] = (counts > 0).sum(axis=1) / np.minimum(total[:, 0], 1 << BITS)
    out[:, -1] = np.log1p(length) / 16
    return out


def chunks(text: str | None) -> Iterator[np.ndarray]:
    """The features of all passages of a text, at most ``CHUNK_PASSAGES`` at a time; a trigram belongs to the passage it begins in."""
    data = (text or "").encode("utf-8", "replace")
    n, step = n_passages(len(data)), CHUNK_PASSAGES
    for lo in range(0, n, step):
        last = lo + step >= n
        end = len(data) if last else (lo + step) * PASSAGE_BYTES
        yield encode(data[lo * PASSAGE_BYTES : end], data[end : end + 2], n - lo if last else step, len(data))


def passages(text: str | None) -> np.ndarray:
    """All ``chunks`` of a text together."""
    return np.concatenate(list(chunks(text)))


class QualityModel:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls) -> QualityModel:
        rng = np.random.default_rng(11)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        return cls({"e": draw(WIDTH, HIDDEN), "eb": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "cb": np.zeros(1, np.float32)})

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The encodings of passages, both halves of their gate, and their attention before it is normalised."""
        p = self.p
        h = np.tanh(x @ p["e"] + p["eb"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        return h, t, s, (t * s) @ p["w"]

    def read(self, text: str | None) -> tuple[float, int, int, float]:
        """Score, number of passages, and place and weight of the one with most attention, chunk by chunk: all that is
        kept of a bag is the highest attention and the sums relative to it."""
        top, at, n, total = -np.inf, 0, 0, 0.0
        z = np.zeros(HIDDEN)
        for x in chunks(text):
            h, _, _, a = self.attend(x)
            if a.max() > top:
                shrink = np.exp(top - a.max())
                top, at, total, z = float(a.max()), n + int(a.argmax()), total * shrink, z * shrink
            share = np.exp(a - top)
            total, z, n = total + share.sum(), z + share @ h, n + len(x)
        return float(sigmoid((z / total @ self.p["c"] + self.p["cb"]).astype(np.float32))[0]), n, at, float(1 / total)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """``starts``: first passage of each document; every document has one at least."""
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        h, t, s, a = self.attend(x)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "p": sigmoid(z @ p["c"] + p["cb"][0])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, starts)
        d_out = ((f["p"] - y) * weight).astype(np.float32)
        d_z = np.repeat(d_out[:, None] * p["c"], f["sizes"], axis=0)
        a, h, t, s = f["a"][:, None], f["h"], f["t"], f["s"]
        d_a = (d_z * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * d_a, starts), f["sizes"])
        d_score = (f["a"] * (d_a - mean))[:, None]
        d_t, d_s = d_score * p["w"] * s * (1 - t * t), d_score * p["w"] * t * s * (1 - s)
        d_h = (a * d_z + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
        g = {"e": x.T @ d_h, "eb": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "w": (d_score * t * s).sum(axis=0), "c": f["z"].T @ d_out, "cb": np.array([d_out.sum()], np.float32)}
        return {k: v + (DECAY * p[k] if k in ("e", "v", "u", "c") else 0) for k, v in g.items()}


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", per_label: int = SAMPLE_PER_LABEL, most_passages: int = SAMPLE_PASSAGES) -> QualityModel:
    """Fit on a bounded sample of ``labels`` (id, 0 or 1), whose ids are broadcast to the scan of ``docs``.

    Rows with a null or other label are left out. Labels are weighted back to their shares, so scores keep their
    meaning as probabilities. Without rows of both labels every text gets one and the same score: near 1 if all are of
    label 1, near 0 if all are of label 0, 0.5 without any. ``per_label`` and ``most_passages`` bound the sample: documents
    are taken in the order of their hashes, each with all its passages, while these fit.
    """
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    sample, counts = sample_labelled(rows, "id", "label", per_label)
    model = QualityModel.fresh()
    total = sum(counts.values())
    if len(counts) < 2:
        model.p = {k: v * 0 for k, v in model.p.items()}
        model.p["cb"][0] = 4.0 if counts.get(1) else -4.0 if counts else 0.0
        return model

    def make():
        return lambda texts: {"x": pa.array([passages(t).astype("<f2").tobytes() for t in texts], pa.binary())}

    text, size = F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n_bytes")
    picked = docs.select(F.col(id_col).alias("id"), text, size).join(F.broadcast(sample), "id")
    picked = durable(picked.select("label", "text", "n_bytes", F.xxhash64("id", F.col("label"), "n_bytes", F.lit(3)).alias("place")), "quality-sample")
    room, chosen = most_passages, []
    for place, n_bytes in sorted(picked.select("place", "n_bytes").collect()):
        if n_passages(n_bytes) <= room:
            room -= n_passages(n_bytes)
            chosen.append(place)
    few = docs.sparkSession.createDataFrame([(c,) for c in chosen], "place long").distinct()
    got = map_texts(picked.join(F.broadcast(few), "place", "left_semi").select("label", "text"), "text", make, "x binary").select("label", "x").toArrow()
    bags = [np.frombuffer(v.as_buffer(), "<f2").reshape(-1, WIDTH) for v in got.column("x")]
    if not bags:
        return model
    x = np.concatenate(bags).astype(np.float32)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    y = np.array(got.column("label").to_pylist(), np.float32)
    held = {k: max(1, int((y == k).sum())) for k in counts}
    weight = np.array([counts[int(k)] / total / held[int(k)] for k in y], np.float32)
    model.p["cb"][0] = np.log(max(counts[1], 1) / max(counts[0], 1))
    adam = Adam(model.p, RATE)
    for _ in range(STEPS):
        adam.step(model.gradients(x, starts, y, weight))
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score (0 to 1, label 1 likelier), passages, and the place and weight of the
    passage with most attention.

    Null and empty texts are one empty passage and get the score the model gives that. Names that are taken get a
    trailing underscore. Rows are independent; nothing is shuffled. Every passage of a text counts, however long it is;
    beside the text itself the memory that takes is that of ``CHUNK_PASSAGES`` passages.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != text_col]
    names = [free_name(others, c) for c in ("score", "passages", "top_passage", "top_weight")]

    def make():
        model = shipped.value

        def work(texts: list) -> dict:
            out: list[tuple] = []
            held: list[np.ndarray] = []  # the bags of texts of ordinary length, read together

            def flush():
                if held:
                    starts = np.cumsum([0] + [len(b) for b in held[:-1]])
                    f = model.forward(np.concatenate(held), starts)
                    for p, start, b in zip(f["p"], starts, held):
                        a = f["a"][start : start + len(b)]
                        out.append((float(p), len(b), int(a.argmax()), float(a.max())))
                    held.clear()

            size = 0
            for t in texts:
                if t and len(t) > CHUNK_PASSAGES * PASSAGE_BYTES // 4:
                    flush()
                    size = 0
                    out.append(model.read(t))
                    continue
                held.append(passages(t))
                size += len(held[-1])
                if size >= CHUNK_PASSAGES:
                    flush()
                    size = 0
            flush()
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            return {n: pa.array(v, k) for n, v, k in zip(names, zip(*out) if out else [[]] * 4, kinds)}

        return work

    return map_texts(docs, text_col, make, f"`{names[0]}` double, `{names[1]}` long, `{names[2]}` long, `{names[3]}` double")
