"""Personal data: exact base patterns, and further spans by weak supervision.

Base spans are found by rule. Beside them each text gives *candidates*: what looks like an address, number or card written in
another way. Labelers of three sorts, regex (form, length, borders), gazetteer (endings, codes, ranges) and context (words in
front), vote for or against each candidate, or abstain; base spans are voted on as well. The counts of all vote
patterns of the corpus (a few hundred, whatever its size) go through expectation-maximisation, which estimates how
reliable every labeler is and how likely each pattern means personal data. These estimates train a logistic span classifier on
votes, shape and neighbouring words, over a bounded sample of candidates; it decides which candidates become spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, map_texts
from .linear import Adam, sigmoid

# Fixed values of the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]*+")

# What further ways of writing are candidates: a marker, then what stands around it.
AT = re.compile(r"\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\}|＠|@|(?<=[a-z0-9]) at (?=[a-z0-9-]{1,63} dot )")
BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?$")
AFTER = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{(?:dot|DOT)\}) ?| dot |\.)[A-Za-z0-9-]{1,63}){0,4}")
HEXTETS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![0-9])")
NUMBER = re.compile(r"(?<![0-9A-Za-z_+=#.,/-])\(?[0-9]++\)?(?:[ ./ -]?\(?[0-9]++\)?){0,7}(?![0-9A-Za-z_=])")

# Gazetteers.
ENDINGS = frozenset("com org net edu gov info biz io eu de fr es it uk us ca ch at be nl pl pt ru se no dk fi ie jp cn in au br mx".split())
ISSUERS = ("4", "34", "37", "36", "38", "35", "51", "52", "53", "54", "55", "60", "62", "65")
CALLING = ("001", "0033", "0034", "0039", "0041", "0043", "0044", "0049", "00351", "0031", "0032", "0045", "0046", "0047", "0048")
CUES = {
    "email": "email e-mail mail mailto courriel correo contact contacto kontakt write schreiben escribir reply inbox".split(),
    "ip": "ip ipv4 ipv6 host server address adresse direccion login gateway router ping dns client remote".split(),
    "card": "card visa mastercard amex credit debit carte karte kreditkarte tarjeta cc pan payment paid".split(),
    "phone": "phone tel telephone telefon telefono mobile cell fax call handy portable movil ring sms whatsapp dial".split(),
}
AGAINST = frozenset("version release section chapter isbn issn order invoice page figure table id build commit date year number serial no nr ratio score license article paragraph total price".split())

#: A vote is 1 for, -1 against, 0 none.
LABELERS = ("form", "length", "borders", "gazetteer", "cue", "anticue")
#: Characters of a candidate's surroundings that labelers read, hashed features, and candidates in the sample that the classifier is fitted on.
AROUND, FEATURES, SAMPLE = 48, 1 << 12, 20_000
#: Candidates that are alike in all features weigh as so many at most.
MOST_ALIKE = 50
#: Candidates from this probability on become spans.
LEAST = 0.6
#: Before any data each labeler is right with this chance, and that belief weighs as so many candidates.
TRUST, WEIGHT = 0.85, 20.0


def luhn(digits: str) -> bool:
    doubled = digits[-2::-2].translate(str.maketrans("0123456789", "0246813579"))
    return (sum(map(int, digits[-1::-2])) + sum(map(int, doubled))) % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in text.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; time is linear in the length of any text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # what stands in front of this sign cannot be part of a later local part
        at = text.find("@", at + 1)
    out += [(1, m.start(), m.end()) for m in QUAD.finditer(text) if small_parts(m[0])]
    for m in DIGITS.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PLUS.finditer(text):
        found = m[0].rstrip(" ().-")
        if len(found) >= 4 and 8 <= sum(c.isdigit() for c in found) <= 15:
            out.append((3, m.start(), m.start() + len(found)))
    return out


def _addresses(text: str) -> Iterator[tuple[int, int, int]]:
    if "@" not in text and "＠" not in text and " dot " not in text and not re.search(r"[(\[{](?:at|AT)[)\]}]", text):
        return
    for m in AT.finditer(text):
        left, right = BEFORE.search(text[max(0, m.start() - 65) : m.start()]), AFTER.match(text, m.end())
        if left and right:
            yield 0, m.start() - len(left[0]), right.end()


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what may be personal data in a form that no base pattern has."""
    yield from _addresses(text)
    for pattern in (HEXTETS, DOTTED) if ":" in text or "." in text or " dot " in text else ():
        for m in pattern.finditer(text):
            yield 1, m.start(), m.end()
    for m in NUMBER.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 7 <= len(digits) <= 12 or len(digits) <= 15 and digits.startswith(CALLING) and len(digits) > 6:
            yield 3, m.start(), m.end()
        elif 13 <= len(digits) <= 19:
            yield 2, m.start(), m.end()


def votes(kind: int, text: str, start: int, end: int) -> list[int]:
    """Each labeler's vote on a span."""
    span = text[start:end]
    digits, words = re.sub(r"[^0-9]", "", span), re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - AROUND) : start].lower())[-5:]
    edge = (text[start - 1 : start] + text[end : end + 1]).strip("\"'()[]{}<>*#&%$!.,;:?|= \t\r\n-")
    if kind == 0:
        plain = re.sub(r" ?[(\[{](?:dot|DOT)[)\]}] ?| dot ", ".", span)
        labels = re.split(r"@|＠|[(\[{](?:at|AT)[)\]}]| at ", plain)[-1].strip().split(".")
        form = 1 if len(labels) > 1 and labels[-1].isalpha() else -1
        length, gazetteer = 1 if 6 <= len(span) <= 100 else -1, 1 if labels[-1].lower() in ENDINGS else -1 if len(labels) < 2 else 0
    elif kind == 1:
        parts = re.split(r"\[\.\]|\(\.\)| dot |\.", span)
        hextets = span.count(":") == 7 or span.count("::") == 1 and span.count(":") < 8
        form = 1 if (hextets if ":" in span else all(p.isdigit() and int(p) <= 255 for p in parts)) else -1
        length = 1 if len(span) >= 7 else -1
        gazetteer = -1 if ":" in span and not re.search("[0-9]", span) else 1 if re.match(r"10\b|127\b|192\b|172\b|2001:|fe80:", span) else -1 if digits[:1] == "0" else 0
    elif kind == 2:
        form = 1 if luhn(digits) else -1
        length, gazetteer = 1 if len(digits) in (15, 16) else -1, 1 if digits.startswith(ISSUERS) else 0
    else:
        groups = re.findall("[0-9]+", span)
        date = re.fullmatch(r"(?:(?:19|20)[0-9]{2}[-./ ]?[0-9]{1,2}[-./ ]?[0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2})", span)
        form = -1 if date or len(groups) < 2 or max(map(len, groups)) > 8 else 1 if span[0] in "+(0" else 0
        length = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if span[0] == "+" or digits.startswith(CALLING) else 0
    cue = any(w in CUES[KINDS[kind]] for w in words)
    return [form, length, -1 if edge else 0, gazetteer, 1 if cue else 0, -1 if any(w in AGAINST for w in words[-3:]) else 0]


def hashed(kind: int, text: str, start: int, end: int, voted: list[int]) -> list[int]:
    """Features of a span: its votes, its shape and the words next to it, each with its kind."""
    shape = re.sub(r"(.)\1+", r"\1+", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", text[start:end])))[:40]
    before, after = re.findall(r"\w+", text[max(0, start - AROUND) : start].lower())[-2:], re.findall(r"\w+", text[end : end + AROUND].lower())[:1]
    said = of_votes(voted) + [f"shape {shape}"] + [f"before {w}" for w in before] + [f"after {w}" for w in after]
    return buckets(kind, said)


def of_votes(voted: list[int]) -> list[str]:
    return [f"{name}{v}" for name, v in zip(LABELERS, voted) if v]


def buckets(kind: int, said: list[str]) -> list[int]:
    return sorted({crc32(f"{kind} {s}".encode()) % FEATURES for s in ["", *said]})


CANDIDATE = "array<struct<kind: int, start: int, end: int, base: boolean, votes: string, features: array<int>>>"


def found_in(text: str | None) -> list[tuple]:
    """Base spans and the candidates that overlap none of these, nor an earlier candidate: (kind, start, end, base, votes, features)."""
    text = text or ""
    base = base_spans(text)
    spans = [(*s, True) for s in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    last = 0
    for kind, a, b in sorted(candidates(text), key=lambda s: (s[1], s[0])):
        before = bisect_left(starts, b)
        if a >= last and not (before and reach[before - 1] > a):
            spans.append((kind, a, b, False))
            last = b
    out = []
    for kind, a, b, known in spans:
        said = votes(kind, text, a, b)
        out.append((kind, a, b, known, " ".join(map(str, said)), hashed(kind, text, a, b, said)))
    return out


@dataclass
class Reliability:
    """For each kind the share of personal data among candidates that no base pattern has, and for each labeler the chance that it votes for, given that it votes, if a candidate is not (0) or is (1) personal data."""

    prior: np.ndarray  # kinds
    favours: np.ndarray  # kinds, labelers, truth

    def posterior(self, kind: np.ndarray, voted: np.ndarray) -> np.ndarray:
        """The chance that candidates of these kinds and votes (rows) are personal data; who abstains says nothing."""
        f = self.favours[kind]
        likely = np.where(voted[:, :, None] > 0, f, 1 - f)
        logs = np.where(voted[:, :, None] == 0, 0.0, np.log(likely)).sum(axis=1)
        prior = self.prior[kind]
        return sigmoid(logs[:, 1] - logs[:, 0] + np.log(prior) - np.log(1 - prior))


def estimate(kind: np.ndarray, base: np.ndarray, voted: np.ndarray, count: np.ndarray, rounds: int = 100) -> Reliability:
    """Expectation-maximisation over vote patterns (kind, of base spans or not, votes, how many candidates have them).

    Base spans are personal data by rule; what the others are is estimated. Every chance starts from ``TRUST``, which keeps its
    weight beside the data, so that a labeler that hardly ever speaks, or a kind that hardly ever occurs, stays near it.
    """
    start = np.empty((len(KINDS), len(LABELERS), 2))
    start[:] = 1 - TRUST, TRUST
    now = Reliability(np.full(len(KINDS), 0.5), start)
    for _ in range(rounds):
        p = np.where(base, 1.0, now.posterior(kind, voted))
        prior, seen = np.full(len(KINDS), 0.5 * WEIGHT), np.full(len(KINDS), WEIGHT)
        np.add.at(prior, kind[~base], (p * count)[~base])
        np.add.at(seen, kind[~base], count[~base])
        favours, spoke = start * WEIGHT, np.full(start.shape, WEIGHT)
        for j in range(len(LABELERS)):
            for truth, mass in enumerate(((1 - p) * count, p * count)):
                np.add.at(favours, (kind, j, truth), mass * (voted[:, j] > 0))
                np.add.at(spoke, (kind, j, truth), mass * (voted[:, j] != 0))
        now = Reliability(prior / seen, favours / spoke)
    return now


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    reliability: Reliability

    def chances(self, features: list[list[int]]) -> np.ndarray:
        return sigmoid(np.array([self.weights[f].sum() for f in features]) + self.bias) if features else np.zeros(0)


def train(features: list[list[int]], target: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features against soft targets; ``weight`` adds up to 1."""
    held = {"w": np.zeros(FEATURES), "b": np.zeros(1)}
    row, col = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features)
    adam = Adam(held, 0.05)
    for _ in range(steps):
        off = (sigmoid(np.bincount(row, held["w"][col], len(features)) + held["b"]) - target) * weight
        adam.step({"w": np.bincount(col, off[row], FEATURES) + 1e-4 * held["w"], "b": np.array([off.sum()])})
    return held["w"], float(held["b"][0])


def scan(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    """``docs`` with the base spans and candidates of each whole text in ``to``, without the text."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
    names = [f.name for f in kind.value_type]

    def make():
        return lambda texts: {to: pa.array([[dict(zip(names, s)) for s in found_in(t)] for t in texts], kind)}

    return map_texts(docs, text_col, make, f"`{to}` {CANDIDATE}")


def fit(scanned: DataFrame, column: str) -> Model:
    """Reliabilities from the vote patterns of all candidates, the classifier from about ``SAMPLE`` of them at most."""
    every = scanned.select(F.explode(column).alias("s")).select("s.*")
    patterns = every.groupBy("kind", "base", "votes").count().collect()  # kinds x 2 x 3 ** labelers at most
    as_votes = lambda said: np.array([[int(v) for v in x.split()] for x in said]).reshape(-1, len(LABELERS))
    kind, base, count = (np.array([r[c] for r in patterns], t) for c, t in (("kind", int), ("base", bool), ("count", float)))
    known = estimate(kind, base, as_votes(r["votes"] for r in patterns), count)
    # each group of a kind, base or not, gives about the same number, by a hash of what a candidate is
    share = F.lit(0)
    for k in range(len(KINDS)):
        for b in (False, True):
            n = int(count[(kind == k) & (base == b)].sum())
            share = F.when((F.col("kind") == k) & (F.col("base") == b), F.lit(min(1 << 30, (SAMPLE // len(KINDS) // 2 << 30) // max(n, 1) + 1))).otherwise(share)
    taken = every.where(F.pmod(F.xxhash64("start", "end", "features"), F.lit(1 << 30)) < share)
    sample = taken.groupBy("kind", "base", "votes", "features").agg(F.least(F.count("*"), F.lit(MOST_ALIKE)).alias("n")).collect()
    features, kinds = [r["features"] for r in sample], np.array([r["kind"] for r in sample], int)
    target = np.where([bool(r["base"]) for r in sample], 1.0, known.posterior(kinds, as_votes(r["votes"] for r in sample)))
    weight = np.array([r["n"] for r in sample], float)
    for k in range(len(KINDS)):  # both answers of a kind weigh alike
        mine = kinds == k
        for side in (target, 1 - target):
            weight[mine] *= np.where(side[mine] > 0.5, 1 / max((weight * side)[mine & (side > 0.5)].sum(), 1e-9), 1)
    # every possible vote of every kind as one candidate more, so that the classifier knows what the labelers are worth where the sample is silent
    votes_of = np.array(list(product((-1, 0, 1), repeat=len(LABELERS))))
    for k in range(len(KINDS)):
        features += [buckets(k, of_votes(v)) for v in votes_of.tolist()]
        target = np.concatenate([target, known.posterior(np.full(len(votes_of), k), votes_of)])
        weight = np.concatenate([weight, np.full(len(votes_of), 1 / len(votes_of))])
    return Model(*train(features, target, weight / weight.sum()), known)


def decide(scanned: DataFrame, column: str, model: Model) -> DataFrame:
    """``scanned`` with n_email, n_ip, n_card, n_phone (base spans), ``base`` and ``spans`` in place of ``column``."""
    names = [free_name([c for c in scanned.columns if c != column], n) for n in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")]
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    carried = [f for f in scanned.schema.fields if f.name != column]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in carried] + [f"`{n}` long" for n in names[:4]] + [f"`{n}` string" for n in names[4:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[list] = [[] for _ in names]
            for spans in batch.column(column).to_pylist():
                base = sorted((s["kind"], s["start"], s["end"]) for s in spans if s["base"])
                others = [s for s in spans if not s["base"]]
                more = [(s["kind"], s["start"], s["end"]) for s, p in zip(others, model.chances([s["features"] for s in others])) if p >= LEAST]
                row = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                for held, value in zip(new, [*row, said(base), said(sorted(base + more))]):
                    held.append(value)
            columns = [batch.column(f.name) for f in carried] + [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(new)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in carried] + names)

    return scanned.mapInArrow(run, schema)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs``, then n_email, n_ip, n_card, n_phone, ``base`` and ``spans`` of each whole text.

    Counts and ``base`` are of the base patterns: email, ip (parts up to 255), card (16 to 19 digits that pass Luhn) and phone
    (8 to 15 digits), leftmost and without overlap within a kind; a match that fails its test is dropped and not tried
    again. ``spans`` has these and what the classifier adds: candidates that overlap no base span. Both are
    ``kind:start:end`` by kind in this order, then start, joined by commas; offsets count code points, ends are exclusive.
    Null and empty texts have no spans; repeated rows and ids each keep their row; a table without candidates, or without
    rows, adds nothing. New columns whose name is taken get an underscore.
    """
    column = free_name(docs.columns, "_spans")
    scanned = durable(scan(docs, text_col, column), "pii-candidates")
    return decide(scanned, column, fit(scanned, column))


