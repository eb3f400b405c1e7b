"""Token counts at every prefix by dynamic programming, and the budget questions they answer.

For a word of the pre-tokenizer, the encoding of a prefix ends in exactly one token that (a) encodes to itself and
(b) may follow the last token of the shorter prefix, which two tokens may if encoding their joined bytes gives these
two again. So one pass over the word gives last token and count at every prefix, without encoding any prefix. Words
are encoded apart, so counts of a text are running sums over its words plus the count inside the word a prefix cuts.

What is stored of a text is the step from each count to the next, two bytes a character. Its running sum is the count at
every prefix; the number of tokens, and where a budget ends, are read from it without looking at the text again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NONE, ByteBpe, WordCache, build, read_tokenizer
from .common import free_name, map_texts

LIMIT = 512
ONE = (1,)
#: Answers to which tokens follow which that are remembered per worker.
CACHE_PAIRS = 1 << 20
#: Characters of a text that are split at once; it changes no count.
BLOCK_CHARS = 1 << 18
#: A space before anything but white space begins a word of the pre-tokenizer, whatever stands before it.
OPENING = re.compile(r" (?=\S)")
SEGMENT = re.compile(r"(?= \S)")
#: Where cutting at every space would not do, and where a stretch that ends in white space may count otherwise.
UNEVEN, BENDING = re.compile(r" (?:\s|\Z)"), re.compile(r"\s (?=\S)")
#: Beginnings of words, in bytes, from which other words go on, and how many are remembered per worker; words and stretches
#: whose steps are (64 MB of text have some 600,000 different words, so fewer would forget frequent ones).
STEMS, CACHE_STEMS, CACHE_STEPS, CACHE_SEGMENTS = (10, 7, 4), 100_000, 800_000, 500_000
#: Marks that are words of their own behind a letter.
MARKS = frozenset(".,;:!?")


class Following(dict):
    """From the bytes of a token that may follow ``token`` to what may follow that one; None for other bytes. Filled as asked."""

    def __init__(self, counter: PrefixCounter, token: int | None):
        super().__init__()
        self.counter, self.token = counter, token

    def __missing__(self, data: bytes) -> Following | None:
        c, t = self.counter, self.counter.ids.get(data)
        c.remember()
        fits = t is not None and (self.token is None or c.fits(self.token, t))
        found = self[data] = c.following(t) if fits else None
        return found


class PrefixCounter:
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        # tokens that encode to themselves; no other ends an encoding
        self.ids = {b: i for i, b in bpe.token_bytes.items() if i not in bpe.special.values() and bpe.merge(b) == [i]}
        # how long tokens are that end in two given bytes, or in one at the start of a word
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[-2:], set()).add(len(t))
        single = {t for t in self.ids if len(t) == 1}
        self.lengths = {e: sorted(found | ({1} if e[-1:] in single else set())) for e, found in lengths.items()}
        # the two parts of each merged token, where ids are in the order of the merges and no token has two; bytes are their own parts
        merged, single_ids = bpe.merged, bpe.byte_ids
        ordered = all(a < b for a, b in pairwise(merged)) and (not merged or max(single_ids) < merged[0])
        self.parts = {m: (pair >> 32, pair & 0xFFFFFFFF) for pair, m in zip(bpe.ranks, merged)} | {i: (i, i) for i in single_ids} if ordered and len(bpe.ranks) == len(merged) else None
        self.tables: dict[int | None, Following] = {}
        self.known = 0
        self.counts = WordCache(lambda w: self.word(w.encode())[-1])
        self.word_steps = WordCache(self.steps_of_word, CACHE_STEPS)
        self.segments = WordCache(lambda stretch: self.segment(stretch)[0], CACHE_SEGMENTS)
        self.bent = WordCache(self.segment)
        self.stems: dict[bytes, tuple[list[Following], list[int]]] = {}

    def remember(self) -> None:
        """One more answer; too many of them start anew."""
        self.known += 1
        if self.known > CACHE_PAIRS:
            self.known = 0
            self.tables.clear()
            self.stems.clear()

    def fits(self, a: int, b: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives these two again.

        It does unless a part at the end of ``a`` and one at the start of ``b`` merge before the tokens they stand in are made:
        the later token of the two is taken apart step by step, and the pair at the border looked up.
        """
        if self.parts is None:
            return self.bpe.merge(self.bpe.token_bytes[a] + self.bpe.token_bytes[b]) == [a, b]
        parts, ranks, merged = self.parts, self.bpe.ranks, self.bpe.merged
        limit = NONE
        while True:
            rank = ranks.get(a << 32 | b)
            if rank is not None and merged[rank] < limit:
                return False
            if a > b and parts[a][1] != a:
                limit, a = a, parts[a][1]
            elif parts[b][0] != b:
                limit, b = b + 1, parts[b][0]
            elif parts[a][1] != a:
                limit, a = a, parts[a][1]
            else:
                return True

    def following(self, token: int | None) -> Following:
        if token not in self.tables:
            self.tables[token] = Following(self, token)
        return self.tables[token]

    def word(self, word: bytes) -> list[int]:
        """Counts at the prefixes of 0, 1, ... bytes of one word. They depend on what is before them alone, so words go on from where others began alike."""
        lengths = self.lengths.get
        for n in STEMS:
            if len(word) >= n and (stem := self.stems.get(word[:n])):
                after, count = stem[0].copy(), stem[1].copy()
                break
        else:
            after, count = [self.following(None)], [0]
        for k in range(len(count), len(word) + 1):
            for n in lengths(word[k - 2 if k > 1 else 0 : k], ONE):
                start = k - n
                if start >= 0 and (found := after[start][word[start:k]]) is not None:
                    after.append(found)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("no token ends here")
            if k in STEMS:
                if len(self.stems) >= CACHE_STEMS:
                    self.stems.clear()
                self.stems[word[:k]] = after.copy(), count.copy()
        return count

    def inside(self, before: str, word: str, base: int, base_before: int) -> list[int]:
        """Counts at the prefixes of 1, 2, ... characters of ``word``; ``before`` is the word in front, whose end counts ``base``."""
        if before in self.bpe.special:
            before, base_before = "", base
        if word in self.bpe.special or word[0] == "'" and len(word) > 1 and word[1].isalpha():
            # cut short, these split otherwise, perhaps together with the word in front
            cut = [base_before + sum(map(self.counts.__getitem__, self.bpe.words(before + word[:j]))) for j in range(1, len(word))]
            return [*cut, base + (1 if word in self.bpe.special else self.counts[word])]
        by_byte = self.word(word.encode())
        ends = accumulate(len(c.encode()) for c in word)
        found = [base + by_byte[e] for e in ends]
        if before.isspace() and word[0].isspace():  # white space at the end of a text is one word
            found[0] = base_before + self.counts[before + word[0]]
        return found

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """Words and added tokens with their counts, in order."""
        out: list[tuple[str, int]] = []
        for section, special in self.bpe.sections(text):
            out += [(section, 1)] if special else [(w, self.counts[w]) for w in self.bpe.words(section)]
        return out

    def prefixes(self, text: str) -> list[int]:
        """Counts at the prefixes of 0, 1, ... characters of a text: what encoding just that prefix would give."""
        out, base, base_before, before = [0], 0, 0, ""
        for w, n in self.pieces(text):
            out += self.inside(before, w, base, base_before)
            base_before, base, before = base, base + n, w
        return out

    def segment(self, text: str) -> tuple[bytes, int]:
        """The steps of a stretch that begins a word, and by how much a space behind it counts other than as one token.

        It does where the stretch ends in white space, as white space at the end of a text is one word.
        """
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.word_steps[text], 0
        if text[-1] in MARKS and text[1:-1].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.word_steps[text[:-1]] + self.word_steps[text[-1]], 0
        words = self.bpe.words(text)
        if len(words) == 1:
            return self.word_steps[text], 0
        if not any(w[0] == "'" or w[-1].isspace() for w in words):  # no end of a word depends on what follows it
            return b"".join(map(self.word_steps.__getitem__, words)), 0
        counts = self.prefixes(text)
        off = self.prefixes(text + " ")[-1] - counts[-1] - 1 if text[-1:].isspace() else 0
        return packed(np.diff(np.array(counts))), off

    def steps_of_word(self, word: str) -> bytes:
        """The steps at the characters of a word; those of a word of white space or an apostrophe hold for it alone."""
        counts = self.word(word.encode())
        if not word.isascii():
            counts = [0, *(counts[e] for e in accumulate(len(c.encode()) for c in word))]
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def steps(self, text: str) -> bytes:
        """The step to the count at each character, as little-endian 16-bit integers."""
        if any(s in text for s in self.bpe.special):
            return packed(np.diff(np.array(self.prefixes(text))))
        if not BENDING.search(text):
            return b"".join(map(self.segments.__getitem__, stretches(text)))
        parts, bends, at = [], [], 0
        for stretch in stretches(text):
            steps, off = self.bent[stretch] if stretch[-1].isspace() else (self.segments[stretch], 0)
            parts.append(steps)
            at += len(stretch)
            if off:
                bends.append((at, off))
        if not bends:
            return b"".join(parts)
        found = np.frombuffer(b"".join(parts), "<i2").astype(np.int64)
        for place, off in bends:
            if place < len(found):  # the next character is a space with a word behind it
                found[place] += off
                found[place + 1] -= off
        return packed(found)


def packed(steps: np.ndarray) -> bytes:
    if len(steps) and np.abs(steps).max() >= 1 << 15:
        raise OverflowError("a step between two prefixes is beyond 16 bits")
    return steps.astype("<i2").tobytes()


def stretches(text: str) -> Iterator[str]:
    """A text cut in front of every space that begins a word."""
    at = 0
    while at < len(text):
        space = OPENING.search(text, at + BLOCK_CHARS)
        end = space.start() if space else len(text)
        block = text[at:end]
        if UNEVEN.search(block):
            yield from filter(None, SEGMENT.split(block))
        else:
            pieces = block.split(" ")
            if pieces[0]:
                yield pieces[0]
            yield from [" " + p for p in pieces[1:]]
        at = end


def read_budget(steps: bytes, limit: int) -> tuple[int, int]:
    """Tokens of a text, and characters of its longest prefix of at most ``limit`` tokens, from its steps."""
    counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
    within = np.flatnonzero(counts <= limit)
    return int(counts[-1]) if len(counts) else 0, int(within[-1]) + 1 if len(within) else 0


def prefix_steps(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with prefix_steps in the place of the text: what ``within_budget`` and ``prefix_counts`` answer from.

    Null texts count as empty and have no steps. Added tokens in a text count one. A name that is taken gets a trailing
    underscore. Rows are independent; nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    name = free_name([c for c in docs.columns if c != text_col], "prefix_steps")

    def make():
        counter = build(shipped.value, PrefixCounter)
        return lambda texts: {name: pa.array([counter.steps(t or "") for t in texts], pa.binary())}

    return map_texts(docs, text_col, make, f"`{name}` binary")


def within_budget(counted: DataFrame, limit: int = LIMIT, steps_col: str = "prefix_steps") -> DataFrame:
    """``counted`` without its steps, with n_tokens and fit_chars, the characters of the longest prefix of at most ``limit`` tokens."""
    others = [c for c in counted.columns if c != steps_col]
    n_col, fit_col = (free_name(others, c) for c in ("n_tokens", "fit_chars"))

    def make():
        def work(steps: list) -> dict:
            n, fit = zip(*(read_budget(s or b"", limit) for s in steps)) if steps else ((), ())
            return {n_col: pa.array(n, pa.int64()), fit_col: pa.array(fit, pa.int64())}

        return work

    return map_texts(counted, steps_col, make, f"`{n_col}` long, `{fit_col}` long")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, with_prefixes: bool = False, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, fit_chars and, if asked for, the counts at every character prefix.

    All come from the steps of ``prefix_steps``. Null texts count as empty (0 tokens, 0 characters, prefix counts [0]).
    Names that are taken get a trailing underscore.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    others = [c for c in docs.columns if c != text_col]
    n_col, fit_col, all_col = (free_name(others, c) for c in ("n_tokens", "fit_chars", "prefix_tokens"))

    def make():
        counter = build(shipped.value, PrefixCounter)

        def work(texts: list) -> dict:
            steps = [counter.steps(t or "") for t in texts]
            n, fit = zip(*(read_budget(s, limit) for s in steps)) if steps else ((), ())
            new = {n_col: pa.array(n, pa.int64()), fit_col: pa.array(fit, pa.int64())}
            if with_prefixes:
                new[all_col] = pa.array([np.concatenate([[0], np.cumsum(np.frombuffer(s, "<i2"))]).astype(np.int32) for s in steps], pa.list_(pa.int32()))
            return new

        return work

    return map_texts(docs, text_col, make, f"`{n_col}` long, `{fit_col}` long" + (f", `{all_col}` array<int>" if with_prefixes else ""))


def truncate(counted: DataFrame, budget: int, prefix_col: str = "prefix_tokens") -> DataFrame:
    """``counted`` with max_chars: characters of the longest prefix within ``budget``, from stored prefix counts alone."""
    at = F.sequence(F.lit(0), F.size(prefix_col) - 1)
    within = F.filter(F.arrays_zip(at.alias("at"), F.col(prefix_col).alias("n")), lambda x: x.n <= budget)
    return counted.withColumn(free_name(counted.columns, "max_chars"), F.array_max(F.transform(within, lambda x: x["at"])))
