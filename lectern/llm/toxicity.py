"""Toxicity of texts that may be disguised: noisy-channel decoding of character lattices, then a word model.

Each token becomes a lattice of what its characters may stand for: look-alike digits and symbols, repeated letters, and
separators inside words. Short tokens in a row (``i d i o t``, ``st u pid``) share one lattice in which the gaps between them
may be dropped. A Viterbi search over the whole lattice, however long, finds the cheapest reading under channel costs plus a
character 4-gram model that is counted over all documents. The restored words are scored by a logistic model learned from
labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, map_texts
from .linear import Adam, sample_labelled, sigmoid

#: Symbols of the character model: 0 ends a word, 1 to 26 are a to z without accents, 27 is any other letter.
SYMBOLS = 28
#: Weight of the shorter history in each step of the interpolated model.
BACKOFF = 4.0
#: Channel costs in nats: a look-alike read as a letter, a separator dropped inside a word, a separator kept, a run
#: of three or more read as one or two letters, a doubled letter read as one, a gap in spaced letters dropped or kept, a gap
#: between short pieces of words dropped.
LOOKALIKE, DROP, KEEP, RUN_ONE, RUN_TWO, DOUBLE_ONE, GAP_DROP, GAP_KEEP, SPLIT_DROP = 1.0, 1.5, 4.0, 0.5, 1.0, 4.0, 0.1, 4.0, 3.0
#: Tokens of so many characters may be pieces of a word.
PIECE = 3
#: What it costs more not to read a look-alike as a letter.
NOT_A_LETTER = 4.0
#: Letters that digits, symbols and letters of other scripts are used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "τ": "t", "υ": "u", "ρ": "p",
}
#: Steps of a search after which its settled part is first given out, and characters that are split into tokens at once:
#: neither changes a reading, both bound the memory that very long texts take.
WINDOW, BLOCK_CHARS = 512, 1 << 18
#: Tokens and stretches of short ones remembered per worker, and the longest of either that is.
CACHE_TOKENS, CACHE_CHARS, CACHE_PIECES = 400_000, 40, 6
#: Labelled documents of each label to fit on.
SAMPLE_PER_LABEL = 3000
#: A word or stem enters the model if so large a share of the toxic sample has it, with this z score and this lift;
#: at most so many do. Stems are the first so many letters of a word; END marks a whole word.
LEAST_SHARE, LEAST_Z, LEAST_LIFT, MOST_WORDS = 0.01, 3.0, 8.0, 256
STEMS, END = range(3, 9), "$"
STEPS, RATE, DECAY = 500, 0.1, 1e-5
#: Min-hashes of a sampled text, those in a band, the share that near copies agree in, and the hashes' factors and addends (odd and any, from the square root of two).
HASHES, BAND, AGREEMENT = 128, 4, 0.76
FACTORS, ADDENDS = (np.cumsum(np.full(HASHES, x, np.uint64)) | np.uint64(1) for x in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B))
ORNAMENTS = {"$$$", "!!!", "|||", "+++", "@@@"}
LOOKALIKE_CHARACTERS = frozenset(LOOKALIKES)
EDGE = ".,;:?\"'()[]{}<>“”‘’«»¿-–—_*#&%~^=`/\\"


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x250 + 1, np.int64)
    for cp in range(0x250):
        c = chr(cp).lower()
        if c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            table[cp] = ord(base) - 96 if "a" <= base <= "z" else 27
    table[0x250] = 27
    return table


TABLE = _symbol_table()


class Symbols(dict):
    """From character to symbol, filled as characters occur."""

    def __missing__(self, c: str) -> int:
        found = self[c] = int(TABLE[min(ord(c), 0x250)]) if c.isalpha() else 0
        return found


symbol = Symbols().__getitem__


def coded(options: list[tuple[str, float]]) -> list[tuple[str, float, list[int]]]:
    """Options of a node with their symbols."""
    return [(o, cost, [symbol(c) for c in o]) for o, cost in options]


def follow(back: list[dict[int, tuple[int, str]]], state: int) -> list[str]:
    """The options on the path that ends in ``state``."""
    out = []
    for came in reversed(back):
        state, o = came[state]
        out.append(o)
    return out[::-1]


def with_last(items: Iterable) -> Iterator[tuple[bool, object]]:
    """Each item, with whether it is the last."""
    before: list = []
    for item in items:
        if before:
            yield False, before[0]
        before = [item]
    if before:
        yield True, before[0]


#: Nodes that stand between characters: the end of a word, the gap between spaced letters, the one between pieces of
#: words, and exclamation marks at the end of a token.
WORD_END = [("", 0.0, [0])]
SPACED_GAP, PIECE_GAP = coded([("", GAP_DROP), (" ", GAP_KEEP)]), coded([(" ", 0.0), ("", SPLIT_DROP)])
ORNAMENT = coded([("", 0.0), *((x, LOOKALIKE) for x in LOOKALIKES["!"])])
GAP, DOUBLED, REPEATED = re.compile(r"\s"), re.compile(r"(.)\1", re.DOTALL), re.compile(r"(.)\1+", re.DOTALL)


#: Two or more tokens in a row that may be pieces, in a byte for each token.
SHORT_ONES = re.compile(rb"\x01{2,}")


class Unseen(dict):
    """For ``str.translate``: characters of some categories go; filled as characters occur."""

    def __init__(self, *categories: str):
        super().__init__()
        self.categories = categories

    def __missing__(self, point: int) -> int | None:
        found = self[point] = None if unicodedata.category(chr(point)) in self.categories else point
        return found


INVISIBLE, ACCENTS = Unseen("Cf", "Mn"), Unseen("Mn")


class Remembered(dict):
    """From a word to what ``make`` gives for it; of words longer than ``longest`` nothing is kept, a full memory starts anew."""

    def __init__(self, make, longest: float = float("inf")):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= CACHE_TOKENS:
                self.clear()
            self[word] = found
        return found


def blocks(text: str) -> Iterator[str]:
    """A text in stretches of about ``BLOCK_CHARS`` characters, cut at white space alone."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + BLOCK_CHARS)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def fourgrams(texts: list) -> np.ndarray:
    """Indices of (three symbols of history, symbol) at every character of the texts; history ends at word ends."""
    data = " ".join(t for t in texts if t).lower() + " "
    points = np.frombuffer(data.encode("utf-32-le", "replace"), "<u4")
    marks = (points >= 0x2000) & (points < 0x2070) | (points >= 0x3000) & (points < 0x3030)
    s = np.where(marks, 0, TABLE[np.minimum(points, 0x250)])
    s = np.concatenate([np.zeros(3, np.int64), s])
    h1 = s[2:-1]
    h2 = np.where(h1 == 0, 0, s[1:-2])
    h3 = np.where(h2 == 0, 0, s[:-3])
    index = ((h3 * SYMBOLS + h2) * SYMBOLS + h1) * SYMBOLS + s[3:]
    return index[(s[3:] != 0) | (h1 != 0)]


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [h3, h2, h1, next], counted over all of ``docs``; each task sends only its totals."""
    size = SYMBOLS**4

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            held: list[str] = []
            for part in chain.from_iterable(blocks(t) for t in batch.column(0).to_pylist() if t):
                held.append(part)
                if sum(map(len, held)) >= BLOCK_CHARS:
                    total += np.bincount(fourgrams(held), minlength=size)
                    held = []
            total += np.bincount(fourgrams(held), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    sums = docs.select(text_col).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    shape = (SYMBOLS,) * 4
    c4 = counts.reshape(shape)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = c4.sum(axis=axes) if axes else c4
        p = (c + BACKOFF * SYMBOLS * p) / (c.sum(axis=-1, keepdims=True) + BACKOFF * SYMBOLS) if len(axes) == 3 else (c + BACKOFF * np.broadcast_to(p, c.shape)) / (c.sum(axis=-1, keepdims=True) + BACKOFF)
    return np.log(p).astype(np.float32).reshape(-1)


class Restorer:
    """Readings of tokens under a character model."""

    def __init__(self, log_probs: np.ndarray):
        self.lp = (-log_probs).tolist()
        self.known = Remembered(self._token, CACHE_CHARS)
        self.token = self.known.__getitem__  # the reading of one token without white space; plain words come back as they are
        self.stretches: dict[tuple, list[str]] = {}
        self.choices: dict[tuple[str, int], list] = {}
        self.edges: dict[str, tuple] = {}
        self.hits: dict[int, Remembered] = {}  # what models find in words, kept as long as the readings

    def options(self, c: str, n: int) -> list[tuple[str, float]]:
        """What a run of ``n`` equal characters inside a token may stand for, with costs."""
        if c.isalpha() and c not in LOOKALIKES:
            return [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, DOUBLE_ONE)] if n == 2 else [(c, RUN_ONE), (c + c, RUN_TWO)]
        out = [(x * min(n, 2), LOOKALIKE + (RUN_TWO if n > 2 else 0)) for x in LOOKALIKES.get(c, "")]
        if n > 1:
            out += [(x, LOOKALIKE + (RUN_ONE if n > 2 else DOUBLE_ONE)) for x in LOOKALIKES.get(c, "")]
        more = NOT_A_LETTER if c in LOOKALIKES else 0.0
        if c.isalpha():
            return out + [(c, KEEP + more)]
        return out + [(" ", KEEP + more)] + ([] if c.isdigit() else [("", DROP + more)])

    def nodes(self, characters: Iterable[str]) -> Iterator[list]:
        """The nodes of a lattice: one for each run of equal characters, its options with their symbols."""
        for c, run in groupby(characters):
            n = min(len(list(islice(run, 3))), 3)
            if (found := self.choices.get((c, n))) is None:
                found = self.choices[c, n] = coded(self.options(c, n))
            yield found

    def search(self, lattice: Iterable[list]) -> str:
        """Viterbi: the cheapest reading of all nodes; states are the last three symbols.

        Steps point back to the state they came from. Now and then the paths of all states are followed back to where
        they meet; what lies before is settled, whatever comes, and is given out.
        """
        lp, size, cut = self.lp, SYMBOLS, SYMBOLS**2
        costs: dict[int, float] = {0: 0.0}
        back: list[dict[int, tuple[int, str]]] = []
        settled: list[str] = []
        due = WINDOW
        for options in chain(lattice, (WORD_END,)):
            new: dict[int, float] = {}
            came: dict[int, tuple[int, str]] = {}
            for h, cost in costs.items():
                for o, extra, codes in options:
                    total, g = cost + extra, h
                    for s in codes:
                        if s or g % size:  # a word end after a word end says nothing
                            total += lp[g * size + s]
                        g = (g % cut) * size + s if s else 0
                    if g not in new or total < new[g]:
                        new[g], came[g] = total, (h, o)
            costs = new
            back.append(came)
            if len(back) >= due:
                t, at = len(back), set(costs)
                while t and len(at) > 1:
                    t -= 1
                    at = {back[t][h][0] for h in at}
                settled += follow(back[:t], at.pop()) if len(at) == 1 else []
                back = back[t:]
                due = WINDOW + 2 * len(back)
        return "".join(settled + follow(back, min(costs, key=costs.__getitem__)))

    def doubled(self, letters: str) -> str | None:
        """What ``search`` reads in letters that stand for themselves, where each doubled one can be decided by itself; else None.

        Reading it once or twice changes the costs of the next three symbols alone, the end of the word being one.
        """
        places = [m.span() for m in REPEATED.finditer(letters)]
        if any(end - at > 2 for at, end in places) or any(b[0] - a[1] < 2 for a, b in pairwise(places)):
            return None
        lp, size, cut = self.lp, SYMBOLS, SYMBOLS**2
        codes, once = [*map(symbol, letters), 0], []
        for at, end in places:
            g = 0
            for s in codes[max(0, at - 2) : end - 1]:
                g = g % cut * size + s
            h = g % cut * size + codes[at]
            twice, single = lp[g * size + codes[at]], DOUBLE_ONE
            for s in codes[end : end + 3]:
                twice, single = twice + lp[h * size + s], single + lp[g * size + s]
                g, h = g % cut * size + s, h % cut * size + s
            if single < twice:
                once.append(at)
        for at in reversed(once):
            letters = letters[:at] + letters[at + 1 :]
        return letters

    def _token(self, token: str) -> str:
        t = token if token.isascii() else unicodedata.normalize("NFKC", token).translate(INVISIBLE)
        core = t.strip(EDGE)
        if not core.isalpha():
            for edge in (core[-3:], core[:3]):
                if edge in ORNAMENTS:  # a run of three or more at an edge
                    core = core.strip(edge[0]).strip(EDGE)
        plain = core.rstrip("!")  # after letters alone, exclamation marks are what they are
        if plain.isalpha() and (plain.isascii() or LOOKALIKE_CHARACTERS.isdisjoint(plain)):
            if not DOUBLED.search(plain):
                return plain
            if plain == core and (found := self.doubled(plain)) is not None:
                return found
        if not any(c.isalpha() or c in LOOKALIKES for c in core) or core.isdigit():
            return core
        ending = [ORNAMENT] if plain != core else []  # at the end of other tokens they may also stand for letters
        return self.search(chain(self.nodes(plain), ending)).strip()

    def spaced(self, tokens: list[str]) -> str:
        """The reading of three or more single characters in a row."""

        def lattice():
            first = True
            for c, run in groupby(tokens):
                if c.isalnum() or c in LOOKALIKES:
                    if not first:
                        yield SPACED_GAP
                    yield from self.nodes(run)
                    first = False

        return self.search(lattice()).strip()

    def ends(self, piece: str) -> tuple[int, float, list[int], float]:
        """What joining a piece to its neighbours needs: the history and the cost at its end, its first three symbols and their cost at the start of a word."""
        found = self.edges.get(piece)
        if found is None:
            lp, codes = self.lp, [*map(symbol, piece)]
            g, head = 0, 0.0
            for i, s in enumerate([*codes, 0]):
                cost = lp[g * SYMBOLS + s]
                head += cost if i < 3 else 0.0
                g, last = g % SYMBOLS**2 * SYMBOLS + s, g
            if len(self.edges) >= CACHE_TOKENS:
                self.edges.clear()
            found = self.edges[piece] = last, cost, [*codes, 0][:3], head
        return found

    def torn(self, a: str, b: str) -> bool:
        """Whether two pieces are likelier to be one word."""
        if not (a.isalpha() and b.isalpha()):
            return False
        g, end, _, _ = self.ends(a)
        _, _, codes, head = self.ends(b)
        joined = SPLIT_DROP
        for s in codes:
            joined += self.lp[g * SYMBOLS + s]
            g = g % SYMBOLS**2 * SYMBOLS + s
        return joined < end + head

    def pieces(self, tokens: list[str]) -> list[str]:
        """The reading of two or more short tokens in a row: gaps fall where the whole is then cheaper."""
        key = tuple(tokens) if len(tokens) <= CACHE_PIECES else None
        found = self.stretches.get(key)
        if found is None:
            found = list(map(self.token, tokens))
            if any(map(self.torn, found, found[1:])):
                gaps = chain.from_iterable(([] if i == 0 else [PIECE_GAP], self.nodes(w)) for i, w in enumerate(filter(None, found)))
                found = self.search(chain.from_iterable(gaps)).split()
            if key:
                if len(self.stretches) >= CACHE_TOKENS:
                    self.stretches.clear()
                self.stretches[key] = found
        return found

    def short(self, tokens: list[str], runs: list[str]) -> Iterator[str]:
        """Readings of short tokens in a row; those of three or more single characters also go to ``runs`` without gaps."""
        at = i = 0
        while i < len(tokens) - 2:
            j = i
            while j < len(tokens) and len(tokens[j]) == 1:
                j += 1
            if j - i >= 3:
                yield from self.pieces(tokens[at:i]) if i - at > 1 else map(self.token, tokens[at:i])
                read = self.spaced(tokens[i:j])
                runs.append(read.replace(" ", ""))
                yield read
                at = j
            i = max(j, i + 1)
        yield from self.pieces(tokens[at:]) if len(tokens) - at > 1 else map(self.token, tokens[at:])

    def readings(self, text: str | None) -> Iterator[tuple[list[str], list[str]]]:
        """Block by block the restored words of a text, in order, and the readings of its spaced runs without their gaps."""
        held: list[str] = []
        for last, block in with_last(blocks(text or "")):
            tokens = block.lower().split()
            end = len(tokens)
            while not last and end and len(tokens[end - 1]) <= PIECE:
                end -= 1  # short tokens may go on in the next block
            if not end and not last:
                held += tokens
                continue
            now, held = held + tokens[:end], tokens[end:]
            out: list[str] = []
            runs: list[str] = []
            at = 0
            for stretch in SHORT_ONES.finditer(bytes(map(PIECE.__ge__, map(len, now)))):
                i, end = stretch.span()
                out += map(self.token, now[at:i])
                part = now[i:end]
                out += self.short(part, runs) if len(part) > CACHE_PIECES or (known := self.stretches.get(tuple(part))) is None else known
                at = end
            out += map(self.token, now[at:])
            yield " ".join(out).split(), runs

    def words(self, text: str | None) -> tuple[list[str], list[str]]:
        """All ``readings`` of a text at once."""
        every = list(self.readings(text))
        return [w for words, _ in every for w in words], [r for _, runs in every for r in runs]


def plain_form(word: str) -> str:
    """Without accents and repeated letters, to compare readings of disguised words."""
    base = word if word.isascii() else unicodedata.normalize("NFD", word).translate(ACCENTS)
    return REPEATED.sub(r"\1", base)


def stems(word: str) -> list[str]:
    """The stems of a word and the word itself with its end marked."""
    return [word[:n] for n in STEMS if n <= len(word)] + [word + END]


DENSITY = pa.struct([("stem", pa.string()), ("s", pa.float64())])


def densities(words: list[str]) -> list[tuple[str, float]]:
    """Each stem of a text and how dense it is there: 1 for one in 25 words or more, in proportion below."""
    seen: dict[str, int] = {}
    for w in words:
        for s in stems(w):
            seen[s] = seen.get(s, 0) + 1
    return [(s, min(1.0, 25 * c / (len(words) + 25))) for s, c in sorted(seen.items())]


class ToxicityModel:
    """Weights of words and stems, and of two figures of a text: how many it has, and how many in a hundred words."""

    def __init__(self, log_probs: np.ndarray, weights: dict[str, float], bias: float, amount: tuple[float, float] = (0.0, 0.0)):
        self.log_probs, self.weights, self.bias, self.amount = log_probs, weights, bias, amount
        self.plain = {plain_form(w.rstrip(END)): w for w in weights if len(plain_form(w.rstrip(END))) >= 4}
        self.openings = {w[:n] for w in weights if w.endswith(END) for n in range(2, len(w) - 2)}
        self.heads, self.plain_heads = {w[:3] for w in weights}, {k[:2] for k in self.plain}
        self.lengths = sorted({len(k) for k, v in self.plain.items() if not v.endswith(END) and len(k) > 5})

    def hits(self, word: str) -> tuple[str, ...]:
        """The word and its stems as far as the model has them; of a word without any, those that its plain form is or begins with."""
        hit = tuple(s for s in stems(word) if s in self.weights) if (word + END)[:3] in self.heads else ()
        two = word[:2]
        if hit or two.isascii() and two[:1] != two[1:] and two not in self.plain_heads:  # these two also begin the plain form
            return hit
        if (not word.isascii() or DOUBLED.search(word)) and (bare := plain_form(word)) != word:
            begins = [v for n in self.lengths if n <= len(bare) and (v := self.plain.get(bare[:n], END))[-1:] != END]
            hit = (*begins, v) if (v := self.plain.get(bare, "")).endswith(END) else tuple(begins)
        return hit

    def evidence(self, words: list[str], memory: Remembered, known: int = 0) -> list[str]:
        """Words and stems of the model in a restored text, as often as they occur; ``memory`` remembers ``hits``.

        The first ``known`` words were looked at before and only begin words that are cut in two.
        """
        found = [*chain.from_iterable(map(memory.__getitem__, words[known:] if known else words))]
        for i in [i for i, w in enumerate(words[:-1]) if w in self.openings]:  # a word cut in two
            if (both := words[i] + words[i + 1] + END) in self.weights:
                found.append(both)
        return found

    def inside(self, runs: list[str], found: list[str]) -> list[str]:
        """What the runs of spaced letters of a text hold, wherever it stands in them, beyond what is ``found``."""
        more: list[str] = []
        for run in map(plain_form, runs):
            more += [v for k, v in self.plain.items() if k in run and v not in found and v not in more]
        return more

    @staticmethod
    def figures(found: list[str], n_words: int) -> tuple[float, float]:
        return float(np.log1p(len(found))), float(np.log1p(100 * len(found) / (n_words + 10)))

    def score(self, found: list[str], n_words: int) -> float:
        many, dense = self.figures(found, n_words)
        return float(sigmoid(np.array(self.bias + sum(self.weights[w] for w in set(found)) + self.amount[0] * many + self.amount[1] * dense)))


def choose(candidates: list[tuple[str, float]]) -> list[str]:
    """Of stems that extend one another, the one of the highest z score, the longest of nearly equal ones."""
    chosen: list[str] = []
    for word, _ in sorted(candidates, key=lambda c: (-round(np.log(c[1]) / 0.2), -len(c[0]), c[0])):
        bare = word.rstrip(END)
        if not any(bare.startswith(o.rstrip(END)) or o.startswith(bare) for o in chosen):
            chosen.append(word)
    return chosen[:MOST_WORDS]


_restorers: dict[int, Restorer] = {}


def restorer(log_probs: np.ndarray) -> Restorer:
    """One per worker and model, so its memory of tokens lasts over tasks."""
    key = hash(log_probs.tobytes())
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(log_probs)
    return _restorers[key]


def signature(words: list[str]) -> np.ndarray:
    """The least of each of ``HASHES`` hashes over the five-word shingles of a text (a shorter one is one shingle)."""
    each = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    while len(h := np.fromiter((xxhash.xxh64_intdigest(s) for s in islice(each, 1 << 12)), np.uint64)):
        np.minimum(least, (h[:, None] * FACTORS + ADDENDS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def alike(signatures: np.ndarray) -> np.ndarray:
    """For each row the first row that it is a near copy of, over any number of steps; rows that agree in a band are compared with the first there."""
    first = np.arange(len(signatures))

    def root(i: int) -> int:
        while first[i] != i:
            first[i] = i = first[first[i]]
        return i

    for lo in range(0, HASHES, BAND):
        seen: dict[bytes, int] = {}
        for i, row in enumerate(signatures):
            j = seen.setdefault(row[lo : lo + BAND].tobytes(), i)
            if root(i) != root(j) and (row == signatures[j]).mean() >= AGREEMENT:
                a, b = sorted((root(i), root(j)))
                first[b] = a
    return np.array([root(i) for i in range(len(signatures))], int)


def weighted(bags: DataFrame) -> DataFrame:
    """``bags`` (id, label, words, ...), a bounded sample, with a weight: near copies of one label weigh as one together, all others 1 each.

    Near copies are what min-hashes of five-word shingles estimate at a similarity of 0.8 or more; the driver sees these
    hashes alone, half a kilobyte a document.
    """

    def make():
        return lambda texts: {"signature": pa.array([signature((t or "").split()).tobytes() for t in texts], pa.binary())}

    rows = map_texts(bags.select("id", "label", "words"), "words", make, "signature binary").orderBy("id").collect()
    group = alike(np.array([np.frombuffer(r["signature"], np.uint32) for r in rows]).reshape(-1, HASHES))
    size: dict[tuple, int] = {}
    for r, g in zip(rows, group):
        size[r["label"], g] = size.get((r["label"], g), 0) + 1
    weights = bags.sparkSession.createDataFrame([(r["id"], 1 / size[r["label"], g]) for r, g in zip(rows, group)], f"id {bags.schema['id'].dataType.simpleString()}, weight double")
    return bags.join(F.broadcast(weights), "id")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Count the character model over all of ``docs`` and learn word weights from a bounded sample of ``labels``.

    Rows with a null or other label are left out. Labels are weighted back to their shares. Without rows of both
    labels there are no word weights and every text gets one and the same score: near 1 if all are of label 1, else near 0.
    """
    log_probs = character_model(docs, text_col)
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    sample, counts = sample_labelled(rows, "id", "label", per_label)
    if len(counts) < 2:
        return ToxicityModel(log_probs, {}, 6.0 if counts.get(1) else -6.0)
    shipped = docs.sparkSession.sparkContext.broadcast(log_probs)

    def make():
        read = restorer(shipped.value)

        def work(texts: list) -> dict:
            every = [read.words(t) for t in texts]
            said = lambda part: pa.array([" ".join(e[part]) for e in every], pa.string())
            return {"words": said(0), "runs": said(1), "stems": pa.array([densities(w) for w, _ in every], pa.list_(DENSITY))}

        return work

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    bags = durable(map_texts(picked, "text", make, "words string, runs string, stems array<struct<stem string, s double>>"), "toxicity-sample")
    bags = durable(weighted(bags), "toxicity-weights")
    n = {r[0]: r[1] for r in bags.groupBy("label").agg(F.sum("weight")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    one, zero = F.col("weight") * F.col("label"), F.col("weight") * (1 - F.col("label"))
    sums = bags.select("label", "weight", F.inline("stems")).groupBy(F.col("stem").alias("word")).agg(
        F.sum(one).alias("docs"), *[F.sum(k * F.col("s") ** power).alias(f"s{name}{power}") for name, k in ((1, one), (0, zero)) for power in (1, 2)])
    mean = {1: F.col("s11") / (n1 or 1), 0: F.col("s01") / (n0 or 1)}
    spread = (F.col("s12") / (n1 or 1) - mean[1] ** 2 + 1e-6) / (n1 or 1) + (F.col("s02") / (n0 or 1) - mean[0] ** 2 + 1e-6) / (n0 or 1)
    z = (mean[1] - mean[0]) / F.sqrt(spread)
    good = (F.col("docs") >= LEAST_SHARE * n1) & (F.col("docs") >= 3) & (mean[1] > LEAST_LIFT * mean[0])
    best = sums.where(good).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(20 * MOST_WORDS)
    lexicon = choose([(r["word"], r["z"]) for r in best.collect()])
    prior = counts[1] / sum(counts.values())
    if not lexicon or not n1 or not n0:
        return ToxicityModel(log_probs, {}, float(np.log(prior / (1 - prior))))
    draft = ToxicityModel(log_probs, dict.fromkeys(lexicon, 0.0), 0.0)
    drafted = docs.sparkSession.sparkContext.broadcast(draft)

    def make_hits():
        model = drafted.value
        memory = Remembered(model.hits)

        def work(texts: list) -> dict:
            found, n_words = [], []
            for t in texts:  # what is scored: words, and what runs of spaced letters hold beyond them
                words, runs = (part.split() for part in t.split("\n"))
                seen = model.evidence(words, memory)
                found.append(seen + model.inside(runs, seen))
                n_words.append(len(words))
            return {"found": pa.array(found, pa.list_(pa.string())), "n_words": pa.array(n_words, pa.int64())}

        return work

    rows = map_texts(bags.select("label", "weight", F.concat_ws("\n", "words", "runs").alias("words")), "words", make_hits, "found array<string>, n_words long").collect()
    # reading may miss disguised words, so a document also counts as if only one of its words had been found
    seen = [(r["label"], r["weight"], r["found"], r["n_words"]) for r in rows]
    seen += [(r["label"], r["weight"] / len(kinds), [w], r["n_words"]) for r in rows if len(kinds := sorted(set(r["found"]))) for w in kinds]
    at = {w: i for i, w in enumerate(lexicon)}
    x, y = np.zeros((len(seen), len(lexicon) + 2), np.float32), np.array([s[0] for s in seen], np.float32)
    for row, (_, _, found, n_words) in zip(x, seen):
        row[[at[w] for w in found]] = 1
        row[-2:] = draft.figures(found, n_words)
    weight = np.array([share * counts[label] / n[label] for label, share, _, _ in seen], np.float32)
    weight /= weight.sum()
    p = {"w": np.zeros(x.shape[1], np.float32), "b": np.array([np.log(prior / (1 - prior))], np.float32)}
    adam = Adam(p, RATE)
    for _ in range(STEPS):
        d = (sigmoid(x @ p["w"] + p["b"]) - y) * weight
        adam.step({"w": x.T @ d + DECAY * p["w"], "b": np.array([d.sum()])})
    return ToxicityModel(log_probs, dict(zip(lexicon, map(float, p["w"]))), float(p["b"][0]), (float(p["w"][-2]), float(p["w"][-1])))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", with_restored: bool = False) -> DataFrame:
    """``docs`` without the text, with score (0 to 1), evidence (restored words that count) and, if asked for, restored.

    Null and empty texts have no words and get the score of a text without evidence. Names that are taken get a
    trailing underscore. Rows are independent; nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != text_col]
    score_col, evidence, restored = (free_name(others, c) for c in ("score", "evidence", "restored"))

    def make():
        model = shipped.value
        read = restorer(model.log_probs)
        memory = read.hits.setdefault(hash(tuple(model.weights)), Remembered(model.hits))

        def work(texts: list) -> dict:
            scores, found, whole = [], [], []
            for t in texts:
                seen: list[str] = []
                n_words, kept, before, spaced = 0, [], [], []
                for words, runs in read.readings(t):
                    seen += model.evidence(before + words, memory, len(before))
                    n_words, before = n_words + len(words), words[-1:] or before
                    spaced += runs
                    if with_restored:
                        kept.append(" ".join(words))
                seen += model.inside(spaced, seen)
                scores.append(model.score(seen, n_words))
                found.append(sorted(set(seen)))
                whole.append(" ".join(filter(None, kept)))
            new = {score_col: pa.array(scores, pa.float64()), evidence: pa.array(found, pa.list_(pa.string()))}
            return new | ({restored: pa.array(whole, pa.string())} if with_restored else {})

        return work

    return map_texts(docs, text_col, make, f"`{score_col}` double, `{evidence}` array<string>" + (f", `{restored}` string" if with_restored else ""))
