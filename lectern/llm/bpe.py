"""Byte-level BPE: encoding by a contiguous rank array per word, decoding by a table of token bytes.

A tokenizer file (JSON with a byte-level BPE model) is read once on the driver and broadcast as text; each Python
worker builds its tables once. Words repeat, so each worker keeps a bounded cache from word to packed ids.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import free_name, map_texts, remembered

#: Longer words are merged with a heap: the scan for the minimum takes quadratic time, so it is for short words.
SHORT_WORD = 128
#: Words kept per worker, and the longest that is kept; a full cache starts anew.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
NONE = 1 << 60
#: Characters of a text and ids that are worked on at once; they change no result.
BLOCK_CHARS, BLOCK_IDS = 1 << 18, 1 << 16
#: A space before anything but white space begins a word of the pre-tokenizer, whatever stands before it.
OPENING = re.compile(r" (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies: fixed values of the file format."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Fixed value of the file format: how ``ByteLevel`` with ``use_regex`` splits text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Tables of one tokenizer, and the merge procedure."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE file without normalizer, dropout and prefix space is needed")
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items()}
        self.byte_ids = [model["vocab"][letters[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[model["vocab"][a] << 32 | model["vocab"][b]] = rank
            self.merged.append(model["vocab"][a + b])
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError("added tokens that strip or need whole words are not supported")
            self.special[t["content"]] = t["id"]
            self.token_bytes[t["id"]] = t["content"].encode()
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = regex.compile(SPLIT).findall

    def sections(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of ordinary text and added tokens, in order."""
        if not self.special_split or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        return [(s, bool(i % 2)) for i, s in enumerate(self.special_split.split(text)) if s]

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SHORT_WORD:
            return self._merge_long(ids)
        ranks_of, merged = self.ranks.get, self.merged
        ranks = [ranks_of(a << 32 | b, NONE) for a, b in pairwise(ids)]  # ranks[i]: of the parts at boundaries i and i + 1
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = ranks_of(ids[i] << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = ranks_of(ids[i - 1] << 32 | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, from a heap of (rank, place) over linked parts."""
        n, ranks_of = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := ranks_of(a << 32 | b, NONE)) != NONE]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks_of(ids[i] << 32 | ids[j], NONE) != rank:
                continue  # a part has changed since
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks_of(ids[i] << 32 | ids[k], NONE)) != NONE:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks_of(ids[h] << 32 | ids[i], NONE)) != NONE:
                heappush(heap, (r, h))
        return [t for t in ids if t >= 0]

    def decode(self, ids) -> str:
        """Text of token ids; added tokens stand for their own text, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_packed(self, packed: bytes) -> str:
        """``decode`` of ids as little-endian unsigned 32-bit integers, block by block."""
        decoder, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for lo in range(0, len(packed), 4 * BLOCK_IDS):
            ids = np.frombuffer(packed, "<u4", min(BLOCK_IDS, (len(packed) - lo) // 4), lo).tolist()
            out.append(decoder.decode(b"".join(map(self.token_bytes.__getitem__, ids))))
        return "".join(out) + decoder.decode(b"", True)


class WordCache(dict):
    """From word to whatever ``make`` gives for it, bounded."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def build(text: str, kind=None):
    """One set of tables and caches per worker and file: the tokenizer, or ``kind(tokenizer)``."""
    return remembered((hash(text), kind), lambda: kind(build(text)) if kind else ByteBpe(text))


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunk_lookup(section: str, first, rest: WordCache, words) -> list | None:
    """Values of the stretches between spaces, or None if the section has to be split as a whole.

    A space in front of anything but white space begins a word of the pre-tokenizer whatever stands before it, so
    each stretch can be looked up with its space. Stretches that are empty or begin with white space depend on
    their neighbours; ``rest`` holds None for them.
    """
    chunks = section.split(" ")
    if chunks[0][:1].isspace() or len(chunks) == 1 and not chunks[0]:
        return None
    found = list(map(rest.__getitem__, chunks[1:]))
    return None if None in found else [first(words(chunks[0])), *found] if chunks[0] else found


def chunk_cache(join, words) -> WordCache:
    return WordCache(lambda chunk: None if not chunk or chunk[0].isspace() else join(words(" " + chunk)))


class Encoder:
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.packed = WordCache(lambda w: np.array(bpe.merge(w.encode()), "<u4").tobytes())
        self.chunks = chunk_cache(self.join, bpe.words)

    def join(self, words: list[str]) -> bytes:
        return b"".join(map(self.packed.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Long texts go block by block, so little beside text and ids is held."""
        out = bytearray()
        for section, special in self.bpe.sections(text):
            if special:
                out += np.array([self.bpe.special[section]], "<u4").tobytes()
                continue
            for block in blocks(section):
                found = chunk_lookup(block, self.join, self.chunks, self.bpe.words)
                out += self.join(self.bpe.words(block)) if found is None else b"".join(found)
        return bytes(out)


def blocks(section: str) -> Iterator[str]:
    """Pieces of about ``BLOCK_CHARS`` characters that end before a space with something behind it, where a word begins whatever stands before."""
    start = 0
    while len(section) - start > BLOCK_CHARS and (m := OPENING.search(section, start + BLOCK_CHARS)):
        yield section[start : m.start()]
        start = m.start()
    yield section[start:] if start else section


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids_le", count_col: str = "n_tokens", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without the text, with its token ids (packed little-endian), their number and the decoded text.

    Null texts count as empty: no ids and an empty decoded text. New columns whose names are taken get a trailing
    underscore. Rows are independent, so nothing is shuffled; one long text is one row's work.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    ids_col, count_col, decoded_col = (free_name([c for c in docs.columns if c != text_col], c) for c in (ids_col, count_col, decoded_col))

    def make():
        encoder, bpe = build(shipped.value, Encoder), build(shipped.value)

        def work(texts: list) -> dict:
            packed = [encoder.encode(t or "") for t in texts]
            decoded = [bpe.decode_packed(p) for p in packed]
            return {ids_col: pa.array(packed, pa.binary()), count_col: pa.array([len(p) // 4 for p in packed], pa.int64()), decoded_col: pa.array(decoded, pa.string())}

        return work

    return map_texts(docs, text_col, make, f"`{ids_col}` binary, `{count_col}` long, `{decoded_col}` string")
