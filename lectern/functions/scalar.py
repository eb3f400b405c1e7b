"""Plain-Python forms of the few text functions that the sequential cue fold needs inside a task."""

from __future__ import annotations

import re

from .text import AFTER_MARK, LONE_I, MAX_LINE_CHARS, NO_LINE_START, NO_SPACE, ODD_SPACES, SPACE

_SPACES = re.compile(SPACE + "+")
_ODD_SPACES = re.compile(ODD_SPACES)
_BEFORE_MARK = re.compile(" +([,.;:!?])")
_AFTER_MARK = re.compile(AFTER_MARK)
_LONE_I = re.compile(LONE_I)
_SCRIPT = re.compile(f"[{NO_SPACE}]")
#: Where a second line may begin in a clean text: after a space, or between characters of such scripts.
_BREAK = re.compile(f"(?<= )[^ ]|(?<=[{NO_SPACE}])(?=[{NO_SPACE}])[^ {NO_LINE_START}]")
SENTENCE_END = re.compile("""[.!?。！？…]["'”’)\\]]*\\Z""")
CLAUSE_END = re.compile("""[,;:，、；：]["'”’)\\]]*\\Z""")


def clean(text: str) -> str:
    text = _BEFORE_MARK.sub(r"\1", _ODD_SPACES.sub(" ", text).strip(" "))
    return _LONE_I.sub("I", _AFTER_MARK.sub(r"\1 ", text)).strip(" ")


def is_script(char: str) -> bool:
    return bool(char) and _SCRIPT.match(char) is not None


def join_pair(left: str, right: str) -> str:
    if not left or not right:
        return left or right
    return left + ("" if is_script(left[-1]) or is_script(right[0]) else " ") + right


def word_count(text: str) -> int:
    return len(_SCRIPT.findall(text)) + len([w for w in _SPACES.split(_SCRIPT.sub(" ", text)) if w])


def length(text: str) -> int:
    """UTF-16 units, the length that the caption limits are stated in."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def most_clean(text: str) -> int:
    """No less than the length that ``text`` has when cleaned, alone or as a part: only a space after a mark makes it longer."""
    return length(text) + (0 if text.isalnum() else sum(map(text.count, ",.;:!?")))


def wrap(text: str) -> str:
    return wrap_clean(clean(text))


def wrap_clean(text: str) -> str:
    if length(text) <= MAX_LINE_CHARS:
        return text
    splits = [(text[: i - (text[i - 1] == " ")], text[i:]) for i in (m.start() for m in _BREAK.finditer(text)) if i]
    sizes = [(length(first), length(second)) for first, second in splits]
    over = [max(0, a - MAX_LINE_CHARS) + max(0, b - MAX_LINE_CHARS) for a, b in sizes]
    least = min(over, default=0)
    best = None
    for (first, second), (a, b), o in zip(splits, sizes, over):
        if o == least:  # words are counted only where the overflow decides nothing
            rank = (word_count(first) == 1 or word_count(second) == 1, abs(a - b))
            if best is None or rank < best[0]:
                best = rank, f"{first}\n{second}"
    return best[1] if best else text
