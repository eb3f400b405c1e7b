"""Caption text as column expressions: cleaning, joining, counting, wrapping, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the caption format.
MAX_LINE_CHARS, MAX_CUE_CHARS = 42, 78
CJK = r"\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef"
SOUTH_EAST_ASIAN = r"\u0e00-\u0e7f\u0e80-\u0eff\u1000-\u109f"
NO_SPACE = SOUTH_EAST_ASIAN + CJK
NO_LINE_START = "、，。．！？：；）〕】》」』〉’”…・"
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Runs of white space that are not one plain space.
ODD_SPACES = f" {SPACE}+|(?! ){SPACE}{SPACE}*"
#: A mark that lacks a space behind it, neither inside a number nor after a single letter; it begins with the mark, which is found at once.
AFTER_MARK = r"""([,.;:!?])(?=[^ "'])(?<![0-9][.,:](?=[0-9]))(?<!(?<![A-Za-z])[A-Za-z]\.(?=[A-Za-z]))"""
#: Where a second line may begin in a clean text: after a space, or between characters of scripts without spaces, the latter not a closing mark.
BREAK = f"(?<= )|(?<=[{NO_SPACE}])(?=[{NO_SPACE}])(?![{NO_LINE_START}])"
LONE_I = "i(?<![A-Za-z0-9_]i)(?![A-Za-z0-9_])"
TIMESTAMPED = "_timestamped"
MAX_NAME_CHARS = 100


def _text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c) -> Column:
    """Without white space at either end, in the wide sense (no-break and ideographic spaces too)."""
    return F.regexp_replace(_text(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def clean(c) -> Column:
    """Collapse white space, fix the spaces around punctuation, write a lone ``i`` as ``I``."""
    c = F.trim(F.regexp_replace(_text(c), ODD_SPACES, " "))
    c = F.regexp_replace(c, " +([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, AFTER_MARK, "$1 "), LONE_I, "I"))


def starts_without_space(c) -> Column:
    return F.left(_text(c), F.lit(1)).rlike(f"^[{NO_SPACE}]")


def ends_without_space(c) -> Column:
    return F.right(_text(c), F.lit(1)).rlike(rf"[{NO_SPACE}]\z")


def join_pair(left, right) -> Column:
    """Two texts with a space between, unless a script without word spaces meets the seam."""
    left, right = _text(left), _text(right)
    glued = ends_without_space(left) | starts_without_space(right)
    return F.when(left == "", right).when(right == "", left).when(glued, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def join_all(texts) -> Column:
    """``join_pair`` over an array, from the left; null if one text is. What goes between two texts hangs on these two alone, so it takes one pass."""

    def spaced(t: Column) -> Column:
        before = lambda i: F.element_at(t, F.greatest(i, F.lit(1)))  # noqa: E731  the text in front; the first has none
        glued = lambda x, i: ends_without_space(before(i)) | starts_without_space(x)
        return F.transform(t, lambda x, i: F.when((i == 0) | glued(x, i), x).otherwise(F.concat(F.lit(" "), x)))

    said = F.transform(F.array(F.filter(_text(texts), lambda x: x != "")), spaced)[0]  # bound once
    return F.when(F.exists(_text(texts), lambda x: x.isNull()), F.lit(None)).otherwise(F.array_join(said, ""))


def word_count(c) -> Column:
    """Words, where each character of a script without word spaces counts as one."""
    c = _text(c)
    rest = F.split(F.regexp_replace(c, f"[{NO_SPACE}]", " "), SPACE + "+")
    return F.regexp_count(c, F.lit(f"[{NO_SPACE}]")) + F.size(F.filter(rest, lambda w: w != ""))


def normalise_word(c) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9']+", "")


def split_words(c) -> Column:
    return F.filter(F.split(clean(c), " "), lambda w: w != "")


def utf16_length(c) -> Column:
    """Characters, where those beyond the basic plane count two."""
    c = _text(c)
    return F.char_length(c) + F.when(F.octet_length(c) == F.char_length(c), 0).otherwise(F.regexp_count(c, F.lit(r"[\x{10000}-\x{10ffff}]")))


def char_weight(c) -> Column:
    return F.greatest(utf16_length(c), F.lit(1))


def ends_sentence(c) -> Column:
    return _text(c).rlike("""[.!?。！？…]["'”’)\\]]*\\z""")


def ends_clause(c) -> Column:
    return _text(c).rlike("""[,;:，、；：]["'”’)\\]]*\\z""")


def capitalise_first(c) -> Column:
    """Upper-case the first ASCII letter, wherever it stands."""
    c = _text(c)
    at = F.regexp_instr(c, F.lit("[A-Za-z]"))
    return F.when(at > 0, F.overlay(c, F.upper(F.substring(c, at, F.lit(1))), at)).otherwise(c)


def capitalise_sentences(c) -> Column:
    """Upper-case each ASCII letter that begins the text or follows ``.``, ``!`` or ``?`` and white space."""
    parts = F.split(_text(c), rf"(?<=[.!?])(?={SPACE})")
    opened = rf"\A({SPACE}*)([a-z])"
    up = lambda p: F.concat(F.regexp_extract(p, opened, 1), F.upper(F.regexp_extract(p, opened, 2)), F.regexp_replace(p, opened, ""))
    first = lambda p: F.when(p.rlike(r"\A[a-z]"), up(p)).otherwise(p)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, first(p)).when(p.rlike(opened), up(p)).otherwise(p)), "")


def terminator(c) -> Column:
    """What ends a last sentence: an ideographic stop, nothing in other scripts without spaces, else a full stop."""
    c = F.regexp_replace(_text(c), rf"{SPACE}+\z", "")
    return F.when(c.rlike(rf"[{CJK}]\z"), "。").when(ends_without_space(c), "").otherwise(".")


def units(c) -> Column:
    """UTF-16 units, the length that the caption limits are stated in: two for a character beyond the basic plane."""
    return utf16_length(c)


def wrap(c) -> Column:
    """Text of at most 42 UTF-16 units as it is; else the two lines of least overflow, no orphan if possible, best balance."""
    return F.transform(F.array(clean(c)), _wrap_clean)[0]  # bound once: every candidate looks at the cleaned text


def _wrap_clean(c: Column) -> Column:
    """One pass over the pieces between breaks, which adds up units, words and characters: no break looks at the whole text again."""
    number = lambda n: F.lit(n).cast("int")
    words = lambda p: F.when(p.rlike(f"[{NO_SPACE}]"), word_count(p)).otherwise(number(1))  # noqa: E731  no break parts a word

    def step(all_: Column, at: Column, p: Column) -> Column:
        n, m = at["u"] - at["gap"], all_["u"] - at["u"]
        over = F.greatest(number(0), n - MAX_LINE_CHARS) + F.greatest(number(0), m - MAX_LINE_CHARS)
        orphan = ((at["w"] == 1) | (all_["w"] - at["w"] == 1)).cast("int")
        here = F.when(at["i"] > 0, F.struct(over.alias("o"), orphan.alias("n"), F.abs(n - m).alias("b"), at["i"].alias("i")))
        return F.struct(
            (at["u"] + units(p)).alias("u"), (at["w"] + words(p)).alias("w"), (at["i"] + F.char_length(p)).alias("i"), p.endswith(" ").cast("int").alias("gap"),
            F.least(at["best"], here).alias("best"))  # the first of equals

    begin = F.struct(*[number(0).alias(x) for x in ("u", "w", "i", "gap")], F.lit(None).cast("struct<o:int,n:int,b:int,i:int>").alias("best"))
    whole = F.array(F.struct(units(c).alias("u"), word_count(c).alias("w")))
    place = F.transform(whole, lambda all_: F.aggregate(F.split(c, BREAK), begin, lambda at, p: step(all_, at, p))["best"]["i"])
    lines = lambda i: F.concat(F.rtrim(F.substring(c, F.lit(1), i)), F.lit("\n"), F.substring(c, i + 1, F.char_length(c)))
    return F.when(units(c) <= MAX_LINE_CHARS, c).otherwise(F.coalesce(F.transform(place, lines)[0], c))


def flatten_lines(c) -> Column:
    return F.replace(_text(c), F.lit("\n"), F.lit(" "))


def speaker_label(speaker_id) -> Column:
    """``SPEAKER_07``; longer numbers are not cut; null without a number."""
    return F.when(_text(speaker_id).isNotNull(), F.format_string("SPEAKER_%02d", _text(speaker_id).cast("long")))


def sanitise_name(c) -> Column:
    return F.regexp_replace(_text(c), r"[\x00-\x1f\x7f]", "")


def escape_annotation(c) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(_text(c), F.lit(plain), F.lit(escaped))
    return c


def speaker_prefix(display) -> Column:
    d = _text(display)
    return F.when(d.isNull(), "").otherwise(F.concat(F.lit("["), sanitise_name(d), F.lit("]: ")))


def voice_span(display, text) -> Column:
    d = _text(display)
    return F.when(d.isNull(), _text(text)).otherwise(F.concat(F.lit("<v "), escape_annotation(sanitise_name(d)), F.lit(">"), _text(text), F.lit("</v>")))


def strip_controls(c) -> Column:
    return F.regexp_replace(_text(c), r"\p{Cc}", "")


def validated_name(c) -> Column:
    """A struct (value, error): trimmed, without control characters, not blank, at most 100 characters."""
    name = trim_space(strip_controls(trim_space(F.coalesce(_text(c), F.lit("")))))
    error = F.when(name == "", "blank").when(F.char_length(name) > MAX_NAME_CHARS, "too long")
    return F.struct(F.when(error.isNull(), name).alias("value"), error.alias("error"))


def normalise_language(c) -> Column:
    c = trim_space(F.coalesce(_text(c), F.lit("")))
    return F.when(c == "", "auto").otherwise(F.lower(c))


def requested_language(c) -> Column:
    """Null where the language is to be detected."""
    return F.nullif(_text(c), F.lit("auto"))


def video_id(url) -> Column:
    """The 11-character id of a video address, or null."""
    u = _text(url)
    host, path = F.lower(F.try_parse_url(u, F.lit("HOST"))), F.try_parse_url(u, F.lit("PATH"))
    named = F.try_url_decode(F.try_parse_url(u, F.lit("QUERY"), F.lit("v")))
    raw = F.when(host.isin("youtu.be", "www.youtu.be"), F.regexp_extract(path, "^/*([^/]*)", 1)).when(
        host.contains("youtube.com"), F.when(path == "/watch", named).otherwise(F.regexp_extract(path, "^/(shorts|embed)/([^/]*)", 2)))
    return F.when(raw.rlike(r"^[A-Za-z0-9_-]{11}\z"), raw)


def model_alias(c) -> Column:
    """The other spelling of a model id, with or without its suffix; null for the bare suffix."""
    c = _text(c)
    return F.when(c == TIMESTAMPED, F.lit(None)).when(c.endswith(TIMESTAMPED), F.substring(c, F.lit(1), F.char_length(c) - len(TIMESTAMPED))).otherwise(F.concat(c, F.lit(TIMESTAMPED)))


def prepared_name(source_type, source_key) -> Column:
    return F.concat(_text(source_type), F.lit("-"), _text(source_key), F.lit(".wav"))


def short_id(c) -> Column:
    return F.substring(_text(c), 1, 8)


def parse_iso(c) -> Column:
    return F.try_to_timestamp(_text(c))


def truncate(c, n: int) -> Column:
    return F.left(_text(c), F.lit(n))


def basename(c) -> Column:
    return F.regexp_extract(_text(c), r"([^/\\]*)\z", 1)


def export_base_name(c) -> Column:
    """File name without its last extension, ``transcript`` if there is none."""
    return F.coalesce(F.nullif(F.regexp_replace(_text(c), r"\.[^/.]+\z", ""), F.lit("")), F.lit("transcript"))


def exit_message(signal, code, panicked) -> Column:
    """What the end of a helper process means. A panic is the engine's own fault, with a signal or, in debug builds, a status."""
    signal, code, panicked = _text(signal), _text(code), F.coalesce(_text(panicked), F.lit(False))
    status = F.format_string(" with status %d", code.cast("int"))
    return (
        F.when((signal == 6) & panicked, "the engine panicked (signal 6)").when(signal == 6, "the engine aborted, perhaps over a damaged model (signal 6)")
        .when(signal == 9, "the engine was killed (signal 9)").when(signal == 11, "the engine made an invalid access (signal 11)")
        .when(signal.isNotNull(), F.format_string("the engine ended by signal %d", signal.cast("int")))
        .when(code.isNotNull() & panicked, F.concat(F.lit("the engine panicked"), status)).when(code.isNotNull(), F.concat(F.lit("the engine ended"), status))
        .otherwise("the engine ended abnormally"))
