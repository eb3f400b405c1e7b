"""Times as column expressions: rounding, overlap, clock formats, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the caption format, in seconds.
NOMINAL_WORD, LEAST_WORD, LEAST_CUE, FALLBACK_CHUNK = 0.35, 0.01, 1.2, 2.0
EPSILON = 1e-6
#: Longest media that is accepted, in seconds, and how long prepared audio is kept, in hours.
MAX_MEDIA_SECONDS, AUDIO_HOURS = 7200, 168
PROGRESS_STEP = 0.02
#: Length and stride in seconds of decode windows; distilled models have the second.
WINDOW, SMALL_WINDOW = (29.0, 5.0), (20.0, 3.0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round3(x) -> Column:
    """Halves go up, also below zero."""
    return F.floor(_c(x) * 1000 + 0.5) / 1000


def overlap(s1, e1, s2, e2) -> Column:
    zero = F.lit(0).cast("double")
    return F.greatest(zero, F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def gap(s1, e1, s2, e2) -> Column:
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    return F.when(s1 >= e2, s1 - e2).when(s2 >= e1, s2 - e1).otherwise(F.lit(0).cast("double"))


def timestamp(seconds, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``: everything is floored, hours may exceed two digits."""
    s = _c(seconds).cast("double")
    whole = lambda x: F.floor(x).cast("long")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", whole(s / 3600), whole((s % 3600) / 60), whole(s % 60), whole((s % 1) * 1000))


def parse_clock(c) -> Column:
    """Seconds of ``HH:MM:SS.frac``; anything but three numbers is null."""
    parts = F.split(F.trim(_c(c)), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3))


def banner_duration(line) -> Column:
    """Seconds in a media tool's ``Duration: HH:MM:SS.ff,`` line, or null."""
    return parse_clock(F.nullif(F.regexp_extract(_c(line), r"Duration:\s*([^,]*)", 1), F.lit("")))


def progress_position(line) -> Column:
    """Seconds in a media tool's ``out_time=`` line, or null."""
    return parse_clock(F.nullif(F.regexp_extract(_c(line), r"^out_time=(.*)$", 1), F.lit("")))


def clock(seconds) -> Column:
    """``MM:SS``, with hours in front from one hour on."""
    s = F.floor(_c(seconds)).cast("long")
    tail = F.format_string("%02d:%02d", F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(s >= 3600, F.concat(F.format_string("%02d:", F.floor(s / 3600).cast("long")), tail)).otherwise(tail)


def unit_range(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def progress_fraction(position, duration) -> Column:
    return F.when(_c(duration) > 0, unit_range(_c(position) / _c(duration)))


def job_progress(fraction, source_type) -> Column:
    """Extraction runs from 0.65 over 0.30 for downloads, from 0.05 over 0.90 for files."""
    f = _c(fraction)
    return F.when(_c(source_type) == "youtube", 0.65 + f * 0.30).otherwise(0.05 + f * 0.90)


def too_long(duration) -> Column:
    return _c(duration) > MAX_MEDIA_SECONDS


def usable_end(start, end, n_words) -> Column:
    """The segment's end if its words fit before it, else a nominal span."""
    fits = _c(end) - _c(start) >= _c(n_words) * LEAST_WORD - EPSILON
    return F.when(fits, _c(end)).otherwise(_c(start) + _c(n_words) * NOMINAL_WORD)


def overlap_offset(start, end, stripped, total) -> Column:
    """Where the first kept word begins after ``stripped`` of ``total`` weight is cut."""
    return _c(start) + F.when(_c(total) > 0, F.greatest(_c(end) - _c(start), F.lit(0.01)) * _c(stripped) / _c(total)).otherwise(0.0)


def window_span(k, length: float = WINDOW[0], stride: float = WINDOW[1]) -> Column:
    """Start and end of decode window ``k``: windows overlap by twice the stride."""
    start = _c(k) * (length - 2 * stride)
    return F.struct(start.alias("start"), (start + length).alias("end"))


def tokens_per_second(count, elapsed_ms) -> Column:
    return F.when(_c(elapsed_ms) > 0, _c(count) / (_c(elapsed_ms) / 1000))
