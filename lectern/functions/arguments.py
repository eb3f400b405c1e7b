"""Argument lists of the diarization engine, parsed by higher-order functions over arrays of strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import MAX_SPEAKERS, cluster_count

# The flags, those that have to be there in the order in which they are missed, and the threshold without a flag.
REQUIRED = ("--wav", "--segmentation-model", "--embedding-model")
SPEAKERS, THRESHOLD = "--num-speakers", "--cluster-threshold"
DEFAULT_THRESHOLD = 0.5
INTEGER = r"^\+?[0-9]+\z"
NUMBER = r"^[+-]?((?i:inf|infinity|nan)|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\z"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _fault(flag: Column, value: Column) -> Column:
    """What is wrong with a flag and its value, null if nothing is."""
    known = flag.isin(*REQUIRED, SPEAKERS, THRESHOLD)
    whole = F.when(value.rlike(INTEGER), F.try_to_number(F.regexp_replace(value, r"^\+?0*(?=[0-9])", ""), F.lit("9" * 38)))
    number = F.when(value.rlike(NUMBER), value.try_cast("float"))
    speakers = F.when(whole.isNull() | (whole > 2**32 - 1), F.concat(F.lit(f"{SPEAKERS} must be a non-negative integer, got "), _quoted(value))).when(
        whole > MAX_SPEAKERS, F.concat(F.lit(f"{SPEAKERS} must be between 0 and {MAX_SPEAKERS}, got "), whole.cast("string")))
    finite = ~F.isnan(number) & (F.abs(number) < float("inf")) & (number > 0)
    threshold = F.when(number.isNull(), F.concat(F.lit(f"{THRESHOLD} must be a number, got "), _quoted(value))).when(~finite, F.concat(F.lit(f"{THRESHOLD} must be a positive finite number, got "), _quoted(value)))
    return F.when(~known, F.concat(F.lit("unknown argument "), _quoted(flag))).when(value.isNull(), F.concat(flag, F.lit(" needs a value"))).when(flag == SPEAKERS, speakers).when(flag == THRESHOLD, threshold)


def parse(args) -> Column:
    """(wav, segmentation_model, embedding_model, num_speakers, cluster_threshold, clusters, error) of an array of arguments.

    Every known flag takes the argument after it, so flags stand at even places up to the first that is unknown or wrong,
    and that is the error; the others are null then. A flag that comes again replaces what it said. Without a
    mistake the first required flag that is missing is one. ``clusters`` is the number of speakers, -1 if that is to be found.
    """
    args = F.col(args) if isinstance(args, str) else args
    n = F.size(args)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(2))).otherwise(F.expr("cast(array() as array<int>)"))
    pairs = F.transform(at, lambda i: F.struct(F.get(args, i).alias("flag"), F.get(args, i + 1).alias("value")))
    faults = F.filter(F.transform(pairs, lambda p: _fault(p["flag"], p["value"])), lambda f: f.isNotNull())
    given = lambda flag: F.get(F.reverse(F.filter(pairs, lambda p: p["flag"] == flag)), F.lit(0))["value"]
    missing = reduce(lambda rest, flag: F.when(given(flag).isNull(), f"{flag} is required").otherwise(rest), reversed(REQUIRED), F.lit(None).cast("string"))
    error = F.coalesce(F.get(faults, F.lit(0)), missing)
    speakers = F.when(error.isNull(), given(SPEAKERS).try_cast("int"))
    threshold = F.when(error.isNull(), F.coalesce(given(THRESHOLD).try_cast("float"), F.lit(DEFAULT_THRESHOLD).cast("float")))
    paths = [F.when(error.isNull(), given(flag)).alias(name) for flag, name in zip(REQUIRED, ("wav", "segmentation_model", "embedding_model"))]
    return F.struct(*paths, speakers.alias("num_speakers"), threshold.alias("cluster_threshold"), F.when(error.isNull(), cluster_count(speakers)).alias("clusters"), error.alias("error"))
