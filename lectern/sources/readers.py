"""Readers: segment and turn JSON, worker results, media files and their headers, tool output, model lists."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SEGMENTS = "array<struct<start:double,end:double,text:string,speaker:string>>"
TURNS = "struct<turns:array<struct<start:float,end:float,speaker:int>>>"
#: Fixed value: file types that are accepted.
MEDIA_TYPES = ("mp3", "wav", "m4a", "flac", "ogg", "opus", "aac", "wma", "mp4", "mov", "mkv", "webm", "avi", "m4v", "mpeg", "mpg")
#: Fixed values of the RIFF format: most chunks that are looked at, plain and extensible PCM, the GUID that ends the latter.
MAX_CHUNKS, PCM, EXTENSIBLE = 64, 1, 0xFFFE
PCM_GUID = bytes.fromhex("0100000000001000800000aa00389b71")


def parse_segments(c) -> Column:
    """Stored segments; an empty list if anything is malformed, incomplete or has an unknown key."""
    c = F.col(c) if isinstance(c, str) else c
    typed, raw = F.from_json(c, SEGMENTS), F.from_json(c, "array<map<string,string>>")
    complete = F.forall(typed, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["text"].isNotNull())
    known = F.forall(raw, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, ("start", "end", "text", "speaker"))))) == 0)
    empty = F.expr(f"cast(array() as {SEGMENTS})")
    return F.when(F.coalesce(complete & known, F.lit(False)), typed).otherwise(empty)


def write_segments(c) -> Column:
    """The JSON of a list of segments; segments without a speaker have no such key."""
    return F.to_json(c)


def parse_turns(c) -> Column:
    """The engine's answer; malformed text is an error."""
    return F.from_json(c, TURNS, {"mode": "FAILFAST"})["turns"]


def explode_turns(runs: DataFrame) -> DataFrame:
    """(transcript_id, idx, start, end, speaker) of rows (transcript_id, turns); negative speakers are an error."""
    rows = runs.select("transcript_id", F.posexplode("turns").alias("idx", "t"))
    speaker = F.when(F.col("t.speaker") >= 0, F.col("t.speaker")).otherwise(F.raise_error(F.lit("negative speaker")))
    return rows.select("transcript_id", "idx", F.col("t.start").cast("double").alias("start"), F.col("t.end").cast("double").alias("end"), speaker.alias("speaker"))


def explode_segments(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("transcript_id", F.posexplode("segments").alias("pos", "s")).select("transcript_id", F.col("pos").cast("long").alias("pos"), "s.*")


def explode_chunks(results: DataFrame) -> DataFrame:
    """(transcript_id, pos, text, start, end) of worker results with ``chunks`` array<struct<text, timestamp array<double>>>."""
    rows = results.select("transcript_id", F.posexplode("chunks").alias("pos", "c"))
    return rows.select("transcript_id", F.col("pos").cast("long").alias("pos"), "c.text", F.get("c.timestamp", F.lit(0)).alias("start"), F.get("c.timestamp", F.lit(1)).alias("end"))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def is_media(path) -> Column:
    return extension(F.col(path) if isinstance(path, str) else path).isin(*MEDIA_TYPES)


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` of an accepted type, with content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_media("path"))


def finished_downloads(files: DataFrame, stem: str) -> DataFrame:
    """Files named ``stem.*`` whose type does not end in ``part``."""
    name = F.regexp_extract("path", r"([^/\\]*)\z", 1)
    return files.where(name.startswith(stem + ".") & ~F.endswith(name, F.lit("part")))


def first_download(files: DataFrame, stem: str) -> DataFrame:
    """The finished download of ``stem`` with the first name, if there is one."""
    return finished_downloads(files, stem).orderBy("path").limit(1)


def first_media(drops: DataFrame, paths: str = "paths") -> DataFrame:
    """``drops`` with path, the first accepted file of each list, ignored, how many others it had, and error where none is accepted."""
    kept = F.filter(paths, is_media)
    path = F.get(kept, F.lit(0))
    return drops.withColumns({"path": path, "ignored": F.when(path.isNotNull(), F.size(paths) - 1), "error": F.when(path.isNull(), "no audio or video file")})


def by_start(turns) -> Column:
    """An array of turns in the order of their starts, those of one start as they were."""
    turns = F.col(turns) if isinstance(turns, str) else turns
    placed = F.transform(turns, lambda t, i: F.struct(t["start"].alias("s"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


def content_key(content) -> Column:
    return F.sha2(content, 256)


def video_metadata(c) -> Column:
    """Title and whole seconds of a video's metadata JSON, 0 if unknown."""
    j = F.from_json(c, "title string, duration double")
    return F.struct(j["title"].alias("title"), F.floor(F.greatest(F.coalesce(j["duration"], F.lit(0.0)), F.lit(0.0))).cast("long").alias("duration"))


def prepared_audio(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (audio_path) with an error where no such file is."""
    there = files.select(F.col("path").alias("audio_path")).distinct().withColumn("_there", F.lit(True))
    joined = requests.join(there, "audio_path", "left")
    return joined.withColumn("error", F.when(F.col("audio_path").isNull(), "no audio").when(F.col("_there").isNull(), "audio file is missing")).drop("_there")


def model_list(config: DataFrame) -> DataFrame:
    """Model ids of a configuration text, without the automatic entry; an error unless all declared presets are found."""
    found = F.regexp_extract_all("value", F.lit(r"""modelId:\s*["']([^"']+)["']"""), F.lit(1))
    declared = F.regexp_count("value", F.lit(r"""\bid:\s*["']"""))
    models = F.filter(found, lambda m: m != "__auto__")
    checked = F.when(F.size(models) == declared - 1, models).otherwise(F.raise_error(F.lit("presets and models differ in number")))
    return config.select(F.explode(checked).alias("model_id"))


def wav_format(data: bytes) -> tuple[int, int, int, str | None]:
    """Channels, sample rate, bits and error of a WAVE header: only 16-bit PCM is accepted."""
    none = (0, 0, 0)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return *none, "not a WAVE file"
    at = 12
    for _ in range(MAX_CHUNKS):
        if at + 8 > len(data):
            break
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            if len(body) < 16:
                return *none, "the format chunk is cut short"
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == EXTENSIBLE and (len(body) < 40 or body[24:40] != PCM_GUID) or tag not in (PCM, EXTENSIBLE):
                return channels, rate, bits, "not PCM"
            return channels, rate, bits, None if bits == 16 else "not 16 bits"
        at += 8 + size + size % 2
    return *none, "no format chunk"


HEADER = StructType([StructField("channels", IntegerType()), StructField("sample_rate", IntegerType()), StructField("bits", IntegerType()), StructField("error", StringType())])


@F.pandas_udf(HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wav_format(bytes(b or b"")) for b in content], columns=["channels", "sample_rate", "bits", "error"])
