"""Caption files: SRT, VTT, prose and JSON, one text per transcript."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import text as T
from ..functions import timing as C
from ..sources.files import store_of
from .tokens import speaker_runs


def printable(cues: DataFrame) -> DataFrame:
    """Without cues that are blank."""
    return cues.where(T.trim_space("text") != "")


def with_display(cues: DataFrame) -> DataFrame:
    return cues if "display" in cues.columns else cues.withColumn("display", F.col("speaker"))


def _document(blocks: DataFrame, block, separator: str, head: str = "", tail: str = "") -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"])
    return blocks.groupBy("transcript_id").agg(F.concat(F.lit(head), F.array_join(ordered, separator), F.lit(tail)).alias("document"))


def _cue_blocks(cues: DataFrame, mark: str, rendered) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("pos"))
    times = F.concat(C.timestamp("start", mark), F.lit(" --> "), C.timestamp("end", mark))
    return cues.select("transcript_id", "pos", F.concat_ws("\n", n.cast("string"), times, rendered, F.lit("")).alias("block"))


def srt(cues: DataFrame) -> DataFrame:
    """(transcript_id, document): cues numbered from 1, times with a comma, the speaker in brackets."""
    rows = _cue_blocks(with_display(cues), ",", F.concat(T.speaker_prefix("display"), F.col("text")))
    return _document(rows, F.col("block"), "\n")


def vtt(cues: DataFrame) -> DataFrame:
    """(transcript_id, document): a header, times with a point, the speaker as a voice span."""
    rows = _cue_blocks(with_display(cues), ".", T.voice_span("display", "text"))
    return _document(rows, F.col("block"), "\n", head="WEBVTT\n\n")


def turn_prose(cues: DataFrame) -> DataFrame:
    """(transcript_id, run, pos, speaker, display, prose): the cues of one speaker in a row as sentences."""
    runs = speaker_runs(with_display(cues))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    turns = runs.groupBy("transcript_id", "run").agg(F.min("pos").alias("pos"), F.first("speaker").alias("speaker"), F.first("display").alias("display"), T.clean(F.array_join(ordered, " ")).alias("prose"))
    cased = turns.withColumn("prose", T.capitalise_sentences("prose"))
    return cased.withColumn("prose", F.when((F.col("prose") == "") | T.ends_sentence("prose"), F.col("prose")).otherwise(F.concat("prose", F.lit("."))))


def txt(cues: DataFrame) -> DataFrame:
    """(transcript_id, document): a paragraph a speaker's turn, without blank ones."""
    turns = turn_prose(cues).where("prose <> ''")
    return _document(turns, F.concat(T.speaker_prefix("display"), F.col("prose")), "\n\n")


def _number(x: Column) -> Column:
    """A number as JavaScript writes it: whole ones without a point, none with an exponent in the range of times."""
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+\z", "")
    text = x.cast("string")
    return F.when(x == F.floor(x), x.cast("long").cast("string")).when(text.contains("E"), plain).otherwise(text)


def _string(x: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(x)), r"\A\[|\]\z", "")


def as_json(cues: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(transcript_id, document): a bare list without speakers, else an object with ``names`` (transcript_id, names map)."""
    depth = lambda n: F.concat(F.lit("\n"), F.when(F.col("spoken"), "  " * (n + 1)).otherwise("  " * n))

    def item(r: Column) -> Column:
        fields = F.array_compact(F.array(
            F.concat(F.lit('"start": '), _number(r["start"])), F.concat(F.lit('"end": '), _number(r["end"])), F.concat(F.lit('"text": '), _string(r["text"])),
            F.when(r["speaker"].isNotNull(), F.concat(F.lit('"speaker": '), _string(r["speaker"])))))
        return F.concat(depth(1), F.lit("{"), F.array_join(F.transform(fields, lambda f: F.concat(depth(2), f)), ","), depth(1), F.lit("}"))

    rows = cues.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "text", "speaker"))).alias("cues"), F.bool_or(F.col("speaker").isNotNull()).alias("spoken"))
    rows = rows.withColumn("names", F.lit(None).cast("map<string,string>")) if names is None else rows.join(names.select("transcript_id", "names"), "transcript_id", "left")
    listed = F.concat(F.lit("["), F.array_join(F.transform("cues", item), ","), depth(0), F.lit("]"))
    pairs = F.transform(F.array_sort(F.map_entries("names")), lambda e: F.concat(F.lit("\n    "), _string(e["key"]), F.lit(": "), _string(e["value"])))
    named = F.when(F.size("names") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("\n  }"))).otherwise("{}")
    whole = F.concat(F.lit('{\n  "segments": '), listed, F.lit(',\n  "speakerNames": '), named, F.lit("\n}"))
    return rows.select("transcript_id", F.when(F.col("spoken"), whole).otherwise(listed).alias("document"))


FORMATS = {"srt": srt, "vtt": vtt, "txt": txt, "json": as_json}


#: Characters that a file name cannot have, or that would leave its folder; ``%`` so that no two ids share a name.
UNSAFE = re.compile(r"[/\\\\%:\x00-\x1f]")


def file_name(transcript_id, extension: str) -> str:
    """The name of a transcript's file: unsafe characters as %XX. An id that is null or blank has none."""
    name = "" if transcript_id is None else str(transcript_id)
    if not name.strip():
        raise ValueError("a transcript without an id has no file name")
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", name) + f".{extension}"


class CaptionFiles(DataSource):
    """``format("caption_files")``: rows (transcript_id, document) become one file each in the folder ``path``.

    Tasks write below a folder of the job that readers never look at, each attempt in its own; the commit moves the files of
    the attempts that count into place, one atomic rename each where the store has it. A job that fails leaves nothing new.
    """

    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        store_of(self.options["path"])  # an address that tasks cannot open fails here, before anything runs
        return CaptionWriter(self.options["path"].rstrip("/"), self.options["extension"])


@dataclass
class Written(WriterCommitMessage):
    folder: str


class CaptionWriter(DataSourceWriter):
    def __init__(self, path: str, extension: str):
        self.path, self.extension = path, extension
        self.staging = f"{path}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = store_of(self.staging)
        folder = f"{root}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{folder}/{file_name(row['transcript_id'], self.extension)}") as out:
                out.write(row["document"].encode())
        return Written(folder)

    def commit(self, messages: list) -> None:
        store, root = store_of(self.path)
        for m in messages:
            if m is not None:
                for f in store.get_file_info(fs.FileSelector(m.folder)):
                    store.move(f.path, f"{root}/{f.base_name}")
        self.abort(messages)  # what is left is of attempts that do not count

    def abort(self, messages: list) -> None:
        store, root = store_of(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def export(cues: DataFrame, fmt: str, path: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Documents of one format; with ``path`` each is also written there, as ``<transcript_id>.<fmt>``, see ``CaptionFiles``.

    ``names`` (transcript_id, names map from label to name) are shown in place of labels; JSON keeps the labels and lists the names.
    """
    rows = printable(cues)
    if names is None:
        documents = FORMATS[fmt](rows)
    elif fmt == "json":
        documents = as_json(rows, names)
    else:
        named = rows.join(names.select("transcript_id", "names"), "transcript_id", "left")
        documents = FORMATS[fmt](named.withColumn("display", F.coalesce(F.try_element_at("names", F.col("speaker")), "speaker")).drop("names"))
    if path:
        documents.sparkSession.dataSource.register(CaptionFiles)
        documents.write.format("caption_files").option("extension", fmt).mode("append").save(path)
    return documents
