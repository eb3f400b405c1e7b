"""Files by blocks, the caption sink's commits, bucketed tables, change logs, argument lists."""

import datetime as dt
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import arguments
from lectern.operators import buckets, changes, export, store
from lectern.sources import files, readers
from test_store_sources_streaming import wav

DOC = "transcript_id string, document string"


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_headers_of_large_media_take_a_few_bytes(spark, tmp_path):
    chunk = b"LIST" + (1 << 24).to_bytes(4, "little") + bytes(1 << 24)
    whole = wav(before=chunk)
    file = Counting(whole)
    assert readers.wav_format(files.header_bytes(file)) == readers.wav_format(whole) == (1, 16000, 16, None)
    assert file.taken < 200
    for odd in (b"", b"RIFF", wav(bits=8), wav(before=b"LIST" + b"\x03\0\0\0abc\0"), b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEfmt \x04\0\0\0abcd", wav()[:30]):
        assert readers.wav_format(files.header_bytes(io.BytesIO(odd))) == readers.wav_format(odd)


def test_files_are_digested_block_by_block(spark, tmp_path):
    rng = random.Random(1)
    content = {"a.wav": wav(), "b.mp3": rng.randbytes(3 * files.BLOCK + 17), "c.MP4": b"x", "d.txt": b"no media", "ü e.wav": wav(bits=8)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    assert files.digest_of(io.BytesIO(b"")) == hashlib.sha256(b"").hexdigest()
    found = files.listed(spark, str(tmp_path))
    keys = {os.path.basename(r["path"]): r for r in files.content_keys(found).collect()}
    assert {n: r["content_key"] for n, r in keys.items()} == {n: hashlib.sha256(d).hexdigest() for n, d in content.items() if n != "d.txt"}
    assert all(r["error"] is None and r["length"] == len(content[n]) for n, r in keys.items())
    forms = {os.path.basename(r["path"]): r["fault"] for r in files.wave_formats(found.where("path like '%wav'")).collect()}
    assert forms == {"a.wav": None, "ü e.wav": "not 16 bits"}
    gone = files.content_keys(spark.createDataFrame([(f"{tmp_path}/gone.wav",), (f"file://{tmp_path}/a.wav",)], "path string")).collect()
    assert gone[0]["content_key"] is None and "Cannot read" in gone[0]["error"] and gone[1]["content_key"] == hashlib.sha256(wav()).hexdigest()
    assert files.content_keys(found.limit(0)).collect() == []


def test_addresses_that_tasks_cannot_open_are_refused(spark):
    with pytest.raises(ValueError):
        files.store_of("viewfs://store/x")
    spark.dataSource.register(export.CaptionFiles)
    with pytest.raises(Exception, match="no task can open"):
        spark.createDataFrame([("a", "b")], DOC).write.format("caption_files").option("extension", "srt").mode("append").save("viewfs://store/x")


def write(spark, rows, path):
    spark.dataSource.register(export.CaptionFiles)
    spark.createDataFrame(rows, DOC).repartition(3).write.format("caption_files").option("extension", "srt").mode("append").save(path)


def test_caption_files_are_published_by_the_commit(spark, tmp_path):
    out = f"{tmp_path}/out"
    names = {"1": "1.srt", "../../etc/x": "..%2F..%2Fetc%2Fx.srt", "a%2Fb": "a%252Fb.srt", "ümlaut é": "ümlaut é.srt", "c:\\d": "c%3A%5Cd.srt"}
    write(spark, [(i, f"text of {i}\n") for i in names], f"file://{out}")
    assert {n: open(f"{out}/{n}", encoding="utf-8").read() for n in os.listdir(out)} == {n: f"text of {i}\n" for i, n in names.items()}
    write(spark, [("1", "anew")], out)
    assert open(f"{out}/1.srt").read() == "anew" and len(os.listdir(out)) == len(names)
    with pytest.raises(Exception, match="without an id"):  # a task fails: nothing of the job is to be seen
        write(spark, [(str(i), "new") for i in range(20)] + [(" ", "blank")], out)
    assert sorted(os.listdir(out)) == sorted(names.values()) and open(f"{out}/1.srt").read() == "anew"
    assert os.listdir(tmp_path) == ["out"]


def test_only_attempts_that_count_are_published(tmp_path):
    """Two attempts at one task wrote; the commit is told of one."""
    writer = export.CaptionWriter(str(tmp_path), "srt")
    for attempt, text in ((7, "first"), (8, "second")):
        os.makedirs(f"{writer.staging}/{attempt}")
        with open(f"{writer.staging}/{attempt}/x.srt", "w") as f:
            f.write(text)
    with open(f"{writer.staging}/7/only-of-the-first.srt", "w") as f:
        f.write("lost")
    writer.commit([export.Written(f"{writer.staging}/8"), None])
    assert os.listdir(tmp_path) == ["x.srt"] and (tmp_path / "x.srt").read_text() == "second"


NAME = "source_id long, speaker_key string, display_name string, seq long"


def test_merges_rewrite_the_buckets_they_touch(spark, tmp_path):
    rows = [(s, f"SPEAKER_{k:02d}", f"n{s}.{k}", 10 * s + k) for s in range(300) for k in range(3)]
    table = buckets.BucketTable(spark, f"file://{tmp_path}/names", NAME, ["source_id"], 32).create(spark.createDataFrame(rows, NAME))
    stamp = lambda: {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(tmp_path) for p in names if p.endswith(".parquet")}
    before = stamp()
    new = spark.createDataFrame([(5, "SPEAKER_00", "Ann", 9000), (5, "SPEAKER_09", "Bob", 9001), (1000, "SPEAKER_00", "Cy", 9002), (6, "SPEAKER_00", "old", 1)], NAME)
    want = sorted(map(tuple, store.upsert_names(table.read(), new).collect()))
    assert 1 <= buckets.merge_names(table, new) <= 3
    assert sorted(map(tuple, table.read().collect())) == want
    assert len(before.keys() & stamp().keys()) >= len(before) - 3  # the files of all other buckets are those of before
    assert buckets.merge_names(table, new.limit(0)) == 0 and sorted(map(tuple, table.read().collect())) == want


SOURCE = "id long, source_type string, source_key string, canonical_url string, filename string, size_bytes long, created_at timestamp, updated_at timestamp, last_accessed_at timestamp"
NEW = "source_type string, source_key string, canonical_url string, filename string, size_bytes long, at timestamp"


def test_sources_get_ids_from_stored_counters(spark, tmp_path):
    t = [dt.datetime(2024 + i, 1, 1) for i in range(3)]
    table = buckets.BucketTable(spark, f"{tmp_path}/sources", SOURCE, buckets.SOURCE_KEY, 8)
    counters = buckets.Counters(spark, f"{tmp_path}/counters", 8)
    for i in range(3):
        new = spark.createDataFrame([("file", f"k{n}", None, f"f{i}", n, t[i]) for n in range(10 * i, 10 * i + 20)], NEW)
        buckets.merge_sources(table, counters, new)
    rows = {r["source_key"]: r for r in table.read().collect()}
    assert len(rows) == 40 and len({r["id"] for r in rows.values()}) == 40 and min(r["id"] for r in rows.values()) >= 1
    assert rows["k5"]["created_at"] == rows["k5"]["updated_at"] == t[0] and rows["k15"]["created_at"] == t[0] and rows["k15"]["updated_at"] == t[1] and rows["k15"]["filename"] == "f1"
    first = {k: r["id"] for k, r in rows.items()}
    buckets.merge_fields(buckets.BucketTable(spark, f"{tmp_path}/s2", SOURCE, ["id"], 4).create(table.read()), spark.createDataFrame([(first["k1"], "new")], "id long, filename string"), ["filename"])
    again = {r["source_key"]: r for r in spark.read.parquet(f"{tmp_path}/s2").collect()}
    assert again["k1"]["filename"] == "new" and {k: r["id"] for k, r in again.items()} == first


JOB = "id long, status string, progress double, error string"


def test_snapshots_equal_a_replay(spark):
    rng = random.Random(3)
    jobs = spark.createDataFrame([(i, "downloading", 0.0, None) for i in range(4)], JOB)
    steps = [(rng.randrange(5), s, *(("p", rng.choice([-0.5, 0.2, 0.7, 3.0])) if rng.random() < 0.8 else ("f", None))) for s in range(60)]
    log = changes.progress_reports(spark.createDataFrame([(j, s, v) for j, s, k, v in steps if k == "p"], "job_id long, seq long, progress double"))
    log = log.unionByName(changes.failures(spark.createDataFrame([(j, s, f"m{s}" if s % 2 else None) for j, s, k, _ in steps if k == "f"], "job_id long, seq long, message string")))
    now, want = {i: ["downloading", 0.0, None] for i in range(4)}, []
    for j, s, kind, v in steps:
        if j in now:
            if kind == "p":
                now[j][1] = min(max(v, 0.0), 1.0)
            else:
                now[j][0], now[j][2] = "failed", f"m{s}" if s % 2 else ""
            want.append((j, s, *now[j]))
    assert sorted(map(tuple, changes.snapshots(jobs, log).collect())) == sorted(want)
    assert sorted(map(tuple, changes.current(jobs, log).collect())) == [(i, *v) for i, v in now.items()]
    shorter = changes.compact(log, 30)
    assert shorter.count() < log.count() and sorted(map(tuple, changes.current(jobs, shorter).collect())) == [(i, *v) for i, v in now.items()]
    assert sorted(map(tuple, changes.snapshots(jobs, shorter).where("seq > 30").collect())) == sorted(w for w in want if w[1] > 30)
    assert changes.snapshots(jobs, log.limit(0)).count() == 0 and changes.current(jobs, log.limit(0)).count() == 4


BASE = ["--wav", "a", "--segmentation-model", "s", "--embedding-model", "e"]


@pytest.mark.parametrize("more, want", [
    ([], (None, 0.5, -1, None)), (["--num-speakers", "0"], (0, 0.5, -1, None)), (["--num-speakers", "+64"], (64, 0.5, 64, None)), (["--num-speakers", "007", "--num-speakers", "2"], (2, 0.5, 2, None)),
    (["--cluster-threshold", "1e-3"], (None, 0.001, -1, None)), (["--cluster-threshold", ".5"], (None, 0.5, -1, None)),
    (["--num-speakers", "65"], "between 0 and 64, got 65"), (["--num-speakers", "4294967295"], "got 4294967295"), (["--num-speakers", "4294967296"], "non-negative integer"), (["--num-speakers", "9" * 60], "non-negative integer"),
    (["--num-speakers", "-1"], "non-negative integer"), (["--num-speakers", "2.0"], "non-negative integer"), (["--num-speakers", ""], "non-negative integer"), (["--num-speakers"], "--num-speakers needs a value"),
    (["--cluster-threshold", "x"], "must be a number"), (["--cluster-threshold", "1f"], "must be a number"), (["--cluster-threshold", "1e39"], "positive finite"), (["--cluster-threshold", "1e-60"], "positive finite"),
    (["--cluster-threshold", "-inf"], "positive finite"), (["--cluster-threshold", "NaN"], "positive finite"), (["--cluster-threshold", "0"], "positive finite"),
    (["--help"], 'unknown argument "--help"'), (["--num-speakers", "x", "--help"], "non-negative"), (["--help", "--num-speakers", "x"], "unknown")])
def test_argument_lists(spark, more, want):
    got = spark.range(1).select(arguments.parse(F.array(*map(F.lit, BASE + more))).alias("a")).first()["a"]
    if isinstance(want, str):
        assert want in got["error"] and got["wav"] is None and got["num_speakers"] is None and got["clusters"] is None
    else:
        assert got["error"] is None and (got["wav"], got["segmentation_model"], got["embedding_model"]) == ("a", "s", "e")
        assert (got["num_speakers"], round(got["cluster_threshold"], 6), got["clusters"]) == want[:3]


def test_required_arguments(spark):
    rows = spark.createDataFrame([(0, []), (1, BASE[2:]), (2, BASE[:2] + BASE[4:]), (3, BASE[:4]), (4, BASE[:1]), (5, ["--wav", "--segmentation-model"])], "i int, args array<string>")
    got = [r["e"] for r in rows.select("i", arguments.parse("args")["error"].alias("e")).orderBy("i").collect()]
    assert got == ["--wav is required", "--wav is required", "--segmentation-model is required", "--embedding-model is required", "--wav needs a value", "--segmentation-model is required"]
