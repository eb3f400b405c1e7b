"""SimHash near-duplicates: fingerprints, segment-popcount grid join, exact verification, components.

A 64-bit fingerprint is cut into segments and mapped to the vector of set bits per segment. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so pairs within two bits
lie within distance two on that integer grid. Every fingerprint registers at its own grid point and at the points one step up
and one step down; two points within distance two share at least one of these, so an equi-join on grid points
is the complete range join. Candidates are then verified on the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import durable, free_name, map_texts, sweep
from .components import components
from .exact_dedup import text_key

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Width in bits of a segment: 16 segments of 4 bits. Narrower segments make fewer false candidates and more grid points.
SEGMENT_BITS = 4
#: Fingerprints at one grid point that are compared directly; a fuller point takes the bit-flip way, which makes no pairs.
POINT_LIMIT = 64
#: Fingerprints of more than one in so many rows are joined by broadcast.
HOT_SHARE = 1000


def fingerprint_bytes(text: bytes) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        return xxh(b" ".join(words), SEED)
    hashes = np.fromiter([xxh(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])], np.uint64, len(words) - 2)
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _make():
    def work(texts: list) -> dict:
        fps = np.fromiter([fingerprint_bytes(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts], np.uint64, len(texts))
        return {"fp": pa.array(fps.view(np.int64))}

    return work


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp long) for every row; null and blank texts have fingerprint zero."""
    text = F.col(text_col)
    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("key"), text.alias("text")), "text", _make, "fp long")


def segment_popcounts(fp: Column, width: int = SEGMENT_BITS) -> Column:
    """The popcounts of all segments in one long, each in its own ``width`` bits (at most ``width`` < 2**width)."""
    if width not in (4, 8):
        raise ValueError("segments have 4 or 8 bits")
    odd, pair, nibble = (F.lit(m) for m in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
    shifted = F.shiftrightunsigned(fp, 1)  # a two-bit field is (a and b, a xor b): no sum that could overflow
    x = fp.bitwiseXOR(shifted).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(odd), 1))
    x = x.bitwiseAND(pair) + F.shiftrightunsigned(x, 2).bitwiseAND(pair)
    return x.bitwiseAND(nibble) + F.shiftrightunsigned(x, 4).bitwiseAND(nibble) if width == 8 else x


SELF, UP, DOWN = 0, 1, 2


def grid_points(fps: DataFrame, width: int = SEGMENT_BITS) -> DataFrame:
    """(point, step, fp): each fingerprint at its own grid point and one step up or down in each segment."""
    with_pc = fps.withColumn("pc", segment_popcounts(F.col("fp"), width))
    at = lambda i: F.shiftrightunsigned("pc", i * width).bitwiseAND(F.lit((1 << width) - 1))
    one = lambda i: F.lit(1 << (i * width))
    ups = [F.when(at(i) < width, F.struct(F.lit(UP).alias("step"), (F.col("pc") + one(i)).alias("point"))) for i in range(64 // width)]
    downs = [F.when(at(i) > 0, F.struct(F.lit(DOWN).alias("step"), (F.col("pc") - one(i)).alias("point"))) for i in range(64 // width)]
    own = F.struct(F.lit(SELF).alias("step"), F.col("pc").alias("point"))
    return with_pc.select("fp", F.explode(F.array(own, *ups, *downs)).alias("g")).where("g is not null").select("g.point", "g.step", "fp")


def links(fps: DataFrame, width: int = SEGMENT_BITS) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of ``fps`` (fp) that differ in at most two bits.

    Grid points that hold up to ``POINT_LIMIT`` rows give all verified pairs. For fuller points each fingerprint is
    sent, with its 64 one-bit variants, to the raw 64-bit values; whatever meets there is within two bits, so linking
    each to the smallest of them keeps every connection without any pairs.
    """
    points = grid_points(fps, width)
    counts = durable(points.groupBy("point").agg(F.count("*").alias("n")).where("n > 1"), "grid-points")
    members = points.join(counts.where(f"n <= {POINT_LIMIT}"), "point").groupBy("point").agg(F.collect_list(F.struct("step", "fp")).alias("m"))

    def fits(a: Column, b: Column) -> Column:
        level = (a.step == SELF) & (b.step == SELF) & (a.fp < b.fp) | (a.step == UP) & (b.step == UP) & (a.fp < b.fp)
        risen = (a.step == UP) & (b.step == SELF) | (a.step == UP) & (b.step == DOWN)
        return (level | risen) & (a.fp != b.fp) & (F.bit_count(a.fp.bitwiseXOR(b.fp)) <= MAX_DISTANCE)

    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: fits(a, b)), lambda b: F.struct(a.fp.alias("u"), b.fp.alias("v")))))
    direct = members.select(F.inline(pairs)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    crowded = points.join(counts.where(f"n > {POINT_LIMIT}"), "point", "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    near = crowded.select("fp", F.explode(flips).alias("value"))
    low = near.groupBy("value").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("value", "v")
    star = near.join(low, "value").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return direct.unionByName(star).distinct()


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (id, key, fp) with component_id: fingerprints are what links, so a repeated id ties no texts together."""
    distinct = durable(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("held")), "distinct-fingerprints")
    linked = distinct.join(components(links(distinct.select("fp"))).withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("lowest"))
    place = linked.join(lowest, "component").select("fp", "lowest")
    moved = durable(distinct.join(place, "fp", "left").select("fp", "held", F.coalesce("lowest", "low").alias("component_id")), "placed-fingerprints")
    # a fingerprint may hold a large share of all rows (all empty texts have one): of those that hold more than a
    # thousandth there are fewer than a thousand, and these are broadcast
    total = moved.agg(F.sum("held")).first()[0] or 0
    often = moved.where(F.col("held") * HOT_SHARE > total).select("fp", F.col("component_id").alias("often_id"))
    marked = rows.join(F.broadcast(often), "fp", "left")
    rare = marked.where("often_id is null").drop("often_id").join(moved.select("fp", "component_id"), "fp", "left")
    return marked.where("often_id is not null").withColumnRenamed("often_id", "component_id").unionByName(rare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of anything but ASCII white space after lower-casing A-Z; shingles of three words are hashed
    with XXH64 (seed 42), repeats included; shorter texts hash their whole sequence, texts without words have
    fingerprint zero and link like any other. Fingerprints link at two or fewer differing bits; component_id is the
    smallest id reachable. Rows with a null id get their fingerprint and a null component_id and link nothing.
    Rows that repeat an id each keep a row; with other texts they go their own ways. Other columns are ignored.
    """
    found = grouped(durable(fingerprints(docs, id_col, text_col), "fingerprints"))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select(F.col("id").alias(id_col), fingerprint, F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group those of the smallest id.

    Rows with a null id stay. A row goes for its own text, so what else is stored under its id stays.
    """
    gone_id, gone_key = free_name(docs.columns, "drop_id"), free_name(docs.columns, "drop_key")
    found = grouped(durable(fingerprints(docs, id_col, text_col), "fingerprints"))
    gone = found.where("component_id <> id").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    return docs.join(gone, (docs[id_col] == gone[gone_id]) & (text_key(docs[text_col]) == gone[gone_key]), "left_anti")


def drop_similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group (the smallest id), with their columns.

    Documents link if their fingerprints do, or if the Jaccard similarity of their sets of five-word shingles is 0.8 or
    more; groups are what links connect. Fingerprints alone cannot find the latter: such pairs differ in up to a
    fifth of the bits, where the grid no longer tells near from far, so ``similar`` finds them exactly. A document is an id
    with one of its texts, so rows that repeat an id go or stay each for its own text; rows that repeat both are one
    document and stay together. Rows with a null id stay.
    """
    sweep(docs.sparkSession)
    node = lambda i, key: F.xxhash64(i, key, F.lit(31))
    rows = durable(fingerprints(docs, id_col, text_col).where("id is not null").withColumn("node", node(F.col("id"), F.col("key"))), "fingerprints")
    key = text_key(F.col(text_col))
    texts = docs.where(F.col(id_col).isNotNull()).select(node(F.col(id_col).cast("long"), key).alias("id"), F.col(text_col).alias("text"))
    near = durable(grouped(rows.select(F.col("node").alias("id"), "key", "fp")).where("component_id <> id").select(F.col("id").alias("u"), F.col("component_id").alias("v")), "near-fingerprints")
    sweep(docs.sparkSession)
    edges = similar.links(texts)
    sweep(docs.sparkSession)
    linked = components(near.unionByName(edges))
    placed = durable(linked.join(rows.select("node", "id", "key").distinct(), "node"), "placed-documents")
    lowest = placed.groupBy("component").agg(F.min(F.struct("id", "key"))["id"].alias("lowest"), F.min(F.struct("id", "key"))["key"].alias("lowest_key"))
    gone_id, gone_key = free_name(docs.columns, "drop_id"), free_name(docs.columns, "drop_key")
    sweep(docs.sparkSession)
    gone = durable(placed.join(lowest, "component").where("id <> lowest or key <> lowest_key").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "dropped-documents")
    return docs.join(similar.few(gone), (docs[id_col] == gone[gone_id]) & (text_key(docs[text_col]) == gone[gone_key]), "left_anti")
