"""Near copies by the similarity of their word sets: an exact join on prefixes, components.

A text is the set of its five-word shingles. If two sets have a Jaccard similarity of 4/5 or more, each shares at
least 4/5 of its members with the other, so in any one order of all shingles the first fifth (and one more) of either
have a member in common; an equi-join on these prefixes finds every pair. The order puts shingles that a share of the
documents shows to be frequent last, which keeps common lines and large groups of copies out of other prefixes; it decides
the work, not the result.

Many documents may share a shingle without being similar. Each such group has a pivot, its smallest set, with which all
others are compared. Two sets that share no shingle beyond the pivot's are similar only if both are similar to the pivot, as
it is no larger than they are: then they are connected already. So what is left to find in a crowded group shares a
shingle that the pivot lacks, and is met by the same join on prefixes of what the sets have beyond it, and so on until no
crowd is left. Every step compares each member with its pivot alone and leaves the pivot behind.

Only sizes, prefixes and parity bits of the sets are stored. Members fall into as many buckets as a set has members, rounded
up to a power of two, and a bit tells whether a bucket holds an odd number. Whatever is in one of two sets only flips one bit, so
sets differ in at least as many members as their bits; that rules out nearly all pairs that are not similar, at an eighth of a
byte a member. Whole sets are made again from the texts of those few documents whose bits leave it open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, map_texts, sweep
from .components import components

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
#: One in so many documents is counted to order the shingles. Buckets of their hashes have a level (4 MB in all); the most frequent shingles that fill an eighth of the buckets get one.
COUNTED, BUCKETS = 8, 1 << 22
#: Bits of the table that tells which shingles may be shared (8 MB), in maps of so many bits.
SHARED_BITS, MAP_BITS = 1 << 26, 1 << 15
#: Words whose hashes a worker remembers, and bytes of a text that are cut into words at once.
CACHE_WORDS, BLOCK_BYTES = 1 << 16, 1 << 20
#: Odd factors of the rolling hash over a shingle's words, and of its finish: from the golden ratio, the square roots of two and three.
FACTOR, FINISH_A, FINISH_B = 0x9E3779B97F4A7C15, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B
#: The bits of a shingle from this one on choose its bucket in a parity; lower ones choose levels and shared bits.
PARITY_SHIFT = 28
#: Up to so many documents outside its largest part a group is compared pair by pair; a fuller one goes on beyond its pivot.
GROUP_LIMIT = 32
#: Up to so many ids are broadcast to pick what belongs to them (8 MB), which saves dealing out texts; more are joined. Of rows with more columns, fewer are.
BROADCAST_IDS, BROADCAST_PAIRS, BROADCAST_PIVOTS = 1 << 20, 1 << 18, 1 << 16
GAP = re.compile(rb"[ \t\n\x0b\f\r]")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text block by block: runs of anything but ASCII white space."""
    start = 0
    while len(data) - start > BLOCK_BYTES and (m := GAP.search(data, start + BLOCK_BYTES)):
        yield data[start : m.start()].split()
        start = m.start()
    yield data[start:].split()


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct hashed shingles of a text with A-Z lower-cased; a text of fewer words is one shingle. In 56 bits, ascending."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes, that is A-Z only
    words = np.concatenate([np.fromiter(map(hashes.__getitem__, block), np.uint64, len(block)) for block in word_blocks(data)])
    size = min(SHINGLE_WORDS, len(words))
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    h = np.full(n, size + 1, np.uint64)
    for k in range(size):
        h *= np.uint64(FACTOR)
        h += words[k : k + n]
    for factor in (FINISH_A, FINISH_B):
        h ^= h >> np.uint64(32)
        h *= np.uint64(factor)
    return np.unique(h >> np.uint64(8))


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequent(rows: DataFrame) -> np.ndarray:
    """For each bucket the logarithm of the highest count of a frequent shingle in it, else 0."""

    def make():
        hashes = WordHashes()
        return lambda texts: {"s": pa.array([shingles(t, hashes).view(np.int64) for t in texts], pa.list_(pa.int64()))}

    counted = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(COUNTED)) == 0)
    several = durable(map_texts(counted, "text", make, "s array<long>").select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2"), "frequent-shingles")
    held, least = 0, 3
    for n, count in sorted(((r["n"], r["count"]) for r in several.groupBy("n").count().collect()), reverse=True):  # as many rows as there are counts
        held += count
        if held > BUCKETS // 8:
            least = n + 1
            break
    found = several.where(F.col("n") >= least).groupBy(F.col("s").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()
    discard(several)
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found["b"].to_numpy()] = np.log2(found["n"].to_numpy()).astype(np.uint8) + 1
    return levels


def least_shared(n_u: Column, n_v: Column) -> Column:
    """What two sets of these sizes have in common at least if they are similar."""
    return F.ceil((n_u + n_v) * SIMILAR[0] / sum(SIMILAR)).cast("int")


def parity(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles is in each of its buckets, in longs; halves of twice as many buckets fold by exclusive or."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(PARITY_SHIFT)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def bits_apart(a: Column, b: Column) -> Column:
    """In how many bits the parities of two sets differ, the longer one, of at most twice the length, being folded."""
    size = F.least(F.size(a), F.size(b))
    fold = lambda p: F.when(F.size(p) == size, p).otherwise(F.zip_with(F.slice(p, F.lit(1), size), F.slice(p, size + 1, size), lambda x, y: x.bitwiseXOR(y)))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda held, n: held + n)


def ordered(rows: DataFrame, levels, whole: bool) -> DataFrame:
    """(id, n, set) or (id, n, prefix, parity) of (id, text): the number of shingles, and all of them or a prefix in the common order.

    ``levels`` is what ``frequent`` found, broadcast to the workers.
    """

    def make():
        hashes, level = WordHashes(), levels.value

        def work(texts: list) -> dict:
            sizes, held, odd = [], [], []
            for t in texts:
                s = shingles(t, hashes)
                if not whole:
                    odd.append(parity(s))
                s = np.sort((level[bucket(s)].astype(np.uint64) << np.uint64(56)) | s)
                sizes.append(len(s))
                held.append((s if whole else s[: len(s) - -(-len(s) * SIMILAR[0] // SIMILAR[1]) + 1]).view(np.int64))
            found = {"n": pa.array(sizes, pa.int32()), "set" if whole else "prefix": pa.array(held, pa.list_(pa.int64()))}
            return found if whole else found | {"parity": pa.array(odd, pa.list_(pa.int64()))}

        return work

    return map_texts(rows, "text", make, "n int, set array<long>" if whole else "n int, prefix array<long>, parity array<long>")


class Scratch:
    """Tables that go when their work is done."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(durable(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        for t in self.tables:
            discard(t)
        self.tables.clear()


class Texts:
    """``rows`` (id, text) whose sets are made when they are asked for."""

    def __init__(self, rows: DataFrame):
        self.rows, self.levels = rows, rows.sparkSession.sparkContext.broadcast(frequent(rows))
        sweep(rows.sparkSession)
        self.kept = durable(ordered(rows, self.levels, False), "prefixes")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of the rows of ``ids`` (id, distinct)."""
        return ordered(self.rows.join(few(ids), "id", "left_semi"), self.levels, True).select("id", "set")


def few(keys: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``keys``, to be broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def shared_bits(shared: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, in which the bit of every one of ``shared`` (s) is set."""
    bit = F.col("s").bitwiseAND(F.lit(SHARED_BITS - 1))
    maps = shared.select((F.shiftright(bit, 15)).alias("map"), bit.bitwiseAND(F.lit(MAP_BITS - 1)).alias("at")).groupBy("map").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    table = np.zeros(SHARED_BITS // 8, np.uint8)
    for r in maps:  # at most SHARED_BITS // MAP_BITS
        held = np.frombuffer(r["bits"], np.uint8)
        table[r["map"] * (MAP_BITS // 8) :][: len(held)] = held
    return table


def shared_postings(kept: DataFrame, table) -> DataFrame:
    """(s, id, n) of the prefixes in ``kept``, without shingles whose bit in the broadcast ``table`` is not set: these are of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            prefix = batch.column("prefix")
            s, size = prefix.flatten().to_numpy(), np.diff(prefix.offsets.to_numpy())
            at = s & (SHARED_BITS - 1)
            may = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row = np.repeat(np.arange(len(size)), size)[may]
            yield pa.RecordBatch.from_arrays([pa.array(s[may]), batch.column("id").take(pa.array(row)), batch.column("n").take(pa.array(row))], ["s", "id", "n"])

    return kept.select("id", "n", "prefix").mapInArrow(run, "s long, id long, n int")


def ids_of(pairs: DataFrame, *sides: str) -> DataFrame:
    return pairs.select(F.explode(F.array(*sides)).alias("id")).distinct()


def verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """Those of ``pairs`` (u, v, n_u, n_v) whose sets are similar enough; sizes and parities rule most others out.

    The sets of a pair meet once: each goes from the task that makes it to its pairs.
    """
    scratch = Scratch()
    sized = scratch.keep(pairs.where(F.least("n_u", "n_v") * SIMILAR[1] >= F.greatest("n_u", "n_v") * SIMILAR[0]).distinct(), "sized")
    of = lambda side: texts.kept.select(F.col("id").alias(side), F.col("parity").alias(f"parity_{side}")).join(few(ids_of(sized, side).withColumnRenamed("id", side)), side, "left_semi")
    both = sized.join(of("u"), "u").join(of("v"), "v")
    least = least_shared(F.col("n_u"), F.col("n_v"))
    enough = bits_apart(F.col("parity_u"), F.col("parity_v")) <= F.col("n_u") + F.col("n_v") - 2 * least
    open_ = scratch.keep(both.where(enough).select("u", "v", least.alias("least")).distinct(), "candidates")
    sides = open_.select("u", "v", "least", F.explode(F.array("u", "v")).alias("id"))
    held = texts.sets(scratch.keep(ids_of(open_, "u", "v"), "candidate-ids")).join(few(sides, BROADCAST_PAIRS), "id")
    side = lambda c: F.first(F.when(F.col("id") == F.col(c), F.col("set")), ignorenulls=True).alias(f"set_{c}")
    out = durable(held.groupBy("u", "v", "least").agg(side("u"), side("v")).where(F.size(F.array_intersect("set_u", "set_v")) >= F.col("least")).select("u", "v"), "similar")
    scratch.clear()
    return out


def beyond_pivots(crowd: DataFrame, texts: Texts, scratch: Scratch) -> DataFrame:
    """(s, id, n) of ``crowd`` (pivot, id, n): postings of what each set has beyond its pivot, as far as a similar pair has to meet.

    Such a pair shares at least what sets of its sizes have to share, less what either shares with the pivot.
    """
    held = scratch.keep(texts.sets(scratch.keep(ids_of(crowd, "id", "pivot"), "crowd-ids")).dropDuplicates(["id"]).withColumn("n", F.size("set")), "crowd-sets")
    pivots = held.select(F.col("id").alias("pivot"), F.col("n").alias("n_pivot"), F.col("set").alias("of_pivot"))
    both = crowd.join(held.select("id", "set"), "id").join(pivots, "pivot").withColumn("beyond", F.array_except("set", "of_pivot"))
    smallest = F.greatest(F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]).cast("int"), F.col("n_pivot"))
    need = F.greatest(F.lit(1), least_shared(F.col("n"), smallest) - (F.col("n") - F.size("beyond")))
    reach = F.greatest(F.lit(0), F.size("beyond") - need + 1)
    first = both.select("pivot", "id", "n", F.explode(F.slice("beyond", F.lit(1), reach)).alias("e"))
    return first.select(F.xxhash64("pivot", "e").alias("s"), "id", "n")


def links(rows: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what all similar pairs of ``rows`` (id, text) connect.

    Groups with up to ``GROUP_LIMIT`` documents outside their largest connected part compare pair by pair what is not
    connected. Others go on beyond their pivots, as often as it takes.
    """
    texts, scratch, spark = Texts(rows), Scratch(), rows.sparkSession
    # most shingles are of one document: which are of several is found first, so that the others are not dealt out
    several = texts.kept.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("held")).where("held > 1").select("s")
    table = spark.sparkContext.broadcast(shared_bits(several))
    sweep(spark)
    postings = shared_postings(texts.kept, table)
    edges: DataFrame | None = None
    while True:
        found = scratch.keep(postings, "postings-shared")
        least = scratch.keep(found.groupBy("s").agg(F.min(F.struct("n", "id")).alias("p"), F.count("*").alias("held")).where("held > 1").select("s", F.col("p.id").alias("pivot"), F.col("p.n").alias("n_pivot"), "held"), "pivots")
        members = scratch.keep(found.join(few(least, BROADCAST_PIVOTS), "s"), "members")
        sweep(spark)
        star = members.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v"), F.col("n").alias("n_u"), F.col("n_pivot").alias("n_v"))
        near = verified(star, texts)
        edges = near if edges is None else _joined(edges, near)
        sweep(spark)
        # groups whose members are connected have nothing left to find, nor have members that are connected to all others
        placed = members.where("id <> pivot and held > 2").join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("s", "id", "n", "pivot", F.coalesce("component", "id").alias("part"))
        placed = scratch.keep(placed, "placed")
        parts = placed.groupBy("s", "part").agg(F.count("*").alias("size")).groupBy("s").agg(F.sum("size").alias("whole"), F.max("size").alias("largest"))
        live = scratch.keep(placed.join(parts.where("whole > largest"), "s").withColumn("others", F.col("whole") - F.col("largest")), "apart")
        crowded = F.col("others") > GROUP_LIMIT
        a, b = (live.where(~crowded).select("s", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "part")]) for side in "ab")
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        fits = (F.col("id_a") > F.col("id_b")) & (F.col("part_a") != F.col("part_b")) & (small * SIMILAR[1] >= large * SIMILAR[0])
        pairs = a.join(b, "s").where(fits).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), F.col("n_a").alias("n_u"), F.col("n_b").alias("n_v"))
        edges = _joined(edges, verified(pairs, texts))
        crowd = scratch.keep(live.where(crowded).select("pivot", "id", "n").distinct(), "crowd")
        if crowd.isEmpty():
            break
        new = durable(beyond_pivots(crowd, texts, scratch), "postings")
        scratch.clear()
        sweep(spark)
        scratch.tables.append(new)
        postings = new
    scratch.clear()
    discard(texts.kept)
    return edges


def _joined(edges: DataFrame, more: DataFrame) -> DataFrame:
    out = durable(edges.unionByName(more), "links")
    discard(edges)
    discard(more)
    return out
