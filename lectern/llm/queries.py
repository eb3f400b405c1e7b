"""The registered queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, exact_topk, hard_negatives, language_id, mixing, pii, quality, sharding, simhash, token_counts, toxicity
from . import exact_dedup as dedup
from .common import configure, crc_bucket, durable, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, domain): ``low`` for documents labelled as of low quality, else the language."""
    rows = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    known = docs.select(F.col("doc_id").alias("id"), "lang").join(rows, "id")
    return known.select("id", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))


#: Target shares of all tokens.
MIX_SHARES = {"en": 0.45, "fr": 0.2, "de": 0.2, "es": 0.14, "low": 0.01}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain_labels(docs, table(spark, sf_dir, "labels")), shares=MIX_SHARES)


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages", "top_passage", "top_weight")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), crc_bucket("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, merges = sharding.shard_table(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return sharding.placements(store, merges)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = durable(token_counts.prefix_steps(docs, tokenizer_path()), "prefix-steps")
    counted = token_counts.within_budget(stored, token_counts.LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "fit_chars")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


ORACLES = {
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_centroid_clustering": clustering.oracle(),
    "op8_exact_topk": """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score
  from (select vec_id, min(v) v from e where vec_id % 50 = 0 group by 1) q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op7_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
