"""A training-corpus pipeline over ``documents``: each stage's result is written as Parquet and read by the next.

Null texts count as empty and have no language, so the first stage drops them. Rows of a null id stay in the stages that drop
copies; rows that repeat an id go or stay each for its own text, save that near copies by word sets leave all rows of an id
with several texts alone. Empty tables stay empty; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, exact_dedup, language_id, mixing, simhash
from lectern.llm.common import configure, durable
from lectern.llm.queries import domain_labels, tokenizer_path

#: Share of their tokens that documents of low quality keep; all else keeps what it has.
LOW_SHARE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays ambiguous; learned from the lang column."""
    configure(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, keep_text=True)
    pred, vague = found.columns[-3], found.columns[-1]
    return found.where(language_id.confident(found[pred], found[vague])).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    configure(spark)
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by fingerprints within two bits, or by five-word shingle sets of similarity 0.8 or more,
    the smallest doc_id stays."""
    configure(spark)
    return simhash.drop_similar_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents by fitted rates: low quality is cut to a share of its tokens, all other domains keep theirs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(docs, domain_labels(docs, labels), factors={"low": LOW_SHARE})
    return mixing.apply_mix(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian), their number and the decoded text of each document, with its other columns."""
    configure(spark)
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifiers nor the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
