"""A corpus pipeline over documents: language, exact copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages but the last return the
columns of docs, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm import bpe, exact_dedup, jaccard_join, langid, mixing
from stylomill.llm.common import one_of_each, unused
from stylomill.session import broadcast_if_small, stored

#: Bits that a byte takes without a model. A text whose shortest code is no shorter is in none of the languages learned.
RAW_BITS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those that docs' labels teach.

    Rejected are null texts, texts without a letter, and texts that no language's model codes in less than RAW_BITS a
    byte. Without any label nothing is learned and all documents go.
    """
    rate = unused("rate", docs.columns)
    pred = unused("lang", docs.columns)
    kept = docs.withColumnsRenamed({c: f"{pred}{i}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score")})
    found = langid.predict(kept, langid.fit(docs), bits=rate)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col(rate) < RAW_BITS)).select(*(F.col(a).alias(b) for a, b in zip(kept.columns, docs.columns)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id. Null texts are as empty ones; of rows that repeat id and text one stays."""
    row = {c: f"{unused('own', docs.columns)}{i}" for i, c in enumerate(docs.columns) if c in ("keep_id", "group_size", "kept", "text_sha256")}
    kept = docs.withColumnsRenamed(row)
    return exact_dedup.mark_duplicates(kept).where("kept").select(*(F.col(a).alias(b) for a, b in zip(kept.columns, docs.columns)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest doc_id. Texts without words are alone and stay; of rows that repeat id and text one stays."""
    # a row is named by its id and text, as ids may repeat
    row, gone_row = unused("row", docs.columns), unused("gone", docs.columns)
    named = docs.withColumn(row, F.struct("doc_id", F.xxhash64("text").alias("tag")))
    classes = jaccard_join.jaccard_components(named, id_col=row)
    gone = stored(classes.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(gone_row)).distinct(), "near-copies")
    left = named.join(broadcast_if_small(gone), F.col(row).eqNullSafe(F.col(gone_row)), "left_anti")
    return one_of_each(left, row).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for. A null source is one of its own; texts without words are taken by chance, too."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text decoded from them. A null text is empty: no ids."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("mix_sources", mix), ("bpe", tokens)]

#: SQL can't express the language model, the draws of the mix and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
