"""The corpus pipeline: from documents to token ids of a deduplicated, clean and balanced corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import mixing, near_dedup, quality, sentencepiece_codec, toxicity
from parchment.llm.common import discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Null and empty texts are scored as empty ones; repeated rows fare alike.

    Of an empty table nothing comes back; extra columns stay.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, toxicity.labelled(spark, sf_dir)))


def good_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels of both classes, all of them.

    Null and empty texts are scored as empty ones, whole long texts are measured, repeated rows fare alike. Of an empty table
    nothing comes back; extra columns stay.
    """
    stats = materialise(quality.measured(docs))
    model = quality.learn(stats, quality.labelled(spark, sf_dir))
    discard(stats)
    return quality.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, once. Documents of null id are all kept.

    Of rows that repeat an id the one with the largest text stays; should texts be equal too, the largest in the other columns.
    Null and empty texts are near duplicates of nothing; of an empty table nothing comes back; extra columns stay.
    """
    kept = materialise(near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct())
    # the ids grow with the corpus, so this join is a merge at every size
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = named.groupBy("doc_id").agg(F.max(F.struct("text", *rest)).alias("__kept_row"))
    return one.select(*[F.col("doc_id") if c == "doc_id" else F.col("__kept_row")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents of null id are taken as often as the most taken of them.

    Null and empty texts cost nothing and are taken once; a null source is a source. Of an empty table nothing comes back;
    extra columns stay.
    """
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("__mixed_id")).agg(F.max("copies").alias("__mixed_copies"))
    taken = docs.join(copies.where("__mixed_copies > 0").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__mixed_id")))
    return taken.withColumn("__mixed_copy", F.explode(F.sequence(F.lit(1), F.col("__mixed_copies")))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of whole texts, however long; a null or empty text has none. A row for each row; other columns go."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("quality", good_enough),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can express neither the classifiers nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            discard(before)
            before = docs
    return docs
