"""Token counts by count-only Viterbi: the best score and its number of pieces, without a segmentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import read, small_batches, spread
from parchment.llm.hashing import slices
from parchment.llm.unigram import MODEL, vocabulary


def token_counts(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens for each row of docs, over the whole text.

    A null or empty text has 0 tokens. Repeated rows and rows of null id each get their count; an empty table gives an
    empty result; other columns play no part. Within a word ties follow the tokenizer's rule exactly.
    """
    small_batches(docs.sparkSession)
    vocab = vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.prepare()
        for batch in batches:
            counts = [own.count_all(part) for part in slices(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(counts) if counts else [], pa.int64())], ["doc_id", "n_tokens"])

    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))
