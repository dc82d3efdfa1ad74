"""Quality by regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text are transformed towards normality. Each class has its mean and a covariance that is shrunk
towards the pooled one and towards a multiple of the identity; its Cholesky factor is computed once. The difference of the
two Mahalanobis log-densities is turned into a calibrated score by logistic regression.

Class sums are taken over all labelled rows that may be learnt from, in one aggregation over the light table of statistics;
only the calibration uses a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import materialise, read, small_batches, spread
from parchment.llm.hashing import slices, word_hashes
from parchment.llm.logistic import Logistic
from parchment.llm.toxicity import held_out

NAMES = ("words", "word_bytes", "upper", "digits", "marks", "symbols", "bars", "loud", "distinct", "repeats", "line_words", "longest")
#: Rows that the calibration uses at most.
CALIBRATION = 20_000
#: Shares of the pooled covariance and of the identity in a class covariance.
POOLED, IDENTITY = 0.1, 0.02
#: Score from which a text counts as good.
GOOD = 0.7

_CLASS = np.zeros((6, 256), dtype=np.int64)
_CLASS[0, ord("A") : ord("Z") + 1] = 1
_CLASS[1, ord("0") : ord("9") + 1] = 1
_CLASS[2, [ord(c) for c in ".,;:?'\"-()"]] = 1
_CLASS[3, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 1
_CLASS[4, ord("|")] = 1
_CLASS[5, ord("!")] = 1


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; a null text counts as an empty one, whose statistics are all 0."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))])
    start = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[start : start + offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    shares = [np.bincount(owner, _CLASS[k][data], minlength=n) / size for k in range(6)]
    lines = np.bincount(owner, data == 10, minlength=n) + 1
    words, doc = word_hashes(texts)
    count = np.bincount(doc, minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, same, minlength=n) / np.maximum(count, 1)
    order = np.lexsort((words, doc))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], new, minlength=n)
    # the share of the most frequent word
    first = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[order][first], np.diff(np.concatenate([first, [len(words)]])))
    full = np.maximum(count, 1)
    columns = [
        np.log1p(count), np.log1p(np.diff(offsets) / full), *(np.log(s + 1e-3) - np.log(1e-3) for s in shares),
        np.where(count > 0, np.log(full) - np.log(np.maximum(distinct, 1)), 0), np.sqrt(repeats), np.log1p(count / lines), np.sqrt(most / full),
    ]
    found = np.column_stack(columns)
    found[count == 0] = 0
    return found


@dataclass
class Model:
    """Means, inverse Cholesky factors and log-determinants of class 0 and 1, and the calibration; without them every score is the share of good labels, 1 if there are none."""

    prior: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None
    logdets: list[float] | None = None
    calibration: Logistic | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        logs = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(x), self.prior)
        return self.calibration(_squashed(self.difference(x)))


def _squashed(d: np.ndarray) -> np.ndarray:
    """Differences of log-densities reach into thousands; their logarithm keeps the sign and the order."""
    return (np.sign(d) * np.log1p(np.abs(d)))[:, None]


def discriminant(count: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Model:
    """From each class's number of rows, sums (2 x p) and sums of products (2 x p x p)."""
    prior = float(count[1] / count.sum()) if count.sum() else 1.0
    p = sums.shape[1]
    if min(count) < 2:
        return Model(prior)
    means = [sums[k] / count[k] for k in (0, 1)]
    own = [squares[k] / count[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (count[0] * own[0] + count[1] * own[1]) / count.sum()
    model = Model(prior, means, [], [])
    for k in (0, 1):
        few = max(POOLED, min(0.9, p / count[k]))  # a small class leans on the pooled covariance
        cov = (1 - few - IDENTITY) * own[k] + few * pooled + IDENTITY * np.trace(pooled) / p * np.eye(p)
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(p))
        model.factors.append(np.linalg.inv(lower))
        model.logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return model


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and stats (array of doubles) for each row of docs, over the whole text.

    A null text counts as an empty one, whose statistics are all 0. Very long texts are hashed whole, one at a time. Repeated
    rows and rows of null id each have their statistics; an empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch["text"]):
                x = statistics(part)
                at = pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(done, len(part)), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "stats"])
                done += len(part)

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id long, stats array<double>")


def learn(stats: DataFrame, labels: DataFrame, calibration: int = CALIBRATION) -> Model:
    """Fit on all rows of stats with a label (doc_id, quality); null labels and ids are left out, of repeated ids the largest counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    rows = stats.where("doc_id is not null").join(known, "doc_id")
    p = len(NAMES)
    cells = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(p)]
    cells += [F.sum(F.col("stats")[i] * F.col("stats")[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    count, sums, squares = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *cells).collect():  # two rows
        k = r.quality
        count[k] = r.n
        sums[k] = [r[f"s{i}"] for i in range(p)]
        for i in range(p):
            for j in range(i, p):
                squares[k, i, j] = squares[k, j, i] = r[f"q{i}_{j}"]
    model = discriminant(count, sums, squares)
    if model.means is not None:
        sample = rows.select("stats", "quality", "doc_id").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(calibration).toArrow()
        x, y = np.array(sample["stats"].to_pylist()).reshape(-1, len(NAMES)), np.array(sample["quality"].to_pylist())
        model.calibration = Logistic.fit(_squashed(model.difference(x)), y, np.ones(len(y)))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for each row of stats: equal statistics have equal scores. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.asarray(batch["stats"].flatten()).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; texts do not move. Without a model nothing is rejected."""
    if model.calibration is None:
        return docs
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(statistics(part)) for part in slices(batch["text"])]
            yield batch.filter(pa.array(np.concatenate(parts) >= GOOD)) if parts else batch

    return spread(docs).mapInArrow(run, docs.schema)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from."""
    return read(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out(F.col("doc_id"), 4, 2))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(measured(read(spark, sf_dir, "documents", "doc_id", "text")))
    found = score(stats, learn(stats, labelled(spark, sf_dir)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
