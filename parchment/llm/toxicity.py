"""Toxicity by compression distance between an ordinary and a toxic zstandard dictionary.

Text is lower-cased, its blanks are folded, and each byte position becomes a four-byte code of the five bytes that begin
there. In codes a match means at least five equal bytes, so zstandard sees word stems and not chance letters. A document
is cut into overlapping windows of codes, and each window is compressed twice. Both dictionaries are trained by zstandard,
each on text of its own: one on windows of ordinary documents, one on passages of toxic documents, which are the stretches
that are far more frequent there. The toxic compressor holds the ordinary dictionary too, before its own, so that common
words cost both the same, and the difference in length is what the toxic dictionary saves. The threshold is calibrated by
logistic regression on features that each labelled text gets from dictionaries trained without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import read, small_batches, spread
from parchment.llm.logistic import Logistic

#: Labelled rows of each class that are learnt from at most, and the longest text among them.
SAMPLE, SAMPLE_CHARS = 2500, 50_000
GRAM = 5
#: Codes of a window, and from the start of one to the next.
WINDOW, STEP = 128, 112
#: Bytes of the two dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 8192
#: Windows that the ordinary dictionary is trained on at most, spread evenly over all ordinary documents of the sample.
ORDINARY_WINDOWS = 40_000
#: A code is toxic if so many toxic documents hold it, and if it is so many times as frequent in toxic text as in ordinary text.
SEEN, RATIO = 3, 8.0
#: Bytes saved in a window from which the saving counts as high.
HIGH = 12
#: Parts of the labelled sample for calibration.
FOLDS = 3
#: Code points that are coded at a time.
PART = 1 << 20
U = np.uint64


def _parameters() -> zs.ZstdCompressionParameters:
    return zs.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=15, search_log=4, min_match=5, target_length=32, strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )


def codes(text: str) -> np.ndarray:
    """A four-byte code for the five bytes from each position on."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(U)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    key = np.zeros(n, U)
    for j in range(GRAM):
        key = (key << U(8)) | data[j : j + n]
    with np.errstate(over="ignore"):
        key = (key ^ (key >> U(29))) * U(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> U(27))) * U(0x94D049BB133111EB)
    return (key >> U(32)).astype(np.uint32)


def windows(text: str) -> Iterator[bytes]:
    """All windows of the whole text, which is coded in parts that overlap."""
    for at in range(0, max(1, len(text)), PART):
        part = codes(text[max(0, at - 4 * GRAM) : at + PART])
        for i in range(0, max(1, len(part) - (WINDOW - STEP)), STEP):
            yield part[i : i + WINDOW].tobytes()


@dataclass
class Model:
    """Two dictionaries and a calibrated threshold; without toxic examples there is no model, and every score is 0."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: Logistic | None = None
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "threshold": self.threshold, "_compressors": []}

    def features(self, text: str) -> list[float]:
        """Of a window's saving: the largest, the mean of the three largest, the mean and how many are high; and the number of windows."""
        if not self._compressors:
            for content in (self.ordinary, self.ordinary + self.toxic):
                held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=_parameters())
                self._compressors.append(zs.ZstdCompressor(compression_params=_parameters(), dict_data=held))
        plain, toxic = (c.compress for c in self._compressors)
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)])
        top = np.sort(saved)[-3:]
        return [float(top[-1]), float(top.mean()), float(saved.mean()), float((saved >= HIGH).mean()), float(np.log(len(saved)))]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.threshold is None:
            return np.zeros(len(texts))
        return self.threshold(np.array([self.features(t or "") for t in texts]).reshape(len(texts), 5))


def _counted(texts: list[str], toxic: np.ndarray, at_a_time: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of texts, how often ordinary and toxic ones hold each, and how many toxic ones do.

    Texts are counted a few hundred at a time, and the counts merged, so that only distinct codes are held.
    """
    values, counts = np.zeros(0, np.uint32), np.zeros((3, 0))
    for a in range(0, len(texts), at_a_time):
        found = [np.unique(codes(t), return_counts=True) for t in texts[a : a + at_a_time]]
        owner = np.repeat(toxic[a : a + at_a_time], [len(v) for v, _ in found])
        times = np.concatenate([n for _, n in found]).astype(float)
        rows = np.stack([np.where(owner, 0, times), np.where(owner, times, 0), owner.astype(float)])
        values, inverse = np.unique(np.concatenate([values, *[v for v, _ in found]]), return_inverse=True)
        rows = np.concatenate([counts, rows], axis=1)
        counts = np.stack([np.bincount(inverse, r, minlength=len(values)) for r in rows])
    return values, counts[:2], counts[2]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there are too few samples to train on, their end."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(texts: list[str], toxic: np.ndarray, windows: int = ORDINARY_WINDOWS) -> tuple[bytes, bytes] | None:
    """The ordinary and the toxic dictionary; none if no toxic passage comes up more than once."""
    if toxic.sum() < SEEN or (~toxic).sum() < SEEN:
        return None
    values, often, docs = _counted(texts, toxic)
    marked = values[(docs >= SEEN) & (often[1] / max(1, often[1].sum()) >= RATIO * (often[0] + 1) / max(1, often[0].sum()))]
    passages: dict[bytes, int] = {}
    for i in np.flatnonzero(toxic):
        coded = codes(texts[i])
        inside = np.isin(coded, marked)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            passage = coded[a:b].tobytes()
            passages[passage] = passages.get(passage, 0) + 1
    kept = sorted((p for p, n in passages.items() if n > 1), key=lambda p: (passages[p], p))
    if not kept:
        return None
    total, plain, nth = sum(-(-len(texts[i]) // WINDOW) for i in np.flatnonzero(~toxic)), [], 0
    for i in np.flatnonzero(~toxic):
        coded = codes(texts[i])
        for a in range(0, len(coded), WINDOW):
            if total <= windows or nth * windows // total != (nth + 1) * windows // total:
                plain.append(coded[a : a + WINDOW].tobytes())
            nth += 1
    return _trained(ORDINARY_BYTES, plain), _trained(TOXIC_BYTES, [p for p in kept for _ in range(passages[p])])


def train(texts: list[str], toxic: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), windows: int = ORDINARY_WINDOWS) -> Model:
    """Dictionaries from all texts, and a threshold from features that each text gets from dictionaries without it.

    The texts are dealt into FOLDS parts by position. weight: how many rows an ordinary and a toxic example stand for.
    """
    toxic = np.asarray(toxic, bool)
    whole = dictionaries(texts, toxic, windows)
    fold, x, y = np.arange(len(texts)) % FOLDS, [], []
    for f in range(FOLDS if whole else 0):
        own = dictionaries([t for t, k in zip(texts, fold, strict=True) if k != f], toxic[fold != f], windows)
        if own:
            part = Model(*own)
            x.extend(part.features(texts[i]) for i in np.flatnonzero(fold == f))
            y.extend(toxic[fold == f])
    if not any(y):
        return Model()
    y = np.array(y)
    return Model(*whole, Logistic.fit(np.array(x), y, np.where(y, weight[1], weight[0])))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, windows: int = ORDINARY_WINDOWS) -> Model:
    """Fit on at most sample documents of each class, in a random order that depends on doc_id only.

    labels: doc_id, toxic; rows of null label or id are left out, and of repeated ids the largest label and the largest text
    count. Only texts of up to SAMPLE_CHARS are learnt from. Without toxic or without ordinary examples, as in an empty table,
    the model scores everything 0. Other columns of either table play no part.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(3))
    ids = known.where("toxic").orderBy(order, "doc_id").limit(sample).union(known.where("not toxic").orderBy(order, "doc_id").limit(sample))
    chosen = docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "doc_id")  # 2 x sample rows at most
    rows = chosen.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy(order, "doc_id").toArrow()
    toxic = np.array(rows["toxic"].to_pylist(), bool)
    weight = tuple(size.get(k, 0) / max(1, int((toxic == k).sum())) for k in (False, True))
    return train(rows["text"].to_pylist(), toxic, weight, windows)


def score(docs: DataFrame, model: Model, schema: str = "doc_id long", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted for each row of docs, over the whole text.

    A null text is scored as an empty one. Equal texts have equal scores, so repeated rows and ties do; a very long text is
    scored in all its windows, a part of it at a time. An empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, f"{schema}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; texts do not move. Cases are those of score()."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch["text"].to_pylist()) < 0.5))

    return spread(docs).mapInArrow(run, docs.schema)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from."""
    return read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(F.col("doc_id"), 5, 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = score(docs, learn(docs, labelled(spark, sf_dir)))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
