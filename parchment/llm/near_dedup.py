"""Near-duplicate documents: BagMinHash signatures, banding and verified multiset overlap.

BagMinHash. A document is a multiset of five-word shingles. Each shingle drives a Poisson process of points with a time
and a weight coordinate; a point counts for a document if its coordinate lies below the shingle's count. Each point picks
one of m registers, and a register holds the earliest time it gets. Two documents agree in a register with a probability
that is their weighted Jaccard similarity. The weight axis is discretised in dyadic ranges (0,1], (1,2], (2,4], ..., each
with its own process, so a shingle that occurs w times costs log w ranges; a document's processes are followed only up to
a time by which all registers are filled with high probability, and further where they are not.

Candidates share one of BANDS bands. Links are verified on whole multisets:

1. exact copies are folded into classes first, and only class representatives go on;
2. within a bucket every document is compared with the bucket's smallest id (a star, linear in the bucket);
3. what the stars leave in different components, though it shares buckets, is compared block by block: every candidate
   pair whose ends are not yet connected is verified, so no link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import discard, materialise, read, small_batches, spread
from parchment.llm.components import components
from parchment.llm.hashing import GOLD, U, items, mix, multisets, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
REGISTERS = BANDS * ROWS
#: Documents and bytes of shingles in a block of step 3.
BLOCK_DOCS, BLOCK_BYTES = 128, 1 << 23


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers of n documents (infinite for one without shingles), from their multisets."""
    sig = np.full(n * m, np.inf)
    if not len(doc):
        return sig.reshape(n, m)
    ranges = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(of)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    length = np.maximum(low, 1.0)
    doc, count = doc[of], count[of]
    with np.errstate(over="ignore"):
        key = mix(shingle[of] + level.astype(U) * GOLD)
    weight = np.bincount(doc, weights=np.minimum(length, np.maximum(count - low, 0)), minlength=n)
    limit = m * (np.log(m) + 4) / np.maximum(weight, 1e-9)
    todo = np.ones(len(doc), dtype=bool)
    while todo.any():
        at = np.flatnonzero(todo)
        time, state = np.zeros(len(at)), key[at]
        while len(at):
            with np.errstate(over="ignore"):
                state = state + GOLD
            draw = mix(state)
            time = time - np.log1p(-((draw >> U(11)).astype(float) / 2.0**53)) / length[at]
            go = time <= limit[doc[at]]
            at, time, state = at[go], time[go], state[go]
            draw = mix(state ^ U(0xD1B54A32D192ED03))
            inside = low[at] + length[at] * ((draw & U(0xFFFFFFFF)).astype(float) / 2.0**32) < count[at]
            register = ((draw >> U(32)) % U(m)).astype(np.int64)
            np.minimum.at(sig, (doc[at] * m + register)[inside], time[inside])
        open_ = np.isinf(sig.reshape(n, m)).any(axis=1)
        limit = limit * 2
        todo = open_[doc]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature, the band's number mixed in."""
    rows = sig.shape[1] // bands
    bits = mix(np.ascontiguousarray(sig).view(U)).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=U) * GOLD, (len(sig), bands)).copy()
        for r in range(rows):
            key = mix(key * U(0x9DDFEA08EB382D69) + bits[:, :, r])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for texts in slices(batch["text"]):
            doc, value, count = multisets(texts, SHINGLE)
            n = len(texts)
            keys = band_keys(signatures(doc, value, count, n))
            size = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(done, n), batch["class"].slice(done, n), pa.array(size), bands], ["doc_id", "class", "size", "bands"])
            done += n


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for texts in slices(batch["text"]):
            own = [batch[c].slice(done, len(texts)) for c in ("node", "doc_id", "bands")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(items(texts, SHINGLE), pa.binary())], ["node", "least", "bands", "items"])
            done += len(texts)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as items()."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                bool(x and y) and min(len(x), len(y)) >= similarity * max(len(x), len(y)) and overlap(np.frombuffer(x, U), np.frombuffer(y, U)) >= similarity
                for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _compare(similarity: float):
    """Of two blocks: verify each candidate pair whose components are not yet one; a pair for each two that it joins."""

    def run(table: pa.Table) -> pa.Table:
        doc, comp, left = (table[c].to_numpy() for c in ("least", "comp", "left"))
        sets = [np.frombuffer(x, U) for x in table["items"].to_pylist()]
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64)
        size = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        groups, a, b = _Union(), [], []
        same = bool(left.all())
        others = np.arange(len(doc)) if same else np.flatnonzero(~left)
        flags = np.zeros(code.max() + 1, dtype=np.int64)
        where = np.concatenate([np.arange(start[i], start[i + 1]) for i in others])
        cuts = np.concatenate([[0], np.cumsum(size[others])[:-1]])
        for i in np.flatnonzero(left):
            near = (bands[others] == bands[i]).any(axis=1) & (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]))
            if same:
                near &= others > i
            if not near.any():
                continue
            flags[code[start[i] : start[i + 1]]] = 1
            both = np.add.reduceat(flags[code[where]], cuts)
            flags[code[start[i] : start[i + 1]]] = 0
            near &= both >= similarity * (size[others] + size[i] - both)
            for j in others[near]:
                if groups.find(int(comp[i])) != groups.find(int(comp[j])):
                    groups.join(int(comp[i]), int(comp[j]))
                    a.append(int(doc[i]))
                    b.append(int(doc[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(star: DataFrame, links: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links between what shares buckets but not a component: straggler blocks against all blocks of their group.

    star joins classes; links and the result join documents, as the smallest ids of classes.
    """
    group, comp = components(star), components(links)
    member = (
        group.select(F.col("id").alias("node"), F.col("component").alias("group"))
        .join(known, "node")
        .join(comp.select(F.col("id").alias("least"), F.col("component").alias("comp")), "least", "left")
        .withColumn("comp", F.coalesce("comp", "least"))
        .withColumn("bytes", F.length("items"))
    )
    member = materialise(member)
    sizes = member.groupBy("group", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    total = sizes.groupBy("group").agg(F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "comp", "bytes")).alias("big"), F.count("*").alias("comps"))
    # a group of two has been compared already
    total = total.where("comps > 1 and all > 2")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_DOCS, size / BLOCK_BYTES)).cast("int")
    plan = total.select(
        "group", F.col("big.comp").alias("big"), blocks(F.col("big.n"), F.col("big.bytes")).alias("n_big"),
        blocks(F.col("all") - F.col("big.n"), F.col("all_bytes") - F.col("big.bytes")).alias("n_few"),
    )
    placed = member.join(plan, "group").withColumn("few", F.col("comp") != F.col("big"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("few"), F.col("n_few")).otherwise(F.col("n_big"))).cast("int"))
    # pairs of blocks: (straggler i, straggler j >= i) and (straggler i, block j of the largest component, numbered after them)
    every = F.sequence(F.lit(0), F.col("n_few") - 1)
    mine = F.transform(F.sequence(F.col("block"), F.col("n_few") + F.col("n_big") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    theirs = F.transform(F.filter(every, lambda i: i < F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left")))
    big = F.transform(every, lambda i: F.struct(i.alias("i"), (F.col("n_few") + F.col("block")).alias("j"), F.lit(False).alias("left")))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("few"), F.concat(mine, theirs)).otherwise(big))).select("group", "at.*", "least", "comp", "bands", "items")
    # dealt out anew: the join left a whole group in one partition, which would do for the grouping, but not for a large group
    return dealt.repartition("group", "i", "j").groupBy("group", "i", "j").applyInArrow(_compare(similarity), "a long, b long")


def _pairs(star: DataFrame, side: DataFrame) -> DataFrame:
    """a and b, the smallest ids of the two classes, with the items of both."""
    edges = star.toDF("u", "v")
    return edges.join(side.toDF("u", "a", "x"), "u").join(side.toDF("v", "b", "y"), "v").select("a", "b", "x", "y")


def _same_id(taking: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of ids that have several texts: each to the smallest id of each of its classes. There are few, if any."""
    several = taking.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("doc_id")
    held = taking.select("doc_id", "class").join(several, "doc_id").distinct()
    return held.join(classes.select("class", "least"), "class").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, group_id (the smallest doc_id reachable by links) and kept (doc_id = group_id).

    Words are runs of anything but ASCII white space, in lower case; two documents link if the weighted Jaccard similarity of
    their multisets of five-word shingles is at least similarity. A text of one to four words has one shingle of them all. A
    null text and one without words link with nothing, not even with each other. A doc_id names a document: rows that repeat
    it are the same document, which links through any of its texts, and have the same group. A row of null doc_id is its own
    group, null, and kept. Texts of any length are compared whole. An empty table gives an empty result. Extra columns play
    no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = materialise(
        spread(base).withColumn("class", F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.unhex(F.md5("text"))))
        .select("doc_id", "class", "text")
        .mapInArrow(_sketch, "doc_id long, class binary, size long, bands array<long>")
    )
    # a class is a text, and a node has its number; links are between the smallest ids of classes
    taking = sketch.where("size > 0 and doc_id is not null")
    classes = taking.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))  # all of a class are equal
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("last > pivot").drop("last")
    star = materialise(banded.join(buckets, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    nodes = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    # one row for each class, that of its smallest id; the rows grow with the corpus, so this join is a merge at every size
    wanted = classes.join(nodes, "node").select("class", F.col("least").alias("doc_id"), "node", "bands")
    texts = base.where("doc_id is not null").withColumn("class", F.unhex(F.md5("text"))).join(wanted.hint("merge"), ["doc_id", "class"])
    texts = texts.dropDuplicates(["doc_id", "class"]).select("node", "doc_id", "bands", "text")
    known = materialise(texts.mapInArrow(_items, "node long, least long, bands array<long>, items binary"))
    side = known.select("node", "least", "items")
    links = materialise(_pairs(star, side).mapInArrow(_verify(similarity), "a long, b long").unionByName(_same_id(taking, classes)))
    more = materialise(_rest(star, links, known, similarity))
    group = components(links.unionByName(more))
    for done in (star, known, links, more):
        discard(done)
    of = classes.select("class", "least").join(group.select(F.col("id").alias("least"), F.col("component").alias("found")), "least", "left")
    of = of.select("class", F.coalesce("found", "least").alias("found"))
    own = sketch.select("doc_id", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    return own.join(of, "class", "left").select(
        "doc_id", F.coalesce("found", "doc_id").alias("group_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("found", "doc_id"))).alias("kept")
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
