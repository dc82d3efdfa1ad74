"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a random order that depends on doc_id only. A document's virtual finish
time is the source's words up to and including it, divided by the source's target; queues with a target above their
size are served a second time. Serving all queues by virtual finish time and stopping at the total budget gives every
source its target, to within a document.

The order is cut into ranges. Both prefix sums (within a source, and over the global order of finish times) are taken in two
levels: sums of ranges first, then rows within a range. Of the global order only the range in which the budget ends is sorted
row by row, as all before it is served and nothing after it. No source and no range of many rows is gathered by one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import discard, materialise, read

#: A word, for sizes: anything but blanks, tabs and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bucket of a prefix sum holds on average.
BUCKET_ROWS = 4096
#: Times that a document is served at most.
MOST = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int = MOST) -> DataFrame:
    """sizes(source, source_size, ...) -> the same with weight and target.

    The budget, share of all sizes, is split by weight; a source stops at most times its size and the excess goes to the
    others by weight, until none is above. Solved in one pass: sources fill up in order of size by weight, so with
    sources in that order the level of the rest after the first k are full is known from two running sums, and the first
    level that fills no further source is the answer.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    return (
        sizes.withColumn("weight", pick)
        .withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum(cap).over(upto), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("_full", F.col("_ratio") <= F.col("_left") / F.col("_weights"))
        # full sources are a prefix of the order by ratio, so the level of the rest is the least one among the others
        .withColumn("_level", F.min(F.when(~F.col("_full"), F.struct("_ratio", (F.col("_left") / F.col("_weights")).alias("level")))).over(every)["level"])
        .withColumn("target", F.when(F.col("_full"), cap).otherwise(F.col("_level") * F.col("weight")))
        .drop("_ratio", "_budget", "_left", "_weights", "_full", "_level")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42
) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies and taken (= copies x size).

    Sources in code point order, null last, get the weights in turn. A null text has size 0; documents of size 0 are
    taken once, as they cost nothing (copies 1, taken 0). Rows that repeat a doc_id are separate documents of the queue.
    A null doc_id is an id like any other. An empty table gives an empty result. Equal finish times are served by source
    and position in the queue, so reruns agree.
    """
    small = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    base = materialise(small.withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000")))))
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    # the table of sources has a row for each; whether it is broadcast is left to Spark's own size limit
    of = targets(per_source, weights, share).withColumnRenamed("source", "_source")
    queue = base.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    # position in the queue: buckets are ranges of the hash, so that they stand in the queue's order
    unit = F.shiftrightunsigned(F.col("_h"), 11).cast("double") / F.lit(float(2**53))
    queue = queue.withColumn("_bucket", F.floor(unit * F.ceil(F.col("_rows") / F.lit(BUCKET_ROWS))))
    sums = queue.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_at"), "_before"
    )
    place = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size")
    queue = materialise(
        queue.withColumn("_cum", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_place", F.row_number().over(place))  # tells repeated rows apart
        .join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
        .drop("_source", "_at", "_rows")
        .withColumn("_cum", F.col("_cum") + F.col("_before"))
        .drop("_before")
    )
    discard(base)
    # virtual finish times, of each round in which a document is served
    rounds = [
        F.when(F.col("target") > 0, (F.col("_cum") + F.lit(r) * F.col("source_size")) / F.col("target")).otherwise(F.lit(float(r))) for r in range(MOST)
    ]
    edge = _edge(queue, rounds)
    order = Window.partitionBy("_slice").orderBy("_finish", F.col("source").asc_nulls_last(), "_bucket", "_place", "_round")
    crossing = (
        queue.select("*", F.posexplode(F.array(*rounds)).alias("_round", "_finish"))
        .withColumn("_slice", _slice(F.col("_finish")))
        .where(F.col("_slice") == F.lit(edge.slice))
        .withColumn("_in", (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(edge.before) <= F.lit(edge.budget)).cast("int"))
    )
    key = ["source", "_bucket", "_place"]
    partly = crossing.groupBy(*key).agg(F.sum("_in").alias("_some"))
    whole = sum(((_slice(f) < F.lit(edge.slice)).cast("int") for f in rounds[1:]), (_slice(rounds[0]) < F.lit(edge.slice)).cast("int"))
    touched = sum(((_slice(f) == F.lit(edge.slice)).cast("int") for f in rounds[1:]), (_slice(rounds[0]) == F.lit(edge.slice)).cast("int")) > 0
    queue = queue.withColumn("_whole", whole).withColumn("_touched", touched)
    # only documents that the crossing range touches need the join
    renamed = partly.select(*[F.col(k).alias(f"_{k}") for k in key], "_some")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("__bucket")) & (F.col("_place") == F.col("__place"))
    some = queue.where("_touched").join(renamed, same).drop("_source", "__bucket", "__place")
    done = queue.where(~F.col("_touched")).withColumn("_some", F.lit(0)).unionByName(some)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_whole") + F.col("_some")).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


#: Ranges of finish time beyond 1 for each doubling of the time past 1. A double is past 1 by 2 ** -52 at least.
SLICES, FINEST, COARSEST = 64, -52, 63


def _slice(finish: Column) -> Column:
    """Range 0 holds finish times up to 1; those beyond 1 lie in ranges whose width grows with the time past 1, by about a hundredth of it."""
    past = F.log2(F.greatest(finish - 1, F.lit(2.0**FINEST)))
    return F.when(finish <= 1, 0).otherwise(1 + F.floor((F.least(past, F.lit(float(COARSEST))) - FINEST) * SLICES)).cast("int")


class _Edge(NamedTuple):
    slice: int
    before: int
    budget: float


def _edge(queue: DataFrame, rounds: list[Column]) -> _Edge:
    """The range of finish times in which the budget is spent, and what is served before it.

    Up to finish time 1 every source has had no more than its target, so the budget lasts beyond 1; and by then what is left is
    less than one document of each source. The ranges just past 1 are the narrowest, so the one in which the budget ends
    holds few rows, however many there are. At most SLICES sums for each doubling come to the driver, whatever the corpus.
    """
    budget = queue.select("source", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    budget += max(1e-9, budget * 1e-12)  # targets are rounded, words are whole
    sums = queue.select("size", F.explode(F.array(*[_slice(f) for f in rounds])).alias("slice")).groupBy("slice").agg(F.sum("size").alias("n")).orderBy("slice").collect()
    upto = 0
    for row in sums:
        if upto + row.n > budget:
            return _Edge(row.slice, upto, budget)
        upto += row.n
    return _Edge((COARSEST - FINEST) * SLICES + 2, upto, budget)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
