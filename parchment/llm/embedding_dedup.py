"""Near-duplicate embeddings by sorted projection passes whose windows are whole runs.

A pass gives each vector a hash of random signs, one for each of some random directions, and orders the vectors of a label by
it; neighbours are then those with equal hashes. Vectors whose hashes are equal form a run, and every run is compared whole,
block by block, however long it is, so no window cuts a link off in a loose or dense group. What is linked by a pass is united
with what other passes link, and a pair that meets in several passes counts in the first of them.

The number of signs follows the label's size, so that a run of evenly spread vectors has RUN at most, and the number of passes
follows from the signs, so that a pair at the threshold stays apart in all of them with probability MISS at most: two vectors
at an angle a agree in a sign with probability 1 - a / pi. A label of up to RUN distinct vectors needs no sign: one run, one
pass, and no link lost. The work is in proportion to passes x RUN for each vector of an evenly spread label; a run that stays
long, as its vectors are all close, is quadratic, and its blocks spread over tasks evenly, whatever share of the rows it holds.
Labels of one block share tasks.

Equal vectors are one class from the start, so a vector that very many rows repeat is compared once. Two blocks give a count
of links for each vector and edges that connect what is linked: counts and at most one edge a vector, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import discard, materialise, read
from parchment.llm.components import components
from parchment.llm.vectors import matrix, usable

COSINE = 0.98
#: Rows of a block, and of the strip of a block whose products are held at a time.
BLOCK, STRIP = 2048, 256
#: Distinct vectors of a run in an evenly spread label, and the probability that a pair at the threshold never shares a run.
RUN, MISS = 16_384, 1e-3


def signs(size: int, run: int) -> int:
    """Signs of a hash for a label of that many distinct vectors."""
    return max(0, ceil(log2(max(1, size) / run)))


def passes(bits: int, cosine: float, miss: float = MISS) -> int:
    """Passes that leave a pair at the threshold apart with probability miss at most."""
    return 1 if not bits else max(1, ceil(log(miss) / log(1 - (1 - acos(cosine) / pi) ** bits)))


def hashes(rows: np.ndarray, bits: int, times: int, seed: int = 17) -> np.ndarray:
    """A hash of each row for each pass."""
    if not bits:
        return np.zeros((len(rows), times), np.int64)
    on = rows @ np.random.default_rng([seed, rows.shape[1]]).standard_normal((times * bits, rows.shape[1])).T > 0
    return on.reshape(len(rows), times, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _hashed(cosine: float, run: int):
    """classes with the hash of every pass (keys)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([signs(n, run) for n in batch["size"].to_pylist()], np.int64)
            shape = np.stack([bits, batch["dim"].to_numpy()])
            keys: list = [None] * batch.num_rows
            for b, dim in np.unique(shape, axis=1).T.tolist():
                at = np.flatnonzero((shape[0] == b) & (shape[1] == dim))
                made = hashes(matrix(batch["vector"].take(pa.array(at))), b, passes(b, cosine))
                for i, row in zip(at, made, strict=True):
                    keys[i] = row
            yield batch.append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    return of


def _unit(column) -> np.ndarray:
    rows = matrix(column)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _forest(links: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (row, column) that connect all that links, a matrix of row by column, connects."""
    rows, columns = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    a, b = [], []
    for start in np.flatnonzero(links.any(axis=1)):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(links[x] & columns):
                columns[y] = False
                a.append(x)
                b.append(y)
                more = np.flatnonzero(links[:, y] & rows)
                rows[more] = False
                a.extend(more)
                b.extend([y] * len(more))
                todo.extend(more)
    return a, b


def _close(unit: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of each of x and each of y reaches the threshold; in single precision where that is beyond doubt."""
    rough = unit.astype(np.float32)
    links = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), STRIP):
        at = x[k : k + STRIP]
        near = rough[at] @ rough[y].T >= cosine - 1e-4
        i, j = np.nonzero(near)
        if len(i) > near.size // 16:
            near = unit[at] @ unit[y].T >= cosine
        else:
            near[i, j] = np.einsum("ij,ij->i", unit[at[i]], unit[y[j]]) >= cosine
        links[k : k + STRIP] = near
    return links


def _compare(cosine: float):
    """Of two blocks of a run, or of one block with whole short runs: node and how many vectors it links with (n), and edges between ids."""

    def run(table: pa.Table) -> pa.Table:
        node, least, copies, left, right = (table[c].to_numpy() for c in ("node", "least", "copies", "left", "right"))
        of = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        one = bool((left & right).all())
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        links = _close(_unit(table["vector"]), x, y, cosine)
        if len(np.unique(of)) > 1:
            links &= of[x][:, None] == of[y][None, :]
        if one:
            np.fill_diagonal(links, False)
        counted, nth = links, int(table["nth"][0].as_py())
        if nth:  # pairs that an earlier pass has compared are counted there
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), nth)
            i, j = np.nonzero(links)
            counted = links.copy()
            counted[i, j] = ~(keys[x[i]] == keys[y[j]]).any(axis=1)
        n = counted @ copies[y]
        ids, counts = (node[x], n) if one else (np.concatenate([node[x], node[y]]), np.concatenate([n, counted.T @ copies[x]]))
        a, b = _forest(links)
        some = counts > 0
        made = pa.table({"node": ids[some], "n": counts[some], "other": pa.nulls(int(some.sum()), pa.int64())})
        edges = pa.table({"node": least[x][np.array(a, int)], "n": pa.nulls(len(a), pa.int64()), "other": least[y][np.array(b, int)]})
        return pa.concat_tables([made, edges])

    return run


def near_vectors(
    table: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", longest: int = RUN
) -> DataFrame:
    """One row for each row of table: vec_id, n_links, component_id (smallest vec_id reachable by links) and kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least cosine. Vectors
    of null label or id, and those that are null, zero or hold null or non-finite components, have no links and are their
    own component (null for a null id, and kept). Vectors of different dimension do not link. Rows that repeat an id and
    its vector are one vector; equal vectors under different ids link. Rows that repeat an id with several vectors, or under
    several labels, each have the links of their own vector, and one component. An empty table gives an empty result; other
    columns play no part.
    """
    base = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    takes = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")), F.lit(False))
    class_ = F.when(takes, F.struct(F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(1), "vector", "label").alias("g")))
    rows = base.withColumn("class", class_)
    ids = rows.where("class is not null").groupBy("class", "vec_id").agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = ids.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumns({"dim": F.size("vector"), "node": F.monotonically_increasing_id()}))
    label_sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    columns = "label string, dim int, node long, least long, copies long, vector array<double>, size long"
    hashed = classes.join(label_sizes, ["label", "dim"]).select(*[c.split()[0] for c in columns.split(", ")])
    hashed = materialise(hashed.mapInArrow(_hashed(cosine, longest), columns + ", keys array<long>"))
    met = hashed.select("*", F.posexplode("keys").alias("nth", "key")).drop("size")
    runs = met.groupBy("label", "dim", "nth", "key").agg(F.count("*").alias("size"))
    placed = met.join(runs, ["label", "dim", "nth", "key"]).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # blocks of a long run against each other, short runs together in bins
    bins = max(1, -(-hashed.count() // (BLOCK // 2)))
    i = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    none = F.lit(None).cast("string")
    small = F.array(F.struct(none.alias("of"), F.pmod(F.xxhash64("label", "key"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right")))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.concat_ws(" ", F.col("key").cast("string"), "label").alias("of"), F.least(i, k).alias("i"), F.greatest(i, k).alias("j"), (i <= k).alias("left"), (i >= k).alias("right")),
    )
    named = F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.concat_ws(" ", F.col("key").cast("string"), "label")).alias("label")
    dealt = placed.withColumn("to", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(small)))
    dealt = dealt.select("to.*", named, "dim", "nth", F.slice("keys", F.lit(1), F.col("nth")).alias("keys"), "node", "least", "copies", "vector")
    found = materialise(dealt.groupBy("of", "i", "j", "dim", "nth").applyInArrow(_compare(cosine), "node long, n long, other long"))
    discard(hashed)
    # an id with several vectors or labels is one document: its classes have one component
    several = ids.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    shared = ids.select("vec_id", "class").join(several, "vec_id").join(classes.select("class", "least"), "class").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    comps = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(shared))
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.select("class", "node", "least", "copies").join(comps.withColumnRenamed("id", "least"), "least", "left").join(counts, "node", "left")
    known = known.select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    done = rows.select("vec_id", "class").join(known, "class", "left")
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a),
c AS (SELECT id, min(x) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.id
"""
