"""Lookups between tables of a corpus as joins. Every key includes doc_id, as ids repeat across documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.assets import asset_id, data_uri
from parchment.store import discard, growing, materialise

#: How well an exporter carries a type.
SUPPORTED = (
    "section heading paragraph quote list list_item code_block horizontal_rule page_break table figure image math_block footnote "
    "text hard_break code em strong strike underline link inline_math inline_image footnote_ref item row cell column"
).split()
DEGRADED = "callout embed mention cite".split()
PRESERVED = ["unknown"]


def asset_urls(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """nodes with asset_url, asset_filename and asset_mime: external URL, data URI of embedded bytes, or the reference itself."""
    own = assets.select("doc_id", "asset_id", F.col("url").alias("_url"), F.col("filename").alias("asset_filename"), F.col("mime").alias("asset_mime"), F.col("bytes").alias("_bytes"))
    joined = nodes.withColumn("asset_id", asset_id(F.col("asset"))).join(growing(own), ["doc_id", "asset_id"], "left")
    return joined.withColumn("asset_url", F.coalesce("_url", data_uri(F.col("asset_mime"), F.col("_bytes")), "asset")).drop("_url", "_bytes", "asset_id")


def dangling_assets(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """References to assets that are not registered."""
    refs = nodes.where("asset is not null").select("doc_id", "path", "asset", asset_id(F.col("asset")).alias("asset_id"))
    return refs.join(growing(assets.select("doc_id", "asset_id")), ["doc_id", "asset_id"], "left_anti")


def orphan_assets(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that no node refers to: allowed, but reported."""
    refs = nodes.where("asset is not null").select("doc_id", asset_id(F.col("asset")).alias("asset_id"))
    return assets.join(growing(refs), ["doc_id", "asset_id"], "left_anti")


def payloads(nodes: DataFrame, preserved: DataFrame) -> DataFrame:
    """nodes with payload: only those that are referred to are joined."""
    return nodes.join(growing(preserved.select("doc_id", F.col("path").alias("payload_ref"), F.col("bytes").alias("payload"))), ["doc_id", "payload_ref"], "left")


def footnote_numbers(nodes: DataFrame) -> DataFrame:
    """Definitions and references numbered by first reference: doc_id, target_ref, number, n_refs, defined."""
    refs = nodes.where("type = 'footnote_ref'").groupBy("doc_id", "target_ref").agg(F.min("seq").alias("first"), F.count("*").alias("n_refs"))
    numbered = refs.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
    defined = nodes.where("type = 'footnote'").select("doc_id", F.col("node_id").alias("target_ref"), F.lit(True).alias("defined")).distinct()
    return numbered.join(growing(defined), ["doc_id", "target_ref"], "left").select("doc_id", "target_ref", "number", "n_refs", F.coalesce("defined", F.lit(False)).alias("defined"))


def capability(nodes: DataFrame) -> DataFrame:
    """doc_id, status and n: nodes by how well an exporter carries their type; types of neither list are degraded."""
    status = F.when(F.col("type").isin(*SUPPORTED), "supported").when(F.col("type").isin(*PRESERVED), "preserved").otherwise("degraded")
    return nodes.groupBy("doc_id", status.alias("status")).agg(F.count("*").alias("n"))


def style_chain(styles: DataFrame, hops: int = 16) -> DataFrame:
    """styles(style, based_on, bold, font, size) -> effective values along based_on: a flag set anywhere, the nearest font and size.

    A join for each of at most hops steps, over the chains that go on; cycles end with it. Each step is written, so that it is read
    and not run again; a recursive query would end in an error beyond a million rows.
    """
    own = materialise(styles.select("style", "based_on", "bold", "font", "size"))
    base = growing(own.withColumnRenamed("style", "_at").select("_at", *[F.col(c).alias(f"_{c}") for c in ("based_on", "bold", "font", "size")]))
    steps = [own.withColumn("depth", F.lit(0))]
    for depth in range(1, hops):
        up = steps[-1].where("based_on is not null").join(base, F.col("based_on") == F.col("_at"))
        step = materialise(up.select("style", *[F.col(f"_{c}").alias(c) for c in ("based_on", "bold", "font", "size")], F.lit(depth).alias("depth")))
        if step.isEmpty():
            discard(step)
            break
        steps.append(step)
    near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    chain = reduce(DataFrame.unionByName, steps)
    return chain.groupBy("style").agg(F.bool_or("bold").alias("bold"), near("font"), near("size"), (F.max("depth") + 1).alias("hops"))


def pair_ranges(events: DataFrame, doc: str = "doc_id", key: str = "key", at: str = "at", kind: str = "kind") -> DataFrame:
    """Each end with the nearest start before it of the same key that no other end has taken: doc, key, start, end.

    Ends take starts like a stack does, so the match is by depth: a window numbers the nesting depth, which an end without
    an open start leaves at 0, and start and end of one depth alternate.
    """
    w = Window.partitionBy(doc, key).orderBy(at)
    step = F.when(F.col(kind) == "start", 1).otherwise(-1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    depth = events.withColumn("_s", F.sum(step).over(so_far)).withColumn("_low", F.least(F.lit(0), F.min("_s").over(so_far)))
    # an end has the depth that it closes: that of the row before
    depth = depth.withColumn("_o", F.col("_s") - F.col("_low")).withColumn("_d", F.when(F.col(kind) == "start", F.col("_o")).otherwise(F.coalesce(F.lag("_o").over(w), F.lit(0)))).drop("_s", "_low", "_o")
    level = Window.partitionBy(doc, key, "_d").orderBy(at)
    paired = depth.withColumn("start", F.lag(at).over(level)).withColumn("_k", F.lag(kind).over(level))
    return paired.where((F.col(kind) == "end") & (F.col("_k") == "start") & (F.col("_d") > 0)).select(doc, key, "start", F.col(at).alias("end"))


def by_position(left: DataFrame, right: DataFrame, partition: str, left_order: str, right_order: str) -> DataFrame:
    """The i-th row of one side with the i-th of the other, within a partition."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(partition).orderBy(left_order)))
    b = right.withColumn("_i", F.row_number().over(Window.partitionBy(partition).orderBy(right_order)))
    return a.join(growing(b), [partition, "_i"]).drop("_i")


def prefer(staged: DataFrame, registered: DataFrame, key: str, value: str) -> DataFrame:
    """A staged value goes before a registered one."""
    a, b = staged.select(key, F.col(value).alias("_a")), registered.select(key, F.col(value).alias("_b"))
    return a.join(growing(b), key, "full").select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "staged").otherwise("registered").alias("origin"))


def first_refs(nodes: DataFrame, column: str) -> DataFrame:
    """doc_id, ref and first: the distinct references of a column, with the place of the first use, by which they are ordered."""
    return nodes.where(F.col(column).isNotNull()).groupBy("doc_id", F.col(column).alias("ref")).agg(F.min("seq").alias("first"))


def mark_ranks(spans: DataFrame) -> DataFrame:
    """spans with rank: the place of a mark among those around a text; null for what is no mark. The table of marks is fixed."""
    from parchment.sources.editor import RANK

    table = spans.sparkSession.createDataFrame(sorted(RANK.items()), "type string, rank int")
    return spans.join(F.broadcast(table), "type", "left")
