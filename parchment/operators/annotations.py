"""Annotations on text quotes: where they stand after an edit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import context_of
from parchment.store import growing

#: Passages of one or two words that quoted() takes at most.
SHORT_PASSAGES = 1000


def relocate(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """annotations(doc_id, annotation_id, target_block, exact, prefix, suffix), blocks(doc_id, node_id, text) -> decision of each.

    unchanged: the quote stands in its block with prefix and suffix. reanchored: it stands in its block, with other context.
    moved: it stands in exactly one other block of the document. detached: anything else, an empty quote included; nothing is
    ever deleted. The search among other blocks is an equi-join on doc_id with a residual contains, over the annotations
    that need it only; its hits are counted, not gathered.
    """
    own = blocks.select("doc_id", F.col("node_id").alias("target_block"), F.col("text").alias("own"))
    a = annotations.join(growing(own), ["doc_id", "target_block"], "left")
    whole = F.concat(F.coalesce("prefix", F.lit("")), F.col("exact"), F.coalesce("suffix", F.lit("")))
    empty = F.coalesce(F.col("exact"), F.lit("")) == ""
    here = F.when(empty, "detached").when(F.coalesce(F.contains("own", whole), F.lit(False)), "unchanged").when(F.coalesce(F.contains("own", "exact"), F.lit(False)), "reanchored")
    a = a.withColumn("_here", here)
    away = a.where("_here is null").select("doc_id", "annotation_id", "target_block", "exact")
    other = blocks.select("doc_id", "node_id", "text")
    hits = away.join(growing(other), "doc_id").where(F.contains("text", "exact") & ~F.col("node_id").eqNullSafe(F.col("target_block")))
    found = hits.groupBy("doc_id", "annotation_id").agg(F.count("*").alias("_n"), F.min("node_id").alias("_to"), F.min("text").alias("_text")).where("_n = 1")
    out = a.join(growing(found), ["doc_id", "annotation_id"], "left")
    state = F.coalesce("_here", F.when(F.col("_to").isNotNull(), "moved").otherwise("detached"))
    text = F.when(state == "moved", F.col("_text")).when(state == "reanchored", F.col("own"))
    before, after = context_of(text, F.col("exact"))
    return out.select(
        "doc_id", "annotation_id", state.alias("state"), F.when(state == "moved", F.col("_to")).when(state == "detached", F.lit(None)).otherwise(F.col("target_block")).alias("block"),
        F.when(text.isNotNull(), before).otherwise(F.col("prefix")).alias("prefix"), F.when(text.isNotNull(), after).otherwise(F.col("suffix")).alias("suffix"),
    )


def relocation_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("doc_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "reanchored", "moved", "detached")])


def annotation_issues(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Targets that do not exist and quotes that do not stand in their block."""
    own = blocks.select("doc_id", F.col("node_id").alias("target_block"), F.col("text").alias("own"))
    a = annotations.join(growing(own), ["doc_id", "target_block"], "left")
    code = F.when(F.col("own").isNull(), "target_missing").when(F.col("exact").isNotNull() & ~F.contains("own", "exact"), "quote_missing")
    return a.select("doc_id", "annotation_id", code.alias("code")).where("code is not null")


def annotate(annotations: DataFrame, proposed: DataFrame, blocks: DataFrame) -> DataFrame:
    """annotations and those proposed whose block exists and whose value is a JSON object."""
    real = proposed.join(growing(blocks.select("doc_id", F.col("node_id").alias("target_block")).distinct()), ["doc_id", "target_block"], "left_semi")
    return annotations.unionByName(real.where(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")), allowMissingColumns=True)


def guarded(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """Model results that may be used: their block exists and is a paragraph, the quote stands in it, confidence is in 0..1."""
    own = blocks.select("doc_id", F.col("node_id").alias("target_block"), "text", "type")
    return results.join(growing(own), ["doc_id", "target_block"]).where(F.contains("text", "exact") & F.col("confidence").between(0, 1) & (F.col("type") == "paragraph")).drop("text", "type")


def quoted(texts: DataFrame, passages: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id and item_id of each text (doc_id, text) that contains a passage (item_id, passage).

    A text that contains a passage holds each of its inner words between blanks, so the longest inner word is the key of an
    equi-join; only keys move in it, and a text is fetched once for the passages whose key it holds. Passages of one or two words
    have no inner word: they are compared with every text, in one pass over the texts, as a list on each row. There may be a few
    of them at most, which is checked.
    """
    inner = F.expr("slice(split(passage, ' '), 2, greatest(size(split(passage, ' ')) - 2, 0))")
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = passages.select(F.col(item_id).alias("item_id"), "passage", key.alias("word"))
    long, short = keyed.where("word is not null and word <> ''"), keyed.where("(word is null or word = '') and passage <> ''")
    given = texts.select(F.col(doc_id).alias("doc_id"), "text")
    words = given.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    near = words.join(long.select("item_id", "word"), "word").groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    fetched = near.join(given, "doc_id").select("doc_id", "text", F.explode("items").alias("item_id"))
    hits = fetched.join(long.select("item_id", "passage"), "item_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    few = short.select("item_id", "passage").limit(SHORT_PASSAGES + 1).collect()
    if len(few) > SHORT_PASSAGES:
        raise ValueError(f"more than {SHORT_PASSAGES} passages of one or two words")
    if few:
        listed = F.array(*[F.struct(F.lit(r.item_id).alias("item_id"), F.lit(r.passage).alias("passage")) for r in few])
        brief = given.select("doc_id", F.explode(F.filter(listed, lambda x: F.contains(F.col("text"), x["passage"]))).alias("x")).select("doc_id", "x.item_id")
        hits = hits.unionByName(brief)
    return hits.distinct()


def targets_missing(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Annotations (doc_id, target_block, ...) whose block (doc_id, node_id) is not in the document."""
    return annotations.join(growing(blocks.select("doc_id", F.col("node_id").alias("target_block"))), ["doc_id", "target_block"], "left_anti")


def listed(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """annotations with state and detached, as a list of them shows where they stand now."""
    now = relocate(annotations, blocks).select("doc_id", "annotation_id", "state")
    return annotations.join(growing(now), ["doc_id", "annotation_id"]).withColumn("detached", F.col("state") == "detached")
