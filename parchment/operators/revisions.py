"""Revision chains: history, checks, differences, commit and checkout; and caches that depend on a revision."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from parchment.store import growing


def history(revisions: DataFrame) -> DataFrame:
    """revisions(doc_id, rev, parent, author_type, sha256) with position from the newest, is_head and is_root.

    The position is that of the chain's own order, which rev gives; a parent that is no revision is a break in the chain.
    """
    newest = Window.partitionBy("doc_id").orderBy(F.col("rev").desc())
    known = revisions.select("doc_id", F.col("rev").alias("parent"), F.lit(True).alias("_known"))
    out = revisions.withColumn("position", F.row_number().over(newest)).join(growing(known), ["doc_id", "parent"], "left")
    return out.withColumns({"is_head": F.col("position") == 1, "is_root": F.col("parent").isNull(), "broken": F.col("parent").isNotNull() & F.col("_known").isNull()}).drop("_known")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, rev, parent), a document's together and its newest first -> (doc_id, rev, depth), a document at a time."""
    none = object()
    doc, head, parents, found = none, None, {}, []

    def finish() -> None:
        if doc is none:
            return
        at, depth, seen = head, 0, set()
        while depth == 0 or (at is not None and at in parents):
            if at in seen:
                raise ValueError(f"the revisions of document {doc} run in a circle at {at}")
            seen.add(at)
            found.append((doc, at, depth))
            at, depth = parents[at], depth + 1

    types = None
    for batch in batches:
        types = [batch.schema.field("doc_id").type, batch.schema.field("rev").type, pa.int32()]
        for d, rev, parent in zip(*(batch[c].to_pylist() for c in ("doc_id", "rev", "parent")), strict=True):
            if doc is none or d != doc:
                finish()
                doc, head, parents = d, rev, {}
            parents.setdefault(rev, parent)
        yield _chain_rows(found, types)
        found.clear()
    if types:
        finish()
        yield _chain_rows(found, types)


def _chain_rows(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "rev", "depth"])


def ancestors(revisions: DataFrame) -> DataFrame:
    """doc_id, rev, depth: revisions reached from the head along parent, however long the chain; a chain in a circle is an error.

    One exchange; a task holds the parents of one document at a time. A document's rows of equal rev count once.
    """
    rows = revisions.select("doc_id", "rev", "parent")
    schema = StructType([*rows.select("doc_id", "rev").schema.fields, StructField("depth", IntegerType())])
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("rev").desc()).mapInArrow(_walk, schema)


def differences(items: DataFrame, revisions: DataFrame) -> DataFrame:
    """items(doc_id, rev, item), revisions(doc_id, rev, parent) -> n_added and n_removed of each revision against its parent.

    Sets, not multisets; a root has nothing to differ from and counts everything as added.
    """
    own = items.select("doc_id", "rev", "item").distinct()
    kept = revisions.select("doc_id", "rev", "parent")
    was = kept.join(growing(own.withColumnRenamed("rev", "parent")), ["doc_id", "parent"]).select("doc_id", "rev", "item", F.lit(1).alias("_was"))
    both = own.withColumn("_is", F.lit(1)).join(growing(was), ["doc_id", "rev", "item"], "full")
    counted = both.groupBy("doc_id", "rev").agg(F.count_if(F.col("_was").isNull()).alias("n_added"), F.count_if(F.col("_is").isNull()).alias("n_removed"))
    return kept.select("doc_id", "rev").join(growing(counted), ["doc_id", "rev"], "left").na.fill(0, ["n_added", "n_removed"])


def commit(revisions: DataFrame, snapshots: DataFrame, author_type: str, message: str) -> DataFrame:
    """revisions and one more for each document of snapshots(doc_id, content) whose content differs from the head's."""
    head = revisions.groupBy("doc_id").agg(F.max_by(F.struct("rev", "sha256"), "rev").alias("_head"))
    new = snapshots.withColumn("sha256", F.sha2("content", 256)).join(growing(head), "doc_id", "left").where(~F.col("sha256").eqNullSafe(F.col("_head.sha256")))
    made = new.select("doc_id", (F.coalesce(F.col("_head.rev"), F.lit(-1)) + 1).alias("rev"), F.col("_head.rev").alias("parent"), F.lit(author_type).alias("author_type"), F.lit(message).alias("message"), "sha256")
    return revisions.unionByName(made, allowMissingColumns=True)


def checkout(manifest: DataFrame, revisions: DataFrame, rev: Column) -> DataFrame:
    """manifest(doc_id, current_revision, ...) with the revision and its content hash restored; documents without it stay."""
    wanted = revisions.withColumn("_to", rev).where("rev = _to").select("doc_id", F.col("rev").alias("_rev"), F.col("sha256").alias("_sha"))
    out = manifest.join(growing(wanted), "doc_id", "left")
    return out.withColumns({"current_revision": F.coalesce("_rev", "current_revision"), "content_sha256": F.coalesce("_sha", "content_sha256")}).drop("_rev", "_sha")


def fresh(revision: Column, current: Column, sha: Column, content: Column) -> Column:
    """Whether a cache is of the current revision (null equals null), and of the current content where it says."""
    return revision.eqNullSafe(current) & (sha.isNull() | (sha == content))


def stale_caches(caches: DataFrame, manifest: DataFrame, formats: tuple[str, ...] = ("markdown", "text", "html")) -> DataFrame:
    """doc_id, format, known: caches to be built again, and those of formats that cannot be."""
    joined = caches.join(growing(manifest.select("doc_id", "current_revision", F.col("content_sha256").alias("_content"))), "doc_id")
    old = joined.where(~F.coalesce(fresh(F.col("revision"), F.col("current_revision"), F.col("content_sha256"), F.col("_content")), F.lit(False)))
    return old.select("doc_id", "format", F.col("format").isin(*formats).alias("known"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of its keys."""
    return table.join(growing(new.select(*keys)), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def next_sequence(paths: DataFrame, prefix: str) -> DataFrame:
    """doc_id and next: one more than the largest number after a prefix, 1 without any."""
    n = F.regexp_extract("path", f"{prefix}(\\d+)", 1).try_cast("int")
    return paths.groupBy("doc_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def chain_issues(revisions: DataFrame, manifest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Breaks of a chain: missing parents, several roots, a current revision outside it, snapshots of another hash."""
    h = history(revisions)
    broken = h.where("broken").select("doc_id", F.lit("parent_missing").alias("code"))
    roots = h.where("is_root").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("several_roots").alias("code"))
    outside = manifest.where("current_revision is not null").join(growing(revisions.select("doc_id", F.col("rev").alias("current_revision"))), ["doc_id", "current_revision"], "left_anti").select("doc_id", F.lit("current_missing").alias("code"))
    changed = revisions.join(growing(snapshots.select("doc_id", "rev", "content")), ["doc_id", "rev"]).where(F.sha2("content", 256) != F.col("sha256")).select("doc_id", F.lit("snapshot_changed").alias("code"))
    return broken.unionByName(roots).unionByName(outside).unionByName(changed).distinct()


def publication_issues(publications: DataFrame, entries: DataFrame) -> DataFrame:
    """Artifacts that are missing or changed since they were frozen."""
    held = entries.select("doc_id", F.col("name").alias("path"), F.sha2("bytes", 256).alias("_sha"))
    joined = publications.join(growing(held), ["doc_id", "path"], "left")
    code = F.when(F.col("_sha").isNull(), "artifact_missing").when(F.col("_sha") != F.col("sha256"), "artifact_changed")
    return joined.select("doc_id", "path", code.alias("code")).where("code is not null")


def published(publications: DataFrame, content: DataFrame, renderer: str, css_version: str, mode: str) -> DataFrame:
    """publications and a frozen record for each row of content(doc_id, revision, content, theme, artifact)."""
    h = F.sha2("content", 256)
    layout = F.sha2(F.concat(F.lit(renderer), h, F.coalesce("theme", F.lit("")), F.lit(css_version), F.lit(mode)), 256)
    made = content.select("doc_id", F.col("revision").alias("source_revision"), F.lit(renderer).alias("renderer"), h.alias("content_hash"), layout.alias("layout_hash"), F.sha2("artifact", 256).alias("sha256"))
    return publications.unionByName(made, allowMissingColumns=True)


def heads_in_chain(manifest: DataFrame, revisions: DataFrame) -> DataFrame:
    """manifest rows (doc_id, current_revision, ...) whose revision is one of the document's."""
    return manifest.join(growing(revisions.select("doc_id", F.col("rev").alias("current_revision"))), ["doc_id", "current_revision"], "left_semi")


def only_in(items: DataFrame, of: Column, against: Column) -> DataFrame:
    """doc_id and item: the distinct items (doc_id, rev, item) of one revision that another lacks."""
    return items.where(of).select("doc_id", "item").subtract(items.where(against).select("doc_id", "item"))


def latest_report(paths: DataFrame, prefix: str) -> DataFrame:
    """doc_id, path and n: the entry with the largest number after a prefix."""
    n = F.regexp_extract("path", f"^{prefix}(\\d+)", 1).try_cast("int")
    return paths.withColumn("n", n).where("n is not null").groupBy("doc_id").agg(F.max_by("path", "n").alias("path"), F.max("n").alias("n"))
