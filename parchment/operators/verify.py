"""Verification of containers: the union of what its steps find, and the exit code that follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.operators import annotations as A
from parchment.operators import references as R
from parchment.operators import revisions as V
from parchment.operators.loss import consistent
from parchment.operators.validate import check_content, totals
from parchment.store import growing, materialise

#: Where a container's own files lie; entries elsewhere are reported and kept.
KNOWN = ("manifest.json", "content/", "presentation/", "semantics/", "assets/", "revisions/", "compatibility/", "reports/", "preserved/", "publications/")


def layer_issues(layers: DataFrame, entries: DataFrame) -> DataFrame:
    """layers(doc_id, layer, path, sha256) against entries(doc_id, name, bytes): paths taken twice, missing, or of another hash."""
    held = entries.select("doc_id", F.col("name").alias("path"), F.sha2("bytes", 256).alias("_sha"))
    n = F.count("*").over(Window.partitionBy("doc_id", "path"))
    joined = layers.withColumn("_n", n).join(growing(held), ["doc_id", "path"], "left")
    code = F.when(F.col("_n") > 1, "layer_path_repeated").when(F.col("_sha").isNull(), "layer_missing").when(F.col("_sha") != F.col("sha256"), "layer_changed")
    return joined.select("doc_id", "path", code.alias("code")).where("code is not null")


def unknown_entries(entries: DataFrame) -> DataFrame:
    """Entries outside the known places: kept, and reported for information."""
    known = reduce(lambda a, b: a | b, [F.col("name").startswith(k) for k in KNOWN])
    return entries.where(~known).select("doc_id", F.col("name").alias("path"), F.lit("entry_unknown").alias("code"))


def verify(
    entries: DataFrame, layers: DataFrame, nodes: DataFrame, assets: DataFrame, annotations: DataFrame, blocks: DataFrame, revisions: DataFrame, manifest: DataFrame,
    snapshots: DataFrame, publications: DataFrame, reports: DataFrame,
) -> DataFrame:
    """All issues of all documents: doc_id, level, code, path. Nothing comes to the driver.

    Each step is written by itself: as one plan, all of them have some eighty stages, which the driver plans anew after each of them
    and compiles together, and its memory then grows with the plan and not with the tables.
    """

    def of(found: DataFrame, level: str) -> DataFrame:
        path = F.col("path") if "path" in found.columns else F.lit(None).cast("string")
        return found.select("doc_id", F.lit(level).alias("level"), "code", path.alias("path"))

    parts = [
        of(layer_issues(layers, entries), "error"),
        check_content(nodes, entries.select("doc_id", F.col("name").alias("path"))),
        of(R.dangling_assets(nodes, assets).withColumn("code", F.lit("asset_dangling")), "error"),
        of(R.orphan_assets(nodes, assets).withColumn("code", F.lit("asset_orphan")), "info"),
        of(A.annotation_issues(annotations, blocks), "warning"),
        of(V.chain_issues(revisions, manifest, snapshots), "error"),
        of(V.publication_issues(publications, entries), "error"),
        of(consistent(reports).where("not consistent").withColumn("code", F.lit("report_inconsistent")), "warning"),
        of(unknown_entries(entries), "info"),
    ]
    return reduce(DataFrame.unionByName, [materialise(p) for p in parts])


def verdicts(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, infos, exit_code for every document."""
    return docs.select("doc_id").join(growing(totals(issues)), "doc_id", "left").na.fill(0)


def version_matches(files: DataFrame) -> DataFrame:
    """doc_id and matches: whether a container's manifest names the version that its header has."""
    from parchment.sources.container import entries, header_fields

    f = header_fields(F.col("content"))
    own = files.select("doc_id", F.concat_ws(".", f["major"].cast("string"), f["minor"].cast("string")).alias("_own"))
    said = entries(files).where("name = 'manifest.json'").select("doc_id", F.get_json_object(F.col("bytes").cast("string"), "$.parchm.format_version").alias("_said"))
    return own.join(growing(said), "doc_id", "left").select("doc_id", F.coalesce(F.col("_own") == F.col("_said"), F.lit(False)).alias("matches"))
