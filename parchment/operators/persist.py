"""Saving the assets that an edited document refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.assets import asset_id, data_uri_mime, data_uri_payload
from parchment.functions.text import identifier


def persist_assets(nodes: DataFrame, staged: DataFrame, registered: DataFrame) -> DataFrame:
    """doc_id, asset (the reference), asset_id, storage, mime, sha256, url and warning for each distinct reference of a document.

    A staged asset (doc_id, asset_id, mime, bytes) becomes embedded; a registered one (doc_id, asset_id) stays as it is; a data URI is
    moved into the container once for each identical string; a web address becomes external. Any other reference is kept, with a warning.
    """
    refs = nodes.where("asset is not null").groupBy("doc_id", "asset").agg(F.min("seq").alias("seq")).withColumn("own", asset_id(F.col("asset")))
    known = registered.select("doc_id", F.col("asset_id").alias("own"), F.lit(True).alias("_known")).distinct()
    held = staged.select("doc_id", F.col("asset_id").alias("own"), F.col("mime").alias("_mime"), F.sha2("bytes", 256).alias("_sha"))
    joined = refs.join(known, ["doc_id", "own"], "left").join(held, ["doc_id", "own"], "left")
    data, web = F.col("asset").startswith("data:") & F.col("asset").contains(","), F.col("asset").rlike("^https?://")
    kind = F.when(F.col("_sha").isNotNull(), "staged").when(F.col("_known"), "registered").when(data, "data").when(web, "web").otherwise("unknown")
    new = F.row_number().over(Window.partitionBy("doc_id", F.col("kind").isin("data", "web")).orderBy("seq"))
    numbered = joined.withColumn("kind", kind).withColumn("_n", new)
    is_kind = lambda *k: F.col("kind").isin(*k)
    return numbered.select(
        "doc_id", "asset", F.when(is_kind("staged", "registered"), F.col("own")).when(is_kind("data", "web"), identifier(F.col("_n"), "as")).alias("asset_id"),
        F.when(is_kind("staged", "data"), "embedded").when(is_kind("web"), "external").when(is_kind("registered"), "registered").alias("storage"),
        F.when(is_kind("staged"), F.col("_mime")).when(is_kind("data"), data_uri_mime(F.col("asset"))).alias("mime"),
        F.when(is_kind("staged"), F.col("_sha")).when(is_kind("data"), F.sha2(data_uri_payload(F.col("asset")), 256)).alias("sha256"),
        F.when(is_kind("web"), F.col("asset")).alias("url"), F.when(is_kind("unknown"), "reference kept as it is").alias("warning"),
    )
