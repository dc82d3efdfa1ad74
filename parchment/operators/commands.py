"""Document commands over tables of containers: import as a command, info, and the model pipeline with a deterministic provider."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.operators import structure as S
from parchment.operators.annotations import guarded
from parchment.operators.render import Document, render
from parchment.schemas import LOSS_CLASSES
from parchment.sources.container import entries, pack
from parchment.sources.importers import READERS
from parchment.store import growing, materialise, spread
from parchment.tree import Job

CONTENT, REVISIONS, REPORT, CACHE = "content/content.json", "revisions/revisions.json", "reports/import-0001.json", "compat/document.txt"
#: Members of a manifest that this library writes; others are kept and reported.
KNOWN = ("parchm", "document", "layers", "current_revision", "caches")


def _json(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True).encode()


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def report_of(job: Job, source: str) -> dict:
    lost = [e for e in job.loss if e["loss_class"] != "none"]
    counts = {c: sum(e["loss_class"] == c for e in job.loss) for c in LOSS_CLASSES}
    issues = [{"id": f"iss_{i:04d}", **{k: e[k] for k in ("feature", "loss_class", "action", "detail")}} for i, e in enumerate(lost)]
    return {"report_version": "1.0", "direction": "import", "source": source, "target": "container", "engine": "parchment", "status": "partial" if lost else "complete", "summary": {"loss": counts}, "issues": issues}


def container_of(doc_id, text: str | None, fmt: str) -> bytes:
    """A container of one document: content, kept payloads and assets, first revision, report and text cache."""
    nodes, job = READERS[fmt](text or "")
    preserved = {p["path"]: bytes(p["bytes"]) for p in job.preserved}
    content = _json({"schema_version": "1.0", "title": job.title, "language": job.language, "content": nodes})
    cache = render(Document(nodes, job.assets, preserved, job.title, job.language), "text")[0].encode()
    revisions = _json([{"id": 1, "parent": None, "author": {"type": "import"}, "message": f"import from {fmt}", "path": CONTENT, "sha256": _sha(content)}])
    report = _json(report_of(job, fmt))
    layers = {"content": {"path": CONTENT, "sha256": _sha(content)}, "revisions": {"path": REVISIONS, "sha256": _sha(revisions)}, "report": {"path": REPORT, "sha256": _sha(report)}}
    manifest = {
        "parchm": {"format_version": "1.0", "container_profile": "prefixed"}, "document": {"id": str(doc_id), "schema_version": "1.0"}, "layers": layers, "current_revision": 1,
        "caches": [{"format": "text", "path": CACHE, "revision": 1, "content_sha256": _sha(content)}],
    }
    assets = [(a["path"], a["bytes"]) for a in job.assets if a["bytes"] is not None]
    return pack([("manifest.json", _json(manifest)), (CONTENT, content), (REVISIONS, revisions), (REPORT, report), (CACHE, cache), *preserved.items(), *assets])


def import_documents(table: DataFrame, fmt: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and content: each row imported and packed in one task; null text is an empty document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": [container_of(i, t, fmt) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]})

    return spread(table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInPandas(run, "doc_id long, content binary")


LAYER = "struct<path:string,sha256:string>"
MANIFEST = f"layers map<string,{LAYER}>, current_revision int, caches array<struct<format:string,path:string,revision:int,content_sha256:string>>, parchm struct<format_version:string>"


def info(files: DataFrame) -> DataFrame:
    """What a container says of itself: doc_id, format_version, current_revision, n_layers, layers_ok, n_caches, fresh_caches, unknown_keys, n_reports, lost.

    Layers are checked against their entries, caches against the revision and the content that the entry holds, losses summed over
    all reports; a manifest's members of other names are listed. One pass opens the files; the rest joins small rows by document.
    """
    held = entries(files).where("name is not null").select("doc_id", "name", F.sha2("bytes", 256).alias("sha"), F.when(F.col("name").rlike(r"^manifest\.json$|^reports/"), F.col("bytes").cast("string")).alias("json"))
    manifests = held.where("name = 'manifest.json'").select("doc_id", F.from_json("json", MANIFEST).alias("m"), F.json_object_keys("json").alias("keys"))
    layers = manifests.select("doc_id", F.explode("m.layers").alias("layer", "l")).join(held.select("doc_id", F.col("name").alias("_path"), "sha"), (F.col("_path") == F.col("l.path")) & (manifests["doc_id"] == held["doc_id"]), "left")
    layers = layers.select(manifests["doc_id"], "layer", "sha", (F.col("sha") == F.col("l.sha256")).alias("ok"))
    checked = layers.groupBy("doc_id").agg(F.count("*").alias("n_layers"), F.count_if("ok").alias("layers_ok"), F.max(F.when(F.col("layer") == "content", F.col("sha"))).alias("_content"))
    loss = F.from_json(F.get_json_object("json", "$.summary.loss"), "map<string,long>")
    lossy = F.array(*[F.lit(c) for c in LOSS_CLASSES[1:]])
    lost = F.aggregate(lossy, F.lit(0).cast("long"), lambda n, c: n + F.coalesce(loss[c], F.lit(0).cast("long")))
    reports = held.where("name like 'reports/%'").groupBy("doc_id").agg(F.count("*").alias("n_reports"), F.sum(lost).alias("lost"))
    fresh = F.filter("m.caches", lambda c: (c["revision"] == F.col("m.current_revision")) & (c["content_sha256"] == F.col("_content")))
    known = F.array(*[F.lit(k) for k in KNOWN])
    return (
        manifests.join(growing(checked), "doc_id", "left").join(growing(reports), "doc_id", "left")
        .select(
            "doc_id", F.col("m.parchm.format_version").alias("format_version"), F.col("m.current_revision").alias("current_revision"), F.coalesce("n_layers", F.lit(0)).alias("n_layers"),
            F.coalesce("layers_ok", F.lit(0)).alias("layers_ok"), F.coalesce(F.size("m.caches"), F.lit(0)).alias("n_caches"), F.coalesce(F.size(fresh), F.lit(0)).alias("fresh_caches"),
            F.array_join(F.array_sort(F.array_except("keys", known)), ",").alias("unknown_keys"), F.coalesce("n_reports", F.lit(0)).alias("n_reports"), F.coalesce("lost", F.lit(0)).alias("lost"),
        )
    )


# the model pipeline

#: Characters of a block that a model is shown, and how many annotations and rewrites of a document are taken at most.
SHOWN, MOST_ANNOTATIONS, MOST_REWRITES, LEAST = 240, 8, 2, 20


def listing(nodes: DataFrame) -> DataFrame:
    """doc_id, seq, target_block, type, text and shown: the paragraphs and headings of a node table as a model is shown them."""
    blocks = nodes.where("type in ('paragraph', 'heading')").select("doc_id", "seq", "path", F.col("node_id").alias("target_block"), "type")
    found = blocks.join(growing(S.plain_spans(nodes)), ["doc_id", "path"])
    return found.select("doc_id", "seq", "target_block", "type", "text", F.substring("text", 1, SHOWN).alias("shown"))


def _first(rows: DataFrame, order: list, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def proposed(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the deterministic provider answers: annotations of the longest paragraphs and of headings, and rewrites of the longest paragraphs.

    Of equally long paragraphs the last goes first. An annotation quotes the first 24 characters; a rewrite ends in a full stop.
    """
    long = listed.where((F.col("type") == "paragraph") & (F.length("shown") >= LEAST)).withColumn("size", F.length("shown"))
    order = [F.col("size").desc(), F.col("seq").desc()]
    own = long.select("doc_id", "seq", "size", "target_block", F.substring("shown", 1, 24).alias("exact"), F.lit(0.9).alias("confidence"))
    heads = listed.where("type = 'heading'").select("doc_id", "seq", F.lit(0).alias("size"), "target_block", F.col("shown").alias("exact"), F.lit(0.9).alias("confidence"))
    rewrites = _first(long, order, MOST_REWRITES).select("doc_id", "seq", "target_block", F.when(F.col("text").endswith("."), F.col("text")).otherwise(F.concat("text", F.lit("."))).alias("text"))
    return _first(own.unionByName(heads), order, MOST_ANNOTATIONS), rewrites


def model_pipeline(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations that pass the guards, and a revision for each rewrite that changes its block: doc_id, rev, parent, target_block, text.

    Guards: the block exists and is a paragraph, the quote stands in it, the confidence is in 0..1. Revision 1 is the import.
    The listing is written, as several joins read it.
    """
    listed = materialise(listing(nodes))
    annotations, rewrites = proposed(listed)
    blocks = listed.select("doc_id", F.col("target_block").alias("node_id"), "text", "type")
    kept = guarded(annotations, blocks).select("doc_id", "target_block", "exact")
    changed = rewrites.join(growing(listed.select("doc_id", "target_block", F.col("text").alias("_old"))), ["doc_id", "target_block"]).where("text <> _old")
    rev = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) + 1
    return kept, changed.withColumn("rev", rev).select("doc_id", "rev", (F.col("rev") - 1).alias("parent"), "target_block", "text")


def rewrite_blocks(nodes: DataFrame, rewrites: DataFrame) -> DataFrame:
    """nodes with the content of rewritten paragraphs (doc_id, target_block, text) replaced by one text span each; other rows stay."""
    given = rewrites.select("doc_id", F.col("target_block").alias("node_id"), F.col("text").alias("_new"))
    hit = nodes.where("type = 'paragraph'").join(growing(given), ["doc_id", "node_id"]).select("doc_id", F.col("path").alias("_block"), F.col("seq").alias("_seq"), "_new")
    inside = nodes.withColumn("_block", F.when(F.col("kind") == "span", F.regexp_extract("path", r"^(.*?)\.content\[\d+\](?:\.content\[\d+\])*$", 1)))
    joined = inside.join(growing(hit.select("doc_id", "_block", "_new")), ["doc_id", "_block"], "left")
    first = F.col("path") == F.concat("_block", F.lit(".content[0]"))
    # the first span becomes the text, the others go; numbers of rows after them keep their order
    kept = joined.where(F.col("_new").isNull() | first)
    plain = {c: F.when(F.col("_new").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("url", "title", "latex", "target_ref", "asset", "alt", "extra")}
    text = F.coalesce("_new", "text").alias("text")
    kind = F.when(F.col("_new").isNotNull(), "text").otherwise(F.col("type")).alias("type")
    return kept.select(*[text if c == "text" else kind if c == "type" else plain.get(c, F.col(c)) for c in nodes.columns])


def longest_block(listed: DataFrame) -> DataFrame:
    """doc_id, target_block and shown of the longest paragraph of at least LEAST characters; of equally long ones the last."""
    long = listed.where((F.col("type") == "paragraph") & (F.length("shown") >= LEAST))
    best = long.groupBy("doc_id").agg(F.max_by(F.struct("target_block", "shown"), F.struct(F.length("shown"), "seq")).alias("b"))
    return best.select("doc_id", "b.target_block", "b.shown")
