"""Importers and exporters over tables: text in a column to the node table and its companions, and back.

Parsing happens once, in Arrow batches, and gives one row for each document with everything it yields; the node table, loss
events, assets and so on are explosions of that row. Where a document is only converted, parser and renderer run in the same
task and nothing is exchanged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators.render import Document, render
from parchment.schemas import ANNOTATIONS, ASSETS, LOSS, NODES, PRESERVED
from parchment.sources import editor
from parchment.sources.html import read_html
from parchment.sources.markdown import read_markdown
from parchment.sources.pandoc import read_pandoc, write_pandoc
from parchment.sources.sanitize import sanitize_paste
from parchment.store import small_batches, spread
from parchment.tree import STRUCTS, Job, flatten, plain_block, unflatten

READERS: dict[str, Callable[[str], tuple[list[dict], Job]]] = {
    "html": read_html,
    "markdown": read_markdown,
    "pandoc": lambda t: read_pandoc(t) if t else ([], Job()),
    "editor": lambda t: (editor.from_editor(json.loads(t)), Job()) if t else ([], Job()),
}


IMPORTED = "doc_id long, title string, language string, nodes array<struct<{n}>>, loss array<struct<{l}>>, preserved array<struct<{p}>>, assets array<struct<{a}>>, annotations array<struct<{m}>>, theme string"


def _fields(schema: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", ") if not f.startswith("doc_id "))


SCHEMA = IMPORTED.format(n=_fields(NODES), l=_fields(LOSS), p=_fields(PRESERVED), a=_fields(ASSETS), m=_fields(ANNOTATIONS))
COLUMNS = ["doc_id", "title", "language", "nodes", "loss", "preserved", "assets", "annotations", "theme"]


def gathered(doc_id, nodes: list[dict], job: Job) -> dict:
    """The row of an imported document."""
    loss = [{"direction": "import", "seq": i, **e} for i, e in enumerate(job.loss)]
    return {
        "doc_id": doc_id, "title": job.title, "language": job.language, "nodes": list(flatten(nodes)), "loss": loss, "preserved": job.preserved, "assets": job.assets, "annotations": job.annotations,
        "theme": json.dumps(job.theme) if job.theme else None,
    }


#: Nodes that a task gives back at a time, a thousand bytes of payloads counting as one, and documents that it takes as objects at a time.
NODES_AT_ONCE, DOCUMENTS_AT_ONCE = 5_000, 16


def framed(rows: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """Rows of gathered() as frames of bounded size: as objects, the nodes of a whole Arrow batch of documents would take gigabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 1 + len(r["nodes"]) + sum(len(x["bytes"] or b"") for k in ("preserved", "assets") for x in r[k]) // 1000
        if size >= NODES_AT_ONCE:
            yield pd.DataFrame(held, columns=COLUMNS)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=COLUMNS)


def imported(table: DataFrame, fmt: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of table; null text is an empty document."""
    reader = READERS[fmt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from framed(gathered(i, *reader(t)) for i, t in zip(batch["doc_id"], batch["text"], strict=True))

    return spread(table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInPandas(run, SCHEMA)


def nodes_of(docs: DataFrame) -> DataFrame:
    """The node table of imported documents."""
    return docs.select("doc_id", F.inline("nodes"))


def loss_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline("loss"))


def assets_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline("assets"))


def preserved_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline("preserved"))


def annotations_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline("annotations"))


def _document(r: dict) -> Document:
    kept = {p["path"]: p["bytes"] for p in r.get("preserved") or []}
    return Document(unflatten(r["nodes"] or []), r.get("assets") or [], kept, r.get("title"), r.get("language"))


def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of Arrow batches as objects, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
            yield batch.slice(at, DOCUMENTS_AT_ONCE).to_pylist()


def _over(docs: DataFrame, made: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """The rows that made() gives for each imported document, of which portions() holds few at a time."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in portions(batches):
            rows = [dict(zip(fields.names, row, strict=True)) for r in few for row in made(r)]
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return docs.mapInArrow(run, schema)


def plain_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, node_id, type, depth and text of all blocks of imported documents: cells by tabs, items and blocks by line ends."""

    def made(r: dict) -> list[tuple]:
        return [(r["doc_id"], n.get("node_id"), n["type"], depth, plain_block(n)) for depth, n in _blocks(_document(r).nodes, 0)]

    return _over(docs.select("doc_id", "nodes"), made, "doc_id long, node_id string, type string, depth int, text string")


def _blocks(nodes: list[dict], depth: int) -> Iterator[tuple[int, dict]]:
    for n in nodes:
        if n["type"] not in STRUCTS:
            yield depth, n
        for slot in ("children", "items", "rows", "cells"):
            # headings stand in sections of their own making, which add no depth
            yield from _blocks(n.get(slot) or [], depth if n["type"] == "section" else depth + 1)


def pasted(table: DataFrame, mode: str = "keep", doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """doc_id, html and counts of what went (dropped, unwrapped, attributes) of pasted content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sanitize_paste(t or "", mode) for t in batch["html"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: [m[c] for m in made] for c in ("html", "dropped", "unwrapped", "attributes")}})

    given = table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html"))
    return given.mapInPandas(run, "doc_id long, html string, dropped int, unwrapped int, attributes int")


EXPORTED = "doc_id long, format string, output string, n_lost int"


def exported(docs: DataFrame, fmt: str, **options) -> DataFrame:
    """doc_id, format, output and n_lost (losses that are not none) of imported documents."""

    def made(r: dict) -> list[tuple]:
        output, job = render(_document(r), fmt, **options)
        return [(r["doc_id"], fmt, output, sum(e["loss_class"] != "none" for e in job.loss))]

    return _over(docs.select("doc_id", "title", "language", "nodes", "preserved", "assets"), made, EXPORTED)


WRITTEN = "doc_id long, output string"


def written(docs: DataFrame, fmt: str) -> DataFrame:
    """doc_id and output of imported documents as JSON for another program: an editor document or a pandoc tree."""
    write = {"editor": lambda nodes, title: json.dumps(editor.to_editor(nodes), ensure_ascii=False), "pandoc": write_pandoc}[fmt]

    return _over(docs.select("doc_id", "title", "nodes"), lambda r: [(r["doc_id"], write(_document(r).nodes, r["title"]))], WRITTEN)


CONVERTED = f"{EXPORTED}, n_unread int"


def convert(table: DataFrame, source: str, target: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Import and export in one Python step: a tree never leaves it, and few documents are held at a time.

    n_lost counts the losses of both ways, n_unread those of the import among them; options are those of the export.
    """
    reader = READERS[source]
    small_batches(table.sparkSession)

    def made(r: dict) -> list[tuple]:
        nodes, job = reader(r["text"])
        doc = Document(nodes, job.assets, {p["path"]: p["bytes"] for p in job.preserved}, job.title, job.language)
        output, lost = render(doc, target, **options)
        unread, unshown = (sum(e["loss_class"] != "none" for e in j.loss) for j in (job, lost))
        return [(r["doc_id"], target, output, unread + unshown, unread)]

    return _over(spread(table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), made, CONVERTED)


def render_nodes(nodes: DataFrame, fmt: str) -> DataFrame:
    """Export of a node table that stands by itself: one exchange by doc_id, one document to a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        output, job = render(Document(unflatten(pdf.astype(object).where(pdf.notna(), None).to_dict("records"))), fmt)
        return pd.DataFrame([(pdf["doc_id"].iloc[0], fmt, output, sum(e["loss_class"] != "none" for e in job.loss))], columns=["doc_id", "format", "output", "n_lost"])

    return nodes.groupBy("doc_id").applyInPandas(run, EXPORTED)
