"""Word-processing packages as tables: their parts as rows, lookups between them as joins, and packages written from texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.sources.docx import Package, Styles, attr, child, local, resolve
from parchment.sources.importers import NODES_AT_ONCE, portions
from parchment.store import growing, spread

#: The namespaces of word-processing packages.
NAMESPACES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
}
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"


def part(root: str, inner: Column) -> Column:
    """A part whose root element is w:root."""
    declared = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:{root}{declared}>'), inner, F.lit(f"</w:{root}>"))


def document(body: Column) -> Column:
    return part("document", F.concat(F.lit("<w:body>"), body, F.lit("</w:body>")))


def zipped(table: DataFrame, parts: dict[str, Column], doc_id: str = "doc_id") -> DataFrame:
    """doc_id and content: a package for each row, its parts given by name; a null part is left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("binary").alias("bytes")) for n, c in parts.items()])
    given = table.select(F.col(doc_id).cast("long").alias("doc_id"), F.filter(entries, lambda e: e["bytes"].isNotNull()).alias("entries"))

    def pack(entries: list[dict]) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for e in entries:
                z.writestr(zipfile.ZipInfo(e["name"]), e["bytes"])
        return held.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pack(r["entries"]) for few in portions([batch]) for r in few]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary())], ["doc_id", "content"])

    return spread(given).mapInArrow(run, "doc_id long, content binary")


PARTS = (
    "doc_id long, names array<string>, rels array<struct<part: string, id: string, type: string, target: string, external: boolean>>, "
    "overrides array<struct<part: string, content_type: string>>, defaults array<struct<extension: string, content_type: string>>, "
    "levels array<struct<abstract_id: string, ilvl: int, fmt: string, start: int>>, numbers array<struct<num_id: string, abstract_id: string>>, "
    "styles array<struct<style: string, name: string, kind: string, based_on: string, bold: boolean, font: string, size: double>>, "
    "comments array<struct<id: string, author: string, text: string>>, notes array<struct<kind: string, id: string, text: string>>, "
    "core array<struct<name: string, value: string>>, paragraphs array<struct<ord: int, style: string, num_id: string, ilvl: int, comment: string>>, "
    "tracked array<struct<author: string, kind: string>>, error string"
)
_COLUMNS = "doc_id names rels overrides defaults levels numbers styles comments notes core paragraphs tracked error".split()


def _text(e) -> str:
    return "".join(x.text or "" for x in e.iter() if local(x.tag) == "t")


def _each(root, name: str):
    return [e for e in (root if root is not None else []) if local(e.tag) == name]


def read_parts(data: bytes) -> dict:
    """The lookups of a package, part by part; only sizes, names and these parts are read."""
    p = Package(data)
    types, numbering = p.xml("[Content_Types].xml"), p.xml("word/numbering.xml")
    body = child(p.xml("word/document.xml"), "body")
    paragraphs = [e for e in (body.iter() if body is not None else []) if local(e.tag) == "p"]
    core = p.xml("docProps/core.xml")
    return {
        "names": p.names,
        "rels": [{"part": "word/document.xml", "id": i, **r} for i, r in p.rels("word/document.xml").items()],
        "overrides": [{"part": (e.get("PartName") or "").lstrip("/"), "content_type": e.get("ContentType")} for e in _each(types, "Override")],
        "defaults": [{"extension": (e.get("Extension") or "").lower(), "content_type": e.get("ContentType")} for e in _each(types, "Default")],
        "levels": [
            {"abstract_id": attr(a, "abstractNumId"), "ilvl": int(attr(x, "ilvl", "0")), "fmt": attr(child(x, "numFmt"), "val", "decimal"), "start": int(attr(child(x, "start"), "val", "1"))}
            for a in _each(numbering, "abstractNum") for x in _each(a, "lvl")
        ],
        "numbers": [{"num_id": attr(n, "numId"), "abstract_id": attr(child(n, "abstractNumId"), "val")} for n in _each(numbering, "num")],
        "styles": [
            {"style": i, "name": v["name"], "kind": v["kind"], "based_on": v["based_on"], "bold": v["flags"].get("b", False), "font": v["font"], "size": float(v["size"]) / 2 if v["size"] else None}
            for i, v in Styles(p.xml("word/styles.xml")).by_id.items()
        ],
        "comments": [{"id": attr(c, "id"), "author": attr(c, "author") or "unknown", "text": "\n".join(_text(x) for x in c)} for c in _each(p.xml("word/comments.xml"), "comment")],
        "notes": [
            {"kind": kind, "id": attr(n, "id"), "text": "\n".join(_text(x) for x in n)}
            for kind in ("footnote", "endnote") for n in _each(p.xml(f"word/{kind}s.xml"), kind) if attr(n, "id") not in ("0", "-1")
        ],
        "core": [{"name": local(e.tag), "value": e.text} for e in (core if core is not None else []) if e.text],
        "paragraphs": [
            {
                "ord": i, "style": attr(child(e, "pPr", "pStyle"), "val"), "num_id": attr(child(e, "pPr", "numPr", "numId"), "val"),
                "ilvl": int(attr(child(e, "pPr", "numPr", "ilvl"), "val", "0")) if child(e, "pPr", "numPr") is not None else None,
                "comment": next((attr(x, "id") for x in e.iter() if local(x.tag) == "commentRangeStart"), None),
            }
            for i, e in enumerate(paragraphs)
        ],
        "tracked": [{"author": attr(x, "author") or "unknown", "kind": "ins" if local(x.tag) in ("ins", "moveTo") else "del"} for e in paragraphs for x in e.iter() if local(x.tag) in ("ins", "moveTo", "del", "moveFrom")],
        "error": None,
    }


def parts_of(files: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """One row for each package with its lookups as arrays; a package that cannot be read has an error and nothing else."""

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLUMNS})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from parchment.sources.docx import UNREADABLE

        for batch in batches:
            rows, size = [], 0
            for i, data in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows.append({"doc_id": i, **read_parts(bytes(data or b""))})
                except UNREADABLE as e:
                    rows.append({"doc_id": i, "error": str(e)[:200] or type(e).__name__})
                size += 1 + sum(len(x) for x in rows[-1].values() if isinstance(x, list))
                if size >= NODES_AT_ONCE:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    return spread(files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("content"))).mapInPandas(run, PARTS)


def rows(packages: DataFrame, column: str) -> DataFrame:
    """An array of parts_of() as rows with doc_id."""
    return packages.select("doc_id", F.inline(column))


def content_types(packages: DataFrame) -> DataFrame:
    """doc_id, part, content_type: an override goes before the default of the extension; a part with neither has none."""
    names = packages.select("doc_id", F.explode("names").alias("part")).withColumn("extension", F.lower(F.regexp_extract("part", r"\.([^./]*)$", 1)))
    own = rows(packages, "overrides").withColumnRenamed("content_type", "_own")
    default = rows(packages, "defaults").withColumnRenamed("content_type", "_default")
    return names.join(growing(own), ["doc_id", "part"], "left").join(growing(default), ["doc_id", "extension"], "left").select("doc_id", "part", F.coalesce("_own", "_default").alias("content_type"))


def numbering(packages: DataFrame) -> DataFrame:
    """doc_id, num_id, abstract_id, ilvl, fmt, start: the levels of every number, through its abstract definition."""
    return rows(packages, "numbers").join(growing(rows(packages, "levels")), ["doc_id", "abstract_id"])


def numbered_paragraphs(packages: DataFrame) -> DataFrame:
    """doc_id, ord, num_id, ilvl, fmt, start of paragraphs with a number; a level that is not defined leaves fmt and start null."""
    given = rows(packages, "paragraphs").where("num_id is not null").select("doc_id", "ord", "num_id", "ilvl")
    return given.join(growing(numbering(packages).drop("abstract_id")), ["doc_id", "num_id", "ilvl"], "left")


def commented_paragraphs(packages: DataFrame) -> DataFrame:
    """doc_id, ord, comment, author, text of paragraphs in which a comment begins; one that is not defined leaves author and text null."""
    given = rows(packages, "paragraphs").where("comment is not null").select("doc_id", "ord", "comment")
    return given.join(growing(rows(packages, "comments").withColumnRenamed("id", "comment")), ["doc_id", "comment"], "left")


def targets(packages: DataFrame) -> DataFrame:
    """doc_id, id, type, target, external and part, the part that an internal relationship leads to (null if the package lacks it)."""
    resolved = F.udf(lambda base, target: resolve(base, target) if target else None, "string")  # few rows, one for each relationship
    rels = rows(packages, "rels").withColumn("part", F.when(~F.col("external"), resolved("part", "target")))
    names = packages.select("doc_id", F.explode("names").alias("part"), F.lit(True).alias("_held"))
    return rels.join(growing(names), ["doc_id", "part"], "left").select("doc_id", "id", "type", "target", "external", F.when(F.col("_held"), F.col("part")).alias("part"))


def theme(packages: DataFrame) -> DataFrame:
    """doc_id, style, uses, name, bold, font, size: the styles that paragraphs use, with effective values along based_on.

    Chains end after 16 steps, which is the reader's limit, or where a style is not defined.
    """
    styles = rows(packages, "styles")
    used = rows(packages, "paragraphs").where("style is not null").groupBy("doc_id", "style").agg(F.count("*").alias("uses"))
    at = used.join(growing(styles.select("doc_id", "style", "name")), ["doc_id", "style"]).select("doc_id", "style", "uses", "name", F.col("style").alias("_at"))
    table = packages.select("doc_id", F.map_from_entries(F.transform("styles", lambda x: F.struct(x["style"], x))).alias("_styles"))
    # a package's styles ride along as one map, so the chain is followed within the row
    chain = F.aggregate(
        F.sequence(F.lit(1), F.lit(16)),
        F.struct(F.col("_at").alias("at"), F.lit(False).alias("bold"), F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size")),
        lambda c, _: F.struct(
            F.try_element_at("_styles", c["at"])["based_on"].alias("at"), (c["bold"] | F.coalesce(F.try_element_at("_styles", c["at"])["bold"], F.lit(False))).alias("bold"),
            F.coalesce(c["font"], F.try_element_at("_styles", c["at"])["font"]).alias("font"), F.coalesce(c["size"], F.try_element_at("_styles", c["at"])["size"]).alias("size"),
        ),
    )
    return at.join(growing(table), "doc_id").select("doc_id", "style", "uses", "name", chain.alias("c")).select("doc_id", "style", "uses", "name", "c.bold", "c.font", "c.size")


def theme_json(found: DataFrame) -> DataFrame:
    """doc_id and theme: theme() as one JSON object for each document, its styles in order of id."""
    entry = F.struct("style", "name", "uses", "bold", "font", "size")
    return found.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("styles"))).alias("theme"))


def tracked_counts(packages: DataFrame) -> DataFrame:
    """doc_id, author, inserted, deleted."""
    kind = F.col("kind")
    return rows(packages, "tracked").groupBy("doc_id", "author").agg(F.count_if(kind == "ins").alias("inserted"), F.count_if(kind == "del").alias("deleted"))


def reserved_numbers(preserved: DataFrame) -> DataFrame:
    """preserved payloads with n, one running number for each document in order of origin and place."""
    return preserved.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("origin", "seq")) - 1)
