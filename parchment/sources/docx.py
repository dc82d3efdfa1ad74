"""Native OOXML reader: parts of a word-processing package to the node table.

Styles, numbering, comments and notes are read first, then the body. Small losses are counted by feature, with up to three
samples, and reported once each in feature order.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions.assets import guess_mime
from parchment.sources.importers import SCHEMA, framed, gathered
from parchment.sources.pandoc import read_pandoc
from parchment.store import spread
from parchment.tree import Job, merged, normalised, plain_block, plain_span, text_span, wrapped

MOST_PARTS, LARGEST_PART, LARGEST_TOTAL = 10_000, 256 << 20, 1 << 30
STYLE_HOPS = 16
ON = ("b", "i", "strike", "u")
MARK_OF = {"b": "strong", "i": "em", "u": "underline", "strike": "strike"}


class Part(Exception):
    """A part is missing, too large or not XML."""


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return default if e is None else next((v for k, v in e.attrib.items() if local(k) == name), default)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = None if e is None else next((c for c in e if local(c.tag) == name), None)
    return e


def parse_xml(data: bytes) -> ET.Element:
    """Refuses document type declarations, so no entity can expand."""
    if b"<!DOCTYPE" in data[:4096]:
        raise Part("document type declaration")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        # some writers leave prefixes undeclared
        names = set(re.findall(rb"[<\s/]([A-Za-z][\w-]*):[\w-]+", data)) - {b"xml", b"xmlns"}
        missing = [n for n in sorted(names) if b"xmlns:" + n not in data]
        if not missing:
            raise Part(str(e)) from e
        declared = b"".join(b' xmlns:%s="urn:%s"' % (n, n) for n in missing)
        try:
            return ET.fromstring(re.sub(rb"(<[A-Za-z][\w:-]*)", rb"\1" + declared, data.split(b"?>", 1)[-1], count=1))
        except ET.ParseError as again:
            raise Part(str(again)) from again


class Package:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        infos = self.zip.infolist()
        if len(infos) > MOST_PARTS or any(i.file_size > LARGEST_PART for i in infos) or sum(i.file_size for i in infos) > LARGEST_TOTAL:
            raise Part("package is too large")
        if any(i.flag_bits & 1 for i in infos):
            raise Part("package is encrypted")
        self.names = [i.filename for i in infos]

    def xml(self, name: str) -> ET.Element | None:
        return parse_xml(self.zip.read(name)) if name in self.names else None

    def rels(self, part: str) -> dict[str, dict]:
        """Relationships of a part by id."""
        root = self.xml(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
        return {
            r.get("Id"): {"type": (r.get("Type") or "").rsplit("/", 1)[-1], "target": r.get("Target"), "external": r.get("TargetMode") == "External"}
            for r in (root if root is not None else [])
        }

    def content_type(self, part: str) -> str | None:
        """An override goes before the default of the extension."""
        root = self.xml("[Content_Types].xml")
        found = {local(e.tag) + ":" + (e.get("PartName") or e.get("Extension") or "").lower(): e.get("ContentType") for e in (root if root is not None else [])}
        return found.get("Override:/" + part.lower()) or found.get("Default:" + part.rsplit(".", 1)[-1].lower())


def resolve(base: str, target: str) -> str:
    """A part name from a relationship target."""
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(base), target))


def flags(properties: ET.Element | None) -> dict[str, bool]:
    found = {}
    for name in ON:
        e = child(properties, name)
        if e is not None:
            found[name] = attr(e, "val", "true") not in ("false", "0", "none")
    return found


class Styles:
    def __init__(self, root: ET.Element | None) -> None:
        self.by_id = {}
        for s in root if root is not None else []:
            if local(s.tag) == "style":
                self.by_id[attr(s, "styleId")] = {
                    "name": attr(child(s, "name"), "val"), "kind": attr(s, "type"), "based_on": attr(child(s, "basedOn"), "val"), "flags": flags(child(s, "rPr")),
                    "font": attr(child(s, "rPr", "rFonts"), "ascii"), "size": attr(child(s, "rPr", "sz"), "val"), "outline": attr(child(s, "pPr", "outlineLvl"), "val"),
                }

    def effective(self, style: str | None) -> dict:
        """Along basedOn, up to 16 hops: a flag set anywhere counts, font and size are the nearest given."""
        out, hops = {"flags": {}, "font": None, "size": None}, 0
        while style in self.by_id and hops < STYLE_HOPS:
            s = self.by_id[style]
            out["flags"] |= {k: True for k, v in s["flags"].items() if v}
            out["font"], out["size"] = out["font"] or s["font"], out["size"] or s["size"]
            style, hops = s["based_on"], hops + 1
        return out

    def heading_level(self, style: str | None) -> int | None:
        """From the outline level, else the name, else the id."""
        s = self.by_id.get(style)
        if s and (s["outline"] or "").isdigit() and int(s["outline"]) <= 5:
            return int(s["outline"]) + 1
        for text in ((s or {}).get("name"), style):
            m = re.fullmatch(r"heading ?([1-6])", text or "", re.I)
            if m:
                return int(m[1])
        return None


class Reader:
    def __init__(self, data: bytes, job: Job) -> None:
        self.job, self.package = job, Package(data)
        self.part = "word/document.xml"
        self.rels = self.package.rels(self.part)
        self.styles = Styles(self.package.xml("word/styles.xml"))
        numbering = self.package.xml("word/numbering.xml")
        levels = {
            attr(a, "abstractNumId"): {attr(x, "ilvl"): (attr(child(x, "numFmt"), "val", "decimal"), int(attr(child(x, "start"), "val", "1"))) for x in a if local(x.tag) == "lvl"}
            for a in (numbering if numbering is not None else []) if local(a.tag) == "abstractNum"
        }
        self.numbers = {attr(n, "numId"): levels.get(attr(child(n, "abstractNumId"), "val"), {}) for n in (numbering if numbering is not None else []) if local(n.tag) == "num"}
        self.notes = {kind: self._notes(kind) for kind in ("footnote", "endnote")}
        comments = self.package.xml("word/comments.xml")
        self.comments = {attr(c, "id"): {"author": attr(c, "author") or "unknown", "text": "\n".join(_text(p) for p in c)} for c in (comments if comments is not None else [])}
        self.defined: dict[str, str] = {}
        self.definitions: list[dict] = []
        self.counted: Counter = Counter()
        self.samples: dict[str, list[str]] = {}
        self.kinds: dict[str, tuple[str, str]] = {}
        self.authors: dict[str, Counter] = {}
        self.page: dict[str, float] = {}
        self.open_comments: dict[str, tuple[str, int, str]] = {}
        self.commented: set[str] = set()

    def _notes(self, kind: str) -> dict[str, ET.Element]:
        root = self.package.xml(f"word/{kind}s.xml")
        return {attr(n, "id"): n for n in (root if root is not None else []) if local(n.tag) == kind and attr(n, "id") not in ("0", "-1")}

    def count(self, feature: str, loss_class: str, action: str, sample: str = "") -> None:
        self.counted[feature] += 1
        self.kinds[feature] = (loss_class, action)
        held = self.samples.setdefault(feature, [])
        if sample and sample not in held and len(held) < 3:
            held.append(sample)

    def read(self) -> list[dict]:
        root = self.package.xml(self.part)
        body = child(root, "body")
        if body is None:
            raise Part("no body")
        core = self.package.xml("docProps/core.xml")
        for e in core if core is not None else []:
            if local(e.tag) in ("title", "language"):
                setattr(self.job, local(e.tag), e.text)
            elif e.text:
                self.job.extra[local(e.tag)] = e.text
        self.side_parts()
        out = self.blocks(body)
        for i, (block, _, _) in list(self.open_comments.items()):  # ranges that never end
            self._comment(i, block)
        for i in self.comments:
            if i not in self.commented:
                self.count("docx_comment", "partial", "dropped", i)
        if self.authors:
            ref = self.job.keep("docx", "xml", self.package.zip.read(self.part))
            detail = "; ".join(f"{a}: +{c['ins']} -{c['del']}" for a, c in sorted(self.authors.items()))
            self.job.lose("partial", "docx_tracked_changes", "degraded", detail, f"final view taken; original kept at {ref}")
        for feature in sorted(self.counted):
            loss_class, action = self.kinds[feature]
            self.job.lose(loss_class, feature, action, "; ".join(self.samples.get(feature, [])), f"{self.counted[feature]} times")
        return out + self.definitions

    def side_parts(self) -> None:
        quarantined = re.compile(r"word/(embeddings|activeX)/|vbaProject")
        known = re.compile(r"word/(document|styles|numbering|comments|footnotes|endnotes|settings|fontTable|webSettings)\.xml$|word/theme/|word/media/|_rels/|docProps/|\[Content_Types\]")
        for name in self.package.names:
            if name.endswith("/") or known.search(name):
                continue
            if re.match(r"word/header\d*\.xml$", name):
                feature, action = "docx_headers", "preserved"
            elif re.match(r"word/footer\d*\.xml$", name):
                feature, action = "docx_footers", "preserved"
            elif quarantined.search(name):
                feature, action = ("docx_ole_object" if "embeddings" in name else "docx_macro"), "preserved_quarantined"
            elif name.startswith("customXml/"):
                feature, action = "docx_custom_xml", "preserved"
            elif re.match(r"word/[^/]+\.xml$", name):
                feature, action = "docx_unknown_part", "preserved"
            else:
                continue
            ref = self.job.keep("docx", name.rsplit(".", 1)[-1], self.package.zip.read(name))
            self.job.lose("preserved_raw", feature, action, ref, f"{name} kept as it was")

    # blocks

    def blocks(self, parent: ET.Element) -> list[dict]:
        out: list[dict] = []
        lists: list[tuple[str, int, dict]] = []
        for e in parent:
            kind = local(e.tag)
            if kind == "p":
                made, number = self.paragraph(e)
                if number and made:
                    self._into_list(out, lists, number, made)
                    continue
                lists.clear()
                out.extend(made)
            elif kind == "tbl":
                lists.clear()
                out.append(self.table(e))
            elif kind == "sectPr":
                self.section(e)
            elif kind in ("sdt",):
                self.count("docx_sdt", "partial", "degraded", "sdt")
                out.extend(self.blocks(child(e, "sdtContent") if child(e, "sdtContent") is not None else ET.Element("x")))
            elif kind == "bookmarkStart":
                self.count("docx_bookmark", "partial", "dropped", attr(e, "name") or "")
            elif kind == "oMathPara":
                out.append(self.formula(e, True))
        return out

    def _into_list(self, out: list[dict], lists: list, number: tuple[str, int], made: list[dict]) -> None:
        """A list goes on with the same numbering; a deeper level nests under the last item."""
        num, level = number
        while lists and (lists[-1][0] != num or lists[-1][1] > level):
            lists.pop()
        if not lists or lists[-1][1] < level:
            fmt, start = self.numbers.get(num, {}).get(str(level), ("decimal", 1))
            self.job.lose("none", "list", "mapped")
            node = {"type": "list", "node_id": self.job.uid("blk"), "style": "bullet" if fmt in ("bullet", "none") else "ordered", "items": []}
            if node["style"] == "ordered" and start != 1:
                node["start"] = start
            (lists[-1][2]["items"][-1]["children"] if lists else out).append(node)
            lists.append((num, level, node))
        lists[-1][2]["items"].append({"type": "item", "node_id": self.job.uid("li"), "children": made})

    def section(self, e: ET.Element) -> None:
        points = lambda v: int(v or 1440) / 20
        size, margin = child(e, "pgSz"), child(e, "pgMar")
        self.page = {"width": points(attr(size, "w")), "height": points(attr(size, "h"))} | {k: points(attr(margin, k)) for k in ("top", "right", "bottom", "left")}

    def paragraph(self, p: ET.Element) -> tuple[list[dict], tuple[str, int] | None]:
        properties = child(p, "pPr")
        style = attr(child(properties, "pStyle"), "val")
        num = attr(child(properties, "numPr", "numId"), "val")
        level = int(attr(child(properties, "numPr", "ilvl"), "val", "0"))
        for e in properties if properties is not None else []:
            if local(e.tag) == "sectPr":
                self.section(e)
            elif local(e.tag) not in ("pStyle", "numPr", "rPr"):
                self.count("docx_paragraph_props", "partial", "dropped", local(e.tag))
        content = [s for c in p if local(c.tag) != "pPr" for s in self.inline(c)]
        marks: list[tuple[str, bool, int]] = []
        content = merged(self._unmarked(content, marks, [0]))
        blocks = [s.pop("block") for s in content if "block" in s]
        content = [s for s in content if s.get("type")]
        self.job.lose("none", "paragraph", "mapped")
        solid = [s for s in content if s["type"] != "text" or s["text"].strip()]
        if not solid:
            return blocks, None
        outline = self.styles.heading_level(style)
        if outline:
            node = {"type": "heading", "node_id": self.job.uid("blk"), "level": outline, "content": content}
        elif len(solid) == 1 and solid[0]["type"] == "inline_image":
            node = {"type": "figure", "node_id": self.job.uid("blk"), "asset": solid[0]["asset"], "alt": solid[0]["alt"], "caption": []}
        else:
            node = {"type": "paragraph", "node_id": self.job.uid("blk"), "content": content}
        if style and not outline:
            node["style"] = (self.styles.by_id.get(style) or {}).get("name") or style
        self._annotate(node, marks)
        return [node, *blocks], None if num in (None, "0") or outline else (num, level)

    def _unmarked(self, content: list[dict], marks: list[tuple[str, bool, int]], at: list[int]) -> list[dict]:
        """Spans without the marks of comment ranges, which are noted with the length of the text before them."""
        out = []
        for s in content:
            if "mark" in s:
                marks.append((*s["mark"], at[0]))
                continue
            if "content" in s:
                s = {**s, "content": self._unmarked(s["content"], marks, at)}
            elif s.get("type"):
                at[0] += len(plain_span(s))
            out.append(s)
        return out

    def _annotate(self, node: dict, marks: list[tuple[str, bool, int]]) -> None:
        """A range inside one block quotes its text; one over several blocks stands for the block that it begins in."""
        text = plain_block(node)
        for i, begins, place in marks:
            if begins:
                self.open_comments[i] = (node["node_id"], place, text)
            elif i in self.open_comments:
                block, start, whole = self.open_comments.pop(i)
                quoted = (whole[start:place], whole[max(0, start - 32) : start], whole[place : place + 32]) if block == node["node_id"] else (None, None, None)
                self._comment(i, block, *quoted)

    def _comment(self, i: str, block: str | None, exact: str | None = None, prefix: str | None = None, suffix: str | None = None) -> None:
        found = self.comments.get(i, {"author": "unknown", "text": ""})
        self.job.annotations.append(
            {
                "ord": len(self.job.annotations), "annotation_id": self.job.uid("ann"), "type": "comment", "target_kind": "text_quote" if exact else "block", "target_block": block,
                "exact": exact or None, "prefix": prefix, "suffix": suffix, "value": found["text"], "author": found["author"],
            }
        )
        self.commented.add(i)

    def table(self, e: ET.Element) -> dict:
        self.job.lose("none", "table", "mapped")
        widths = [attr(g, "w") for g in (child(e, "tblGrid") if child(e, "tblGrid") is not None else [])]
        rows, header, open_cells = [], False, {}
        for tr in (x for x in e if local(x.tag) == "tr"):
            row, col = {"type": "row", "node_id": self.job.uid("row"), "cells": []}, 0
            top = child(tr, "trPr", "tblHeader") is not None and attr(child(tr, "trPr", "tblHeader"), "val", "true") not in ("false", "0")
            header = header or (top and not rows)
            for tc in (x for x in tr if local(x.tag) == "tc"):
                across = max(1, int(attr(child(tc, "tcPr", "gridSpan"), "val", "1")))
                merge = child(tc, "tcPr", "vMerge")
                if merge is not None and attr(merge, "val", "continue") == "continue" and col in open_cells:
                    open_cells[col]["row_span"] = open_cells[col].get("row_span", 1) + 1
                else:
                    cell = {"type": "cell", "node_id": self.job.uid("cel"), "col": col, "children": self.blocks(tc)}
                    cell |= ({"col_span": across} if across > 1 else {}) | ({"role": "header"} if top else {})
                    row["cells"].append(cell)
                    open_cells.pop(col, None)
                    if merge is not None:
                        open_cells[col] = cell
                col += across
            rows.append(row)
        names = [" ".join(plain_block(b) for b in c["children"]) for c in rows[0]["cells"]] if rows and header else []
        total = sum(int(w or 0) for w in widths)
        columns = [
            {"type": "column", "node_id": self.job.uid("col"), "title": names[i] if i < len(names) else None} | ({"extra": {"width": round(int(w) / total, 3)}} if total and w else {})
            for i, w in enumerate(widths)
        ]
        return {"type": "table", "node_id": self.job.uid("blk"), "header_row": header, "columns": columns, "rows": rows}

    # spans

    def inlines(self, e: ET.Element | None) -> list[dict]:
        return [s for c in (e if e is not None else []) for s in self.inline(c)]

    def inline(self, e: ET.Element) -> list[dict]:
        kind = local(e.tag)
        if kind == "r":
            return self.run(e)
        if kind == "hyperlink":
            content, target = merged(self.inlines(e)), self.rels.get(attr(e, "id"))
            if target:
                return [{"type": "link", "url": target["target"], "content": content}]
            if attr(e, "anchor"):
                self.count("docx_internal_link", "partial", "degraded", attr(e, "anchor"))
                return [{"type": "link", "url": "#" + attr(e, "anchor"), "content": content}]
            return content
        if kind in ("ins", "moveTo", "del", "moveFrom"):
            inserted = kind in ("ins", "moveTo")
            self.authors.setdefault(attr(e, "author") or "unknown", Counter())["ins" if inserted else "del"] += 1
            return self.inlines(e) if inserted else []
        if kind == "oMath":
            return [self.formula(e, False)]
        if kind == "oMathPara":
            return [{"type": None, "block": self.formula(e, True)}]
        if kind == "sdt":
            self.count("docx_sdt", "partial", "degraded", "sdt")
            return self.inlines(child(e, "sdtContent"))
        if kind == "AlternateContent":
            return self.inlines(child(e, "Fallback") if child(e, "Fallback") is not None else child(e, "Choice"))
        if kind == "fldSimple":
            self.count("docx_field", "partial", "degraded", (attr(e, "instr") or "").strip())
            return self.inlines(e)
        if kind == "bookmarkStart":
            self.count("docx_bookmark", "partial", "dropped", attr(e, "name") or "")
            return []
        if kind in ("commentRangeStart", "commentRangeEnd"):
            return [{"type": None, "mark": (attr(e, "id"), kind == "commentRangeStart")}]
        if kind in ("bookmarkEnd", "proofErr", "pPr", "rPr"):
            return []
        return self.inlines(e)

    def run(self, e: ET.Element) -> list[dict]:
        properties = child(e, "rPr")
        on = self.styles.effective(attr(child(properties, "rStyle"), "val"))["flags"] | flags(properties)
        for p in properties if properties is not None else []:
            if local(p.tag) not in (*ON, "rStyle", "bCs", "iCs", "lang", "noProof"):
                self.count("docx_run_props", "partial", "dropped", local(p.tag))
        content = merged(s for c in e if local(c.tag) != "rPr" for s in self.piece(c))
        for name in ("b", "i", "u", "strike"):
            if on.get(name) and content:
                content = [{"type": MARK_OF[name], "content": content}]
        return content

    def piece(self, c: ET.Element) -> list[dict]:
        kind = local(c.tag)
        if kind == "t":
            return [text_span(c.text or "")]
        if kind == "tab":
            self.count("docx_tab", "partial", "degraded", "tab")
            return [text_span(" ")]
        if kind == "cr":
            return [{"type": "hard_break"}]
        if kind == "br":
            if attr(c, "type") in ("page", "column"):
                self.count("docx_page_break", "partial", "degraded", attr(c, "type"))
                return [{"type": None, "block": {"type": "page_break", "node_id": self.job.uid("blk")}}]
            return [{"type": "hard_break"}]
        if kind in ("drawing", "pict"):
            ref = next((attr(x, "embed") or attr(x, "link") or attr(x, "id") for x in c.iter() if local(x.tag) in ("blip", "imagedata")), None)
            alt = next((attr(x, "descr") or attr(x, "name") or "" for x in c.iter() if local(x.tag) == "docPr"), "")
            if ref in self.rels:
                return [{"type": "inline_image", "asset": self.media(self.rels[ref]), "alt": alt}]
            return [self.kept(c, f"docx_{kind}")]
        if kind == "object":
            return [self.kept(c, "docx_ole_object")]
        if kind in ("footnoteReference", "endnoteReference"):
            return self.note(kind.removesuffix("Reference"), attr(c, "id"))
        if kind in ("instrText", "fldChar"):
            if kind == "instrText":
                self.count("docx_field", "partial", "degraded", (c.text or "").strip())
            return []
        return []

    def kept(self, e: ET.Element, feature: str) -> dict:
        ref = self.job.keep("docx", "xml", ET.tostring(e))
        self.job.lose("preserved_raw", feature, "preserved", ref, f"{local(e.tag)} kept as it was")
        return self.job.unknown("docx", local(e.tag), ref)

    def media(self, rel: dict) -> str:
        name = rel["target"].rsplit("/", 1)[-1]
        if rel["external"]:
            return self.job.asset(name, guess_mime(name), url=rel["target"])
        part = resolve(self.part, rel["target"])
        return self.job.asset(name, guess_mime(name), self.package.zip.read(part) if part in self.package.names else b"")

    def note(self, kind: str, i: str) -> list[dict]:
        """A note is defined at its first reference; foot- and endnotes have ids of their own."""
        body, key = self.notes[kind].get(i), f"{kind}:{i}"
        if body is None:
            return []
        if key not in self.defined:
            self.defined[key] = self.job.uid("blk")
            if kind == "endnote":
                self.count("docx_endnotes", "partial", "degraded", i)
            self.definitions.append({"type": "footnote", "node_id": self.defined[key], "children": self.blocks(body)})
        return [{"type": "footnote_ref", "target_ref": self.defined[key]}]

    def formula(self, e: ET.Element, display: bool) -> dict:
        ref = self.job.keep("docx", "xml", ET.tostring(e))
        self.count("docx_omml", "degraded", "degraded", ref)
        text = _text(e)
        return {"type": "math_block" if display else "inline_math", "latex": text, "payload_ref": ref} | ({"node_id": self.job.uid("blk")} if display else {})


def _text(e: ET.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if local(x.tag) == "t")


def read_docx(data: bytes) -> tuple[list[dict], Job]:
    """The tree of a package, with sections from its headings, and what its import gathered."""
    job = Job()
    reader = Reader(data, job)
    nodes = reader.read()
    notes = [n for n in nodes if n["type"] == "footnote"]
    out = normalised(wrapped([n for n in nodes if n["type"] != "footnote"], job) + notes)
    job.theme = {"page": reader.page} if reader.page else None
    return out, job


UNREADABLE = (Part, zipfile.BadZipFile, KeyError, ValueError)


def read_any(data: bytes, tree: str | None, reader: str) -> tuple[list[dict], Job]:
    """A package by the native reader, or by pandoc's JSON tree of it; auto takes the tree only where the native reader fails, and says so."""
    if reader != "pandoc":
        try:
            return read_docx(data)
        except UNREADABLE as e:
            reason = str(e)[:200]
            if reader == "native" or not tree:
                job = Job()
                job.lose("unsupported", "docx_unreadable", "dropped", reason, "package could not be read")
                return [], job
            nodes, job = read_pandoc(tree)
            job.lose("partial", "docx_reader_fallback", "degraded", reason, "package read by pandoc's tree instead")
            return nodes, job
    if tree:
        return read_pandoc(tree)
    job = Job()
    job.lose("unsupported", "docx_unreadable", "dropped", "no tree", "pandoc's tree is not at hand")
    return [], job


def imported_docx(files: DataFrame, doc_id: str = "doc_id", content: str = "content", reader: str = "auto", tree: str | None = None) -> DataFrame:
    """Rows as sources.importers.imported(). reader: native, pandoc or auto; tree names the column of pandoc's JSON, if there is one.

    A file that no reader can read gives an empty document with one loss event.
    """
    if reader not in ("auto", "native", "pandoc"):
        raise ValueError(f"no reader {reader}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from framed(gathered(i, *read_any(bytes(data or b""), t, reader)) for i, data, t in zip(batch["doc_id"], batch["content"], batch["tree"], strict=True))

    given = F.col(tree) if tree else F.lit(None).cast("string")
    return spread(files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("content"), given.alias("tree"))).mapInPandas(run, SCHEMA)


# inventories over an entry table


def inventory(entries: DataFrame) -> DataFrame:
    """doc_id, has_headers, has_footers, has_comments and n_media."""
    name = F.col("name")
    return entries.groupBy("doc_id").agg(
        F.bool_or(name.rlike(r"^word/header\d*\.xml$")).alias("has_headers"),
        F.bool_or(name.rlike(r"^word/footer\d*\.xml$")).alias("has_footers"),
        F.bool_or(name == "word/comments.xml").alias("has_comments"),
        F.count_if(name.startswith("word/media/")).alias("n_media"),
    )


def inventory_losses(found: DataFrame) -> DataFrame:
    """Up to three loss events from the flags of an inventory."""
    of = lambda flag, feature: F.when(F.col(flag), F.lit(feature))
    features = F.array_compact(F.array(of("has_headers", "docx_headers"), of("has_footers", "docx_footers"), of("has_comments", "docx_comments")))
    return found.select("doc_id", F.explode(features).alias("feature")).withColumn("loss_class", F.when(F.col("feature") == "docx_comments", "partial").otherwise("preserved_raw"))


def inventory_json(found: DataFrame) -> DataFrame:
    """doc_id and summary: the flags of inventory() as a JSON object."""
    return found.select("doc_id", F.to_json(F.struct("has_headers", "has_footers", "has_comments", "n_media")).alias("summary"))
