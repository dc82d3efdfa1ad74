"""Pandoc's JSON document tree, read and written. The program itself is never run."""

from __future__ import annotations

import json
import re

from parchment.tree import Job, merged, normalised, plain_block, plain_spans, text_span, wrapped

API = [1, 23, 1]
NO_ATTR = ["", [], []]
ALIGN = {"t": "AlignDefault"}
WRAPS = {"Emph": "em", "Strong": "strong", "Strikeout": "strike", "Underline": "underline"}


class Reader:
    def __init__(self, job: Job) -> None:
        self.job, self.notes = job, []

    def blocks(self, items: list[dict]) -> list[dict]:
        return [b for i in items for b in self.block(i)]

    def _node(self, kind: str, **fields) -> list[dict]:
        self.job.lose("none", kind, "mapped")
        return [{"type": kind, "node_id": self.job.uid("blk"), **fields}]

    def block(self, e: dict) -> list[dict]:
        t, c = e["t"], e.get("c")
        if t in ("Para", "Plain"):
            return self.paragraph(c)
        if t == "Header":
            return self._node("heading", level=min(6, c[0]), content=self.inlines(c[2]))
        if t == "BlockQuote":
            return self._node("quote", children=self.blocks(c))
        if t in ("BulletList", "OrderedList"):
            ordered = t == "OrderedList"
            items = [{"type": "item", "node_id": self.job.uid("li"), "children": self.blocks(x)} for x in (c[1] if ordered else c)]
            start = {"start": c[0][0]} if ordered and c[0][0] != 1 else {}
            return self._node("list", style="ordered" if ordered else "bullet", items=items, **start)
        if t == "CodeBlock":
            return self._node("code_block", text=c[1], language=(c[0][1] or [None])[0])
        if t == "HorizontalRule":
            return self._node("horizontal_rule")
        if t == "Table":
            return self.table(c)
        if t == "Figure":
            image = self._first_image(c[2])
            caption = [s for b in c[1][1] for s in self.inlines(b.get("c", []))] if c[1][1] else []
            if image is None:
                self.job.lose("partial", "figure_without_image", "degraded", "", "figure becomes its contents")
                return self.blocks(c[2])
            return self._node("figure", asset=self.job.asset(image[2][0].rsplit("/", 1)[-1], "image/png", url=image[2][0]), alt=plain_spans(self.inlines(image[1])), caption=caption)
        if t == "Div":
            return self.blocks(c[1])
        if t == "RawBlock":
            if c[0] == "openxml" and 'w:type="page"' in c[1]:
                return self._node("page_break")
            ref = self.job.keep("pandoc", c[0], c[1].encode())
            self.job.lose("preserved_raw", "raw_block", "preserved", ref, f"{c[0]} kept as it was")
            return [self.job.unknown("pandoc", f"{c[0]} block", ref)]
        self.job.lose("partial", f"block_{t}", "degraded", t, "block of unknown type")
        return []

    def paragraph(self, inlines: list[dict]) -> list[dict]:
        if len(inlines) == 1 and inlines[0]["t"] == "Math" and inlines[0]["c"][0]["t"] == "DisplayMath":
            return self._node("math_block", latex=inlines[0]["c"][1])
        if len(inlines) == 1 and inlines[0]["t"] == "Image":
            _, alt, (url, _) = inlines[0]["c"]
            return self._node("figure", asset=self.job.asset(url.rsplit("/", 1)[-1], "image/png", url=url), alt=plain_spans(self.inlines(alt)), caption=[])
        content = self.inlines(inlines)
        return self._node("paragraph", content=content) if content else []

    def _first_image(self, blocks) -> list | None:
        stack = [blocks]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if x.get("t") == "Image":
                    return x["c"]
                stack.append(x.get("c"))
            elif isinstance(x, list):
                stack.extend(reversed(x))
        return None

    def table(self, c: list) -> list[dict]:
        if c[1][1]:
            self.job.lose("partial", "table_caption", "dropped", "", "table caption not imported")
        head = c[3][1]
        rows, taken = [], {}
        for k, row in enumerate([*head, *(r for body in c[4] for r in [*body[2], *body[3]]), *c[5][1]]):
            cells, col = [], 0
            for cell in row[1]:
                while taken.get((k, col)):
                    col += 1
                _, _, down, across, content = cell
                for r in range(down):
                    for w in range(across):
                        taken[k + r, col + w] = True
                made = {"type": "cell", "node_id": self.job.uid("cel"), "col": col, "children": self.blocks(content)}
                cells.append(made | ({"col_span": across} if across > 1 else {}) | ({"row_span": down} if down > 1 else {}))
                col += across
            rows.append({"type": "row", "node_id": self.job.uid("row"), "cells": cells})
        names = [" ".join(plain_block(b) for b in x["children"]) for x in rows[0]["cells"]] if head and rows else []
        columns = [
            {"type": "column", "node_id": self.job.uid("col"), "title": names[i] if i < len(names) else None} | ({"extra": {"width": round(w["c"] * 1000) / 1000}} if w["t"] == "ColWidth" else {})
            for i, (_, w) in enumerate(c[2])
        ]
        return self._node("table", header_row=bool(head), columns=columns, rows=rows)

    def inlines(self, items: list[dict]) -> list[dict]:
        return merged(s for i in items for s in self.inline(i))

    def inline(self, e: dict) -> list[dict]:
        t, c = e["t"], e.get("c")
        if t == "Str":
            return [text_span(c)]
        if t in ("Space", "SoftBreak"):
            return [text_span(" ")]
        if t == "LineBreak":
            return [{"type": "hard_break"}]
        if t == "Code":
            return [{"type": "code", "text": c[1]}]
        if t in WRAPS:
            return [{"type": WRAPS[t], "content": self.inlines(c)}]
        if t == "Link":
            return [{"type": "link", "url": c[2][0], "title": c[2][1] or None, "content": self.inlines(c[1])}]
        if t == "Image":
            return [{"type": "inline_image", "asset": self.job.asset(c[2][0].rsplit("/", 1)[-1], "image/png", url=c[2][0]), "alt": plain_spans(self.inlines(c[1]))}]
        if t == "Math":
            return [{"type": "inline_math", "latex": c[1]}]
        if t == "Note":
            i = self.job.uid("blk")
            self.notes.append({"type": "footnote", "node_id": i, "children": self.blocks(c)})
            return [{"type": "footnote_ref", "target_ref": i}]
        if t == "Quoted":
            left, right = ("“", "”") if c[0]["t"] == "DoubleQuote" else ("‘", "’")
            return [text_span(left), *self.inlines(c[1]), text_span(right)]
        if t == "RawInline":
            ref = self.job.keep("pandoc", c[0], c[1].encode())
            self.job.lose("preserved_raw", "raw_inline", "preserved", ref, f"{c[0]} kept as it was")
            return [self.job.unknown("pandoc", f"{c[0]} inline", ref)]
        self.job.lose("partial", f"inline_{t}", "unwrapped", t, f"{t} not imported, its text is")
        inner = c if t in ("SmallCaps", "Superscript", "Subscript") else c[1] if isinstance(c, list) and len(c) > 1 else []
        return self.inlines(inner)


def meta_string(value: dict | None) -> str | None:
    if not value:
        return None
    return value["c"] if value["t"] == "MetaString" else plain_spans(Reader(Job()).inlines(value["c"])) if value["t"] == "MetaInlines" else None


def read_pandoc(text: str) -> tuple[list[dict], Job]:
    """The tree of a JSON document, footnotes last, with sections from its headings."""
    doc, job = json.loads(text), Job()
    job.title = meta_string(doc.get("meta", {}).get("title"))
    reader = Reader(job)
    out = reader.blocks(doc["blocks"])
    return normalised(wrapped(out + reader.notes, job)), job


class Writer:
    def __init__(self, nodes: list[dict]) -> None:
        from parchment.tree import blocks

        self.defined = {b.get("node_id"): b for b in blocks(nodes) if b["type"] == "footnote"}

    def blocks(self, items: list[dict]) -> list[dict]:
        return [b for n in items for b in self.block(n)]

    def block(self, n: dict) -> list[dict]:
        t = n["type"]
        if t == "section":
            return self.blocks(n.get("children", []))
        if t == "paragraph":
            return [{"t": "Para", "c": self.spans(n.get("content"))}]
        if t == "heading":
            return [{"t": "Header", "c": [int(n.get("level") or 1), [n.get("node_id") or "", [], []], self.spans(n.get("content"))]}]
        if t == "quote":
            return [{"t": "BlockQuote", "c": self.blocks(n.get("children", []))}]
        if t == "list":
            items = [self.blocks(i.get("children", [])) for i in n.get("items", [])]
            if n.get("style") != "ordered":
                return [{"t": "BulletList", "c": items}]
            return [{"t": "OrderedList", "c": [[int(n.get("start") or 1), {"t": "Decimal"}, {"t": "Period"}], items]}]
        if t == "code_block":
            return [{"t": "CodeBlock", "c": [["", [n["language"]] if n.get("language") else [], []], n.get("text") or ""]}]
        if t == "horizontal_rule":
            return [{"t": "HorizontalRule"}]
        if t == "page_break":
            return [{"t": "RawBlock", "c": ["openxml", '<w:p><w:r><w:br w:type="page"/></w:r></w:p>']}]
        if t == "math_block":
            return [{"t": "Para", "c": [{"t": "Math", "c": [{"t": "DisplayMath"}, n.get("latex") or ""]}]}]
        if t in ("figure", "image"):
            image = {"t": "Image", "c": [NO_ATTR, self.text(n.get("alt") or ""), [n.get("asset") or "", ""]]}
            if t == "image":
                return [{"t": "Para", "c": [image]}]
            caption = [{"t": "Plain", "c": self.spans(n["caption"])}] if n.get("caption") else []
            return [{"t": "Figure", "c": [NO_ATTR, [None, caption], [{"t": "Plain", "c": [image]}]]}]
        if t == "table":
            return [self.table(n)]
        if t == "footnote":
            return []
        if t == "unknown":
            return [{"t": "Para", "c": self.text(f"[{n.get('summary') or ''}]")}]
        return self.blocks(n.get("children", []))

    def table(self, n: dict) -> dict:
        rows = [
            [NO_ATTR, [[NO_ATTR, ALIGN, int(c.get("row_span") or 1), int(c.get("col_span") or 1), self.blocks(c.get("children", []))] for c in r.get("cells", [])]] for r in n.get("rows", [])
        ]
        head, body = (rows[:1], rows[1:]) if n.get("header_row") else ([], rows)
        widths = [(json.loads(c["extra"]) if isinstance(c.get("extra"), str) else c.get("extra") or {}).get("width") for c in n.get("columns", [])]
        total = sum(w for w in widths if w)
        specs = [[ALIGN, {"t": "ColWidth", "c": w / total} if w else {"t": "ColWidthDefault"}] for w in widths]
        return {"t": "Table", "c": [NO_ATTR, [None, []], specs, [NO_ATTR, head], [[NO_ATTR, 0, [], body]], [NO_ATTR, []]]}

    @staticmethod
    def text(text: str) -> list[dict]:
        return [{"t": "Space"} if w == " " else {"t": "Str", "c": w} for w in re.findall(r" |[^ ]+", text)]

    def spans(self, items: list[dict] | None) -> list[dict]:
        return [x for s in items or [] for x in self.span(s)]

    def span(self, s: dict) -> list[dict]:
        t = s["type"]
        if t == "text":
            return self.text(s.get("text") or "")
        if t == "hard_break":
            return [{"t": "LineBreak"}]
        if t == "code":
            return [{"t": "Code", "c": [NO_ATTR, s.get("text") or ""]}]
        for name, kind in WRAPS.items():
            if kind == t:
                return [{"t": name, "c": self.spans(s.get("content"))}]
        if t == "link":
            return [{"t": "Link", "c": [NO_ATTR, self.spans(s.get("content")), [s.get("url") or "", s.get("title") or ""]]}]
        if t == "inline_math":
            return [{"t": "Math", "c": [{"t": "InlineMath"}, s.get("latex") or ""]}]
        if t == "inline_image":
            return [{"t": "Image", "c": [NO_ATTR, self.text(s.get("alt") or ""), [s.get("asset") or "", ""]]}]
        if t == "footnote_ref":
            note = self.defined.get(s.get("target_ref"))
            return [{"t": "Note", "c": self.blocks(note.get("children", []))}] if note else []
        if t in ("mention", "cite"):
            return self.text(s.get("target_ref") or "")
        return self.spans(s.get("content"))


def write_pandoc(nodes: list[dict], title: str | None = None) -> str:
    """A tree as a JSON document; footnotes stand at their references."""
    meta = {"title": {"t": "MetaString", "c": title}} if title else {}
    return json.dumps({"pandoc-api-version": API, "meta": meta, "blocks": Writer(nodes).blocks(nodes)}, ensure_ascii=False)
