"""Editor documents: nested spans as flat text runs with mark sets, and back.

Marks are ordered by rank, outermost first: link, strong, em, underline, strike, code. Runs of equal marks merge, and going
back neighbours that share their outer marks share the span.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby

from parchment.schemas import NODE_TYPES
from parchment.tree import SLOTS, Job, merged, text_span

RANK = {"link": 0, "strong": 1, "em": 2, "underline": 3, "strike": 4, "code": 5}
#: Node table attributes that an editor node carries, beside id.
FIELDS = "level style start checked language url title asset alt latex variant target_ref col col_span row_span role header_row origin loss_class summary payload_ref label".split()
NAMES = {"item": "list_item", "row": "table_row", "cell": "table_cell"}
BACK = {v: k for k, v in NAMES.items()}
CHILDREN = {"section": "children", "quote": "children", "callout": "children", "footnote": "children", "list": "items", "list_item": "children", "table": "rows", "table_row": "cells", "table_cell": "children"}


def runs(spans: list[dict]) -> list[dict]:
    """Inline editor nodes: text with marks, sorted and without repeats; anything else is an atom."""
    flat: list[tuple[str, object, tuple]] = []

    def walk(items: list[dict], marks: tuple) -> None:
        for s in items:
            kind = s["type"]
            if kind == "text":
                flat.append(("text", s.get("text") or "", marks))
            elif kind == "code":
                flat.append(("text", s.get("text") or "", (*marks, ("code", "{}"))))
            elif kind in RANK:
                attrs = {k: s[k] for k in ("url", "title") if s.get(k) is not None} if kind == "link" else {}
                walk(s.get("content", []), (*marks, (kind, json.dumps(attrs, sort_keys=True))))
            else:
                flat.append((kind, s, marks))

    walk(spans, ())
    out = []
    key = lambda f: (f[0] == "text", tuple(sorted(dict.fromkeys(f[2]), key=lambda m: (RANK[m[0]], m[1]))), None if f[0] == "text" else id(f[1]))
    for (is_text, marks, _), group in groupby(flat, key):
        group = list(group)
        shown = [{"type": n, "attrs": json.loads(a)} if a != "{}" else {"type": n} for n, a in marks]
        if is_text:
            text = "".join(str(g[1]) for g in group)
            if text:
                out.append({"type": "text", "text": text} | ({"marks": shown} if shown else {}))
        else:
            s = group[0][1]
            out.append({"type": s["type"], "attrs": {k: v for k, v in s.items() if k != "type" and v is not None}} | ({"marks": shown} if shown else {}))
    return out


def spans(inline: list[dict]) -> list[dict]:
    """Nested spans of inline editor nodes."""

    def build(items: list[tuple[tuple, dict]], depth: int) -> list[dict]:
        out: list[dict] = []
        for mark, group in groupby(items, lambda x: x[0][depth] if len(x[0]) > depth else None):
            group = list(group)
            if mark is None:
                out.extend(leaf for _, leaf in group)
            elif mark[0] == "code":
                out.append({"type": "code", "text": "".join(leaf.get("text", "") for _, leaf in group)})
            else:
                out.append({"type": mark[0], **json.loads(mark[1]), "content": build(group, depth + 1)})
        return out

    rows = []
    for n in inline:
        marks = tuple(sorted(((m["type"], json.dumps(m.get("attrs") or {}, sort_keys=True)) for m in n.get("marks", []) if m["type"] in RANK), key=lambda m: (RANK[m[0]], m[1])))
        rows.append((marks, text_span(n.get("text", "")) if n["type"] == "text" else {"type": n["type"], **(n.get("attrs") or {})}))
    return merged(build(rows, 0))


def _extra(column: dict) -> dict:
    extra = column.get("extra") or {}
    return json.loads(extra) if isinstance(extra, str) else extra


def _width(column: dict):
    return _extra(column).get("width")


def _take_widths(columns: list[dict], rows: list[dict]) -> None:
    """Each column gets the first width that a cell gives for it; cells beyond the columns add none."""
    found: dict[int, object] = {}
    for cell in (c for r in rows for c in r.get("content", [])):
        attrs = cell.get("attrs") or {}
        for k, w in enumerate(attrs.get("colwidth") or []):
            if w is not None:
                found.setdefault((attrs.get("col") or 0) + k, w)
    for i, column in enumerate(columns):
        if i in found:
            column["extra"] = _extra(column) | {"width": found[i]}


def to_editor(nodes: list[dict]) -> dict:
    """A document as the editor holds it. The widths of a table's columns are spread to its cells."""
    shown: dict[int, list] = {}

    def block(n: dict) -> dict:
        kind = NAMES.get(n["type"], n["type"])
        attrs = {"id": n.get("node_id")} | {f: n[f] for f in FIELDS if n.get(f) is not None}
        if n.get("extra") is not None:
            attrs["extra"] = n["extra"]
        if n["type"] == "table":
            attrs["columns"] = [{k: v for k, v in c.items() if v is not None} for c in n.get("columns", [])]
            spread = [_width(c) for c in n.get("columns", [])]
            if any(w is not None for w in spread):
                for cell in (c for r in n.get("rows", []) for c in r.get("cells", [])):
                    at = cell.get("col") or 0
                    shown[id(cell)] = spread[at : at + (cell.get("col_span") or 1)]
        if id(n) in shown:
            attrs["colwidth"] = shown.pop(id(n))
        if n.get("caption"):
            attrs["caption"] = runs(n["caption"])
        out = {"type": kind, "attrs": attrs}
        if n["type"] == "code_block":
            return out | ({"content": [{"type": "text", "text": n["text"]}]} if n.get("text") else {})
        slot = CHILDREN.get(kind)
        content = runs(n["content"]) if "content" in n else [block(c) for c in n.get(slot, [])] if slot else []
        return out | ({"content": content} if content else {})

    return {"type": "doc", "attrs": {"schema_version": "1.0"}, "content": [block(n) for n in nodes]}


def from_editor(doc: dict, new_id: Callable[[str], str] | None = None) -> list[dict]:
    """The tree of an editor document. The first holder of a valid id keeps it; missing and repeated ids are issued anew."""
    new_id, seen = new_id or Job().uid, set()
    prefixes = {"section": "sec", "list_item": "li", "table_row": "row", "table_cell": "cel"}

    def block(n: dict) -> dict:
        kind, attrs = n["type"], n.get("attrs") or {}
        out = {"type": BACK.get(kind, kind)}
        own = attrs.get("id")
        if not own or own in seen:
            own = new_id(prefixes.get(kind, "blk"))
            while own in seen:
                own = new_id(prefixes.get(kind, "blk"))
        seen.add(own)
        out["node_id"] = own
        out |= {f: attrs[f] for f in FIELDS if attrs.get(f) is not None and not (f in ("col_span", "row_span") and attrs[f] == 1)}
        if attrs.get("extra") is not None:
            out["extra"] = attrs["extra"]
        content = n.get("content", [])
        if kind == "table":
            out["columns"] = [{"type": "column", **{k: v for k, v in c.items() if k != "type"}} for c in attrs.get("columns") or []]
            _take_widths(out["columns"], content)
        if attrs.get("caption") is not None:
            out["caption"] = spans(attrs["caption"])
        if kind == "code_block":
            out["text"] = "".join(c.get("text", "") for c in content)
        elif kind in CHILDREN:
            out[CHILDREN[kind]] = [block(c) for c in content]
        elif kind in NODE_TYPES and kind in ("paragraph", "heading"):
            out["content"] = spans(content)
        return out

    return [block(n) for n in doc.get("content", [])]


def stable(nodes: list[dict]) -> list[dict]:
    """A tree without empty slots and nulls: what a round trip keeps."""
    out = []
    for n in nodes:
        n = {k: v for k, v in n.items() if v is not None}
        for slot in SLOTS:
            if slot in n:
                n[slot] = stable(merged(n[slot]) if slot in ("content", "caption") else n[slot])
        out.append({k: v for k, v in n.items() if v != []})
    return out


def schema_spec() -> dict:
    """The editor's schema as its nodes and marks, made from the same tables that the mapping uses."""
    from parchment.schemas import SPAN_TYPES

    inner = {"section": "block+", "quote": "block+", "callout": "block+", "footnote": "block+", "list": "list_item+", "list_item": "block+", "table": "table_row+", "table_row": "table_cell*", "table_cell": "block*"}
    nodes = {NAMES.get(t, t): {"group": "block", "content": inner.get(NAMES.get(t, t), "inline*" if t in ("paragraph", "heading") else "text*" if t == "code_block" else "")} for t in (*NODE_TYPES, "row", "cell")}
    atoms = {t: {"group": "inline", "content": "", "atom": True} for t in SPAN_TYPES if t not in RANK and t not in ("text", "unknown")}
    marks = {name: {"rank": rank, "attrs": ["url", "title"] if name == "link" else []} for name, rank in RANK.items()}
    return {"nodes": nodes | atoms | {"text": {"group": "inline", "content": ""}}, "marks": marks, "attrs": ["id", *FIELDS]}
