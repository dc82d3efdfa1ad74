"""Documents as trees inside one task, and their rows in the node table.

A node is a dict: type, attributes named as the node table's columns, and slots, each an ordered list of nodes.
"""

from __future__ import annotations

import hashlib
import json
import mimetypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from parchment.schemas import ID_ALPHABET, ID_DIGITS, NODE_FIELDS, NODES, SPAN_TYPES

SLOTS = ("columns", "content", "children", "items", "rows", "cells", "caption")
STRUCTS = ("item", "row", "cell", "column")
#: Slots that hold spans.
SPAN_SLOTS = ("content", "caption")
#: Attributes that are whole numbers; data frames with nulls hand them over as floats.
WHOLE = frozenset(f.split()[0] for f in NODES.split(", ") if f.endswith(" int"))
ATTRIBUTES = [f for f in NODE_FIELDS if f not in ("doc_id", "seq", "parent_seq", "slot", "ord", "depth", "path", "kind", "type")]

BLANK = dict.fromkeys(ATTRIBUTES)


def digits(n: int) -> str:
    """A counter in base 32, least significant digit first."""
    out = []
    while n and len(out) < ID_DIGITS:
        n, d = divmod(n, 32)
        out.append(ID_ALPHABET[d])
    return "".join(out).ljust(ID_DIGITS, ID_ALPHABET[0])


@dataclass
class Job:
    """What an import gathers beside the tree."""

    loss: list[dict] = field(default_factory=list)
    preserved: list[dict] = field(default_factory=list)
    assets: list[dict] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    title: str | None = None
    language: str | None = None
    extra: dict = field(default_factory=dict)
    theme: dict | None = None
    _count: int = 0

    def uid(self, prefix: str) -> str:
        self._count += 1
        return f"{prefix}_{digits(self._count)}"

    def lose(self, loss_class: str, feature: str, action: str, detail: str = "", message: str = "", location: str | None = None) -> None:
        self.loss.append({"feature": feature, "loss_class": loss_class, "location": location, "action": action, "detail": detail, "message": message})

    def keep(self, origin: str, suffix: str, payload: bytes) -> str:
        """Keep a payload; numbers run within an origin."""
        n = sum(p["origin"] == origin for p in self.preserved)
        path = f"preserved/{origin}/part-{n:04d}.{suffix}"
        self.preserved.append({"path": path, "origin": origin, "seq": n, "bytes": payload})
        return path

    def asset(self, filename: str, mime: str, payload: bytes | None = None, url: str | None = None) -> str:
        """Register an asset; returns its reference."""
        n = self.uid("as")
        embedded = payload is not None
        self.assets.append(
            {
                "ord": len(self.assets), "asset_id": n, "filename": filename, "mime": mime, "size": len(payload) if embedded else None,
                "sha256": hashlib.sha256(payload).hexdigest() if embedded else None, "storage": "embedded" if embedded else "external",
                "path": f"assets/{n}/{filename}" if embedded else None, "url": url, "bytes": payload,
            }
        )
        return f"asset://{n}/{filename}"

    def unknown(self, origin: str, summary: str, payload_ref: str, kind: str = "blk") -> dict:
        return {"type": "unknown", "node_id": self.uid(kind), "origin": origin, "loss_class": "preserved_raw", "summary": summary, "payload_ref": payload_ref}


def text_span(text: str) -> dict:
    return {"type": "text", "text": text}


def merged(spans: Iterable[dict]) -> list[dict]:
    """Empty text goes, and neighbouring texts become one."""
    out: list[dict] = []
    for s in spans:
        if "content" in s:
            s = {**s, "content": merged(s["content"])}
        if s["type"] == "text":
            if not s.get("text"):
                continue
            if out and out[-1]["type"] == "text" and not s.get("extra") and not out[-1].get("extra"):
                out[-1] = {**out[-1], "text": out[-1]["text"] + s["text"]}
                continue
        out.append(s)
    return out


def normalised(nodes: list[dict]) -> list[dict]:
    """merged() in every slot of spans."""
    out = []
    for n in nodes:
        n = dict(n)
        for slot in SLOTS:
            if slot in n:
                n[slot] = merged(n[slot]) if slot in SPAN_SLOTS and n["type"] not in STRUCTS else normalised(n[slot])
        out.append(n)
    return out


def wrapped(nodes: list[dict], job: Job) -> list[dict]:
    """Sections from headings: a heading opens one that ends before the next heading of its level or above."""
    root: list[dict] = []
    open_: list[tuple[int, dict]] = []
    for n in nodes:
        if n["type"] == "heading":
            while open_ and open_[-1][0] >= n["level"]:
                open_.pop()
            section = {"type": "section", "node_id": job.uid("sec"), "children": [n]}
            (open_[-1][1]["children"] if open_ else root).append(section)
            open_.append((n["level"], section))
        else:
            (open_[-1][1]["children"] if open_ else root).append(n)
    return root


def flatten(nodes: list[dict]) -> Iterator[dict]:
    """Rows of the node table in preorder, without doc_id."""
    seq = 0
    stack = [(n, None, "content", i, 0, f"content[{i}]") for i, n in reversed(list(enumerate(nodes)))]
    while stack:
        n, parent, slot, i, depth, path = stack.pop()
        kind = "struct" if n["type"] in STRUCTS else "span" if slot in SPAN_SLOTS and depth > 0 else "block"
        row = {"seq": seq, "parent_seq": parent, "slot": slot, "ord": i, "depth": depth, "path": path, "kind": kind, "type": n["type"], **BLANK}
        for a in BLANK.keys() & n.keys():
            value = n[a]
            row[a] = json.dumps(value, ensure_ascii=False, sort_keys=True) if a == "extra" and value is not None and not isinstance(value, str) else value
        yield row
        below = [(c, seq, s, j, depth + 1, f"{path}.{s}[{j}]") for s in SLOTS for j, c in enumerate(n.get(s) or [])]
        stack.extend(reversed(below))
        seq += 1


def unflatten(rows: Iterable[dict]) -> list[dict]:
    """The tree of a document's rows, whatever their order."""
    found, root = {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        n = {"type": r["type"]} | {a: int(r[a]) if a in WHOLE else r[a] for a in ATTRIBUTES if r.get(a) is not None and r.get(a) == r.get(a)}
        found[r["seq"]] = n
        parent = r["parent_seq"]
        if parent is None or parent != parent:
            root.append(n)
        else:
            found[int(parent)].setdefault(r["slot"], []).append(n)
    return root


def plain_span(s: dict) -> str:
    """Plain text of a span."""
    kind = s["type"]
    if kind in ("text", "code"):
        return s.get("text") or ""
    if kind == "hard_break":
        return "\n"
    if kind == "inline_math":
        return s.get("latex") or ""
    if kind == "inline_image":
        return s.get("alt") or ""
    if kind in ("mention", "cite"):
        return s.get("target_ref") or ""
    if kind in ("footnote_ref", "unknown"):
        return ""
    return plain_spans(s.get("content"))


def plain_spans(spans: list[dict] | None) -> str:
    return "".join(plain_span(s) for s in spans or [])


def plain_block(n: dict) -> str:
    """Plain text of a block: cells by tabs, blocks of a cell by spaces, everything else by line ends."""
    kind = n["type"]
    if kind in ("paragraph", "heading"):
        return plain_spans(n.get("content"))
    if kind == "code_block":
        return n.get("text") or ""
    if kind == "math_block":
        return n.get("latex") or ""
    if kind in ("figure", "image"):
        return plain_spans(n.get("caption")) or n.get("alt") or ""
    if kind == "table":
        return "\n".join("\t".join(" ".join(plain_block(b) for b in c.get("children", [])) for c in r.get("cells", [])) for r in n.get("rows", []))
    if kind == "list":
        return "\n".join("\n".join(plain_block(b) for b in i.get("children", [])) for i in n.get("items", []))
    return "\n".join(plain_block(b) for b in n.get("children", []))


def blocks(nodes: list[dict]) -> Iterator[dict]:
    """All blocks, parents first."""
    for n in nodes:
        if n["type"] not in STRUCTS:
            yield n
        for slot in ("children", "items", "rows", "cells"):
            yield from blocks(n.get(slot) or [])


def spans(nodes: list[dict]) -> Iterator[dict]:
    """All spans below nodes, in order."""
    for n in nodes:
        for slot in SLOTS:
            if slot in SPAN_SLOTS:
                for s in n.get(slot) or []:
                    yield s
                    yield from spans([s])
            else:
                yield from spans(n.get(slot) or [])


def is_span(kind: str) -> bool:
    return kind in SPAN_TYPES


def file_mime(name: str) -> str:
    return mimetypes.guess_type(name)[0] or "application/octet-stream"
