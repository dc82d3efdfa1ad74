"""HTML reader: tolerant parsing to a tree, mapped onto blocks and spans with a record of what was lost.

The parser keeps the parts of browser recovery that decide structure: implied html, head and body, implied end tags, void
elements, raw text elements, and formatting elements left open, which go on in the paragraphs after.
"""

from __future__ import annotations

import base64
import binascii
import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

from parchment.functions.assets import guess_mime
from parchment.tree import Job, merged, normalised, text_span

#: Classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
INLINE = frozenset(
    "a abbr b big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
TRANSPARENT = frozenset(("div", "center", "html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "figcaption", "caption"))
ACTIVE = frozenset(("script", "iframe", "object", "embed", "applet"))
UNWRAPPED = frozenset("sub sup small q abbr cite var time font big wbr data dfn tt".split())
HEAD_ONLY = frozenset("title meta link base style script".split())
SCRIPT_URL = re.compile(r"^[\x00-\x20]*(?:j\s*a\s*v\s*a\s*s\s*c\s*r\s*i\s*p\s*t|vbscript)\s*:|^[\x00-\x20]*data:text/html", re.I)
DATA_URI = re.compile(r"^data:([^;,]*)((?:;[^;,]*)*),(.*)$", re.S)


class Element:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: list[tuple[str, str | None]] | None = None, parent: Element | None = None) -> None:
        self.name, self.attrs, self.children, self.parent = name, {k: v or "" for k, v in reversed(attrs or [])}, [], parent

    def get(self, key: str) -> str | None:
        return self.attrs.get(key)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if not isinstance(c, Comment))

    def descend(self):
        for c in self.elements():
            yield c
            yield from c.descend()

    def source(self) -> str:
        """The element as HTML again."""
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in reversed(self.attrs.items()))
        if self.name in VOID:
            return f"<{self.name}{attrs}>"
        inner = "".join(c.source() if isinstance(c, (Element, Comment)) else c if self.name in RAW else escape(c, quote=False) for c in self.children)
        return f"<{self.name}{attrs}>{inner}</{self.name}>"


class Comment:
    __slots__ = ("data",)

    def __init__(self, data: str) -> None:
        self.data = data

    def source(self) -> str:
        return f"<!--{self.data}-->"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top: list = []
        self.html, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.head.parent = self.body.parent = self.html
        self.html.children = [self.head, self.body]
        self.now, self.in_head, self.begun = self.head, True, False
        self.open: list[Element] = []  # formatting elements that go on

    def _into_body(self) -> None:
        if self.in_head:
            self.in_head, self.now = False, self.body

    def _up_to(self, names, stop=("body", "head", "td", "th", "caption", "table")) -> bool:
        at = self.now
        while at is not None and at.name not in stop:
            if at.name in names:
                self.now = at.parent
                return True
            at = at.parent
        return False

    def _inside(self, name: str) -> bool:
        at = self.now
        while at is not None:
            if at.name == name:
                return True
            at = at.parent
        return False

    def _reconstruct(self) -> None:
        missing = [e for e in self.open if not self._holds(e)]
        for e in missing:
            again = Element(e.name, None, self.now)
            again.attrs = dict(e.attrs)
            self.now.children.append(again)
            self.open[self.open.index(e)] = again
            self.now = again

    def _holds(self, e: Element) -> bool:
        at = self.now
        while at is not None:
            if at is e:
                return True
            at = at.parent
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._into_body()
            self.begun = True
            return
        self.begun = True
        if self.in_head and tag not in HEAD_ONLY and tag not in ("noscript", "template"):
            self._into_body()
        if not self.in_head:
            if tag in CLOSES_P:
                self._up_to(("p",))
            if tag == "li":
                self._up_to(("li",), ("ul", "ol", "body", "td", "th"))
            elif tag in ("dt", "dd"):
                self._up_to(("dt", "dd"), ("dl", "body"))
            elif tag == "tr":
                self._up_to(("tr",), ("table", "body"))
            elif tag in ("td", "th"):
                self._up_to(("td", "th"), ("tr", "table", "body"))
            elif tag in ("tbody", "thead", "tfoot"):
                self._up_to(("tbody", "thead", "tfoot"), ("table", "body"))
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.now.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.now = self.now.parent
            if tag == "a" and any(e.name == "a" for e in self.open):
                self.handle_endtag("a")
            if tag in INLINE:
                self._reconstruct()
        e = Element(tag, attrs, self.now)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e
            if tag in FORMATTING and not self.in_head:
                self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.name == tag and tag not in INLINE and tag not in CLOSES_P:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self._into_body()
            return
        if tag in ("html", "body") or tag in VOID:
            return
        if tag in FORMATTING:
            at = next((e for e in reversed(self.open) if e.name == tag), None)
            if at is not None:
                self.open.remove(at)
                if self._holds(at):
                    self.now = at.parent
            return
        if tag == "p" and not self._inside("p"):
            self.now.children.append(Element("p", None, self.now))
            return
        self._up_to((tag,), ("body", "head"))

    def handle_data(self, data: str) -> None:
        if self.in_head and self.now.name not in HEAD_ONLY | {"noscript", "template"}:
            if not data.strip():
                return
            self._into_body()
        if not self.in_head and self.now.name not in RAW and data.strip():
            self._reconstruct()
        into = self.now.children
        if into and isinstance(into[-1], str):
            into[-1] += data
        else:
            into.append(data)

    def handle_comment(self, data: str) -> None:
        (self.now.children if self.begun else self.top).append(Comment(data))


def parse(html: str) -> tuple[list, Element, Element]:
    """What stands before the document, its head and its body."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.top, builder.head, builder.body


def collapse(text: str) -> str:
    """Runs of white space become a blank; the ends keep one, as a neighbour may need it."""
    return re.sub(r"\s+", " ", text)


def decode_data_uri(uri: str) -> tuple[str, bytes] | None:
    m = DATA_URI.match(uri)
    if not m:
        return None
    mime = m[1] or "application/octet-stream"
    try:
        return mime, base64.b64decode(m[3], validate=True) if ";base64" in m[2] else unquote_to_bytes(m[3])
    except (binascii.Error, ValueError):
        return None


class Reader:
    def __init__(self, job: Job) -> None:
        self.job = job

    def strip_active(self, e: Element) -> None:
        for key in [k for k, v in e.attrs.items() if k.startswith("on") or k == "srcdoc" or (k in ("href", "src", "action", "formaction", "xlink:href", "data") and SCRIPT_URL.match(v))]:
            del e.attrs[key]
            self.job.lose("unsupported", "active_content", "removed", key, "active attribute removed")

    def preserve(self, e: Element | Comment, feature: str, summary: str, kind: str = "blk") -> dict:
        ref = self.job.keep("html", "html", e.source().encode())
        self.job.lose("preserved_raw", feature, "preserved", ref, f"{summary} kept as it was")
        return self.job.unknown("html", summary, ref, kind)

    def media(self, src: str, what: str) -> str:
        if src.startswith("data:"):
            found = decode_data_uri(src)
            if found:
                mime, payload = found
                return self.job.asset(f"{what}.{mime.split('/')[-1].split('+')[0]}", mime, payload)
        name = src.split("?")[0].rstrip("/").rsplit("/", 1)[-1] or what
        if not re.match(r"^https?://", src):
            self.job.lose("partial", f"{what}_missing", "external", src, "file is not at hand; kept as an external reference")
        return self.job.asset(name, guess_mime(name), url=src)

    # blocks

    def flow(self, parent: Element) -> list[dict]:
        out, pending = [], []

        def flush() -> None:
            spans = trimmed(pending)
            if spans:
                self.job.lose("none", "paragraph", "mapped")
                out.append({"type": "paragraph", "node_id": self.job.uid("blk"), "content": spans})
            pending.clear()

        for c in parent.children:
            if isinstance(c, Element) and c.name not in INLINE:
                flush()
                out.extend(self.block(c))
            elif isinstance(c, Comment) and not pending:
                out.append(self.preserve(c, "html_comment", "HTML comment"))
            elif isinstance(c, str) and not c.strip() and not pending:
                continue
            else:
                pending.extend(self.inline(c))
        flush()
        return out

    def block(self, e: Element) -> list[dict]:
        self.strip_active(e)
        job, name = self.job, e.name
        if name == "script":
            job.lose("unsupported", "active_content", "removed", "script", "script element removed")
            return []
        if name == "style":
            job.lose("partial", "style_element", "dropped", "body", "style sheet not imported")
            return []
        if name == "p":
            content = trimmed(self.inlines(e))
            job.lose("none", "paragraph", "mapped")
            return [{"type": "paragraph", "node_id": job.uid("blk"), "content": content}] if content else []
        if re.fullmatch("h[1-6]", name):
            job.lose("none", "heading", "mapped")
            return [{"type": "heading", "node_id": job.uid("blk"), "level": int(name[1]), "content": trimmed(self.inlines(e))}]
        if name == "blockquote":
            job.lose("none", "quote", "mapped")
            return [{"type": "quote", "node_id": job.uid("blk"), "children": self.flow(e)}]
        if name in ("ul", "ol"):
            return [self.list(e)]
        if name == "pre":
            return [self.code(e)]
        if name == "table":
            return [self.table(e)]
        if name == "hr":
            job.lose("none", "horizontal_rule", "mapped")
            return [{"type": "horizontal_rule", "node_id": job.uid("blk")}]
        if name == "div" and "page-break" in (e.get("class") or "").split():
            job.lose("none", "page_break", "mapped")
            return [{"type": "page_break", "node_id": job.uid("blk")}]
        if name == "figure":
            return self.figure(e)
        if name in ("section", "article", "main"):
            job.lose("none", "section", "mapped")
            return [{"type": "section", "node_id": job.uid("sec"), "children": self.flow(e)}]
        if name in ("iframe", "video", "audio", "object", "embed"):
            src = e.get("src") or e.get("data") or next((s.get("src") for s in e.descend() if s.name == "source"), None) or ""
            job.lose("partial", "embed", "mapped", name, f"{name} becomes an embed")
            return [{"type": "embed", "node_id": job.uid("blk"), "asset": self.media(src, name) if src else None, "title": e.get("title")}]
        if name == "template":
            job.lose("partial", "template_element", "dropped", "template", "template not imported")
            return []
        if "-" in name:
            return [self.preserve(e, "custom_element", f"<{name}>")]
        if name in TRANSPARENT:
            return self.flow(e)
        for inner in e.descend():
            if inner.name in RAW - {"style"}:
                job.lose("unsupported", "active_content", "preserved", inner.name, "active content inside a preserved part")
        return [self.preserve(e, "unknown_element", f"<{name}>")]

    def list(self, e: Element) -> dict:
        self.job.lose("none", "list", "mapped")
        node = {"type": "list", "node_id": self.job.uid("blk"), "style": "ordered" if e.name == "ol" else "bullet", "items": []}
        if e.name == "ol" and (e.get("start") or "").lstrip("-").isdigit():
            node["start"] = int(e.get("start"))
        for c in e.elements():
            self.strip_active(c)
            if c.name == "li":
                item = {"type": "item", "node_id": self.job.uid("li"), "children": self.flow(c)}
                if c.get("data-checked") is not None:
                    item["checked"] = c.get("data-checked") == "true"
                node["items"].append(item)
            elif c.name in ("ul", "ol"):
                if not node["items"]:
                    node["items"].append({"type": "item", "node_id": self.job.uid("li"), "children": []})
                node["items"][-1]["children"].append(self.list(c))
        return node

    def code(self, e: Element) -> dict:
        self.job.lose("none", "code_block", "mapped")
        inner = next((c for c in e.elements() if c.name == "code"), e)
        language = next((c[9:] for c in (inner.get("class") or "").split() if c.startswith("language-")), None)
        text = inner.text()
        return {"type": "code_block", "node_id": self.job.uid("blk"), "text": text.removeprefix("\n").removesuffix("\n"), "language": language}

    def table(self, e: Element) -> dict:
        self.job.lose("none", "table", "mapped")
        rows, header = [], False
        parts = [c for s in e.elements() for c in (s.elements() if s.name in ("thead", "tbody", "tfoot") else [s]) if c.name == "tr"]
        for tr in parts:
            row, col = {"type": "row", "node_id": self.job.uid("row"), "cells": []}, 0
            for c in tr.elements():
                if c.name not in ("td", "th"):
                    continue
                self.strip_active(c)
                header = header or c.name == "th"
                across, down = (max(1, int(v)) if (v := c.get(k) or "").isdigit() else 1 for k in ("colspan", "rowspan"))
                cell = {"type": "cell", "node_id": self.job.uid("cel"), "col": col, "children": self.flow(c)}
                row["cells"].append(cell | ({"col_span": across} if across > 1 else {}) | ({"row_span": down} if down > 1 else {}) | ({"role": "header"} if c.name == "th" else {}))
                col += across
            rows.append(row)
        width = max((sum(c.get("col_span", 1) for c in r["cells"]) for r in rows), default=0)
        names = [" ".join(x for x in (_plain(b) for b in c["children"]) if x) for c in rows[0]["cells"]] if rows and header else []
        columns = [{"type": "column", "node_id": self.job.uid("col"), "ord": i, "title": names[i] if i < len(names) else None} for i in range(width)]
        return {"type": "table", "node_id": self.job.uid("blk"), "header_row": header, "columns": columns, "rows": rows}

    def figure(self, e: Element) -> list[dict]:
        img = next((c for c in e.descend() if c.name == "img"), None)
        if img is None:
            return self.flow(e)
        caption = next((c for c in e.descend() if c.name == "figcaption"), None)
        self.strip_active(img)
        self.job.lose("none", "figure", "mapped")
        return [
            {
                "type": "figure", "node_id": self.job.uid("blk"), "asset": self.media(img.get("src") or "", "image"), "alt": img.get("alt") or "",
                "caption": trimmed(self.inlines(caption)) if caption else [],
            }
        ]

    # spans

    def inlines(self, e: Element) -> list[dict]:
        return [s for c in e.children for s in self.inline(c)]

    def inline(self, c: Element | Comment | str) -> list[dict]:
        job = self.job
        if isinstance(c, str):
            return [text_span(collapse(c))]
        if isinstance(c, Comment):
            return [self.preserve(c, "html_comment", "HTML comment", "blk")]
        self.strip_active(c)
        name = c.name
        if name == "br":
            return [{"type": "hard_break"}]
        wraps = {"em": "em", "i": "em", "strong": "strong", "b": "strong", "u": "underline", "ins": "underline", "s": "strike", "strike": "strike", "del": "strike"}
        if name in wraps:
            return [{"type": wraps[name], "content": self.inlines(c)}]
        if name in ("code", "kbd", "samp"):
            return [{"type": "code", "text": c.text()}]
        if name == "a":
            return [{"type": "link", "url": c.get("href") or "", "title": c.get("title"), "content": self.inlines(c)}]
        if name == "img":
            return [{"type": "inline_image", "asset": self.media(c.get("src") or "", "image"), "alt": c.get("alt") or ""}]
        if name == "span":
            if c.get("class") or c.get("style"):
                job.lose("partial", "span_style", "unwrapped", c.get("class") or c.get("style") or "", "styling of a span not imported")
            return self.inlines(c)
        if name == "mark":
            job.lose("partial", "mark", "mapped", "mark", "highlight becomes strong")
            return [{"type": "strong", "content": self.inlines(c)}]
        if name in UNWRAPPED:
            job.lose("partial", f"{name}_element", "unwrapped", name, f"{name} not imported, its text is")
            return self.inlines(c)
        if name == "script":
            job.lose("unsupported", "active_content", "removed", "script", "script element removed")
            return []
        return [self.preserve(c, "unknown_inline", f"<{name}>")]


def _plain(n: dict) -> str:
    from parchment.tree import plain_block

    return plain_block(n)


def trimmed(spans: list[dict]) -> list[dict]:
    """Blanks at both ends of a block go, doubled ones between texts become one."""
    flat: list[dict] = []

    def walk(items: list[dict]) -> list[dict]:
        kept = []
        for s in items:
            s = dict(s)
            if s["type"] == "text":
                if flat and flat[-1]["type"] == "text" and flat[-1]["text"].endswith(" ") or not flat:
                    s["text"] = s["text"].lstrip(" ")
                if not s["text"]:
                    continue
                flat.append(s)
            elif "content" in s:
                s["content"] = walk(s["content"])
            else:
                flat.append(s)
            kept.append(s)
        return kept

    out = walk(spans)
    while flat and flat[-1]["type"] == "text":
        flat[-1]["text"] = flat[-1]["text"].rstrip(" ")
        if flat[-1]["text"]:
            break
        flat.pop()
    return merged(s for s in out if not (s["type"] == "link" and not s["content"] and not s.get("url")))


def read_html(html: str) -> tuple[list[dict], Job]:
    """The tree of an HTML page, and what its import gathered."""
    job = Job()
    reader = Reader(job)
    top, head, body = parse(html or "")
    out = [reader.preserve(c, "html_comment", "HTML comment") for c in top]
    for e in head.elements():
        if e.name == "title":
            job.title = re.sub(r"\s+", " ", e.text()).strip()
        elif e.name == "script":
            job.lose("unsupported", "active_content", "removed", "script", "script element removed")
        elif e.name == "style":
            job.lose("partial", "style_element", "dropped", "head", "style sheet not imported")
        elif e.name == "meta" and (e.get("http-equiv") or "").lower() == "refresh":
            job.lose("unsupported", "active_content", "removed", "meta refresh", "meta refresh removed")
    out += reader.flow(body)
    return normalised(out), job
