"""Sanitizers: HTML fragments free of active content, and pasted HTML in three modes."""

from __future__ import annotations

import re
from html import escape

from parchment.sources.html import SCRIPT_URL, Comment, Element, parse

#: What is dropped with its contents, what pasted content may keep, and allowed URL schemes.
DROPPED = frozenset(("script", "style", "iframe", "object", "embed", "link", "meta"))
PASTE_DROPPED = frozenset("script style iframe object embed form input button select textarea".split())
STRUCTURE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code table thead tbody tr td th a img br hr figure figcaption".split())
FORMAT = frozenset("strong b em i u s del ins sub sup mark span".split())
KEPT_ATTRIBUTES = frozenset(("href", "src", "alt", "colspan", "rowspan", "start"))
LINK_SCHEMES, IMAGE_SCHEMES = ("http", "https", "mailto", "tel"), ("http", "https", "data")
BITMAP = re.compile(r"^data:image/(png|jpeg|jpg|gif|webp|avif|bmp|x-icon)[;,]", re.I)


def safe_url(url: str | None, kind: str = "link") -> bool:
    """Relative and scheme-less URLs are safe, others by scheme; data URIs only for bitmap images."""
    url = (url or "").strip()
    if not url:
        return False
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    if not scheme or url[0] in "#/.":
        return True
    name = scheme[1].lower()
    if name == "data":
        return kind == "image" and bool(BITMAP.match(url))
    return name in (IMAGE_SCHEMES if kind == "image" else LINK_SCHEMES)


def sanitize_fragment(html: str) -> tuple[str, bool]:
    """The fragment without active elements, handlers and script URLs, and whether anything went."""
    _, _, body = parse(f"<body>{html}")
    removed = False

    def clean(e: Element) -> None:
        nonlocal removed
        kept = []
        for c in e.children:
            if isinstance(c, Element):
                if c.name in DROPPED:
                    removed = True
                    continue
                bad = [k for k, v in c.attrs.items() if k.startswith("on") or k == "srcdoc" or SCRIPT_URL.match(v)]
                for k in bad:
                    del c.attrs[k]
                removed = removed or bool(bad)
                clean(c)
            kept.append(c)
        e.children = kept

    clean(body)
    return "".join(c.source() if isinstance(c, (Element, Comment)) else escape(c, quote=False) for c in body.children), removed


def sanitize_paste(html: str, mode: str = "keep") -> dict:
    """Pasted HTML by an allow-list: keep (structure and format), match (structure) or plain (text); with counts of what went."""
    _, _, body = parse(f"<body>{html}")
    stats = {"dropped": 0, "unwrapped": 0, "attributes": 0}
    allowed = {"keep": STRUCTURE | FORMAT, "match": STRUCTURE, "plain": frozenset()}[mode]

    def write(c) -> str:
        if isinstance(c, str):
            return escape(c, quote=False)
        if isinstance(c, Comment) or c.name in PASTE_DROPPED:
            stats["dropped"] += 1
            return ""
        inner = "".join(map(write, c.children))
        if c.name not in allowed:
            stats["unwrapped"] += 1
            return inner
        kept = {k: v for k, v in c.attrs.items() if k in KEPT_ATTRIBUTES and (k not in ("href", "src") or safe_url(v, "image" if k == "src" else "link"))}
        stats["attributes"] += len(c.attrs) - len(kept)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in sorted(kept.items()))
        return f"<{c.name}{attrs}>" if c.name in ("br", "hr", "img") else f"<{c.name}{attrs}>{inner}</{c.name}>"

    return {"html": "".join(map(write, body.children)), **stats}
