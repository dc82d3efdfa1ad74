"""Renderers: the node table to TXT, GitHub-flavoured Markdown and self-contained HTML.

A document is folded to a string inside one task; documents are independent, so the only exchange is by doc_id, and none
where a page goes from parser to renderer in one step (sources.importers.convert).
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from html import escape

from parchment.sources.sanitize import sanitize_fragment
from parchment.tree import Job, blocks, plain_block, plain_spans, spans

#: Words that appear in output; replace them to localise it.
LABELS = {"figure": "图", "attachment": "附件", "unshown": "未能显示的内容", "unknown": "未知内容", "footnotes": "脚注：", "rule": "─" * 10, "untitled": "未命名文档", "language": "zh-CN", "link": ("（", "）")}
#: Code points that take two columns.
WIDE = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6))
#: Blocks that carry their id in marked HTML.
MARKED = frozenset(
    "paragraph heading quote list code_block table figure image horizontal_rule page_break math_block callout embed unknown".split()
)
CSS = "body{font-family:sans-serif;line-height:1.6;max-width:48rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3rem .6rem}blockquote{border-left:3px solid #ccc;margin-left:0;padding-left:1rem}.callout{border:1px solid #999;padding:.5rem 1rem}.page-break{break-after:page}"


def visual_width(text: str) -> int:
    return sum(2 if any(a <= ord(c) <= b for a, b in WIDE) else 1 for c in text)


@dataclass
class Document:
    """What a renderer needs of a document."""

    nodes: list[dict]
    assets: list[dict] = field(default_factory=list)
    preserved: dict[str, bytes] = field(default_factory=dict)
    title: str | None = None
    language: str | None = None
    document_id: str | None = None

    def asset(self, ref: str | None) -> dict | None:
        m = re.match(r"asset://([^/]*)", ref or "")
        return next((a for a in self.assets if m and a["asset_id"] == m[1]), None)

    def url(self, ref: str | None) -> str:
        """An asset's external URL, or its bytes as a data URI; any other reference stands for itself."""
        a = self.asset(ref)
        if a is None:
            return ref or ""
        return a["url"] or f"data:{a['mime']};base64,{base64.b64encode(a['bytes'] or b'').decode()}"

    def filename(self, ref: str | None) -> str:
        a = self.asset(ref)
        return a["filename"] if a else ref or ""


class Txt:
    def __init__(self, doc: Document, job: Job) -> None:
        self.doc, self.job = doc, job
        order: dict[str, int] = {}
        for s in spans(doc.nodes):
            if s["type"] == "footnote_ref":
                order.setdefault(s.get("target_ref") or "", len(order) + 1)
        self.order = order

    def document(self) -> str:
        out = "".join(map(self.block, self.doc.nodes))
        defined = {b.get("node_id"): b for b in blocks(self.doc.nodes) if b["type"] == "footnote"}
        notes = [f"[{n}] {plain_block(defined[i])}\n" for i, n in sorted(self.order.items(), key=lambda x: x[1]) if i in defined]
        for n in blocks(self.doc.nodes):
            self.job.lose("preserved_raw" if n["type"] == "unknown" else "none", n["type"], "rendered")
        return out + (LABELS["footnotes"] + "\n" + "".join(notes) if notes else "")

    def spans(self, items: list[dict] | None) -> str:
        out = []
        for s in items or []:
            if s["type"] == "link":
                inner, (left, right) = self.spans(s.get("content")), LABELS["link"]
                out.append(inner if inner == s.get("url") or not s.get("url") else f"{inner}{left}{s['url']}{right}")
            elif "content" in s:
                out.append(self.spans(s["content"]))
            else:
                out.append(plain_spans([s]))
        return "".join(out)

    def block(self, n: dict) -> str:
        return getattr(self, "on_" + n["type"], lambda _: "")(n)

    def inside(self, n: dict) -> str:
        return "".join(map(self.block, n.get("children", [])))

    on_section = inside

    def on_heading(self, n: dict) -> str:
        text = self.spans(n.get("content"))
        return f"{text}\n{('=' if (n.get('level') or 1) <= 1 else '-') * max(1, visual_width(text))}\n\n"

    def on_paragraph(self, n: dict) -> str:
        text = self.spans(n.get("content"))
        return f"{text}\n\n" if text.strip() else ""

    def on_quote(self, n: dict) -> str:
        return "".join(f"  {line}\n" for line in self.inside(n).splitlines())

    def on_list(self, n: dict) -> str:
        out = []
        for i, item in enumerate(n.get("items", [])):
            lead = (f"{int(n.get('start') or 1) + i}. " if n.get("style") == "ordered" else "- ") + {True: "[x] ", False: "[ ] "}.get(item.get("checked"), "")
            lines = [line for c in item.get("children", []) for line in self.block(c).splitlines()] or [""]
            out.append(lead + lines[0])
            out.extend(" " * len(lead) + line if line else "" for line in lines[1:])
        return "".join(f"{line}\n" for line in out) + "\n"

    def on_code_block(self, n: dict) -> str:
        return "".join(f"  {line}\n" for line in (n.get("text") or "").splitlines()) + "\n"

    def on_table(self, n: dict) -> str:
        rows = [" / ".join(" ".join(plain_block(b) for b in c.get("children", [])) for c in r.get("cells", [])) for r in n.get("rows", [])]
        if n.get("header_row"):
            rows[:1] = [" / ".join(c.get("title") or "" for c in n.get("columns", []))]
        return "".join(f"{r}\n" for r in rows) + "\n"

    def on_image(self, n: dict) -> str:
        return f"[{LABELS['figure']}: {n.get('alt') or ''}]\n\n"

    def on_figure(self, n: dict) -> str:
        caption = self.spans(n.get("caption"))
        return f"[{LABELS['figure']}: {n.get('alt') or ''}]\n" + (f"{caption}\n" if caption else "") + "\n"

    def on_callout(self, n: dict) -> str:
        return f"[{(n.get('variant') or 'note').upper()}] " + "".join(self.block(c).rstrip("\n") for c in n.get("children", [])) + "\n\n"

    def on_math_block(self, n: dict) -> str:
        return f"{n.get('latex') or ''}\n\n"

    def on_horizontal_rule(self, n: dict) -> str:
        return LABELS["rule"] + "\n\n"

    def on_embed(self, n: dict) -> str:
        return f"[{LABELS['attachment']}: {self.doc.filename(n.get('asset'))}]\n\n"

    def on_unknown(self, n: dict) -> str:
        return f"[{LABELS['unshown']}: {n.get('summary') or LABELS['unknown']}]\n\n"


def escape_markdown(text: str) -> str:
    """Backslashes before what Markdown would take as markup."""
    return re.sub(r"([\\`*_\[\]<>#|~$!&])", r"\\\1", text)


def destination(url: str) -> str:
    """A link target; angle brackets where blanks or parentheses would end it."""
    return f"<{url.replace('<', '%3C').replace('>', '%3E')}>" if re.search(r"[\s()]", url) else url


class Markdown:
    VARIANTS = {"note": "NOTE", "tip": "TIP", "important": "IMPORTANT", "warning": "WARNING"}

    def __init__(self, doc: Document, job: Job) -> None:
        self.doc, self.job, self.labels, auto = doc, job, {}, 0
        self.notes = [b for b in blocks(doc.nodes) if b["type"] == "footnote"]
        for b in self.notes:
            if not b.get("label"):
                auto += 1
            self.labels[b.get("node_id")] = b.get("label") or str(auto)

    def document(self) -> str:
        out = "".join(map(self.block, self.doc.nodes))
        notes = (f"[^{self.labels[b.get('node_id')]}]: " + " ".join(self.block(c).rstrip() for c in b.get("children", [])) + "\n" for b in self.notes)
        return out + "".join(notes)

    def block(self, n: dict) -> str:
        made = getattr(self, "on_" + n["type"], None)
        if made is None:
            self.job.lose("partial", "markdown_fallback", "degraded", n["type"], "block of unknown type written as its contents")
            return self.inside(n)
        return made(n)

    def inside(self, n: dict) -> str:
        return "".join(self.block(c) for c in n.get("children", []))

    on_section = inside

    def on_heading(self, n: dict) -> str:
        return f"{'#' * int(n.get('level') or 1)} {self.spans(n.get('content'))}\n\n"

    def on_paragraph(self, n: dict) -> str:
        text = self.spans(n.get("content"))
        if re.match(r"(\d+)([.)])(\s|$)", text):
            text = re.sub(r"^(\d+)([.)])", r"\1\\\2", text)
        elif re.match(r"([-+=])", text):
            text = "\\" + text
        return f"{text}\n\n" if text.strip() else ""

    @staticmethod
    def quoted(text: str) -> str:
        return "".join(f"> {line}\n" if line else ">\n" for line in text.rstrip("\n").split("\n")) + "\n"

    def on_quote(self, n: dict) -> str:
        return self.quoted(self.inside(n))

    def on_callout(self, n: dict) -> str:
        return f"> [!{self.VARIANTS.get(n.get('variant') or 'note', 'NOTE')}]\n" + self.quoted(self.inside(n))

    def on_list(self, n: dict) -> str:
        out = []
        for i, item in enumerate(n.get("items", [])):
            marker = f"{int(n.get('start') or 1) + i}. " if n.get("style") == "ordered" else "- "
            check = {True: "[x] ", False: "[ ] "}.get(item.get("checked"), "")
            body = "\n".join(self.block(c).rstrip("\n") + ("\n" if k + 1 < len(item["children"]) and c["type"] == item["children"][k + 1]["type"] == "paragraph" else "") for k, c in enumerate(item.get("children", [])))
            lines = body.split("\n")
            out.append(f"{marker}{check}{lines[0]}\n")
            out.extend(f"{' ' * len(marker)}{line}\n" if line else "\n" for line in lines[1:])
        return "".join(out) + "\n"

    def on_code_block(self, n: dict) -> str:
        text = n.get("text") or ""
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
        return f"{fence}{n.get('language') or ''}\n{text}{'' if text.endswith(chr(10)) else chr(10)}{fence}\n\n"

    def on_table(self, n: dict) -> str:
        cells = [c for r in n.get("rows", []) for c in r.get("cells", [])]
        if any((c.get("col_span") or 1) > 1 or (c.get("row_span") or 1) > 1 for c in cells):
            self.job.lose("partial", "merged_cell", "degraded", "table", "merged cells written as plain ones")
        rows = [["".join(self.block(b).strip() for b in c.get("children", [])).replace("\n", " ") for c in r.get("cells", [])] for r in n.get("rows", [])]
        names = [c.get("title") or "" for c in n.get("columns", [])]
        if not n.get("header_row") or not rows:
            rows.insert(0, names)
        width = max(1, *(len(r) for r in rows))
        lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
        lines.insert(1, "|" + " --- |" * width)
        return "".join(f"{line}\n" for line in lines) + "\n"

    def on_figure(self, n: dict) -> str:
        caption = self.spans(n.get("caption"))
        if caption.strip():
            self.job.lose("partial", "figure_caption", "degraded", caption, "caption written in italics")
        return self.on_image(n).rstrip("\n") + "\n" + (f"*{caption}*\n" if caption.strip() else "") + "\n"

    def on_image(self, n: dict) -> str:
        return f"![{n.get('alt') or ''}]({destination(self.doc.url(n.get('asset')))})\n\n"

    def on_horizontal_rule(self, n: dict) -> str:
        return "---\n\n"

    def on_page_break(self, n: dict) -> str:
        self.job.lose("partial", "page_break", "dropped", "page_break", "Markdown has no page breaks")
        return ""

    def on_math_block(self, n: dict) -> str:
        return f"$${n.get('latex') or ''}$$\n\n"

    def on_footnote(self, n: dict) -> str:
        return ""

    def on_embed(self, n: dict) -> str:
        self.job.lose("partial", "embed", "degraded", n.get("asset") or "", "embed written as a link")
        return f"[{self.doc.filename(n.get('asset'))}]({destination(self.doc.url(n.get('asset')))})\n\n"

    def on_unknown(self, n: dict) -> str:
        self.job.lose("preserved_raw", "unknown_block", "preserved", n.get("payload_ref") or "", "written as a comment")
        return f"<!-- unsupported {n.get('summary') or ''}, see {n.get('payload_ref') or ''} -->\n\n"

    def spans(self, items: list[dict] | None) -> str:
        return "".join(map(self.span, items or []))

    def span(self, s: dict) -> str:
        kind = s["type"]
        inner = lambda: self.spans(s.get("content"))
        if kind == "text":
            return escape_markdown(s.get("text") or "")
        if kind == "hard_break":
            return "\\\n"
        if kind == "code":
            text = s.get("text") or ""
            ticks = "`" * (1 + text.count("`"))
            pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
            return f"{ticks}{pad}{text}{pad}{ticks}"
        if kind in ("em", "strong", "strike"):
            mark = {"em": "*", "strong": "**", "strike": "~~"}[kind]
            return f"{mark}{inner()}{mark}"
        if kind == "link":
            title = f' "{s["title"].replace(chr(34), chr(39))}"' if s.get("title") else ""
            return f"[{inner()}]({destination(s.get('url') or '')}{title})"
        if kind == "inline_math":
            return f"${s.get('latex') or ''}$"
        if kind == "inline_image":
            return f"![{s.get('alt') or ''}]({destination(self.doc.url(s.get('asset')))})"
        if kind == "footnote_ref":
            label = self.labels.get(s.get("target_ref"))
            return f"[^{label}]" if label else ""
        if kind == "unknown":
            self.job.lose("preserved_raw", "unknown_span", "preserved", s.get("payload_ref") or "", "left out, kept in the container")
            return ""
        if kind in ("underline", "mention", "cite"):
            self.job.lose("partial", kind, "degraded", s.get("target_ref") or kind, f"{kind} written as plain text")
        return s.get("target_ref") or "" if kind in ("mention", "cite") else inner()


class Html:
    def __init__(self, doc: Document, job: Job, marked: bool = False) -> None:
        self.doc, self.job, self.marked = doc, job, marked
        notes = {b.get("node_id"): b for b in reversed(list(blocks(doc.nodes))) if b["type"] == "footnote"}
        self.notes = list(reversed(notes.values()))
        self.number = {b.get("node_id"): i + 1 for i, b in enumerate(self.notes)}

    def document(self) -> str:
        lineage = f'<meta name="document-id" content="{escape(self.doc.document_id)}">\n' if self.doc.document_id else ""
        body = "".join(map(self.block, self.doc.nodes))
        notes = "".join(
            f'<li id="fn-{b.get("node_id")}">{self.inside(b).rstrip()} <a href="#fnref-{b.get("node_id")}">&#8617;</a></li>\n' for b in self.notes
        )
        return (
            f'<!doctype html>\n<html lang="{escape(self.doc.language or LABELS["language"])}">\n<head>\n<meta charset="utf-8">\n'
            f'<meta name="viewport" content="width=device-width, initial-scale=1">\n{lineage}'
            f"<title>{escape(self.doc.title or LABELS['untitled'], quote=False)}</title>\n<style>{CSS}</style>\n</head>\n<body>\n<article>\n{body}"
            + (f'<section class="footnotes">\n<ol>\n{notes}</ol>\n</section>\n' if notes else "")
            + "</article>\n</body>\n</html>\n"
        )

    def block(self, n: dict) -> str:
        made = getattr(self, "on_" + n["type"], None)
        if made is None:
            self.job.lose("partial", "html_fallback", "degraded", n["type"], "block of unknown type written as its contents")
            return self.inside(n)
        out = made(n)
        if self.marked and n["type"] in MARKED and n.get("node_id") and out.startswith("<"):
            at = out.index(">")
            out = f'{out[:at]} data-block-id="{escape(n["node_id"])}"{out[at:]}'
        return out

    def inside(self, n: dict) -> str:
        return "".join(self.block(c) for c in n.get("children", []))

    on_section = inside

    def on_heading(self, n: dict) -> str:
        level = int(n.get("level") or 1)
        return f'<h{level} id="{n.get("node_id") or ""}">{self.spans(n.get("content"))}</h{level}>\n'

    def on_paragraph(self, n: dict) -> str:
        text = self.spans(n.get("content"))
        return f"<p>{text}</p>\n" if text.strip() else ""

    def on_quote(self, n: dict) -> str:
        return f"<blockquote>\n{self.inside(n)}</blockquote>\n"

    def on_list(self, n: dict) -> str:
        tag, out = ("ol" if n.get("style") == "ordered" else "ul"), []
        for item in n.get("items", []):
            box = "" if item.get("checked") is None else f'<input type="checkbox" disabled{" checked" if item["checked"] else ""}> '
            parts = item.get("children", [])
            first = [self.spans(parts[0].get("content")) + "\n"] if parts and parts[0]["type"] == "paragraph" else []
            out.append(f"<li>{(box + ''.join(first + [self.block(c) for c in parts[len(first) :]])).rstrip()}</li>\n")
        start = f' start="{int(n["start"])}"' if n.get("start") not in (None, 1) else ""
        return f"<{tag}{start}>\n{''.join(out)}</{tag}>\n"

    def on_code_block(self, n: dict) -> str:
        language = f' class="language-{escape(n["language"])}"' if n.get("language") else ""
        return f"<pre><code{language}>{escape(n.get('text') or '', quote=False)}</code></pre>\n"

    def on_table(self, n: dict) -> str:
        head, body = "", []
        for i, row in enumerate(n.get("rows", [])):
            tag = "th" if i == 0 and n.get("header_row") else "td"
            cells = ""
            for c in row.get("cells", []):
                spans_ = "".join(f' {k}span="{int(c[f"{k}_span"])}"' for k in ("col", "row") if (c.get(f"{k}_span") or 1) > 1)
                cells += f"<{tag}{spans_}>{self.inside(c).rstrip()}</{tag}>"
            if tag == "th":
                head = f"<thead>\n<tr>{cells}</tr>\n</thead>\n"
            else:
                body.append(f"<tr>{cells}</tr>\n")
        return f"<table>\n{head}{''.join(body)}</table>\n"

    def on_figure(self, n: dict) -> str:
        caption = self.spans(n.get("caption"))
        shown = f"<figcaption>{caption}</figcaption>\n" if caption else ""
        return f'<figure><img src="{escape(self.doc.url(n.get("asset")))}" alt="{escape(n.get("alt") or "")}">{shown}</figure>\n'

    def on_image(self, n: dict) -> str:
        return f'<p><img src="{escape(self.doc.url(n.get("asset")))}" alt="{escape(n.get("alt") or "")}"></p>\n'

    def on_horizontal_rule(self, n: dict) -> str:
        return "<hr>\n"

    def on_page_break(self, n: dict) -> str:
        return '<div class="page-break"></div>\n'

    def on_math_block(self, n: dict) -> str:
        latex = n.get("latex") or ""
        self.job.lose("degraded", "math", "degraded", latex, "formula written as text")
        return f'<p class="math" data-latex="{escape(latex)}">{escape(latex, quote=False)}</p>\n'

    def on_callout(self, n: dict) -> str:
        return f'<div class="callout" data-variant="{escape(n.get("variant") or "note")}">{self.inside(n)}</div>\n'

    def on_footnote(self, n: dict) -> str:
        return ""

    def on_embed(self, n: dict) -> str:
        found, url = self.doc.asset(n.get("asset")), escape(self.doc.url(n.get("asset")))
        family = (found["mime"] if found else "").split("/")[0]
        if family == "image":
            return f'<p><img src="{url}" alt=""></p>\n'
        if family in ("video", "audio"):
            return f'<p><{family} controls src="{url}"></{family}></p>\n'
        self.job.lose("partial", "embed", "degraded", n.get("asset") or "", "embed written as a link")
        return f'<p><a href="{url}">{escape(self.doc.filename(n.get("asset")), quote=False)}</a></p>\n'

    def on_unknown(self, n: dict) -> str:
        summary, ref = n.get("summary") or "", n.get("payload_ref") or ""
        payload = self.doc.preserved.get(ref)
        if payload is None:
            self.job.lose("preserved_raw", "unknown_block", "preserved", ref, "written as a placeholder")
            return f'<div class="unknown" data-unknown="{escape(summary)}">[{LABELS["unshown"]}: {escape(summary, quote=False)}]</div>\n'
        clean, removed = sanitize_fragment(payload.decode("utf-8", "replace"))
        if removed:
            self.job.lose("unsupported", "active_content", "removed", ref, "active content removed from a kept payload")
        return f'<div data-unknown="{escape(summary)}">{clean}</div>\n'

    def spans(self, items: list[dict] | None) -> str:
        return "".join(map(self.span, items or []))

    TAGS = {"em": "em", "strong": "strong", "underline": "u", "strike": "s"}

    def span(self, s: dict) -> str:
        kind = s["type"]
        if kind == "text":
            return escape(s.get("text") or "", quote=False)
        if kind == "hard_break":
            return "<br>"
        if kind == "code":
            return f"<code>{escape(s.get('text') or '', quote=False)}</code>"
        if kind in self.TAGS:
            return f"<{self.TAGS[kind]}>{self.spans(s.get('content'))}</{self.TAGS[kind]}>"
        if kind == "link":
            title = f' title="{escape(s["title"])}"' if s.get("title") else ""
            return f'<a href="{escape(s.get("url") or "")}"{title}>{self.spans(s.get("content"))}</a>'
        if kind == "inline_math":
            self.job.lose("degraded", "math", "degraded", s.get("latex") or "", "formula written as text")
            return f'<span class="math" data-latex="{escape(s.get("latex") or "")}">{escape(s.get("latex") or "", quote=False)}</span>'
        if kind == "inline_image":
            return f'<img src="{escape(self.doc.url(s.get("asset")))}" alt="{escape(s.get("alt") or "")}">'
        if kind == "footnote_ref":
            ref = s.get("target_ref")
            n = self.number.get(ref)
            return f'<sup id="fnref-{ref}"><a href="#fn-{ref}">{n}</a></sup>' if n else ""
        if kind in ("mention", "cite"):
            self.job.lose("partial", kind, "degraded", s.get("target_ref") or "", f"{kind} written as plain text")
            return escape(s.get("target_ref") or "", quote=False)
        if kind == "unknown":
            self.job.lose("preserved_raw", "unknown_span", "preserved", s.get("payload_ref") or "", "left out, kept in the container")
            return ""
        return self.spans(s.get("content"))


RENDERERS = {"text": Txt, "markdown": Markdown, "html": Html}


def render(doc: Document, fmt: str, **options) -> tuple[str, Job]:
    """A document in text, markdown or html, and what was lost."""
    job = Job()
    return RENDERERS[fmt](doc, job, **options).document(), job
