"""Markdown reader: CommonMark blocks and inlines with tables, task lists, strikethrough, autolinks, footnotes, alerts,
dollar math and front matter.

Blocks are found by recursive descent over lines: a container strips its prefix and hands the lines inside to the same
function. Inlines are scanned once into tokens; emphasis is resolved on the delimiter stack as CommonMark describes it.
"""

from __future__ import annotations

import re
from html import unescape

from parchment.functions.assets import guess_mime
from parchment.sources.html import decode_data_uri
from parchment.tree import Job, merged, normalised, plain_spans, text_span, wrapped

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))([ \t]+|$)")
TASK = re.compile(r"\[([ xX])\](?:[ \t]+|$)")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
DEFINITION = re.compile(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*(<[^>]*>|\S+)(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?[ \t]*$")
ALERT = re.compile(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*$", re.I)
DIVIDER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
HTML_BLOCK = re.compile(
    r" {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|body|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))",
    re.I,
)
INLINE_HTML = re.compile(r"<(?:!--.*?-->|/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?)>", re.S)
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+)>")
BARE = re.compile(r"(?:https?://|www\.)[^\s<]+")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
MATH = re.compile(r"\$\$(?!\$)([^$]+)\$\$(?!\$)|\$(?![\s\d$])((?:[^$\\\n]|\\.)*?[^\s$\\])\$(?![\d$])", re.S)
DOLLARS = re.compile(r"\$+")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")


class Reader:
    def __init__(self, job: Job) -> None:
        self.job, self.references, self.notes, self.defined = job, {}, {}, set()

    # blocks

    def blocks(self, lines: list[str]) -> list[dict]:
        out, text, i = [], [], 0

        def flush() -> None:
            if text:
                out.extend(self.paragraph(text))
                text.clear()

        while i < len(lines):
            line = lines[i]
            if not line.strip():
                flush()
                i += 1
                continue
            if text and (m := SETEXT.match(line)) and not (m[1][0] == "-" and RULE.match(line) and ITEM.match(line)):
                out.append(self.heading(1 if m[1][0] == "=" else 2, "\n".join(x.strip() for x in text)))
                text.clear()
                i += 1
                continue
            if (m := HEADING.match(line)) and not line.startswith("    "):
                flush()
                out.append(self.heading(len(m[1]), m[2] or ""))
                i += 1
                continue
            if RULE.match(line):
                flush()
                self.job.lose("none", "horizontal_rule", "mapped")
                out.append({"type": "horizontal_rule", "node_id": self.job.uid("blk")})
                i += 1
                continue
            if m := FENCE.match(line):
                flush()
                i += 1
                body = []
                while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", lines[i]):
                    body.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[i]))
                    i += 1
                i += 1
                out.append(self.code("\n".join(body), (m[3].split() or [None])[0]))
                continue
            if line.startswith("    ") and not text:
                body = []
                while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                    body.append(lines[i][4:])
                    i += 1
                out.append(self.code("\n".join(body).rstrip("\n"), None))
                continue
            if QUOTE.match(line):
                flush()
                body = []
                while i < len(lines) and lines[i].strip() and (QUOTE.match(lines[i]) or (body and body[-1].strip() and not self._starts(lines[i]))):
                    body.append(QUOTE.sub("", lines[i], count=1))
                    i += 1
                out.append(self.quote(body))
                continue
            if (m := ITEM.match(line)) and (not text or (line[m.end() :].strip() and m[3] in (None, "1"))):
                flush()
                node, i = self.list(lines, i)
                out.append(node)
                continue
            if (m := NOTE.match(line)) and not text:
                body, i = [line[m.end() :]], i + 1
                while i < len(lines) and (lines[i].startswith("    ") or (lines[i].strip() and body[-1].strip() and not self._starts(lines[i]) and not NOTE.match(lines[i]))):
                    body.append(lines[i][4:] if lines[i].startswith("    ") else lines[i])
                    i += 1
                self.defined.add(m[1])
                self.job.lose("none", "footnote", "mapped")
                out.append({"type": "footnote", "node_id": self.note(m[1]), "label": m[1], "children": self.blocks(body)})
                continue
            if line.strip().startswith("$$") and not text:
                body = line.strip()[2:]
                i += 1
                while not body.rstrip().endswith("$$") and i < len(lines):
                    body += "\n" + lines[i]
                    i += 1
                self.job.lose("none", "math_block", "mapped")
                out.append({"type": "math_block", "node_id": self.job.uid("blk"), "latex": body.rstrip().removesuffix("$$").strip()})
                continue
            if HTML_BLOCK.match(line) and not text:
                body = []
                comment = line.lstrip().startswith("<!--")
                while i < len(lines) and (comment or lines[i].strip()):
                    body.append(lines[i])
                    i += 1
                    if comment and "-->" in body[-1]:
                        break
                ref = self.job.keep("markdown", "html", "\n".join(body).encode())
                self.job.lose("preserved_raw", "html_block", "preserved", ref, "HTML block kept as it was")
                out.append(self.job.unknown("markdown", "HTML block", ref))
                continue
            if text and len(text) == 1 and "|" in text[0] and DIVIDER.match(line) and len(cells(text[0])) == len(cells(line)):
                header = text.pop()
                i += 1
                rows = []
                while i < len(lines) and lines[i].strip() and not self._starts(lines[i]):
                    rows.append(cells(lines[i]))
                    i += 1
                out.append(self.table(cells(header), rows))
                continue
            text.append(line)
            i += 1
        flush()
        return out

    @staticmethod
    def _starts(line: str) -> bool:
        return bool(HEADING.match(line) or RULE.match(line) or FENCE.match(line) or QUOTE.match(line) or ITEM.match(line))

    def note(self, label: str) -> str:
        if label not in self.notes:
            self.notes[label] = self.job.uid("blk")
        return self.notes[label]

    def heading(self, level: int, text: str) -> dict:
        self.job.lose("none", "heading", "mapped")
        return {"type": "heading", "node_id": self.job.uid("blk"), "level": level, "content": self.inlines(text.strip())}

    def code(self, text: str, language: str | None) -> dict:
        self.job.lose("none", "code_block", "mapped")
        return {"type": "code_block", "node_id": self.job.uid("blk"), "text": text, "language": language}

    def paragraph(self, lines: list[str]) -> list[dict]:
        spans = self.inlines("\n".join([x.lstrip() for x in lines]).rstrip())
        solid = [s for s in spans if s["type"] != "text" or s["text"].strip()]
        if len(solid) == 1 and solid[0]["type"] == "inline_image":
            self.job.lose("none", "figure", "mapped")
            return [{"type": "figure", "node_id": self.job.uid("blk"), "asset": solid[0]["asset"], "alt": solid[0]["alt"], "caption": []}]
        if not solid:
            return []
        self.job.lose("none", "paragraph", "mapped")
        return [{"type": "paragraph", "node_id": self.job.uid("blk"), "content": spans}]

    def quote(self, lines: list[str]) -> dict:
        if m := ALERT.match(lines[0].strip()):
            variant = m[1].lower()
            if variant == "caution":
                variant = "warning"
                self.job.lose("partial", "alert_caution", "mapped", "caution", "caution becomes a warning")
            self.job.lose("none", "callout", "mapped")
            return {"type": "callout", "node_id": self.job.uid("blk"), "variant": variant, "children": self.blocks(lines[1:])}
        self.job.lose("none", "quote", "mapped")
        return {"type": "quote", "node_id": self.job.uid("blk"), "children": self.blocks(lines)}

    def list(self, lines: list[str], i: int) -> tuple[dict, int]:
        first = ITEM.match(lines[i])
        kind = first[4] or first[2]
        node = {"type": "list", "node_id": self.job.uid("blk"), "style": "ordered" if first[3] else "bullet", "items": []}
        if first[3] and int(first[3]) != 1:
            node["start"] = int(first[3])
        self.job.lose("none", "list", "mapped")
        while i < len(lines) and (m := ITEM.match(lines[i])) and (m[4] or m[2]) == kind and not RULE.match(lines[i]):
            wide = len(m[5].expandtabs(4))
            indent = len(m[1]) + len(m[2]) + (wide if 1 <= wide <= 4 else 1)
            body, i = [lines[i][m.end() :] if wide <= 4 else " " * (wide - 1) + lines[i][m.end() :]], i + 1
            while i < len(lines):
                line = lines[i]
                if line.strip() and len(line) - len(line.lstrip(" ")) >= indent:
                    body.append(line[indent:])
                elif not line.strip():
                    if not any(x.strip() for x in body) or i + 1 >= len(lines):
                        break
                    body.append("")
                elif body[-1].strip() and not self._starts(line):
                    body.append(line.lstrip())
                else:
                    break
                i += 1
            item = {"type": "item", "node_id": self.job.uid("li")}
            if t := TASK.match(body[0]):
                item["checked"], body[0] = t[1] != " ", body[0][t.end() :]
            while body and not body[-1].strip():
                body.pop()
            item["children"] = self.blocks(body)
            node["items"].append(item)
            while i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and ITEM.match(lines[i + 1]):
                i += 1
        return node, i

    def table(self, header: list[str], rows: list[list[str]]) -> dict:
        self.job.lose("none", "table", "mapped")
        width, made, names = len(header), [], []
        for r in [header, *rows]:
            row = {"type": "row", "node_id": self.job.uid("row"), "cells": []}
            for j, text in enumerate((r + [""] * width)[:width]):
                spans = self.inlines(text)
                if not made:
                    names.append(plain_spans(spans))
                block = {"type": "paragraph", "node_id": self.job.uid("blk"), "content": spans}
                row["cells"].append({"type": "cell", "node_id": self.job.uid("cel"), "col": j, "children": [block] if spans else []} | ({"role": "header"} if not made else {}))
            made.append(row)
        columns = [{"type": "column", "node_id": self.job.uid("col"), "title": n} for n in names]
        return {"type": "table", "node_id": self.job.uid("blk"), "header_row": True, "columns": columns, "rows": made}

    # spans

    def image(self, url: str, alt: str) -> dict:
        if found := decode_data_uri(url):
            ref = self.job.asset(f"image.{found[0].split('/')[-1].split('+')[0]}", *found)
        else:
            if not re.match(r"https?://", url):
                self.job.lose("partial", "image_missing", "external", url, "file is not at hand; kept as an external reference")
            name = url.split("?")[0].rstrip("/").rsplit("/", 1)[-1] or "image"
            ref = self.job.asset(name, guess_mime(name), url=url)
        return {"type": "inline_image", "asset": ref, "alt": alt}

    def inlines(self, text: str) -> list[dict]:
        """Spans of a text."""
        tokens: list[dict] = []
        plain: list[str] = []
        i, n = 0, len(text)

        def flush() -> None:
            if plain:
                tokens.append(text_span(unescape("".join(plain))))
                plain.clear()

        def add(span: dict, to: int) -> None:
            nonlocal i
            flush()
            tokens.append(span)
            i = to

        while i < n:
            c = text[i]
            if c == "\\":
                if i + 1 < n and text[i + 1] == "\n":
                    add({"type": "hard_break"}, i + 2)
                elif m := ESCAPED.match(text, i):
                    flush()
                    tokens.append(text_span(m[1]))
                    i += 2
                else:
                    plain.append(c)
                    i += 1
            elif c == "\n":
                if plain and plain[-1] == " " and len(plain) > 1 and plain[-2] == " ":
                    while plain and plain[-1] == " ":
                        plain.pop()
                    add({"type": "hard_break"}, i + 1)
                else:
                    while plain and plain[-1] == " ":
                        plain.pop()
                    plain.append(" ")
                    i += 1
                    while i < n and text[i] == " ":
                        i += 1
            elif c == "`":
                run = re.compile("`+").match(text, i)[0]
                end = next((m for m in re.finditer("`+", text[i + len(run) :]) if m[0] == run), None)
                if end is None:
                    plain.append(run)
                    i += len(run)
                else:
                    inner = text[i + len(run) : i + len(run) + end.start()].replace("\n", " ")
                    if len(inner) > 1 and inner[0] == inner[-1] == " " and inner.strip():
                        inner = inner[1:-1]
                    add({"type": "code", "text": inner}, i + len(run) + end.end())
            elif c == "<":
                if m := AUTO.match(text, i):
                    url = m[1] if ":" in m[1].split("@")[0] or "@" not in m[1] else f"mailto:{m[1]}"
                    add({"type": "link", "url": url, "content": [text_span(m[1])]}, m.end())
                elif m := INLINE_HTML.match(text, i):
                    ref = self.job.keep("markdown", "html", m[0].encode())
                    self.job.lose("preserved_raw", "html_inline", "preserved", ref, "inline HTML kept as it was")
                    add(self.job.unknown("markdown", "inline HTML", ref), m.end())
                else:
                    plain.append(c)
                    i += 1
            elif c == "$":
                if m := MATH.match(text, i):
                    add({"type": "inline_math", "latex": m[1] or m[2]}, m.end())
                else:
                    run = DOLLARS.match(text, i)[0]
                    plain.append(run)
                    i += len(run)
            elif c == "[" and (m := re.compile(r"\[\^([^\]\s]+)\]").match(text, i)):
                add({"type": "footnote_ref", "target_ref": self.note(m[1]), "label": m[1]}, m.end())
            elif c == "[" or (c == "!" and text[i + 1 : i + 2] == "["):
                start = i + (c == "!")
                found = self._link(text, start)
                if found is None:
                    plain.append(text[i : start + 1])
                    i = start + 1
                else:
                    inner, url, title, end = found
                    if c == "!":
                        add(self.image(url, plain_spans(self.inlines(inner))), end)
                    else:
                        add({"type": "link", "url": url, "title": title, "content": self.inlines(inner)}, end)
            elif c in "*_~":
                run = re.compile(re.escape(c) + "+").match(text, i)[0]
                before, after = text[i - 1] if i else " ", text[i + len(run)] if i + len(run) < n else " "
                left = not after.isspace() and (not PUNCTUATION.match(after) or before.isspace() or bool(PUNCTUATION.match(before)))
                right = not before.isspace() and (not PUNCTUATION.match(before) or after.isspace() or bool(PUNCTUATION.match(after)))
                if c == "_":
                    left, right = left and (not right or bool(PUNCTUATION.match(before))), right and (not left or bool(PUNCTUATION.match(after)))
                if c == "~" and len(run) > 2:
                    left = right = False
                flush()
                tokens.append({"type": "run", "mark": c, "n": len(run), "all": len(run), "opens": left, "closes": right})
                i += len(run)
            elif c in "hw" and (not i or not text[i - 1].isalnum()) and (m := BARE.match(text, i)):
                url = m[0].rstrip("?!.,:*_~'\"")
                while url.endswith(")") and url.count(")") > url.count("("):
                    url = url[:-1]
                add({"type": "link", "url": url if url.startswith("http") else f"http://{url}", "content": [text_span(url)]}, i + len(url))
            else:
                plain.append(c)
                i += 1
        flush()
        return merged(self._emphasis(tokens))

    def _link(self, text: str, i: int) -> tuple[str, str, str | None, int] | None:
        """Of a bracket at i: what it holds, target, title and where the link ends."""
        depth, j = 0, i
        while j < len(text):
            if text[j] == "\\":
                j += 1
            elif text[j] == "[":
                depth += 1
            elif text[j] == "]":
                depth -= 1
                if not depth:
                    break
            j += 1
        if j >= len(text):
            return None
        inner = text[i + 1 : j]
        m = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(([^()]*)\)))?\s*\)", re.S).match(text, j + 1)
        if m:
            clean = lambda s: unescape(ESCAPED.sub(r"\1", s))
            title = next((t for t in m.groups()[2:] if t is not None), None)
            return inner, clean(m[1] if m[1] is not None else m[2] or ""), clean(title) if title is not None else None, m.end()
        m = re.compile(r"\[([^\]]*)\]").match(text, j + 1)
        key = " ".join((m[1] if m and m[1] else inner).lower().split())
        if key in self.references:
            return inner, *self.references[key], m.end() if m else j + 1
        return None

    @staticmethod
    def _emphasis(tokens: list[dict]) -> list[dict]:
        i = 0
        while i < len(tokens):
            closer = tokens[i]
            if closer["type"] != "run" or not closer["closes"] or not closer["n"]:
                i += 1
                continue
            for j in range(i - 1, -1, -1):
                opener = tokens[j]
                if opener["type"] != "run" or opener["mark"] != closer["mark"] or not opener["opens"] or not opener["n"]:
                    continue
                odd = (opener["closes"] or closer["opens"]) and (opener["all"] + closer["all"]) % 3 == 0 and (opener["all"] % 3 or closer["all"] % 3)
                if closer["mark"] == "~":
                    if opener["n"] != closer["n"]:
                        continue
                    used, kind = opener["n"], "strike"
                elif odd:
                    continue
                else:
                    used = 2 if opener["n"] >= 2 and closer["n"] >= 2 else 1
                    kind = "strong" if used == 2 else "em"
                inside = [text_span(t["mark"] * t["n"]) if t["type"] == "run" else t for t in tokens[j + 1 : i]]
                opener["n"] -= used
                closer["n"] -= used
                tokens[j + 1 : i] = [{"type": kind, "content": merged(inside)}]
                i = j + 2
                break
            else:
                i += 1
        return [text_span(t["mark"] * t["n"]) if t["type"] == "run" else t for t in tokens]


def cells(line: str) -> list[str]:
    """Cells of a table row; an escaped bar is text."""
    line = line.strip().removeprefix("|")
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def front_matter(lines: list[str], job: Job) -> list[str]:
    """Lines after a leading --- block of key: value; title and language are the document's, the rest goes to its extra."""
    if not lines or lines[0].rstrip() != "---":
        return lines
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), None)
    if end is None:
        return lines
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        value = value.strip().strip("\"'")
        if not colon or not key.strip():
            continue
        if key.strip() == "title":
            job.title = value
        elif key.strip() in ("language", "lang"):
            job.language = value
        else:
            job.extra[key.strip()] = value
    return lines[end + 1 :]


def read_markdown(text: str) -> tuple[list[dict], Job]:
    """The tree of a Markdown text, with sections from its headings, and what its import gathered."""
    job = Job()
    reader = Reader(job)
    lines = front_matter((text or "").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"), job)
    fenced, kept = None, []
    for line in lines:
        m = FENCE.match(line)
        if m and (fenced is None or m[2].startswith(fenced)):
            fenced = None if fenced else m[2]
        elif fenced is None and (d := DEFINITION.match(line)):
            reader.references.setdefault(" ".join(d[1].lower().split()), (d[2].strip("<>"), next((t for t in d.groups()[2:] if t), None)))
            continue
        kept.append(line)
    found = reader.blocks(kept)
    # definitions of footnotes stand at the end, wherever they were written
    found.sort(key=lambda b: b["type"] == "footnote")
    return normalised(wrapped(found, job)), job
