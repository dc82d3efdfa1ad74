"""Readers and renderers on small documents of our own, one for each rule."""

import pytest

from parchment.operators.render import Document, render
from parchment.sources import editor
from parchment.sources.html import read_html
from parchment.sources.markdown import read_markdown
from parchment.sources.pandoc import read_pandoc, write_pandoc
from parchment.sources.sanitize import safe_url, sanitize_fragment, sanitize_paste
from parchment.tree import SLOTS, flatten, plain_block, unflatten

MARKDOWN = """---
title: A report
lang: en
project: x
---

# Top

Some *em*, **strong**, ~~gone~~, `code` and [a link](https://example.com "T").
A second line.\\
After a break, $x^2$ and 5 $ and $19.

## Lists

- one
- two
  - nested

3. three
4. four

- [x] done
- [ ] open

> quoted
> lines

> [!CAUTION]
> hot

```py
a = "```"
```

| a | b |
| - | - |
| 1 | 2\\|3 |

---

![alt](https://example.com/i.png)

Note[^n].

[^n]: The note.
"""


def bare(nodes):
    out = []
    for n in nodes:
        n = {k: v for k, v in n.items() if k not in ("node_id", "asset", "target_ref") and v is not None}
        for s in SLOTS:
            if s in n:
                n[s] = bare(n[s])
        out.append(n)
    return out


def types(nodes):
    return [r["type"] for r in flatten(nodes) if r["kind"] == "block"]


def lost(job):
    return sorted((e["feature"], e["loss_class"]) for e in job.loss if e["loss_class"] != "none")


def test_markdown_structure():
    nodes, job = read_markdown(MARKDOWN)
    assert (job.title, job.language, job.extra) == ("A report", "en", {"project": "x"})
    assert types(nodes) == [
        "section", "heading", "paragraph", "section", "heading", "list", "paragraph", "paragraph", "list", "paragraph", "list", "paragraph", "paragraph", "list", "paragraph", "paragraph",
        "quote", "paragraph", "callout", "paragraph", "code_block", "table", *["paragraph"] * 4, "horizontal_rule", "figure", "paragraph", "footnote", "paragraph",
    ]
    assert lost(job) == [("alert_caution", "partial")]


def test_markdown_round_trip_keeps_the_tree():
    nodes, job = read_markdown(MARKDOWN)
    text, _ = render(Document(nodes, job.assets), "markdown")
    assert bare(read_markdown(text)[0]) == bare(nodes)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a <b>x</b>", [("html_inline", "preserved_raw")] * 2),
        ("<div>\nx\n</div>", [("html_block", "preserved_raw")]),
        ("<!-- c -->", [("html_block", "preserved_raw")]),
        ("![x](gone.png)", [("image_missing", "partial")]),
    ],
)
def test_markdown_losses(text, expected):
    assert lost(read_markdown(text)[1]) == expected


def test_txt_layout():
    nodes, _ = read_markdown("# 标题\n\ntext [l](http://u)\n\n1. a\n   - b\n\n| h |\n| - |\n| c |\n")
    assert render(Document(nodes), "text")[0] == "标题\n====\n\ntext l（http://u）\n\n1. a\n\n   - b\n\n\n\nh\nc\n\n"


HTML = """<!doctype html><html><head><title> A  page </title><style>x</style><script>1</script></head><body><nav>n</nav><!-- c -->
<h2>H</h2><p>one <b>bold<p>two</b> three<br>four<ul><li>a<ul><li>b</ul><li>c</ul>
<table><tr><th colspan=2>h<tr><td>1<td rowspan=2>2</table>
<figure><img src="https://e.com/i.png" alt=A><figcaption>cap</figcaption></figure>
<p onclick=x><a href="javascript:1">bad</a> <mark>m</mark><sub>s</sub></p><x-y>custom</x-y><pre><code class="language-js">a &lt; b
</code></pre><div class="page-break"></div><hr></body></html>"""


def test_html_structure_and_losses():
    nodes, job = read_html(HTML)
    assert job.title == "A page"
    assert types(nodes) == [
        "unknown", "unknown", "heading", "paragraph", "paragraph", "list", "paragraph", "list", "paragraph", "paragraph", "table", *["paragraph"] * 3, "figure", "paragraph", "unknown",
        "code_block", "page_break", "horizontal_rule",
    ]
    two = [n for n in nodes if n["type"] == "paragraph"][1]
    assert two["content"][0]["type"] == "strong"  # bold goes on in the next paragraph
    assert lost(job) == sorted(
        [("active_content", "unsupported")] * 3 + [("custom_element", "preserved_raw"), ("html_comment", "preserved_raw"), ("mark", "partial"), ("style_element", "partial"), ("sub_element", "partial"), ("unknown_element", "preserved_raw")]
    )
    table = next(n for n in nodes if n["type"] == "table")
    assert [(c["col"], c.get("col_span", 1), c.get("row_span", 1)) for r in table["rows"] for c in r["cells"]] == [(0, 2, 1), (0, 1, 1), (1, 1, 2)]


def test_html_round_trip():
    nodes, job = read_html("<h1>T</h1><p>a <em>b</em> <a href='u' title='t'>c</a></p><ol start=3><li>x</li></ol><blockquote><p>q</p></blockquote><table><tr><th>h</th></tr><tr><td>d</td></tr></table>")
    out, _ = render(Document(nodes, job.assets), "html")
    (article,) = read_html(out)[0]
    assert article["type"] == "section"
    assert bare(article["children"]) == bare(nodes)


def test_marked_html_has_ids_on_blocks():
    nodes, _ = read_html("<p>a</p><section><h1>b</h1></section>")
    assert render(Document(nodes), "html", marked=True)[0].count("data-block-id") == 2


def test_tree_rows_round_trip():
    nodes, _ = read_markdown(MARKDOWN)
    assert list(flatten(unflatten(reversed(list(flatten(nodes)))))) == list(flatten(nodes))


def test_editor_round_trip():
    nodes, _ = read_markdown(MARKDOWN)
    again = editor.from_editor(editor.to_editor(nodes))
    assert editor.stable(again) == editor.stable(nodes)


def test_editor_reissues_repeated_ids():
    nodes, _ = read_markdown("a\n\nb")
    nodes[1]["node_id"] = nodes[0]["node_id"]
    ids = [n["node_id"] for n in editor.from_editor(editor.to_editor(nodes))]
    assert len(set(ids)) == 2 and ids[0] == nodes[0]["node_id"]


def test_pandoc_round_trip():
    nodes, _ = read_markdown(MARKDOWN.replace("![alt](https://example.com/i.png)", "").replace("> [!CAUTION]\n> hot\n", ""))
    plain = [plain_block(n) for n in nodes]
    assert [plain_block(n) for n in read_pandoc(write_pandoc(nodes))[0]] == plain


def test_sanitizers():
    clean, removed = sanitize_fragment('<p onclick="x">a<script>1</script><a href=" JavaScript:1">b</a></p>')
    assert removed and "script" not in clean.lower() and "onclick" not in clean
    assert sanitize_fragment("<p>a</p>") == ("<p>a</p>", False)
    assert sanitize_paste('<p style="x"><b>a</b><script>1</script><font>c</font></p>', "match") == {"html": "<p>ac</p>", "dropped": 1, "unwrapped": 2, "attributes": 1}
    assert safe_url("/x") and safe_url("mailto:a") and not safe_url("javascript:1") and not safe_url("data:text/html,x", "image")
    assert safe_url("data:image/png;base64,AA", "image")


@pytest.mark.parametrize("reader", [read_html, read_markdown])
@pytest.mark.parametrize("text", ["", None, "   ", "<", "\x00", "a" * 100_000, "<p>" * 500, "[" * 300, "*" * 501, "> " * 200, "| | |\n| - | - |\n"])
def test_readers_survive(reader, text):
    nodes, job = reader(text)
    for fmt in ("text", "markdown", "html"):
        render(Document(nodes, job.assets), fmt)
