"""Document commands: containers, packages, editor documents, table edits, model pipeline and small reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import text as X
from parchment.operators import annotations as A
from parchment.operators import references as R
from parchment.operators import tables as T
from parchment.plans.catalog import query, table
from parchment.sources import container as C
from parchment.sources import editor as E
from parchment.sources import importers as I
from parchment.sources.html import read_html
from parchment.sources.markdown import read_markdown
from parchment.sources.pandoc import read_pandoc, write_pandoc
from parchment.store import spread
from parchment.sources.sanitize import sanitize_fragment, sanitize_paste


def _packed(s, d, deflate=True):
    t = table(s, d, "documents", "doc_id", "text", "lang")
    manifest = F.to_json(F.struct(F.struct(F.lit("1.0").alias("format_version"), F.lit("prefixed").alias("container_profile")).alias("parchm"), F.struct(F.struct(F.lit("content/content.json").alias("path"), F.sha2("text", 256).alias("sha256")).alias("content")).alias("layers")))
    entries = F.array(F.struct(F.lit("manifest.json").alias("name"), manifest.cast("binary").alias("bytes")), F.struct(F.lit("content/content.json").alias("name"), F.col("text").cast("binary").alias("bytes")))
    return C.packed_rows(t.select("doc_id", entries.alias("entries")), deflate=deflate)


@query("sc1_open_container", "SELECT doc_id, 'content/content.json' AS name, strlen(text) AS size, sha256(text) AS sha256 FROM documents")
def sc1(s, d):
    # stored, as a text that repeats itself would deflate beyond the limit and be refused
    found = C.entries(_packed(s, d, deflate=False)).where("name <> 'manifest.json'")
    return found.select("doc_id", "name", "size", F.sha2("bytes", 256).alias("sha256"))


@query("sc2_header_fields", "SELECT doc_id, 1 AS major, 0 AS minor, 32 AS header_size, 32 AS zip_offset, true AS crc_ok FROM documents")
def sc2(s, d):
    f = C.header_fields(F.col("content"))
    return _packed(s, d).select("doc_id", *[f[k].alias(k) for k in ("major", "minor", "header_size", "zip_offset", "crc_ok")])


@query("sc7_recover", "SELECT doc_id, 'content/content.json' AS name, 'scan' AS mode, sha256(text) AS sha256 FROM documents")
def sc7(s, d):
    # the end of the archive, with its directory, is cut off
    broken = _packed(s, d).select("doc_id", F.expr("substring(content, 1, length(content) - 100)").alias("content"))
    found = C.recovered(broken).where("ok and name <> 'manifest.json'")
    return found.select("doc_id", "name", "mode", F.sha2("bytes", 256).alias("sha256"))


@query("sk2_pack_deterministic", "SELECT doc_id, true AS same FROM documents")
def sk2(s, d):
    # once in a row, once from an entry table whose rows come in any order; only checksums move
    a = _packed(s, d).select("doc_id", F.sha2("content", 256).alias("content"))
    found = C.entries(_packed(s, d, deflate=False)).select("doc_id", "name", "bytes")
    b = C.packed(found).select("doc_id", F.sha2("content", 256).alias("again"))
    return a.join(b, "doc_id").select("doc_id", (F.col("content") == F.col("again")).alias("same"))


@query("sk5_minimal_document", "SELECT n_nationkey AS doc_id, n_name AS title, n_name || chr(10) || repeat('=', length(n_name)) || chr(10) || chr(10) AS txt FROM nation")
def sk5(s, d):
    t = table(s, d, "nation")
    txt = F.concat("n_name", F.lit("\n"), F.repeat(F.lit("="), X.visual_width(F.col("n_name"))), F.lit("\n\n"))
    return t.select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("title"), txt.alias("txt"))


def _docx(text: str) -> bytes:
    import io
    import zipfile
    from html import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>{body}</w:body></w:document>')
    return held.getvalue()


@query("sc12_docx_import", "SELECT item_id AS doc_id, 1 AS headings, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS paragraphs FROM benchmark")
def sc12(s, d):
    from parchment.sources.docx import imported_docx

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["item_id"], "content": [_docx(t) for t in b["text"]]})

    docs = imported_docx(table(s, d, "benchmark").mapInPandas(made, "doc_id long, content binary"))
    n = lambda t: F.count_if(F.col("type") == t)
    return I.nodes_of(docs).groupBy("doc_id").agg(n("heading").alias("headings"), n("paragraph").alias("paragraphs"))


def _mapped(df, out: str, f):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *f(t)) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True)], columns=[c.split()[0] for c in out.split(", ")])

    return spread(df).mapInPandas(run, out)


def _round_trip(html: str) -> tuple[bool, int]:
    nodes, _ = read_html(html)
    nodes = [n for n in nodes if n["type"] != "unknown"]
    # mark sets hold a mark once, so the first pass may flatten what was nested twice; from then on nothing changes
    once = E.stable(E.from_editor(json.loads(json.dumps(E.to_editor(nodes)))))
    return E.stable(E.from_editor(json.loads(json.dumps(E.to_editor(once))))) == once, len(nodes)


@query("sc27_editor_round_trip", "SELECT page_id, true AS same FROM pages")
def sc27(s, d):
    return _mapped(table(s, d, "pages", "page_id", "html"), "page_id long, same boolean, n int", _round_trip).select("page_id", "same")


def _pandoc_trip(html: str) -> tuple[bool]:
    nodes, _ = read_html(html)
    once = write_pandoc([n for n in nodes if n["type"] != "unknown"])
    again = write_pandoc(read_pandoc(once)[0])
    ids = lambda t: json.dumps([_bare(b) for b in json.loads(t)["blocks"]])
    return (ids(once) == ids(again),)


def _bare(x):
    if isinstance(x, dict):
        if x.get("t") == "Header":
            return {"t": "Header", "c": [x["c"][0], _bare(x["c"][2])]}
        return {k: _bare(v) for k, v in x.items()}
    return [_bare(v) for v in x] if isinstance(x, list) else x


@query("sk11_pandoc_round_trip", "SELECT page_id, true AS same FROM pages")
def sk11(s, d):
    return _mapped(table(s, d, "pages", "page_id", "html"), "page_id long, same boolean", _pandoc_trip)


@query("sk7_markdown_round_trip", "SELECT doc_id, true AS same FROM documents")
def sk7b(s, d):
    from parchment.operators.render import Document, render
    from parchment.tree import flatten

    def trip(text: str) -> tuple[bool]:
        bare = lambda nodes: [(r["kind"], r["type"], r["path"], r["text"]) for r in flatten(nodes)]
        nodes, _ = read_markdown(text)
        again, _ = read_markdown(render(Document(nodes), "markdown")[0])
        return (bare(nodes) == bare(again),)

    return _mapped(table(s, d, "documents", "doc_id", "text"), "doc_id long, same boolean", trip)


@query("fn37_sanitize_fragment", "SELECT page_id, true AS removed, 0 AS scripts FROM pages WHERE html LIKE '%<script%'")
def fn37(s, d):
    t = table(s, d, "pages", "page_id", "html").where(F.col("html").contains("<script"))
    # the head is no part of a fragment, so the script is put into the body
    t = t.withColumn("html", F.concat(F.lit("<p onclick=x>a</p><script>x</script>"), F.regexp_extract("html", "(?s)<article>.*", 0)))
    return _mapped(t, "page_id long, html string, removed boolean", sanitize_fragment).select("page_id", "removed", F.regexp_count("html", F.lit("<script")).cast("long").alias("scripts"))


# table edits over nations as a grid


def _grid(s, d):
    n = F.col("n_nationkey").cast("int")
    return table(s, d, "nation").select(F.lit(0).alias("doc_id"), F.lit(0).alias("table"), F.floor(n / 5).cast("int").alias("row"), (n % 5).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("data").alias("role"), F.col("n_name").alias("text"))


GRID = "g AS (SELECT n_nationkey // 5 AS row, n_nationkey % 5 AS col, n_name AS text FROM nation)"


@query("cm20_insert_column", f"WITH {GRID} SELECT row, CASE WHEN col >= 2 THEN col + 1 ELSE col END AS col, text FROM g UNION ALL SELECT DISTINCT row, 2, '' FROM g")
def cm20(s, d):
    return T.insert(_grid(s, d), "col", 2).select("row", "col", "text")


@query("cm20_delete_row", f"WITH {GRID} SELECT CASE WHEN row > 1 THEN row - 1 ELSE row END AS row, col, text FROM g WHERE row <> 1")
def cm20b(s, d):
    return T.delete(_grid(s, d), "row", 1).select("row", "col", "text")


@query("cm20_merge_cells", f"WITH {GRID} SELECT row, col, 1 AS row_span, 1 AS col_span, text FROM g WHERE NOT (row <= 1 AND col <= 1) UNION ALL SELECT 0, 0, 2, 2, string_agg(text, chr(10) ORDER BY row, col) FROM g WHERE row <= 1 AND col <= 1")
def cm20c(s, d):
    return T.merge(_grid(s, d), 0, 0, 1, 1).select("row", "col", "row_span", "col_span", "text")


@query("cm20_split_cells", f"WITH {GRID} SELECT row, col, CASE WHEN row <= 1 AND col <= 1 THEN CASE WHEN row + col = 0 THEN (SELECT string_agg(text, chr(10) ORDER BY row, col) FROM g WHERE row <= 1 AND col <= 1) ELSE '' END ELSE text END AS text FROM g")
def cm20d(s, d):
    return T.split(T.merge(_grid(s, d), 0, 0, 1, 1)).select("row", "col", "text")


@query("cm20_sync_metadata", "SELECT 5 AS n_cols, 5 AS n_rows, true AS header_row, true AS has_spans")
def cm20e(s, d):
    return T.metadata(T.toggle_header(T.merge(_grid(s, d), 2, 2, 3, 3))).select("n_cols", "n_rows", "header_row", "has_spans")


@query("cm21_format_state", "SELECT doc_id, CASE WHEN count(DISTINCT k) > 1 THEN 'mixed' ELSE max(k) END AS \"fontSize\" FROM (SELECT user_id AS doc_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY doc_id")
def cm21(s, d):
    spans = table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("fontSize")).alias("format"))).alias("extra"))
    return T.format_state(spans, ["fontSize"])


# model pipeline with the deterministic provider


@query("st1_sorted_hits", "SELECT doc_id, item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def st1(s, d):
    return A.quoted(table(s, d, "documents", "doc_id", "text"), table(s, d, "benchmark").select("item_id", F.col("text").alias("passage"))).select(
        "doc_id", "item_id", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")).alias("rank")
    )


@query("ag16_footnote_index", "SELECT user_id AS doc_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'click') GROUP BY 1")
def ag16(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    refs = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("footnote_ref").alias("type"), F.col("event_type").alias("target_ref"), F.lit(None).cast("string").alias("node_id"))
    defs = e.where("event_type <> 'click'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("footnote").alias("type"), F.lit(None).cast("string").alias("target_ref"), F.col("event_type").alias("node_id"))
    return R.footnote_numbers(refs.unionByName(defs)).where("not defined").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("ag14_loss_summary", "SELECT page_id AS doc_id, len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<footer>')) + len(regexp_extract_all(html, '<!--')) AS unknown FROM pages")
def ag14(s, d):
    docs = I.imported(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html")
    return I.nodes_of(docs).groupBy("doc_id").agg(F.count_if(F.col("type") == "unknown").alias("unknown"))


@query("cm22_recovery_drafts", "SELECT left(sha256(CAST(user_id AS VARCHAR)), 24) || '.draft.json' AS name, max(ts) AS at FROM events GROUP BY user_id")
def cm22(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("at")).select(X.recovery_name(F.col("user_id").cast("string")).alias("name"), "at")


