"""Further operators: rules of the validator one by one, lookups, commands and small functions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import text as X
from parchment.operators import annotations as A
from parchment.operators import references as R
from parchment.operators import revisions as V
from parchment.operators import validate as C
from parchment.operators import verify as Y
from parchment.plans.catalog import query, table
from parchment.sources import importers as I
from parchment.store import materialise


def _nodes(s, d, **columns):
    """Events as nodes of documents, with the columns given and nulls for the rest."""
    from parchment.schemas import NODES

    t = table(s, d, "events", "event_id", "user_id", "event_type", "value", "props")
    given = {"doc_id": F.col("user_id").cast("long"), "seq": F.col("event_id").cast("int"), "path": F.concat(F.lit("content["), F.col("event_id").cast("string"), F.lit("]")), "kind": F.lit("block"), **columns}
    kinds = dict(f.split() for f in NODES.split(", "))
    return t.select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])




def _k():
    return F.col("event_id") % 5

PATH = "user_id AS doc_id, 'content[' || event_id || ']' AS path"


def _codes(issues, *codes):
    return issues.where(F.col("code").isin(*codes)).select("doc_id", "path", "code")


@query("fl2_types", f"SELECT {PATH}, CASE WHEN event_id % 5 = 0 THEN 'type_missing' ELSE 'type_unknown' END AS code FROM events WHERE event_id % 5 < 2")
def fl2(s, d):
    return _codes(C.issues_of(_nodes(s, d, type=F.when(_k() == 0, F.lit(None)).when(_k() == 1, "sidebar").otherwise("paragraph")), C.type_rules()), "type_missing", "type_unknown")


@query("fl3_ids", f"SELECT {PATH}, CASE event_id % 5 WHEN 0 THEN 'id_missing' WHEN 1 THEN 'id_invalid' ELSE 'id_prefix' END AS code FROM events WHERE event_id % 5 < 3")
def fl3(s, d):
    n = F.when(_k() == 0, F.lit(None)).when(_k() == 1, "blk_short").otherwise(X.identifier(F.col("event_id"), "blk"))
    return _codes(C.issues_of(_nodes(s, d, type=F.when(_k() == 2, "section").otherwise("paragraph"), node_id=n), C.id_rules()), "id_missing", "id_invalid", "id_prefix")


@query("fl4_block_fields", f"SELECT {PATH}, CASE event_id % 5 WHEN 0 THEN 'heading_level' WHEN 1 THEN 'list_style' WHEN 2 THEN 'code_text' WHEN 3 THEN 'callout_variant' ELSE 'math_latex' END AS code FROM events")
def fl4(s, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("heading", "list", "code_block", "callout", "math_block")]), (_k() + 1).cast("int"))
    return _codes(C.issues_of(_nodes(s, d, type=kind, level=F.lit(7), style=F.lit("stars"), variant=F.lit("shout")), C.block_rules()), "heading_level", "list_style", "code_text", "callout_variant", "math_latex")


@query("fl5_table_parts", "SELECT user_id AS doc_id, 'content[' || event_id || ']' AS path, unnest(['table_columns', 'table_rows']) AS code FROM events WHERE event_id % 5 = 0")
def fl5(s, d):
    columns, rows, grid = C.table_rules(_nodes(s, d, type=F.when(_k() == 0, "table").otherwise("paragraph")))
    return _codes(columns.unionByName(rows).unionByName(grid), "table_columns", "table_rows")


@query("fl7_spans", f"SELECT {PATH}, CASE event_id % 5 WHEN 0 THEN 'span_text' WHEN 1 THEN 'link_url' ELSE 'footnote_ref_id' END AS code FROM events WHERE event_id % 5 < 3")
def fl7(s, d):
    kind = F.when(_k() == 0, "text").when(_k() == 1, "link").when(_k() == 2, "footnote_ref").otherwise("hard_break")
    return _codes(C.issues_of(_nodes(s, d, kind=F.lit("span"), type=kind), C.span_rules()), "span_text", "link_url", "footnote_ref_id")


@query("fl8_unknown_fields", f"SELECT {PATH}, CASE event_id % 5 WHEN 0 THEN 'unknown_loss_class' WHEN 1 THEN 'unknown_payload_ref' WHEN 2 THEN 'unknown_summary' ELSE 'unknown_payload_missing' END AS code FROM events WHERE event_id % 5 < 4")
def fl8(s, d):
    nodes = _nodes(
        s, d, type=F.lit("unknown"), loss_class=F.when(_k() == 0, "gone").otherwise("preserved_raw"), payload_ref=F.when(_k() == 1, F.lit(None)).when(_k() == 3, "lost").otherwise("held"),
        summary=F.when(_k() == 2, " ").otherwise("x"),
    )
    held = table(s, d, "events", F.col("user_id").alias("doc_id")).distinct().withColumn("path", F.lit("held"))
    return _codes(C.issues_of(nodes, C.unknown_rules()).unionByName(C.missing_payloads(nodes, held)), "unknown_loss_class", "unknown_payload_ref", "unknown_summary", "unknown_payload_missing")


@query("fl9_format", f"SELECT {PATH}, CASE event_id % 5 WHEN 0 THEN 'format_align' WHEN 1 THEN 'format_line_height' WHEN 2 THEN 'format_color' WHEN 3 THEN 'format_font_size' ELSE 'format_vertical' END AS code FROM events")
def fl9(s, d):
    bad = F.array(*[F.lit(f'{{"format":{x}}}') for x in ('{"align":"middle"}', '{"lineHeight":9}', '{"color":"red"}', '{"fontSize":0}', '{"verticalAlign":"top"}')])
    codes = ("format_align", "format_line_height", "format_color", "format_font_size", "format_vertical")
    return _codes(C.issues_of(_nodes(s, d, type=F.lit("text"), extra=F.element_at(bad, (_k() + 1).cast("int"))), C.format_rules()), *codes)


@query("fl22_unknown_entries", "SELECT user_id AS doc_id, 'other/' || event_id AS path FROM events WHERE event_id % 5 = 0")
def fl22(s, d):
    name = F.concat(F.when(_k() == 0, "other/").otherwise("assets/"), F.col("event_id").cast("string"))
    return Y.unknown_entries(table(s, d, "events").select(F.col("user_id").alias("doc_id"), name.alias("name"))).select("doc_id", "path")


@query("w8_repeated_ids", "SELECT user_id AS doc_id, 'content[' || event_id || ']' AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1")
def w8b(s, d):
    return C.repeated_ids(_nodes(s, d, type=F.lit("paragraph"), node_id=F.col("event_type"))).select("doc_id", "path")


@query("jn10_footnote_labels", "WITH r AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS number FROM r) SELECT event_id, number FROM events JOIN n USING (user_id, event_type)")
def jn10(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    refs = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("footnote_ref").alias("type"), F.col("event_type").alias("target_ref"), F.lit(None).cast("string").alias("node_id"))
    numbers = R.footnote_numbers(refs).select("doc_id", "target_ref", "number")
    return refs.join(numbers, ["doc_id", "target_ref"]).select(F.col("seq").alias("event_id"), "number")


@query("jn11_embed_mime", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'video/mp4' END AS mime FROM documents")
def jn11(s, d):
    t = table(s, d, "documents", "doc_id")
    i = F.col("doc_id").cast("string")
    assets = t.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("as_"), i).alias("asset_id"), F.lit("x.mp4").alias("filename"), F.lit("video/mp4").alias("mime"), F.lit("u").alias("url"), F.lit(None).cast("binary").alias("bytes"))
    return R.asset_urls(t.select("doc_id", F.concat(F.lit("asset://as_"), i, F.lit("/x.mp4")).alias("asset")), assets).select("doc_id", F.col("asset_mime").alias("mime"))


@query("jn17_type_status", "SELECT event_id, CASE event_type WHEN 'click' THEN 'supported' WHEN 'view' THEN 'degraded' ELSE 'degraded' END AS status FROM events")
def jn17(s, d):
    kinds = s.createDataFrame([("click", "paragraph"), ("view", "callout")], "event_type string, type string")
    e = table(s, d, "events", "event_id", "event_type").join(F.broadcast(kinds), "event_type", "left")
    status = F.when(F.col("type").isin(*R.SUPPORTED), "supported").when(F.col("type").isin(*R.PRESERVED), "preserved").otherwise("degraded")
    return e.select("event_id", status.alias("status"))


@query("ag4_txt_losses", "SELECT page_id AS doc_id, len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<footer>')) + len(regexp_extract_all(html, '<!--')) AS preserved_raw FROM pages")
def ag4(s, d):
    nodes = I.nodes_of(I.imported(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html"))
    return nodes.where("kind = 'block'").groupBy("doc_id").agg(F.count_if(F.col("type") == "unknown").alias("preserved_raw"))


@query("ag13_next_sequence", "SELECT user_id AS doc_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id % 50 END), 0) + 1 AS next FROM events GROUP BY 1")
def ag13(s, d):
    path = F.concat(F.when(F.col("event_type") == "click", "reports/export-").otherwise("other/"), (F.col("event_id") % 50).cast("string"))
    return V.next_sequence(table(s, d, "events").select(F.col("user_id").alias("doc_id"), path.alias("path")), "reports/export-")


@query("w6_list_assembly", "WITH k AS (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS list FROM k) SELECT conv_id, list, count(*) AS items FROM i GROUP BY ALL")
def w6(s, d):
    from parchment.operators.structure import islands

    c = table(s, d, "conversations", "conv_id", "turn", "role").withColumn("_before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return islands(c, ["conv_id"], "turn", F.col("role") == F.col("_before")).groupBy("conv_id", F.col("island").alias("list")).agg(F.count("*").alias("items"))


@query("fn27_resolve_part", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'word/media/x.png' WHEN 1 THEN 'media/x.png' ELSE 'docProps/core.xml' END AS part FROM events")
def fn27(s, d):
    from parchment.sources.docx import resolve

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "part": [resolve("word/document.xml", ("media/x.png", "../media/x.png", "/docProps/core.xml")[i % 3]) for i in b["event_id"]]})

    return table(s, d, "events", "event_id").mapInPandas(run, "event_id long, part string")


@query("fn23_prompt_blocks", "SELECT event_id, props AS blocks FROM events WHERE props LIKE '{%'")
def fn23(s, d):
    prompt = F.concat(F.lit("First:\n```json\n{}\n```\nThen:\n```json\n"), "props", F.lit("\n```"))
    last = F.element_at(F.regexp_extract_all(prompt, F.lit("(?s)```json\\s*(.*?)\\s*```"), F.lit(1)), -1)
    return table(s, d, "events", "event_id", "props").select("event_id", last.alias("blocks")).where("blocks <> '{}'")


@query("sc3_header_crc", "SELECT doc_id, doc_id % 2 = 0 AS crc_ok FROM documents")
def sc3(s, d):
    from parchment.plans.documents import _packed
    from parchment.sources.container import header_fields

    # a flipped version byte makes the checksum wrong
    broken = F.concat(F.substring("content", 1, 9), F.lit(b"\x07"), F.expr("substring(content, 11, length(content) - 10)"))
    data = F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(broken)
    return _packed(s, d).select("doc_id", header_fields(data)["crc_ok"].alias("crc_ok"))


@query("sc5_overlay", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.text) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def sc5(s, d):
    base = table(s, d, "documents").select("doc_id", F.col("text").alias("value"))
    overlay = table(s, d, "labels").join(base.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("quality").cast("string").alias("value"))
    return R.prefer(overlay, base, "doc_id", "value").select("doc_id", "value")


@query("cm3_verify", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS infos, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS exit_code FROM documents")
def cm3(s, d):
    from parchment.schemas import NODES
    from parchment.operators import loss as L

    t = table(s, d, "documents", "doc_id", "text")
    empty = lambda schema: s.createDataFrame([], schema)
    layers = t.select("doc_id", F.lit("content").alias("layer"), F.lit("content/content.json").alias("path"), F.sha2("text", 256).alias("sha256"))
    content = t.select("doc_id", F.lit("content/content.json").alias("name"), F.when(F.col("doc_id") % 3 == 0, "changed").otherwise(F.col("text")).cast("binary").alias("bytes"))
    strange = t.where("doc_id % 4 = 0").select("doc_id", F.lit("strange.bin").alias("name"), F.lit(b"x").alias("bytes"))
    none = empty("doc_id long, seq int, feature string, loss_class string, action string, location string, detail string")
    issues = Y.verify(
        content.unionByName(strange), layers, empty(NODES), empty("doc_id long, asset_id string"), empty("doc_id long, annotation_id string, target_block string, exact string"),
        empty("doc_id long, node_id string, text string"), empty("doc_id long, rev long, parent long, author_type string, sha256 string"), empty("doc_id long, current_revision long"),
        empty("doc_id long, rev long, content string"), empty("doc_id long, path string, sha256 string"), L.reports(none, "a", "b"),
    )
    return Y.verdicts(issues, t).select("doc_id", "errors", "infos", "exit_code")


@query("cm11_checkout_relocate", "SELECT c.conv_id AS doc_id, CASE WHEN contains(f.text, left(c.text, 12)) THEN 'reanchored' ELSE 'detached' END AS state FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0 WHERE c.turn = 1")
def cm11(s, d):
    c = table(s, d, "conversations")
    anns = c.where("turn = 1").select(F.col("conv_id").alias("doc_id"), F.lit("a").alias("annotation_id"), F.lit("b").alias("target_block"), F.substring("text", 1, 12).alias("exact"), F.lit("\u0000").alias("prefix"), F.lit("").alias("suffix"))
    first = c.where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.lit("b").alias("node_id"), "text")
    return A.relocate(anns.join(first.select("doc_id"), "doc_id", "left_semi"), first).select("doc_id", "state")


@query("cm5_import_pipeline", "SELECT page_id AS doc_id, 'partial' AS status, 3 AS issues FROM pages WHERE len(regexp_extract_all(html, '<script')) + len(regexp_extract_all(html, '<style')) + len(regexp_extract_all(html, '<!--')) = 3")
def cm5(s, d):
    from parchment.operators.loss import reports

    pages = table(s, d, "pages", "page_id", "html")
    docs = I.imported(pages, "html", "page_id", "html")
    made = reports(I.loss_of(docs).where("feature <> 'unknown_element'"), "html", "container", docs=pages.select(F.col("page_id").alias("doc_id")))
    one = F.from_json("report", "status string, issues array<struct<id:string>>")
    return made.select("doc_id", one["status"].alias("status"), F.size(one["issues"]).cast("long").alias("issues"))


@query("cm6_transmute", "SELECT page_id AS doc_id, 'markdown' AS format, true AS has_heading FROM pages WHERE html LIKE '%<h1>%'")
def cm6(s, d):
    out = I.convert(table(s, d, "pages", "page_id", "html").where(F.col("html").contains("<h1>")), "html", "markdown", "page_id", "html")
    return out.select("doc_id", "format", F.col("output").rlike("(?m)^# ").alias("has_heading"))


@query("sc28_export_document", "SELECT page_id AS doc_id, len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<footer>')) + len(regexp_extract_all(html, '<!--')) AS payloads FROM pages")
def sc28(s, d):
    docs = materialise(I.imported(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html"))  # parsed once
    held = R.payloads(I.nodes_of(docs).where("payload_ref is not null"), I.preserved_of(docs))
    counted = held.groupBy("doc_id").agg(F.count_if(F.col("payload").isNotNull()).alias("payloads"))
    return docs.select("doc_id").join(counted, "doc_id", "left").na.fill(0)
