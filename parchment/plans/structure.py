"""Pages and documents as trees: imports, projections, validation and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.operators import loss as L
from parchment.operators import references as R
from parchment.operators import structure as S
from parchment.operators import validate as V
from parchment.plans.catalog import query, table
from parchment.sources import importers as I
from parchment.store import materialise


def _pages(s, d):
    return I.imported(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html")


def _nodes(s, d):
    return I.nodes_of(_pages(s, d))


def _parsed(s, d):
    """The pages parsed once and written, for what reads them several times."""
    return materialise(_pages(s, d))


N = lambda pattern: f"len(regexp_extract_all(html, '{pattern}'))"


@query(
    "ag1_loss_by_class",
    f"""WITH c AS (SELECT page_id AS doc_id, {N("<style")} AS partial, 0 AS degraded, {N("<script")} AS unsupported,
          {N("<!--")} + {N("<nav>")} + {N("<footer>")} AS preserved_raw FROM pages)
        SELECT *, CASE WHEN partial + unsupported + preserved_raw > 0 THEN 'partial' ELSE 'complete' END AS status FROM c""",
)
def ag1(s, d):
    docs = table(s, d, "pages", F.col("page_id").alias("doc_id"))
    return L.loss_by_class(I.loss_of(_pages(s, d)), docs).select("doc_id", "partial", "degraded", "unsupported", "preserved_raw", "status")


@query("ag2_has_loss", "SELECT page_id AS doc_id, html LIKE '%<script%' OR html LIKE '%<style%' OR html LIKE '%<nav>%' OR html LIKE '%<!--%' AS has_loss FROM pages")
def ag2(s, d):
    found = I.loss_of(_pages(s, d)).groupBy("doc_id").agg(F.bool_or(F.col("loss_class") != "none").alias("has_loss"))
    return table(s, d, "pages", F.col("page_id").alias("doc_id")).join(found, "doc_id", "left").na.fill(False)


@query(
    "ag5_loss_features",
    f"""SELECT * FROM (SELECT page_id AS doc_id, unnest(['active_content', 'html_comment', 'style_element', 'unknown_element']) AS feature,
        unnest([{N("<script")}, {N("<!--")}, {N("<style")}, {N("<nav>")} + {N("<footer>")}]) AS n FROM pages) WHERE n > 0""",
)
def ag5(s, d):
    return L.by_feature(I.loss_of(_pages(s, d)).where("loss_class <> 'none'")).select("doc_id", "feature", "n")


UNESCAPE = "replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("pj11_outline", f"WITH h AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<h1>(.*?)</h1>', 1)) AS t FROM pages) SELECT doc_id, 1 AS level, trim({UNESCAPE}) AS text FROM h")
def pj11(s, d):
    return S.outline(I.nodes_of(_parsed(s, d))).select("doc_id", "level", "text")


@query("pj12_title", f"WITH h AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages) SELECT doc_id, trim({UNESCAPE}) AS title FROM h")
def pj12(s, d):
    return _pages(s, d).select("doc_id", "title")


@query("ag3_count_headings", f"SELECT page_id AS doc_id, {N('<h[1-6]>')} AS headings, {N('<article>')} AS sections, {N('<nav>')} + {N('<footer>')} + {N('<!--')} AS unknowns FROM pages")
def ag3b(s, d):
    n = lambda t: F.count_if(F.col("type") == t)
    return _nodes(s, d).groupBy("doc_id").agg(n("heading").alias("headings"), n("section").alias("sections"), n("unknown").alias("unknowns"))


@query("ag7_capability", f"SELECT page_id AS doc_id, {N('<!--')} + {N('<nav>')} + {N('<footer>')} AS preserved FROM pages")
def ag7(s, d):
    return R.capability(_nodes(s, d)).where("status = 'preserved'").select("doc_id", F.col("n").alias("preserved"))


@query("jn3_payloads", "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<nav>.*?</nav>', 0, 's')) AS payload FROM pages")
def jn3(s, d):
    docs = _parsed(s, d)
    joined = R.payloads(I.nodes_of(docs).where("summary = '<nav>'"), I.preserved_of(docs))
    return joined.select("doc_id", F.col("payload").cast("string").alias("payload"))


@query("sc9_markdown_import", "SELECT doc_id, 1 AS paragraphs FROM documents WHERE trim(text) <> ''")
def sc9(s, d):
    docs = I.imported(table(s, d, "documents", "doc_id", "text"), "markdown")
    return I.nodes_of(docs).where("kind = 'block'").groupBy("doc_id").agg(F.count_if(F.col("type") == "paragraph").cast("int").alias("paragraphs"))


@query("fl1_check_content", "SELECT page_id AS doc_id, 0 AS errors FROM pages")
def fl1(s, d):
    docs = _parsed(s, d)
    issues = V.check_content(materialise(I.nodes_of(docs)), I.preserved_of(docs))
    errors = V.totals(issues).select("doc_id", "errors")
    return docs.select("doc_id").join(errors, "doc_id", "left").select("doc_id", F.coalesce("errors", F.lit(0)).alias("errors"))


UNKNOWN = f"{N('<nav>')} + {N('<footer>')} + {N('<!--')}"


@query("sc10_html_import", f"SELECT page_id AS doc_id, unnest(['section', 'heading', 'unknown']) AS type, unnest([{N('<article>')}, {N('<h1>')}, {UNKNOWN}]) AS n FROM pages")
def sc10(s, d):
    kinds = F.array(*[F.lit(x) for x in ("section", "heading", "unknown")])
    docs = _pages(s, d).select("doc_id", F.col("nodes.type").alias("types"))
    return docs.select("doc_id", "types", F.explode(kinds).alias("type")).select("doc_id", "type", F.size(F.filter("types", lambda t: t == F.col("type"))).alias("n"))


def _counted(out, **patterns):
    """Exports by what they hold: how often each pattern stands in the output."""
    return out.select("doc_id", "format", "n_lost", *[F.regexp_count("output", F.lit(p)).alias(k) for k, p in patterns.items()])


LOSSES = f"{N('<style')} + {N('<script')} + {UNKNOWN}"


@query("sk6_export_txt", f"SELECT page_id AS doc_id, 'text' AS format, {LOSSES} + {UNKNOWN} AS n_lost, {N('<h1>')} AS headings, {UNKNOWN} AS unshown FROM pages")
def sk6(s, d):
    out = I.convert(table(s, d, "pages", "page_id", "html"), "html", "text", "page_id", "html")
    return _counted(out, headings="(?m)^=+$", unshown=r"(?m)^\[未能显示的内容: ")


@query("sk7_export_markdown", f"SELECT page_id AS doc_id, 'markdown' AS format, {LOSSES} + {UNKNOWN} AS n_lost, {N('<h1>')} AS headings, {UNKNOWN} AS comments FROM pages")
def sk7(s, d):
    out = I.convert(table(s, d, "pages", "page_id", "html"), "html", "markdown", "page_id", "html")
    return _counted(out, headings="(?m)^# ", comments="<!-- unsupported ")


@query("sk8_export_html", f"SELECT page_id AS doc_id, 'html' AS format, 0 AS n_lost, {N('<h1>')} AS headings, {UNKNOWN} AS kept, 1 AS pages FROM pages")
def sk8(s, d):
    return _counted(I.exported(_pages(s, d), "html"), headings='<h1 id="blk_[^"]*">', kept="<div data-unknown=", pages="(?s)^<!doctype html>.*</html>\n$")


@query("sk9_export_html_marked", f"SELECT page_id AS doc_id, 'html' AS format, 0 AS n_lost, {N('<h1>')} AS headings, {UNKNOWN} AS kept FROM pages")
def sk9(s, d):
    # the losses of the export alone; the tree of a page stays in the Python step that reads it
    out = I.convert(table(s, d, "pages", "page_id", "html"), "html", "html", "page_id", "html", marked=True).withColumn("n_lost", F.col("n_lost") - F.col("n_unread"))
    return _counted(out, headings='<h1 [^>]*data-block-id="blk_', kept='<div data-unknown="[^"]*" data-block-id="blk_')


@query("sk6_render_nodes", f"SELECT page_id AS doc_id, 'text' AS format, {UNKNOWN} AS n_lost, {N('<h1>')} AS headings, {UNKNOWN} AS unshown FROM pages")
def sk6b(s, d):
    return _counted(I.render_nodes(_nodes(s, d), "text"), headings="(?m)^=+$", unshown=r"(?m)^\[未能显示的内容: ")


@query(
    "fl1_planted_faults",
    f"""WITH c AS (SELECT page_id AS doc_id, {N('<h1>')} AS h, {N('<article>')} AS a, {N('<nav>')} + {N('<footer>')} + {N('<!--')} AS u, page_id % 8 AS k FROM pages)
        SELECT doc_id, CASE k WHEN 0 THEN h WHEN 1 THEN u WHEN 2 THEN u WHEN 3 THEN u WHEN 5 THEN h + a - 1 WHEN 6 THEN h ELSE 0 END AS errors, CASE k WHEN 4 THEN u WHEN 5 THEN a WHEN 7 THEN h ELSE 0 END AS warnings,
               CASE k WHEN 6 THEN a ELSE 0 END AS infos FROM c WHERE CASE k WHEN 0 THEN h WHEN 1 THEN u WHEN 2 THEN u WHEN 3 THEN u WHEN 4 THEN u WHEN 5 THEN h + a WHEN 6 THEN h + a ELSE h END > 0""",
)
def fl1b(s, d):
    # a fault in each page, of a kind that its number gives; the validator is to find just these
    docs = _parsed(s, d)
    k, own = F.col("doc_id") % 8, F.lit("blk_" + "0" * 26)
    heading, section, unknown = F.col("type") == "heading", F.col("type") == "section", F.col("type") == "unknown"
    nodes = I.nodes_of(docs).withColumns(
        {
            "level": F.when(heading & (k == 0), 7).otherwise(F.col("level")),
            "payload_ref": F.when(unknown & (k == 1), F.lit(None)).when(unknown & (k == 2), "gone").otherwise(F.col("payload_ref")),
            "loss_class": F.when(unknown & (k == 3), "lost").otherwise(F.col("loss_class")),
            "summary": F.when(unknown & (k == 4), " ").otherwise(F.col("summary")),
            "node_id": F.when((heading | section) & (k == 5), own).when(heading & (k == 6), F.lit("blk_1")).otherwise(F.col("node_id")),
            "type": F.when(section & (k == 6), "aside").otherwise(F.col("type")),
            "extra": F.when(heading & (k == 7), '{"format":{"color":"red"}}').otherwise(F.col("extra")),
        }
    )
    # what was a section keeps its id, whose prefix is then a warning of its own
    issues = V.check_content(materialise(nodes), I.preserved_of(docs)).where("not (doc_id % 8 = 6 and code = 'id_prefix')")
    return V.totals(issues).select("doc_id", "errors", "warnings", "infos")


# synthetic trees over tables


def _headings(s, d):
    c = table(s, d, "conversations", "conv_id", "turn")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 4 != 3, 1 + (F.col("turn") * 7 + F.col("conv_id")) % 3).alias("level"))


HEADINGS = "h AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN turn % 4 <> 3 THEN 1 + (turn * 7 + conv_id) % 3 END AS level FROM conversations)"


@query("pj1_wrap_sections", f"WITH {HEADINGS} SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level IS NOT NULL AND (a.level IS NULL OR b.level < a.level) GROUP BY a.doc_id, a.seq")
def pj1(s, d):
    return S.section_parents(_headings(s, d)).select("doc_id", "seq", "parent")


@query("w2_section_sizes", f"WITH {HEADINGS}, p AS (SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level IS NOT NULL AND (a.level IS NULL OR b.level < a.level) GROUP BY a.doc_id, a.seq) SELECT doc_id, parent, count(*) AS children FROM p WHERE parent IS NOT NULL GROUP BY ALL")
def w2(s, d):
    return S.section_parents(_headings(s, d)).where("parent is not null").groupBy("doc_id", "parent").agg(F.count("*").alias("children"))


MARKS = "SELECT conv_id, turn, role AS mark, CASE WHEN turn % 5 = 4 THEN '' ELSE left(text, 10) END AS t FROM conversations"


@query("pj2_merge_text_spans", f"WITH m AS ({MARKS}), k AS (SELECT *, CASE WHEN mark = lag(mark) OVER w THEN 0 ELSE 1 END AS n FROM m WHERE t <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM k) SELECT conv_id, any_value(mark) AS mark, string_agg(t, '' ORDER BY turn) AS t FROM i GROUP BY conv_id, island")
def pj2(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("mark"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.substring("text", 1, 10)).alias("t"))
    return S.merge_runs(c, ["conv_id"], "turn", "mark", "t").select("conv_id", "mark", "t")


@query("w7_mark_islands", "WITH k AS (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM k")
def w7(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations", "conv_id", "turn", "role").withColumn("_before", F.lag("role").over(w))
    return S.islands(c, ["conv_id"], "turn", F.col("role") == F.col("_before")).select("conv_id", "turn", "island")


@query("pj3_canonical_assets", "WITH f AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1 AS ordinal FROM f")
def pj3(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    return S.first_use_ordinal(e, ["user_id"], "event_type", "event_id").select("event_id", "ordinal")


@query("w3_footnote_numbers", "WITH r AS (SELECT user_id AS doc_id, event_type AS ref, min(event_id) AS f, count(*) AS n_refs FROM events GROUP BY ALL) SELECT doc_id, ref AS target_ref, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS number, n_refs, ref <> 'click' AS defined FROM r")
def w3(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    refs = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("footnote_ref").alias("type"), F.col("event_type").alias("target_ref"), F.lit(None).cast("string").alias("node_id"))
    defs = e.where("event_type <> 'click'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("footnote").alias("type"), F.lit(None).cast("string").alias("target_ref"), F.col("event_type").alias("node_id"))
    return R.footnote_numbers(refs.unionByName(defs))


@query("w4_auto_labels", "SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN 'u' || turn END, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR)) AS shown FROM conversations")
def w4(s, d):
    c = table(s, d, "conversations", "conv_id", "turn", "role").withColumn("label", F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("turn").cast("string"))))
    return S.auto_labels(c, ["conv_id"], "turn", "label").select("conv_id", "turn", "shown")


@query("w8_resolve_ids", "SELECT event_id, event_type <> 'view' AND row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS keeps FROM events")
def w8(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    return S.keep_first_ids(e, ["user_id"], "event_type", "event_id", F.col("event_type") != "view").select("event_id", "keeps")


@query("w9_row_spans", "WITH k AS (SELECT conv_id, turn, sum(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) SELECT conv_id, min(turn) AS turn, count(*) AS row_span FROM k GROUP BY conv_id, island")
def w9(s, d):
    c = table(s, d, "conversations", "conv_id", "turn", "role").withColumn("merge", F.when(F.col("role") == "assistant", "continue").otherwise("restart"))
    return S.row_spans(c, ["conv_id"], "turn", "merge")


CELLS = "c AS (SELECT n_nationkey AS seq, n_regionkey AS t, n_nationkey // 5 AS r, n_nationkey % 5 AS c, 1 + n_nationkey % 2 AS w, 1 + n_nationkey % 3 AS h FROM nation)"


@query(
    "fl6_table_grid",
    f"""WITH {CELLS}, p AS (SELECT seq, t, r + unnest(range(h)) AS pr, c, w FROM c), q AS (SELECT seq, t, pr, c + unnest(range(w)) AS pc FROM p),
        o AS (SELECT DISTINCT seq FROM (SELECT seq, row_number() OVER (PARTITION BY t, pr, pc ORDER BY seq) AS n FROM q) WHERE n > 1)
        SELECT seq, 'cell_overlap' AS issue FROM o UNION ALL SELECT seq, 'cell_beyond_columns' FROM c WHERE c + w > 5 UNION ALL SELECT seq, 'cell_beyond_rows' FROM c WHERE r + h > 5""",
)
def fl6(s, d):
    n = F.col("n_nationkey").cast("int")
    cells = table(s, d, "nation").select(
        n.alias("seq"), F.col("n_regionkey").alias("table"), F.floor(n / 5).cast("int").alias("row"), (n % 5).alias("col"), (1 + n % 2).alias("col_span"), (1 + n % 3).alias("row_span"),
        F.lit(5).alias("n_cols"), F.lit(5).alias("n_rows"),
    )
    return V.grid_issues(cells, ("table",)).select("seq", "issue")


@query("jn16_style_chain", "WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey % 8 <> 1 THEN p_partkey - 1 END AS based_on, p_size % 5 = 0 AS bold, CASE WHEN p_size % 3 = 0 THEN p_brand END AS font, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part), c AS (SELECT style, based_on, 0 AS depth, bold, font, size FROM s UNION ALL SELECT c.style, s.based_on, c.depth + 1, s.bold, s.font, s.size FROM c JOIN s ON c.based_on = s.style WHERE c.depth < 15) SELECT style, bool_or(bold) AS bold, arg_min(font, depth) FILTER (font IS NOT NULL) AS font, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, max(depth) + 1 AS hops FROM c GROUP BY style")
def jn16(s, d):
    p = table(s, d, "part")
    styles = p.select(
        F.col("p_partkey").alias("style"), F.when(F.col("p_partkey") % 8 != 1, F.col("p_partkey") - 1).alias("based_on"), (F.col("p_size") % 5 == 0).alias("bold"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("font"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"),
    )
    return R.style_chain(styles)


