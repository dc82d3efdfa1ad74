"""Lookups, selections and small functions over parsed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import text as X
from parchment.operators import annotations as A
from parchment.operators import commands as M
from parchment.operators import references as R
from parchment.operators import revisions as V
from parchment.operators import structure as S
from parchment.operators import validate as C
from parchment.operators import verify as Y
from parchment.plans.catalog import query, table
from parchment.plans.commands import MODEL
from parchment.plans.mapping import _editor, _lost, _read
from parchment.plans.more import _nodes
from parchment.plans.packages import _packages, _r, _with
from parchment.plans.relations import WORDS, _revisions
from parchment.sources import container as K
from parchment.sources import importers as I
from parchment.sources import ooxml as O
from parchment.sources.docx import imported_docx, inventory, inventory_json
from parchment.store import growing, materialise
from parchment.streaming import jobs as J

# annotations


def _quoted(s, d):
    """Documents of two paragraphs, and an annotation of each whose quote one in seven does not hold."""
    nodes = I.nodes_of(_read(s, d, "markdown", r"concat(p_name, ' and more\n\n', p_type)"))
    blocks = M.listing(nodes).select("doc_id", F.col("target_block").alias("node_id"), "seq", "text")
    first = blocks.groupBy("doc_id").agg(F.min_by("node_id", "seq").alias("target_block"), F.min_by("text", "seq").alias("_t"))
    exact = F.when(F.col("doc_id") % 7 == 0, F.lit("absent")).otherwise(F.expr("left(_t, length(_t) - 9)"))
    return first.select("doc_id", F.lit("ann").alias("annotation_id"), "target_block", exact.alias("exact"), F.lit("").alias("prefix"), F.lit(" and").alias("suffix")), blocks


@query("cm13_annotations", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 = 0 THEN 'absent' ELSE p_name END AS exact, CASE WHEN p_partkey % 7 = 0 THEN 'detached' ELSE 'unchanged' END AS state, p_partkey % 7 = 0 AS detached FROM part")
def cm13(s, d):
    return A.listed(*_quoted(s, d)).select("doc_id", "exact", "state", "detached")


@query("jn7_targets_missing", "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 2 = 1")
def jn7(s, d):
    given, blocks = _quoted(s, d)
    return A.targets_missing(given.withColumn("target_block", F.when(F.col("doc_id") % 2 == 1, "blk_none").otherwise(F.col("target_block"))), blocks).select("doc_id")


# revisions


@query("jn19_head_in_chain", "SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE turn = conv_id % 5")
def jn19(s, d):
    manifest = table(s, d, "conversations", "conv_id").distinct().select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") % 5).alias("current_revision"))
    return V.heads_in_chain(manifest, _revisions(s, d)).select("doc_id")


@query("se1_revision_diff", f"WITH {WORDS} SELECT doc_id, item FROM (SELECT doc_id, item FROM w WHERE rev = 0 EXCEPT SELECT doc_id, item FROM w WHERE rev = 1)")
def se1(s, d):
    items = _revisions(s, d).select("doc_id", "rev", F.explode(F.split("content", " ")).alias("item"))
    return V.only_in(items, F.col("rev") == 0, F.col("rev") == 1)


@query("st5_latest_report", "SELECT conv_id AS doc_id, 'reports/import-' || lpad(CAST(max(turn) AS VARCHAR), 4, '0') || '.json' AS path FROM conversations GROUP BY 1")
def st5(s, d):
    path = F.concat(F.lit("reports/import-"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".json"))
    t = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), path.alias("path"))
    other = t.select("doc_id", F.lit("reports/export-9999.json").alias("path"))
    return V.latest_report(t.unionByName(other), "reports/import-").select("doc_id", "path")


# structure


@query("jn22_layout_index", "SELECT p_partkey AS doc_id, unnest(['content[0]', 'content[2]', 'content[3]', 'content[5]']) AS path, unnest([1, 2, 2, 3]) AS page FROM part")
def jn22(s, d):
    br = '<div class="page-break"></div>'
    nodes = I.nodes_of(_read(s, d, "html", f"concat('<p>', p_name, '</p>{br}<p>', p_type, '</p><hr>{br}<p>', p_brand, '</p>')"))
    return S.page_index(nodes).select("doc_id", "path", "page")


@query("jn23_mark_ranks", "SELECT p_partkey AS doc_id, unnest(['em', 'strong', 'link', 'strike', 'text', 'text', 'text', 'text']) AS type, unnest([2, 1, 0, 4, NULL, NULL, NULL, NULL]) AS rank FROM part")
def jn23(s, d):
    nodes = I.nodes_of(_read(s, d, "markdown", "concat('*', p_name, '***', p_type, '**[', p_brand, '](/x)~~', p_size, '~~')"))
    return R.mark_ranks(nodes.where("kind = 'span'").select("doc_id", "type"))


@query("se5_known_types", "SELECT p_partkey AS doc_id, unnest(['paragraph', CASE WHEN p_partkey % 2 = 0 THEN 'sidebar' ELSE 'quote' END, 'text', 'sparkle']) AS type, unnest([true, p_partkey % 2 = 1, true, false]) AS known FROM part")
def se5(s, d):
    src = _editor("""concat('{"type":"paragraph","attrs":{"id":"blk_A"},"content":[{"type":"text","text":"', p_name, '"},{"type":"sparkle"}]},{"type":"', CASE WHEN p_partkey % 2 = 0 THEN 'sidebar' ELSE 'quote' END, '","attrs":{"id":"blk_B"}}')""")
    return C.known_types(I.nodes_of(_read(s, d, "editor", src))).select("doc_id", "type", "known")


@query("st2_head_issues", "SELECT doc_id, path FROM (SELECT user_id AS doc_id, 'content[' || event_id || ']' AS path, row_number() OVER (PARTITION BY user_id ORDER BY 'content[' || event_id || ']') AS n FROM events WHERE event_type = 'click') WHERE n <= 10")
def st2(s, d):
    nodes = _nodes(s, d, type=F.when(F.col("event_type") == "click", "heading").otherwise("paragraph"), level=F.lit(7))
    return C.head_issues(C.issues_of(nodes, C.block_rules())).select("doc_id", "path")


@query("st4_longest", "SELECT doc_id, arg_max(text, struct_pack(n := length(text), k := k)) AS shown FROM (SELECT p_partkey AS doc_id, unnest([2, 3]) AS k, unnest([left(p_name || ' ' || repeat('ab ', p_size) || 'end', 240), p_brand || ' is a part of' || repeat(' cd', 7) || '.']) AS text FROM part) GROUP BY 1")
def st4(s, d):
    return M.longest_block(M.listing(I.nodes_of(_read(s, d, "markdown", MODEL)))).select("doc_id", "shown")


@query("st3_recent", "SELECT user_id, max(ts) AS latest FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 20")
def st3(s, d):
    return J.recent(table(s, d, "events"), "user_id", "ts")


# packages and containers


@query("ag20_inventory_json", "SELECT p_partkey AS doc_id, '{\"has_headers\":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || ',\"has_footers\":false,\"has_comments\":' || CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END || ',\"n_media\":1}' AS summary FROM part")
def ag20(s, d):
    files = _with(s, d, {"word/header2.xml": "CASE WHEN p_partkey % 2 = 0 THEN '<x/>' END", "word/comments.xml": "CASE WHEN p_partkey % 3 = 0 THEN '<x/>' END", "word/media/a.png": "'x'"})
    return inventory_json(inventory(O.parts_of(files).select("doc_id", F.explode("names").alias("name"))))


@query("fl17_version_match", "SELECT doc_id, doc_id % 2 = 0 AS matches FROM documents")
def fl17(s, d):
    t = table(s, d, "documents", "doc_id")
    manifest = F.concat(F.lit('{"parchm":{"format_version":"'), F.when(F.col("doc_id") % 2 == 0, "1.0").otherwise("1.1"), F.lit('"}}'))
    return Y.version_matches(K.packed_rows(t.select("doc_id", F.array(F.struct(F.lit("manifest.json").alias("name"), manifest.cast("binary").alias("bytes"))).alias("entries"))))


@query("fl21_run_flags", "SELECT p_partkey AS doc_id, p_partkey % 6 IN (1, 2, 3) AS bold FROM part")
def fl21(s, d):
    given = """CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '<w:b/>' WHEN 2 THEN '<w:b w:val="true"/>' WHEN 3 THEN '<w:b w:val="1"/>' WHEN 4 THEN '<w:b w:val="0"/>' ELSE '<w:b w:val="false"/>' END"""
    nodes = I.nodes_of(imported_docx(_packages(s, d, "'<w:p>', " + _r("p_name", "', " + given + ", '") + ", '</w:p>'")))
    return nodes.where("kind = 'span'").groupBy("doc_id").agg(F.bool_or(F.col("type") == "strong").alias("bold"))


@query("fl14_handler_attributes", "SELECT p_partkey AS doc_id, 1 + p_size % 3 AS removed FROM part")
def fl14(s, d):
    src = """concat('<p onclick="x()">', p_name, repeat('<a href=" java script:x()">b</a>', p_size % 3), '<a href="/ok">c</a>')"""
    return _lost(_read(s, d, "html", src)).where("feature = 'active_content'").groupBy("doc_id").agg(F.count("*").alias("removed"))


@query("pj15_defaults", "SELECT p_partkey AS doc_id, nullif(p_size % 3 + 1, 1) AS col_span, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS role FROM part")
def pj15(s, d):
    src = _editor("""concat('{"type":"table","attrs":{"id":"blk_A"},"content":[{"type":"table_row","attrs":{"id":"row_A"},"content":[{"type":"table_cell","attrs":{"id":"cel_A","col":0,"role":', CASE WHEN p_partkey % 2 = 0 THEN concat('"', p_type, '"') ELSE 'null' END, ',"col_span":', p_size % 3 + 1, '}}]}]}')""")
    return I.nodes_of(_read(s, d, "editor", src)).where("type = 'cell'").select("doc_id", "col_span", "role")


# members of JSON objects and small functions

PROPS = """concat('{"id":"', p_name, '","n":', p_size, ',"deep/er":{"x~y":[1,', p_partkey, ']}', CASE WHEN p_partkey % 2 = 0 THEN ',"odd":true' ELSE '' END, '}')"""


def _props(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", F.expr(PROPS).alias("props"))


@query("fn36_json_pointer", "SELECT p_partkey AS doc_id, p_name AS id, CAST(p_partkey AS VARCHAR) AS deep, CAST(NULL AS VARCHAR) AS none FROM part")
def fn36(s, d):
    at = lambda p: X.json_pointer(F.col("props"), p)
    return _props(s, d).select("doc_id", at("/id").alias("id"), at("/deep~1er/x~0y/1").alias("deep"), at("/id/x").alias("none"))


@query("pj16_extra_members", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'n,odd' ELSE 'n' END AS extra, CAST(p_size AS VARCHAR) AS n, p_type AS id FROM part")
def pj16(s, d):
    t = _props(s, d).join(table(s, d, "part", F.col("p_partkey").alias("doc_id"), "p_type"), "doc_id").withColumn("extra", X.unknown_members(F.col("props"), ("id", "deep/er")))
    back = X.spread_members(F.concat(F.lit('{"id":"'), "p_type", F.lit('"}')), F.col("extra"))
    return t.select("doc_id", F.array_join(F.array_sort(F.json_object_keys("extra")), ",").alias("extra"), F.get_json_object(back, "$.n").alias("n"), F.get_json_object(back, "$.id").alias("id"))


@query("se2_unknown_keys", "SELECT p_partkey AS doc_id, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['n', 'odd'] ELSE ['n'] END) AS key FROM part")
def se2(s, d):
    return _props(s, d).select("doc_id", F.explode(F.json_object_keys(X.unknown_members(F.col("props"), ("id", "deep/er")))).alias("key"))


@query("fn40_replace_all", "SELECT doc_id, replace(text, 'the', 'a') AS text FROM documents")
def fn40(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", X.replace_all(F.col("text"), "the", "a").alias("text"))


@query("fn15_layout_hash", "SELECT doc_id, sha256('fp' || sha256(text) || 'css1' || 'paged') AS layout_hash FROM documents")
def fn15(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", X.layout_hash(F.lit("fp"), F.sha2("text", 256), "css1", "paged").alias("layout_hash"))


@query("fn33_converter_name", "SELECT page_id, CASE WHEN url LIKE '%7%' THEN 'parchment-html' WHEN url LIKE '%8%' THEN 'parchment-markdown' END AS converter FROM pages")
def fn33(s, d):
    name = F.when(F.col("url").contains("7"), "a.HTML").when(F.col("url").contains("8"), "b.md").otherwise("c.txt")
    return table(s, d, "pages", "page_id", "url").select("page_id", X.converter_name(X.detect_format(name)).alias("converter"))


# recovery, relocation and verification as commands


@query("cm4_recover", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'central' ELSE 'scan' END AS mode, 2 AS saved, sha256(text) AS sha256 FROM documents")
def cm4(s, d):
    cut = F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(F.expr("substring(content, 1, length(content) - 90)"))
    found = K.recovered(_containers(s, d, deflate=False).withColumn("content", cut)).where("ok")
    text = F.max(F.when(F.col("name") == "content/content.json", F.sha2("bytes", 256)))
    return found.groupBy("doc_id").agg(F.min("mode").alias("mode"), F.count("*").alias("saved"), text.alias("sha256"))


def _containers(s, d, deflate=True):
    from parchment.plans.documents import _packed

    return _packed(s, d, deflate)


@query("sc8_scan_damaged", "SELECT doc_id, unnest(['manifest.json', 'content/content.json']) AS name, unnest([true, doc_id % 2 = 0]) AS ok FROM documents WHERE length(text) > 0")
def sc8(s, d):
    # the directory is cut off, and of every other file the content's last byte is another
    at = F.expr("instr(decode(content, 'ISO-8859-1'), concat('PK', char(1), char(2)))")
    files = _containers(s, d, deflate=False).join(table(s, d, "documents", "doc_id").where(F.length("text") > 0).select("doc_id"), "doc_id").withColumn("at", at)
    good = F.expr("substring(content, 1, at - 1)")
    bad = F.concat(F.expr("substring(content, 1, at - 2)"), F.lit(b"\x01"))
    return K.recovered(files.withColumn("content", F.when(F.col("doc_id") % 2 == 0, good).otherwise(bad))).select("doc_id", "name", "ok")


def _moved(s, d):
    """Documents whose quote stands in its block, in one other block, in two others, or nowhere."""
    nodes = materialise(I.nodes_of(_read(s, d, "markdown", r"""concat(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'one' END, '\n\n', CASE WHEN p_partkey % 4 IN (1, 2) THEN p_name ELSE 'two' END, '\n\n', CASE WHEN p_partkey % 4 = 2 THEN p_name ELSE 'three' END)""")))
    blocks = materialise(M.listing(nodes).select("doc_id", F.col("target_block").alias("node_id"), "seq", "text"))
    first = blocks.groupBy("doc_id").agg(F.min_by("node_id", "seq").alias("target_block"))
    names = table(s, d, "part", F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("exact"))
    return first.join(growing(names), "doc_id").select("doc_id", F.lit("ann").alias("annotation_id"), "target_block", "exact", F.lit("").alias("prefix"), F.lit("").alias("suffix")), blocks


@query("jn9_moved_quotes", "SELECT p_partkey AS doc_id, p_name AS text FROM part WHERE p_partkey % 4 = 1")
def jn9(s, d):
    given, blocks = _moved(s, d)
    found = A.relocate(given, blocks).where("state = 'moved'").select("doc_id", F.col("block").alias("node_id"))
    return found.join(growing(blocks), ["doc_id", "node_id"]).select("doc_id", "text")


@query("cm17_relocated_layer", "SELECT p_partkey AS doc_id, ['unchanged', 'moved', 'detached', 'detached'][p_partkey % 4 + 1] AS state FROM part")
def cm17(s, d):
    return A.relocate(*_moved(s, d)).select("doc_id", "state")


def _verified(s, d):
    """Documents with every kind of input that verification takes, and a fault of each kind in some of them."""
    from parchment.operators import loss as L
    i, n = F.col("doc_id"), lambda k: F.col("doc_id") % k == 0
    docs = materialise(_read(s, d, "markdown", r"concat('![alt](https://example.com/', p_partkey, '.png)\n\n', p_name)"))
    nodes, base = materialise(I.nodes_of(docs)), docs.select("doc_id")
    text = F.concat(F.lit("content "), i.cast("string"))
    layers = base.select("doc_id", F.lit("content").alias("layer"), F.lit("content/content.json").alias("path"), F.sha2(text, 256).alias("sha256"))
    held = base.select("doc_id", F.lit("content/content.json").alias("name"), F.when(n(3), "changed").otherwise(text).cast("binary").alias("bytes"))
    strange = base.where(n(9)).select("doc_id", F.lit("strange.bin").alias("name"), F.lit(b"x").alias("bytes"))
    artifact = base.where(~n(10)).select("doc_id", F.lit("publications/p.pdf").alias("name"), F.lit(b"pdf").alias("bytes"))
    assets = I.assets_of(docs).where(~n(5)).select("doc_id", "asset_id").unionByName(base.where(n(4)).select("doc_id", F.lit("as_X").alias("asset_id")))
    blocks = materialise(M.listing(nodes).select("doc_id", F.col("target_block").alias("node_id"), "text"))
    quotes = blocks.select("doc_id", F.lit("ann").alias("annotation_id"), F.col("node_id").alias("target_block"), F.when(n(7), "absent").otherwise(F.col("text")).alias("exact"))
    chain = base.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rev")).select("doc_id", "rev", F.when(F.col("rev") == 2, 1).alias("parent"), F.lit("human").alias("author_type"), F.sha2(F.col("rev").cast("string"), 256).alias("sha256"))
    snapshots = chain.select("doc_id", "rev", F.when(n(6) & (F.col("rev") == 2), "tampered").otherwise(F.col("rev").cast("string")).alias("content"))
    publications = base.select("doc_id", F.lit("publications/p.pdf").alias("path"), F.sha2(F.lit("pdf"), 256).alias("sha256"))
    reports = L.reports(I.loss_of(docs), "markdown", "container")
    reports = reports.withColumn("report", F.when(n(8), F.regexp_replace("report", '"partial":0', '"partial":3')).otherwise(F.col("report")))
    issues = Y.verify(held.unionByName(strange).unionByName(artifact), layers, nodes, assets, quotes, blocks, chain, base.withColumn("current_revision", F.lit(2)), snapshots, publications, reports)
    return issues, base


VERDICT = "SELECT p_partkey AS doc_id, (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 6 = 0)::INT + (p_partkey % 10 = 0)::INT AS errors, (p_partkey % 7 = 0)::INT + (p_partkey % 8 = 0)::INT AS warnings, (p_partkey % 4 = 0)::INT + (p_partkey % 9 = 0)::INT AS infos FROM part"


@query("cm18_verify_all", f"WITH v AS ({VERDICT}) SELECT *, CASE WHEN errors > 0 THEN 1 ELSE 0 END AS exit_code FROM v")
def cm18(s, d):
    issues, docs = _verified(s, d)
    return Y.verdicts(issues, docs).select("doc_id", "errors", "warnings", "infos", "exit_code")


@query("se4_issue_union", f"WITH v AS ({VERDICT}) SELECT doc_id, unnest(['error', 'warning', 'info']) AS level, unnest([errors, warnings, infos]) AS n FROM v")
def se4(s, d):
    issues, docs = _verified(s, d)
    levels = docs.select("doc_id", F.explode(F.array(F.lit("error"), F.lit("warning"), F.lit("info"))).alias("level"))
    counted = issues.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    return levels.join(growing(counted), ["doc_id", "level"], "left").na.fill(0)
