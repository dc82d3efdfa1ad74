"""Commands over containers, the model pipeline, saving, printing and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import text as X
from parchment.operators import commands as M
from parchment.operators import loss as L
from parchment.operators import references as R
from parchment.operators import structure as S
from parchment.operators import tables as T
from parchment.operators.persist import persist_assets
from parchment.plans.catalog import query, table
from parchment.plans.documents import _packed
from parchment.plans.mapping import _editor, _read
from parchment.plans.structure import N, _pages
from parchment.sources import container as C
from parchment.sources import editor as E
from parchment.sources import importers as I
from parchment.store import materialise, replace, shared_dir
from parchment.streaming import jobs as J

# containers


@query("sc6_entry_names", "SELECT doc_id, unnest(['manifest.json', 'content/content.json']) AS name FROM documents")
def sc6(s, d):
    return C.entries(_packed(s, d, deflate=False)).select("doc_id", "name")


@query("sk1_rewritten_container", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS entries, sha256(CASE WHEN doc_id % 3 = 0 THEN 'new ' || lang ELSE text END) AS content, doc_id % 3 <> 0 AS untouched FROM documents")
def sk1(s, d):
    files = materialise(_packed(s, d, deflate=False))
    t = table(s, d, "documents", "doc_id", "lang").where("doc_id % 3 = 0")
    new = t.select("doc_id", F.explode(F.array(F.struct(F.lit("content/content.json").alias("name"), F.concat(F.lit("new "), "lang").cast("binary").alias("bytes")), F.struct(F.lit("extra.bin").alias("name"), F.lit(b"x").alias("bytes")))).alias("e")).select("doc_id", "e.*")
    made = materialise(C.rewritten(files, new))
    held = C.entries(made)
    # what the manifest says of the content is what the entry holds
    said = held.where("name = 'manifest.json'").select("doc_id", F.get_json_object(F.col("bytes").cast("string"), "$.layers.content.sha256").alias("content"))
    same = files.select("doc_id", F.sha2("content", 256).alias("_a")).join(made.select("doc_id", F.sha2("content", 256).alias("_b")), "doc_id").select("doc_id", (F.col("_a") == F.col("_b")).alias("untouched"))
    return held.groupBy("doc_id").agg(F.count("*").alias("entries")).join(said, "doc_id").join(same, "doc_id")


@query("sk3_header_bytes", "SELECT p_partkey AS doc_id, 1 AS major, p_size AS minor, 32 + length(p_name) AS header_size, p_size * 1000 AS flags, 32 + length(p_name) AS zip_offset, true AS crc_ok, p_name AS extension FROM part")
def sk3(s, d):
    t = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("minor"), (F.col("p_size") * 1000).alias("flags"), F.col("p_name").cast("binary").alias("extension"))
    f = C.header_fields(F.col("content"))
    return C.headers(t).select("doc_id", *[c.alias(k) for k, c in f.items()], F.expr("substring(content, 33)").cast("string").alias("extension"))


LOST = f"{N('<style')} + {N('<script')} + {N('<!--')} + {N('<nav>')} + {N('<footer>')}"


@query("cm1_import_container", f"SELECT page_id AS doc_id, '1.0' AS format_version, 1 AS current_revision, 3 AS n_layers, 3 AS layers_ok, 1 AS n_caches, 1 AS fresh_caches, '' AS unknown_keys, 1 AS n_reports, {LOST} AS lost FROM pages")
def cm1(s, d):
    return M.info(materialise(M.import_documents(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html")))


@query("cm1_import_entries", f"SELECT page_id AS doc_id, {N('<nav>')} + {N('<footer>')} + {N('<!--')} AS payloads, 5 AS others FROM pages")
def cm1b(s, d):
    held = C.entries(M.import_documents(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html"))
    kept = F.col("name").startswith("preserved/")
    return held.groupBy("doc_id").agg(F.count_if(kept).alias("payloads"), F.count_if(~kept).alias("others"))


@query("cm2_info", f"SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 3 END AS layers_ok, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS fresh_caches, CASE WHEN page_id % 2 = 0 THEN 'notes' ELSE '' END AS unknown_keys, {LOST} + CASE WHEN page_id % 5 = 0 THEN 7 ELSE 0 END AS lost FROM pages")
def cm2(s, d):
    files = materialise(M.import_documents(table(s, d, "pages", "page_id", "html"), "html", "page_id", "html"))
    held = C.entries(files).select("doc_id", "name", "bytes")
    # the content is changed behind the manifest's back, the manifest gets a member of another name, and a second report comes in
    text = F.col("bytes").cast("string")
    changed = F.when((F.col("name") == M.CONTENT) & (F.col("doc_id") % 3 == 0), F.concat(text, F.lit(" ")))
    changed = changed.when((F.col("name") == "manifest.json") & (F.col("doc_id") % 2 == 0), F.concat(F.lit('{"notes": 1, '), F.expr("substring(cast(bytes as string), 2)"))).otherwise(text)
    body = F.lit('{"summary": {"loss": {"none": 9, "partial": 4, "degraded": 3, "unsupported": 0, "preserved_raw": 0}}}')
    more = files.where("doc_id % 5 = 0").select("doc_id", F.lit("reports/export-0001.json").alias("name"), body.cast("binary").alias("bytes"))
    return M.info(C.packed(held.withColumn("bytes", F.when(text.isNotNull(), changed.cast("binary"))).unionByName(more))).select("doc_id", "layers_ok", "fresh_caches", "unknown_keys", "lost")


@query("sk12_inconsistent_reports", "SELECT DISTINCT user_id AS doc_id, user_id % 2 = 0 AS consistent FROM events")
def sk12(s, d):
    from parchment.plans.relations import _events

    made = L.reports(_events(s, d), "events", "report")
    # every other report claims one partial loss more than it lists
    more = F.get_json_object("report", "$.summary.loss.partial").cast("int") + 1
    wrong = F.regexp_replace("report", F.lit('"partial":[0-9]+'), F.concat(F.lit('"partial":'), more.cast("string")))
    return L.consistent(made.withColumn("report", F.when(F.col("doc_id") % 2 == 1, wrong).otherwise(F.col("report"))))


@query("sk16_editor_schema")
def sk16(s, d):
    spec = E.schema_spec()
    rows = [("node", k, v["group"], v["content"]) for k, v in spec["nodes"].items()] + [("mark", k, str(v["rank"]), ",".join(v["attrs"])) for k, v in spec["marks"].items()]
    return s.createDataFrame(rows, "kind string, name string, place string, content string")


@query("sk17_replaced_table", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def sk17(s, d):
    import uuid

    path = f"{shared_dir(s)}/replaced-{uuid.uuid4().hex}"
    first = replace(table(s, d, "documents", "doc_id", "lang"), path)
    return replace(first.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))), path)


# the model pipeline

MODEL = r"concat('# ', p_name, '\n\n', p_type, '\n\n', p_name, ' ', repeat('ab ', p_size), 'end\n\n', p_brand, ' is a *part* of', repeat(' cd', 7), '.')"
LISTED = "l AS (SELECT p_partkey AS doc_id, unnest([1, 2, 3]) AS k, unnest([p_type, p_name || ' ' || repeat('ab ', p_size) || 'end', p_brand || ' is a part of' || repeat(' cd', 7) || '.']) AS text FROM part)"


@query("cm15_listing", "SELECT p_partkey AS doc_id, unnest(['heading', 'paragraph', 'paragraph', 'paragraph']) AS type, unnest([p_name, p_type, left(p_name || ' ' || repeat('ab ', p_size) || 'end', 240), p_brand || ' is a part of' || repeat(' cd', 7) || '.']) AS shown FROM part")
def cm15(s, d):
    return M.listing(I.nodes_of(_read(s, d, "markdown", MODEL))).select("doc_id", "type", "shown")


@query("cm15_annotations", f"WITH {LISTED} SELECT doc_id, left(text, 24) AS exact FROM l WHERE length(text) >= 20")
def cm15b(s, d):
    # headings are proposed as well, but the guards take paragraphs alone
    return M.model_pipeline(materialise(I.nodes_of(_read(s, d, "markdown", MODEL))))[0].select("doc_id", "exact")


@query("cm15_commits", f"WITH {LISTED} SELECT doc_id, 2 AS rev, 1 AS parent, text || '.' AS text FROM l WHERE length(text) >= 20 AND NOT ends_with(text, '.')")
def cm15c(s, d):
    return M.model_pipeline(materialise(I.nodes_of(_read(s, d, "markdown", MODEL))))[1].select("doc_id", "rev", "parent", "text")


@query("pj10_rewrite_block", "SELECT p_partkey AS doc_id, unnest(['content[0]', 'content[1]']) AS path, unnest([p_name || '!', p_brand || ' x']) AS text, unnest([1, 2]) AS spans FROM part")
def pj10(s, d):
    nodes = materialise(I.nodes_of(_read(s, d, "markdown", r"concat('**', p_name, '** and *', p_type, '*\n\n', p_brand, ' *x*')")))
    blocks = nodes.where("path = 'content[0]'").select("doc_id", F.col("node_id").alias("target_block"))
    names = table(s, d, "part", F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit("!")).alias("text"))
    made = M.rewrite_blocks(nodes, blocks.join(names, "doc_id"))
    spans = made.where("kind = 'span' and depth = 1").groupBy("doc_id", "path").agg(F.lit(1)).select("doc_id", F.regexp_extract("path", r"^(content\[\d\])", 1).alias("path")).groupBy("doc_id", "path").agg(F.count("*").alias("spans"))
    return S.plain_spans(made).join(spans, ["doc_id", "path"])


# saving

ASSETS = """{"type":"figure","attrs":{"id":"blk_A","asset":"', CASE p_partkey % 5 WHEN 0 THEN 'asset://as_S/x' WHEN 1 THEN 'asset://as_R/x' WHEN 2 THEN 'data:image/png;base64,QUJD' WHEN 3 THEN concat('https://example.com/', p_partkey) ELSE 'x.png' END, '"}}"""


@query(
    "cm16_persist_assets",
    """SELECT p_partkey AS doc_id, ['embedded', 'registered', 'embedded', 'external', NULL][p_partkey % 5 + 1] AS storage, CASE p_partkey % 5 WHEN 0 THEN 'text/plain' WHEN 2 THEN 'image/png' END AS mime,
       CASE p_partkey % 5 WHEN 0 THEN sha256(p_name) WHEN 2 THEN sha256('ABC') END AS sha256, CASE p_partkey % 5 WHEN 3 THEN 'https://example.com/' || p_partkey END AS url, p_partkey % 5 = 4 AS warned FROM part""",
)
def cm16(s, d):
    # each reference stands twice in its document, and is saved once
    nodes = I.nodes_of(_read(s, d, "editor", _editor(f"concat('{ASSETS},{ASSETS.replace('blk_A', 'blk_B')}')")))
    t = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    staged = t.select("doc_id", F.lit("as_S").alias("asset_id"), F.lit("text/plain").alias("mime"), F.col("p_name").cast("binary").alias("bytes"))
    found = persist_assets(nodes, staged, t.select("doc_id", F.lit("as_R").alias("asset_id")))
    return found.select("doc_id", "storage", "mime", "sha256", "url", F.col("warning").isNotNull().alias("warned"))


FORMATTED = _editor("""concat('{"type":"paragraph","attrs":{"id":"blk_A","extra":{"format":{"fontSize":"', p_size, '","align":"left"},"own":"', p_name, '"}}}')""")
FORMAT = {k: f"$.{k}" for k in ("format.fontSize", "format.align", "format.color", "own")}


def _formats(nodes):
    return nodes.select("doc_id", *[F.get_json_object("extra", p).alias(k.split(".")[-1]) for k, p in FORMAT.items()])


@query("cm21_set_format", "SELECT p_partkey AS doc_id, CAST(p_size AS VARCHAR) AS \"fontSize\", 'center' AS align, '#00ff00' AS color, p_name AS own FROM part")
def cm21(s, d):
    nodes = I.nodes_of(_read(s, d, "editor", FORMATTED)).where("type = 'paragraph'")
    return _formats(T.set_format(T.set_format(nodes, "align", "center"), "color", "#00ff00"))


@query("cm21_clear_format", "SELECT p_partkey AS doc_id, CAST(NULL AS VARCHAR) AS \"fontSize\", 'left' AS align, CAST(NULL AS VARCHAR) AS color, p_name AS own FROM part")
def cm21b(s, d):
    return _formats(T.set_format(I.nodes_of(_read(s, d, "editor", FORMATTED)).where("type = 'paragraph'"), "fontSize", None))


# printing


@query("pj6_inline_script", r"SELECT page_id, regexp_replace(html, '<script[^>]*>.*?</script>', E'<script>\nrun()\n</script>', 's') AS html FROM pages")
def pj6(s, d):
    return table(s, d, "pages", "page_id", "html").select("page_id", X.inline_first_script(F.col("html"), F.lit("run()")).alias("html"))


@query(
    "pj9_normal_theme",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'Letter' ELSE 'A4' END AS page_size, CASE WHEN p_partkey % 3 = 2 THEN 'landscape' ELSE 'portrait' END AS orientation,
       CASE WHEN p_partkey % 3 = 1 THEN least(60.0, greatest(5.0, p_size * 2.0)) WHEN p_partkey % 3 = 2 THEN 30.0 ELSE 22.0 END AS top, CASE WHEN p_partkey % 3 = 2 THEN 40.0 ELSE 18.0 END AS "left", CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS header FROM part""",
)
def pj9(s, d):
    theme = """CASE p_partkey % 3 WHEN 0 THEN concat('{"pageSize":"Letter","header":"', p_name, '"}') WHEN 1 THEN concat('{"margins":{"top":', p_size * 2, '}}') ELSE '{"defaults":{"page":{"size":"A4 landscape","margin":"30mm 40mm"}}}' END"""
    found = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), X.normal_theme(F.expr(theme)).alias("t"))
    return found.select("doc_id", "t.page_size", "t.orientation", "t.top", "t.left", "t.header")


@query("fn16_preview_hash", "SELECT doc_id, sha256(text || lang || 'css1' || 'paged') AS hash FROM documents")
def fn16(s, d):
    return table(s, d, "documents").select("doc_id", X.preview_hash(F.col("text"), F.col("lang"), "css1", "paged").alias("hash"))


@query("fn17_file_fingerprint", "SELECT p_partkey, sha256(encode(p_name) || unhex(printf('%02x', p_size) || '00000000000000') || unhex(printf('%02x', p_size + 1) || '01000000000000')) AS fingerprint FROM part")
def fn17(s, d):
    return table(s, d, "part").select("p_partkey", X.file_fingerprint(F.col("p_name"), F.col("p_size"), F.col("p_size") + 257).alias("fingerprint"))


# lookups and counts over parsed pages


@query("jn2_asset_filenames", "SELECT p_partkey AS doc_id, p_partkey || '.png' AS filename FROM part")
def jn2(s, d):
    docs = _read(s, d, "html", "concat('<p>a <img src=\"https://example.com/i/', p_partkey, '.png?x=1\">')")
    return R.asset_urls(I.nodes_of(docs).where("type = 'inline_image'"), I.assets_of(docs)).select("doc_id", F.col("asset_filename").alias("filename"))


@query("w5_list_markers", "SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS ord, unnest([(p_size + 3) || '. ', (p_size + 4) || '. ', (p_size + 5) || '. ']) AS marker FROM part")
def w5(s, d):
    return S.list_items(I.nodes_of(_read(s, d, "html", "concat('<ol start=', p_size + 3, '><li>a<li>b<li>', p_name, '</ol>')"))).select("doc_id", "ord", "marker")


@query("se3_payload_refs", f"SELECT page_id AS doc_id, {N('<nav>')} + {N('<footer>')} + {N('<!--')} AS refs FROM pages")
def se3(s, d):
    return R.first_refs(I.nodes_of(_pages(s, d)), "payload_ref").groupBy("doc_id").agg(F.count("*").alias("refs"))


@query("ag11_count_chars", "SELECT doc_id, length(text) AS n FROM documents WHERE text = trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AND NOT regexp_matches(text, '[^A-Za-zÀ-ÿ ,.]')")
def ag11(s, d):
    t = table(s, d, "documents", "doc_id", "text")
    plain = t.where((F.col("text") == X.collapse_blanks(F.col("text"))) & ~F.col("text").rlike("[^A-Za-zÀ-ÿ ,.]"))
    return S.count_chars(I.nodes_of(I.imported(plain, "markdown"))).select("doc_id", "n")


@query("ag15_text_index", "SELECT p_partkey AS doc_id, p_type AS second FROM part")
def ag15(s, d):
    index = S.text_index(I.nodes_of(_read(s, d, "markdown", r"concat(p_name, '\n\n*', p_type, '*\n\n', p_brand)")))
    return index.select("doc_id", F.col("index")["content[1]"].alias("second"))


# sessions


@query("ts2_one_job_at_a_time", "WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'end' ELSE event_type END AS e FROM events), l AS (SELECT *, last_value(CASE WHEN e IN ('start', 'end') THEN e END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e) SELECT event_id, e = 'start' AND coalesce(p = 'start', false) AS busy FROM l")
def ts2(s, d):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "end").otherwise(F.col("event_type"))
    return J.busy(table(s, d, "events").select("event_id", "user_id", kind.alias("event")), "user_id", "event_id", "event").select("event_id", "busy")


@query("ts7_open_once", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS session FROM events")
def ts7(s, d):
    return J.opened_once(table(s, d, "events", "event_id", "user_id", "event_type"), "user_id", "event_type", "event_id").select("event_id", "session")


@query(
    "ts8_publish_conflicts",
    """WITH w AS (SELECT user_id, event_id AS t, event_id % 3 AS sha FROM events WHERE event_type = 'view'), j AS (SELECT user_id, event_id AS job, event_id + 1 AS s, event_id + 200 AS c FROM events WHERE event_type = 'click')
       SELECT user_id, job, (SELECT arg_max(sha, t) FROM w WHERE w.user_id = j.user_id AND t <= s) IS DISTINCT FROM (SELECT arg_max(sha, t) FROM w WHERE w.user_id = j.user_id AND t <= c) AS conflict FROM j""",
)
def ts8(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    writes = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at"), (F.col("event_id") % 3).cast("string").alias("sha"))
    jobs = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("job"), (F.col("event_id") + 1).alias("started"), (F.col("event_id") + 200).alias("committed"))
    return J.publish_conflicts(jobs, writes, "user_id")
