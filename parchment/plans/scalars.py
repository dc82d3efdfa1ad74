"""Scalar functions over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import assets as A
from parchment.functions import text as X
from parchment.plans.catalog import query, table


def _docs(s, d):
    return table(s, d, "documents", "doc_id", "text", "lang", "source", "n_chars")


@query("fn3_visual_width", r"SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]')) AS width FROM documents")
def fn3(s, d):
    return _docs(s, d).select("doc_id", X.visual_width(F.col("text")).cast("long").alias("width"))


MIME_SQL = "CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.MIME.items()) + f" ELSE '{A.OTHER}' END"


@query("fn4_guess_mime", f"WITH n AS (SELECT page_id, split_part(url, '?', 1) AS name FROM pages) SELECT page_id, {MIME_SQL} AS mime FROM n")
def fn4(s, d):
    return table(s, d, "pages", "page_id", "url").select("page_id", A.mime_of(F.col("url")).alias("mime"))


EXT_SQL = "CASE mime " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.EXTENSION.items()) + " ELSE 'bin' END"


@query("fn5_mime_extension", f"WITH m AS (SELECT event_id, 'image/' || CASE event_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'svg+xml' WHEN 3 THEN 'bmp' ELSE 'tiff' END AS mime FROM events) SELECT event_id, {EXT_SQL} AS ext FROM m")
def fn5(s, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("png", "jpeg", "svg+xml", "bmp", "tiff")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events", "event_id").select("event_id", A.extension_of(F.concat(F.lit("image/"), kind)).alias("ext"))


@query("fn6_data_uri", "SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS uri FROM benchmark")
def fn6(s, d):
    return table(s, d, "benchmark").select("item_id", A.data_uri(F.lit("text/plain"), F.col("text").cast("binary")).alias("uri"))


@query("fn7_decode_data_uri", "SELECT item_id, 'text/plain' AS mime, text FROM benchmark")
def fn7(s, d):
    uri = A.data_uri(F.lit("text/plain"), F.col("text").cast("binary"))
    return table(s, d, "benchmark").select("item_id", A.data_uri_mime(uri).alias("mime"), A.data_uri_payload(uri).cast("string").alias("text"))


@query("fn8_sanitize_filename", r"WITH n AS (SELECT page_id, regexp_replace(substr(regexp_extract(url, '([^/\\]*)$', 1), 1, 100), '^[. ]+|[. ]+$', '', 'g') AS f FROM pages) SELECT page_id, CASE WHEN f = '' THEN 'asset' ELSE f END AS filename FROM n")
def fn8(s, d):
    return table(s, d, "pages", "page_id", "url").select("page_id", A.sanitize_filename(F.col("url")).alias("filename"))


@query("fn9_collapse_ws", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM documents")
def fn9(s, d):
    return _docs(s, d).select("doc_id", X.collapse_blanks(F.col("text")).alias("text"))


@query("fn10_escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def fn10(s, d):
    return table(s, d, "pages", "page_id", "html").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@query("fn12_inline_code", "SELECT item_id, repeat('`', 1 + length(t) - length(replace(t, '`', ''))) || CASE WHEN starts_with(t, '`') OR ends_with(t, '`') THEN ' ' ELSE '' END || t || CASE WHEN starts_with(t, '`') OR ends_with(t, '`') THEN ' ' ELSE '' END || repeat('`', 1 + length(t) - length(replace(t, '`', ''))) AS code FROM (SELECT item_id, replace(text, ' th', ' `h') AS t FROM benchmark)")
def fn12(s, d):
    return table(s, d, "benchmark").select("item_id", X.inline_code(F.replace("text", F.lit(" th"), F.lit(" `h"))).alias("code"))


@query("fn13_table_cell", r"SELECT doc_id, replace(replace(trim(text), chr(10), ' '), '|', '\|') AS cell FROM documents")
def fn13(s, d):
    return _docs(s, d).select("doc_id", X.table_cell(F.col("text")).alias("cell"))


@query("fn14_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fn14(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("fn18_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def fn18(s, d):
    return table(s, d, "events", "event_id", "ts").select("event_id", X.rfc3339(F.col("ts")).alias("at"))


@query("fn19_split_author", "SELECT conv_id, turn, role AS author_type, CAST(conv_id AS VARCHAR) AS author_id FROM conversations")
def fn19(s, d):
    kind, who = X.split_author(F.concat("role", F.lit(": "), F.col("conv_id").cast("string")))
    return table(s, d, "conversations").select("conv_id", "turn", kind.alias("author_type"), who.alias("author_id"))


@query("fn20_truncate", "SELECT doc_id, left(text, 80) AS head FROM documents")
def fn20(s, d):
    return _docs(s, d).select("doc_id", X.truncate(F.col("text"), 80).alias("head"))


@query("fn21_context", "WITH t AS (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents) SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 8, 1), p - greatest(p - 8, 1)) END AS prefix, CASE WHEN p > 0 THEN substr(text, p + 5, 8) END AS suffix FROM t")
def fn21(s, d):
    before, after = X.context_of(F.col("text"), F.lit(" the "))
    return _docs(s, d).select("doc_id", before.alias("prefix"), after.alias("suffix"))


@query("fn22_model_json", "SELECT event_id, props AS answer FROM events WHERE props LIKE '{%'")
def fn22(s, d):
    answer = X.fenced_json(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\n")))
    return table(s, d, "events", "event_id", "props").select("event_id", answer.alias("answer")).where("answer is not null")


@query("fn24_points", "SELECT p_partkey, CASE WHEN p_size * 3 % 20 = 0 THEN CAST(p_size * 3 // 20 AS VARCHAR) || 'pt' ELSE printf('%.1f', floor(p_size * 3 / 20.0 * 10 + 0.5) / 10) || 'pt' END AS pt FROM part")
def fn24(s, d):
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", X.points(F.col("p_size") * 3, 20).alias("pt"))


@query("fn25_column_fraction", "SELECT p_partkey, round(p_size * 1.0 / sum(p_size) OVER (PARTITION BY p_brand), 6) AS fraction FROM part")
def fn25(s, d):
    from pyspark.sql import Window

    return table(s, d, "part").select("p_partkey", F.round(F.col("p_size") * 1.0 / F.sum("p_size").over(Window.partitionBy("p_brand")), 6).alias("fraction"))


@query("fn26_heading_level", "WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN turn % 8 END AS o, CASE WHEN turn % 4 = 1 THEN 'Heading ' || (conv_id % 8) END AS n, 'heading' || (turn % 9) AS i FROM conversations) SELECT conv_id, turn, coalesce(CASE WHEN o BETWEEN 0 AND 5 THEN o + 1 END, TRY_CAST(nullif(regexp_extract(n, '(?i)^heading ?([1-6])$', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(i, '(?i)^heading ?([1-6])$', 1), '') AS INT)) AS level FROM t")
def fn26(s, d):
    t = table(s, d, "conversations", "conv_id", "turn")
    outline = F.when(F.col("turn") % 4 == 0, F.col("turn") % 8)
    name = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Heading "), (F.col("conv_id") % 8).cast("string")))
    return t.select("conv_id", "turn", X.heading_level(outline, name, F.concat(F.lit("heading"), (F.col("turn") % 9).cast("string"))).cast("long").alias("level"))


@query("fn28_entities", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '&' WHEN 1 THEN '<' WHEN 2 THEN 'A' ELSE '&nosuch;' END AS resolved FROM events")
def fn28(s, d):
    name = F.element_at(F.array(F.lit("amp"), F.lit("lt"), F.lit("#65"), F.lit("nosuch")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(s, d, "events", "event_id").select("event_id", X.resolve_entity(name).alias("resolved"))


@query("fn29_text_pieces", "SELECT item_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words FROM benchmark")
def fn29(s, d):
    return table(s, d, "benchmark").select("item_id", F.size(X.text_pieces(F.col("text"))).cast("long").alias("words"))


@query("fn30_class_language", "SELECT doc_id, lang AS language FROM documents")
def fn30(s, d):
    return _docs(s, d).select("doc_id", X.class_language(F.concat(F.lit("code language-"), "lang", F.lit(" wide"))).alias("language"))


@query("fn31_indent", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN l = '' THEN l ELSE '  ' || l END), chr(10)) AS text FROM documents")
def fn31(s, d):
    return _docs(s, d).select("doc_id", X.indent_lines(F.col("text"), "  ").alias("text"))


@query("fn32_compat_path", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'compatibility/markdown/document.md' WHEN 1 THEN 'compatibility/text/document.txt' WHEN 2 THEN 'compatibility/html/index.html' WHEN 3 THEN 'compatibility/docx/document.docx' END AS path FROM events")
def fn32(s, d):
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("markdown", "text", "html", "docx", "pdf")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events", "event_id").select("event_id", X.compat_path(fmt).alias("path"))


@query("fn34_file_url", "SELECT page_id, 'file://' || replace(url_encode('/tmp/a b/' || page_id || '.html'), '%2F', '/') AS url FROM pages")
def fn34(s, d):
    return table(s, d, "pages", "page_id").select("page_id", X.percent_encoded(F.concat(F.lit("/tmp/a b/"), F.col("page_id").cast("string"), F.lit(".html"))).alias("url"))


@query("fn35_css", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 2 = 0 THEN 'font-weight: bold' END, CASE WHEN p_size % 3 = 0 THEN 'font-style: italic' END, 'font-size: ' || p_size || 'pt', 'color: #00' || lpad(CAST(p_size AS VARCHAR), 4, '0')) AS css FROM part")
def fn35(s, d):
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", X.character_css(size % 2 == 0, size % 3 == 0, size, F.concat(F.lit("#00"), F.lpad(size.cast("string"), 4, "0"))).alias("css"))


@query("fn39_find_all", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM documents")
def fn39(s, d):
    return _docs(s, d).select("doc_id", X.find_all(F.col("text"), "the").cast("long").alias("hits"))


@query("fn41_recovery_key", "SELECT doc_id, left(sha256(source || '/' || doc_id), 24) || '.draft.json' AS name FROM documents")
def fn41(s, d):
    return _docs(s, d).select("doc_id", X.recovery_name(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("name"))


@query("fn42_asset_id", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'as_' || doc_id END AS asset_id FROM documents")
def fn42(s, d):
    i = F.col("doc_id").cast("string")
    return _docs(s, d).select("doc_id", A.asset_id(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("asset://as_"), i, F.lit("/x.png"))).otherwise(F.concat(F.lit("http://x/"), i))).alias("asset_id"))


@query("ag18_fence_length", "SELECT item_id, greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(replace(text, 'th', '````'), '(`+)', 1), lambda x: length(x))), 0)) AS fence FROM benchmark")
def ag18(s, d):
    return table(s, d, "benchmark").select("item_id", X.fence_length(F.replace("text", F.lit("th"), F.lit("````"))).cast("long").alias("fence"))


@query("ag12_largest_count", "SELECT p_partkey, greatest(p_size, 7) AS pages FROM part")
def ag12(s, d):
    text = F.concat(F.lit("<< /Count 7 >> << /Count "), F.col("p_size").cast("string"), F.lit(" >>"))
    return table(s, d, "part").select("p_partkey", X.largest_number_after(text, "/Count").alias("pages"))


ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@query("w1_idgen", f"WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, 'blk_' || array_to_string(list_transform(range(26), lambda i: substr('{ALPHABET}', CAST(1 + CASE WHEN i < 12 THEN (n // CAST(32 ** i AS BIGINT)) % 32 ELSE 0 END AS BIGINT), 1)), '') AS node_id FROM t")
def w1(s, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _docs(s, d).withColumn("n", n).select("doc_id", X.identifier(F.col("n"), "blk").alias("node_id"))


@query("fl10_valid_id", f"SELECT doc_id, regexp_full_match(i, '(doc|sec|blk|li|cel|col|row|as|ann|rev|pub|iss)_[0-9A-HJKMNP-TV-Z]{{26}}') AS valid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'blk_' ELSE 'xyz_' END || CASE doc_id % 2 WHEN 0 THEN upper(left(sha256(text), 26)) ELSE left(sha256(text), 26) END AS i FROM documents)")
def fl10(s, d):
    h = F.substring(F.sha2("text", 256), 1, 26)
    value = F.concat(F.when(F.col("doc_id") % 3 == 0, "blk_").otherwise("xyz_"), F.when(F.col("doc_id") % 2 == 0, F.upper(h)).otherwise(h))
    return _docs(s, d).select("doc_id", X.valid_id(value).alias("valid"))


@query("fl12_safe_part", "SELECT event_id, event_id % 4 > 1 AS safe FROM events")
def fl12(s, d):
    name = F.element_at(F.array(F.lit("../x"), F.lit("/etc/x"), F.lit("word/document.xml"), F.lit("a..b/c")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(s, d, "events", "event_id").select("event_id", X.safe_part(name).alias("safe"))


@query("fl13_active_elements", "SELECT page_id, len(regexp_extract_all(html, '(?i)<(script|iframe|object|embed|applet)[ />]')) AS active FROM pages")
def fl13(s, d):
    tags = F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)[ />]"), F.lit(1))
    return table(s, d, "pages", "page_id", "html").select("page_id", F.size(F.filter(tags, X.is_active)).cast("long").alias("active"))


@query("fl15_safe_url", "SELECT page_id, page_id % 4 IN (0, 3) AS safe_link, page_id % 4 IN (0, 2) AS safe_image FROM pages")
def fl15(s, d):
    url = F.element_at(F.array(F.col("url"), F.lit("javascript:alert(1)"), F.lit("data:image/png;base64,AA"), F.lit("mailto:a@example.com")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(s, d, "pages", "page_id", "url").select("page_id", X.safe_url(url).alias("safe_link"), X.safe_url(url, "image").alias("safe_image"))


@query("fl16_allowed_asset", "SELECT doc_id, n_chars > 0 AND n_chars <= 33554432 AND doc_id % 2 = 0 AS allowed FROM documents")
def fl16(s, d):
    mime = F.when(F.col("doc_id") % 2 == 0, "image/png").otherwise("text/html")
    return _docs(s, d).select("doc_id", A.allowed(mime, F.col("n_chars")).alias("allowed"))


@query("fl20_has_class", "SELECT doc_id, source = 'src0' AS found FROM documents")
def fl20(s, d):
    return _docs(s, d).select("doc_id", X.has_class(F.concat(F.lit(" wide  "), "source", F.lit(" x")), "src0").alias("found"))


@query("pj4_inject_block_id", "SELECT page_id, left(h, instr(h, '>') - 1) || ' data-block-id=\"blk_' || page_id || '\"' || substr(h, instr(h, '>')) AS marked FROM (SELECT page_id, regexp_extract(html, '<article>.*', 0, 's') AS h FROM pages WHERE html LIKE '%<article>%')")
def pj4(s, d):
    t = table(s, d, "pages", "page_id", "html").where(F.col("html").contains("<article>"))
    return t.select("page_id", X.inject_attribute(F.regexp_extract("html", "(?s)<article>.*", 0), "data-block-id", F.concat(F.lit("blk_"), F.col("page_id").cast("string"))).alias("marked"))


@query("pj5_augment_print", "SELECT page_id, regexp_replace(html, '^(.*)</head>', '\\1<style>@page{margin:20mm}</style></head>', 's') AS html FROM pages")
def pj5(s, d):
    return table(s, d, "pages", "page_id", "html").select("page_id", X.inject_before_last(F.col("html"), "</head>", "<style>@page{margin:20mm}</style>").alias("html"))


@query("pj7_page_css", "SELECT p_partkey, printf('@page { size: %.1fmm %.1fmm; margin: %.1fmm } /* %s */', p_size * 10.0, 297.0, least(greatest(p_size * 2.0, 5.0), 60.0), CASE WHEN p_size * 10 > 297 THEN 'landscape' ELSE 'portrait' END) AS css FROM part")
def pj7(s, d):
    return table(s, d, "part").select("p_partkey", X.page_css(F.col("p_size") * 10, F.lit(297), F.col("p_size") * 2).alias("css"))


@query("pj8_css_string", r"""SELECT item_id, replace(replace(replace(text || '"\' || chr(10), '\', '\\'), '"', '\"'), chr(10), '\A ') AS css FROM benchmark""")
def pj8(s, d):
    return table(s, d, "benchmark").select("item_id", X.css_string(F.concat("text", F.lit('"\\\n'))).alias("css"))


@query("sc25_front_matter", "SELECT doc_id, source AS title, lang AS language, CAST(NULL AS VARCHAR) AS missing FROM documents")
def sc25(s, d):
    text = F.concat(F.lit("---\ntitle: \""), "source", F.lit('"\nlang: '), "lang", F.lit("\n---\n"), "text")
    return _docs(s, d).select("doc_id", X.front_matter(text, "title").alias("title"), X.front_matter(text, "lang").alias("language"), X.front_matter(text, "absent").alias("missing"))


@query("sc26_detect_format", "SELECT page_id, CASE lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.([^./]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'docx' THEN 'docx' END AS format FROM pages")
def sc26(s, d):
    return table(s, d, "pages", "page_id", "url").select("page_id", X.detect_format(F.regexp_extract("url", "^[^?#]*", 0)).alias("format"))
