"""Word-processing packages: written from the part table's columns, read by the library, held against the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators import structure as S
from parchment.operators import tables as T
from parchment.plans.catalog import query, table
from parchment.sources import importers as I
from parchment.sources import ooxml as O
from parchment.sources.docx import imported_docx
from parchment.store import materialise


def _p(text: str, properties: str = "", run: str = "") -> str:
    """A paragraph, as arguments of concat(); text is a SQL expression."""
    return f"""'<w:p><w:pPr>{properties}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">', {text}, '</w:t></w:r></w:p>'"""


def _r(text: str, run: str = "") -> str:
    return f"""'<w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">', {text}, '</w:t></w:r>'"""


NUMBER = '<w:numPr><w:ilvl w:val="{0}"/><w:numId w:val="{1}"/></w:numPr>'


def _packages(s, d, body: str, **parts: str) -> DataFrame:
    """A package for each part row: the body, and other parts as (root element, SQL expression of what is in it)."""
    t = table(s, d, "part")
    made = {"word/document.xml": O.document(F.expr(f"concat('', {body})"))}
    for name, (root, inner) in parts.items():
        made[f"word/{name}.xml"] = O.part(root, F.expr(f"concat('', {inner})"))
    return O.zipped(t, made, "p_partkey")


def _with(s, d, more: dict[str, str], body: str = _p("p_name")) -> DataFrame:
    """A package with other parts, given whole as SQL expressions; null leaves one out."""
    made = {"word/document.xml": O.document(F.expr(f"concat('', {body})"))} | {n: F.expr(x) for n, x in more.items()}
    return O.zipped(table(s, d, "part"), made, "p_partkey")


def _rels(*inner: str) -> str:
    return f"concat('<Relationships xmlns=\"{O.RELATIONSHIPS}\">', {', '.join(inner)}, '</Relationships>')"


RELS = "word/_rels/document.xml.rels"
IMAGE_REL = """'<Relationship Id="rId1" Type="http://x/image" Target="media/x.png"/>'"""


def _lost(docs: DataFrame) -> DataFrame:
    return I.loss_of(docs).where("loss_class <> 'none'").select("doc_id", "feature", "loss_class")


# readers and parts


@query("sc11_reader_choice", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 > 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_type END AS text, CASE WHEN p_partkey % 3 > 0 THEN 'native' WHEN p_partkey % 2 = 0 THEN 'tree' ELSE 'none' END AS reader FROM part")
def sc11(s, d):
    tree = """CASE WHEN doc_id % 2 = 0 THEN concat('{"blocks":[{"t":"Para","c":[{"t":"Str","c":"', p_type, '"}]}]}') END"""
    files = _packages(s, d, _p("p_name")).join(table(s, d, "part", F.col("p_partkey").alias("doc_id"), "p_type"), "doc_id")
    files = files.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(b"broken")).otherwise(F.col("content")).alias("content"), F.expr(tree).alias("tree"))
    docs = imported_docx(files, tree="tree")
    found = I.loss_of(docs).groupBy("doc_id").agg(F.max(F.when(F.col("feature") == "docx_reader_fallback", "tree").when(F.col("feature") == "docx_unreadable", "none")).alias("r"))
    return docs.select("doc_id").join(S.plain_spans(I.nodes_of(docs)), "doc_id", "left").join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("r", F.lit("native")).alias("reader"))


@query("sc16_unreadable_packages", "SELECT p_partkey AS doc_id, p_partkey % 4 < 2 AS failed, CASE WHEN p_partkey % 4 >= 2 THEN 1 END AS names FROM part")
def sc16(s, d):
    # one in four is no archive, one holds a document type declaration
    declared = O.zipped(table(s, d, "part").where("p_partkey % 4 = 1"), {"word/document.xml": F.lit("<!DOCTYPE x><x/>")}, "p_partkey")
    files = _packages(s, d, _p("p_name")).where("doc_id % 4 <> 1").unionByName(declared)
    files = files.withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.lit(b"PK?")).otherwise(F.col("content")))
    return O.parts_of(files).select("doc_id", F.col("error").isNotNull().alias("failed"), F.when(F.col("names").isNotNull(), F.size("names")).alias("names"))


@query("sc18_doctype_refused", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'document type declaration' END AS reason FROM part")
def sc18(s, d):
    inner = f"concat('<w:document xmlns:w=\"{O.NAMESPACES['w']}\"><w:body/></w:document>')"
    t = table(s, d, "part")
    files = O.zipped(t, {"word/document.xml": F.expr(f"concat(CASE WHEN p_partkey % 2 = 0 THEN '<!DOCTYPE x [<!ENTITY a \"b\">]>' ELSE '' END, {inner})")}, "p_partkey")
    return O.parts_of(files).select("doc_id", F.col("error").alias("reason"))


TARGETS = _rels(IMAGE_REL, """'<Relationship Id="rId2" Type="http://x/hyperlink" Target="https://example.com/', p_partkey, '" TargetMode="External"/>'""", """'<Relationship Id="rId3" Type="http://x/styles" Target="/word/../word/styles.xml"/>'""")


@query(
    "sc17_relationships",
    """SELECT p_partkey AS doc_id, unnest(['rId1', 'rId2', 'rId3']) AS id, unnest(['image', 'hyperlink', 'styles']) AS type, unnest(['media/x.png', 'https://example.com/' || p_partkey, '/word/../word/styles.xml']) AS target,
       unnest([false, true, false]) AS external FROM part""",
)
def sc17(s, d):
    return O.rows(O.parts_of(_with(s, d, {RELS: TARGETS})), "rels").drop("part")


@query("jn12_relationship_targets", "SELECT p_partkey AS doc_id, unnest(['rId1', 'rId2', 'rId3']) AS id, unnest([CASE WHEN p_partkey % 2 = 0 THEN 'word/media/x.png' END, NULL, 'word/styles.xml']) AS part FROM part")
def jn12(s, d):
    more = {RELS: TARGETS, "word/media/x.png": "CASE WHEN p_partkey % 2 = 0 THEN 'png' END", "word/styles.xml": f"'<w:styles xmlns:w=\"{O.NAMESPACES['w']}\"/>'"}
    return O.targets(O.parts_of(_with(s, d, more))).select("doc_id", "id", "part")


@query(
    "sc19_content_types",
    """SELECT p_partkey AS doc_id, unnest(['word/document.xml', 'word/media/x.PNG', 'word/strange.bin', '[Content_Types].xml']) AS part,
       unnest(['main/' || p_size, 'image/png', NULL, 'application/xml']) AS content_type FROM part""",
)
def sc19(s, d):
    types = f"concat('<Types xmlns=\"{O.CONTENT_TYPES}\"><Default Extension=\"png\" ContentType=\"image/png\"/><Default Extension=\"XML\" ContentType=\"application/xml\"/><Override PartName=\"/word/document.xml\" ContentType=\"main/', p_size, '\"/></Types>')"
    return O.content_types(O.parts_of(_with(s, d, {"[Content_Types].xml": types, "word/media/x.PNG": "'png'", "word/strange.bin": "'x'"})))


LEVEL = """'<w:lvl w:ilvl="{0}"><w:start w:val="', {1}, '"/><w:numFmt w:val="{2}"/></w:lvl>'"""
NUMBERING = (
    "numbering",
    f"""'<w:abstractNum w:abstractNumId="7">', {LEVEL.format(0, 'p_size', 'decimal')}, {LEVEL.format(1, '1', 'bullet')}, '</w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="4"><w:abstractNumId w:val="8"/></w:num>'""",
)


@query("sc20_numbering", "SELECT p_partkey AS doc_id, '3' AS num_id, '7' AS abstract_id, unnest([0, 1]) AS ilvl, unnest(['decimal', 'bullet']) AS fmt, unnest([p_size, 1]) AS start FROM part")
def sc20(s, d):
    return O.numbering(O.parts_of(_packages(s, d, _p("p_name"), numbering=NUMBERING)))


LISTED = ", ".join([_p("p_name", NUMBER.format(0, 3)), _p("p_type", NUMBER.format(1, 3)), _p("p_brand", NUMBER.format(0, 3)), _p("'plain'"), _p("p_size", NUMBER.format(0, 4))])


@query("jn15_numbering_levels", "SELECT p_partkey AS doc_id, unnest([0, 1, 2, 4]) AS ord, unnest(['decimal', 'bullet', 'decimal', NULL]) AS fmt, unnest([p_size, 1, p_size, NULL]) AS start FROM part")
def jn15(s, d):
    return O.numbered_paragraphs(O.parts_of(_packages(s, d, LISTED, numbering=NUMBERING))).select("doc_id", "ord", "fmt", "start")


STYLES = (
    "styles",
    """'<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base text"/><w:rPr><w:rFonts w:ascii="', p_type, '"/><w:sz w:val="', 2 * p_size, '"/></w:rPr></w:style>',
       '<w:style w:type="paragraph" w:styleId="Loud"><w:name w:val="Loud"/><w:basedOn w:val="Base"/><w:rPr><w:b/></w:rPr></w:style>',
       '<w:style w:type="paragraph" w:styleId="Note"><w:name w:val="', p_name, '"/><w:basedOn w:val="Loud"/><w:rPr><w:b w:val="0"/><w:sz w:val="30"/></w:rPr></w:style>',
       '<w:style w:type="paragraph" w:styleId="Part"><w:name w:val="heading 3"/></w:style>'""",
)


@query(
    "sc21_styles",
    """SELECT p_partkey AS doc_id, unnest(['Base', 'Loud', 'Note', 'Part']) AS style, unnest(['Base text', 'Loud', p_name, 'heading 3']) AS name, unnest([NULL, 'Base', 'Loud', NULL]) AS based_on,
       unnest([false, true, false, false]) AS bold, unnest([p_type, NULL, NULL, NULL]) AS font, unnest([CAST(p_size AS DOUBLE), NULL, 15.0, NULL]) AS size FROM part""",
)
def sc21(s, d):
    return O.rows(O.parts_of(_packages(s, d, _p("p_name"), styles=STYLES)), "styles").drop("kind")


STYLED = ", ".join([_p("p_name", '<w:pStyle w:val="Note"/>'), _p("p_type", '<w:pStyle w:val="Loud"/>'), _p("p_brand", '<w:pStyle w:val="Note"/>'), _p("p_size", '<w:pStyle w:val="Gone"/>')])


@query(
    "sk20_theme",
    """SELECT p_partkey AS doc_id, unnest(['Note', 'Loud']) AS style, unnest([2, 1]) AS uses, unnest([p_name, 'Loud']) AS name, unnest([true, true]) AS bold, unnest([p_type, p_type]) AS font, unnest([15.0, CAST(p_size AS DOUBLE)]) AS size FROM part""",
)
def sk20(s, d):
    made = O.theme_json(O.theme(materialise(O.parts_of(_packages(s, d, STYLED, styles=STYLES)))))
    one = "array<struct<style:string,uses:bigint,name:string,bold:boolean,font:string,size:double>>"
    return made.select("doc_id", F.inline(F.from_json(F.get_json_object("theme", "$.styles"), one)))


COMMENTS = ("comments", f"""'<w:comment w:id="5" w:author="', p_type, '">', {_p("p_name")}, {_p("p_size")}, '</w:comment><w:comment w:id="6">', {_p("p_brand")}, '</w:comment>'""")
COMMENTED = f"""'<w:p>', {_r("p_type")}, '<w:commentRangeStart w:id="5"/>', {_r("p_name")}, '<w:commentRangeEnd w:id="5"/>', {_r("p_brand")}, '</w:p>', {_p("'between'")}, '<w:p><w:commentRangeStart w:id="9"/>', {_r("p_size")}, '<w:commentRangeEnd w:id="9"/></w:p>'"""


@query("sc22_comments", "SELECT p_partkey AS doc_id, unnest(['5', '6']) AS id, unnest([p_type, 'unknown']) AS author, unnest([p_name || chr(10) || p_size, p_brand]) AS text FROM part")
def sc22(s, d):
    return O.rows(O.parts_of(_packages(s, d, _p("p_name"), comments=COMMENTS)), "comments")


@query("jn14_comments", "SELECT p_partkey AS doc_id, unnest([0, 2]) AS ord, unnest([p_type, NULL]) AS author, unnest([p_name || chr(10) || p_size, NULL]) AS text FROM part")
def jn14(s, d):
    return O.commented_paragraphs(O.parts_of(_packages(s, d, COMMENTED, comments=COMMENTS))).select("doc_id", "ord", "author", "text")


@query(
    "cm19_comment_annotations",
    """SELECT p_partkey AS doc_id, unnest([0, 1]) AS ord, unnest([p_name, CAST(p_size AS VARCHAR)]) AS exact, unnest([p_type, '']) AS prefix, unnest([p_brand, '']) AS suffix, unnest([p_type, 'unknown']) AS author,
       unnest([p_name || chr(10) || p_size, '']) AS value FROM part""",
)
def cm19(s, d):
    docs = imported_docx(_packages(s, d, COMMENTED, comments=COMMENTS))
    return I.annotations_of(docs).select("doc_id", "ord", "exact", "prefix", "suffix", "author", "value")


@query("cm19_comments_over_blocks", "SELECT p_partkey AS doc_id, 'block' AS target_kind, p_name || chr(10) || p_size AS value FROM part")
def cm19b(s, d):
    body = f"""'<w:p>', {_r("p_type")}, '<w:commentRangeStart w:id="5"/>', {_r("p_name")}, '</w:p><w:p>', {_r("p_brand")}, '<w:commentRangeEnd w:id="5"/></w:p>'"""
    return I.annotations_of(imported_docx(_packages(s, d, body, comments=COMMENTS))).select("doc_id", "target_kind", "value")


NOTES = ("footnotes", f"""'<w:footnote w:id="-1">', {_p("'separator'")}, '</w:footnote><w:footnote w:id="0"/><w:footnote w:id="2">', {_p("p_name")}, '</w:footnote>'""")
ENDNOTES = ("endnotes", f"""'<w:endnote w:id="2">', {_p("p_type")}, '</w:endnote>'""")


@query("sc23_notes", "SELECT p_partkey AS doc_id, unnest(['footnote', 'endnote']) AS kind, '2' AS id, unnest([p_name, p_type]) AS text FROM part")
def sc23(s, d):
    return O.rows(O.parts_of(_packages(s, d, _p("p_name"), footnotes=NOTES, endnotes=ENDNOTES)), "notes")


CORE = """concat('<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>', p_name, '</dc:title><dc:creator>', p_type, '</dc:creator><dc:language>en</dc:language><dc:subject/></cp:coreProperties>')"""


@query("sc24_core_properties", "SELECT p_partkey AS doc_id, p_name AS title, 'en' AS language, p_type AS creator FROM part")
def sc24(s, d):
    files = _with(s, d, {"docProps/core.xml": CORE})
    creator = O.rows(O.parts_of(files), "core").where("name = 'creator'").select("doc_id", F.col("value").alias("creator"))
    return imported_docx(files).select("doc_id", "title", "language").join(creator, "doc_id")


# mapping rows


def _read(s, d, body: str, **parts) -> DataFrame:
    return imported_docx(_packages(s, d, body, **parts))


@query("mp15_docx_blocks", "SELECT p_partkey AS doc_id, unnest(['list', 'list', 'paragraph', 'list', 'table']) AS type, unnest(['content[0]', 'content[0].items[0].children[1]', 'content[1]', 'content[2]', 'content[3]']) AS path FROM part")
def mp15(s, d):
    body = f"""{LISTED}, '<w:bookmarkStart w:id="1" w:name="b"/><w:tbl><w:tr><w:tc>', {_p("p_name")}, '</w:tc></w:tr></w:tbl>'"""
    return I.nodes_of(_read(s, d, body, numbering=NUMBERING)).where("type in ('list', 'table') or (type = 'paragraph' and depth = 0)").select("doc_id", "type", "path")


@query("mp15_docx_lists", "SELECT p_partkey AS doc_id, unnest(['content[0]', 'content[0]', 'content[0].items[0].children[1]', 'content[2]']) AS list, unnest([0, 1, 0, 0]) AS ord, unnest(['ordered', 'ordered', 'bullet', 'ordered']) AS style, unnest([nullif(p_size, 1), nullif(p_size, 1), NULL, NULL]) AS start FROM part")
def mp15b(s, d):
    return S.list_items(materialise(I.nodes_of(_read(s, d, LISTED, numbering=NUMBERING)))).select("doc_id", "list", "ord", "style", "start")


@query("mp16_page_setup", "SELECT p_partkey AS doc_id, 10.0 * p_size AS width, 72.0 AS height, 36.0 AS left_margin, 72.0 AS top_margin FROM part")
def mp16(s, d):
    docs = _read(s, d, f"""{_p("p_name")}, '<w:sectPr><w:pgSz w:w="', 200 * p_size, '"/><w:pgMar w:left="720"/></w:sectPr>'""")
    at = lambda k: F.get_json_object("theme", f"$.page.{k}").cast("double")
    return docs.select("doc_id", at("width").alias("width"), at("height").alias("height"), at("left").alias("left_margin"), at("top").alias("top_margin"))


DRAWING = """'<w:r><w:drawing><wp:inline><wp:docPr id="1" name="n" descr="', {0}, '"/><a:blip r:embed="rId1"/></wp:inline></w:drawing></w:r>'"""


@query("mp17_docx_paragraphs", "SELECT p_partkey AS doc_id, unnest(['paragraph', 'heading', 'figure']) AS type, unnest([NULL, 3, NULL]) AS level, unnest([p_name, NULL, NULL]) AS style, unnest([NULL, NULL, p_type]) AS alt FROM part")
def mp17(s, d):
    body = f"""{_p("p_type", '<w:pStyle w:val="Note"/><w:jc w:val="center"/>')}, {_p("p_name", '<w:pStyle w:val="Part"/>')}, {_p("' '")}, '<w:p>', {DRAWING.format("p_type")}, '</w:p>'"""
    styles = O.part("styles", F.expr(f"concat({STYLES[1]})"))
    made = {"word/document.xml": O.document(F.expr(f"concat('', {body})")), "word/styles.xml": styles, RELS: F.expr(_rels(IMAGE_REL)), "word/media/x.png": F.lit("png")}
    nodes = I.nodes_of(imported_docx(O.zipped(table(s, d, "part"), made, "p_partkey")))
    return nodes.where("type in ('paragraph', 'heading', 'figure')").select("doc_id", "type", "level", "style", "alt")


@query("mp17_docx_paragraph_losses", "SELECT p_partkey AS doc_id, 'docx_paragraph_props' AS feature, 'jc' AS detail FROM part")
def mp17b(s, d):
    docs = _read(s, d, _p("p_type", '<w:jc w:val="center"/>'))
    return I.loss_of(docs).where("loss_class <> 'none'").select("doc_id", "feature", "detail")


INLINE = f"""'<w:p><w:ins w:author="A">', {_r("p_name")}, '</w:ins><w:del w:author="B"><w:r><w:delText>gone</w:delText></w:r></w:del><w:moveFrom w:author="B">', {_r("'away'")}, '</w:moveFrom><w:sdt><w:sdtContent>', {_r("' '")}, {_r("p_type")}, '</w:sdtContent></w:sdt><mc:AlternateContent><mc:Choice>', {_r("'new'")}, '</mc:Choice><mc:Fallback>', {_r("' '")}, {_r("p_size")}, '</mc:Fallback></mc:AlternateContent><w:smartTag>', {_r("' s'")}, '</w:smartTag><w:fldSimple w:instr=" PAGE ">', {_r("' 7'")}, '</w:fldSimple><w:bookmarkStart w:id="1" w:name="m"/><w:bookmarkEnd w:id="1"/></w:p>'"""


@query("mp18_docx_inline", "SELECT p_partkey AS doc_id, p_name || ' ' || p_type || ' ' || p_size || ' s 7' AS text FROM part")
def mp18(s, d):
    return S.plain_spans(I.nodes_of(_read(s, d, INLINE))).select("doc_id", "text")


@query("mp18_docx_inline_losses", "SELECT p_partkey AS doc_id, unnest(['docx_tracked_changes', 'docx_sdt', 'docx_field', 'docx_bookmark']) AS feature, 'partial' AS loss_class FROM part")
def mp18b(s, d):
    return _lost(_read(s, d, INLINE))


@query("mp27_tracked_changes", "SELECT p_partkey AS doc_id, 'A: +1 -0; B: +0 -2' AS detail, 'preserved/docx/part-0000.xml' AS path, true AS kept FROM part")
def mp27(s, d):
    docs = _read(s, d, INLINE)
    event = I.loss_of(docs).where("feature = 'docx_tracked_changes'").select("doc_id", "detail")
    original = I.preserved_of(docs).select("doc_id", "path", F.col("bytes").cast("string").contains("<w:delText>gone</w:delText>").alias("kept"))
    return event.join(original, "doc_id")


@query("ag6_tracked_authors", "SELECT p_partkey AS doc_id, unnest(['A', 'B']) AS author, unnest([1, 0]) AS inserted, unnest([0, 2]) AS deleted FROM part")
def ag6(s, d):
    return O.tracked_counts(O.parts_of(_packages(s, d, INLINE)))


@query("mp19_docx_links", "SELECT p_partkey AS doc_id, unnest(['https://example.com/' || p_partkey, '#top']) AS url FROM part")
def mp19(s, d):
    body = f"""'<w:p><w:hyperlink r:id="rId2">', {_r("p_name")}, '</w:hyperlink><w:hyperlink w:anchor="top">', {_r("p_type")}, '</w:hyperlink><w:hyperlink>', {_r("p_brand")}, '</w:hyperlink></w:p>'"""
    return I.nodes_of(imported_docx(_with(s, d, {RELS: TARGETS}, body))).where("type = 'link'").select("doc_id", "url")


@query("mp20_docx_runs", "SELECT p_partkey AS doc_id, unnest(['content[0].content[0]', 'content[0].content[0].content[0]', 'content[0].content[0].content[0].content[0]', 'content[0].content[1]']) AS path, unnest(['em', 'strong', 'text', 'text']) AS type, unnest([NULL, NULL, p_name, p_type]) AS text FROM part")
def mp20(s, d):
    body = f"""'<w:p>', {_r("p_name", '<w:b/><w:i w:val="true"/><w:u w:val="none"/>')}, {_r("p_type", '<w:b w:val="0"/>')}, '</w:p>'"""
    return I.nodes_of(_read(s, d, body)).where("kind = 'span'").select("doc_id", "path", "type", "text")


@query("mp21_run_children", "SELECT p_partkey AS doc_id, unnest(['paragraph', 'text', 'hard_break', 'text', 'hard_break', 'text', 'page_break']) AS type, unnest([NULL, p_name || ' x', NULL, p_type, NULL, CAST(p_size AS VARCHAR), NULL]) AS text FROM part")
def mp21(s, d):
    body = "'<w:p><w:r><w:t>', p_name, '</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>', p_type, '</w:t><w:cr/><w:t>', p_size, '</w:t><w:br w:type=\"page\"/><w:instrText>PAGE</w:instrText><w:delText>no</w:delText></w:r></w:p>'"
    return I.nodes_of(_read(s, d, body)).select("doc_id", "type", "text")


@query("mp22_formulas", "SELECT p_partkey AS doc_id, unnest(['inline_math', 'math_block']) AS type, unnest([p_name, p_type]) AS latex, unnest([p_name, p_type]) AS kept FROM part")
def mp22(s, d):
    docs = _read(s, d, """'<w:p><w:r><w:t>a</w:t></w:r><m:oMath><m:r><m:t>', p_name, '</m:t></m:r></m:oMath></w:p><m:oMathPara><m:oMath><m:r><m:t>', p_type, '</m:t></m:r></m:oMath></m:oMathPara>'""")
    kept = I.preserved_of(docs).select("doc_id", F.col("path").alias("payload_ref"), F.regexp_extract(F.col("bytes").cast("string"), r">([^<>]+)</[\w]+:t>", 1).alias("kept"))
    return I.nodes_of(docs).where("latex is not null").join(kept, ["doc_id", "payload_ref"]).select("doc_id", "type", "latex", "kept")


@query("mp23_drawings", "SELECT p_partkey AS doc_id, unnest(['inline_image', 'unknown']) AS type, unnest([p_name, NULL]) AS alt, unnest([NULL, 'drawing']) AS summary FROM part")
def mp23(s, d):
    lost = DRAWING.format("p_type").replace("rId1", "rId9")
    nodes = I.nodes_of(imported_docx(_with(s, d, {RELS: _rels(IMAGE_REL), "word/media/x.png": "'png'"}, f"'<w:p>', {_r('p_type')}, {DRAWING.format('p_name')}, {lost}, '</w:p>'")))
    return nodes.where("type in ('inline_image', 'unknown')").select("doc_id", "type", "alt", "summary")


@query("sk18_serialized_xml", "SELECT p_partkey AS doc_id, p_type AS descr FROM part")
def sk18(s, d):
    docs = _read(s, d, f"'<w:p>', {_r('p_name')}, {DRAWING.format('p_type')}, '</w:p>'")
    return I.preserved_of(docs).select("doc_id", F.regexp_extract(F.col("bytes").cast("string"), 'descr="([^"]*)"', 1).alias("descr"))


@query("mp24_note_references", "SELECT p_partkey AS doc_id, 2 AS defined, 2 AS first, 1 AS second FROM part")
def mp24(s, d):
    body = f"""'<w:p>', {_r("p_name")}, '<w:r><w:footnoteReference w:id="2"/><w:endnoteReference w:id="2"/><w:footnoteReference w:id="2"/><w:footnoteReference w:id="77"/></w:r></w:p>'"""
    from parchment.operators.references import footnote_numbers

    nodes = I.nodes_of(_read(s, d, body, footnotes=NOTES, endnotes=ENDNOTES))
    n = lambda k: F.max(F.when(F.col("number") == k, F.col("n_refs")))
    return footnote_numbers(nodes).groupBy("doc_id").agg(F.count_if("defined").alias("defined"), n(1).alias("first"), n(2).alias("second"))


DOCX_TABLE = f"""'<w:tbl><w:tblGrid><w:gridCol w:w="1000"/><w:gridCol w:w="3000"/></w:tblGrid><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>', {_p("p_name")}, '</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>', {_p("p_brand")}, '</w:tc><w:tc>', {_p("p_type")}, '</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>', {_p("''")}, '</w:tc><w:tc>', {_p("p_size")}, '</w:tc></w:tr></w:tbl>'"""


@query(
    "mp25_docx_tables",
    """SELECT p_partkey AS doc_id, unnest([0, 1, 1, 2]) AS row, unnest([0, 0, 1, 1]) AS col, unnest([1, 2, 1, 1]) AS row_span, unnest([2, 1, 1, 1]) AS col_span, unnest(['header', 'data', 'data', 'data']) AS role,
       unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS text FROM part""",
)
def mp25(s, d):
    return T.cells(materialise(I.nodes_of(_read(s, d, DOCX_TABLE)))).drop("table")


@query("mp25_column_widths", "SELECT p_partkey AS doc_id, unnest([0, 1]) AS ord, unnest([p_name, NULL]) AS title, unnest([0.25, 0.75]) AS width FROM part")
def mp25b(s, d):
    return I.nodes_of(_read(s, d, DOCX_TABLE)).where("type = 'column'").select("doc_id", "ord", "title", F.get_json_object("extra", "$.width").cast("double").alias("width"))


@query(
    "mp26_side_parts",
    """SELECT p_partkey AS doc_id, unnest(['docx_headers', 'docx_ole_object', 'docx_macro', 'docx_custom_xml', 'docx_unknown_part']) AS feature,
       unnest(['preserved', 'preserved_quarantined', 'preserved_quarantined', 'preserved', 'preserved']) AS action, unnest([p_name, p_type, p_brand, 'c', 'u']) AS payload FROM part""",
)
def mp26(s, d):
    docs = imported_docx(_with(s, d, {"word/header1.xml": "p_name", "word/embeddings/o.bin": "p_type", "word/vbaProject.bin": "p_brand", "customXml/item1.xml": "'c'", "word/strange.xml": "'u'", "word/theme/theme1.xml": "'t'"}))
    kept = I.preserved_of(docs).select("doc_id", F.col("path").alias("detail"), F.col("bytes").cast("string").alias("payload"))
    return I.loss_of(docs).where("loss_class = 'preserved_raw'").join(kept, ["doc_id", "detail"]).select("doc_id", "feature", "action", "payload")


@query("w11_preserved_numbers", "SELECT p_partkey AS doc_id, unnest(['a', 'b']) AS payload, unnest([0, 1]) AS n FROM part")
def w11(s, d):
    docs = imported_docx(_with(s, d, {"word/header1.xml": "'a'", "word/header2.xml": "'b'"}))
    return O.reserved_numbers(I.preserved_of(docs)).select("doc_id", F.col("bytes").cast("string").alias("payload"), "n")
