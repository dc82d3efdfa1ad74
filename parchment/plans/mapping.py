"""Mapping rows of the readers and renderers: documents written from the part table, read by the library, held against the columns.

Each source text is an expression over a part's columns, so what a reader must make of it is known from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators import references as R
from parchment.operators import structure as S
from parchment.operators import tables as T
from parchment.plans.catalog import query, table
from parchment.sources import importers as I


def _read(s, d, fmt: str, source: str) -> DataFrame:
    """A document for each part, its text given as a SQL expression."""
    return I.imported(table(s, d, "part").select("p_partkey", F.expr(source).alias("src")), fmt, "p_partkey", "src")


def _cases(n: int, *texts: str) -> str:
    """The i-th of n texts for parts whose key leaves i."""
    assert len(texts) == n
    return f"CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


def _roots(nodes: DataFrame) -> DataFrame:
    detail = F.coalesce("language", "variant", "latex", "style", "summary", F.col("level").cast("string"))
    return nodes.where("parent_seq is null").select("doc_id", "type", detail.alias("detail"))


def _lost(docs: DataFrame) -> DataFrame:
    return I.loss_of(docs).where("loss_class <> 'none'").select("doc_id", "feature", "loss_class")


def _spans(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'span' and type <> 'text' and depth = 1").select("doc_id", "type", F.coalesce("text", "url", "latex", "summary").alias("detail"), "title")


# Markdown

MD_BLOCKS = _cases(
    10, "p_name", r"concat('## ', p_name)", r"concat('> ', p_name)", r"concat('- ', p_name)", r"concat('```sql x\n', p_name, '\n```')", "'***'", "concat('<div>', p_name, '</div>')",
    r"concat('| a | b |\n| - | - |\n| ', p_name, ' | ', p_size, ' |')", r"concat('> [!CAUTION]\n> ', p_name)", "concat('$$', p_name, '$$')",
)


@query("mp1_markdown_blocks", f"SELECT p_partkey AS doc_id, ['paragraph', 'section', 'quote', 'list', 'code_block', 'horizontal_rule', 'unknown', 'table', 'callout', 'math_block'][p_partkey % 10 + 1] AS type, {_cases(10, 'NULL', 'NULL', 'NULL', repr('bullet'), repr('sql'), 'NULL', repr('HTML block'), 'NULL', repr('warning'), 'p_name')} AS detail FROM part")
def mp1(s, d):
    return _roots(I.nodes_of(_read(s, d, "markdown", MD_BLOCKS)))


@query("mp1_markdown_losses", "SELECT p_partkey AS doc_id, CASE p_partkey % 10 WHEN 6 THEN 'html_block' ELSE 'alert_caution' END AS feature, CASE p_partkey % 10 WHEN 6 THEN 'preserved_raw' ELSE 'partial' END AS loss_class FROM part WHERE p_partkey % 10 IN (6, 8)")
def mp1b(s, d):
    return _lost(_read(s, d, "markdown", MD_BLOCKS))


@query(
    "mp2_markdown_lists",
    """SELECT p_partkey AS doc_id, unnest([0, 1]) AS ord, CAST(NULL AS BOOLEAN) AS checked, 'ordered' AS style, p_size + 1 AS start, unnest([(p_size + 1) || '. ', (p_size + 2) || '. ']) AS marker
       FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT p_partkey, unnest([0, 1, 2]), unnest([true, false, NULL]), 'bullet', NULL, '- ' FROM part WHERE p_partkey % 2 = 1""",
)
def mp2(s, d):
    src = r"CASE WHEN p_partkey % 2 = 0 THEN concat(p_size + 1, '. ', p_name, '\n', p_size + 2, '. ', p_type) ELSE concat('- [x] ', p_name, '\n- [ ] ', p_type, '\n- ', p_brand) END"
    return S.list_items(I.nodes_of(_read(s, d, "markdown", src))).select("doc_id", "ord", "checked", "style", "start", "marker")


MD_TABLE = r"concat('| a | *', p_type, '* |\n| - | - |\n| **', p_name, '** | ', p_size, ' |\n| ', p_type, ' | |')"


@query(
    "mp3_markdown_tables",
    """SELECT p_partkey AS doc_id, unnest([0, 0, 1, 1, 2, 2]) AS row, unnest([0, 1, 0, 1, 0, 1]) AS col, unnest(['header', 'header', 'data', 'data', 'data', 'data']) AS role,
       unnest(['a', p_type, p_name, CAST(p_size AS VARCHAR), p_type, '']) AS text FROM part""",
)
def mp3(s, d):
    return T.cells(I.nodes_of(_read(s, d, "markdown", MD_TABLE))).select("doc_id", "row", "col", "role", "text")


MD_FIGURE = _cases(3, "concat('![', p_name, '](https://example.com/', p_partkey, '.png)')", "concat('![', p_name, '](data:image/png;base64,QUJD)')", "concat('![', p_name, '](gone.png)')")


@query("mp4_markdown_figures", f"SELECT p_partkey AS doc_id, p_name AS alt, {_cases(3, chr(39) + 'https://example.com/' + chr(39) + ' || p_partkey || ' + repr('.png'), repr('data:image/png;base64,QUJD'), repr('gone.png'))} AS url, 'image/png' AS mime FROM part")
def mp4(s, d):
    docs = _read(s, d, "markdown", MD_FIGURE)
    return R.asset_urls(I.nodes_of(docs).where("type = 'figure'"), I.assets_of(docs)).select("doc_id", "alt", F.col("asset_url").alias("url"), F.col("asset_mime").alias("mime"))


@query("mp4_missing_files", "SELECT p_partkey AS doc_id, 'image_missing' AS feature, 'partial' AS loss_class FROM part WHERE p_partkey % 3 = 2")
def mp4b(s, d):
    return _lost(_read(s, d, "markdown", MD_FIGURE))


MD_SPANS = r"""concat('*', p_name, '* **', p_type, '** ~~', p_name, '~~ `', p_brand, '` [', p_type, '](https://example.com/', p_partkey, ' "', p_name, '") $x_', p_size, '$ <b>')"""


@query(
    "mp5_markdown_spans",
    """SELECT p_partkey AS doc_id, unnest(['em', 'strong', 'strike', 'code', 'link', 'inline_math', 'unknown']) AS type,
       unnest([NULL, NULL, NULL, p_brand, 'https://example.com/' || p_partkey, 'x_' || p_size, 'inline HTML']) AS detail, unnest([NULL, NULL, NULL, NULL, p_name, NULL, NULL]) AS title FROM part""",
)
def mp5(s, d):
    return _spans(I.nodes_of(_read(s, d, "markdown", MD_SPANS)))


@query("mp6_inline_text", "SELECT p_partkey AS doc_id, unnest(['figure', 'column', 'column']) AS type, unnest(['a ' || p_name || ' b', p_name, p_type]) AS text FROM part")
def mp6(s, d):
    src = r"concat('![a *', p_name, '* b](https://example.com/i.png)\n\n| *', p_name, '* | `', p_type, '` |\n| - | - |\n| 1 | 2 |')"
    return I.nodes_of(_read(s, d, "markdown", src)).where("type in ('figure', 'column')").select("doc_id", "type", F.coalesce("alt", "title").alias("text"))


# HTML

HTML_BLOCKS = _cases(
    14, "concat('<p>', p_name, '</p>')", "concat('<h3>', p_name, '</h3>')", "concat('<blockquote><p>', p_name, '</blockquote>')", "concat('<ul><li>', p_name, '</ul>')",
    "concat('<pre><code class=\"language-sql\">', p_name, '</code></pre>')", "concat('<table><tr><td>', p_name, '</table>')", "'<hr>'", "'<div class=\"x page-break\"></div>'",
    "concat('<section><p>', p_name, '</section>')", "'<iframe src=\"https://example.com/v\"></iframe>'", "concat('<nav>', p_name, '</nav>')", "concat('<x-card>', p_name, '</x-card>')", "p_name",
    "concat('<center><p>', p_name, '</center>')",
)


@query(
    "mp7_html_blocks",
    f"""SELECT p_partkey AS doc_id, ['paragraph', 'heading', 'quote', 'list', 'code_block', 'table', 'horizontal_rule', 'page_break', 'section', 'embed', 'unknown', 'unknown', 'paragraph', 'paragraph'][p_partkey % 14 + 1] AS type,
        {_cases(14, 'NULL', repr('3'), 'NULL', repr('bullet'), repr('sql'), *['NULL'] * 5, repr('<nav>'), repr('<x-card>'), 'NULL', 'NULL')} AS detail FROM part""",
)
def mp7(s, d):
    return _roots(I.nodes_of(_read(s, d, "html", HTML_BLOCKS)))


@query("mp7_html_losses", "SELECT p_partkey AS doc_id, CASE p_partkey % 14 WHEN 9 THEN 'embed' WHEN 10 THEN 'unknown_element' ELSE 'custom_element' END AS feature, CASE p_partkey % 14 WHEN 9 THEN 'partial' ELSE 'preserved_raw' END AS loss_class FROM part WHERE p_partkey % 14 IN (9, 10, 11)")
def mp7b(s, d):
    return _lost(_read(s, d, "html", HTML_BLOCKS))


@query("mp8_inline_runs", "SELECT p_partkey AS doc_id, unnest(['content[0]', 'content[1]', 'content[2]']) AS path, unnest([p_name || ' ' || p_type, p_brand, 'tail ' || p_size]) AS text FROM part")
def mp8(s, d):
    src = "concat('<div> ', p_name, ' <b>', p_type, '</b> <p>', p_brand, '</p> tail  ', p_size, '<hr></div>')"
    return S.plain_spans(I.nodes_of(_read(s, d, "html", src)))


@query(
    "mp9_html_lists",
    """SELECT p_partkey AS doc_id, unnest(['content[0]', 'content[0]', 'content[0].items[0].children[1]']) AS list, unnest([0, 1, 0]) AS ord, unnest([NULL, true, NULL]) AS checked,
       unnest(['ordered', 'ordered', 'bullet']) AS style, unnest([p_size + 1, p_size + 1, NULL]) AS start FROM part""",
)
def mp9(s, d):
    src = "concat('<ol start=\"', p_size + 1, '\"><li>', p_name, '</li><ul><li>', p_type, '</ul><li data-checked=\"true\">', p_brand, '</ol>')"
    return S.list_items(I.nodes_of(_read(s, d, "html", src))).select("doc_id", "list", "ord", "checked", "style", "start")


@query("mp10_html_code", "SELECT p_partkey AS doc_id, p_name || ' < ' || p_size || chr(10) || p_type AS text, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS language FROM part")
def mp10(s, d):
    src = r"concat('<pre>', CASE WHEN p_partkey % 2 = 0 THEN concat('<code class=\"a language-', lower(p_type), '\">') ELSE '<code>' END, '\n', p_name, ' &lt; ', p_size, '\n', p_type, '\n</code></pre>')"
    return I.nodes_of(_read(s, d, "html", src)).where("type = 'code_block'").select("doc_id", "text", "language")


HTML_TABLE = """concat('<table><thead><tr><th colspan="2">', p_name, '<tbody><tr><td rowspan="2">', p_brand, '<td>', p_type, '<tr><td><b>', p_size, '</b></table>')"""


@query(
    "mp11_html_tables",
    """SELECT p_partkey AS doc_id, unnest([0, 1, 1, 2]) AS row, unnest([0, 0, 1, 0]) AS col, unnest([1, 2, 1, 1]) AS row_span, unnest([2, 1, 1, 1]) AS col_span, unnest(['header', 'data', 'data', 'data']) AS role,
       unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS text FROM part""",
)
def mp11(s, d):
    return T.cells(I.nodes_of(_read(s, d, "html", HTML_TABLE))).drop("table")


HTML_SPANNING = """concat('<table><tr>', repeat('<td>x', p_size % 4 + 1), '<tr><td', CASE WHEN p_partkey % 3 = 0 THEN ' colspan="3"' ELSE '' END, '>', p_name, '</table>')"""


@query("fl24_table_has_spans", "SELECT p_partkey AS doc_id, p_partkey % 3 = 0 AS has_spans FROM part")
def fl24(s, d):
    return T.metadata(T.cells(I.nodes_of(_read(s, d, "html", HTML_SPANNING)))).select("doc_id", "has_spans")


@query("ag17_table_width", "SELECT p_partkey AS doc_id, greatest(p_size % 4 + 1, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END) AS width FROM part")
def ag17(s, d):
    return T.widths(T.cells(I.nodes_of(_read(s, d, "html", HTML_SPANNING)))).select("doc_id", "width")


@query("mp12_html_figures", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 1 THEN 'paragraph' ELSE 'figure' END AS type, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE p_name END AS alt, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name END AS text FROM part")
def mp12(s, d):
    src = _cases(
        3, "concat('<figure><div><img src=\"https://example.com/i.png\" alt=\"', p_name, '\"></div><figcaption><em>', p_type, '</em></figcaption></figure>')",
        "concat('<figure><p>', p_name, '</figure>')", "concat('<figure><img src=\"https://example.com/i.png\" alt=\"', p_name, '\"></figure>')",
    )
    nodes = I.nodes_of(_read(s, d, "html", src))
    return nodes.where("parent_seq is null").select("doc_id", "path", "type", "alt").join(S.plain_spans(nodes), ["doc_id", "path"], "left").select("doc_id", "type", "alt", "text")


@query("mp13_html_media", "SELECT p_partkey AS doc_id, ['https://example.com/' || p_partkey || '.mp4', 'data:text/plain;base64,QUJD', 'clip.bin'][p_partkey % 3 + 1] AS url, ['external', 'embedded', 'external'][p_partkey % 3 + 1] AS storage, p_partkey % 3 = 2 AS missing FROM part")
def mp13(s, d):
    src = _cases(3, "concat('<video><source src=\"https://example.com/', p_partkey, '.mp4\"></video>')", "'<iframe src=\"data:text/plain,ABC\"></iframe>'", "'<object data=\"clip.bin\"></object>'")
    docs = _read(s, d, "html", src)
    shown = R.asset_urls(I.nodes_of(docs).where("type = 'embed'"), I.assets_of(docs)).select("doc_id", F.col("asset_url").alias("url"))
    lost = I.loss_of(docs).groupBy("doc_id").agg(F.bool_or(F.col("feature").endswith("_missing")).alias("missing"))
    return shown.join(I.assets_of(docs).select("doc_id", "storage"), "doc_id").join(lost, "doc_id")


HTML_SPANS = """concat('<p><i>', p_name, '</i> <u>', p_type, '</u> <del>x</del> <kbd>', p_brand, '</kbd> <a href="/', p_partkey, '" title="', p_name, '">y</a> <mark>', p_type, '</mark> <sub>', p_size, '</sub> <span class="c">z</span> <blink>q</blink>')"""


@query(
    "mp14_html_spans",
    """SELECT p_partkey AS doc_id, unnest(['em', 'underline', 'strike', 'code', 'link', 'strong', 'unknown']) AS type, unnest([NULL, NULL, NULL, p_brand, '/' || p_partkey, NULL, '<blink>']) AS detail,
       unnest([NULL, NULL, NULL, NULL, p_name, NULL, NULL]) AS title FROM part""",
)
def mp14(s, d):
    return _spans(I.nodes_of(_read(s, d, "html", "concat('', " + HTML_SPANS + ")")))


@query("mp14_html_span_losses", "SELECT p_partkey AS doc_id, unnest(['mark', 'sub_element', 'span_style', 'unknown_inline']) AS feature, unnest(['partial', 'partial', 'partial', 'preserved_raw']) AS loss_class FROM part")
def mp14b(s, d):
    return _lost(_read(s, d, "html", HTML_SPANS))


@query("sk19_serialized_elements", "SELECT p_partkey AS doc_id, '<x-card data-n=\"' || p_size || '\">' || p_name || ' &amp; <b>' || p_type || '</b><br></x-card>' AS payload FROM part")
def sk19(s, d):
    docs = _read(s, d, "html", "concat('<X-Card data-n=', p_size, '>', p_name, ' &amp; <b>', p_type, '</b><br/></X-Card>')")
    return I.preserved_of(docs).select("doc_id", F.col("bytes").cast("string").alias("payload"))


@query("fl19_only_image", "SELECT p_partkey AS doc_id, p_partkey % 3 = 0 AS lone FROM part")
def fl19(s, d):
    src = _cases(3, "'<p> <img src=\"https://example.com/i.png\"> </p>'", "concat('<p>', p_name, '<img src=\"https://example.com/i.png\">')", "'<p><img src=\"https://example.com/i.png\"><img src=\"https://example.com/j.png\">'")
    return S.lone(I.nodes_of(_read(s, d, "html", src)), "inline_image").select("doc_id", "lone")


@query("w10_style_slugs", "WITH RECURSIVE n AS (SELECT p_type, p_partkey, trim(regexp_replace(lower(CASE WHEN p_size % 3 = 0 THEN '##' ELSE split_part(p_name, ' ', 1) END), '[^a-z0-9]+', '-', 'g'), '-') AS base, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part), b AS (SELECT p_type, p_partkey, i, CASE WHEN base = '' THEN 'style-' || i ELSE base END AS base FROM n), c AS (SELECT *, row_number() OVER (PARTITION BY p_type, base ORDER BY i) AS k FROM b) SELECT p_type, p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM c")
def w10(s, d):
    styles = table(s, d, "part").select("p_type", "p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN '##' ELSE split_part(p_name, ' ', 1) END").alias("name"))
    return S.style_slugs(styles, "p_type", "p_partkey", "name")


# pandoc's JSON trees

STR = "'{{\"t\":\"Str\",\"c\":\"', {0}, '\"}}'"


def _str(x: str) -> str:
    """A Str of a column, for use inside concat()."""
    return STR.format(x)


def _pandoc(blocks: str, meta: str = "'{}'") -> str:
    return f"""concat('{{"pandoc-api-version":[1,23,1],"meta":', {meta}, ',"blocks":[', {blocks}, ']}}')"""


PARA = f"concat('{{\"t\":\"Para\",\"c\":[', {_str('p_name')}, ']}}')"
PANDOC_BLOCKS = _cases(
    10, f"concat('{{\"t\":\"Header\",\"c\":[', p_size % 6 + 1, ',[\"\",[],[]],[', {_str('p_name')}, ']]}}')", PARA, f"concat('{{\"t\":\"BlockQuote\",\"c\":[', {PARA}, ']}}')",
    f"concat('{{\"t\":\"BulletList\",\"c\":[[', {PARA}, ']]}}')", f"concat('{{\"t\":\"OrderedList\",\"c\":[[', p_size, ',{{\"t\":\"Decimal\"}},{{\"t\":\"Period\"}}],[[', {PARA}, ']]]}}')",
    "concat('{\"t\":\"CodeBlock\",\"c\":[[\"\",[\"sql\"],[]],\"', p_name, '\"]}')", "'{\"t\":\"HorizontalRule\"}'", "'{\"t\":\"RawBlock\",\"c\":[\"openxml\",\"<w:br w:type=\\\\\"page\\\\\"/>\"]}'",
    "concat('{\"t\":\"RawBlock\",\"c\":[\"html\",\"', p_name, '\"]}')", f"concat('{{\"t\":\"Div\",\"c\":[[\"\",[],[]],[', {PARA}, ']]}}')",
)


@query(
    "mp28_pandoc_blocks",
    f"""SELECT p_partkey AS doc_id, ['section', 'paragraph', 'quote', 'list', 'list', 'code_block', 'horizontal_rule', 'page_break', 'unknown', 'paragraph'][p_partkey % 10 + 1] AS type,
        {_cases(10, 'NULL', 'NULL', 'NULL', repr('bullet'), repr('ordered'), repr('sql'), 'NULL', 'NULL', repr('html block'), 'NULL')} AS detail FROM part""",
)
def mp28(s, d):
    return _roots(I.nodes_of(_read(s, d, "pandoc", _pandoc(PANDOC_BLOCKS))))


@query("sc14_pandoc_sections", "SELECT p_partkey AS doc_id, 'content[0].children[0]' AS path, p_size % 6 + 1 AS level, p_name AS text FROM part WHERE p_partkey % 10 = 0")
def sc14(s, d):
    nodes = I.nodes_of(_read(s, d, "pandoc", _pandoc(PANDOC_BLOCKS)))
    return nodes.where("type = 'heading'").select("doc_id", "path", "level").join(S.plain_spans(nodes), ["doc_id", "path"])


def _cell(content: str, down: int = 1, across: int = 1) -> str:
    return f"""'[["",[],[]],{{"t":"AlignDefault"}},{down},{across},[{{"t":"Plain","c":[', {content}, ']}}]]'"""


PANDOC_TABLE = f"""concat('{{"t":"Table","c":[["",[],[]],[null,[{{"t":"Plain","c":[]}}]],[[{{"t":"AlignDefault"}},{{"t":"ColWidth","c":0.25}}],[{{"t":"AlignDefault"}},{{"t":"ColWidthDefault"}}]],[["",[],[]],[[["",[],[]],[', {_cell(_str('p_name'), 1, 2)}, ']]]],[[["",[],[]],0,[],[[["",[],[]],[', {_cell(_str('p_brand'), 2, 1)}, ',', {_cell(_str('p_type'))}, ']],[["",[],[]],[', {_cell(_str('p_size'))}, ']]]]],[["",[],[]],[]]]}}')"""


@query(
    "mp29_pandoc_tables",
    """SELECT p_partkey AS doc_id, unnest([0, 1, 1, 2]) AS row, unnest([0, 0, 1, 1]) AS col, unnest([1, 2, 1, 1]) AS row_span, unnest([2, 1, 1, 1]) AS col_span,
       unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS text FROM part""",
)
def mp29(s, d):
    return T.cells(I.nodes_of(_read(s, d, "pandoc", _pandoc(PANDOC_TABLE)))).drop("table", "role")


@query("mp29_table_captions", "SELECT p_partkey AS doc_id, 'table_caption' AS feature, 'partial' AS loss_class FROM part")
def mp29b(s, d):
    return _lost(_read(s, d, "pandoc", _pandoc(PANDOC_TABLE)))


IMAGE = f"'{{\"t\":\"Image\",\"c\":[[\"\",[],[]],[', {_str('p_name')}, '],[\"https://example.com/', p_partkey, '.png\",\"\"]]}}'"
PANDOC_FIGURE = _cases(
    2, f"concat('{{\"t\":\"Figure\",\"c\":[[\"\",[],[]],[null,[{{\"t\":\"Plain\",\"c\":[', {_str('p_type')}, ']}}]],[{{\"t\":\"Div\",\"c\":[[\"\",[],[]],[{{\"t\":\"Plain\",\"c\":[', {IMAGE}, ']}}]]}}]]}}')",
    f"concat('{{\"t\":\"Figure\",\"c\":[[\"\",[],[]],[null,[]],[', {PARA}, ']]}}')",
)


@query("mp30_pandoc_figures", "SELECT p_partkey AS doc_id, CASE p_partkey % 2 WHEN 0 THEN 'figure' ELSE 'paragraph' END AS type, CASE p_partkey % 2 WHEN 0 THEN p_name END AS alt, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE p_name END AS text FROM part")
def mp30(s, d):
    nodes = I.nodes_of(_read(s, d, "pandoc", _pandoc(PANDOC_FIGURE)))
    return nodes.where("parent_seq is null").select("doc_id", "path", "type", "alt").join(S.plain_spans(nodes), ["doc_id", "path"]).drop("path")


PANDOC_SPANS = f"""concat('{{"t":"Para","c":[{{"t":"Emph","c":[', {_str('p_name')}, ']}},{{"t":"Space"}},{{"t":"Strong","c":[', {_str('p_type')}, ']}},{{"t":"SoftBreak"}},{{"t":"Code","c":[["",[],[]],"', p_brand, '"]}},{{"t":"Link","c":[["",[],[]],[', {_str('p_type')}, '],["https://example.com/', p_partkey, '","', p_name, '"]]}},{{"t":"Math","c":[{{"t":"InlineMath"}},"x_', p_size, '"]}},{{"t":"LineBreak"}},{{"t":"Strikeout","c":[', {_str('p_name')}, ']}},{{"t":"SmallCaps","c":[', {_str('p_name')}, ']}},{{"t":"Note","c":[', {PARA}, ']}}]}}')"""


@query(
    "mp31_pandoc_spans",
    """SELECT p_partkey AS doc_id, unnest(['em', 'strong', 'code', 'link', 'inline_math', 'hard_break', 'strike', 'footnote_ref']) AS type,
       unnest([NULL, NULL, p_brand, 'https://example.com/' || p_partkey, 'x_' || p_size, NULL, NULL, NULL]) AS detail, unnest([NULL, NULL, NULL, p_name, NULL, NULL, NULL, NULL]) AS title FROM part""",
)
def mp31(s, d):
    return _spans(I.nodes_of(_read(s, d, "pandoc", _pandoc(PANDOC_SPANS))))


@query("sc13_pandoc_import", "SELECT p_partkey AS doc_id, p_name AS text, 'inline_SmallCaps' AS lost FROM part")
def sc13(s, d):
    docs = _read(s, d, "pandoc", _pandoc(PANDOC_SPANS))
    notes = S.plain_spans(I.nodes_of(docs)).where("path = 'content[1].children[0]'").select("doc_id", "text")
    return notes.join(_lost(docs).select("doc_id", F.col("feature").alias("lost")), "doc_id")


@query("pj13_meta_title", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type END AS title FROM part")
def pj13(s, d):
    meta = _cases(3, """concat('{"title":{"t":"MetaString","c":"', p_name, '"}}')""", f"""concat('{{"title":{{"t":"MetaInlines","c":[', {_str('p_name')}, ',{{"t":"Space"}},{{"t":"Emph","c":[', {_str('p_type')}, ']}}]}}}}')""", "'{}'")
    return _read(s, d, "pandoc", _pandoc(PARA, meta)).select("doc_id", "title")


def _at(path: str):
    return F.get_json_object("output", path)


@query("mp42_pandoc_tree", "SELECT p_partkey AS doc_id, 'Header' AS first, 2 AS level, p_name AS word, 'CodeBlock' AS second, p_brand AS code, 'Table' AS third, p_type AS cell FROM part")
def mp42(s, d):
    src = r"concat('## ', split_part(p_name, ' ', 1), '\n\n```\n', p_brand, '\n```\n\n| a |\n| - |\n| ', p_type, ' |')"
    out = I.written(_read(s, d, "markdown", src), "pandoc").join(table(s, d, "part", F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id")
    return out.select(
        "doc_id", _at("$.blocks[0].t").alias("first"), _at("$.blocks[0].c[0]").cast("int").alias("level"),
        F.when(_at("$.blocks[0].c[2][0].c") == F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_name")).alias("word"), _at("$.blocks[1].t").alias("second"),
        _at("$.blocks[1].c[1]").alias("code"), _at("$.blocks[2].t").alias("third"), _at("$.blocks[2].c[4][0][3][0][1][0][4][0].c[0].c").alias("cell"),
    )


@query("sk10_export_docx_tree", "SELECT p_partkey AS doc_id, p_type AS title, p_name AS note FROM part")
def sk10(s, d):
    src = r"concat('---\ntitle: ', p_type, '\n---\n\nsee[^a]\n\n[^a]: ', replace(p_name, ' ', '-'))"
    out = I.written(_read(s, d, "markdown", src), "pandoc")
    return out.select("doc_id", _at("$.meta.title.c").alias("title"), F.replace(_at("$.blocks[0].c[1].c[0].c[0].c"), F.lit("-"), F.lit(" ")).alias("note"))


# editor documents

ITEM = '{"type":"list_item","attrs":{"id":"li_0000000000000000000000000A"},"content":[{"type":"paragraph","content":[{"type":"text","text":"'


@query("mp32_tree_to_editor", "SELECT p_partkey AS doc_id, 'list' AS block, 'ordered' AS style, p_size + 1 AS start, 'list_item' AS item, 'table_cell' AS cell, p_type AS text FROM part")
def mp32(s, d):
    src = r"concat(p_size + 1, '. ', p_name, '\n\n| a |\n| - |\n| ', p_type, ' |')"
    out = I.written(_read(s, d, "markdown", src), "editor")
    return out.select(
        "doc_id", _at("$.content[0].type").alias("block"), _at("$.content[0].attrs.style").alias("style"), _at("$.content[0].attrs.start").cast("int").alias("start"),
        _at("$.content[0].content[0].type").alias("item"), _at("$.content[1].content[1].content[0].type").alias("cell"), _at("$.content[1].content[1].content[0].content[0].content[0].text").alias("text"),
    )


RUNS = "array<struct<text:string,marks:array<struct<type:string>>>>"


@query(
    "mp33_editor_runs",
    "SELECT p_partkey AS doc_id, unnest([p_name || ' ', p_type, ' ' || p_size || ' ', p_brand]) AS text, unnest(['strong', 'strong,em', 'strong', 'link,strong,code']) AS marks FROM part",
)
def mp33(s, d):
    src = "concat('**', p_name, ' *', p_type, '* ', p_size, ' [`', p_brand, '`](https://example.com/x)**')"
    out = I.written(_read(s, d, "markdown", src), "editor")
    runs = out.select("doc_id", F.explode(F.from_json(_at("$.content[0].content"), RUNS)).alias("r"))
    return runs.select("doc_id", "r.text", F.array_join(F.transform("r.marks", lambda m: m["type"]), ",").alias("marks"))


def _editor(blocks: str) -> str:
    return f"""concat('{{"type":"doc","content":[', {blocks}, ']}}')"""


@query("mp34_editor_to_tree", "SELECT p_partkey AS doc_id, unnest(['list', 'item', 'paragraph', 'code_block', 'callout']) AS type, unnest(['ordered', NULL, NULL, NULL, 'tip']) AS detail, unnest([p_size + 1, NULL, NULL, NULL, NULL]) AS start, unnest([NULL, NULL, NULL, p_brand, NULL]) AS text FROM part")
def mp34(s, d):
    src = _editor(f"""concat('{{"type":"list","attrs":{{"id":"blk_A","style":"ordered","start":', p_size + 1, '}},"content":[{ITEM}', p_name, '"}}]}}]}}]}},{{"type":"code_block","attrs":{{"id":"blk_B"}},"content":[{{"type":"text","text":"', p_brand, '"}}]}},{{"type":"callout","attrs":{{"id":"blk_C","variant":"tip"}}}}')""")
    nodes = I.nodes_of(_read(s, d, "editor", src)).where("kind <> 'span'")
    return nodes.select("doc_id", "type", F.coalesce("style", "variant").alias("detail"), "start", "text")


def _editor_cell(n: int, widths: str, across: int = 1) -> str:
    return f'{{"type":"table_cell","attrs":{{"id":"cel_{n}","col":{n},"col_span":{across},"colwidth":{widths}}}}}'


@query("mp35_editor_columns", "SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS ord, unnest([p_size, 20, NULL]) AS width FROM part")
def mp35(s, d):
    rows = '{"type":"table_row","attrs":{"id":"row_1"},"content":[' + _editor_cell(0, "[null,20]", 2) + "," + _editor_cell(2, "null") + ']},{"type":"table_row","attrs":{"id":"row_2"},"content":[' + _editor_cell(0, "[', p_size, ']") + "," + _editor_cell(1, "[99]") + "]}"
    src = _editor(f"""concat('{{"type":"table","attrs":{{"id":"blk_T","columns":[{{"title":"a"}},{{"title":"b"}},{{"title":"c"}}]}},"content":[{rows}]}}')""")
    nodes = I.nodes_of(_read(s, d, "editor", src)).where("type = 'column'")
    return nodes.select("doc_id", "ord", F.get_json_object("extra", "$.width").cast("int").alias("width"))


@query(
    "mp36_marks_to_spans",
    "SELECT p_partkey AS doc_id, unnest(['content[0].content[0]', 'content[0].content[0].content[0]', 'content[0].content[0].content[0].content[0]', 'content[0].content[0].content[0].content[1]', 'content[0].content[0].content[0].content[1].content[0]']) AS path, unnest(['link', 'strong', 'text', 'em', 'text']) AS type, unnest(['/' || p_partkey, NULL, p_name, NULL, p_type]) AS detail FROM part",
)
def mp36(s, d):
    link = """{"type":"link","attrs":{"url":"/', p_partkey, '"}}"""
    src = _editor(f"""concat('{{"type":"paragraph","attrs":{{"id":"blk_A"}},"content":[{{"type":"text","text":"', p_name, '","marks":[{{"type":"strong"}},{link}]}},{{"type":"text","text":"', p_type, '","marks":[{{"type":"em"}},{link},{{"type":"strong"}}]}}]}}')""")
    return I.nodes_of(_read(s, d, "editor", src)).where("kind = 'span'").select("doc_id", "path", "type", F.coalesce("url", "text").alias("detail"))


@query("sk14_editor_ids", "SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS ord, unnest([true, p_partkey % 2 = 0, false]) AS kept FROM part")
def sk14(s, d):
    # the second paragraph has an id of its own or the first one's again, the third has none
    block = lambda i: f'{{"type":"paragraph","attrs":{{{i}}}}}'
    src = _editor(f"""concat('{block('"id":"blk_0000000000000000000000000X"')},', CASE WHEN p_partkey % 2 = 0 THEN '{block('"id":"blk_0000000000000000000000000Y"')}' ELSE '{block('"id":"blk_0000000000000000000000000X"')}' END, ',{block('')}')""")
    nodes = I.nodes_of(_read(s, d, "editor", src))
    given = F.array(F.lit("blk_0000000000000000000000000X"), F.lit("blk_0000000000000000000000000Y"))
    first = F.min("seq").over(_window("doc_id", "node_id"))
    return nodes.withColumn("_first", first).select("doc_id", "ord", (F.array_contains(given, F.col("node_id")) & (F.col("_first") == F.col("seq"))).alias("kept"))


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


# renderers

MD_SOURCE = "concat('<h2>', p_name, '</h2><p>', p_type, '</p><ol start=\"', p_size + 1, '\"><li>', p_name, '</ol><pre><code>a ``` b</code></pre><blockquote><p>', p_type, '</blockquote><table><tr><th>', p_name, '<tr><td>x|y</table><hr>')"


@query("mp37_blocks_to_markdown", r"SELECT p_partkey AS doc_id, '## ' || p_name || E'\n\n' || p_type || E'\n\n' || (p_size + 1) || '. ' || p_name || E'\n\n````\na ``` b\n````\n\n> ' || p_type || E'\n\n| ' || p_name || E' |\n| --- |\n| x\\|y |\n\n---\n\n' AS output FROM part")
def mp37(s, d):
    return _converted(s, d, "html", "markdown", MD_SOURCE)


def _converted(s, d, source: str, target: str, text: str) -> DataFrame:
    return I.convert(table(s, d, "part").select("p_partkey", F.expr(text).alias("src")), source, target, "p_partkey", "src").select("doc_id", "output")


@query("mp38_spans_to_markdown", r"SELECT p_partkey AS doc_id, '*' || p_name || '* **' || p_type || '** ~~' || p_name || '~~ `' || p_brand || '` [' || p_type || '](https://example.com/' || p_partkey || E' \"' || p_name || E'\") 1 \\* 2 \\_x\\_ u\n\n' AS output FROM part")
def mp38(s, d):
    src = "concat('<p><em>', p_name, '</em> <strong>', p_type, '</strong> <s>', p_name, '</s> <code>', p_brand, '</code> <a href=\"https://example.com/', p_partkey, '\" title=\"', p_name, '\">', p_type, '</a> 1 * 2 _x_ <u>u</u>')"
    return _converted(s, d, "html", "markdown", src)


@query("fn11_escape_markdown", r"SELECT p_partkey AS doc_id, p_name || E' \\* \\_ \\` \\[ \\] \\< \\> \\# \\| \\~ \\$ \\! \\& \\\\ ' || p_size || E'\n\n' AS output FROM part")
def fn11(s, d):
    return _converted(s, d, "html", "markdown", r"concat('<p>', p_name, ' * _ ` [ ] &lt; &gt; # | ~ $ ! &amp; \\ ', p_size, '</p>')")


def _article():
    """The body of an exported page, without ids."""
    return F.regexp_replace(F.regexp_extract("output", r"(?s)<article>\n(.*)</article>", 1), ' id="[^"]*"', "").alias("output")


@query("mp39_blocks_to_html", r"SELECT p_partkey AS doc_id, '<h2>' || p_name || E'</h2>\n<p>' || p_type || E'</p>\n<ol start=\"' || (p_size + 1) || E'\">\n<li>' || p_name || E'</li>\n</ol>\n<pre><code class=\"language-sql\">a &lt; b</code></pre>\n<blockquote>\n<p>' || p_type || E'</p>\n</blockquote>\n<table>\n<thead>\n<tr><th><p>' || p_name || E'</p></th></tr>\n</thead>\n<tr><td><p>x</p></td></tr>\n</table>\n<hr>\n' AS output FROM part")
def mp39(s, d):
    src = r"concat('## ', p_name, '\n\n', p_type, '\n\n', p_size + 1, '. ', p_name, '\n\n```sql\na < b\n```\n\n> ', p_type, '\n\n| ', p_name, ' |\n| - |\n| x |\n\n***')"
    return _converted(s, d, "markdown", "html", src).select("doc_id", _article())


@query("mp40_spans_to_html", r"""SELECT p_partkey AS doc_id, '<p><em>' || p_name || '</em> <strong>' || p_type || '</strong> <s>' || p_name || '</s> <code>' || p_brand || '</code> <a href="https://example.com/' || p_partkey || '" title="' || p_name || '">' || p_type || E'</a><br>1 &lt; 2 &amp; 3</p>\n' AS output FROM part""")
def mp40(s, d):
    src = r"""concat('*', p_name, '* **', p_type, '** ~~', p_name, '~~ `', p_brand, '` [', p_type, '](https://example.com/', p_partkey, ' "', p_name, '")\\\n1 < 2 & 3')"""
    return _converted(s, d, "markdown", "html", src).select("doc_id", _article())


@query("mp41_blocks_to_txt", r"SELECT p_partkey AS doc_id, p_name || E'\n' || repeat('=', length(p_name)) || E'\n\n' || p_type || E'\n\n' || (p_size + 1) || '. ' || p_name || E'\n\n\n  ' || p_brand || E'\n\n  ' || p_type || E'\n  \na\n' || p_size || E'\n\n' AS output FROM part")
def mp41(s, d):
    src = r"concat('# ', p_name, '\n\n', p_type, '\n\n', p_size + 1, '. ', p_name, '\n\n```\n', p_brand, '\n```\n\n> ', p_type, '\n\n| a |\n| - |\n| ', p_size, ' |')"
    return _converted(s, d, "markdown", "text", src)


# plain text, counts and pasted content


@query("ag3_count_nodes", "SELECT p_partkey AS doc_id, p_size + 2 AS blocks, p_size + 3 AS spans FROM part")
def ag3(s, d):
    nodes = I.nodes_of(_read(s, d, "markdown", r"concat(repeat('- a\n', p_size), '\n*', p_name, '* ', p_type)"))
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("kind") == "block").alias("blocks"), F.count_if(F.col("kind") == "span").alias("spans"))


@query("fn1_plain_spans", "SELECT p_partkey AS doc_id, p_name || ' ' || p_type || chr(10) || p_brand || ' x_' || p_size || ' alt' AS text FROM part")
def fn1(s, d):
    src = r"concat('**', p_name, '** [', p_type, '](/x)\\\n`', p_brand, '` $x_', p_size, '$ ![alt](https://example.com/i.png)')"
    return S.plain_spans(I.nodes_of(_read(s, d, "markdown", src))).select("doc_id", "text")


@query("fn2_plain_blocks", "SELECT p_partkey AS doc_id, unnest([p_name, p_name || chr(10) || p_type, 'a' || chr(9) || 'b' || chr(10) || p_type || chr(9) || p_size, p_brand]) AS text FROM part")
def fn2(s, d):
    src = r"concat('# ', p_name, '\n\n- ', p_name, '\n- *', p_type, '*\n\n| a | b |\n| - | - |\n| ', p_type, ' | ', p_size, ' |\n\n```\n', p_brand, '\n```')"
    return I.plain_blocks(_read(s, d, "markdown", src)).where("depth = 0 and type <> 'section'").select("doc_id", "text")


@query("fn38_sanitize_paste", """SELECT p_partkey AS doc_id, '<p>' || p_name || ' ' || p_type || ' <a href="/x">' || p_brand || '</a></p>' AS html, 1 AS dropped, 2 AS unwrapped, 3 AS attributes FROM part""")
def fn38(s, d):
    src = """concat('<p class="c" onclick="x()"><b>', p_name, '</b> <font>', p_type, '</font> <a href="/x" target="_blank">', p_brand, '</a><script>1</script></p>')"""
    return I.pasted(table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(src).alias("html")), "match")
