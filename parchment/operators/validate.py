"""Content validation: what rules find in a node table.

Issues: doc_id, level (error, warning, info), code, path. Each is reported once. Rules about one row are evaluated together, in one
pass over the rows; only rules about several rows (grids, repeated ids, dangling references, missing payloads) join or sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import valid_id
from parchment.schemas import NODE_TYPES, SPAN_TYPES
from parchment.store import growing

LIST_STYLES, VARIANTS, LOSS_KINDS = ("bullet", "ordered"), ("note", "tip", "important", "warning"), ("none", "partial", "degraded", "unsupported", "preserved_raw")
ISSUES = ("doc_id", "level", "code", "path")

#: A rule about one row: when it is broken, how grave that is, and its code.
Rule = tuple[Column, str, str]


def issues_of(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """Issues of all rules about one row, in one pass."""
    found = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for broken, level, code in rules]))
    return nodes.select("doc_id", "path", F.explode(found).alias("i")).select("doc_id", "i.level", "i.code", "path")


def _issue(nodes: DataFrame, condition: Column, level: str, code: str) -> DataFrame:
    return nodes.where(condition).select("doc_id", F.lit(level).alias("level"), F.lit(code).alias("code"), "path")


def _is(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def _not(condition: Column) -> Column:
    """A condition that is false, or null."""
    return ~F.coalesce(condition, F.lit(False))


def type_rules() -> list[Rule]:
    block, span = F.col("kind") == "block", F.col("kind") == "span"
    return [
        (F.col("type").isNull(), "error", "type_missing"),
        ((block & ~_is(*NODE_TYPES)) | (span & ~_is(*SPAN_TYPES)), "info", "type_unknown"),
    ]


def id_rules() -> list[Rule]:
    """Blocks and structural parts need an id of the right prefix."""
    named = (F.col("kind") != "span") & ~_is("column")
    prefix = F.when(_is("section"), "sec").when(_is("item", "list_item"), "li").when(_is("row"), "row").when(_is("cell"), "cel").otherwise("blk")
    i = F.col("node_id")
    return [
        (named & i.isNull(), "error", "id_missing"),
        (named & i.isNotNull() & ~valid_id(i), "error", "id_invalid"),
        (named & valid_id(i) & (F.split_part(i, F.lit("_"), F.lit(1)) != prefix), "warning", "id_prefix"),
    ]


def block_rules() -> list[Rule]:
    return [
        (_is("heading") & _not(F.col("level").between(1, 6)), "error", "heading_level"),
        (_is("list") & _not(F.col("style").isin(*LIST_STYLES)), "error", "list_style"),
        (_is("list") & (F.col("start") < 1), "error", "list_start"),
        (_is("code_block") & F.col("text").isNull(), "error", "code_text"),
        (_is("callout") & _not(F.col("variant").isin(*VARIANTS)), "error", "callout_variant"),
        (_is("math_block", "inline_math") & F.col("latex").isNull(), "error", "math_latex"),
        (_is("cell") & F.col("col").isNull(), "error", "cell_column"),
        (_is("figure", "image", "inline_image") & F.col("asset").isNull(), "error", "asset_missing"),
    ]


def span_rules() -> list[Rule]:
    return [
        ((F.col("kind") == "span") & _is("text", "code") & F.col("text").isNull(), "error", "span_text"),
        (_is("link") & F.col("url").isNull(), "error", "link_url"),
        (_is("footnote_ref") & F.col("target_ref").isNull(), "error", "footnote_ref_id"),
    ]


def unknown_rules() -> list[Rule]:
    """Unknown content needs a loss class, a summary and a payload."""
    return [
        (_is("unknown") & _not(F.col("loss_class").isin(*LOSS_KINDS)), "error", "unknown_loss_class"),
        (_is("unknown") & F.col("payload_ref").isNull(), "error", "unknown_payload_ref"),
        (_is("unknown") & (F.coalesce(F.trim("summary"), F.lit("")) == ""), "warning", "unknown_summary"),
    ]


def format_rules(member: str = "format") -> list[Rule]:
    """Ranges of the format extension, a JSON object in extra."""
    at = lambda key: F.get_json_object("extra", f"$.{member}.{key}")
    out = lambda key, low, high: at(key).isNotNull() & _not(at(key).try_cast("double").between(low, high))
    return [
        (at("align").isNotNull() & ~at("align").isin("left", "center", "right", "justify"), "warning", "format_align"),
        (out("spaceBefore", 0, 999) | out("spaceAfter", 0, 999) | out("indent", 0, 999), "warning", "format_points"),
        (out("lineHeight", 0.5, 5), "warning", "format_line_height"),
        (out("fontSize", 1, 999), "warning", "format_font_size"),
        (at("color").isNotNull() & ~at("color").rlike("^#[0-9A-Fa-f]{6}$"), "warning", "format_color"),
        (at("fontFamily").isNotNull() & ~at("fontFamily").rlike(r"^[\p{L}\p{N} ,._'-]{1,120}$"), "warning", "format_font"),
        (at("verticalAlign").isNotNull() & ~at("verticalAlign").isin("sub", "super"), "warning", "format_vertical"),
    ]


def row_rules() -> list[Rule]:
    return [*type_rules(), *id_rules(), *block_rules(), *span_rules(), *unknown_rules(), *format_rules()]


def table_rules(nodes: DataFrame) -> list[DataFrame]:
    """Tables without columns or rows, and cells that leave the grid or overlap."""
    parts = nodes.where(_is("column", "row")).groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count_if(_is("column")).alias("n_cols"), F.count_if(_is("row")).alias("n_rows"))
    tables = nodes.where(_is("table")).join(growing(parts), ["doc_id", "seq"], "left").na.fill(0, ["n_cols", "n_rows"])
    row = nodes.where(_is("row")).select("doc_id", F.col("seq").alias("row_seq"), F.col("parent_seq").alias("table_seq"), F.col("ord").alias("row"))
    cell = nodes.where(_is("cell")).select("doc_id", F.col("parent_seq").alias("row_seq"), "seq", "path", "col", "col_span", "row_span")
    sized = tables.select("doc_id", F.col("seq").alias("table_seq"), "n_cols", "n_rows")
    cells = cell.join(growing(row), ["doc_id", "row_seq"]).join(growing(sized), ["doc_id", "table_seq"])
    grid = grid_issues(cells.withColumnRenamed("table_seq", "table"), ("doc_id", "table"))
    return [
        _issue(tables, F.col("n_cols") == 0, "error", "table_columns"),
        _issue(tables, F.col("n_rows") == 0, "warning", "table_rows"),
        grid.select("doc_id", F.lit("warning").alias("level"), F.col("issue").alias("code"), "path"),
    ]


def grid_issues(cells: DataFrame, table: tuple[str, ...]) -> DataFrame:
    """cells: table's columns, row, col, col_span, row_span, n_cols, n_rows, seq and others -> the same with issue.

    A cell takes a rectangle of grid places; it may not leave the table's columns or rows, nor take a place that an earlier
    cell has. Two rectangles that overlap share the place where the later row and the later column of their corners meet, so
    places need to be listed only up to the last row and column in which a cell of the table begins, however wide a cell says it is.
    """
    every = Window.partitionBy(*table)
    across, down = (F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)) for c in ("col_span", "row_span"))
    sized = cells.withColumns({"_across": across, "_down": down, "_right": F.max("col").over(every), "_bottom": F.max("row").over(every)})
    wide = sized.where(F.col("col") + F.col("_across") > F.col("n_cols")).withColumn("issue", F.lit("cell_beyond_columns"))
    tall = sized.where(F.col("row") + F.col("_down") > F.col("n_rows")).withColumn("issue", F.lit("cell_beyond_rows"))
    upto = lambda at, span, last: F.explode(F.sequence(F.col(at), F.least(F.col(at) + F.col(span) - 1, F.col(last))))
    places = sized.withColumn("_r", upto("row", "_down", "_bottom")).withColumn("_c", upto("col", "_across", "_right"))
    later = places.withColumn("_n", F.row_number().over(Window.partitionBy(*table, "_r", "_c").orderBy("seq"))).where("_n > 1")
    overlap = later.select(sized.columns).distinct().withColumn("issue", F.lit("cell_overlap"))
    return wide.unionByName(tall).unionByName(overlap).drop("_across", "_down", "_right", "_bottom")


def missing_payloads(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Payloads of unknown content that entries (doc_id, path) do not hold."""
    held = entries.select("doc_id", F.col("path").alias("payload_ref"))
    lost = nodes.where(_is("unknown") & F.col("payload_ref").isNotNull()).join(growing(held), ["doc_id", "payload_ref"], "left_anti")
    return _issue(lost, F.lit(True), "error", "unknown_payload_missing")


def dangling_footnotes(nodes: DataFrame) -> DataFrame:
    """Footnote references without a definition in the document."""
    defined = nodes.where(_is("footnote")).select("doc_id", F.col("node_id").alias("target_ref"))
    lost = nodes.where(_is("footnote_ref") & F.col("target_ref").isNotNull()).join(growing(defined), ["doc_id", "target_ref"], "left_anti")
    return _issue(lost, F.lit(True), "warning", "footnote_dangling")


def repeated_ids(nodes: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("seq"))
    return _issue(nodes.where("node_id is not null").withColumn("_n", n), F.col("_n") > 1, "error", "id_repeated")


def check_content(nodes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """All issues of a node table; entries (doc_id, path) are what payloads may refer to.

    nodes is read by each of the rules about several rows, so it should be a table that is written (store.materialise), not a parse.
    """
    parts = [issues_of(nodes, row_rules()), *table_rules(nodes), dangling_footnotes(nodes), repeated_ids(nodes)]
    if entries is not None:
        parts.append(missing_payloads(nodes, entries))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def totals(issues: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, infos and the exit code they give."""
    count = lambda level: F.count_if(F.col("level") == level)
    found = issues.groupBy("doc_id").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    return found.withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))


def known_types(nodes: DataFrame) -> DataFrame:
    """doc_id, type and known: whether each type of a block or span that a document uses is in the closed lists."""
    used = nodes.where("kind <> 'struct'").select("doc_id", "kind", "type").distinct()
    known = F.when(F.col("kind") == "span", _is(*SPAN_TYPES)).otherwise(_is(*NODE_TYPES))
    return used.select("doc_id", "kind", "type", known.alias("known"))


def head_issues(issues: DataFrame, most: int = 10) -> DataFrame:
    """The first issues of each document in order of place and code, as a summary shows them."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "code"))
    return issues.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
