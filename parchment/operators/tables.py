"""Edits of table blocks as grid transformations: cells(doc_id, table, row, col, row_span, col_span, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.store import growing

KEY = ("doc_id", "table")


def _shift(axis: str, at: int, by: int) -> dict[str, Column]:
    return {axis: F.when(F.col(axis) >= at, F.col(axis) + by).otherwise(F.col(axis))}


def cells(nodes: DataFrame) -> DataFrame:
    """The cells of a node table's tables, with their plain text: doc_id, table (its path), row, col, row_span, col_span, role, text."""
    at = F.regexp_extract("path", r"^(.*)\.rows\[(\d+)\]\.cells\[\d+\]$", 1), F.regexp_extract("path", r"\.rows\[(\d+)\]\.cells\[\d+\]$", 1).cast("int")
    own = nodes.where("type = 'cell'").select(
        "doc_id", F.col("path").alias("cell"), at[0].alias("table"), at[1].alias("row"), "col", F.coalesce("row_span", F.lit(1)).alias("row_span"),
        F.coalesce("col_span", F.lit(1)).alias("col_span"), F.coalesce("role", F.lit("data")).alias("role"),
    )
    # a span belongs to the innermost cell on its path
    inside = nodes.where("kind = 'span' and text is not null").withColumn("cell", F.regexp_extract("path", r"^(.*\.cells\[\d+\])", 1)).where("cell <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    texts = inside.groupBy("doc_id", "cell").agg(joined.alias("text"))
    return own.join(growing(texts), ["doc_id", "cell"], "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("cell")


def widths(cells: DataFrame) -> DataFrame:
    """doc_id, table and width: the most columns that a row's cells take together."""
    rows = cells.groupBy(*KEY, "row").agg(F.sum("col_span").alias("n"))
    return rows.groupBy(*KEY).agg(F.max("n").alias("width"))


def insert(cells: DataFrame, axis: str, at: int) -> DataFrame:
    """An empty row or column before position at; cells that reach across it grow by one."""
    span, other = f"{axis}_span", "col" if axis == "row" else "row"
    across = (F.col(axis) < at) & (F.col(axis) + F.col(span) > at)
    moved = cells.withColumn(span, F.when(across, F.col(span) + 1).otherwise(F.col(span))).withColumns(_shift(axis, at, 1))
    covered = cells.where(across).select(*KEY, F.explode(F.sequence(F.col(other), F.col(other) + F.col(f"{other}_span") - 1)).alias(other)).distinct()
    every = cells.select(*KEY, F.explode(F.sequence(F.col(other), F.col(other) + F.col(f"{other}_span") - 1)).alias(other)).distinct()
    new = every.join(growing(covered), [*KEY, other], "left_anti").select(
        *KEY, *[{axis: F.lit(at).alias(axis), other: F.col(other), "row_span": F.lit(1).alias("row_span"), "col_span": F.lit(1).alias("col_span")}[c] for c in ("row", "col", "row_span", "col_span")],
        F.lit("data").alias("role"), F.lit("").alias("text"),
    )
    return moved.unionByName(new)


def delete(cells: DataFrame, axis: str, at: int) -> DataFrame:
    """Without a row or column; cells that reach across it shrink, and those that lie in it alone go."""
    span = f"{axis}_span"
    inside = (F.col(axis) <= at) & (F.col(axis) + F.col(span) > at)
    kept = cells.withColumn(span, F.when(inside, F.col(span) - 1).otherwise(F.col(span))).where(F.col(span) > 0)
    return kept.withColumn(axis, F.when(F.col(axis) > at, F.col(axis) - 1).otherwise(F.col(axis)))


def merge(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """One cell for a rectangle, with the texts of its cells in reading order."""
    inside = F.col("row").between(top, bottom) & F.col("col").between(left, right)
    texts = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda c: c["text"]), lambda t: t != ""), "\n")
    one = cells.where(inside).groupBy(*KEY).agg(texts.alias("text"), F.min_by("role", F.struct("row", "col")).alias("role"))
    made = one.select(*KEY, F.lit(top).alias("row"), F.lit(left).alias("col"), F.lit(bottom - top + 1).alias("row_span"), F.lit(right - left + 1).alias("col_span"), "role", "text")
    return cells.where(~inside).select(made.columns).unionByName(made)


def split(cells: DataFrame) -> DataFrame:
    """Every merged cell as single ones; the first keeps the text."""
    r = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))
    c = F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1))
    out = cells.withColumn("_r", r).withColumn("_c", c)
    first = (F.col("_r") == F.col("row")) & (F.col("_c") == F.col("col"))
    return out.select(*KEY, F.col("_r").alias("row"), F.col("_c").alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "role", F.when(first, F.col("text")).otherwise("").alias("text"))


def toggle_header(cells: DataFrame) -> DataFrame:
    """The first row becomes a header, or data if it was one."""
    return cells.withColumn("role", F.when(F.col("row") == 0, F.when(F.col("role") == "header", "data").otherwise("header")).otherwise(F.col("role")))


def metadata(cells: DataFrame) -> DataFrame:
    """Columns, rows, header and spans of each table, recomputed."""
    return cells.groupBy(*KEY).agg(
        F.max(F.col("col") + F.col("col_span")).alias("n_cols"), F.max(F.col("row") + F.col("row_span")).alias("n_rows"),
        F.bool_and(F.when(F.col("row") == 0, F.col("role") == "header")).alias("header_row"), F.bool_or((F.col("col_span") > 1) | (F.col("row_span") > 1)).alias("has_spans"),
    )


def format_state(spans: DataFrame, keys: list[str]) -> DataFrame:
    """For a selection's spans and each key of the format extension: the value all share, or mixed."""
    values = [F.get_json_object("extra", f"$.format.{k}").alias(k) for k in keys]
    shown = lambda k: F.when(F.count_distinct(F.coalesce(F.col(k), F.lit("\u0000"))) > 1, F.lit("mixed")).otherwise(F.max(k))
    return spans.select("doc_id", *values).groupBy("doc_id").agg(*[shown(k).alias(k) for k in keys])


def set_format(spans: DataFrame, key: str, value: str | None) -> DataFrame:
    """spans with a key of the format extension set, or cleared; other members of extra stay as they are, of whatever type."""
    members = "map<string,variant>"
    empty = F.create_map().cast(members)
    whole = F.coalesce(F.from_json("extra", members), empty)
    own = F.coalesce(F.from_json(F.get_json_object("extra", "$.format"), members), empty)
    kept = F.map_filter(own, lambda k, _: k != key)
    new = kept if value is None else F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(F.to_json(F.array(F.lit(value)))).cast("array<variant>")[0]))
    others = F.map_filter(whole, lambda k, _: k != "format")
    return spans.withColumn("extra", F.to_json(F.map_concat(others, F.create_map(F.lit("format"), F.parse_json(F.to_json(new))))))
