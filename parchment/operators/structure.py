"""Order-dependent passes as windows: sections, islands, numbering."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.store import growing

LEVELS = range(1, 7)


def section_parents(nodes: DataFrame, doc: str = "doc_id", seq: str = "seq", level: str = "level") -> DataFrame:
    """nodes with parent: the latest heading before of a smaller level; for what is no heading (null level) the latest heading.

    One window by document: the last position of each level so far is carried, and levels above are compared.
    """
    before = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(seq))).over(before) for k in LEVELS]
    names = {f"_l{k}": c for k, c in zip(LEVELS, last, strict=True)}
    above = F.greatest(*[F.when(F.col(level).isNull() | (F.col(level) > k), F.col(f"_l{k}")) for k in LEVELS])
    return nodes.withColumns(names).withColumn("parent", above).drop(*names)


def islands(table: DataFrame, partition: list[str], order: str, same: Column) -> DataFrame:
    """table with island: a number that grows where same (a condition on a row and lag columns) is not true."""
    w = Window.partitionBy(*partition).orderBy(order)
    begun = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("island", begun)


def merge_runs(table: DataFrame, partition: list[str], order: str, mark: str, text: str) -> DataFrame:
    """Neighbours of equal mark become one row with their texts joined in order; empty texts go first."""
    w = Window.partitionBy(*partition).orderBy(order)
    kept = table.where(F.length(text) > 0).withColumn("_before", F.lag(mark).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    marked = kept.withColumn("_new", F.when(F.col("_first") | ~F.col(mark).eqNullSafe(F.col("_before")), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return numbered.groupBy(*partition, "island").agg(F.first(mark).alias(mark), F.array_join(F.transform(parts, lambda p: p[text]), "").alias(text))


def first_use_ordinal(table: DataFrame, partition: list[str], key: str, order: str) -> DataFrame:
    """table with ordinal: keys numbered from 0 in order of first use."""
    first = Window.partitionBy(*partition, key)
    return table.withColumn("_first", F.min(order).over(first)).withColumn("ordinal", F.dense_rank().over(Window.partitionBy(*partition).orderBy("_first")) - 1).drop("_first")


def keep_first_ids(table: DataFrame, partition: list[str], key: str, order: str, valid: Column) -> DataFrame:
    """table with keeps: whether a row keeps its id, as the first row of a valid one."""
    n = F.row_number().over(Window.partitionBy(*partition, key).orderBy(order))
    return table.withColumn("keeps", F.coalesce(valid, F.lit(False)) & (n == 1))


def auto_labels(table: DataFrame, partition: list[str], order: str, label: str) -> DataFrame:
    """table with shown: the label, or a running number over rows without one."""
    n = F.sum(F.when(F.col(label).isNull(), 1).otherwise(0)).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("shown", F.coalesce(F.col(label), n.cast("string")))


def row_spans(cells: DataFrame, partition: list[str], row: str, merge: str) -> DataFrame:
    """Vertical merges: a restart and the continues below it become one cell with a row span; continues go."""
    w = Window.partitionBy(*partition).orderBy(row)
    numbered = cells.withColumn("island", F.sum(F.when(F.col(merge) == "continue", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*partition, "island").agg(F.min(row).alias(row), F.count("*").alias("row_span")).drop("island")


def outline(nodes: DataFrame) -> DataFrame:
    """Headings of a node table with their plain text, in document order: doc_id, seq, level, text."""
    heads = nodes.where("type = 'heading'").select("doc_id", F.col("seq").alias("top"), "level")
    below = nodes.where("kind = 'span' and type in ('text', 'code')").select("doc_id", "seq", "path", "text")
    paths = nodes.where("type = 'heading'").select("doc_id", F.col("seq").alias("top"), F.col("path").alias("head"))
    joined = below.withColumn("head", F.regexp_extract("path", r"^(.*?)\.content\[\d+\](?:\.content\[\d+\])*$", 1)).join(growing(paths), ["doc_id", "head"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    texts = joined.groupBy("doc_id", "top").agg(text.alias("text"))
    return heads.join(growing(texts), ["doc_id", "top"], "left").select("doc_id", F.col("top").alias("seq"), "level", F.coalesce("text", F.lit("")).alias("text"))


def plain_spans(nodes: DataFrame) -> DataFrame:
    """Plain text of every leaf block, from its spans in order: doc_id, path, text. One exchange, no Python."""
    shown = (
        F.when(F.col("type").isin("text", "code"), F.col("text")).when(F.col("type") == "hard_break", F.lit("\n")).when(F.col("type") == "inline_math", F.col("latex"))
        .when(F.col("type") == "inline_image", F.col("alt")).when(F.col("type").isin("mention", "cite"), F.col("target_ref"))
    )
    spans = nodes.where("kind = 'span'").select("doc_id", F.regexp_extract("path", r"^(.*?)\.(?:content|caption)\[\d+\](?:\.content\[\d+\])*$", 1).alias("path"), "seq", F.coalesce(shown, F.lit("")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    return spans.groupBy("doc_id", "path").agg(joined.alias("text"))


def list_items(nodes: DataFrame) -> DataFrame:
    """Items of the lists of a node table: doc_id, list (its path), style, start, ord, checked, and marker, what stands before an item."""
    items = nodes.where("type = 'item'").select("doc_id", F.regexp_replace("path", r"\.items\[\d+\]$", "").alias("list"), "ord", "checked")
    lists = nodes.where("type = 'list'").select("doc_id", F.col("path").alias("list"), "style", "start")
    number = F.concat((F.coalesce("start", F.lit(1)) + F.col("ord")).cast("string"), F.lit(". "))
    return items.join(growing(lists), ["doc_id", "list"]).withColumn("marker", F.when(F.col("style") == "ordered", number).otherwise("- "))


def lone(nodes: DataFrame, kind: str) -> DataFrame:
    """doc_id, path and lone: whether a paragraph, blank text aside, holds one span of that kind and nothing else."""
    span = nodes.where("kind = 'span'").select("doc_id", F.col("parent_seq").alias("seq"), "type", F.coalesce(F.trim("text"), F.lit("")).alias("text"))
    solid = span.groupBy("doc_id", "seq").agg(F.count_if(F.col("type") == kind).alias("n"), F.count_if((F.col("type") != "text") | (F.col("text") != "")).alias("all"))
    found = nodes.where("type = 'paragraph'").select("doc_id", "seq", "path").join(growing(solid), ["doc_id", "seq"], "left")
    return found.select("doc_id", "path", F.coalesce((F.col("n") == 1) & (F.col("all") == 1), F.lit(False)).alias("lone"))


def slugs(names: list[str]) -> list[str]:
    """A slug for each name: ASCII letters and digits by dashes; style-N without any; repeats get a number. Each depends on those before."""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or f"style-{i + 1}"
        slug, n = base, 2
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add(slug)
        out.append(slug)
    return out


def style_slugs(styles: DataFrame, doc: str, order: str, name: str) -> DataFrame:
    """styles(doc, order, name) -> doc, order and slug. The names of a document are one small group; it goes through Arrow at once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return pa.table({doc: table[doc], order: table[order], "slug": slugs([n or "" for n in table[name].to_pylist()])})

    kept = styles.select(doc, order, name)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.groupBy(doc).applyInArrow(run, f"{doc} {kinds[doc]}, {order} {kinds[order]}, slug string")


def count_chars(nodes: DataFrame) -> DataFrame:
    """doc_id and n: the characters of all text in a document."""
    return nodes.where("text is not null").groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))


def text_index(nodes: DataFrame) -> DataFrame:
    """doc_id and index, a map from the path of each block with spans to its plain text."""
    return plain_spans(nodes).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("index"))


def page_index(nodes: DataFrame) -> DataFrame:
    """doc_id, path, node_id and page of each block at the top of a document: page breaks before it, and one."""
    top = nodes.where("kind = 'block' and depth = 0")
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    paged = top.withColumn("page", F.coalesce(F.sum(F.when(F.col("type") == "page_break", 1).otherwise(0)).over(before), F.lit(0)) + 1)
    return paged.where("type <> 'page_break'").select("doc_id", "path", "node_id", "page")


def first_rows(table: DataFrame, partition: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each partition in an order; the sort keeps no more of them than that."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return table.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
