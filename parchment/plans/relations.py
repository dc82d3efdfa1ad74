"""Assets, annotations, revisions, caches and reports over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.operators import annotations as A
from parchment.operators import loss as L
from parchment.operators import references as R
from parchment.operators import revisions as V
from parchment.plans.catalog import query, table
from parchment.sources import container as C


# documents as blocks, labels and benchmark passages as annotations


def _blocks(s, d):
    return table(s, d, "documents").select(F.pmod(F.col("doc_id"), F.lit(50)).alias("doc_id"), F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("node_id"), "text")


def _quotes(s, d):
    b = table(s, d, "benchmark")
    every = b.withColumn("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))))
    return every.select("doc_id", F.concat_ws("_", F.lit("ann"), "doc_id", "item_id").alias("annotation_id"), F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("target_block"), F.col("text").alias("exact"), F.lit("").alias("prefix"), F.lit(". ").alias("suffix"))


QUOTES = """b AS (SELECT doc_id % 50 AS doc_id, 'blk_' || doc_id AS node_id, text FROM documents),
q AS (SELECT d AS doc_id, 'ann_' || d || '_' || item_id AS annotation_id, 'blk_' || d AS target_block, text AS exact FROM benchmark, range(50) r(d)),
o AS (SELECT q.*, b.text AS own FROM q LEFT JOIN b ON q.doc_id = b.doc_id AND q.target_block = b.node_id),
e AS (SELECT *, CASE WHEN exact = '' THEN 'detached' WHEN contains(own, exact || '. ') THEN 'unchanged' WHEN contains(own, exact) THEN 'reanchored' END AS here FROM o),
h AS (SELECT annotation_id, count(*) AS n FROM e JOIN b ON e.doc_id = b.doc_id AND contains(b.text, e.exact) AND b.node_id <> e.target_block WHERE here IS NULL GROUP BY 1),
s AS (SELECT e.doc_id, e.annotation_id, coalesce(here, CASE WHEN n = 1 THEN 'moved' ELSE 'detached' END) AS state FROM e LEFT JOIN h USING (annotation_id))"""


@query("cm14_relocate", f"WITH {QUOTES} SELECT * FROM s")
def cm14(s, d):
    return A.relocate(_quotes(s, d), _blocks(s, d)).select("doc_id", "annotation_id", "state")


@query("ag8_relocate_stats", f"WITH {QUOTES} SELECT doc_id, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'reanchored') AS reanchored, count(*) FILTER (state = 'moved') AS moved, count(*) FILTER (state = 'detached') AS detached FROM s GROUP BY doc_id")
def ag8(s, d):
    return A.relocation_counts(A.relocate(_quotes(s, d), _blocks(s, d)))


@query("jn8_quote_issues", f"WITH {QUOTES} SELECT doc_id, annotation_id, CASE WHEN own IS NULL THEN 'target_missing' ELSE 'quote_missing' END AS code FROM o WHERE own IS NULL OR NOT contains(own, exact)")
def jn8(s, d):
    return A.annotation_issues(_quotes(s, d), _blocks(s, d))


@query("cm12_annotate", "SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'de')")
def cm12(s, d):
    proposed = table(s, d, "labels").select("doc_id", F.lit("b").alias("target_block"), F.to_json(F.struct("quality")).alias("value"), "quality")
    blocks = table(s, d, "documents", "doc_id", "lang").where("lang = 'de'").select("doc_id", F.lit("b").alias("node_id"))
    return A.annotate(proposed.limit(0), proposed, blocks).select("doc_id", "quality")


@query("fl23_model_guards", "SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE contains(d.text, 'the') AND d.lang <> 'fr' AND quality * 1.5 BETWEEN 0 AND 1")
def fl23(s, d):
    results = table(s, d, "labels").select("doc_id", F.lit("b").alias("target_block"), F.lit("the").alias("exact"), (F.col("quality") * 1.5).alias("confidence"))
    blocks = table(s, d, "documents").select("doc_id", F.lit("b").alias("node_id"), "text", F.when(F.col("lang") == "fr", "heading").otherwise("paragraph").alias("type"))
    return A.guarded(results, blocks).select("doc_id")


@query("jn1_asset_urls", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://example.com/' || doc_id WHEN 1 THEN 'data:text/plain;base64,' || base64(encode(source)) ELSE 'asset://as_' || doc_id || '/x' END AS asset_url FROM documents")
def jn1(s, d):
    t = table(s, d, "documents", "doc_id", "source")
    i = F.col("doc_id").cast("string")
    nodes = t.select("doc_id", F.concat(F.lit("asset://as_"), i, F.lit("/x")).alias("asset"))
    assets = t.where("doc_id % 3 < 2").select(
        "doc_id", F.concat(F.lit("as_"), i).alias("asset_id"), F.lit("x").alias("filename"), F.lit("text/plain").alias("mime"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://example.com/"), i)).alias("url"), F.when(F.col("doc_id") % 3 == 1, F.col("source").cast("binary")).alias("bytes"),
    )
    return R.asset_urls(nodes, assets).select("doc_id", "asset_url")


def _refs(s, d):
    return table(s, d, "labels", "doc_id").select("doc_id", F.concat(F.lit("asset://as_"), F.col("doc_id").cast("string"), F.lit("/x")).alias("asset"), F.lit("p").alias("path"))


def _registry(s, d):
    return table(s, d, "documents", "doc_id").where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("as_"), F.col("doc_id").cast("string")).alias("asset_id"))


@query("jn5_dangling_assets", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def jn5(s, d):
    return R.dangling_assets(_refs(s, d), _registry(s, d)).select("doc_id")


@query("jn6_orphan_assets", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def jn6(s, d):
    return R.orphan_assets(_refs(s, d), _registry(s, d)).select("doc_id")


@query("jn4_dangling_footnotes", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def jn4(s, d):
    from parchment.operators.validate import dangling_footnotes

    ref = table(s, d, "labels", "doc_id").select("doc_id", F.lit("footnote_ref").alias("type"), F.lit("n").alias("target_ref"), F.lit(None).cast("string").alias("node_id"), F.lit("p").alias("path"))
    made = table(s, d, "documents").where("lang = 'en'").select("doc_id", F.lit("footnote").alias("type"), F.lit(None).cast("string").alias("target_ref"), F.lit("n").alias("node_id"), F.lit("q").alias("path"))
    return dangling_footnotes(ref.unionByName(made)).select("doc_id")


@query("jn13_comment_ranges", "WITH t AS (SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'), w AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t) SELECT conv_id, p AS \"start\", turn AS \"end\" FROM w WHERE role = 'assistant' AND r = 'user' AND NOT EXISTS (SELECT 1 FROM w v WHERE v.conv_id = w.conv_id AND v.role = v.r)")
def jn13(s, d):
    t = table(s, d, "conversations").where("role <> 'system'")
    events = t.select(F.col("conv_id"), F.lit("c").alias("key"), F.col("turn").alias("at"), F.when(F.col("role") == "user", "start").otherwise("end").alias("kind"))
    return R.pair_ranges(events, "conv_id").select("conv_id", "start", "end")


@query("jn20_read_asset", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(CAST(a.toxic AS VARCHAR), b.lang) AS value, CASE WHEN a.doc_id IS NULL THEN 'registered' ELSE 'staged' END AS origin FROM labels a FULL JOIN documents b ON a.doc_id = b.doc_id")
def jn20(s, d):
    staged = table(s, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("value"))
    return R.prefer(staged, table(s, d, "documents").select("doc_id", F.col("lang").alias("value")), "doc_id", "value")


@query("jn21_positional", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn AS reply, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, reply FROM a JOIN b USING (conv_id, i)")
def jn21(s, d):
    c = table(s, d, "conversations")
    asks, says = c.where("role = 'user'").select("conv_id", "turn"), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("reply"))
    return R.by_position(asks, says, "conv_id", "turn", "reply")


# conversations as revision chains


def _revisions(s, d):
    c = table(s, d, "conversations")
    kind = F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "user", "human").otherwise("system")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("rev"), F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("parent"), kind.alias("author_type"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))


@query("cm8_history", "SELECT conv_id AS doc_id, turn AS rev, row_number() OVER w AS position, row_number() OVER w = 1 AS is_head, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_root FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)")
def cm8(s, d):
    return V.history(_revisions(s, d)).select("doc_id", "rev", "position", "is_head", "is_root")


@query("jn18_parent", "SELECT conv_id AS doc_id, turn AS rev, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_sha256 FROM conversations")
def jn18(s, d):
    r = _revisions(s, d)
    up = r.select("doc_id", F.col("rev").alias("parent"), F.col("sha256").alias("parent_sha256"))
    return r.join(up, ["doc_id", "parent"], "left").select("doc_id", "rev", "parent_sha256")


@query("jn18_ancestors", "SELECT conv_id AS doc_id, turn AS rev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS depth FROM conversations")
def jn18b(s, d):
    return V.ancestors(_revisions(s, d))


WORDS = "w AS (SELECT DISTINCT conv_id AS doc_id, turn AS rev, unnest(string_split(text, ' ')) AS item FROM conversations), r AS (SELECT conv_id AS doc_id, turn AS rev, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations)"


@query("ag10_diff_block_ids", f"WITH {WORDS} SELECT doc_id, rev, (SELECT count(*) FROM w a WHERE a.doc_id = r.doc_id AND a.rev = r.rev AND NOT EXISTS (SELECT 1 FROM w b WHERE b.doc_id = r.doc_id AND b.rev = r.parent AND b.item = a.item)) AS n_added, (SELECT count(*) FROM w b WHERE b.doc_id = r.doc_id AND b.rev = r.parent AND NOT EXISTS (SELECT 1 FROM w a WHERE a.doc_id = r.doc_id AND a.rev = r.rev AND b.item = a.item)) AS n_removed FROM r")
def ag10(s, d):
    r = _revisions(s, d)
    return V.differences(r.select("doc_id", "rev", F.explode(F.split("content", " ")).alias("item")), r)


@query("fl11_cache_fresh", "SELECT conv_id, turn, (nullif(turn % 3, 2) IS NOT DISTINCT FROM nullif(conv_id % 3, 2)) AND (turn % 2 = 0 OR sha256(text) = sha256('x')) AS fresh FROM conversations")
def fl11(s, d):
    c = table(s, d, "conversations")
    two = F.lit(2)
    is_fresh = V.fresh(F.nullif(F.col("turn") % 3, two), F.nullif(F.col("conv_id") % 3, two), F.when(F.col("turn") % 2 == 1, F.sha2("text", 256)), F.sha2(F.lit("x"), 256))
    return c.select("conv_id", "turn", is_fresh.alias("fresh"))


@query("cm7_upgrade", "SELECT c.conv_id AS doc_id, CASE c.turn % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'html' ELSE 'docx' END AS format, c.turn % 4 < 3 AS known FROM conversations c JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) h USING (conv_id) WHERE c.turn <> h.m")
def cm7(s, d):
    c = table(s, d, "conversations")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("markdown", "text", "html", "docx")]), (F.col("turn") % 4 + 1).cast("int"))
    caches = c.select(F.col("conv_id").alias("doc_id"), fmt.alias("format"), F.col("turn").alias("revision"), F.lit(None).cast("string").alias("content_sha256"))
    manifest = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("current_revision")).withColumn("content_sha256", F.lit("x"))
    return V.stale_caches(caches, manifest)


@query("cm9_commit", "WITH h AS (SELECT conv_id AS doc_id, max(turn) AS m, arg_max(text, turn) AS t FROM conversations GROUP BY 1) SELECT doc_id, m + 1 AS rev, m AS parent FROM h WHERE t || CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END <> t")
def cm9(s, d):
    r = _revisions(s, d)
    new = r.groupBy("doc_id").agg(F.max_by("content", "rev").alias("c")).select("doc_id", F.concat("c", F.when(F.col("doc_id") % 2 == 0, "!").otherwise("")).alias("content"))
    return V.commit(r.drop("content"), new, "human", "edit").where("message = 'edit'").select("doc_id", "rev", "parent")


@query("cm10_checkout", "SELECT DISTINCT conv_id AS doc_id, 0 AS current_revision, sha256(text) AS content_sha256 FROM conversations WHERE turn = 0")
def cm10(s, d):
    r = _revisions(s, d)
    manifest = r.groupBy("doc_id").agg(F.max("rev").alias("current_revision"), F.max_by("sha256", "rev").alias("content_sha256"))
    return V.checkout(manifest, r, F.lit(0)).where("current_revision = 0").select("doc_id", "current_revision", "content_sha256")


@query("cm18_chain_issues", "SELECT conv_id AS doc_id, 'snapshot_changed' AS code FROM conversations WHERE turn = 1 AND conv_id % 3 = 0")
def cm18(s, d):
    r = _revisions(s, d)
    manifest = r.groupBy("doc_id").agg(F.max("rev").alias("current_revision"))
    snapshots = r.select("doc_id", "rev", F.when((F.col("rev") == 1) & (F.col("doc_id") % 3 == 0), "tampered").otherwise(F.col("content")).alias("content"))
    return V.chain_issues(r.drop("content"), manifest, snapshots)


@query("sk13_next_report", "SELECT conv_id AS doc_id, max(turn) + 1 AS next FROM conversations GROUP BY 1")
def sk13(s, d):
    paths = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("reports/import-"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".json")).alias("path"))
    return V.next_sequence(paths, "reports/import-")


@query("sk4_set_entry", "SELECT doc_id, coalesce('label ' || quality, lang) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def sk4(s, d):
    base = table(s, d, "documents").select("doc_id", F.col("lang").alias("value"))
    new = table(s, d, "labels").join(base.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("value"))
    return V.upsert(base, new, ["doc_id"])


@query("sk15_publish", "SELECT doc_id, sha256(text) AS content_hash, sha256('r1' || sha256(text) || lang || 'css2' || 'paged') AS layout_hash FROM documents")
def sk15(s, d):
    content = table(s, d, "documents").select("doc_id", F.lit(1).alias("revision"), F.col("text").alias("content"), F.col("lang").alias("theme"), F.col("text").alias("artifact"))
    empty = s.createDataFrame([], "doc_id long")
    return V.published(empty, content, "r1", "css2", "paged").select("doc_id", "content_hash", "layout_hash")


@query("cm18_publication_issues", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'artifact_missing' ELSE 'artifact_changed' END AS code FROM documents WHERE doc_id % 5 IN (0, 1)")
def cm18b(s, d):
    t = table(s, d, "documents", "doc_id", "text")
    pubs = t.select("doc_id", F.lit("p").alias("path"), F.sha2("text", 256).alias("sha256"))
    entries = t.where("doc_id % 5 > 0").select("doc_id", F.lit("p").alias("name"), F.when(F.col("doc_id") % 5 == 1, F.lit("x")).otherwise(F.col("text")).cast("binary").alias("bytes"))
    return V.publication_issues(pubs, entries).select("doc_id", "code")


# containers and reports


def _entries(s, d):
    t = table(s, d, "documents", "doc_id", "n_chars", "source")
    return t.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / (1 + F.col("doc_id") % 300))).alias("compressed_size"), F.when(F.col("doc_id") % 4 == 0, "stored").otherwise("deflate").alias("method"))


@query("sc4_limits", "WITH e AS (SELECT source AS doc_id, n_chars AS size, greatest(1, n_chars // (1 + doc_id % 300)) AS c, doc_id % 4 = 0 AS stored FROM documents), g AS (SELECT doc_id, count(*) AS n_entries, max(size) AS largest, sum(size) AS total, coalesce(max(size * 1.0 / c) FILTER (NOT stored AND c > 64), 0) AS r FROM e GROUP BY 1) SELECT doc_id, n_entries, largest, total, r <= 200 AS ok FROM g")
def sc4(s, d):
    return C.within_limits(_entries(s, d)).select("doc_id", "n_entries", "largest", "total", "ok")


@query("sc15_inventory", "SELECT source AS doc_id, bool_or(doc_id % 9 = 1) AS has_headers, bool_or(doc_id % 9 = 2) AS has_footers, bool_or(doc_id % 9 = 3) AS has_comments, count(*) FILTER (doc_id % 9 > 3) AS n_media FROM documents GROUP BY 1")
def sc15(s, d):
    from parchment.sources.docx import inventory

    k = (F.col("doc_id") % 9).cast("int")
    name = F.when(k == 0, "word/document.xml").when(k == 1, "word/header1.xml").when(k == 2, "word/footer1.xml").when(k == 3, "word/comments.xml").otherwise("word/media/x.png")
    return inventory(table(s, d, "documents", "doc_id", "source").select(F.col("source").alias("doc_id"), name.alias("name")))


@query("pj14_loss_issues", "WITH i AS (SELECT doc_id % 2 = 0 AS h, doc_id % 3 = 0 AS f, doc_id % 5 = 0 AS c, doc_id FROM documents) SELECT doc_id, 'docx_headers' AS feature, 'preserved_raw' AS loss_class FROM i WHERE h UNION ALL SELECT doc_id, 'docx_footers', 'preserved_raw' FROM i WHERE f UNION ALL SELECT doc_id, 'docx_comments', 'partial' FROM i WHERE c")
def pj14(s, d):
    from parchment.sources.docx import inventory_losses

    i = F.col("doc_id")
    return inventory_losses(table(s, d, "documents", "doc_id").select("doc_id", (i % 2 == 0).alias("has_headers"), (i % 3 == 0).alias("has_footers"), (i % 5 == 0).alias("has_comments")))


def _events(s, d):
    kinds = F.array(*[F.lit(x) for x in ("none", "partial", "degraded", "unsupported", "preserved_raw")])
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").cast("int").alias("seq"), F.col("event_type").alias("feature"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("loss_class"),
        F.lit("kept").alias("action"), F.lit(None).cast("string").alias("location"), F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")).alias("detail"),
    )


@query("ag9_archive_summary", "SELECT user_id AS doc_id, unnest(['none', 'partial', 'degraded', 'unsupported', 'preserved_raw']) AS loss_class, unnest([count(*) FILTER (event_id % 5 = 0), count(*) FILTER (event_id % 5 = 1), count(*) FILTER (event_id % 5 = 2), count(*) FILTER (event_id % 5 = 3), count(*) FILTER (event_id % 5 = 4)]) AS n FROM events GROUP BY user_id")
def ag9(s, d):
    return L.summed(L.reports(_events(s, d), "events", "report"))


@query("sk12_report_consistent", "SELECT DISTINCT user_id AS doc_id, true AS consistent FROM events")
def sk12(s, d):
    return L.consistent(L.reports(_events(s, d), "events", "report"))


@query("ag19_verify_totals", "SELECT user_id AS doc_id, count(*) FILTER (event_id % 3 = 0) AS errors, count(*) FILTER (event_id % 3 = 1) AS warnings, count(*) FILTER (event_id % 3 = 2) AS infos, CASE WHEN count(*) FILTER (event_id % 3 = 0) > 0 THEN 1 ELSE 0 END AS exit_code FROM events GROUP BY 1")
def ag19(s, d):
    from parchment.operators.validate import totals

    level = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), (F.col("event_id") % 3 + 1).cast("int"))
    return totals(table(s, d, "events").select(F.col("user_id").alias("doc_id"), level.alias("level")))


@query("fl18_layer_issues", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'layer_missing' ELSE 'layer_changed' END AS code FROM documents WHERE doc_id % 3 < 2")
def fl18(s, d):
    from parchment.operators.verify import layer_issues

    t = table(s, d, "documents", "doc_id", "text")
    layers = t.select("doc_id", F.lit("content").alias("layer"), F.lit("content.json").alias("path"), F.sha2("text", 256).alias("sha256"))
    entries = t.where("doc_id % 3 > 0").select("doc_id", F.lit("content.json").alias("name"), F.when(F.col("doc_id") % 3 == 1, F.lit("x")).otherwise(F.col("text")).cast("binary").alias("bytes"))
    return layer_issues(layers, entries).select("doc_id", "code")
