"""What keeps the queries within their memory on tables much larger than the given ones."""

import pyarrow as pa
import pytest

from parchment.plans import registry
from parchment.sources import importers as I
from parchment.tree import Job

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cm17_relocated_layer", "cm18_verify_all", "cm15_annotations", "se4_issue_union", "jn9_moved_quotes", "cm15_commits", "mp25_docx_tables", "mp15_docx_lists", "sk20_theme"])
def test_growing_sides_are_merged(spark, name):
    """No side of a join that grows with the documents is sent to the driver, however small Spark takes it to be."""
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_exports_hold_few_documents_as_objects():
    """However many documents an Arrow batch holds, few of them are objects at a time, none is left out and their order stays."""
    batch = pa.RecordBatch.from_pylist([{"doc_id": i} for i in range(3 * I.DOCUMENTS_AT_ONCE + 1)])
    found = list(I.portions([batch, batch.slice(0, 0), batch.slice(0, 2)]))
    assert [len(x) for x in found] == [I.DOCUMENTS_AT_ONCE] * 3 + [1, 2]
    assert [r["doc_id"] for x in found for r in x] == [*range(batch.num_rows), 0, 1]


def test_marked_exports_take_one_python_step(spark):
    """Where two Python steps are chained, an executor has twice as many Python workers, and all nodes of all documents pass between them."""
    plan = registry.queries()["sk9_export_html_marked"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") + plan.count("MapInArrow") == 1


def test_conversion_is_import_and_export(spark):
    """Import and export in one step give what they give one after the other, documents without text included."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").selectExpr("page_id AS doc_id", "html AS text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, '<p>a<img src="data:image/png;base64,QUJD">&amp<custom x="1">b</custom>'), (None, "<h1>c</h1>")], "doc_id long, text string"))
    docs = I.imported(pages, "html")
    unread = {r.doc_id: r.n for r in docs.selectExpr("doc_id", "size(filter(loss, e -> e.loss_class <> 'none')) AS n").collect()}
    for target, options in (("html", {"marked": True}), ("html", {}), ("text", {}), ("markdown", {})):
        own = {r.doc_id: r for r in I.convert(pages, "html", target, **options).collect()}
        apart = {r.doc_id: r for r in I.exported(docs, target, **options).collect()}
        assert own.keys() == apart.keys() == unread.keys() and len(own) > 20
        for i, r in apart.items():
            assert (own[i].output, own[i].n_lost, own[i].n_unread) == (r.output, r.n_lost + unread[i], unread[i])


def test_imports_give_back_frames_of_bounded_size():
    """The nodes and payloads of few documents are one frame, and none is left out."""
    nodes = [{"type": "paragraph", "content": [{"type": "text", "text": "a"}]}] * (I.NODES_AT_ONCE // 4)
    heavy = Job(preserved=[{"path": "p", "origin": "o", "seq": 0, "bytes": bytes(2000 * I.NODES_AT_ONCE)}])
    rows = [I.gathered(i, nodes, Job()) for i in range(5)] + [I.gathered(i, [], heavy) for i in range(5, 8)]
    frames = list(I.framed(iter(rows)))
    assert [len(f) for f in frames] == [2, 2, 2, 1, 1]
    assert [i for f in frames for i in f["doc_id"]] == list(range(8))


def test_style_chains_have_no_row_limit(spark):
    """Spark ends recursive queries in an error beyond a number of rows; chains and cycles are followed for sixteen steps all the same."""
    from parchment.operators.references import style_chain

    rows = [(i, i - 1 if i % 20 else None, i % 20 == 1, "f" if i % 20 == 3 else None, i) for i in range(60)] + [(100, 101, False, None, None), (101, 100, True, "g", None)]
    key = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        found = {r.style: r for r in style_chain(spark.createDataFrame(rows, "style int, based_on int, bold boolean, font string, size int")).collect()}
    finally:
        spark.conf.set(key, was)
    assert len(found) == 62
    assert (found[20].hops, found[20].bold, found[20].font, found[20].size) == (1, False, None, 20)
    assert (found[25].hops, found[25].bold, found[25].font, found[25].size) == (6, True, "f", 25)
    assert (found[59].hops, found[59].bold, found[59].font) == (16, False, None)
    assert (found[100].hops, found[100].bold, found[100].font, found[100].size) == (16, True, "g", None)


def test_packages_are_dealt_over_all_cores(spark, tmp_path):
    """Packing, reading parts and importing take a core much longer than reading, so a table in one file is dealt out, and once."""
    from pyspark.sql import functions as F

    from parchment.sources import ooxml as O
    from parchment.sources.docx import imported_docx

    rows = spark.range(0, 60_000, 1, 1).select("id", F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(i)), 256) for i in range(2)]).alias("text"))
    rows.write.parquet(str(tmp_path / "t"))
    made = O.zipped(spark.read.parquet(str(tmp_path / "t")), {"word/document.xml": O.document(F.col("text"))}, "id")
    for found in (made, O.parts_of(made), imported_docx(made)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition ") == 1
    made.limit(50).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert imported_docx(spark.read.parquet(str(tmp_path / "p"))).count() == 50


@pytest.mark.parametrize("name, most", [("jn9_moved_quotes", 7), ("cm17_relocated_layer", 6), ("cm15_commits", 1), ("cm15_annotations", 1)])
def test_listings_are_made_once(spark, name, most):
    """A listing of blocks that several joins read is written, so that its own join and texts are not repeated in the plan for each of them."""
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Join") <= most and "collect_list" not in plan


def test_verification_is_not_one_plan(spark):
    """The driver's memory grows with the stages of a plan, so each step of verification is written by itself and few joins stand in one plan."""
    plan = registry.queries()["se4_issue_union"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Join") < 4
