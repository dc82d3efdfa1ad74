"""Queries on logs that the given tables do not hold: long chains, nested ranges, pages of any number of losses."""

import pytest

from parchment.operators import revisions as V
from parchment.plans import registry


def conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_long_chain(spark, tmp_path):
    rows = [(1, t, "user", "x") for t in range(500)] + [(2, t, "user", "x") for t in range(3)] + [(None, 4, "user", "x"), (None, 6, "user", "x")]
    found = registry.queries()["jn18_ancestors"](spark, conversations(spark, tmp_path, rows)).collect()
    assert {(r.doc_id, r.rev, r.depth) for r in found} == {(1, t, 499 - t) for t in range(500)} | {(2, t, 2 - t) for t in range(3)} | {(None, 6, 0), (None, 4, 1)}
    assert len(found) == len(rows)


def test_branches_and_circles(spark):
    schema = "doc_id long, rev long, parent long"
    found = V.ancestors(spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 5, 4)], schema)).collect()
    assert {(r.doc_id, r.rev, r.depth) for r in found} == {(1, 3, 0), (1, 1, 1), (1, 0, 2), (2, 5, 0)}
    assert V.ancestors(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="circle"):
        V.ancestors(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], schema)).collect()


def test_ranges_as_a_stack_pairs_them(spark, tmp_path):
    roles = {1: "uuaa", 2: "auaua", 3: "uauuaauaaau", 4: "suaua", 5: "uaauusaa", 6: "aaa"}
    names, rows, expected = {"u": "user", "a": "assistant", "s": "system"}, [], set()
    for conv, turns in roles.items():
        held = []
        for at, role in enumerate(turns):
            rows.append((conv, at, names[role], "x"))
            if role == "u":
                held.append(at)
            elif role == "a" and held:
                expected.add((conv, held.pop(), at))
    found = registry.queries()["jn13_comment_ranges"](spark, conversations(spark, tmp_path, rows)).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)


def test_report_of_every_page(spark, tmp_path):
    pages = [(1, "<p>x</p>"), (2, "<p>x</p><!-- a -->"), (3, "<script>1</script><p>x</p><style>p {}</style><!-- a --><!-- b -->"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = registry.queries()["cm5_import_pipeline"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, "complete", 0), (2, "partial", 1), (3, "partial", 4), (4, "complete", 0)]


def test_paragraphs_are_counted(spark, tmp_path):
    texts = [(1, "one"), (2, "one\n\ntwo\n\nthree"), (3, "# head\n\none\n\ntwo"), (4, " "), (5, "# head")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["sc9_markdown_import"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1), (2, 3), (3, 2), (5, 0)]
