"""Tables in the shared folder, and rules that the given tables do not reach."""

import pytest
from pyspark.sql import functions as F

from parchment import store
from parchment.functions import text as X
from parchment.operators import tables as T
from parchment.operators import validate as V
from parchment.operators.annotations import quoted
from parchment.streaming import jobs as J


def test_tables_are_written_replaced_and_deleted(spark, tmp_path):
    made = store.materialise(spark.range(10))
    assert made.count() == 10
    store.discard(made)
    with pytest.raises(Exception, match="(?i)path|exist"):
        made.count()
    path = str(tmp_path / "t")
    for n in (3, 5):
        assert store.replace(spark.range(n), path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_only_small_tables_of_few_files_are_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 512).alias("text"))
    wide.coalesce(1).write.parquet(str(tmp_path / "one"))
    wide.repartition(cores).write.parquet(str(tmp_path / "many"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "tiny"))
    plan = lambda name: store.spread(spark.read.parquet(str(tmp_path / name)))._jdf.queryExecution().toString()
    assert "Repartition" in plan("one")
    assert "Repartition" not in plan("many") and "Repartition" not in plan("tiny")
    assert store.spread(spark.read.parquet(str(tmp_path / "one"))).count() == 60_000


def test_wide_cells_have_no_cap(spark):
    schema = "t int, seq int, row int, col int, row_span int, col_span int, n_cols int, n_rows int"
    cells = [(1, 0, 0, 0, 1, 100, 70, 2), (1, 1, 0, 65, 1, 1, 70, 2), (2, 0, 0, 0, 10**9, 10**9, 3, 3), (2, 1, 2, 2, 1, 1, 3, 3), (3, 0, 0, 0, 1, 70, 70, 1), (4, 0, 0, 0, 1, 2, 3, 2), (4, 1, 1, 0, 1, 3, 3, 2)]
    found = V.grid_issues(spark.createDataFrame(cells, schema), ("t",)).collect()
    assert sorted((r.t, r.seq, r.issue) for r in found) == [
        (1, 0, "cell_beyond_columns"), (1, 1, "cell_overlap"), (2, 0, "cell_beyond_columns"), (2, 0, "cell_beyond_rows"), (2, 1, "cell_overlap"),
    ]


def test_passages_of_any_length(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "xa b c dx"), (3, "b"), (4, None), (5, "a  c d")], "doc_id int, text string")
    passages = [(10, "a b c d"), (11, "b"), (12, "c d"), (13, ""), (14, "b c d"), (15, "zz"), (16, "a  c")]
    found = quoted(texts, spark.createDataFrame(passages, "item_id int, passage string")).collect()
    truth = {(r.doc_id, i) for r in texts.collect() if r.text for i, p in passages if p and p in r.text}
    assert {(r.doc_id, r.item_id) for r in found} == truth and len(found) == len(truth)


def test_formats_keep_other_members(spark):
    rows = [(1, '{"n":1,"format":{"a":"x","k":2},"o":{"p":[1]}}'), (2, None), (3, '{"q":true}')]
    spans = spark.createDataFrame(rows, "id int, extra string")
    at = lambda df, p: {r.id: r[1] for r in df.select("id", F.get_json_object("extra", p)).collect()}
    made = T.set_format(spans, "a", 'y"z')
    assert at(made, "$.format.a") == {1: 'y"z', 2: 'y"z', 3: 'y"z'} and at(made, "$.format.k")[1] == "2" and at(made, "$.o.p[0]")[1] == "1" and at(made, "$.q")[3] == "true"
    assert at(T.set_format(made, "a", None), "$.format.a") == {1: None, 2: None, 3: None}


def test_events_of_a_key_over_several_batches():
    import pandas as pd

    parts = [pd.DataFrame({"event_id": [5, 1], "event": ["b", "a"]}), pd.DataFrame({"event_id": [3], "event": ["c"]})]
    assert [r.event_id for r in J._in_order(iter(parts))] == [1, 3, 5] and list(J._in_order(iter([]))) == []


def test_json_members(spark):
    t = spark.createDataFrame([('{"a/b":{"~c":[7]},"x":1}',), (None,), ("{}",)], "v string")
    assert [r[0] for r in t.select(X.json_pointer(F.col("v"), "/a~1b/~0c/0")).collect()] == ["7", None, None]
    assert [r[0] for r in t.select(X.unknown_members(F.col("v"), ("x",))).collect()] == ['{"a/b":{"~c":[7]}}', None, None]
