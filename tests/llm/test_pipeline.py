"""Stages of the pipeline, and their cases."""

from collections import Counter

import corpus_pipeline
from parchment.llm import mixing, near_dedup, unigram
from parchment.llm.common import materialise

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order_and_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "mixing", "sentencepiece"]
    given, columns, sizes = docs, docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = materialise(stage(spark, docs, SMALL))
        assert after.columns == columns
        assert after.join(given, ["doc_id", "text"], "left_anti").count() == 0
        sizes.append(after.count())
        docs = after
        if name == "near_dedup":
            assert near_dedup.near_duplicates(docs).where("not kept").count() == 0
    assert sizes == sorted(sizes, reverse=True)
    mix = materialise(corpus_pipeline.mixed(spark, docs, SMALL))
    expected = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in mix.collect()) == Counter(expected)
    out = corpus_pipeline.encoded(spark, mix, SMALL).collect()
    vocab = unigram.vocabulary().prepare()
    assert Counter(r.doc_id for r in out) == Counter(expected)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(vocab.decode(r.ids) == texts[r.doc_id] for r in out)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "ids"]


def test_extra_columns_with_clashing_names(spark):
    text = "some words that make a sentence of their own here " * 6
    rows = [(i, f"{text} {i}" if i else None, "en", f"s{i % 2}", 0, 1, "a", "b", 2, "c", 3.0, 4) for i in range(6)] + [(1, text, "en", "s1", 0, 1, "z", "b", 2, "c", 3.0, 4)] * 2
    names = "doc_id long, text string, lang string, source string, n_chars long, size int, class string, node string, _h int, found string, score double, __mixed_copy int"
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        assert after.count() <= (2 if name == "mixing" else 1) * len(rows)
    # of rows that repeat an id the one with the largest text stays
    one = {r.doc_id: r["class"] for r in corpus_pipeline.one_of_each_group(spark, docs, SMALL).where("doc_id = 1").collect()}
    assert one in ({}, {1: "a"})
    assert corpus_pipeline.encoded(spark, docs, SMALL).count() == len(rows)


def test_cases(spark):
    text = "some words that make a sentence of their own here " * 6
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, text), (None, text), (5, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()]
    assert Counter(kept) == Counter([1, 3, 4, 5, None, None])
    assert corpus_pipeline.mixed(spark, docs, SMALL).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
        assert set(stage(spark, docs, SMALL).columns) >= {"doc_id"}
