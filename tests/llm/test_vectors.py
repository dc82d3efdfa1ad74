"""Operators on vectors against brute force, and the cases they must survive."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, class string, n int"


def rows():
    r = np.random.default_rng(3)
    out = []
    centre = r.normal(size=16)
    for i in range(700):
        v = centre + 0.04 * r.normal(size=16) if i % 7 == 0 else r.normal(size=16)
        out.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    same = out[7][1]
    out += [(2000 + i, same, 7 % 3) for i in range(40)]  # exact copies
    out += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [math.nan] + [1.0] * 15, 1), (3003, [math.inf] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1), (3005, [], 1), (3006, same, None)]
    out += [(3007, [1.0, 2.0], 1), (3008, [1.0, 2.0], 1), (None, same, 1), (7, same, 1), (3100, [2 * x for x in same], 1)]
    return [(*x, "c", 1) for x in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_vectors(table):
    given = {(i, tuple(v), lab) for i, v, lab, *_ in rows() if usable(v) and lab is not None and i is not None}
    ids = sorted(given, key=lambda x: x[0])
    up = {i: i for i, _, _ in ids}
    links = dict.fromkeys(up, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _ in ids}
    for k, (i, v, a) in enumerate(ids):
        for j, w, b in ids[k + 1 :]:
            if a == b and len(v) == len(w) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    found = embedding_dedup.near_vectors(table).collect()
    assert len(found) == len(rows())
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert r.n_links == links.get(r.vec_id, 0), r
            assert r.component_id == (find(r.vec_id) if r.vec_id in up else r.vec_id)
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    r = np.random.default_rng(1)
    centre = r.normal(size=24)
    data = [(i, [float(x) for x in centre + 0.02 * r.normal(size=24)], 1, "c", 1) for i in range(300)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(data, SCHEMA)).collect()
    v = np.array([np.array(x[1], np.float32).astype(float) for x in data])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    truth = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert {x.vec_id: x.n_links for x in found} == dict(enumerate(truth.tolist()))


def test_loose_group(spark):
    r = np.random.default_rng(5)
    v = (r.normal(size=64) + 0.19 * r.normal(size=(10_000, 64))).astype(np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = unit @ unit.T >= 0.98
    np.fill_diagonal(close, False)
    lowest, before = np.arange(len(v)), None
    while before is None or (lowest != before).any():
        before = lowest
        lowest = np.array([min(own, before[row].min(initial=own)) for own, row in zip(before, close, strict=True)])
    data = [(i, x, 1, "c", 1) for i, x in enumerate(v.tolist())]
    found = {x.vec_id: x for x in embedding_dedup.near_vectors(spark.createDataFrame(data, SCHEMA)).collect()}
    assert [found[i].n_links for i in range(len(v))] == close.sum(axis=1).tolist()
    assert [found[i].component_id for i in range(len(v))] == lowest.tolist()


def test_one_id_under_two_vectors(spark):
    e = np.eye(8).tolist()
    near = [1.0, 0.05, *[0.0] * 6]
    data = [(1, e[0], 1), (1, e[1], 1), (2, near, 1), (3, e[1], 1), (3, e[1], 2), (4, e[2], 2), (5, e[1], 2)]
    found = embedding_dedup.near_vectors(spark.createDataFrame([(*x, "c", 1) for x in data], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 1, 1, False),
    ]


def test_passes_over_a_long_label(spark):
    # a label cut into many runs: pairs well above the threshold are found in some pass, none is counted twice
    r = np.random.default_rng(8)
    base = r.normal(size=(1500, 32))
    v = np.concatenate([base, base[:300] + 0.03 * r.normal(size=(300, 32))]).astype(np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    truth = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    data = [(i, x, 1, "c", 1) for i, x in enumerate(v.tolist())]
    found = embedding_dedup.near_vectors(spark.createDataFrame(data, SCHEMA), longest=64).collect()
    assert embedding_dedup.signs(1800, 64) == 5 and embedding_dedup.passes(5, 0.98) > 5
    assert {x.vec_id: x.n_links for x in found} == dict(enumerate(truth.tolist()))


def brute_nearest(data, q, k):
    own = {i: np.array(v, float) for i, v, *_ in data if i is not None and usable(v)}
    near = sorted((float(np.sqrt(((own[q] - w) ** 2).sum())), i) for i, w in own.items() if i != q and len(w) == len(own[q]))
    return near[:k]


def test_nearest(table):
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    queries = {i for i, v, *_ in rows() if i is not None and i % 100 == 0 and usable(v)}
    assert set(found) == queries
    hit = total = 0
    for q in queries:
        truth = brute_nearest(rows(), q, 10)
        got = [found[q][k] for k in sorted(found[q])]
        assert sorted(found[q]) == list(range(1, len(got) + 1)) and got == sorted(got)
        assert len(got) == len(truth)
        hit += len({i for _, i in got} & {i for _, i in truth})
        total += len(truth)
    assert hit / total >= 0.9


def test_few_candidates_and_none(spark, table):
    data = [(0, [1.0, 0.0], 1, "c", 1), (1, [0.0, 1.0], 1, "c", 1), (2, [0.0, 1.0], 1, "c", 1), (100, [5.0], 1, "c", 1)]
    found = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert found[0].score == pytest.approx(math.sqrt(2))
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(table, F.lit(False)).count() == 0


def test_recall_on_corpus(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = {}
    for r in ann.op7_ann(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    truth = {q: {i for _, i in brute_nearest(data, q, 10)} for q in found}
    assert sum(len(found[q] & truth[q]) for q in truth) / sum(map(len, truth.values())) >= 0.9
