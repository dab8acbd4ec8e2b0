import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import quality


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_flat_walk_equals_walk_by_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    model = quality.fit(x, (x[:, 1] + x[:, 2] > 0).astype(float), trees=7, depth=3)
    for row, score in zip(x[:50], model.score(x[:50])):
        raw = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            raw += leaf[at - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([None, "", "!!!", "a" * 100_000, "É É", "one two\none two"]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    assert x[5, quality.FEATURES.index("distinct_words")] == 0.5
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_scores_and_folds(spark, docs, clashing, rows, result):
    bad = [(i, "BUY NOW!! " * 20 + str(i), "en", "a", 1) for i in range(200, 260)]
    more = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    labels = [(r[0], int(not r[1].startswith("BUY")), 0) for r in rows + bad if r[0] is not None and r[1]]
    held = [(i, 1 - q, t) for i, q, t in labels if remainder(i) == 0]  # wrong on purpose: must not be learned
    used = [x for x in labels if remainder(x[0]) != 0]
    table = spark.createDataFrame([*held, *used, (1, None, 0), (None, 1, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(more, table).collect()
    assert len(got) == len(rows) + len(bad)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"]) == 0)
        if r["doc_id"] is not None and 200 <= r["doc_id"] < 260:
            assert r["predicted"] == 0
    kept = quality.accepted(more, table)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in got)
    assert result(quality.classified(clashing, table)) == result(quality.classified(docs, table))


def test_no_labels_and_empty_table(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classified(docs, none).collect()} == {0.5}
    assert quality.classified(no_docs, none).count() == 0


def test_sample_is_bounded_and_repeatable(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    x, y = quality.training_rows(docs, labels, sample_rows=10)
    again, _ = quality.training_rows(docs.repartition(5), labels, sample_rows=10)
    assert len(y) == 10 and (x == again).all()
