import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscan.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows, share=1.5, cap=2.0, weights=(3, 1, 2)):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > cap * sizes[s]}
        if not full:
            out.update({s: unit * w[s] for s in open_})
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return sizes, out


def test_targets_sums_and_reruns(docs, clashing, rows, no_docs, result):
    sizes, want = brute_targets(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_source = {(sizes[s], round(t, 6)) for s, t in want.items()}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == by_source
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    again = result(mixing.mix(docs.repartition(7)))
    assert again == result(mixing.mix(docs))
    assert result(mixing.mix(clashing)) == again
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    largest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in sizes}
    for s, target in want.items():
        taken = sum(r["taken"] for r in got if (r["source_size"], round(r["target"], 6)) == (sizes[s], round(target, 6)))
        assert abs(taken - target) <= largest[s]


def test_close_to_target_over_several_levels(spark):
    rows = [(i, "w " * (1 + i * 31 % 50), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes, want = brute_targets(rows)
    got = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 50
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_document_is_taken_as_often_as_it_should(spark):
    """Over many mixes with other ids, documents of every size are taken in the same share."""
    rows = [(1000 * k + i, "w " * (1 + i), "en", f"x{i % 2}", 1) for k in range(60) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, weights=(1, 3)).where("target < source_size").collect()
    small = [r["taken"] / r["size"] for r in got if r["size"] <= 14]
    large = [r["taken"] / r["size"] for r in got if r["size"] > 28]
    rate = got[0]["target"] / got[0]["source_size"]
    assert sum(small) / len(small) == pytest.approx(rate, abs=0.08)
    assert sum(large) / len(large) == pytest.approx(rate, abs=0.08)


def test_mixed_documents_repeat_rows(docs, clashing):
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +want
    assert mixing.mixed_documents(clashing).columns == clashing.columns


def test_many_equal_rows(spark, monkeypatch):
    """A third of the table repeats one row; it spreads over buckets and tasks."""
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = [(7, "a b c", "en", "s", 5)] * 400 + [(100 + i, "w " * (1 + i % 9), "en", "s", 1) for i in range(800)]
    rows += [(7, "a b c", "en", "s", 6)] * 3 + [(None, None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.copies(df, share=0.6).collect()
    assert len(got) == len(rows) and len({r["h"] for r in got if r["doc_id"] == 7}) == 403
    sizes, want = brute_targets(rows, share=0.6)
    taken = sum(r["size"] * r["copies"] for r in got if r["source_size"] == sizes["s"])
    assert abs(taken - want["s"]) <= 9
    seven = sum(r["copies"] for r in got if r["doc_id"] == 7)
    assert 0.4 * 403 < seven < 0.8 * 403
    out = Counter(tuple(r) for r in mixing.mixed_documents(df, share=0.6).collect())
    again = Counter(tuple(r) for r in mixing.mixed_documents(df.repartition(5), share=0.6).collect())
    assert out == again
    assert sum(n for r, n in out.items() if r[0] == 7) == seven
    per_row = Counter()
    for r in got:
        per_row[r["doc_id"]] += r["copies"]
    assert Counter({k: sum(n for r, n in out.items() if r[0] == k) for k in per_row if k != 7}) == Counter(
        {k: n for k, n in per_row.items() if k != 7}
    )
