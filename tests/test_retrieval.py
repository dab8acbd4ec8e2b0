"""Ranking, fusion and filters against small expectations and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscan.operators import aggregation, coverage, dense, filters, fusion, lexical, rerank
from folioscan.rules import INDONESIAN as R
from folioscan.settings import Bm25Settings

DOCS = ["rumah besar rumah", "besar sekali", "jalan raya besar", "kebun kota", "", "kota rumah jalan"]


def chunks(spark, texts=DOCS):
    return spark.createDataFrame(
        [(i, i, "all", t) for i, t in enumerate(texts)], "chunk_id int, ord int, stream string, text string"
    )


def okapi(texts, query, k1=1.5, b=0.75):
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return [
        round(sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg))
                  for w in query.split()), 6)
        for t in toks
    ]


@pytest.mark.parametrize("parts", [1, 3])
def test_bm25_matches_formula(spark, parts):
    df = chunks(spark).repartition(parts)
    q = spark.createDataFrame([("q", "rumah besar rumah")], "query_id string, text string")
    hits = lexical.bm25_topk(lexical.build_bm25_index(df), q, k=6, fill_zero=True, chunks=df)
    want = okapi(DOCS, "rumah besar rumah")
    order = sorted(range(len(DOCS)), key=lambda i: (-want[i], i))
    assert [(r.chunk_id, r.score) for r in hits.orderBy("rank").collect()] == [(i, want[i]) for i in order]


def test_bm25_in_blocks_and_stored(spark, tmp_path):
    df = chunks(spark)
    q = spark.createDataFrame([(i, t or "kota") for i, t in enumerate(DOCS)], "query_id int, text string")
    settings = Bm25Settings(idf="plus1")
    index = lexical.build_bm25_index(df, settings=settings)
    whole = lexical.bm25_topk(index, q, k=3, settings=settings)
    lexical.save_bm25_index(index, str(tmp_path))
    stored = lexical.load_bm25_index(spark, str(tmp_path), stream="all")
    blocks = lexical.bm25_topk(stored, q, k=3, settings=settings, max_broadcast_terms=2)
    key = lambda r: (r.query_id, r.rank, r.chunk_id, r.score)
    assert sorted(map(key, whole.collect())) == sorted(map(key, blocks.collect()))


def test_tokens_keep_accents_and_stem(spark):
    df = spark.createDataFrame([("Été-déjà, a_b! 12",)], "text string")
    stem = lambda s: s.map(lambda ts: [t[:3] for t in ts])
    row = df.select(lexical.tokens("text").alias("a"), lexical.tokens("text", stem).alias("b")).first()
    assert row.a == ["été", "déjà", "a_b", "12"] and row.b == ["été", "déj", "a_b", "12"]


@pytest.mark.parametrize("block", [2, 1000])
def test_dense_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[30:45] = v[10]  # copies: a quarter of the rows tie
    rows = [(i, i, 2000 + i % 3, v[i].tolist()) for i in range(60)]
    vec = spark.createDataFrame(rows, "chunk_id int, ord int, year int, embedding array<double>").repartition(7)
    qs = [(i, v[i * 5].tolist(), (2001 if i % 2 else None)) for i in range(6)]
    q = spark.createDataFrame(qs, "query_id int, embedding array<double>, f_year int")
    got = {}
    for r in dense.dense_topk(vec, q, k=9, max_query_rows=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i, e, y in qs:
        d = np.round(((v - np.array(e)) ** 2).sum(1), 6)
        pool = [j for j in range(60) if y is None or 2000 + j % 3 == y]
        assert got[i] == sorted(pool, key=lambda j: (d[j], j))[:9]


def test_cells_with_all_probes_are_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 4))
    vec = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "chunk_id int, ord int, embedding array<double>")
    q = vec.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "embedding")
    centres = dense.train_cells(vec, n_cells=3)
    a = dense.dense_topk(vec, q, k=5).select("query_id", "rank", "chunk_id")
    b = dense.dense_topk_cells(vec, q, centres, k=5, n_probe=3).select("query_id", "rank", "chunk_id")
    assert sorted(a.collect()) == sorted(b.collect())


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, doc_id string, score double")


def test_rrf_order(spark):
    d = hits(spark, [(1, 1, "a", "x", 0.1), (1, 2, "b", "x", 0.2)])
    s = hits(spark, [(1, 1, "b", "x", 9.0), (1, 2, "c", "x", 8.0)])
    got = fusion.rrf(d, s, carry=("doc_id",)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert got[1].rank_sparse is None and got[2].score_dense is None


def test_diversify(spark):
    h = hits(spark, [(1, 1, "a", "x", 0.0), (1, 2, "b", "x", 0.0), (1, 3, "c", "x", 0.0), (1, 4, "d", "y", 0.0)])
    assert [r.chunk_id for r in fusion.diversify(h, top_k=3).orderBy("rank").collect()] == ["a", "d", "b"]


def test_citation_merge_floor(spark):
    n = hits(spark, [(1, i, f"n{i}", "x", i / 10) for i in range(1, 11)])
    c = hits(spark, [(1, i, f"s{i}", "y", i / 10) for i in range(1, 8)])
    got = [r.chunk_id for r in fusion.citation_merge(n, c, pool=10, higher_is_better=False).collect()]
    assert sum(x[0] == "n" for x in got) == 6 and sum(x[0] == "s" for x in got) == 4


def test_pick_by_ids_prefers_rerank_payload(spark):
    a = hits(spark, [(1, 1, "a", "x", 1.0), (1, 2, "b", "x", 1.0)]).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rerank_rank", F.lit(None).cast("int"))
    b = a.withColumn("rerank_score", F.lit(0.5)).where("chunk_id = 'b'")
    wanted = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, chunk_id string, pos int")
    got = fusion.pick_by_ids(wanted, a, b).orderBy("rank").collect()
    assert [(r.chunk_id, r.rerank_score) for r in got] == [("b", 0.5), ("a", None)]


def test_rerank_paths(spark):
    h = hits(spark, [(1, 1, "a", "x", 0.0), (1, 2, "b", "x", 0.0)]).withColumn(
        "text", F.when(F.col("chunk_id") == "b", "kata kunci").otherwise("lain")
    )
    q = spark.createDataFrame([(1, "kata kunci")], "query_id int, query_text string")
    assert [r.chunk_id for r in rerank.rerank(h, q, top_n=1).collect()] == ["b"]
    by_len = lambda a, b: pd.Series([float(len(x)) for x in b])
    assert [r.chunk_id for r in rerank.rerank(h, q, top_n=2, scorer=by_len).orderBy("rerank_rank").collect()] == ["b", "a"]
    skipped = rerank.rerank(h, top_n=1, scorer=None).collect()
    assert [(r.chunk_id, r.rerank_rank) for r in skipped] == [("a", None)]


def test_filter_fields_and_json(spark):
    rows = [(1, "x", '```json\n{"tahun": "2023.0", "prodi": "Informatika", "penulis": "Budi"}\n```'), (2, "x", "tidak ada")]
    df = spark.createDataFrame(rows, "query_id int, text string, raw string")
    got = {r.query_id: r for r in filters.limit_fields(filters.fields_from_json(df, "raw", R)).collect()}
    assert (got[1].f_year, got[1].f_program, got[1].f_author) == (2023, "Informatika", None)
    assert got[1].filter_fields_used == ["year", "program"] and not got[2].filter_applied


def test_strict_focus_may_be_empty(spark):
    h = hits(spark, [(1, 1, "a", "doc_x", 0.0)]).withColumn("source_file", F.lit("doc_x.pdf"))
    none = h.withColumn("allowed_docs", F.array(F.lit("other")))
    assert filters.apply_doc_focus(none, strict=True).count() == 0
    assert filters.apply_doc_focus(none, min_keep=1).first().focus_reason == "too_few_kept_fallback"


def test_greedy_coverage_uses_a_hit_once(spark):
    rows = [
        (1, 1, "a", "umum", "metode rad dan metode prototyping"),
        (1, 2, "b", "umum", "metode rad"),
        (1, 3, "c", "umum", "lain"),
        (1, 4, "d", "lain", "lain"),
    ]
    h = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, doc_id string, text string").withColumn(
        "targets", F.array(F.lit("PROTOTYPING"), F.lit("RAD"))
    )
    got = coverage.select_with_coverage(h, R, top_k=4, max_per_doc=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.pick_for) for r in got] == [("a", "PROTOTYPING"), ("b", "RAD"), ("d", None)]


def test_comparison_prefers_unused_contexts(spark):
    rows = [(1, 1, "rad prototyping", "BAB_I"), (1, 2, "prototyping saja", "BAB_I"), (1, 3, "rad", "BAB_II")]
    c = spark.createDataFrame(rows, "query_id int, ctx int, text string, label string").withColumn(
        "targets", F.array(F.lit("RAD"), F.lit("PROTOTYPING"))
    )
    chosen = aggregation.comparison_contexts(c, R)
    got = {(r.topic, r.pos): (r.ctx, r.strong) for r in chosen.collect()}
    assert got == {("RAD", 1): (1, True), ("RAD", 2): (3, False), ("PROTOTYPING", 1): (2, True), ("PROTOTYPING", 2): (1, True)}
    q = c.groupBy("query_id").agg(F.first("targets").alias("targets"))
    status = aggregation.comparison_status(chosen, q).first()
    assert status.comparison_status == "balanced_comparison" and status.shared_ctx == [1]


def test_stored_index_keeps_its_partitioning(spark, tmp_path):
    """Scores of (chunk, query) pairs are summed where the postings lie; only folders of the terms are read."""
    index = lexical.build_bm25_index(chunks(spark))
    lexical.save_bm25_index(index, str(tmp_path), buckets=3)
    stored = lexical.load_bm25_index(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "rumah kota")], "query_id int, text string")
    hits = lexical.bm25_topk(stored, q, k=2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(chunk_id" not in plan
    assert "PartitionFilters" in plan and "term_part" in plan.split("PartitionFilters", 1)[1][:200]
    name = lexical._table_name(f"{tmp_path}/plain", "postings")
    want = sorted(map(tuple, hits.collect()))
    spark.sql(f"DROP TABLE {name}")  # as a new session finds it
    again = lexical.bm25_topk(lexical.load_bm25_index(spark, str(tmp_path)), q, k=2)
    assert sorted(map(tuple, again.collect())) == want and want


def test_search_inside_a_document(spark):
    texts = DOCS * 3
    df = chunks(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.col("chunk_id") % 4))
    asked = [("a", "d1", "rumah besar"), ("b", "d2", "kota besar"), ("c", "none", "kota"), ("d", None, "kota")]
    q = spark.createDataFrame(asked, "query_id string, f_doc string, text string")
    hits = lexical.bm25_topk(lexical.build_bm25_index(df), q, k=3, docs=df)
    want = []
    for name, doc, text in asked:
        scores = okapi(texts, text)
        own = [i for i in range(len(texts)) if f"d{i % 4}" == doc and set(text.split()) & set(texts[i].split())]
        own.sort(key=lambda i: (-scores[i], i))
        want += [(name, n, i, scores[i]) for n, i in enumerate(own[:3], 1)]
    assert sorted(map(tuple, hits.select("query_id", "rank", "chunk_id", "score").collect())) == sorted(want)


@pytest.mark.parametrize("rows", [3, 1000])
def test_dense_search_in_groups_and_documents(spark, rows):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(80, 4))
    vec = spark.createDataFrame([(2**60 + i, i, f"d{i % 3}", x.tolist()) for i, x in enumerate(v)], "chunk_id long, ord int, doc_id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", v[i].tolist(), f"d{i % 4}") for i in range(10)], "query_id string, embedding array<double>, f_doc string")
    d = np.round(((v[:10, None] - v[None]) ** 2).sum(-1), 6)
    for inside in (False, True):
        asked = q if inside else q.drop("f_doc")
        got = dense.dense_topk(vec.repartition(5), asked, k=4, max_query_rows=rows, keep=("doc_id",))
        want = []
        for i in range(10):
            own = [j for j in range(80) if not inside or j % 3 == i % 4]
            own.sort(key=lambda j: (d[i, j], j))
            want += [(f"q{i}", n, 2**60 + j, f"d{j % 3}") for n, j in enumerate(own[:4], 1)]
        assert sorted(map(tuple, got.select("query_id", "rank", "chunk_id", "doc_id").collect())) == sorted(want)
    assert dense.dense_topk(vec.limit(0), q, k=2).count() == 0 and dense.dense_topk(vec, q.limit(0), k=2).count() == 0


def test_precheck_equals_brute_force(spark):
    import itertools
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(0, 6)))
    values = [(rng.choice([None, 2001, 2002]), rng.choice([None, word()]), rng.choice([None, word()])) for _ in range(30)]
    filters_ = list(itertools.product([None, 2001, 2003], [None, "", "a", "ab", "abab", word()], [None, "b", "ba ", word()]))
    q = spark.createDataFrame([(i, *f) for i, f in enumerate(filters_)], "query_id int, f_year int, f_program string, f_author string")
    c = spark.createDataFrame(values, "year int, program string, author string")
    out = filters.precheck(filters.limit_fields(q, 3), c)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["query_id"]: (r["filter_applied"], r["fallback_reason"]) for r in out.collect()}
    for i, (y, p, a) in enumerate(filters_):
        asked = any(x is not None for x in (y, p, a))
        found = any((y is None or v[0] == y) and (p is None or (v[1] is not None and p in v[1])) and (a is None or (v[2] is not None and a in v[2])) for v in values)
        assert got[i] == (asked and found, "precheck_no_results" if asked and not found else None), (y, p, a)
