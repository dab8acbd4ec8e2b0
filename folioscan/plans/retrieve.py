"""A whole query table through the retrieval stages, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscan.functions import intent
from folioscan.functions.topics import topics_in
from folioscan.operators import coverage, dense, filters, fusion, lexical, rerank
from folioscan.rules import INDONESIAN, RuleSet
from folioscan.session import cut_lineage
from folioscan.settings import Bm25Settings, RetrievalSettings

CARRY = ("doc_id", "stream", "label")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    index: lexical.Bm25Index,
    *,
    rules: RuleSet = INDONESIAN,
    settings: RetrievalSettings = RetrievalSettings(),
    bm25: Bm25Settings = Bm25Settings(),
    scorer: rerank.Scorer | str | None = "overlap",
    filter_sparse: bool = False,
) -> DataFrame:
    """Final hits of ``queries(query_id, text, embedding)``.

    Metadata split and pre-check, dense and lexical search on the narrative
    stream, fusion, citation merge where the question asks for references,
    coverage of the target topics, reranking, anchor reservation.  ``chunks``
    carries ``chunk_id, ord, doc_id, source_file, stream, label, year, program,
    author, text, embedding``.  The metadata filter holds for the dense leg;
    ``filter_sparse`` also drops lexical hits that fail it.
    """
    split = filters.precheck(filters.limit_fields(filters.split_query(queries, rules)), chunks)
    q = cut_lineage(
        split.withColumn("is_citation", fusion.is_citation_query("text", rules)).withColumn(
            "targets", topics_in("text", rules)
        )
    )
    pool = intent.candidate_pool_size(
        settings.top_k, candidate_k=settings.rerank_pool, base=settings.rerank_top_n,
        complex_=settings.rerank_top_n_complex, scorer=scorer is not None,
    )
    searched = q.select(
        "query_id", "embedding", "f_year", "f_program", "f_author",
        F.col("semantic_query").alias("text"),
    )
    fused = _hybrid(searched, chunks, index, "narasi", pool, settings, bm25, filter_sparse)
    cite = _hybrid(
        searched.join(q.where("is_citation").select("query_id"), "query_id", "left_semi")
        .drop("f_year", "f_program", "f_author"),
        chunks, index, "sitasi", max(3, pool // 2), settings, bm25, False,
    )
    merged = fusion.citation_merge(fused, cite, pool=pool, higher_is_better=True)
    texts = chunks.select("chunk_id", "source_file", "text")
    hits = merged.join(texts, "chunk_id").join(
        q.select("query_id", "targets", F.col("text").alias("query_text")), "query_id"
    )
    steps = intent.is_steps_question("query_text", rules)
    multi = intent.is_multi_target("query_text", rules)
    chosen = cut_lineage(
        coverage.select_with_coverage(
            hits, rules, top_k=pool, max_per_doc=settings.max_per_doc
        )
    )
    top = intent.rerank_size(
        multi_target=multi, steps=steps, topics=F.col("targets"), base=settings.rerank_top_n,
        complex_=settings.rerank_top_n_complex, scorer=scorer is not None,
    )
    best = rerank.rerank(chosen, top_n=top, scorer=scorer)
    if scorer is None:
        return best
    detail = coverage.coverage_detail(chosen, q, rules)
    anchors = coverage.best_anchors(chosen, detail, rules, prefer_steps=steps)
    sizes = chosen.groupBy("query_id").agg(F.first(top).alias("_k"))
    final = coverage.reserve_anchors(
        best, chosen, anchors, final_k=settings.rerank_top_n_complex
    ).join(sizes, "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
    payload = chosen.drop("rank")
    synced = rerank.sync_rerank(
        final.drop("reserved_topic"), best,
        anchors.select("query_id", "chunk_id", "topic", "topic_pos"),
    )
    return synced.join(payload, ["query_id", "chunk_id"])


def _hybrid(queries, chunks, index, stream, pool, settings, bm25, filter_sparse) -> DataFrame:
    part = chunks.where(F.col("stream") == stream)
    d = dense.dense_topk(part, queries, k=pool, keep=CARRY)
    one = lexical.Bm25Index(*[t.where(F.col("stream") == stream)
                              for t in (index.postings, index.terms, index.stats)])
    s = lexical.bm25_topk(one, queries, k=pool, settings=bm25)
    s = s.join(part.select("chunk_id", "doc_id", "label", "year", "program", "author"), "chunk_id")
    if filter_sparse:
        s = s.join(queries.select("query_id", "f_year", "f_program", "f_author"), "query_id").where(
            filters.row_passes()
        )
    return fusion.rrf(d, s, k=settings.rrf_k, top_k=pool, carry=CARRY)
