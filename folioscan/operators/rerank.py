"""Reranking with a caller-supplied scorer, and what is logged about it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioscan.functions.windows import by_query
from folioscan.operators.lexical import tokens

#: scores a batch of (query text, chunk text) pairs
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Share of the distinct query tokens that occur in the text."""
    q = F.array_distinct(tokens(query))
    both = F.size(F.array_intersect(q, tokens(text)))
    return F.when(F.size(q) > 0, F.round(both / F.size(q), 6)).otherwise(0.0)


def rerank(
    hits: DataFrame,
    queries: DataFrame | None = None,
    *,
    top_n: int | Column = 3,
    scorer: Scorer | str | None = "overlap",
    query_text: str = "query_text",
) -> DataFrame:
    """Score every (query, text) pair and keep the best ``top_n`` per query.

    ``scorer`` is a function on Arrow batches (a model is loaded once per
    Python worker), ``"overlap"`` for the built-in lexical score, or ``None``:
    then the first ``top_n`` hits stay, with null score and rank.  Ties keep
    the old order.  The query text is joined on ``query_id`` unless the hits
    carry it already.
    """
    top = F.lit(max(1, top_n)) if isinstance(top_n, int) else F.greatest(top_n, F.lit(1))
    rows = hits
    if query_text not in hits.columns and scorer is not None:
        rows = hits.join(queries.select("query_id", query_text), "query_id")
    if scorer is None:
        return rows.where(F.col("rank") <= top).select(
            "*",
            F.lit(None).cast("double").alias("rerank_score"),
            F.lit(None).cast("int").alias("rerank_rank"),
        )
    if scorer == "overlap":
        scored = rows.withColumn("rerank_score", overlap_score(query_text, "text"))
    else:
        scored = _score_batches(rows, scorer, query_text)
    order = by_query().orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(
        F.col("rerank_rank") <= top
    )


def _score_batches(rows: DataFrame, scorer: Scorer, query_text: str) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(rerank_score=scorer(b[query_text], b["text"]).astype("float64"))

    return rows.mapInPandas(run, schema)


def sync_rerank(final: DataFrame, reranked: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Carry rerank score and rank onto the final hits and tag reserved anchors.

    ``anchors(query_id, chunk_id, topic)``; of several topics with one anchor
    the last in ``topic_pos`` order names it.
    """
    known = (
        reranked.where(F.col("rerank_score").isNotNull() | F.col("rerank_rank").isNotNull())
        .groupBy("query_id", "chunk_id")
        .agg(F.max("rerank_score").alias("_rs"), F.min("rerank_rank").alias("_rr"))
    )
    out = final.join(known, ["query_id", "chunk_id"], "left")
    for own, new in (("rerank_score", "_rs"), ("rerank_rank", "_rr")):
        old = F.col(own) if own in final.columns else F.lit(None)
        out = out.withColumn(own, F.coalesce(F.col(new), old))
    out = out.drop("_rs", "_rr")
    if anchors is None:
        tagged = out.withColumn("reserved_topic", F.lit(None).cast("string"))
    else:
        names = anchors.groupBy("query_id", "chunk_id").agg(
            F.max_by("topic", "topic_pos").alias("reserved_topic")
        )
        tagged = out.join(names, ["query_id", "chunk_id"], "left")
    return tagged.withColumn(
        "is_reserved_anchor", F.col("reserved_topic").isNotNull()
    ).withColumn("anchor_label", F.concat(F.lit("anchor:"), F.col("reserved_topic")))


def rerank_record(
    *,
    enabled: Column,
    in_scope: Column,
    applied: Column,
    candidates: Column,
    top_n_base: Column,
    top_n: Column,
    model: Column,
    error: Column,
    anchors: Column,
) -> Column:
    """Log struct with one shape for off, bypassed, failed and applied paths."""
    active = enabled & in_scope
    reason = (
        F.when(~enabled, "disabled_in_config")
        .when(~in_scope, "bypass_path")
        .when(~applied & error.isNull(), "not_attempted")
    )
    return F.struct(
        F.coalesce(active & applied, F.lit(False)).alias("applied"),
        F.when(active, candidates).otherwise(0).alias("candidate_count"),
        F.when(active, top_n).alias("top_n"),
        F.when(active, top_n_base).alias("top_n_base"),
        F.when(active, top_n).alias("top_n_effective"),
        F.struct(
            model.alias("model_name"),
            F.coalesce(active & error.isNotNull(), F.lit(False)).alias("load_failed"),
            F.when(active, error).alias("error_msg"),
            reason.alias("disabled_reason"),
        ).alias("info"),
        F.when(active & applied, anchors).alias("anchor_reservation"),
    )
