"""Per-query statistics and context tables over hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import blank_to_null, col, text_or_empty
from folioscan.operators.dense import similarity

# Lower bounds of the rank bands.
RRF_BANDS = (0.025, 0.015)
SIMILARITY_BANDS = (0.70, 0.55)
RERANK_BANDS = (1.5, 0.5)
SPARSE_RANK_BANDS = (3, 6)


def band(value: Column | str, bounds: tuple[float, float]) -> Column:
    v, (high, medium) = col(value), bounds
    return F.when(v >= high, "high").when(v >= medium, "medium").when(v.isNotNull(), "low")


def rank_band(rank: Column | str, bounds: tuple[int, int] = SPARSE_RANK_BANDS) -> Column:
    r, (high, medium) = col(rank), bounds
    return F.when(r <= high, "high").when(r <= medium, "medium").when(r.isNotNull(), "low")


def effective_distance(hits: DataFrame) -> Column:
    """Distance of the dense leg when there is one, else the score."""
    if "score_dense" in hits.columns:
        return F.coalesce("score_dense", "score")
    return F.col("score")


def retrieval_stats(hits: DataFrame) -> DataFrame:
    """One row per query: counts, top five documents, similarity figures."""
    rows = hits.select(
        "query_id",
        "rank",
        F.coalesce(blank_to_null(F.col("doc_id").cast("string")), F.lit("unknown")).alias("doc_id"),
        effective_distance(hits).alias("dist"),
    ).withColumn("sim", similarity("dist"))

    def at(name: str, rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    per_doc = rows.groupBy("query_id", "doc_id").agg(
        F.count("*").alias("n"),
        F.min("rank").alias("first"),
        F.sum("sim").alias("sim"),
        at("sim", 1).alias("sim1"),
        at("sim", 2).alias("sim2"),
        at("dist", 1).alias("dist1"),
    )
    top = F.slice(
        F.sort_array(F.collect_list(F.struct(-F.col("n"), "first", "doc_id", "n"))), 1, 5
    )
    return per_doc.groupBy("query_id").agg(
        F.sum("n").alias("n_hits"),
        F.count("*").alias("n_docs"),
        F.transform(top, lambda d: F.struct(d["doc_id"].alias("doc_id"), d["n"].alias("n"))).alias(
            "doc_counts_top"
        ),
        F.round(F.max("sim1"), 6).alias("sim_top1"),
        F.round(F.sum("sim") / F.sum("n"), 6).alias("sim_avg"),
        F.round(F.max("sim1") - F.max("sim2"), 6).alias("sim_gap12"),
        F.round(F.max("dist1"), 6).alias("dist_top1"),
    )


def context_rows(hits: DataFrame, *, hybrid: bool, order: str = "rank") -> DataFrame:
    """Numbered context table with rounded scores and bands."""
    out = hits.withColumn("ctx", F.concat(F.lit("CTX "), F.col(order)))
    if hybrid:
        out = (
            out.withColumn("score_rrf", F.round("score", 6))
            .withColumn("score_dense", F.round("score_dense", 4))
            .withColumn("score_sparse", F.round("score_sparse", 4))
            .withColumn("rrf_band", band("score_rrf", RRF_BANDS))
            .withColumn("sparse_band", rank_band("rank_sparse"))
        )
    else:
        out = (
            out.withColumn("sim", F.round(similarity("score"), 4))
            .withColumn("dist", F.round("score", 4))
            .withColumn("sim_band", band("sim", SIMILARITY_BANDS))
        )
    if "rerank_score" in hits.columns:
        out = out.withColumn("rerank_band", band("rerank_score", RERANK_BANDS)).withColumn(
            "rerank_score", F.round("rerank_score", 4)
        )
    return out


def source_snapshot(hits: DataFrame, *, hybrid: bool, max_items: int = 6) -> DataFrame:
    """First hits of each query with shortened names and their metrics as text."""
    def number(c: Column, digits: int) -> Column:
        return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))

    def short(c: Column | str, n: int) -> Column:
        t = text_or_empty(c)
        return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)

    parts = []
    if hybrid:
        parts += [
            F.concat(F.lit("rrf="), number(F.col("score"), 5)),
            F.concat(F.lit("bm25="), number(F.col("score_sparse"), 2)),
            F.concat(F.lit("dense="), number(similarity("score_dense"), 3)),
        ]
    else:
        parts.append(F.concat(F.lit("sim="), number(similarity("score"), 4)))
    if "rerank_rank" in hits.columns:
        parts.append(F.concat(F.lit("rk#"), F.col("rerank_rank")))
    if "reserved_topic" in hits.columns:
        parts.append(F.concat(F.lit("anchor="), F.col("reserved_topic")))
    return hits.where(F.col("rank") <= max_items).select(
        "query_id",
        "rank",
        short(F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), 34).alias("doc"),
        short("source_file", 38).alias("file"),
        F.concat_ws(" · ", *parts).alias("metrics"),
    )
