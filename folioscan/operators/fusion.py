"""Fusion, merging, diversification and deduplication of hit tables.

A hit table holds at most a few hundred rows per query (it comes out of a
top-k), so windows by ``query_id`` stay small; the number of queries may be
anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscan.functions.text import blank_to_null, col, matches
from folioscan.functions.windows import by_query
from folioscan.rules import RuleSet


def rrf(
    dense: DataFrame,
    sparse: DataFrame,
    *,
    k: int = 60,
    top_k: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Reciprocal rank fusion of two hit tables (``query_id, chunk_id, rank, score``).

    Score = 1/(k+rank_dense) + 1/(k+rank_sparse); a side without the chunk adds
    nothing.  Ties keep first-seen order: dense ranks before sparse ones.
    ``carry`` columns come from the dense side first.  A union and one
    aggregation replace the full outer join: one exchange instead of two.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        own = f"score_{name}"
        score = F.coalesce(F.col(own), F.col("score")) if own in df.columns else F.col("score")
        extra = [
            (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in carry
        ]
        return df.select("query_id", "chunk_id", F.lit(name).alias("side"), "rank",
                         score.alias("s"), *extra)

    both = side(dense, "dense").unionByName(side(sparse, "sparse"))

    def pick(c: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(c)))

    fused = both.groupBy("query_id", "chunk_id").agg(
        pick("s", "dense").alias("score_dense"),
        pick("s", "sparse").alias("score_sparse"),
        pick("rank", "dense").alias("rank_dense"),
        pick("rank", "sparse").alias("rank_sparse"),
        *[F.coalesce(pick(c, "dense"), pick(c, "sparse")).alias(c) for c in carry],
    )
    score = F.coalesce(1.0 / (F.lit(k) + F.col("rank_dense")), F.lit(0.0)) + F.coalesce(
        1.0 / (F.lit(k) + F.col("rank_sparse")), F.lit(0.0)
    )
    order = by_query().orderBy(
        F.desc("score"), F.asc_nulls_last("rank_dense"), F.asc_nulls_last("rank_sparse")
    )
    return (
        fused.withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
    )


def is_citation_query(c: Column | str, rules: RuleSet) -> Column:
    return matches(F.lower(col(c)), rules.pattern_lists["citation"])


def citation_merge(
    narrative: DataFrame,
    citations: DataFrame,
    *,
    pool: int,
    higher_is_better: bool,
    narrative_share: float = 0.6,
) -> DataFrame:
    """Add bibliography hits to narrative hits under a narrative floor.

    Up to ``max(3, pool/2)`` citation hits not already present, at most
    ``pool - floor(share*pool)`` of them; the narrative list gives way for them
    and the result is sorted by score again (fused scores descending, distances
    ascending).
    """
    take = max(3, pool // 2)
    cap = pool - max(1, int(pool * narrative_share))
    shared = [c for c in narrative.columns if c in citations.columns]
    both = narrative.select(*shared, F.lit(0).alias("side")).unionByName(
        citations.where(F.col("rank") <= take).select(*shared, F.lit(1).alias("side"))
    )
    same = W.partitionBy("query_id", "chunk_id")
    fresh = both.repartition("query_id").withColumn(
        "known", F.min("side").over(same)
    ).where((F.col("side") == 0) | (F.col("known") == 1))
    turn = W.partitionBy("query_id", "side").orderBy("rank")
    placed = fresh.withColumn("pos", F.row_number().over(turn)).where(
        (F.col("side") == 0) | (F.col("pos") <= cap)
    )
    n_new = F.sum("side").over(by_query())
    kept = placed.withColumn("n_new", n_new).where(
        (F.col("side") == 1) | (F.col("pos") <= F.lit(pool) - F.col("n_new"))
    )
    score = F.desc("score") if higher_is_better else F.asc("score")
    return kept.withColumn(
        "rank", F.row_number().over(by_query().orderBy(score, "side", "pos"))
    ).drop("side", "known", "pos", "n_new")


def doc_key(doc_id: Column | str, source_file: Column | str) -> Column:
    """Document of a hit: id, else file, else ``unknown``."""
    return F.coalesce(
        blank_to_null(F.trim(col(doc_id))), blank_to_null(F.trim(col(source_file))), F.lit("unknown")
    )


def candidate_pool(top_k: int, candidate_k: int | None, cap: int) -> int:
    """How many hits to fetch before diversifying."""
    wanted = top_k * 6 if candidate_k is None else candidate_k
    return min(max(wanted, top_k), cap)


def diversify(
    hits: DataFrame, *, top_k: int, max_per_doc: int = 2, doc: str = "doc_id"
) -> DataFrame:
    """Spread hits over documents.

    Pass 1 takes one hit per document, pass 2 up to ``max_per_doc``, pass 3 the
    rest; the output keeps pass order.
    """
    top_k, max_per_doc = max(1, top_k), max(1, max_per_doc)
    in_doc = F.row_number().over(W.partitionBy("query_id", doc).orderBy("rank"))
    turn = F.when(F.col("in_doc") == 1, 1).when(F.col("in_doc") <= max_per_doc, 2).otherwise(3)
    return (
        hits.repartition("query_id")
        .withColumn("in_doc", in_doc)
        .withColumn("turn", turn)
        .withColumn("new_rank", F.row_number().over(by_query().orderBy("turn", "rank")))
        .where(F.col("new_rank") <= top_k)
        .withColumn("rank", F.col("new_rank"))
        .drop("in_doc", "turn", "new_rank")
    )


def dedupe_best(hits: DataFrame, *, higher_is_better: bool) -> DataFrame:
    """One row per (query, chunk) with the best score, ranked by score."""
    score = F.desc("score") if higher_is_better else F.asc("score")
    first = W.partitionBy("query_id", "chunk_id").orderBy(score, "rank")
    return (
        hits.where(F.col("chunk_id").isNotNull() & (F.col("chunk_id").cast("string") != ""))
        .repartition("query_id")
        .withColumn("seen", F.row_number().over(first))
        .where(F.col("seen") == 1)
        .withColumn("rank", F.row_number().over(by_query().orderBy(score, "rank")))
        .drop("seen")
    )


def dedupe_keep_order(hits: DataFrame) -> DataFrame:
    """First occurrence of each chunk; ranks closed up."""
    first = W.partitionBy("query_id", "chunk_id").orderBy("rank")
    return (
        hits.repartition("query_id")
        .withColumn("seen", F.row_number().over(first))
        .where(F.col("seen") == 1)
        .withColumn("rank", F.row_number().over(by_query().orderBy("rank")))
        .drop("seen")
    )


def has_rerank_payload(
    score: Column | str = "rerank_score", rank: Column | str = "rerank_rank",
    reserved: Column | None = None,
) -> Column:
    out = col(score).isNotNull() | col(rank).isNotNull()
    return out if reserved is None else out | F.coalesce(reserved, F.lit(False))


def pick_by_ids(wanted: DataFrame, preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows for ``wanted(query_id, chunk_id, pos)`` in that order.

    A row that carries a rerank score or rank beats one that does not; among
    equals the preferred table, then the lower rank.
    """
    pool = preferred.withColumn("src", F.lit(0)).unionByName(
        fallback.withColumn("src", F.lit(1)), allowMissingColumns=True
    )
    best = W.partitionBy("query_id", "chunk_id").orderBy(
        F.when(has_rerank_payload(), 0).otherwise(1), "src", "rank"
    )
    chosen = pool.withColumn("n", F.row_number().over(best)).where(F.col("n") == 1)
    out = wanted.select("query_id", "chunk_id", "pos").join(
        chosen.drop("n", "src", "rank"), ["query_id", "chunk_id"]
    )
    return out.withColumn(
        "rank", F.row_number().over(by_query().orderBy("pos"))
    ).drop("pos")
