"""Evaluation sets rebuilt from run logs, and metric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import squeeze, strip, text_or_empty
from folioscan.operators.answers import is_not_found

KEY = ["run_id", "turn_id"]
# Metric names and the column names they may come under.
METRICS = {
    "faithfulness": ("faithfulness",),
    "answer_relevancy": ("answer_relevancy", "answer_relevance", "response_relevancy"),
    "context_precision": (
        "context_precision",
        "llm_context_precision_without_reference",
        "context_precision_without_reference",
        "llm_context_precision_with_reference",
        "context_precision_with_reference",
        "non_llm_context_precision_with_reference",
    ),
}


def _none() -> Column:
    return F.array().cast("array<string>")


def clean_ids(ids: Column) -> Column:
    """Chunk ids trimmed, blanks and repeats dropped, order kept."""
    trimmed = F.transform(F.coalesce(ids, _none()), lambda x: strip(text_or_empty(x)))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def keyed(rows: DataFrame) -> DataFrame:
    """Join key in one form: trimmed run id, turn as number (0 when unreadable)."""
    return rows.withColumn("run_id", strip(text_or_empty("run_id"))).withColumn(
        "turn_id", F.coalesce(F.col("turn_id").cast("string").try_cast("bigint"), F.lit(0))
    )


def last_per_key(retrieval: DataFrame, *, order: str = "log_pos") -> DataFrame:
    """The last record of each key wins (a partial aggregation, no sort)."""
    payload = [c for c in retrieval.columns if c not in (*KEY, order)]
    return keyed(retrieval).groupBy(*KEY).agg(
        F.max_by(F.struct(*payload), order).alias("r")
    ).select(*KEY, F.struct(*[F.col(f"r.{c}").alias(c) for c in payload]).alias("retrieval"))


def question_bundle(user: Column, retrieval: Column, legacy: Column) -> Column:
    """Struct ``user, eval, source``: the retrieval query, else the user's
    question, else the old field; equal texts count as the user's."""
    u, r, old = (strip(text_or_empty(c)) for c in (user, retrieval, legacy))
    asked = F.when(u != "", u).otherwise(old)
    same = squeeze(r) == squeeze(asked)
    return F.struct(
        F.when(asked != "", asked).otherwise(r).alias("user"),
        F.when(r != "", r).otherwise(asked).alias("eval"),
        F.when(r != "", F.when((asked != "") & same, "user_query").otherwise("retrieval_query"))
        .when(asked != "", "user_query")
        .otherwise("empty")
        .alias("source"),
    )


def rebuild_contexts(answers: DataFrame, retrieval: DataFrame, chunks: DataFrame) -> DataFrame:
    """Final contexts of each answer, with where they came from.

    Works per answer: answers that share a key keep their own contexts.  Each
    context id looks for its text in the chunk table (first stream wins),
    then in the retrieval record of the same turn; without any, the contexts
    stored on the answer are used.  ``answers`` carries ``used_context_chunk_ids``
    and optionally ``contexts``; ``retrieval`` as :func:`last_per_key`.
    """
    rows = keyed(answers).withColumn("ids", clean_ids(F.col("used_context_chunk_ids")))
    legacy = F.col("contexts") if "contexts" in answers.columns else _none()
    rows = rows.withColumn(
        "_legacy",
        F.filter(F.transform(F.coalesce(legacy, _none()), lambda x: strip(text_or_empty(x))), lambda x: x != ""),
    )
    # answers that cite the same list under the same key share it; every answer row keeps its own list
    cited = rows.select(*KEY, "ids").distinct().select(*KEY, "ids", F.posexplode("ids").alias("pos", "chunk_id"))
    first_stream = F.when(F.col("stream") == "narasi", 0).otherwise(1)
    texts = (
        chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "stream", "text")
        .join(cited.select("chunk_id").distinct(), "chunk_id", "left_semi")
        .where(strip(text_or_empty("text")) != "")
        .groupBy("chunk_id")
        .agg(F.min_by(strip("text"), first_stream).alias("full"))
    )
    previews = (
        retrieval.select(*KEY, F.posexplode("retrieval.retrieved_nodes").alias("n", "node"))
        .select(*KEY, "n", strip(text_or_empty("node.chunk_id")).alias("chunk_id"),
                strip(text_or_empty("node.text")).alias("preview"))
        .where((F.col("chunk_id") != "") & (F.col("preview") != ""))
        .groupBy(*KEY, "chunk_id")
        .agg(F.min_by("preview", "n").alias("preview"))
    )
    found = cited.join(texts, "chunk_id", "left").join(previews, [*KEY, "chunk_id"], "left")
    item = F.struct("pos", F.coalesce("full", "preview").alias("text"), "chunk_id")
    got = F.sort_array(F.collect_list(item))
    per = found.groupBy(*KEY, "ids").agg(
        F.transform(F.filter(got, lambda x: x["text"].isNotNull()), lambda x: x["text"]).alias("_ctx"),
        F.transform(F.filter(got, lambda x: x["text"].isNull()), lambda x: x["chunk_id"]).alias("_missing"),
        F.bool_or(F.col("full").isNotNull()).alias("_full"),
        F.bool_or(F.col("full").isNull() & F.col("preview").isNotNull()).alias("_prev"),
    )
    out = rows.join(retrieval, KEY, "left").join(per, [*KEY, "ids"], "left")
    has = F.size(F.coalesce("_ctx", _none())) > 0
    source = (
        F.when(has & F.col("_full") & F.col("_prev"), "index_plus_retrieval_fallback")
        .when(has & F.col("_full"), "index_full")
        .when(has, "retrieval_join")
        .when(F.size("_legacy") > 0, "answers_fallback")
        .otherwise("none")
    )
    return out.select(
        *[c for c in rows.columns if c not in ("contexts", "_legacy", "used_context_chunk_ids", "ids")],
        "retrieval",
        F.col("ids").alias("used_context_chunk_ids"),
        F.when(has, F.col("_ctx")).otherwise(F.col("_legacy")).alias("contexts"),
        F.coalesce("_missing", _none()).alias("missing_context_chunk_ids"),
        source.alias("context_source"),
    )


def audit_rows(
    rebuilt: DataFrame, *, include_metadata_routes: bool = False, include_not_found: bool = False
) -> DataFrame:
    """Every answer with its question, contexts and include or skip reason."""
    have = set(rebuilt.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    q = question_bundle(field("user_query"), field("retrieval_query"), field("question"))
    rows = rebuilt.withColumn("_q", q).withColumn("_a", strip(text_or_empty("answer")))
    handled = F.coalesce(F.col("metadata_route.handled"), F.lit(False)) if "metadata_route" in have else F.lit(False)
    skip = (
        F.when(handled & F.lit(not include_metadata_routes), "metadata_route_skipped")
        .when(is_not_found("_a") & F.lit(not include_not_found), "global_not_found_skipped")
        .when(F.col("_q.eval") == "", "empty_question")
        .when(F.col("_a") == "", "empty_answer")
        .when(F.size("contexts") == 0, "no_final_contexts")
    )
    verification = F.col("verification") if "verification" in have else None
    return rows.select(
        *KEY,
        F.col("_q.eval").alias("question"),
        F.col("_q.user").alias("question_user"),
        F.col("_q.eval").alias("question_eval"),
        F.col("_q.source").alias("question_source"),
        F.col("_a").alias("answer"),
        "contexts",
        F.size("contexts").alias("context_count"),
        "used_context_chunk_ids",
        "missing_context_chunk_ids",
        "context_source",
        F.exists("contexts", lambda c: F.contains(c, F.lit("...<trimmed>"))).alias(
            "contexts_have_trimmed_preview"
        ),
        skip.isNull().alias("include_in_eval"),
        skip.alias("skip_reason"),
        field("strategy").alias("strategy"),
        F.col("retrieval.retrieval_mode").alias("retrieval_mode"),
        field("generator_status").alias("generator_status"),
        (verification["label"] if verification is not None else F.lit(None).cast("string")).alias("verification_label"),
        (verification["score"] if verification is not None else F.lit(None).cast("double")).alias("verification_score"),
        handled.alias("metadata_route_handled"),
        F.col("retrieval").isNotNull().alias("retrieval_record_found"),
    )


def eval_rows(audit: DataFrame) -> DataFrame:
    """The rows a metric job takes."""
    drop = ("include_in_eval", "skip_reason", "missing_context_chunk_ids", "context_source",
            "contexts_have_trimmed_preview", "metadata_route_handled", "retrieval_record_found")
    return audit.where("include_in_eval").drop(*drop)


def normalize_eval_rows(rows: DataFrame) -> DataFrame:
    """Old and new names of question, answer and contexts side by side."""
    have = set(rows.columns)
    names = [c for c in ("question", "question_eval", "question_user") if c in have]
    q = F.lit(None).cast("string")
    for c in reversed(names):
        q = F.when(text_or_empty(c) != "", F.col(c)).otherwise(q)
    ctx = F.filter(
        F.transform(F.coalesce(F.col("contexts"), _none()), lambda x: strip(text_or_empty(x))),
        lambda x: x != "",
    )
    out = rows.withColumns(
        {"question": strip(text_or_empty(q)), "answer": strip(text_or_empty("answer")), "contexts": ctx}
    )
    return out.withColumns(
        {"user_input": F.col("question"), "response": F.col("answer"), "retrieved_contexts": F.col("contexts")}
    )


def reference_flags(rows: DataFrame) -> DataFrame:
    """One row: do all rows carry a reference answer, and reference contexts?"""
    have = set(rows.columns)
    answers = strip(text_or_empty("reference")) != "" if "reference" in have else F.lit(False)
    contexts = (
        F.exists(F.coalesce(F.col("reference_contexts"), _none()), lambda x: strip(text_or_empty(x)) != "")
        if "reference_contexts" in have
        else F.lit(False)
    )
    return rows.agg(
        F.coalesce(F.bool_and(answers), F.lit(False)).alias("has_reference_answers"),
        F.coalesce(F.bool_and(contexts), F.lit(False)).alias("has_reference_contexts"),
    )


def metric_columns(df: DataFrame) -> dict[str, str]:
    """Logical metric name to the column it comes under."""
    low = {c.lower(): c for c in df.columns}
    out = {}
    for name, names in METRICS.items():
        hit = next((low[a] for a in names if a in low), None)
        if hit is not None:
            out[name] = hit
    return out


def with_metrics(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric values joined on the row key; NaN is missing; adds row status.

    Rows without a metric row stay and have status ``unmatched``.  Several metric rows of
    one key are one row with the means of what they hold (``metric_rows`` of them), so
    that no row is counted twice.
    """
    cols = metric_columns(metrics)
    picked = keyed(metrics).select(
        *KEY,
        *[
            (F.nanvl(F.col(cols[m]).cast("double"), F.lit(None).cast("double"))
             if m in cols else F.lit(None).cast("double")).alias(m)
            for m in METRICS
        ],
    ).groupBy(*KEY).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("metric_rows"))
    missing = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in METRICS]))
    return (
        rows.join(picked, KEY, "left")
        .withColumn("missing_metrics", missing)
        .withColumn(
            "row_status",
            F.when(F.col("metric_rows").isNull(), "unmatched")
            .when(F.size("missing_metrics") > 0, "partial")
            .otherwise("ok"),
        )
    )


def unmatched_metrics(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Keys of metric rows that belong to no row."""
    return keyed(metrics).select(*KEY).join(rows.select(*KEY), KEY, "left_anti")


def metric_summary(rows: DataFrame, *group: str) -> DataFrame:
    """Means over present values, missing counts, rows ok, partial and unmatched."""
    return rows.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in METRICS],
        *[F.count_if(F.col(m).isNull()).alias(f"missing_{m}") for m in METRICS],
        F.count_if(F.col("row_status") == "ok").alias("rows_ok"),
        F.count_if(F.col("row_status") == "partial").alias("rows_partial"),
        F.count_if(F.col("row_status") == "unmatched").alias("rows_unmatched"),
    )
