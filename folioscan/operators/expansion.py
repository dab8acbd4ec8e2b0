"""Context expansion inside one document: explanations and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscan.functions.text import strip, text_or_empty
from folioscan.functions.topics import (
    STRONG_STEPS,
    explain_strength,
    has_owner_cue,
    looks_like_artifact,
    looks_like_related_work,
    normal,
    steps_bias_strength,
    steps_strength,
)
from folioscan.functions.windows import by_query
from folioscan.operators.lexical import Bm25Index, bm25_topk
from folioscan.operators.coverage import pick_first, unpicked, with_topic_columns
from folioscan.operators.steps import valid_step_items
from folioscan.rules import RuleSet


def topic_label(topic: Column, rules: RuleSet) -> Column:
    out = topic
    for t in rules.topics:
        out = F.when(topic == t.name, F.lit(t.label)).otherwise(out)
    return out


def template_queries(
    queries: DataFrame, rules: RuleSet, *, kind: str, max_queries: int
) -> DataFrame:
    """Search texts per (query, target topic): ``kind`` is ``explain`` or ``steps``.

    ``queries(query_id, topic, target_doc)``; the target document is the filter
    of the search.
    """
    texts = rules.templates[f"{kind}_queries"][: max(1, max_queries)]
    rows = queries.where(
        F.col("topic").isNotNull() & (F.coalesce(F.col("target_doc").cast("string"), F.lit("")) != "")
    ).select(
        "query_id", "topic", "target_doc",
        F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("n", "template"),
    )
    text = F.replace("template", F.lit("{label}"), topic_label(F.col("topic"), rules))
    return rows.select(
        F.concat_ws("|", "query_id", "n").alias("expansion_id"), "query_id", "n",
        F.col("target_doc").alias("f_doc"), text.alias("text"),
    )


def search_inside(searches: DataFrame, index: Bm25Index, chunks: DataFrame, *, k: int = 3) -> DataFrame:
    """Hits of :func:`template_queries` within their documents, best first for each query.

    ``chunks(chunk_id, doc_id)``.  One row per (query, chunk): the best score of all its
    searches and the first of them (``n``) that found it.
    """
    asked = searches.select(F.col("expansion_id").alias("query_id"), "f_doc", "text")
    hits = bm25_topk(index, asked, k=k, docs=chunks)
    of = searches.select("expansion_id", F.col("query_id").alias("_q"), "n", "f_doc")
    return (
        hits.select(F.col("query_id").alias("expansion_id"), "chunk_id", "ord", "score")
        .join(of, "expansion_id")
        .groupBy(F.col("_q").alias("query_id"), "chunk_id", "ord", F.col("f_doc").alias("doc_id"))
        .agg(F.max("score").alias("score"), F.min("n").alias("n"))
    )


def expansion_pool(base: DataFrame, found: DataFrame, chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """The input of :func:`explanation_expansion` and :func:`steps_expansion`.

    ``base(query_id, chunk_id, ord, score)`` with distances, ``found`` from
    :func:`search_inside`, ``chunks(chunk_id, doc_id, label, text)`` and
    ``targets(query_id, topic, target_doc)``.  A chunk found both ways is a base row;
    others take ``1 / (1 + score)`` as their distance.
    """
    rows = base.select("query_id", "chunk_id", "ord", "score", F.lit(True).alias("in_base")).unionByName(
        found.select("query_id", "chunk_id", "ord", (1 / (1 + F.greatest("score", F.lit(0.0)))).alias("score"),
                     F.lit(False).alias("in_base"))
    )
    once = rows.groupBy("query_id", "chunk_id", "ord").agg(
        F.max_by("score", "in_base").alias("score"), F.max("in_base").alias("in_base")
    )
    return once.join(targets, "query_id").join(chunks.select("chunk_id", "doc_id", "label", "text"), "chunk_id")


def explanation_target_doc(
    *, allowed: Column, accepted: Column, hit_docs: Column, mapped: Column
) -> Column:
    """Lock from the question, else first accepted document, else the only
    document among the hits, else the topic's mapped document."""

    def names(docs: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.array_distinct(
            F.filter(F.transform(F.coalesce(docs, none), strip), lambda d: d != "")
        )

    single = F.when(F.size(names(hit_docs)) == 1, F.get(names(hit_docs), 0))
    return F.coalesce(
        F.get(names(allowed), 0), F.get(names(accepted), 0), single, mapped, F.lit("")
    )


def steps_target_doc(*, allowed: Column, accepted: Column) -> tuple[Column, Column]:
    """Strict form for step questions: (document, how it was resolved)."""
    none = F.array().cast("array<string>")
    lock = F.filter(F.transform(F.coalesce(allowed, none), strip), lambda d: d != "")
    docs = F.array_distinct(
        F.filter(F.transform(F.coalesce(accepted, none), strip), lambda d: d != "")
    )
    status = (
        F.when(F.size(lock) > 0, "resolved_explicit_doc_lock")
        .when(F.size(docs) == 1, "resolved_owner_aggregation")
        .when(F.size(docs) > 1, "ambiguous_owner_docs")
        .otherwise("unresolved_owner_doc")
    )
    doc = F.when(F.size(lock) > 0, F.get(lock, 0)).when(F.size(docs) == 1, F.get(docs, 0))
    return F.coalesce(doc, F.lit("")), status


def _points(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


def _flags(pool: DataFrame, rules: RuleSet) -> DataFrame:
    label = F.upper(text_or_empty("label"))
    forms = with_topic_columns(pool, rules).withColumn("_sq", normal("text"))
    return forms.select(
        "*",
        F.coalesce(F.col("doc_id").cast("string") == F.col("target_doc").cast("string"), F.lit(False)).alias("_own"),
        F.array_contains("t_strong", F.col("topic")).alias("_sup"),
        has_owner_cue("_sq", rules, True).alias("_cue"),
        label.isin(*rules.owner_labels).alias("_owner_label"),
        label.isin(*rules.process_labels).alias("_process_label"),
        label.isin(*rules.literature_labels).alias("_lit"),
        looks_like_related_work("_sq", "label", rules, True).alias("_related"),
        (steps_strength("_sq", True) >= STRONG_STEPS).alias("_rich"),
        explain_strength("_sq", rules, True).alias("_explain"),
        steps_bias_strength("_sq", rules, True).alias("_bias"),
        looks_like_artifact("_sq", rules, True).alias("_artifact"),
    )


def _select(df: DataFrame, predicates: list[Column], *, floor: int, limit: int) -> DataFrame:
    """First row for each predicate, then rows scoring ``floor`` and more.

    At least one further row is taken even when the predicates reached the
    limit already.
    """
    key = F.struct((-F.col("expansion_score")).alias("s"), F.col("score").alias("d"),
                   F.col("ord").alias("o"))
    df = unpicked(df.repartition("query_id"))
    for i, p in enumerate(predicates):
        df = pick_first(df, F.when(p, key), i, "pick")
    picked = F.col("pick_no").isNotNull()
    df = df.withColumn("_n", F.sum(picked.cast("int")).over(by_query())).withColumn(
        "_fit", (~picked & (F.col("expansion_score") >= floor)).cast("int")
    )
    nth = F.sum("_fit").over(
        by_query().orderBy(F.desc("expansion_score"), "score", "ord").rowsBetween(W.unboundedPreceding, 0)
    )
    df = df.withColumn("_nth", nth)
    room = F.greatest(F.lit(limit) - F.col("_n"), F.lit(1))
    chosen = picked | ((F.col("_fit") == 1) & (F.col("_nth") <= room))
    df = df.withColumn("_chosen", chosen)
    return df.withColumn(
        "_any", F.max(F.col("_chosen").cast("int")).over(by_query())
    )


def _finish(df: DataFrame, fallback_rows: int) -> DataFrame:
    """Fall back to the first base rows of the document; number the choice."""
    base_no = F.sum((F.col("in_base") & F.col("_own")).cast("int")).over(
        by_query().orderBy("score", "ord").rowsBetween(W.unboundedPreceding, 0)
    )
    df = df.withColumn("_base_no", base_no)
    fallback = (F.col("_any") == 0) & F.col("in_base") & F.col("_own") & (
        F.col("_base_no") <= fallback_rows
    )
    order = by_query().orderBy(
        F.asc_nulls_last("pick_no"), F.desc("expansion_score"), "score", "ord"
    )
    return (
        df.where(F.col("_chosen") | fallback)
        .withColumn("ctx", F.row_number().over(order))
        .withColumn("is_added", ~F.col("in_base"))
    )


def explanation_expansion(pool: DataFrame, rules: RuleSet, *, max_added: int = 4) -> DataFrame:
    """Contexts for an explanation.

    ``pool(query_id, topic, target_doc, chunk_id, ord, doc_id, label, text,
    score, in_base)`` holds the base hits and the hits of the template queries,
    one row per chunk.  Score = 5 own document + 4 support + 3 owner cue + 2
    owner chapter + min(signal, 6) + 2 steps - 5 related work - 3 literature.
    Taken: an owner cue, a signal of 2, a description of steps, then scores of
    2 and more.
    """
    f = _flags(pool, rules)
    score = (
        _points(F.col("_own"), 5)
        + _points(F.col("_sup"), 4)
        + _points(F.col("_cue"), 3)
        + _points(F.col("_owner_label"), 2)
        + F.least(F.col("_explain"), F.lit(6))
        + _points(F.col("_rich"), 2)
        - _points(F.col("_related"), 5)
        - _points(F.col("_lit"), 3)
    )
    f = f.withColumn("expansion_score", score)
    picked = _select(
        f, [F.col("_cue"), F.col("_explain") >= 2, F.col("_rich")], floor=2, limit=max(3, max_added)
    )
    return _finish(picked, 1).select(
        "query_id", "ctx", "chunk_id", "doc_id", "expansion_score", "is_added"
    )


def steps_expansion(
    pool: DataFrame, rules: RuleSet, *, max_added: int = 4, max_steps: int = 5
) -> DataFrame:
    """Contexts for the steps of one topic, same input as the explanation.

    Score = 6 own document + 4 support + 7 strong steps + 3 or 2 chapter + 2
    owner cue + min(signal, 6) - 4 artefact - 6 related - 4 literature.
    """
    f = _flags(pool, rules)
    score = (
        _points(F.col("_own"), 6)
        + _points(F.col("_sup"), 4)
        + _points(F.col("_rich"), 7)
        + F.when(F.col("_process_label"), 3).when(F.col("_owner_label"), 2).otherwise(0)
        + _points(F.col("_cue"), 2)
        + F.least(F.col("_bias"), F.lit(6))
        - _points(F.col("_artifact"), 4)
        - _points(F.col("_related"), 6)
        - _points(F.col("_lit"), 4)
    )
    f = f.withColumn("expansion_score", score)
    picked = _select(
        f,
        [F.col("_rich") & F.col("_process_label"), F.col("_rich"), F.col("_sup") & F.col("_cue")],
        floor=4,
        limit=max(2, max_added),
    )
    return _finish(picked, max(1, max_added)).select(
        "query_id", "topic", "target_doc", "ctx", "chunk_id", "doc_id", "text", "expansion_score",
        "is_added",
        F.col("_sup").alias("supports_topic"),
        F.col("_rich").alias("explicit_steps"),
        F.col("_artifact").alias("artifact"),
        valid_step_items("text", rules, max_items=max_steps).alias("items"),
    )


def steps_status(contexts: DataFrame, *, max_steps: int = 5) -> DataFrame:
    """One row per query from :func:`steps_expansion`.

    ``steps_found`` with two and more distinct items, else
    ``method_confirmed_no_explicit_steps`` when a context supports the topic,
    else ``method_not_found``.
    """
    has_items = F.size("items") > 0

    def ctxs(cond: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(cond, F.col("ctx"))))

    merged = F.flatten(
        F.transform(F.sort_array(F.collect_list(F.struct("ctx", "items"))), lambda x: x["items"])
    )
    out = contexts.groupBy("query_id", "topic", "target_doc").agg(
        ctxs(F.col("supports_topic")).alias("support_ctx"),
        ctxs(F.col("explicit_steps")).alias("explicit_ctx"),
        ctxs(has_items).alias("extractable_ctx"),
        ctxs(~has_items & F.col("explicit_steps") & F.col("artifact")).alias("artifact_ctx"),
        merged.alias("_items"),
    )
    low = F.transform("_items", F.lower)
    first = F.filter(
        F.transform("_items", lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)),
        lambda x: x.isNotNull(),
    )
    status = (
        F.when(F.size("steps") >= 2, "steps_found")
        .when(F.size("support_ctx") > 0, "method_confirmed_no_explicit_steps")
        .otherwise("method_not_found")
    )
    return (
        out.withColumn("steps", F.slice(first, 1, max_steps))
        .withColumn("status", status)
        .drop("_items")
    )
