"""Per-topic coverage of a hit list and reservation of topic anchors.

The greedy rules ("best hit not used yet, topic by topic") run as a fixed
number of windows over ``query_id``: the loops below go over the topics of the
rule set, never over rows, and all windows share one exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscan.functions.text import col, matches, text_or_empty
from folioscan.functions.topics import (
    STRONG_STEPS,
    id_hint,
    mentions,
    metadata_blob,
    named_topics,
    normal,
    steps_strength,
    strong_cue,
    topic_text,
    topics_in,
)
from folioscan.functions.windows import by_query
from folioscan.rules import RuleSet


def with_topic_columns(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """Arrays of topic names a hit stands for, each by another test.

    ``t_id`` id hint, ``t_sup`` support, ``t_strong`` strong support,
    ``t_any`` normalised mention, ``t_direct`` direct mention.
    """
    have = set(hits.columns)
    blob = metadata_blob(
        *[F.col(c).cast("string") if c in have else F.lit("")
          for c in ("doc_id", "source_file", "title", "label", "stream")]
    )
    doc, topics = F.col("doc_id").cast("string"), {t.name: t for t in rules.topics}
    # every normal form is computed once, every pattern matched once
    forms = hits.select(
        "*",
        F.lower(text_or_empty("text")).alias("_low"),
        normal("text").alias("_sq"),
        topic_text("text").alias("_split"),
        normal(blob).alias("_blob"),
    ).withColumn("_lsplit", topic_text("_low"))

    def where(test) -> Column:
        return named_topics({n: test(t) for n, t in topics.items()})

    # one reference per topic keeps the optimizer from inlining the patterns
    def either(*cols: str) -> Column:
        return named_topics(
            {n: reduce(lambda a, b: a | b, [F.array_contains(c, n) for c in cols]) for n in topics}
        )

    loose = {n: t for n, t in topics.items() if not t.strict_only}
    tested = forms.select(
        *hits.columns,
        where(lambda t: id_hint(doc, t)).alias("t_id"),
        where(lambda t: matches("_low", t.strict)).alias("_strict"),
        named_topics({n: matches("_lsplit", t.mention) for n, t in loose.items()}).alias("_loose"),
        where(lambda t: strong_cue("_sq", t, True) | strong_cue("_blob", t, True)).alias("_cue"),
        where(lambda t: matches("_split", t.mention)).alias("t_any"),
        where(lambda t: mentions("_sq", t, True)).alias("t_direct"),
    )
    return tested.withColumn("t_sup", either("t_id", "_strict", "_loose")).withColumn(
        "t_strong", either("t_sup", "_cue")
    ).drop("_strict", "_loose", "_cue")


def pick_first(df: DataFrame, key: Column, order: int, name: str | Column) -> DataFrame:
    """Mark the unused row with the least non-null ``key`` of each query.

    Needs and updates ``pick_no`` (null = unused) and ``pick_for``.
    """
    open_key = F.when(F.col("pick_no").isNull(), key)
    best = F.min(F.col("_key")).over(by_query())
    hit = F.col("_key").isNotNull() & (F.col("_key") == F.col("_best"))
    label = F.lit(name) if isinstance(name, str) else name
    return (
        df.withColumn("_key", open_key)
        .withColumn("_best", best)
        .withColumn("pick_for", F.when(hit, label).otherwise(F.col("pick_for")))
        .withColumn("pick_no", F.when(hit, F.lit(order)).otherwise(F.col("pick_no")))
        .drop("_key", "_best")
    )


def unpicked(df: DataFrame) -> DataFrame:
    return df.withColumn("pick_no", F.lit(None).cast("int")).withColumn(
        "pick_for", F.lit(None).cast("string")
    )


def select_with_coverage(
    hits: DataFrame, rules: RuleSet, *, top_k: int, max_per_doc: int, targets: str = "targets"
) -> DataFrame:
    """One hit per target topic first, then the best others.

    For each topic of ``targets`` (an array on the hits, in its order) the best
    unused hit by id hint, then support, then plain mention (not for strict-only
    topics).  The rest fills up to ``top_k`` in rank order with at most
    ``max_per_doc`` hits per document (0 = no limit).  Adds ``pick_for``; the
    new order is ``rank``.
    """
    strict = [t.name for t in rules.topics if t.strict_only]
    df = unpicked(with_topic_columns(hits, rules).repartition("query_id"))
    for i in range(len(rules.topics)):
        topic = F.get(col(targets), i)
        loose = F.array_contains("t_any", topic)
        if strict:
            loose = loose & ~topic.isin(*strict)
        tier = (
            F.when(F.array_contains("t_id", topic), 1)
            .when(F.array_contains("t_sup", topic), 2)
            .when(loose, 3)
        )
        key = F.when(tier.isNotNull(), F.struct(tier.alias("tier"), F.col("rank").alias("rank")))
        df = pick_first(df, key, i, topic)
    picked = F.col("pick_no").isNotNull()
    in_doc = W.partitionBy("query_id", "doc_id")
    df = (
        df.withColumn("_picked", picked)
        .withColumn("_doc_picks", F.sum(picked.cast("int")).over(in_doc))
        .withColumn(
            "_nth",
            F.row_number().over(
                W.partitionBy("query_id", "doc_id", "_picked").orderBy("rank")
            ),
        )
    )
    if max_per_doc > 0:
        df = df.where(picked | (F.col("_doc_picks") + F.col("_nth") <= max_per_doc))
    order = by_query().orderBy(F.asc_nulls_last("pick_no"), "rank")
    return (
        df.withColumn("_new", F.row_number().over(order))
        .where(F.col("_new") <= top_k)
        .withColumn("rank", F.col("_new"))
        .drop("_new", "_picked", "_doc_picks", "_nth", "t_id", "t_sup", "t_strong", "t_any",
              "t_direct", "pick_no")
    )


def coverage_detail(selected: DataFrame, queries: DataFrame, rules: RuleSet) -> DataFrame:
    """Found flag, chunk and document per (query, target topic)."""
    wanted = queries.select("query_id", F.posexplode("targets").alias("topic_pos", "topic"))
    found = selected.where(F.col("pick_for").isNotNull()).select(
        "query_id", F.col("pick_for").alias("topic"), "chunk_id", "doc_id"
    )
    hint = F.lit(False)
    for t in rules.topics:
        hint = F.when(F.col("topic") == t.name, id_hint(F.col("doc_id").cast("string"), t)).otherwise(hint)
    return wanted.join(found, ["query_id", "topic"], "left").select(
        "query_id", "topic_pos", "topic",
        F.col("chunk_id").isNotNull().alias("found"),
        "chunk_id", "doc_id",
        F.coalesce(F.col("chunk_id").isNotNull() & hint, F.lit(False)).alias("id_hit"),
    )


def adequately_represented(
    hits: DataFrame, rules: RuleSet, *, targets: str = "targets", prefer_steps: Column | None = None
) -> DataFrame:
    """Per (query, topic): is some hit a good enough representative?"""
    flagged = with_topic_columns(hits, rules)
    enough = F.lit(True)
    if prefer_steps is not None:
        enough = ~prefer_steps | (steps_strength("text") >= STRONG_STEPS)
    strong = F.array_contains("t_strong", F.col("topic")) & F.col("_enough")
    return (
        flagged.select("query_id", "t_strong", enough.alias("_enough"), F.explode(targets).alias("topic"))
        .groupBy("query_id", "topic")
        .agg(F.bool_or(strong).alias("represented"))
    )


def topic_doc_map(hits: DataFrame, rules: RuleSet, *, targets: str = "targets") -> DataFrame:
    """Document of the first hit that mentions a topic."""
    direct = named_topics({t.name: mentions("text", t) for t in rules.topics})
    return (
        hits.select("query_id", "rank", "doc_id", F.explode(F.array_intersect(targets, direct)).alias("topic"))
        .groupBy("query_id", "topic")
        .agg(F.min_by("doc_id", "rank").alias("doc_id"))
    )


def expansion_queries(
    queries: DataFrame, base_hits: DataFrame, rules: RuleSet, *, min_topics: int = 2
) -> DataFrame:
    """Extra searches for topics the base hits lack.

    ``queries(query_id, text, targets, is_steps, needs_coverage)``.  Step
    questions search again for every topic.  All rows go through one search;
    ``expansion_id`` is its query id.
    """
    seen = base_hits.select("query_id", F.explode(topics_in("text", rules)).alias("topic"))
    have = seen.groupBy("query_id").agg(F.collect_set("topic").alias("have"))
    none = F.array().cast("array<string>")
    missing = F.array_except("targets", F.coalesce("have", none))
    t = rules.templates

    def fill(template: str) -> Column:
        filled = F.replace(F.lit(template), F.lit("{topic}"), F.col("topic"))
        return F.trim(F.replace(filled, F.lit("{query}"), F.trim("text")))

    rows = (
        queries.where(F.col("needs_coverage") & (F.size("targets") >= min_topics))
        .join(have, "query_id", "left")
        .select(
            "query_id", "text", "is_steps",
            F.explode(F.when(F.col("is_steps"), F.col("targets")).otherwise(missing)).alias("topic"),
        )
    )
    text = F.when(F.col("is_steps"), fill(t["steps_query"])).otherwise(fill(t["biased_query"]))
    return rows.select(
        F.concat_ws("|", "query_id", "topic").alias("expansion_id"), "query_id", "topic",
        text.alias("text"),
    )


def best_anchors(
    candidates: DataFrame, coverage: DataFrame, rules: RuleSet, *, prefer_steps: Column | None = None
) -> DataFrame:
    """Best representative per (query, topic) among the candidates.

    ``coverage`` (see :func:`coverage_detail`) names a preferred document and
    chunk.  Step questions prefer hits of the topic's own documents, then the
    strongest description of steps.
    """
    steps_wanted = F.lit(False) if prefer_steps is None else prefer_steps
    flagged = with_topic_columns(candidates, rules).withColumn("_steps", steps_strength("text"))
    pref = coverage.select(
        "query_id", "topic_pos", "topic",
        F.col("doc_id").alias("_pdoc"), F.col("chunk_id").alias("_pchunk"),
    )
    df = flagged.join(pref, "query_id").withColumn("_prefer", steps_wanted)
    own = F.array_contains("t_id", F.col("topic"))
    strong = F.array_contains("t_strong", F.col("topic"))
    same_doc = F.coalesce(F.col("doc_id") == F.col("_pdoc"), F.lit(False))
    same_chunk = F.coalesce(F.col("chunk_id") == F.col("_pchunk"), F.lit(False))
    rich = F.col("_steps") >= STRONG_STEPS
    for_steps = (
        F.when(own & rich, 1).when(own, 2).when(strong & rich, 3).when(strong, 4)
    )
    plain = (
        F.when(same_chunk & strong, 1)
        .when(same_doc & strong, 2)
        .when(own, 3)
        .when(strong, 4)
        .when(same_chunk, 5)
    )
    df = df.withColumn("_tier", F.when(F.col("_prefer"), for_steps).otherwise(plain)).where(
        F.col("_tier").isNotNull()
    )

    def only_steps(c: Column) -> Column:
        return F.when(F.col("_prefer"), c).otherwise(0)

    order = W.partitionBy("query_id", "topic").orderBy(
        "_tier",
        F.desc(only_steps(F.col("_steps"))),
        F.desc(only_steps(same_doc.cast("int"))),
        F.desc(only_steps(same_chunk.cast("int"))),
        "rank",
    )
    return (
        df.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") == 1)
        .select("query_id", "topic_pos", "topic", "chunk_id", "doc_id", F.col("_tier").alias("tier"))
    )


def reserve_anchors(
    reranked: DataFrame, candidates: DataFrame, anchors: DataFrame, *, final_k: int | Column
) -> DataFrame:
    """Final hits: reserved anchors, then rerank order, then candidates.

    ``anchors`` as given by :func:`best_anchors` (a query without targets has
    none and keeps its reranked list).  Adds ``reserved_topic`` and, per query,
    ``anchors_applied`` and ``anchors_modified``.
    """
    k = F.lit(max(1, final_k)) if isinstance(final_k, int) else F.greatest(final_k, F.lit(1))
    rows = [
        anchors.select("query_id", "chunk_id", F.lit(0).alias("src"),
                       F.col("topic_pos").alias("pos"), "topic"),
        reranked.select("query_id", "chunk_id", F.lit(1).alias("src"),
                        F.col("rerank_rank").alias("pos"), F.lit(None).cast("string").alias("topic")),
        candidates.select("query_id", "chunk_id", F.lit(2).alias("src"),
                          F.col("rank").alias("pos"), F.lit(None).cast("string").alias("topic")),
    ]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    one = both.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("src", "pos", "topic")).alias("first"),
        F.min(F.when(F.col("src") == 1, F.col("pos"))).alias("old_pos"),
    )
    order = by_query().orderBy("first.src", "first.pos")
    reserved = F.max((F.col("first.src") == 0).cast("int")).over(by_query()) == 1
    placed = (
        one.withColumn("has_anchor", reserved)
        .where((F.col("first.src") < 2) | F.col("has_anchor"))
        .withColumn("rank", F.row_number().over(order))
    )
    # the list changed when a kept rank holds another chunk than reranking gave,
    # or a reranked chunk fell out
    moved = (F.col("rank") <= k) & (
        F.col("old_pos").isNull() | (F.col("old_pos") != F.col("rank"))
    )
    fell = (F.col("rank") > k) & F.col("old_pos").isNotNull() & (F.col("old_pos") <= k)
    changed = F.max((moved | fell).cast("int")).over(by_query()) == 1
    return (
        placed.withColumn("anchors_modified", changed)
        .where(F.col("rank") <= k)
        .select(
            "query_id", "rank", "chunk_id",
            F.col("first.topic").alias("reserved_topic"),
            F.col("has_anchor").alias("anchors_applied"),
            "anchors_modified",
        )
    )
