"""Group aggregations over hits and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscan.functions.text import (
    distinct_in_order,
    matches,
    quote_snippet,
    short_snippet,
    text_or_empty,
)
from folioscan.functions.topics import (
    drop_doc_header,
    has_owner_cue,
    has_steps_signal,
    id_hint,
    looks_like_related_work,
    mentions,
    named_topics,
    normal,
)
from folioscan.functions.windows import by_query
from folioscan.operators.expansion import topic_label
from folioscan.rules import RuleSet

CLASSES = ("strong", "weak", "neutral", "mention")


def ownership_class(
    text: Column | str, label: Column | str, mentioned: Column, rules: RuleSet, ready: bool = False
) -> Column:
    """How a chunk that names the topic relates to it; null when it does not."""
    related = looks_like_related_work(text, label, rules, ready)
    owner_label = F.upper(text_or_empty(label)).isin(*rules.owner_labels)
    return F.when(
        mentioned,
        F.when(~related & has_owner_cue(text, rules, ready), "strong")
        .when(owner_label & ~related, "weak")
        .when(related, "mention")
        .otherwise("neutral"),
    )


def _mentioned(rules: RuleSet, topic: Column, text: str) -> Column:
    """Only the topic asked for is matched."""
    out = F.lit(False)
    for t in rules.topics:
        out = F.when(topic == t.name, mentions(text, t, True)).otherwise(out)
    return out


def _hinted(rules: RuleSet, topic: Column, doc: Column) -> Column:
    hinted = named_topics({t.name: id_hint(doc, t) for t in rules.topics})
    return F.array_contains(hinted, topic)


def document_ownership(
    hits: DataFrame, rules: RuleSet, *, topic: str = "topic", evidence_chars: int = 280
) -> DataFrame:
    """Which documents own the topic of a query.

    Score per (query, document) = 4 id hint + 3 strong + weak + neutral - 2
    mention-only chunks; acceptance and reasons follow from the counts.  Counts
    use a partial aggregation and evidence a per-task limit of two rows per
    class, so a document with a third of the hits is never gathered.
    """
    keys = ["query_id", topic, "doc_id"]
    doc = F.col("doc_id").cast("string")
    forms = hits.select(
        *keys, "rank", "chunk_id", "source_file", "label",
        short_snippet("text", evidence_chars).alias("snippet"),
        normal("text").alias("_sq"),
    ).withColumn("_hit", _mentioned(rules, F.col(topic), "_sq"))
    flagged = forms.withColumn(
        "cls", ownership_class("_sq", "label", F.col("_hit"), rules, True)
    ).drop("_sq", "_hit")

    def n(cls: str) -> Column:
        return F.count_if(F.coalesce(F.col("cls") == cls, F.lit(False))).cast("int")

    counts = flagged.groupBy(*keys).agg(
        *[n(c).alias(f"n_{c}") for c in CLASSES],
        F.min_by("source_file", "rank").alias("source_file"),
    )
    by_class = W.partitionBy(*keys, "cls").orderBy("rank")
    by_doc = W.partitionBy(*keys).orderBy("rank")
    evidence = ["rank", "chunk_id", "label", "snippet"]
    top_class = (
        flagged.where(F.col("cls").isNotNull())
        .withColumn("nth", F.row_number().over(by_class))
        .where(F.col("nth") <= 2)
    )
    top_doc = (
        flagged.withColumn("nth", F.row_number().over(by_doc))
        .where(F.col("nth") <= 2)
        .withColumn("cls", F.lit("any"))
    )
    prio = F.lit(4)
    for i, c in enumerate(CLASSES):
        prio = F.when(F.col("cls") == c, i).otherwise(prio)
    rows = top_class.unionByName(top_doc).withColumn("prio", prio)
    first, second = F.col("nth") == 1, (F.col("nth") == 2) & (F.col("cls") != "mention")
    picked = rows.groupBy(*keys).agg(
        F.min(F.when(first, F.struct("prio", *evidence))).alias("rep"),
        F.min(F.when(second, F.struct("prio", *evidence))).alias("sec"),
    )
    hint = _hinted(rules, F.col(topic), doc)
    score = (
        F.when(hint, 4).otherwise(0)
        + 3 * F.col("n_strong")
        + F.col("n_weak")
        + F.col("n_neutral")
        - 2 * F.col("n_mention")
    )
    strong, weak = F.col("n_strong") > 0, F.col("n_weak") > 0
    neutral = (F.col("n_neutral") > 0) & (F.col("n_mention") == 0)
    reasons = F.array_compact(
        F.array(
            F.when(hint, F.lit("doc_id_hint")),
            F.when(strong, F.lit("strong_owner_phrase")),
            F.when(weak, F.lit("preferred_bab_context")),
            F.when(neutral, F.lit("direct_method_mention")),
        )
    )
    out = counts.join(picked, keys).select(
        *keys,
        "source_file",
        hint.alias("id_hit"),
        score.alias("owner_score"),
        *[f"n_{c}" for c in CLASSES],
        reasons.alias("accepted_reasons"),
        F.col("rep.chunk_id").alias("representative_chunk_id"),
        F.col("rep.label").alias("representative_label"),
        F.col("rep.snippet").alias("owner_evidence"),
        F.coalesce("sec.snippet", F.lit("")).alias("secondary_evidence"),
    )
    accepted = F.col("id_hit") | (F.col("n_strong") > 0) | (
        (F.col("owner_score") >= 2) & ((F.col("n_weak") > 0) | neutral)
    )
    return out.withColumn("accepted", accepted)


def accepted_documents(ownership: DataFrame, *, max_docs: int = 5) -> DataFrame:
    """Best accepted documents per query: score descending, then id."""
    order = by_query().orderBy(F.desc("owner_score"), F.col("doc_id").cast("string"))
    return (
        ownership.where(F.col("accepted"))
        .withColumn("doc_rank", F.row_number().over(order))
        .where(F.col("doc_rank") <= max(1, max_docs))
    )


def aggregation_summary(ownership: DataFrame, *, max_docs: int = 5) -> DataFrame:
    """One row per query: candidate and accepted counts, accepted ids in order."""
    counts = ownership.groupBy("query_id", "topic").agg(
        F.count("*").cast("int").alias("candidate_doc_count")
    )
    best = accepted_documents(ownership, max_docs=max_docs).groupBy("query_id").agg(
        F.count("*").cast("int").alias("accepted_doc_count"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("doc_rank", F.col("doc_id").cast("string").alias("d")))),
            lambda x: x["d"],
        ).alias("accepted_doc_ids"),
    )
    none = F.array().cast("array<string>")
    return counts.join(best, "query_id", "left").select(
        "query_id",
        F.col("topic").alias("target_topic"),
        F.lit(True).alias("executed"),
        (F.coalesce("accepted_doc_count", F.lit(0)) > 0).alias("applied"),
        "candidate_doc_count",
        F.coalesce("accepted_doc_count", F.lit(0)).alias("accepted_doc_count"),
        F.coalesce("accepted_doc_ids", none).alias("accepted_doc_ids"),
    )


def ownership_contexts(accepted: DataFrame, rules: RuleSet) -> DataFrame:
    """Text summary of each accepted document, numbered per query.

    Display columns (``title_display, author_display, year_display``) are used
    when the caller joined them.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("-")) if name in accepted.columns else F.lit("-")

    def or_dash(c: Column) -> Column:
        return F.when(c != "", c).otherwise("-")

    lines = F.array_compact(
        F.array(
            F.concat(F.lit("DOC_AGG: "), F.col("doc_id").cast("string"), F.lit(" | "),
                     text_or_empty("source_file"), F.lit(" | owner_method="),
                     topic_label(F.col("topic"), rules)),
            F.concat(F.lit("TITLE: "), shown("title_display")),
            F.concat(F.lit("AUTHOR: "), shown("author_display")),
            F.concat(F.lit("YEAR: "), shown("year_display")),
            F.concat(F.lit("OWNER_SCORE: "), F.col("owner_score")),
            F.concat(F.lit("OWNERSHIP_BASIS: "), or_dash(F.array_join("accepted_reasons", ", "))),
            F.concat(F.lit("OWNER_EVIDENCE: "), or_dash(F.col("owner_evidence"))),
            F.when(F.col("secondary_evidence") != "",
                   F.concat(F.lit("ADDITIONAL_EVIDENCE: "), F.col("secondary_evidence"))),
        )
    )
    return accepted.select(
        "query_id", F.col("doc_rank").alias("ctx"), "doc_id", F.array_join(lines, "\n").alias("text")
    )


# -- comparison ----------------------------------------------------------------


def comparison_contexts(
    contexts: DataFrame, rules: RuleSet, *, targets: str = "targets", per_topic: int = 2
) -> DataFrame:
    """Context numbers per (query, topic), preferring ones no earlier topic took.

    ``contexts(query_id, ctx, text, label, targets)``.  Order of choice for a
    topic: strong and unused, strong, weak and unused, weak; strong means the
    context is no related work.  One window per target position.
    """
    direct = named_topics({t.name: mentions("text", t) for t in rules.topics})
    df = contexts.select(
        "query_id", "ctx", targets, direct.alias("t_direct"),
        looks_like_related_work("text", "label", rules).alias("weak"),
    ).repartition("query_id")
    df = df.withColumn("chosen", F.array().cast("array<struct<topic_pos:int,topic:string,pos:int>>"))
    for i in range(len(rules.topics)):
        topic = F.get(F.col(targets), i)
        fits = F.coalesce(F.array_contains("t_direct", topic), F.lit(False))
        tier = F.col("weak").cast("int") * 2 + (F.size("chosen") > 0).cast("int")
        order = by_query().orderBy(F.desc("_fits"), "_tier", "ctx")
        df = (
            df.withColumn("_fits", fits)
            .withColumn("_tier", tier)
            .withColumn("_pos", F.row_number().over(order))
        )
        take = F.struct(F.lit(i).alias("topic_pos"), topic.alias("topic"), F.col("_pos").alias("pos"))
        df = df.withColumn(
            "chosen",
            F.when(F.col("_fits") & (F.col("_pos") <= per_topic), F.array_append("chosen", take))
            .otherwise(F.col("chosen")),
        )
    users = F.size("chosen")
    return df.select(
        "query_id", "ctx", "weak", users.alias("n_users"), F.explode("chosen").alias("c")
    ).select(
        "query_id", "c.topic_pos", "c.topic", "c.pos", "ctx", (~F.col("weak")).alias("strong"),
        (F.col("n_users") > 1).alias("shared"),
    )


def comparison_status(chosen: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: supported, weak and missing topics, context counts, status."""
    wanted = queries.where(F.size("targets") >= 2).select(
        "query_id", F.posexplode("targets").alias("topic_pos", "topic")
    )
    per_topic = chosen.groupBy("query_id", "topic_pos").agg(
        F.bool_or("strong").alias("strong"),
        F.count_if(~F.col("shared")).alias("own"),
        F.collect_set("ctx").alias("ctxs"),
        F.collect_set(F.when(F.col("shared"), F.col("ctx"))).alias("shared"),
    )
    rows = wanted.join(per_topic, ["query_id", "topic_pos"], "left")

    def topics(cond: Column) -> Column:
        got = F.sort_array(F.collect_list(F.when(cond, F.struct("topic_pos", "topic"))))
        return F.transform(got, lambda x: x["topic"])

    out = rows.groupBy("query_id").agg(
        topics(F.col("strong")).alias("supported_topics"),
        topics(~F.col("strong")).alias("weak_topics"),
        topics(F.col("strong").isNull()).alias("missing_topics"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ctxs")))).alias("unique_context_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("shared_ctx"),
        F.count_if((F.col("topic_pos") < 2) & (F.coalesce("own", F.lit(0)) > 0)).alias("_own2"),
    )
    n_sup, n_weak = F.size("supported_topics"), F.size("weak_topics")
    balanced = (
        (n_sup >= 2)
        & (n_weak == 0)
        & (F.size("missing_topics") == 0)
        & (F.col("unique_context_count") >= 2)
        & (F.col("_own2") == 2)
    )
    return out.withColumn(
        "comparison_status",
        F.when(balanced, "balanced_comparison")
        .when(n_sup + n_weak >= 2, "asymmetric_comparison")
        .otherwise("insufficient_comparison"),
    ).drop("_own2")


def comparison_candidates(
    contexts: DataFrame, rules: RuleSet, *, targets: str = "targets", per_topic: int = 2
) -> DataFrame:
    """Best contexts per topic by cues: 4 + 2 usage + 2 reason + 1 process - 4 noise."""
    p = rules.pattern_lists
    body = F.col("body")
    df = contexts.select("query_id", "ctx", targets, drop_doc_header("text").alias("body"))
    topics = named_topics({t.name: matches(body, t.mention, "iU") for t in rules.topics})
    score = (
        F.lit(4)
        + F.when(matches(body, p["compare_usage"], "iU"), 2).otherwise(0)
        + F.when(matches(body, p["compare_reason"], "iU"), 2).otherwise(0)
        + F.when(matches(body, p["compare_process"], "iU"), 1).otherwise(0)
        - F.when(matches(body, p["compare_noise"], "iU"), 4).otherwise(0)
    )
    rows = df.where(body != "").select(
        "query_id", "ctx", score.alias("score"),
        F.explode(F.array_intersect(targets, topics)).alias("topic"),
    )
    order = W.partitionBy("query_id", "topic").orderBy(F.desc("score"), "ctx")
    return (
        rows.where(F.col("score") >= 1)
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= per_topic)
    )


def topic_snippet(text: Column | str, topic: Column, rules: RuleSet, max_len: int = 220) -> Column:
    out = F.lit(None).cast("string")
    for t in rules.topics:
        out = F.when(topic == t.name, quote_snippet(text, t.mention, max_len)).otherwise(out)
    return out


def comparison_signals(contexts: DataFrame, chosen: DataFrame, rules: RuleSet) -> DataFrame:
    """First snippet per (query, topic) for each cue, and the style tags.

    ``chosen(query_id, topic, pos, ctx)`` gives the contexts to look at.
    """
    p = rules.pattern_lists
    body = drop_doc_header("text")
    rows = chosen.select("query_id", "topic", "pos", "ctx").join(
        contexts.select("query_id", "ctx", "text"), ["query_id", "ctx"]
    )
    style = F.array().cast("array<string>")
    for t in rules.topics:
        tags = F.array_compact(
            F.array(*[F.when(matches(body, s, "iU"), F.lit(s)) for s in t.style])
        ) if t.style else F.array().cast("array<string>")
        style = F.when(F.col("topic") == t.name, tags).otherwise(style)
    rows = rows.select(
        "query_id", "topic", "pos", "ctx",
        topic_snippet(body, F.col("topic"), rules).alias("snippet"),
        matches(body, p["compare_usage"], "iU").alias("usage"),
        matches(body, p["compare_reason"], "iU").alias("reason"),
        (matches(body, p["compare_process"], "iU") | has_steps_signal(body, rules)).alias("process"),
        style.alias("style"),
    )

    def first(cond: Column) -> Column:
        return F.min_by(
            F.when(cond, F.struct("ctx", "snippet")), F.when(cond, F.col("pos"))
        )

    tags = F.flatten(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "style"))), lambda x: x["style"])
    )
    return rows.groupBy("query_id", "topic").agg(
        first(F.col("snippet") != "").alias("best"),
        first(F.col("usage")).alias("usage"),
        first(F.col("reason")).alias("reason"),
        first(F.col("process")).alias("process"),
        distinct_in_order(tags).alias("style_tags"),
    )


# -- steps and evidence ----------------------------------------------------------


def steps_contexts(
    contexts: DataFrame, rules: RuleSet, *, targets: str = "targets", per_topic: int = 3
) -> DataFrame:
    """Contexts per topic for steps: topic mention, step signal first."""
    topics = named_topics({t.name: matches("text", t.mention, "iU") for t in rules.topics})
    rows = contexts.select(
        "query_id", "ctx", "text",
        F.when(has_steps_signal("text", rules), 0).otherwise(1).alias("prio"),
        F.explode(F.array_intersect(targets, topics)).alias("topic"),
    )
    order = W.partitionBy("query_id", "topic").orderBy("prio", "ctx")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= per_topic)


def bullet_topic(bullet: Column | str, targets: Column, rules: RuleSet) -> Column:
    """Topic of an evidence line: its "(LABEL)" prefix, else a mention, in
    target order."""
    b = F.trim(text_or_empty(bullet))
    head = F.lower(F.trim(F.regexp_extract(b, r"^\(?\s*([A-Za-z_ ]+?)\s*\)?\s*[:\-]", 1)))
    joined = F.replace(head, F.lit(" "), F.lit("_"))

    def by_prefix(t: Column) -> Column:
        out = F.lit(False)
        for topic in rules.topics:
            same = (head == topic.label.lower()) | F.contains(joined, F.lit(topic.name.lower()))
            out = F.when(t == topic.name, (head != "") & same).otherwise(out)
        return out

    mentioned = named_topics({t.name: matches(F.lower(b), t.mention) for t in rules.topics})
    prefixed = F.get(F.filter(targets, by_prefix), 0)
    return F.coalesce(prefixed, F.get(F.array_intersect(targets, mentioned), 0))


def cap_evidence(
    bullets: DataFrame, rules: RuleSet, *, per_topic: int = 1, total: int = 6,
    targets: str = "targets",
) -> DataFrame:
    """At most ``per_topic`` lines per target topic, others fill up to ``total``.

    ``bullets(query_id, pos, bullet, targets)``; the new order is ``new_pos``.
    """
    per_topic, total = max(1, min(per_topic, 3)), max(1, min(total, 8))
    rows = bullets.withColumn("topic", bullet_topic("bullet", F.col(targets), rules))
    place = F.array_position(targets, F.col("topic"))
    rows = rows.withColumn("_place", F.coalesce(F.nullif(place, F.lit(0)), F.lit(99)))
    nth = F.row_number().over(W.partitionBy("query_id", "_place").orderBy("pos"))
    rows = rows.withColumn("_nth", nth).where((F.col("_place") == 99) | (F.col("_nth") <= per_topic))
    order = by_query().orderBy("_place", "pos")
    return (
        rows.withColumn("new_pos", F.row_number().over(order))
        .where(F.col("new_pos") <= total)
        .drop("_place", "_nth")
    )
