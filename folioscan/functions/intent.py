"""Question flags and the intent plan as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import contains_any, matches, squeeze, strip, text_or_empty
from folioscan.functions.topics import topics_in
from folioscan.rules import RuleSet


def _low(c: Column | str) -> Column:
    return F.lower(text_or_empty(c))


def is_topic_question(c, rules: RuleSet) -> Column:
    return matches(_low(c), rules.patterns["q_topic"])


def is_steps_question(c, rules: RuleSet) -> Column:
    q, p = _low(c), rules.patterns
    return matches(q, p["q_steps"]) | (matches(q, p["q_flow"]) & matches(q, p["q_flow_context"]))


def is_anaphora(c, rules: RuleSet) -> Column:
    return matches(_low(c), rules.patterns["q_anaphora"])


def is_multi_target(c, rules: RuleSet) -> Column:
    q = _low(c)
    return contains_any(q, rules.word_lists["multi_target_phrases"]) | matches(
        q, rules.pattern_lists["multi_target"]
    )


def is_multi_doc(c, rules: RuleSet) -> Column:
    q = _low(c)
    return contains_any(q, rules.word_lists["multi_doc_phrases"]) | matches(
        q, rules.pattern_lists["multi_doc"]
    )


def is_count(c, rules: RuleSet) -> Column:
    return matches(_low(c), rules.patterns["q_count"])


def is_listing(c, rules: RuleSet) -> Column:
    return matches(_low(c), rules.patterns["q_listing"])


def is_explanation(c, rules: RuleSet) -> Column:
    return matches(_low(c), rules.pattern_lists["explain"])


def is_comparison(c, rules: RuleSet) -> Column:
    q, p = _low(c), rules.patterns
    two = F.size(topics_in(q, rules)) >= 2
    return matches(q, p["q_compare"]) | (two & matches(q, p["q_compare_join"]))


def is_identification(c, rules: RuleSet) -> Column:
    q = _low(c)
    return (
        is_topic_question(q, rules)
        & ~is_steps_question(q, rules)
        & ~is_explanation(q, rules)
        & matches(q, rules.patterns["q_identify"])
    )


def is_compression(c, rules: RuleSet) -> Column:
    """Surface test only; the follow-up also needs a topic or step history."""
    q = F.lower(squeeze(c))
    return (q != "") & matches(q, rules.pattern_lists["compression"])


FLAGS = {
    "is_topic": is_topic_question,
    "is_steps": is_steps_question,
    "is_anaphora": is_anaphora,
    "is_multi_target": is_multi_target,
    "is_multi_doc": is_multi_doc,
    "is_count": is_count,
    "is_listing": is_listing,
    "is_explanation": is_explanation,
    "is_comparison": is_comparison,
    "is_identification": is_identification,
    "is_compression": is_compression,
}


def question_flags(c: Column | str, rules: RuleSet) -> list[Column]:
    """All flags, one column each, in a single projection."""
    return [f(c, rules).alias(name) for name, f in FLAGS.items()]


def with_intent_plan(
    df: DataFrame, rules: RuleSet, *, text: str = "text", history: str | None = None,
    allowed_docs: str | None = None, name: str = "plan",
) -> DataFrame:
    """Add the plan struct of a question.

    Priority: comparison > steps for one topic > count and list > explanation
    that pre-empts a listing > listing > explanation > identification > general.
    ``history`` is an array of structs with ``query`` and ``answer_preview``; it
    supplies topics to anaphoric and step questions that name none.

    Flags are computed in a projection of their own, so that no pattern is
    matched twice however often the plan refers to it.
    """
    p = rules.patterns
    q = strip(text_or_empty(text))
    low = F.lower(q)
    none = F.array().cast("array<string>")
    flags = df.select(
        "*",
        topics_in(q, rules).alias("_own"),
        *[f(q, rules).alias(f"_{n}") for n, f in FLAGS.items()
          if n not in ("is_comparison", "is_identification")],
        matches(low, p["q_compare"]).alias("_compare"),
        matches(low, p["q_compare_join"]).alias("_join"),
        topics_in(low, rules).alias("_low_topics"),
        matches(low, p["q_identify"]).alias("_identify"),
        matches(low, p["q_multi_doc_extra"]).alias("_multi_extra"),
        matches(low, p["q_title_field"]).alias("_title"),
        matches(low, p["q_author_field"]).alias("_author"),
    )
    if history is not None:
        blob = history_text(F.col(history))
        flags = flags.withColumn(
            "_past",
            F.when(
                (F.size("_own") == 0) & (F.col("_is_anaphora") | F.col("_is_steps")),
                topics_in(blob, rules),
            ),
        )
        topics = F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce("_past", none))
    else:
        topics = F.col("_own")
    docs = none if allowed_docs is None else F.array_distinct(
        F.filter(
            F.transform(F.coalesce(F.col(allowed_docs), none), strip), lambda x: x != ""
        )
    )
    staged = flags.select(
        "*",
        topics.alias("_topics"),
        docs.alias("_docs"),
        (F.col("_compare") | ((F.size("_low_topics") >= 2) & F.col("_join"))).alias("_cmp"),
        (F.col("_is_multi_doc") | F.col("_multi_extra")).alias("_many"),
        (F.col("_title") | F.col("_author")).alias("_fields"),
    )
    n = F.size("_topics")
    compare, steps, count = F.col("_cmp"), F.col("_is_steps"), F.col("_is_count")
    listing, explain, topic = F.col("_is_listing"), F.col("_is_explanation"), F.col("_is_topic")
    fields, many, title, author = (F.col(c) for c in ("_fields", "_many", "_title", "_author"))
    preempt = explain & ~count & ~steps & ~compare & ~fields & (n <= 1)
    identify = topic & ~steps & ~explain & F.col("_identify")
    primary = (
        F.when(compare, "method_comparison")
        .when(steps & (n <= 1), "single_target_steps")
        .when(count & (listing | fields | many | explain), "doc_count_list")
        .when(preempt, "method_explanation")
        .when(listing & (many | (n > 0)), "doc_listing")
        .when(explain & ((n > 0) | topic), "method_explanation")
        .when(identify, "method_identification")
        .otherwise("general_qa")
    )

    def when_all(*pairs) -> Column:
        return F.array_compact(F.array(*[F.when(cond, F.lit(v)) for cond, v in pairs]))

    actions = when_all(
        (F.lit(True), "show_evidence"),
        (count, "count_docs"),
        (listing | fields, "list_docs"),
        (explain, "explain_method"),
        (steps, "extract_steps"),
        (compare, "compare_methods"),
        (topic, "identify_method"),
        (title, "show_title"),
        (author, "show_author"),
    )
    reasons = when_all(
        (count, "count_signal"),
        (listing | fields, "list_signal"),
        (explain, "explanation_signal"),
        (steps, "steps_signal"),
        (compare, "comparison_signal"),
        (preempt, "explanation_preempts_listing"),
    )
    staged = staged.select(
        "*", primary.alias("_primary"), actions.alias("_actions"), reasons.alias("_reasons")
    )
    main, locked = F.col("_primary"), F.size("_docs") > 0
    plan = F.struct(
        main.alias("primary_intent"),
        F.col("_actions").alias("requested_actions"),
        F.col("_topics").alias("target_topics"),
        F.when(compare, F.col("_topics")).otherwise(none).alias("comparison_targets"),
        locked.alias("doc_locked"),
        F.col("_docs").alias("allowed_doc_ids"),
        (
            main.isin("doc_count_list", "doc_listing")
            | ((main == "method_explanation") & many)
            | ((main == "single_target_steps") & ~locked)
        ).alias("needs_doc_aggregation"),
        (main == "method_explanation").alias("needs_explanation_expansion"),
        (main == "single_target_steps").alias("needs_steps_expansion"),
        many.alias("is_multi_doc"),
        (F.size("_actions") > 2).alias("is_compound"),
        count.alias("is_count_query"),
        listing.alias("is_list_query"),
        explain.alias("is_explanation_query"),
        steps.alias("is_steps_query"),
        compare.alias("is_comparison_query"),
        when_all((title, "title"), (author, "author")).alias("requested_fields"),
        F.when(F.size("_reasons") > 0, F.array_join("_reasons", "; "))
        .otherwise("fallback_general")
        .alias("planner_reason"),
    )
    return staged.select(*[F.col(c) for c in df.columns], plan.alias(name))


def history_text(history: Column) -> Column:
    """Questions and answer previews of past turns as one text."""
    return F.array_join(
        F.transform(
            history,
            lambda h: F.concat_ws(" ", text_or_empty(h["query"]), text_or_empty(h["answer_preview"])),
        ),
        " ",
    )


def history_has_context(history: Column, rules: RuleSet) -> Column:
    """Does any past turn carry a topic or talk about steps?"""

    def one(h: Column) -> Column:
        q = text_or_empty(h["query"])
        both = F.lower(F.concat_ws(" ", q, text_or_empty(h["answer_preview"])))
        return (
            (F.size(F.coalesce(h["topics"], F.array().cast("array<string>"))) > 0)
            | is_steps_question(q, rules)
            | is_topic_question(q, rules)
            | matches(both, rules.patterns["q_history_context"])
        )

    return F.coalesce(F.exists(history, one), F.lit(False))


def is_compression_followup(c: Column | str, history: Column, rules: RuleSet) -> Column:
    return is_compression(c, rules) & history_has_context(history, rules)


def target_topics(c: Column | str, history: Column, rules: RuleSet) -> Column:
    """Topics of the question, else those stored on past turns, else those in
    the text of past turns (anaphoric, multi-target and step questions only)."""
    none = F.array().cast("array<string>")
    own = topics_in(c, rules)
    stored = F.array_distinct(
        F.filter(
            F.flatten(F.transform(history, lambda h: F.coalesce(h["topics"], none))),
            lambda t: t != "",
        )
    )
    blob = history_text(history)
    follow = is_anaphora(c, rules) | is_multi_target(c, rules) | is_steps_question(c, rules)
    return (
        F.when(F.size(own) > 0, own)
        .when(F.coalesce(F.size(history), F.lit(0)) <= 0, none)
        .when(F.size(stored) > 0, stored)
        .when(follow, topics_in(blob, rules))
        .otherwise(none)
    )


def evidence_budget(
    c: Column | str, context_topics: Column, rules: RuleSet, *, default: int = 3, expanded: int = 5
) -> Column:
    more = is_multi_target(c, rules) | (is_anaphora(c, rules) & (F.size(context_topics) >= 2))
    return F.when(more, expanded).otherwise(default)


def rerank_size(
    *, multi_target: Column, steps: Column, topics: Column, base: int = 3, complex_: int = 5,
    scorer: bool = True, dynamic: bool = True,
) -> Column:
    """How many hits to keep after reranking."""
    hard = multi_target | steps | (F.size(F.array_distinct(topics)) >= 2)
    if not (scorer and dynamic):
        return F.lit(max(1, base))
    return F.greatest(F.when(hard, complex_).otherwise(base), F.lit(1))


def candidate_pool_size(
    top_k: int, *, candidate_k: int = 10, base: int = 3, complex_: int = 5,
    scorer: bool = True, dynamic: bool = True,
) -> int:
    """Hits to fetch before reranking."""
    if not scorer:
        return top_k
    return max(top_k, max(complex_ if dynamic else base, candidate_k))


def audit_summary(plan: Column, aggregation: Column | None = None) -> Column:
    """Flat record of the plan and of the document aggregation it led to."""
    none = F.array().cast("array<string>")

    def agg(name: str, default: Column) -> Column:
        return default if aggregation is None else F.coalesce(aggregation[name], default)

    return F.struct(
        F.when(plan["primary_intent"] != "", plan["primary_intent"]).alias("intent_primary"),
        F.array_distinct(F.concat(plan["target_topics"], plan["comparison_targets"])).alias(
            "intent_targets"
        ),
        plan["doc_locked"].alias("intent_doc_locked"),
        plan["needs_doc_aggregation"].alias("intent_needs_doc_aggregation"),
        plan["needs_explanation_expansion"].alias("intent_needs_explanation_expansion"),
        plan["needs_steps_expansion"].alias("intent_needs_steps_expansion"),
        agg("executed", F.lit(False)).alias("doc_aggregation_executed"),
        agg("applied", F.lit(False)).alias("doc_aggregation_applied"),
        agg("target_topic", F.lit(None).cast("string")).alias("doc_aggregation_target_topic"),
        agg("candidate_doc_count", F.lit(0)).alias("doc_aggregation_candidate_doc_count"),
        agg("accepted_doc_count", F.lit(0)).alias("doc_aggregation_accepted_doc_count"),
        agg("accepted_doc_ids", none).alias("doc_aggregation_accepted_doc_ids"),
    )
