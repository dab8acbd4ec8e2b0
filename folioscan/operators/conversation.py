"""Conversation history: windows, topic shifts, stand-alone questions.

Turns are addressed by their position in the conversation and joined on
(conversation, position), never gathered per conversation; the one sequential
rule (a shift flag depends on earlier flags) is a scan over ``window + 1``
states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.intent import (
    history_has_context,
    history_text,
    is_anaphora,
    is_compression,
)
from folioscan.functions.text import (
    contains_any,
    ellipsis,
    keywords,
    let,
    matches,
    strip,
    text_or_empty,
)
from folioscan.functions.topics import topics_in
from folioscan.operators.expansion import topic_label
from folioscan.operators.ordered import finite_state_scan, position
from folioscan.rules import RuleSet
from folioscan.settings import HistorySettings

TURNS_PER_BIN = 1024
HISTORY = "array<struct<pos:bigint,turn:bigint,query:string,answer_preview:string,topics:array<string>>>"


def _bin(c: str) -> Column:
    return F.floor(F.col(c) / TURNS_PER_BIN)


def pair_turns(
    messages: DataFrame, rules: RuleSet, settings: HistorySettings = HistorySettings()
) -> DataFrame:
    """Each user message with the assistant message right after it.

    ``messages(conv_id, turn, role, text)`` to ``turns(conv_id, turn, pos,
    query, answer_preview, topics)``; other roles are dropped.  ``pos`` counts
    the user turns of a conversation from 1.
    """
    rows = messages.where(F.col("role").isin("user", "assistant"))
    placed = position(
        rows, keys=["conv_id"], bin=[_bin("turn")], order=[F.col("turn")], name="_at"
    )
    asked = placed.where(F.col("role") == "user").select(
        "conv_id", "turn", "_at", F.col("text").alias("query")
    )
    answered = placed.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("_at") - 1).alias("_at"), F.col("text").alias("_answer")
    )
    both = asked.join(answered, ["conv_id", "_at"], "left").withColumn(
        "_answer", text_or_empty("_answer")
    )
    not_found = F.lower(F.col("_answer")).contains(rules.patterns["not_found_sentence"])
    turns = both.select(
        "conv_id", "turn", "query",
        ellipsis(F.col("_answer"), settings.preview_chars).alias("answer_preview"),
        F.when(
            ~not_found, F.slice(topics_in("_answer", rules), 1, settings.max_topics)
        ).otherwise(F.array().cast("array<string>")).alias("topics"),
    )
    return position(turns, keys=["conv_id"], bin=[_bin("turn")], order=[F.col("turn")], name="pos")


def with_history(turns: DataFrame, n: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add ``history``: the last ``n`` turns before each turn, oldest first.

    Every turn is sent to the ``n`` positions after it; a group holds at most
    ``n`` rows.  ``extra`` columns of the past turns travel along.
    """
    item = F.struct("pos", "turn", "query", "answer_preview", "topics", *extra)
    sent = turns.select(
        "conv_id", item.alias("h"),
        F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + n)).alias("pos"),
    )
    past = sent.groupBy("conv_id", "pos").agg(F.sort_array(F.collect_list("h")).alias("history"))
    joined = turns.join(past, ["conv_id", "pos"], "left")
    return joined.withColumn("history", F.coalesce("history", F.slice(F.array(item), 1, 0)))


def _question_facts(query: Column, rules: RuleSet) -> Column:
    low = F.lower(query)
    return F.struct(
        (query == "").alias("empty"),
        contains_any(low, rules.word_lists["shift_markers"]).alias("marker"),
        is_compression(query, rules).alias("shorten"),
        is_anaphora(query, rules).alias("refers"),
        keywords(query, rules.word_lists["stop_topic"], min_len=3, alphabet="a-z0-9").alias("terms"),
    )


def _window_facts(size: Column, terms: Column, has_context: Column, asked: Column) -> Column:
    return let(
        terms,
        lambda t: F.struct(
            size.alias("turns"),
            F.size(t).alias("n_terms"),
            F.size(F.array_intersect(asked, t)).alias("shared"),
            has_context.alias("has_context"),
        ),
    )


def _decide(q: Column, w: Column, s: HistorySettings) -> Column:
    n = F.size(q["terms"])
    reason = (
        F.when(q["empty"], "empty_query")
        .when(w["turns"] <= 0, "no_history")
        .when(q["marker"], "explicit_marker")
        .when(q["shorten"] & w["has_context"], "compression_followup")
        .when(q["refers"], "anaphora")
        .when(F.least(n, w["n_terms"]) < s.min_terms, "too_few_terms")
        .otherwise("overlap_check")
    )
    share = w["shared"] / F.greatest(n, F.lit(1))

    def result(r: Column) -> Column:
        checked = r == "overlap_check"
        return F.struct(
            ((r == "explicit_marker") | (checked & (share < s.overlap_threshold))).alias("is_shift"),
            r.alias("reason"),
            F.when(checked, F.round(share, 6)).alias("overlap"),
        )

    return let(reason, result)


def topic_shift(
    query: Column | str, history: Column, rules: RuleSet,
    settings: HistorySettings = HistorySettings(),
) -> Column:
    """Struct ``is_shift, reason, overlap`` for a question and its history.

    An explicit marker is a shift; a follow-up that shortens or refers back is
    not; else the share of the question's content terms that the history knows
    must stay below the threshold, with enough terms on both sides.
    """
    past = keywords(
        history_text(history), rules.word_lists["stop_topic"], min_len=3, alphabet="a-z0-9"
    )
    return let(
        _question_facts(strip(text_or_empty(query)), rules),
        lambda q: let(
            _window_facts(F.size(history), past, history_has_context(history, rules), q["terms"]),
            lambda w: _decide(q, w, settings),
        ),
    )


def _window_for(state: int, history: Column, pos: Column, anaphora: Column, s: HistorySettings) -> Column:
    """The turns a question sees when the last shift lies ``state`` turns back
    (0: none among the last ``window``)."""
    w = s.window
    last = F.filter(history, lambda h: h["pos"] >= pos - w)
    seen = last
    if s.segment_on_shift and state:
        seen = F.filter(last, lambda h: h["pos"] >= pos - state)
    if state == 1 and s.anaphora_skips_last_shift:
        before = F.filter(history, lambda h: h["pos"] <= pos - 2)
        seen = F.when(anaphora, before).otherwise(seen)
    return seen


def conversation_windows(
    turns: DataFrame, rules: RuleSet, settings: HistorySettings = HistorySettings()
) -> DataFrame:
    """History window and shift flag of every turn.

    The window is cut at the last shift (which stays in it); a question that
    refers back right after a shift sees the turns before the shift.  The flag
    of a turn is computed for each possible distance of the last shift, and a
    scan over the conversation picks the one that holds.
    """
    w = settings.window
    # what a turn contributes to later windows is worked out once per turn
    own = turns.select(
        "conv_id", "turn", "pos", "query", "answer_preview", "topics",
        _question_facts(strip(text_or_empty("query")), rules).alias("_q"),
        keywords(
            F.concat_ws(" ", text_or_empty("query"), text_or_empty("answer_preview")),
            rules.word_lists["stop_topic"], min_len=3, alphabet="a-z0-9",
        ).alias("_terms"),
        history_has_context(F.array(F.struct("query", "answer_preview", "topics")), rules).alias("_ctx"),
    )
    rows = with_history(own, w + 1, ("_terms", "_ctx"))
    options = [
        _window_for(d, F.col("history"), F.col("pos"), F.col("_q.refers"), settings)
        for d in range(w + 1)
    ]
    rows = rows.withColumn("_windows", F.array(*options))
    facts = F.transform(
        "_windows",
        lambda x: _window_facts(
            F.size(x),
            F.array_distinct(F.flatten(F.transform(x, lambda h: h["_terms"]))),
            F.exists(x, lambda h: h["_ctx"]),
            F.col("_q.terms"),
        ),
    )
    tests = rows.withColumn("_tests", F.transform(facts, lambda f: _decide(F.col("_q"), f, settings)))
    after = F.transform(
        "_tests",
        lambda t, d: F.when(t["is_shift"], 1)
        .when((d == 0) | (d >= w), 0)
        .otherwise(d + 1)
        .cast("bigint"),
    )
    tests = tests.withColumn("_next", after).persist()  # read by the scan and by the final join

    def step(state: int, nxt: object) -> int:
        return int(nxt[state])

    scanned = finite_state_scan(
        tests.select("conv_id", "pos", "_next"), keys=["conv_id"], order="pos",
        bin=F.floor(F.col("pos") / TURNS_PER_BIN), payload="_next", n_states=w + 1, step=step,
        starts=lambda s: False,
    ).select("conv_id", "pos", F.col("state").cast("int").alias("_state"))
    joined = tests.join(scanned, ["conv_id", "pos"])
    test = F.get("_tests", F.col("_state"))
    window = F.get("_windows", F.col("_state"))
    return joined.select(
        "conv_id", "turn", "pos", "query", "answer_preview", "topics",
        F.transform(window, lambda h: h.dropFields("_terms", "_ctx")).alias("window"),
        (F.col("_q.refers") & (F.col("_state") == 1) & F.lit(settings.anaphora_skips_last_shift)).alias(
            "used_pre_shift"
        ),
        test["is_shift"].alias("is_shift"),
        test["reason"].alias("shift_reason"),
        test["overlap"].alias("overlap"),
    )


# -- stand-alone questions ---------------------------------------------------------


def _labels(topics: Column, rules: RuleSet) -> Column:
    return F.array_join(F.transform(topics, lambda t: topic_label(t, rules)), ", ")


def steps_standalone(topics: Column, rules: RuleSet, *, summary: bool = False) -> Column:
    """Template question for the steps of the topics; empty without topics."""
    template = rules.templates["steps_summary_standalone" if summary else "steps_standalone"]
    names = F.filter(topics, lambda t: t != "")
    text = F.replace(F.lit(template), F.lit("{labels}"), _labels(names, rules))
    return F.when(F.size(names) > 0, text).otherwise("")


def context_rewrite(query: Column | str, history: Column, rules: RuleSet) -> Column:
    """Question plus the newest answer (else question) of the history."""
    q = strip(text_or_empty(query))
    last = F.try_element_at(history, F.lit(-1))
    answer = strip(text_or_empty(last["answer_preview"]))
    focus = F.when(answer != "", answer).otherwise(strip(text_or_empty(last["query"])))
    filled = F.replace(
        F.replace(F.lit(rules.templates["context_rewrite"]), F.lit("{query}"), q),
        F.lit("{focus}"), ellipsis(focus, 260),
    )
    return F.when((F.size(history) <= 0) | (focus == "") | (q == ""), q).otherwise(filled)


def is_weak_rewrite(rewrite: Column | str, history: Column, rules: RuleSet) -> Column:
    """Too short, still referring back, or without a focus term of the last turn."""
    r = strip(text_or_empty(rewrite))
    low = F.lower(r)
    last = F.try_element_at(history, F.lit(-1))
    past = F.concat_ws(
        " ", strip(text_or_empty(last["query"])), strip(text_or_empty(last["answer_preview"]))
    )
    focus = keywords(past, rules.words("stop_qa", "stop_focus_extra"), min_len=3, max_terms=8)
    n_words = F.size(F.filter(F.split(r, r"\s+"), lambda x: x != ""))
    misses = let(
        focus, lambda f: (F.size(f) > 0) & ~F.exists(f, lambda t: F.contains(low, t))
    )
    return (n_words < 4) | matches(low, rules.patterns["q_pronoun"]) | misses


def standalone_question(
    query: Column | str, history: Column, topics: Column, rules: RuleSet, *,
    steps_followup: Column, compression_followup: Column, rewrite: Column | None = None,
) -> Column:
    """Templates for step follow-ups, else a caller-supplied rewrite that is
    not weak, else the question with its context."""
    fallback = context_rewrite(query, history, rules)
    if rewrite is not None:
        weak = is_weak_rewrite(rewrite, history, rules)
        fallback = F.when((F.size(history) > 0) & ~weak, strip(rewrite)).otherwise(fallback)
    has = F.size(topics) > 0
    return (
        F.when(compression_followup & has, steps_standalone(topics, rules, summary=True))
        .when(steps_followup & has, steps_standalone(topics, rules))
        .otherwise(fallback)
    )


def history_block(history: Column, *, max_chars: int = 1200) -> Column:
    """User and assistant lines of the past turns, the last ``max_chars``."""
    lines = F.transform(
        F.filter(history, lambda h: strip(text_or_empty(h["query"])) != ""),
        lambda h: F.concat(
            F.lit("User: "), strip(h["query"]), F.lit("\nAssistant: "),
            ellipsis(strip(text_or_empty(h["answer_preview"])), 240),
        ),
    )

    def tail(t: Column) -> Column:
        cut = F.when(F.length(t) > max_chars, F.right(t, F.lit(max_chars))).otherwise(t)
        return F.when(cut != "", cut).otherwise("(no history)")

    return let(strip(F.array_join(lines, "\n\n")), tail)
