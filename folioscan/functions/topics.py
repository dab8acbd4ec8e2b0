"""Topic and step signals as column expressions (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscan.functions.text import (
    contains_any,
    col,
    count_matches,
    matches,
    squeeze,
    strip,
    text_or_empty,
)
from folioscan.rules import RuleSet, Topic


def topic_text(c: Column | str) -> Column:
    """Split camel case, turn ``_`` and ``-`` to blanks, squeeze, lower."""
    s = F.regexp_replace(text_or_empty(c), r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"[_\-]+", " ")
    return F.lower(squeeze(s))


def normal(c: Column | str, ready: bool = False) -> Column:
    """Squeezed lower case; ``ready`` says the column holds that already."""
    return col(c) if ready else F.lower(squeeze(c))


def topics_in(c: Column | str, rules: RuleSet) -> Column:
    """Names of the topics a text mentions, in rule order."""
    t = topic_text(c)
    found = [F.when(matches(t, topic.mention), F.lit(topic.name)) for topic in rules.topics]
    return F.array_compact(F.array(*found))


def mentions(c: Column | str, topic: Topic, ready: bool = False) -> Column:
    """Direct mention: no camel-case or underscore splitting."""
    return matches(normal(c, ready), topic.mention)


def id_hint(doc_id: Column | str, topic: Topic) -> Column:
    return contains_any(F.lower(text_or_empty(doc_id)), topic.id_hints)


def supports(doc_id: Column | str, text: Column | str, topic: Topic) -> Column:
    """Id hint, else strict pattern, else (unless strict only) any mention."""
    low = F.lower(text_or_empty(text))
    out = id_hint(doc_id, topic) | matches(low, topic.strict)
    return out if topic.strict_only else out | matches(topic_text(low), topic.mention)


def strong_cue(c: Column | str, topic: Topic, ready: bool = False) -> Column:
    t = normal(c, ready)
    return (t != "") & matches(t, topic.strong or (rf"\b{topic.name.lower()}\b",))


def metadata_blob(*parts: Column | str) -> Column:
    return F.concat_ws(" | ", *[text_or_empty(p) for p in parts])


def strongly_supports(
    doc_id: Column | str, text: Column | str, blob: Column, topic: Topic
) -> Column:
    return (
        id_hint(doc_id, topic)
        | strong_cue(blob, topic)
        | strong_cue(text, topic)
        | supports(doc_id, text, topic)
    )


def named_topics(flags: dict[str, Column]) -> Column:
    """Array of the topic names whose flag holds, in the given order."""
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))


def drop_doc_header(c: Column | str) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"(?im)^DOC:\s.*\n", ""))


def has_steps_signal(c: Column | str, rules: RuleSet) -> Column:
    t = strip(F.regexp_replace(F.lower(text_or_empty(c)), r"(?im)^doc:\s.*\n", ""))
    stage = count_matches(t, [rf"\b{w}\b" for w in rules.word_lists["stage_terms"]])
    return (
        matches(t, rules.patterns["steps_word"])
        | t.rlike(r"(?m)^\s*(\d+[\.\)]|[a-c][\.\)]|[-•])\s+")
        | (matches(t, rules.patterns["list_connector"]) & (stage >= 2))
    )


def steps_strength(c: Column | str, ready: bool = False) -> Column:
    """0..20; 4 and more counts as a real description of steps."""
    t = normal(c, ready)

    def points(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return (
        points(t.contains("langkah-langkah") | t.contains("langkah langkah"), 4)
        + points(t.contains("tahapan"), 4)
        + points(matches(t, r"\btiga\s+tahapan\b"), 3)
        + points(matches(t, r"\bfase\b"), 2)
        + points(t.rlike(r"(?:^|\s)1\.\s"), 2)
        + points(t.rlike(r"(?:^|\s)2\.\s"), 2)
        + points(t.rlike(r"(?:^|\s)3\.\s"), 2)
        + points(matches(t, r"\btahap\b"), 1)
    )


STRONG_STEPS = 4


def has_owner_cue(c: Column | str, rules: RuleSet, ready: bool = False) -> Column:
    return matches(normal(c, ready), rules.pattern_lists["owner_cue"])


def looks_like_related_work(
    text: Column | str, label: Column | str, rules: RuleSet, ready: bool = False
) -> Column:
    return F.upper(text_or_empty(label)).isin(*rules.literature_labels) | matches(
        normal(text, ready), rules.pattern_lists["related_work"]
    )


def looks_like_artifact(c: Column | str, rules: RuleSet, ready: bool = False) -> Column:
    """Design artefacts named as words (diagrams, test sheets)."""
    return matches(normal(c, ready), rules.pattern_lists["artifact"])


def contains_artifact_word(c: Column | str, rules: RuleSet) -> Column:
    """The looser substring form used on single list items."""
    return contains_any(F.lower(squeeze(c)), rules.word_lists["artifact_words"])


def explain_strength(c: Column | str, rules: RuleSet, ready: bool = False) -> Column:
    return count_matches(normal(c, ready), rules.pattern_lists["explain_signal"])


def steps_bias_strength(c: Column | str, rules: RuleSet, ready: bool = False) -> Column:
    t = normal(c, ready)
    return count_matches(t, rules.pattern_lists["steps_bias"]) + F.least(
        steps_strength(t, True), F.lit(6)
    )
