"""Lists of steps found in a text (column functions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from folioscan.functions.text import contains_any, squeeze, stripped_lines, text_or_empty
from folioscan.functions.topics import contains_artifact_word, drop_doc_header, looks_like_artifact
from folioscan.rules import RuleSet

ITEM_MARK = r"^(\d+[\.\)]|[-•])\s+"
ITEM_EDGES = r"^[ ;:\-\n\t]+|[ ;:\-\n\t]+\z"


def listed_items(c: Column | str) -> Column:
    """Lines that start with a number or a bullet, mark removed."""
    marked = F.filter(stripped_lines(c), lambda x: x.rlike(ITEM_MARK))
    items = F.transform(marked, lambda x: F.trim(F.regexp_replace(x, ITEM_MARK, "")))
    return F.filter(items, lambda x: x != "")


def connected_items(c: Column, rules: RuleSet) -> Column:
    """The list after a connector such as "consists of", split at commas."""
    tail = F.regexp_extract(c, f"(?i){rules.patterns['list_after_connector']}", 3)
    parts = F.split(tail, rules.patterns["list_split"])
    return F.filter(
        F.transform(
            F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(p, ITEM_EDGES, "")
        ),
        lambda p: p != "",
    )


def _distinct_ignoring_case(arr: Column) -> Column:
    low = F.transform(arr, F.lower)
    first = F.transform(arr, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x))
    return F.filter(first, lambda x: x.isNotNull())


def valid_step_items(c: Column | str, rules: RuleSet, *, max_items: int = 5) -> Column:
    """Listed items, else the list after a connector, without artefacts,
    captions, items under 5 characters and repeats."""
    listed = listed_items(c)
    items = F.when(F.size(listed) >= 2, listed).otherwise(connected_items(squeeze(c), rules))
    tidy = F.transform(items, squeeze)
    good = F.filter(
        tidy,
        lambda x: (F.length(x) >= 5)
        & ~looks_like_artifact(x, rules)
        & ~x.rlike(f"(?i){rules.patterns['caption']}"),
    )
    return F.slice(_distinct_ignoring_case(good), 1, max_items)


def looks_like_step(x: Column, rules: RuleSet) -> Column:
    """A stage word is required; artefacts and captions are refused."""
    s = F.lower(squeeze(x))
    return (
        (F.length(s) >= 4)
        & ~contains_artifact_word(s, rules)
        & ~s.rlike(f"(?i){rules.patterns['caption']}")
        & contains_any(s, rules.word_lists["step_item_words"])
    )


def extract_steps(c: Column | str, rules: RuleSet, *, max_items: int = 5) -> Column:
    """Steps in a context: at least two items that look like steps, else none."""
    s = drop_doc_header(text_or_empty(c))
    listed = listed_items(s)
    tail = F.slice(
        F.filter(F.transform(connected_items(s, rules), squeeze), lambda x: F.length(x) >= 5),
        1,
        max_items,
    )
    test: Callable[[Column], Column] = lambda x: looks_like_step(x, rules)
    from_list, from_tail = F.filter(listed, test), F.filter(tail, test)
    none = F.array().cast("array<string>")
    kept = F.when(F.size(listed) >= 2, from_list).otherwise(from_tail)
    return F.when(F.size(kept) >= 2, F.slice(kept, 1, max_items)).otherwise(none)


def merge_steps(lists: Column, max_items: int) -> Column:
    """Distinct steps of several contexts, first occurrence kept."""
    return F.slice(_distinct_ignoring_case(F.flatten(lists)), 1, max_items)
