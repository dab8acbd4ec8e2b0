"""Shape of the rule data the operators take."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Topic:
    """One topic: how a text mentions it, and how a chunk or file owns it."""

    name: str
    label: str
    mention: tuple[str, ...]
    id_hints: tuple[str, ...] = ()
    strict: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    style: tuple[str, ...] = ()
    style_summary: str = ""
    aliases: tuple[str, ...] = ()
    #: a loose mention is never enough to count as support
    strict_only: bool = False


@dataclass(frozen=True)
class FileRule:
    """File-name rule: first match gives stream and label of the whole file."""

    pattern: str
    stream: str | None
    label: str


@dataclass(frozen=True)
class RuleSet:
    topics: tuple[Topic, ...]
    patterns: Mapping[str, str] = field(default_factory=dict)
    pattern_lists: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    word_lists: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    templates: Mapping[str, object] = field(default_factory=dict)
    #: topic and its lists of patterns; a text needs one of every list
    free_text_topics: tuple[tuple[str | tuple[str, ...], ...], ...] = ()
    file_rules: tuple[FileRule, ...] = ()
    numerals: Mapping[str, str] = field(default_factory=dict)
    label_streams: Mapping[str, str] = field(default_factory=dict)
    owner_labels: tuple[str, ...] = ()
    literature_labels: tuple[str, ...] = ()
    process_labels: tuple[str, ...] = ()

    def words(self, *names: str) -> tuple[str, ...]:
        """Union of word lists, first-seen order."""
        return tuple(dict.fromkeys(w for n in names for w in self.word_lists[n]))
