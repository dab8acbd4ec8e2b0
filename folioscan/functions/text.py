"""String column helpers shared by the operators.

Patterns follow Python's Unicode meaning of ``\\w``, ``\\s`` and ``\\b``; the JVM
needs the inline flag ``(?U)`` for that.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: characters of a word, spelled out so that accents survive in every engine
WORD_CLASS = r"\p{L}\p{N}_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


#: every white-space character of Unicode
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Trim all white space, newlines included (``trim`` only knows blanks)."""
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def union_pattern(patterns: Iterable[str], flags: str = "U") -> str:
    """One alternation, so that a text is scanned once for a whole list."""
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns)


def matches(c: Column | str, patterns: str | Iterable[str], flags: str = "U") -> Column:
    """Any of the patterns occurs.  Rule patterns are lower case and meet
    lower-cased text; ``flags="iU"`` ignores case on raw text (slower)."""
    pats = (patterns,) if isinstance(patterns, str) else tuple(patterns)
    if not pats:
        return F.lit(False)
    return text_or_empty(c).rlike(union_pattern(pats, flags))


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text_or_empty(c).contains(w)
    return out


def count_matches(c: Column | str, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur at least once."""
    out = F.lit(0)
    for p in patterns:
        out = out + matches(c, p).cast("int")
    return out


def split_lines(c: Column | str) -> Column:
    return F.split(text_or_empty(c), r"\r\n|[\n\r]")


def stripped_lines(c: Column | str) -> Column:
    """Non-blank lines, trimmed, in order."""
    return F.filter(F.transform(split_lines(c), strip), lambda x: x != "")


def distinct_in_order(arr: Column) -> Column:
    """``array_distinct`` keeps first occurrences in order."""
    return F.array_distinct(arr)


def ellipsis(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def short_snippet(c: Column | str, n: int = 280) -> Column:
    """White space squeezed; cut at ``n`` characters, trailing blanks removed."""
    t = squeeze(c)
    cut = F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))
    return F.when(F.length(t) <= n, t).otherwise(cut)


def trim_marked(c: Column | str, n: int) -> Column:
    """Trim to ``n`` characters and say so in the text."""
    return ellipsis(strip(text_or_empty(c)), n, " ...<trimmed>")


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(
        F.lower(c).endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))
    ).otherwise(c)


def file_stem(c: Column | str) -> Column:
    """Last path part without its extension."""
    name = F.element_at(F.split(text_or_empty(c), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def words_of(c: Column | str, min_len: int, alphabet: str = "a-zA-Z") -> Column:
    """Lower-cased ASCII words of at least ``min_len`` characters, in order."""
    return F.regexp_extract_all(
        F.lower(text_or_empty(c)), F.lit(f"([{alphabet}]{{{min_len},}})"), 1
    )


def keywords(
    c: Column | str, stop: Iterable[str], *, min_len: int, max_terms: int | None = None,
    alphabet: str = "a-zA-Z",
) -> Column:
    """First ``max_terms`` distinct words outside the stop list."""
    stop_set = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    kept = F.array_except(F.array_distinct(words_of(c, min_len, alphabet)), stop_set)
    return kept if max_terms is None else F.slice(kept, 1, max_terms)


def let(value: Column, body) -> Column:
    """Bind a costly value to a lambda variable, so that it is computed once.

    The optimizer inlines a column that is referenced once, also into the
    lambda of a higher-order function, where it would run for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def count_hits(terms: Column, hay: Column) -> Column:
    """Number of terms that occur as substrings."""
    return let(hay, lambda h: F.size(F.filter(terms, lambda t: F.contains(h, t))))


def quote_snippet(c: Column | str, patterns: Iterable[str], max_len: int = 220) -> Column:
    """80 characters before and 140 after the first pattern that hits.

    Patterns are tried in order: the first pattern of the list with any hit
    decides, not the earliest position.
    """
    s = squeeze(c)
    low = F.lower(s)
    pos = F.lit(None).cast("int")
    for p in reversed(list(patterns)):
        # the text before the hit gives its 0-based offset
        before = F.regexp_extract(low, rf"(?sU)^(.*?)(?:{p})", 1)
        pos = F.when(low.rlike(f"(?sU){p}"), F.length(before)).otherwise(pos)
    start = F.greatest(F.lit(0), pos - 80)
    end = F.least(F.length(s), pos + 140)
    around = strip(F.substring(s, start + 1, end - start))
    return F.when(s == "", "").when(pos.isNull(), ellipsis(s, max_len)).otherwise(
        ellipsis(around, max_len)
    )
