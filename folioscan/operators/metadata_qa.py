"""Questions answered from the catalog: document references, page counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import (
    blank_to_null,
    matches,
    strip,
    strip_suffix,
    text_or_empty,
)
from folioscan.rules import RuleSet

ALIAS_FIELDS = ("doc_id", "source_file", "relative_path", "title", "author")
GRAM = 5


def is_page_count(c: Column | str, rules: RuleSet) -> Column:
    return matches(F.lower(text_or_empty(c)), rules.patterns["q_page_count"])


def doc_key(c: Column | str) -> Column:
    """File name without folder, quotes and ``.pdf``."""
    t = F.regexp_replace(strip(text_or_empty(c)), "^\"+|\"+\\z", "")
    t = F.regexp_replace(t, r"^'+|'+\z", "")
    t = F.element_at(F.split(F.replace(t, F.lit("\\"), F.lit("/")), "/"), -1)
    return strip(strip_suffix(t, ".pdf"))


def loose(c: Column | str) -> Column:
    """Lower-cased letters and digits of the key only."""
    return F.regexp_replace(F.lower(doc_key(c)), r"[^a-z0-9]+", "")


def loose_tokens(c: Column | str, rules: RuleSet) -> Column:
    stop = F.array(*[F.lit(w) for w in rules.word_lists["stop_alias"]])
    words = F.filter(F.split(F.lower(text_or_empty(c)), r"[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    return F.array_except(F.array_distinct(words), stop)


def explicit_ref(c: Column | str) -> Column:
    """Quoted text, else ``x.pdf``."""
    quoted = strip(F.regexp_extract(text_or_empty(c), '["“](.+?)["”]', 1))
    named = F.regexp_extract(text_or_empty(c), r"(?i)([a-z0-9_\-]+\.pdf)\b", 1)
    return F.coalesce(
        F.when(quoted != "", doc_key(quoted)), F.when(named != "", doc_key(named))
    )


def natural_ref(c: Column | str, rules: RuleSet) -> Column:
    """Words after "document", "file" and the like."""
    found = strip(F.regexp_extract(strip(text_or_empty(c)), f"(?i){rules.patterns['q_doc_after_noun']}", 1))
    return blank_to_null(strip(F.regexp_replace(found, r"[\?\!\.,;:]+\z", "")))


def aliases(catalog: DataFrame) -> DataFrame:
    """Names a document may be called by: ``doc_id, ord, alias``.

    For each of five fields the value, its key, the parts of the key and the
    parts joined by blanks.
    """
    def names(field: str) -> Column:
        if field not in catalog.columns:
            return F.array().cast("array<string>")
        raw = strip(text_or_empty(F.col(field).cast("string")))
        key = doc_key(raw)
        parts = F.filter(F.split(key, r"[_\-/]+"), lambda p: p != "")
        joined = F.when(F.size(parts) >= 2, F.array(F.array_join(parts, " "))).otherwise(
            F.array().cast("array<string>")
        )
        every = F.concat(F.array(raw, key), parts, joined)
        return F.when(raw != "", every).otherwise(F.array().cast("array<string>"))

    order = F.col("ord") if "ord" in catalog.columns else F.col("doc_id")
    all_names = F.array_distinct(
        F.filter(
            F.transform(F.concat(*[names(f) for f in ALIAS_FIELDS]), strip), lambda a: a != ""
        )
    )
    return catalog.select("doc_id", order.alias("ord"), F.explode(all_names).alias("alias"))


def alias_score(query: Column | str, alias: Column | str, rules: RuleSet) -> Column:
    """100 equal, 85 or 70 contained, else 40..79 by token overlap, 0 none."""
    q, a = loose(query), loose(alias)
    qt, at = loose_tokens(query, rules), loose_tokens(alias, rules)
    both = F.array_intersect(qt, at)
    shorter = F.least(F.length(q), F.length(a))
    share = F.size(both) / F.greatest(F.size(qt), F.lit(1))
    long_one = F.exists(both, lambda t: F.length(t) >= 8)
    overlap = F.lit(40) + F.floor(share * 40).cast("int") + F.when(long_one, 10).otherwise(0)
    return (
        F.when((q == "") | (a == ""), 0)
        .when(q == a, 100)
        .when(F.contains(a, q) | F.contains(q, a), F.when(shorter >= 5, 85).otherwise(70))
        .when(F.size(both) == 0, 0)
        .otherwise(F.least(overlap, F.lit(79)))
    )


def _pieces(text: str) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(GRAM))))


def _grams(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(text) >= GRAM).select("*", F.explode(_pieces(text)).alias("gram"))


def _contained(inner: DataFrame, outer: DataFrame, i: str, o: str, few: bool) -> DataFrame:
    """Pairs where ``i`` occurs inside ``o``, exactly, without a nested loop; further columns stay.

    A text that contains another contains each of its 5-grams; the rarest one
    of the inner text is the join key, so a gram in a third of the names is
    used only by texts made of nothing rarer.  Grams that one side lacks are dropped
    first, and an inner text that loses one is nowhere.  ``few``: the texts of one side
    are few by count, and their grams are sent to the other's; else both are shuffled,
    as the size of exploded grams is not known to the planner.
    """
    small = F.broadcast if few else lambda df: df.hint("merge")
    inner_grams, outer_grams = _grams(inner, i), _grams(outer, o)
    wanted = outer_grams.join(small(inner_grams.select("gram").distinct()), "gram", "left_semi")
    freq = wanted.groupBy("gram").agg(F.count("*").alias("n"))
    keyed = (
        inner_grams.join(small(freq), "gram")
        .groupBy(*inner.columns)
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("found"))
        .where(F.col("found") == F.size(_pieces(i)))
        .drop("found")
    )
    return keyed.hint("merge").join(wanted, "gram").where(F.contains(F.col(o), F.col(i))).drop("gram")


def resolve_refs(refs: DataFrame, catalog: DataFrame, rules: RuleSet, *, few_grams: int = 100_000) -> DataFrame:
    """``refs(ref)`` to ``ref, doc_id, how``: exact id, exact file stem, alias.

    An alias counts with 80 points and more, that is when the loose forms are
    equal or one of at least 5 characters lies in the other; the best score
    wins, then catalog order.  Distinct references meet distinct aliases.
    Up to ``few_grams`` different 5-grams of references are broadcast, more are shuffled.
    """
    names = aliases(catalog).withColumn("a", loose("alias")).where(F.col("a") != "")
    docs = catalog.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (F.col("ord") if "ord" in catalog.columns else F.col("doc_id")).alias("ord"),
        F.lower(strip_suffix(text_or_empty("source_file"), ".pdf")).alias("stem"),
    ).hint("merge")
    asked = refs.select("ref").distinct().withColumn("key", doc_key("ref")).withColumn("q", loose("ref"))
    by_id = asked.join(docs, F.col("key") == F.col("doc_id")).select(
        "ref", "doc_id", "ord", F.lit(1).alias("prio"), F.lit(0).alias("minus")
    )
    by_stem = asked.join(docs, F.lower("key") == F.col("stem")).select(
        "ref", "doc_id", "ord", F.lit(2).alias("prio"), F.lit(0).alias("minus")
    )
    q = asked.where(F.col("q") != "").select("q").distinct()
    a = names.groupBy("a").agg(
        F.min(F.struct("ord", F.col("doc_id").cast("string").alias("doc_id"))).alias("d")
    ).persist()
    few = _grams(q, "q").select("gram").distinct().limit(few_grams + 1).count() <= few_grams
    equal = q.join(a.hint("merge"), F.col("q") == F.col("a")).select("q", "d", F.lit(-100).alias("minus"))
    inside = (
        _contained(q, a, "q", "a", few)
        .unionByName(_contained(a, q, "a", "q", few))
        .where(F.col("q") != F.col("a"))
        .select("q", "d", F.lit(-85).alias("minus"))
    )
    best = (
        equal.unionByName(inside)
        .groupBy("q")
        .agg(F.min(F.struct("minus", "d.ord", "d.doc_id")).alias("b"))
    )
    by_alias = asked.join(best.hint("merge"), "q").select(
        "ref", "b.doc_id", "b.ord", F.lit(3).alias("prio"), F.col("b.minus").alias("minus")
    )
    every = by_id.unionByName(by_stem).unionByName(by_alias)
    how = F.when(F.col("b.prio") == 1, "doc_id").when(F.col("b.prio") == 2, "file_stem").otherwise("alias")
    return (
        every.groupBy("ref")
        .agg(F.min(F.struct("prio", "minus", "ord", "doc_id")).alias("b"))
        .select("ref", "b.doc_id", how.alias("how"), (-F.col("b.minus")).alias("score"))
    )


def page_count_answers(queries: DataFrame, catalog: DataFrame, rules: RuleSet) -> DataFrame:
    """Answers to page-count questions with a reason code.

    ``queries(query_id, text)``; other questions give no row.  An explicit
    reference that cannot be resolved falls back to the words after the noun.
    """
    asked = queries.where(is_page_count("text", rules)).select(
        "query_id", explicit_ref("text").alias("explicit"), natural_ref("text", rules).alias("natural")
    )
    refs = asked.select(F.explode(F.array_compact(F.array("explicit", "natural"))).alias("ref"))
    found = resolve_refs(refs, catalog, rules)
    e, n = found.alias("e"), found.alias("n")
    rows = asked.join(e, F.col("explicit") == F.col("e.ref"), "left").join(
        n, F.col("natural") == F.col("n.ref"), "left"
    )
    by_natural = F.col("e.doc_id").isNull() & F.col("n.doc_id").isNotNull()
    rows = rows.select(
        "query_id",
        F.when(by_natural, F.col("natural")).otherwise(F.coalesce("explicit", "natural")).alias("doc_ref"),
        F.coalesce("e.doc_id", "n.doc_id").alias("doc_id"),
        F.when(by_natural, "natural_language_alias")
        .when(F.col("e.doc_id").isNotNull(), "explicit_doc_ref")
        .alias("resolved_via"),
    )
    cat = catalog.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source_file", "page_count"
    )
    out = rows.join(cat, "doc_id", "left")
    reason = (
        F.when(F.col("doc_ref").isNull() & F.col("doc_id").isNull(), "missing_doc_ref")
        .when(F.col("doc_id").isNull(), "not_in_catalog")
        .when(F.col("page_count").isNull(), "missing_page_count_field")
        .otherwise("ok")
    )
    file = F.coalesce("source_file", F.concat(F.coalesce("doc_ref", F.lit("unknown")), F.lit(".pdf")))
    head = (
        F.when(reason == "missing_doc_ref",
               "Jawaban: Untuk menjawab jumlah halaman, sebutkan nama dokumen (filename/doc_id).")
        .when(reason == "not_in_catalog",
              F.concat(F.lit('Jawaban: Dokumen "'), F.col("doc_ref"),
                       F.lit('" tidak ditemukan pada katalog ingest.')))
        .when(reason == "missing_page_count_field",
              F.concat(F.lit('Jawaban: Katalog ingest untuk "'), file,
                       F.lit('" tidak memiliki field page_count.')))
        .otherwise(F.concat(F.lit('Jawaban: Dokumen "'), file, F.lit('" memiliki '),
                            F.col("page_count").cast("string"), F.lit(" halaman.")))
    )
    return out.select(
        "query_id", "doc_ref", "doc_id", "source_file", "page_count", reason.alias("reason"),
        F.when(reason == "ok", F.col("resolved_via")).alias("resolved_via"), head.alias("answer"),
    )
