"""Metadata filters, free-text filters and document focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import blank_to_null, col, strip, text_or_empty
from folioscan.functions.windows import by_query
from folioscan.rules import RuleSet

FIELDS = ("year", "program", "author")


def valid_year(c: Column | str, low: int = 2000, high: int = 2030) -> Column:
    """Year as INT; accepts ``2023.0``; outside the range or unreadable is null."""
    year = col(c).cast("string").try_cast("double").cast("int")
    return F.when(year.between(low, high), year)


def valid_name(c: Column | str, rules: RuleSet) -> Column:
    """Text longer than 2 characters that is no placeholder."""
    t = strip(text_or_empty(c))
    low = F.lower(t)
    bad = low.isin(*rules.word_lists["undetected"], "null", "none")
    return F.when(~bad & (F.length(t) > 2), t)


def json_in_text(c: Column | str) -> Column:
    """JSON inside free text: fenced block, else first ``{`` to last ``}``."""
    t = strip(text_or_empty(c))
    fenced = strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.+?)\s*```", 1))
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(blank_to_null(fenced), blank_to_null(braces))


FIELD_SCHEMA = "semantic_query STRING, query STRING, tahun STRING, prodi STRING, penulis STRING"


def fields_from_json(queries: DataFrame, json_col: str, rules: RuleSet) -> DataFrame:
    """Parse a caller-supplied answer column to checked filter fields.

    Adds ``semantic_query, f_year, f_program, f_author, fallback_reason``; the
    reason tells why a row has no filter (nothing found, not an object, no
    valid field).
    """
    located = json_in_text(json_col)
    parsed = F.from_json(located, FIELD_SCHEMA)
    is_object = located.startswith("{")
    out = (
        queries.withColumn("_located", located)
        .withColumn("_parsed", F.when(is_object, parsed))
        .withColumn(
            "_valid_json",
            F.col("_located").isNotNull() & F.get_json_object("_located", "$").isNotNull(),
        )
    )
    own = blank_to_null(
        strip(
            F.coalesce(
                blank_to_null(F.col("_parsed.semantic_query")),
                F.col("_parsed.query"),
                F.lit(""),
            )
        )
    )
    out = (
        out.withColumn("f_year", F.when(F.col("_valid_json"), valid_year("_parsed.tahun")))
        .withColumn("f_program", F.when(F.col("_valid_json"), valid_name("_parsed.prodi", rules)))
        .withColumn("f_author", F.when(F.col("_valid_json"), valid_name("_parsed.penulis", rules)))
    )
    has = F.coalesce(F.col("f_year").cast("string"), "f_program", "f_author").isNotNull()
    reason = (
        F.when(strip(text_or_empty("text")) == "", "empty_query")
        .when(F.col("_located").isNull(), "json_extraction_failed:empty_output")
        .when(~F.col("_valid_json"), "json_parse_failed")
        .when(~F.col("_located").startswith("{"), "json_not_a_dict")
        .when(~has, "no_valid_filters_extracted")
    )
    return (
        out.withColumn("fallback_reason", reason)
        .withColumn(
            "semantic_query", F.when(reason.isNull(), F.coalesce(own, "text")).otherwise(F.col("text"))
        )
        .drop("_located", "_parsed", "_valid_json")
    )


def split_query(queries: DataFrame, rules: RuleSet, *, text: str = "text") -> DataFrame:
    """Rule-based split of a question into filter fields and semantic text."""
    p = rules.patterns
    year = F.regexp_extract(text, f"(?i){p['f_year']}", 1)
    program = strip(F.regexp_extract(text, f"(?i){p['f_program']}", 1))
    author = strip(F.regexp_extract(text, f"(?i){p['f_author']}", 1))
    rest = col(text)
    for name in ("f_year", "f_program", "f_author"):
        rest = F.regexp_replace(rest, f"(?i){p[name]}", " ")
    rest = F.trim(F.regexp_replace(rest, r"\s+", " "))
    return (
        queries.withColumn("f_year", valid_year(blank_to_null(year)))
        .withColumn("f_program", valid_name(program, rules))
        .withColumn("f_author", valid_name(author, rules))
        .withColumn("semantic_query", F.coalesce(blank_to_null(rest), col(text)))
    )


def limit_fields(queries: DataFrame, max_fields: int = 2) -> DataFrame:
    """Keep at most ``max_fields`` (1..3) filters, in order year, program, author.

    Adds ``filter_fields_used`` and ``filter_applied``; dropped fields turn null.
    """
    n = max(1, min(max_fields, len(FIELDS)))
    named = F.array_compact(
        F.array(*[F.when(F.col(f"f_{f}").isNotNull(), F.lit(f)) for f in FIELDS])
    )
    out = queries.withColumn("filter_fields_used", F.slice(named, 1, n))
    for f in FIELDS:
        out = out.withColumn(
            f"f_{f}", F.when(F.array_contains("filter_fields_used", f), F.col(f"f_{f}"))
        )
    return out.withColumn("filter_applied", F.size("filter_fields_used") > 0)


def row_passes(
    year: Column | str = "year", program: Column | str = "program", author: Column | str = "author"
) -> Column:
    """Does a chunk pass the filter of the query it is paired with?"""
    return (
        (F.col("f_year").isNull() | F.coalesce(col(year) == F.col("f_year"), F.lit(False)))
        & (
            F.col("f_program").isNull()
            | F.coalesce(F.contains(col(program), F.col("f_program")), F.lit(False))
        )
        & (
            F.col("f_author").isNull()
            | F.coalesce(F.contains(col(author), F.col("f_author")), F.lit(False))
        )
    )


GRAM = 3


def _grams(text: Column, n: int) -> Column:
    if n == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def _filters_with_hits(asked: DataFrame, values: DataFrame) -> DataFrame:
    """The filters that at least one row of metadata values passes.

    A year alone is an equi-join.  A contained name is looked up by the rarest of its
    grams, so that a filter only meets values that may hold it, up to the first that does.
    """
    by_year = asked.where("f_program IS NULL AND f_author IS NULL").join(
        values, F.col("year") == F.col("f_year"), "left_semi"
    )
    kinds = [F.lit("program").alias("kind"), F.lit("author").alias("kind")]
    grams = None
    for kind, name in zip(kinds, ("program", "author")):
        text = F.col(name)
        every = F.array_distinct(F.concat(*[_grams(text, n) for n in range(GRAM + 1)]))
        part = values.where(text.isNotNull()).select("year", "program", "author", kind, F.explode(every).alias("gram"))
        grams = part if grams is None else grams.unionByName(part)
    named = asked.where("f_program IS NOT NULL OR f_author IS NOT NULL").select(
        "*",
        F.when(F.col("f_program").isNotNull(), "program").otherwise("author").alias("kind"),
        F.coalesce("f_program", "f_author").alias("name"),
    )
    size = F.least(F.length("name"), F.lit(GRAM))
    own = F.when(size == 0, _grams(F.col("name"), 0))
    for n in range(1, GRAM + 1):
        own = own.when(size == n, _grams(F.col("name"), n))
    counts = grams.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    filter_cols = ["f_year", "f_program", "f_author"]
    rarest = (
        named.select(*filter_cols, "kind", F.explode(own).alias("gram"))
        .join(counts, ["kind", "gram"], "left")
        .groupBy(*filter_cols, "kind")
        .agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    )
    r, g = rarest.alias("r"), grams.alias("g")
    same = (F.col("r.kind") == F.col("g.kind")) & (F.col("r.gram") == F.col("g.gram"))
    by_name = r.join(g, same & row_passes(), "left_semi").select(*filter_cols)
    return by_year.select(*filter_cols).unionByName(by_name)


def precheck(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drop a filter that matches no chunk, with reason ``precheck_no_results``.

    Only the distinct metadata values of the corpus meet the distinct filters,
    never chunks and queries: both sides shrink by a partial aggregation before
    anything is shuffled, and meet by equi-joins.
    """
    values = chunks.groupBy("year", "program", "author").agg(F.lit(True).alias("seen")).drop("seen")
    asked = (
        queries.where(F.col("filter_applied"))
        .select("f_year", "f_program", "f_author")
        .distinct()
    )
    hit = _filters_with_hits(asked, values).withColumn("filter_hits", F.lit(True))
    same = [F.col(f"q.f_{f}").eqNullSafe(F.col(f"h.f_{f}")) for f in FIELDS]
    joined = queries.alias("q").join(hit.alias("h"), same[0] & same[1] & same[2], "left")
    found = F.coalesce(F.col("h.filter_hits"), F.lit(False))
    failed = F.col("q.filter_applied") & ~found
    keep = [c for c in queries.columns if c not in
            ("filter_applied", "filter_fields_used", "fallback_reason", "f_year", "f_program", "f_author")]
    prior = F.col("q.fallback_reason") if "fallback_reason" in queries.columns else F.lit(None)
    return joined.select(
        *[F.col(f"q.{c}") for c in keep],
        *[F.when(~failed, F.col(f"q.f_{f}")).alias(f"f_{f}") for f in FIELDS],
        F.col("q.f_year").alias("asked_year"),
        F.col("q.f_program").alias("asked_program"),
        F.col("q.f_author").alias("asked_author"),
        (F.col("q.filter_applied") & found).alias("filter_applied"),
        F.when(failed, F.array().cast("array<string>"))
        .otherwise(F.col("q.filter_fields_used"))
        .alias("filter_fields_used"),
        F.when(failed, F.lit("precheck_no_results")).otherwise(prior.cast("string")).alias(
            "fallback_reason"
        ),
    )


def filter_record(
    *, enabled: Column, semantic_query: Column, applied: Column, fields_used: Column,
    year: Column, program: Column, author: Column, reason: Column,
) -> Column:
    """Log record with one shape for every path (off, error, no filter, applied)."""
    return F.struct(
        F.coalesce(enabled, F.lit(False)).alias("enabled"),
        semantic_query.alias("semantic_query"),
        F.coalesce(applied, F.lit(False)).alias("filter_applied"),
        F.coalesce(fields_used, F.array().cast("array<string>")).alias("filter_fields_used"),
        F.struct(
            F.when(applied, year).alias("year"),
            F.when(applied, program).alias("program"),
            F.when(applied, author).alias("author"),
        ).alias("filters"),
        F.struct(year.alias("year"), program.alias("program"), author.alias("author")).alias(
            "extracted_metadata"
        ),
        reason.cast("string").alias("fallback_reason"),
    )


def must_answer_not_found(reason: Column | str, year: Column, program: Column, author: Column) -> Column:
    """Metadata was asked for and the pre-check found nothing."""
    asked = (
        year.isNotNull()
        | (strip(text_or_empty(program)) != "")
        | (strip(text_or_empty(author)) != "")
    )
    return F.coalesce(col(reason) == "precheck_no_results", F.lit(False)) & asked


def guarded_answer(answer: Column | str, guard: Column, rules: RuleSet) -> Column:
    return F.when(guard, F.lit(rules.templates["not_found_answer"])).otherwise(col(answer))


def doc_focus(c: Column | str, rules: RuleSet) -> Column:
    """Documents named in a question: ``x.pdf`` (and its stem), institution-style ids."""
    t = text_or_empty(c)
    files = F.regexp_extract_all(t, F.lit(r"(?i)([A-Za-z0-9_]+\.pdf)"), 1)
    with_stem = F.flatten(
        F.transform(files, lambda f: F.array(f, F.substring(f, F.lit(1), F.length(f) - 4)))
    )
    ids = F.regexp_extract_all(t, F.lit(f"({rules.patterns['doc_id_style']})"), 1)
    return F.array_distinct(F.concat(with_stem, ids))


def focus_hit(doc_id: Column | str, source_file: Column | str, allowed: Column) -> Column:
    """Id or file equals or contains one of the allowed names."""
    d, f = F.lower(strip(text_or_empty(doc_id))), F.lower(strip(text_or_empty(source_file)))

    def one(a: Column) -> Column:
        name = F.lower(strip(a))
        stem = F.substring(name, F.lit(1), F.length(name) - 4)
        as_file = F.contains(f, name) | ((stem != "") & F.contains(d, stem))
        plain = F.contains(d, name) | F.contains(f, name)
        return F.when(name.endswith(".pdf"), as_file).otherwise(plain)

    names = F.filter(allowed, lambda a: strip(a) != "")
    return F.exists(names, one)


def apply_doc_focus(
    hits: DataFrame, *, allowed: str = "allowed_docs", min_keep: int = 3, strict: bool = False
) -> DataFrame:
    """Keep the hits of the focused documents; adds ``focus_reason``.

    Strict is a hard lock (a query may end up empty).  Otherwise a query with
    fewer than ``min_keep`` kept hits keeps all of them.  An empty list of
    names changes nothing.
    """
    names = F.filter(F.coalesce(F.col(allowed), F.array().cast("array<string>")),
                     lambda a: strip(a) != "")
    flagged = hits.withColumn("_open", F.size(names) == 0).withColumn(
        "_kept", focus_hit("doc_id", "source_file", names)
    )
    n_kept = F.sum(F.col("_kept").cast("int")).over(by_query())
    flagged = flagged.withColumn("_n", n_kept)
    if strict:
        reason = F.when(F.col("_open"), "empty_allowlist").otherwise("strict_lock")
    else:
        reason = (
            F.when(F.col("_open"), "empty_allowlist")
            .when(F.col("_n") < min_keep, "too_few_kept_fallback")
            .otherwise("filtered_ok")
        )
    out = flagged.withColumn("focus_reason", reason)
    stay = F.col("focus_reason").isin("empty_allowlist", "too_few_kept_fallback") | F.col("_kept")
    return out.where(stay).drop("_open", "_kept", "_n")


def hit_contains(
    needle: Column, doc_id: Column | str = "doc_id", source_file: Column | str = "source_file",
    text: Column | str = "text",
) -> Column:
    """Free-text filter over id, file and text; an empty needle lets all pass."""
    q = F.lower(strip(needle))
    found = q == ""
    for c in (doc_id, source_file, text):
        found = found | F.contains(F.lower(text_or_empty(c)), q)
    return found


def fill_stream(stream: Column | str, collection: Column) -> Column:
    """Empty stream becomes the collection that was queried."""
    return F.coalesce(blank_to_null(col(stream)), collection)


def fill_label(label: Column | str) -> Column:
    return blank_to_null(col(label))
