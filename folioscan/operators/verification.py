"""Rule-based checks of answers against the contexts they cite."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import count_hits, let, matches, strip, text_or_empty
from folioscan.operators import answers as A
from folioscan.rules import RuleSet

# Weights, cap and label thresholds.
WEIGHTS = {
    "format_ok": 0.10,
    "evidence_ok": 0.10,
    "citations_present": 0.15,
    "citations_in_range": 0.15,
    "answer_grounded": 0.10,
}
RATIO_WEIGHT = 0.20
CAUTION_CAP = 0.79
FULL, HALF = 0.999999, 0.5
BADGES = {
    "verified": "Verified",
    "partial": "Partially Verified",
    "low": "Low Verification",
    "not_found": "Verification N/A",
    "skipped": "Verification N/A",
}


def bullet_grounded(bullet: Column, low_contexts: Column, used: Column, rules: RuleSet) -> Column:
    """A cited context in range holds the topic prefix or a keyword of the line.

    ``low_contexts`` are the contexts in lower case.
    """
    nums = F.filter(A.ctx_nums(bullet), lambda n: n.between(F.lit(1), used))
    prefix = F.lower(strip(F.regexp_extract(strip(bullet), r"^\(\s*([A-Za-z_ ]+)\s*\)", 1)))
    facts = F.struct(
        nums.alias("nums"), prefix.alias("prefix"), A.grounding_keywords(bullet, rules).alias("kws")
    )

    def test(f: Column) -> Column:
        def one(n: Column) -> Column:
            return let(
                F.get(low_contexts, n - 1),
                lambda hay: ((f["prefix"] != "") & F.contains(hay, f["prefix"]))
                | F.exists(f["kws"], lambda k: F.contains(hay, k)),
            )

        return F.exists(f["nums"], one)

    return F.coalesce(let(facts, test), F.lit(False))


def answer_grounded(answer: Column | str, hay: Column, rules: RuleSet) -> Column:
    """One keyword hit in all contexts together, two when there are more than
    four keywords; nothing to check passes."""
    kws = A.grounding_keywords(A.answer_body(answer), rules, 12)
    return let(
        kws,
        lambda k: (F.size(k) == 0)
        | (count_hits(k, hay) >= F.when(F.size(k) <= 4, 1).otherwise(2)),
    )


def question_supported(question: Column | str, hay: Column, rules: RuleSet) -> Column:
    """Some keyword of the question occurs that is not merely generic."""
    generic = F.array(*[F.lit(w) for w in rules.word_lists["generic_support"]])
    kws = F.array_except(A.support_keywords(question, rules), generic)
    return count_hits(kws, hay) > 0


def with_generation(
    df: DataFrame, rules: RuleSet, *, answer: str = "answer", contexts: str = "contexts",
    question: str = "question", max_evidence: int = 3, name: str = "generation",
) -> DataFrame:
    """Add the check struct of an answer: format, citations, grounding, status.

    ``contexts`` is the array of the final context texts (a handful per row).
    Costly forms are columns of their own, so each is computed once.
    """
    limit = max(1, min(max_evidence, 8))
    t = strip(text_or_empty(answer))
    none = F.array().cast("array<string>")
    forms = df.select(
        "*",
        t.alias("_t"),
        F.transform(F.coalesce(F.col(contexts), none), lambda c: F.lower(text_or_empty(c))).alias("_low"),
        A.evidence_lines(t).alias("_lines"),
    ).select(
        "*",
        F.size("_low").alias("_used"),
        F.array_join("_low", " ").alias("_hay"),
        A.is_not_found_normalized("_t", rules).alias("_nf"),
        F.size("_lines").alias("_n"),
    )
    used = F.col("_used")
    facts = F.transform(
        "_lines",
        lambda b: F.struct(
            A.ctx_nums(b).alias("nums"),
            bullet_grounded(b, F.col("_low"), used, rules).alias("grounded"),
        ),
    )
    head = F.regexp_replace(A.answer_head("_t"), A.ANSWER_LABEL, "")
    missing = F.filter(
        F.transform(
            F.filter(F.transform(F.split(head, "\n"), strip), lambda x: x != ""),
            lambda x: F.when(
                F.lower(F.regexp_extract(x, r"^([A-Za-z_ ].+?)\s*:\s*(.*)$", 2)).contains(
                    rules.patterns["not_found_sentence"]
                ),
                strip(F.regexp_extract(x, r"^([A-Za-z_ ].+?)\s*:\s*(.*)$", 1)),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    checked = forms.select(
        "*",
        A.valid_format("_t").alias("_format"),
        A.evidence_is_list("_t").alias("_list"),
        A.has_citation("_t").alias("_cited"),
        A.citations_in_range("_t", used).alias("_range"),
        A.ctx_nums("_t").alias("_nums"),
        facts.alias("_facts"),
        answer_grounded("_t", F.col("_hay"), rules).alias("_ag"),
        question_supported(question, F.col("_hay"), rules).alias("_sup"),
        missing.alias("_missing"),
    )
    all_grounded = (used <= 0) | F.forall("_facts", lambda f: f["grounded"])
    checked = checked.select(
        "*",
        (F.col("_nf") | all_grounded).alias("_eg"),
        (F.col("_nf") | (used <= 0) | F.col("_ag")).alias("_agok"),
        (~F.col("_nf") & (F.col("_n") > limit)).alias("_over"),
    )
    bad = used > 0
    status = (
        F.when(F.col("_t") == "", "empty")
        .when(F.col("_nf"), "not_found")
        .when(~F.col("_format") | ~F.col("_list"), "invalid_format")
        .when(bad & ~F.col("_cited"), "missing_citation")
        .when(bad & ~F.col("_range"), "invalid_citation_range")
        .when(bad & ~F.col("_eg"), "weak_grounding_bukti")
        .when(bad & ~F.col("_agok"), "weak_grounding_jawaban")
        .when(F.col("_over"), "bukti_overflow")
        .otherwise("ok")
    )
    real = F.col("_t") != ""
    generation = F.struct(
        used.alias("used_ctx"),
        F.lit(limit).alias("max_evidence"),
        (bad & F.col("_sup")).alias("supported"),
        (real & F.col("_format")).alias("format_ok"),
        (real & F.col("_list")).alias("evidence_ok"),
        F.col("_n").alias("evidence_count"),
        F.col("_over").alias("evidence_overflow"),
        (real & F.col("_cited")).alias("citations_present"),
        (real & F.col("_range")).alias("citations_in_range"),
        F.col("_eg").alias("grounding_ok"),
        F.col("_agok").alias("answer_grounded"),
        F.col("_nums").alias("ctx_nums"),
        (~F.col("_nf") & (F.size("_missing") > 0)).alias("partial_not_found"),
        F.when(~F.col("_nf"), F.col("_missing")).otherwise(none).alias("topics_not_found"),
        status.alias("status"),
    )
    return checked.select(*df.columns, generation.alias(name), F.col("_facts").alias("evidence_facts"))


def with_verification(
    df: DataFrame, rules: RuleSet, *, answer: str = "answer", chunk_ids: str | None = None,
    enabled: bool = True, metadata_route: Column | None = None, name: str = "verification",
) -> DataFrame:
    """Add the verification struct to rows of :func:`with_generation`.

    Label ``verified``, ``partial``, ``low``, ``not_found`` or ``skipped`` by
    rules; the score is a diagnostic, null for not found and skipped rows.  The
    struct has one shape on every path.
    """
    g = F.col("generation")
    none = F.array().cast("array<string>")
    skipped = F.lit(not enabled)
    if metadata_route is not None:
        skipped = skipped | F.coalesce(metadata_route, F.lit(False))
    used = g["used_ctx"]
    in_range = F.transform(
        "evidence_facts",
        lambda f: (F.size(f["nums"]) > 0) & F.forall(f["nums"], lambda n: n.between(F.lit(1), used)),
    )
    rows = df.select(
        "*",
        skipped.alias("_skip"),
        F.size("evidence_facts").alias("_total"),
        F.size(F.filter("evidence_facts", lambda f: F.size(f["nums"]) > 0)).alias("_with"),
        F.size(F.filter(in_range, lambda x: x)).alias("_valid"),
        F.size(
            F.filter(
                "evidence_facts",
                lambda f: f["grounded"]
                & (F.size(f["nums"]) > 0)
                & F.forall(f["nums"], lambda n: n.between(F.lit(1), used)),
            )
        ).alias("_ground"),
        A.valid_ctx_nums(F.flatten(F.transform("evidence_facts", lambda f: f["nums"])), used).alias("_cited"),
        matches(F.lower(A.answer_body(answer)), rules.pattern_lists["caution"]).alias("_caution"),
    )

    def ratio(c: str) -> Column:
        return F.when(F.col("_total") > 0, F.round(F.col(c) / F.col("_total"), 6)).otherwise(0.0)

    rows = rows.withColumn("_cr", ratio("_valid")).withColumn("_gr", ratio("_ground"))
    careful = F.col("_caution") | g["partial_not_found"]
    label = (
        F.when(F.col("_skip"), "skipped")
        .when(g["status"] == "not_found", "not_found")
        .when(~g["format_ok"] | ~g["evidence_ok"], "low")
        .when((used > 0) & ~(g["citations_present"] & g["citations_in_range"]), "low")
        .when(F.col("_total") <= 0, "low")
        .when((F.col("_gr") >= FULL) & g["answer_grounded"] & ~careful, "verified")
        .when(
            (F.col("_gr") >= HALF)
            & (g["answer_grounded"] | g["citations_in_range"] | g["supported"]),
            "partial",
        )
        .otherwise("low")
    )
    score = RATIO_WEIGHT * F.col("_cr") + RATIO_WEIGHT * F.col("_gr")
    for field, weight in WEIGHTS.items():
        score = score + F.when(g[field], weight).otherwise(0.0)
    score = F.least(score, F.lit(1.0))
    score = F.round(F.when(careful, F.least(score, F.lit(CAUTION_CAP))).otherwise(score), 6)
    rows = rows.withColumn("_label", label).withColumn("_score", score)
    lab, off = F.col("_label"), F.col("_skip")
    badge = F.lit("Verification N/A")
    for k, v in BADGES.items():
        badge = F.when(lab == k, v).otherwise(badge)
    reason = F.when(off, "disabled_in_config" if not enabled else "metadata_route_skipped")

    def on(c: Column) -> Column:
        return ~off & c

    verification = F.struct(
        F.lit(enabled).alias("enabled"),
        (~off).alias("applied"),
        lab.alias("label"),
        badge.alias("badge_text"),
        _explanation(lab, g, careful, reason, rules.templates["verification"]).alias("explanation"),
        F.when(~lab.isin("skipped", "not_found"), F.col("_score")).alias("score"),
        reason.alias("skipped_reason"),
        F.struct(
            *[on(g[f]).alias(f) for f in (
                "supported", "format_ok", "evidence_ok", "citations_present", "citations_in_range",
                "grounding_ok", "answer_grounded", "partial_not_found")],
            on(F.col("_caution")).alias("coverage_caution"),
        ).alias("signals"),
        F.struct(
            used.alias("used_ctx"),
            F.when(off, 0).otherwise(F.col("_total")).alias("bullet_total"),
            F.when(off, 0).otherwise(F.col("_with")).alias("bullet_with_citation"),
            F.when(off, 0).otherwise(F.col("_valid")).alias("bullet_valid_citation"),
            F.when(off, 0).otherwise(F.col("_ground")).alias("bullet_grounded"),
            F.when(off, 0.0).otherwise(F.col("_cr")).alias("citation_ratio"),
            F.when(off, 0.0).otherwise(F.col("_gr")).alias("grounded_ratio"),
            F.when(off, F.array().cast("array<int>")).otherwise(F.col("_cited")).alias("cited_ctx_nums"),
            (none if chunk_ids is None else F.when(off, none).otherwise(
                A.ctx_chunk_ids(F.col("_cited"), F.col(chunk_ids)))).alias("cited_chunk_ids"),
        ).alias("evidence_summary"),
    )
    return rows.select(*df.columns, verification.alias(name))


def _explanation(
    label: Column, g: Column, careful: Column, reason: Column, says: Mapping[str, str]
) -> Column:
    """The sentence of the rule set that says why the label was given."""
    partial = (
        F.when(careful, says["partial_caution"])
        .when(~g["answer_grounded"], says["partial_ungrounded"])
        .otherwise(says["partial_weak"])
    )
    low = (
        F.when(~g["format_ok"] | ~g["evidence_ok"],
               says["low_format"])
        .when(F.col("_total") == 0, says["low_no_evidence"])
        .when(~g["citations_present"], says["low_uncited"])
        .when(~g["citations_in_range"], says["low_out_of_range"])
        .when(F.col("_gr") <= 0, says["low_ungrounded"])
        .otherwise(says["low_weak"])
    )
    return (
        F.when(reason == "disabled_in_config", says["skipped_config"])
        .when(reason.isNotNull(), says["skipped_metadata"])
        .when(label == "not_found",
              says["not_found"])
        .when(label == "verified", says["verified"])
        .when(label == "partial", partial)
        .otherwise(low)
    )


def guarded_answer(
    df: DataFrame, rules: RuleSet, *, answer: str = "answer", contexts: str = "contexts",
    has_topic: Column | None = None, name: str = "final_answer",
) -> DataFrame:
    """Replace an answer that fails its checks (rows of :func:`with_generation`).

    Ungrounded, uncited, out of range or badly formed answers become the
    extractive answer when the question looks supported (or has a topic), else
    "not found".  Good ones lose empty list numbers and answer citations.
    """
    g = F.col("generation")
    used = g["used_ctx"]
    relaxed = F.lit(False) if has_topic is None else has_topic
    not_found = g["status"].isin("not_found", "empty")
    fails = ((used > 0) & ~not_found) & (
        ~g["grounding_ok"] | ~g["answer_grounded"] | ~g["citations_present"] | ~g["citations_in_range"]
    )
    malformed = ~g["format_ok"] | ~g["evidence_ok"]
    fallback = F.when(
        g["supported"] | relaxed, A.extractive_answer(F.col(contexts), used, rules)
    ).otherwise(F.lit(rules.templates["not_found_answer"]))
    clean = A.strip_answer_citations(A.fix_empty_numbers(answer))
    return df.withColumn(
        name,
        F.when(fails | malformed, fallback)
        .when((used > 0) & ~not_found, clean)
        .otherwise(strip(text_or_empty(answer))),
    )
