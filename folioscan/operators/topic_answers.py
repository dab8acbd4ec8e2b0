"""Answers built from contexts per topic, and answers cut into topic sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscan.functions.text import matches, split_lines, strip, text_or_empty
from folioscan.functions.topics import named_topics
from folioscan.functions.windows import by_query
from folioscan.operators import answers as A
from folioscan.operators.aggregation import bullet_topic, steps_contexts, topic_snippet
from folioscan.operators.expansion import topic_label
from folioscan.operators.steps import extract_steps, merge_steps
from folioscan.rules import RuleSet


def _lines(order: str, text: Column) -> Column:
    got = F.sort_array(F.collect_list(F.struct(order, text.alias("t"))))
    return F.transform(F.filter(got, lambda x: x["t"].isNotNull()), lambda x: x["t"])


def _cited(label: Column, text: Column, ctx: Column) -> Column:
    return F.concat(F.lit("- ("), label, F.lit(") "), text, F.lit(" [CTX "), ctx.cast("string"), F.lit("]"))


def topic_answers(
    contexts: DataFrame, queries: DataFrame, rules: RuleSet, *, max_evidence: int = 5
) -> DataFrame:
    """Which topics the contexts name, with a snippet each.

    ``contexts(query_id, ctx, text)``, ``queries(query_id, text, targets)``;
    a context serves one topic only, the first in target order.
    """
    found = named_topics({t.name: matches("text", t.mention, "iU") for t in rules.topics})
    hits = contexts.select("query_id", "ctx", "text", found.alias("found"))
    wanted = queries.select(
        "query_id", F.col("text").alias("question"), F.posexplode("targets").alias("topic_pos", "topic")
    )
    first = (
        wanted.join(hits, "query_id")
        .where(F.array_contains("found", F.col("topic")))
        .groupBy("query_id", "question", "topic_pos", "topic")
        .agg(F.min(F.struct("ctx", "text")).alias("c"))
        .select("query_id", "question", "topic_pos", "topic", "c.ctx", "c.text")
    )
    once = W.partitionBy("query_id", "ctx").orderBy("topic_pos")
    label = topic_label(F.col("topic"), rules)
    rows = (
        first.withColumn("_n", F.row_number().over(once))
        .where(F.col("_n") == 1)
        .withColumn("_k", F.row_number().over(by_query().orderBy("topic_pos")))
        .where(F.col("_k") <= max(1, min(max_evidence, 8)))
        .select("query_id", "question", "topic_pos", label.alias("label"),
                _cited(label, topic_snippet("text", F.col("topic"), rules), F.col("ctx")).alias("line"))
    )
    out = rows.groupBy("query_id", "question").agg(
        _lines("topic_pos", F.col("label")).alias("names"),
        _lines("topic_pos", F.col("line")).alias("lines"),
    )
    as_list = matches(F.lower("question"), rules.patterns["q_list_form"])
    one = (F.size("names") == 1) & ~as_list
    template = F.when(one, rules.templates["topic_answer_one"]).otherwise(
        rules.templates["topic_answer_many"]
    )
    head = F.replace(template, F.lit("{names}"), F.array_join("names", ", "))
    return out.select(
        "query_id", F.concat(head, F.lit("\nBukti:\n"), F.array_join("lines", "\n")).alias("answer")
    )


def steps_per_topic(
    contexts: DataFrame, queries: DataFrame, rules: RuleSet, *, max_items: int = 5
) -> DataFrame:
    """Best context and merged steps per (query, target topic); null context
    when no context names the topic."""
    max_items = max(2, min(max_items, 6))
    with_targets = contexts.join(queries.select("query_id", "targets"), "query_id")
    best = steps_contexts(with_targets, rules).withColumn(
        "items", extract_steps("text", rules, max_items=max_items)
    )
    lists = F.transform(F.sort_array(F.collect_list(F.struct("pos", "items"))), lambda x: x["items"])
    per = best.groupBy("query_id", "topic").agg(
        F.min_by("ctx", "pos").alias("ctx"), lists.alias("_lists")
    ).select("query_id", "topic", "ctx", merge_steps(F.col("_lists"), max_items).alias("steps"))
    wanted = queries.select("query_id", F.posexplode("targets").alias("topic_pos", "topic"))
    return wanted.join(per, ["query_id", "topic"], "left").withColumn(
        "steps", F.coalesce("steps", F.array().cast("array<string>"))
    )


def steps_answers(
    contexts: DataFrame, queries: DataFrame, rules: RuleSet, *, max_items: int = 5, max_evidence: int = 6
) -> DataFrame:
    """Steps of two and more topics as one answer with a line per topic."""
    t = rules.templates
    many = queries.where(F.size("targets") >= 2)
    per = steps_per_topic(contexts, many, rules, max_items=max_items).join(
        many.select("query_id", A.mentions_compare("text", rules).alias("_cmp")), "query_id"
    )
    label = topic_label(F.col("topic"), rules)
    joined = F.array_join("steps", "; ")
    note = F.concat(F.lit(t["steps_note"]), F.when(F.col("_cmp"), t["steps_note_compare"]).otherwise(""))
    full = F.size("steps") >= 2
    cite = F.concat(F.lit(" [CTX "), F.col("ctx").cast("string"), F.lit("]"))
    line = (
        F.when(F.col("ctx").isNull(), F.concat(label, F.lit(": "), F.lit(t["not_found_line"])))
        .when(full, F.concat(label, F.lit(": "), joined, cite))
        .otherwise(F.concat(label, F.lit(": "), note))
    )
    evidence = F.when(
        F.col("ctx").isNotNull(),
        _cited(label, F.when(full, F.concat(F.lit(t["steps_listed"]), joined)).otherwise(note), F.col("ctx")),
    )
    out = per.groupBy("query_id").agg(
        _lines("topic_pos", line).alias("head"), _lines("topic_pos", evidence).alias("ev")
    )
    lines = F.slice("ev", 1, max(1, min(max_evidence, 8)))
    tail = F.when(F.size(lines) > 0, F.concat(F.lit("\nBukti:\n"), F.array_join(lines, "\n"))).otherwise(
        "\nBukti: -"
    )
    return out.select(
        "query_id", F.concat(F.lit("Jawaban:\n"), F.array_join("head", "\n"), tail).alias("answer")
    )


def single_topic_steps(status: DataFrame, resolution: DataFrame, rules: RuleSet) -> DataFrame:
    """Outcome for step questions about one topic in one document.

    ``status`` from the steps expansion; ``resolution(query_id, topic,
    resolve_status, candidate_docs)`` tells how the document was found.  An
    ambiguous or unknown owner always wins over extracted steps; fewer than two
    steps are a partial outcome; evidence names at most two contexts.
    """
    joined = resolution.join(status.drop("topic"), "query_id", "left")
    safe = F.col("resolve_status").isin("ambiguous_owner_docs", "unresolved_owner_doc")
    found = (F.col("status") == "steps_found") & (F.size("steps") >= 2)
    outcome = (
        F.when(safe, F.col("resolve_status"))
        .when(found, "steps_found")
        .when(F.coalesce("status", F.lit("method_not_found")) == "method_not_found", "method_not_found")
        .otherwise("partial")
    )
    none_i = F.array().cast("array<int>")
    support = F.coalesce(F.get("support_ctx", 0), F.get("explicit_ctx", 0))
    steps_ctx = F.coalesce(F.get("extractable_ctx", 0), F.get("explicit_ctx", 0), F.get("support_ctx", 0))
    refs = (
        F.when(outcome == "steps_found", F.slice("extractable_ctx", 1, 2))
        .when(outcome == "partial", F.array_distinct(F.array_compact(F.array(support, steps_ctx))))
        .otherwise(none_i)
    )
    label = topic_label(F.col("topic"), rules)
    doc = F.coalesce(F.col("target_doc").cast("string"), F.lit(rules.templates["single_topic_steps"]["no_doc"]))
    numbered = F.array_join(
        F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"
    )
    docs = F.array_join(F.slice("candidate_docs", 1, 3), ", ")
    cites = F.array_join(
        F.transform("contexts", lambda n: F.concat(F.lit("- "), label, F.lit(" [CTX "), n.cast("string"), F.lit("]"))),
        "\n",
    )
    says = rules.templates["single_topic_steps"]

    def said(name: str, **parts: Column) -> Column:
        """A sentence of the rule set with its ``{part}`` filled."""
        pieces = re.split(r"\{(\w+)\}", says[name])
        return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])

    text = F.lit(rules.templates["not_found_answer"])
    for name in ("ambiguous_owner_docs", "unresolved_owner_doc", "steps_found", "partial"):
        made = said(name, label=label, docs=docs, doc=doc, steps=numbered, cites=cites)
        text = F.when(F.col("outcome") == name, made).otherwise(text)
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("contexts", F.coalesce(refs, none_i))
        .select("query_id", "topic", "target_doc", "outcome",
                F.when(F.col("outcome") == "steps_found", F.col("steps"))
                .otherwise(F.array().cast("array<string>")).alias("steps"),
                "contexts", text.alias("answer"))
    )


def comparison_table(signals: DataFrame, status: DataFrame, queries: DataFrame, rules: RuleSet) -> DataFrame:
    """Per (query, topic): usage, reason and process snippets, style tags and a
    summary line; at most three topics per query."""
    wanted = queries.where(F.size("targets") >= 2).select(
        "query_id", F.posexplode(F.slice("targets", 1, 3)).alias("topic_pos", "topic")
    )
    rows = wanted.join(signals, ["query_id", "topic"], "left").join(
        status.select("query_id", "weak_topics", "comparison_status"), "query_id", "left"
    )
    label = topic_label(F.col("topic"), rules)
    styled = F.size(F.coalesce("style_tags", F.array().cast("array<string>"))) > 0
    style = F.lit(None).cast("string")
    for t in rules.topics:
        if t.style_summary:
            style = F.when(F.col("topic") == t.name, F.lit(f"Pada konteks final, {t.label} {t.style_summary}")).otherwise(style)
    summary = (
        F.when(styled & style.isNotNull(), style)
        .when(F.col("usage").isNotNull(),
              F.concat(label, F.lit(" terkonfirmasi digunakan dalam penelitian, tetapi detail pembeda yang eksplisit masih terbatas.")))
        .when(F.array_contains("weak_topics", F.col("topic")),
              "Metode ini hanya muncul secara lemah pada konteks final, sehingga pembeda spesifiknya belum kuat.")
        .otherwise("Tidak ditemukan pembeda yang cukup jelas pada konteks final.")
    )
    return rows.select(
        "query_id", "topic_pos", "topic", "best", "usage", "reason", "process", "style_tags",
        "comparison_status", F.concat(label, F.lit(": "), summary).alias("summary"),
    )


def comparison_evidence(table: DataFrame, rules: RuleSet, *, max_evidence: int = 5) -> DataFrame:
    """Evidence lines of a comparison: first lines from contexts not used yet,
    then lines that differ in text, at most ``min(budget, 5)``."""
    limit = max(1, min(max_evidence, 5))
    parts = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("v"))
                      for i, c in enumerate(("best", "usage", "reason", "process"))])
    rows = table.select("query_id", "topic_pos", "topic", F.inline(parts)).where(
        F.col("v").isNotNull() & (F.col("v.snippet") != "")
    )
    rows = rows.groupBy("query_id", "topic_pos", "topic", "v").agg(F.min("k").alias("k"))
    by_ctx = W.partitionBy("query_id", "v.ctx").orderBy("topic_pos", "k")
    order = by_query().orderBy("again", "topic_pos", "k")
    return (
        rows.withColumn("again", (F.row_number().over(by_ctx) > 1).cast("int"))
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= limit)
        .select("query_id", "pos", "topic",
                _cited(topic_label(F.col("topic"), rules), F.col("v.snippet"), F.col("v.ctx")).alias("line"))
    )


def comparison_answers(table: DataFrame, evidence: DataFrame, rules: RuleSet) -> DataFrame:
    """Summary lines and evidence of a comparison as one answer."""
    heads = table.groupBy("query_id", "comparison_status").agg(
        _lines("topic_pos", F.col("summary")).alias("head"),
        _lines("topic_pos", topic_label(F.col("topic"), rules)).alias("names"),
    )
    ev = evidence.groupBy("query_id").agg(_lines("pos", F.col("line")).alias("ev"))
    pair = F.concat_ws(" dan ", F.get("names", 0), F.get("names", 1))
    lead = F.when(
        F.col("comparison_status") == "balanced_comparison",
        F.concat(F.lit("Jawaban: Berdasarkan konteks final, perbedaan utama "), pair,
                 F.lit(" yang digunakan pada dokumen adalah sebagai berikut:")),
    ).otherwise(
        F.concat(F.lit("Jawaban: Perbandingan "), pair,
                 F.lit(" hanya dapat dijelaskan secara parsial dari konteks final yang tersedia."))
    )
    return heads.join(ev, "query_id").select(
        "query_id",
        F.concat_ws("\n", lead, F.array_join("head", "\n"), F.lit("Bukti:"), F.array_join("ev", "\n")).alias("answer"),
    )


# -- sections ----------------------------------------------------------------------


def guess_topic(text: Column | str, targets: Column, rules: RuleSet, *, first_target: bool = False) -> Column:
    """Most likely topic of text without a header, null when nothing points to
    one (``first_target`` takes the first target instead)."""
    low = F.lower(text_or_empty(text))
    mentioned = named_topics({t.name: matches(low, t.mention) for t in rules.topics})
    guess = F.lit(None).cast("string")
    for name, *lists in reversed(rules.free_text_topics):
        hit = F.array_contains(targets, name)
        for patterns in lists:
            hit = hit & matches(low, patterns)
        guess = F.when(hit, F.lit(name)).otherwise(guess)
    last = F.get(targets, 0) if first_target else F.lit(None).cast("string")
    return F.coalesce(F.get(F.array_intersect(targets, mentioned), 0), guess, last)


def topic_sections(
    answers: DataFrame, rules: RuleSet, *, max_items: int = 3, first_target: bool = False
) -> DataFrame:
    """One row per (answer, target topic): its section of the answer.

    ``answers(answer_id, answer, targets)``.  Lines belong to the last topic
    header above them; aliases count as their topic, other topics are dropped,
    a repeated header keeps its last section, and text without any header goes
    to its likely topic.  An empty section is refilled from evidence of the
    topic, else says "not found".  ``source`` is answer, evidence or missing.
    """
    max_items = max(1, min(max_items, 5))
    labels = {t.label.lower(): t.name for t in rules.topics}
    labels |= {a.lower(): t.name for t in rules.topics for a in t.aliases}
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    pattern = "|".join(sorted((r"\Q" + x + r"\E" for x in labels), key=len, reverse=True))
    header = rf"(?i)^\s*(?:-\s*)?({pattern})\s*:\s*(.*)$"
    not_found = rules.patterns["not_found_sentence"]
    body = F.regexp_replace(A.answer_head("answer"), A.ANSWER_LABEL, "")
    lines = answers.select(
        "answer_id", "targets", body.alias("_body"), F.posexplode(split_lines(body)).alias("pos", "line")
    ).select(
        "answer_id", "targets", "pos",
        F.element_at(names, F.lower(F.regexp_extract("line", header, 1))).alias("own"),
        F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 2))
        .otherwise(F.col("line")).alias("text"),
        F.col("line").rlike(header).alias("is_header"), "_body",
    )
    upto = W.partitionBy("answer_id").orderBy("pos")
    every = W.partitionBy("answer_id")
    lines = (
        lines.withColumn("topic", F.last("own", ignorenulls=True).over(upto))
        .withColumn("section", F.sum(F.col("is_header").cast("int")).over(upto))
        .withColumn("n_headers", F.sum(F.col("is_header").cast("int")).over(every))
    )
    # the whole body without headers goes to its likely topic
    lines = lines.withColumn(
        "topic",
        F.when(
            F.col("n_headers") == 0,
            guess_topic("_body", F.col("targets"), rules, first_target=first_target),
        ).otherwise(F.col("topic")),
    )
    said = (strip("text") != "") & (strip("text") != "-") & ~F.lower("text").contains(not_found)
    per = (
        lines.where(F.col("topic").isNotNull() & F.array_contains("targets", F.col("topic")))
        .groupBy("answer_id", "topic", "section")
        .agg(
            F.bool_or(said).alias("real"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: _rtrim(x["text"])),
                "\n",
            ).alias("content"),
        )
    )
    latest = per.groupBy("answer_id", "topic").agg(
        F.max_by(F.struct("real", "content"), "section").alias("s")
    )
    evidence = (
        answers.select("answer_id", "targets", F.posexplode(A.evidence_lines("answer")).alias("pos", "b"))
        .withColumn("topic", bullet_topic("b", F.col("targets"), rules))
        .where(F.col("topic").isNotNull())
        .groupBy("answer_id", "topic")
        .agg(
            F.slice(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("pos", "b"))),
                    lambda x: F.concat(F.lit("- "), F.regexp_replace(strip(x["b"]), r"^\(\s*[A-Za-z_ ]+\s*\)\s*", "")),
                ),
                1, max_items,
            ).alias("ev")
        )
    )
    wanted = answers.select("answer_id", F.posexplode("targets").alias("topic_pos", "topic"))
    out = wanted.join(latest, ["answer_id", "topic"], "left").join(evidence, ["answer_id", "topic"], "left")
    real = F.coalesce(F.col("s.real"), F.lit(False))
    label = topic_label(F.col("topic"), rules)
    text = (
        F.when(real, F.concat(label, F.lit(": "), strip(F.col("s.content"))))
        .when(F.col("ev").isNotNull(), F.concat(label, F.lit(":\n"), F.array_join("ev", "\n")))
        .otherwise(F.concat(label, F.lit(": "), F.lit(rules.templates["not_found_line"])))
    )
    return out.select(
        "answer_id", "topic_pos", "topic",
        F.when(real, "answer").when(F.col("ev").isNotNull(), "evidence").otherwise("missing").alias("source"),
        text.alias("text"),
    )


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+\z", "")


def join_sections(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """Answers put together again from their topic sections."""
    body = sections.groupBy("answer_id").agg(F.array_join(_lines("topic_pos", F.col("text")), "\n\n").alias("_b"))
    return answers.join(body, "answer_id", "left").withColumn(
        "answer",
        F.when(
            F.col("_b").isNotNull(),
            F.concat(F.lit("Jawaban:\n"), F.col("_b"), F.lit("\n"), A.evidence_part("answer")),
        ).otherwise(F.col("answer")),
    ).drop("_b")
