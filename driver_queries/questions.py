"""Question flags, plans and metadata split over the conversation questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import query, sql_any, sql_contains_any
from driver_queries.themes import (
    CHUNK_CTE,
    QUESTION_CTE,
    RULES,
    artifact_sql,
    explain_strength_sql,
    owner_cue_sql,
    questions,
    related_sql,
    steps_bias_sql,
    steps_signal_sql,
    steps_strength_sql,
    themed_chunks,
    topics_in_sql,
)
from folioscan.functions import intent, topics
from folioscan.operators import filters, fusion

P, L, WL = RULES.patterns, RULES.pattern_lists, RULES.word_lists
LOW = "lower(text)"

FLAG_SQL = {
    "is_topic": sql_any(LOW, P["q_topic"]),
    "is_steps": f"({sql_any(LOW, P['q_steps'])} OR ({sql_any(LOW, P['q_flow'])} AND {sql_any(LOW, P['q_flow_context'])}))",
    "is_anaphora": sql_any(LOW, P["q_anaphora"]),
    "is_multi_target": f"({sql_contains_any(LOW, WL['multi_target_phrases'])} OR {sql_any(LOW, L['multi_target'])})",
    "is_multi_doc": f"({sql_contains_any(LOW, WL['multi_doc_phrases'])} OR {sql_any(LOW, L['multi_doc'])})",
    "is_count": sql_any(LOW, P["q_count"]),
    "is_listing": sql_any(LOW, P["q_listing"]),
    "is_explanation": sql_any(LOW, L["explain"]),
    "is_comparison": f"({sql_any(LOW, P['q_compare'])} OR (len(topics_low) >= 2 AND {sql_any(LOW, P['q_compare_join'])}))",
    "is_compression": sql_any(LOW, L["compression"]),
    "is_citation": sql_any(LOW, L["citation"]),
}

FLAG_CTE = f"""{QUESTION_CTE},
q0 AS (SELECT *, {topics_in_sql('text')} AS topics, {topics_in_sql('lower(text)')} AS topics_low FROM questions),
f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in FLAG_SQL.items())} FROM q0),
flags AS (SELECT *, is_topic AND NOT is_steps AND NOT is_explanation AND {sql_any(LOW, P['q_identify'])}
          AS is_identification FROM f)"""


@query(
    "intent_flags",
    f"WITH {FLAG_CTE} SELECT query_id, {', '.join(FLAG_SQL)}, is_identification FROM flags",
)
def intent_flags(spark, sf_dir):
    return questions(spark, sf_dir).select(
        "query_id",
        *intent.question_flags("text", RULES),
        fusion.is_citation_query("text", RULES).alias("is_citation"),
    )


PLAN_CTE = f"""{FLAG_CTE},
g AS (SELECT *, len(topics) AS n, is_multi_doc OR {sql_any(LOW, P['q_multi_doc_extra'])} AS multi_doc,
        {sql_any(LOW, P['q_title_field'])} AS title, {sql_any(LOW, P['q_author_field'])} AS author FROM flags),
h AS (SELECT *, is_explanation AND NOT is_count AND NOT is_steps AND NOT is_comparison AND NOT title AND NOT author
        AND n <= 1 AS preempt FROM g),
plan AS (SELECT *, CASE WHEN is_comparison THEN 'method_comparison'
   WHEN is_steps AND n <= 1 THEN 'single_target_steps'
   WHEN is_count AND (is_listing OR title OR author OR multi_doc OR is_explanation) THEN 'doc_count_list'
   WHEN preempt THEN 'method_explanation'
   WHEN is_listing AND (multi_doc OR n > 0) THEN 'doc_listing'
   WHEN is_explanation AND (n > 0 OR is_topic) THEN 'method_explanation'
   WHEN is_identification THEN 'method_identification' ELSE 'general_qa' END AS primary_intent,
   ['show_evidence'] || (CASE WHEN is_count THEN ['count_docs'] ELSE [] END)
   || (CASE WHEN is_listing OR title OR author THEN ['list_docs'] ELSE [] END)
   || (CASE WHEN is_explanation THEN ['explain_method'] ELSE [] END)
   || (CASE WHEN is_steps THEN ['extract_steps'] ELSE [] END)
   || (CASE WHEN is_comparison THEN ['compare_methods'] ELSE [] END)
   || (CASE WHEN is_topic THEN ['identify_method'] ELSE [] END)
   || (CASE WHEN title THEN ['show_title'] ELSE [] END)
   || (CASE WHEN author THEN ['show_author'] ELSE [] END) AS actions,
   array_to_string((CASE WHEN is_count THEN ['count_signal'] ELSE [] END)
   || (CASE WHEN is_listing OR title OR author THEN ['list_signal'] ELSE [] END)
   || (CASE WHEN is_explanation THEN ['explanation_signal'] ELSE [] END)
   || (CASE WHEN is_steps THEN ['steps_signal'] ELSE [] END)
   || (CASE WHEN is_comparison THEN ['comparison_signal'] ELSE [] END)
   || (CASE WHEN preempt THEN ['explanation_preempts_listing'] ELSE [] END), '; ') AS why FROM h)"""


@query(
    "intent_plan",
    f"""WITH {PLAN_CTE}
SELECT query_id, primary_intent, array_to_string(actions, ',') AS actions, array_to_string(topics, ',') AS topics,
  CASE WHEN why = '' THEN 'fallback_general' ELSE why END AS planner_reason, len(actions) > 2 AS is_compound,
  primary_intent IN ('doc_count_list', 'doc_listing', 'single_target_steps')
    OR (primary_intent = 'method_explanation' AND multi_doc) AS needs_doc_aggregation FROM plan""",
)
def intent_plan(spark, sf_dir):
    q = intent.with_intent_plan(questions(spark, sf_dir), RULES)
    return q.select(
        "query_id", "plan.primary_intent",
        F.array_join("plan.requested_actions", ",").alias("actions"),
        F.array_join("plan.target_topics", ",").alias("topics"),
        "plan.planner_reason", "plan.is_compound", "plan.needs_doc_aggregation",
    )


@query(
    "plan_audit",
    f"""WITH {PLAN_CTE} SELECT query_id, primary_intent AS intent_primary, array_to_string(topics, ',') AS intent_targets,
  primary_intent = 'method_explanation' AS wants_explanation, primary_intent = 'single_target_steps' AS wants_steps,
  false AS aggregated FROM plan""",
)
def plan_audit(spark, sf_dir):
    q = intent.with_intent_plan(questions(spark, sf_dir), RULES)
    audit = intent.audit_summary(F.col("plan"))
    return q.select("query_id", audit.alias("a")).select(
        "query_id", "a.intent_primary",
        F.array_join("a.intent_targets", ",").alias("intent_targets"),
        F.col("a.intent_needs_explanation_expansion").alias("wants_explanation"),
        F.col("a.intent_needs_steps_expansion").alias("wants_steps"),
        F.col("a.doc_aggregation_applied").alias("aggregated"),
    )


@query(
    "answer_budgets",
    f"""WITH {FLAG_CTE} SELECT query_id, CASE WHEN is_multi_target OR (is_anaphora AND len(topics) >= 2) THEN 5 ELSE 3 END
  AS max_evidence, CASE WHEN is_multi_target OR is_steps OR len(topics) >= 2 THEN 5 ELSE 3 END AS rerank_top_n FROM flags""",
)
def answer_budgets(spark, sf_dir):
    q = questions(spark, sf_dir)
    names = topics.topics_in("text", RULES)
    return q.select(
        "query_id",
        intent.evidence_budget("text", names, RULES).alias("max_evidence"),
        intent.rerank_size(
            multi_target=intent.is_multi_target("text", RULES),
            steps=intent.is_steps_question("text", RULES),
            topics=names,
        ).alias("rerank_top_n"),
    )


@query(
    "topic_detect",
    f"WITH {CHUNK_CTE} SELECT chunk_id, array_to_string({topics_in_sql('text')}, ',') AS topics FROM chunks",
)
def topic_detect(spark, sf_dir):
    return themed_chunks(spark, sf_dir).select(
        "chunk_id", F.array_join(topics.topics_in("text", RULES), ",").alias("topics")
    )


@query(
    "step_signals",
    f"""WITH {CHUNK_CTE} SELECT chunk_id, {steps_signal_sql('text')} AS has_steps, {steps_strength_sql('text')} AS strength,
  {owner_cue_sql('text')} AS owner_cue, {related_sql('text', 'label')} AS related, {artifact_sql('text')} AS artifact,
  {explain_strength_sql('text')} AS explain_strength, {steps_bias_sql('text')} AS steps_bias FROM chunks""",
)
def step_signals(spark, sf_dir):
    return themed_chunks(spark, sf_dir).select(
        "chunk_id",
        topics.has_steps_signal("text", RULES).alias("has_steps"),
        topics.steps_strength("text").alias("strength"),
        topics.has_owner_cue("text", RULES).alias("owner_cue"),
        topics.looks_like_related_work("text", "label", RULES).alias("related"),
        topics.looks_like_artifact("text", RULES).alias("artifact"),
        topics.explain_strength("text", RULES).alias("explain_strength"),
        topics.steps_bias_strength("text", RULES).alias("steps_bias"),
    )


def re2(pattern: str) -> str:
    """RE2 has no look-ahead: consume the stop word instead."""
    return pattern.replace("(?=", "(?:").replace("'", "''")


@query(
    "query_split",
    f"""WITH {QUESTION_CTE},
y AS (SELECT query_id, regexp_extract(text, '(?i){re2(P['f_year'])}', 1) AS y,
   trim(regexp_extract(text, '(?i){re2(P['f_program'])}', 1)) AS p,
   trim(regexp_extract(text, '(?i){re2(P['f_author'])}', 1)) AS a FROM questions)
SELECT query_id, CASE WHEN y <> '' AND y::DOUBLE BETWEEN 2000 AND 2030 THEN y::DOUBLE::INT END AS f_year,
  CASE WHEN len(p) > 2 AND lower(p) NOT IN {tuple(w for w in WL['undetected'] if w) + ('null',)} THEN p END AS f_program,
  CASE WHEN len(a) > 2 AND lower(a) NOT IN {tuple(w for w in WL['undetected'] if w) + ('null',)} THEN a END AS f_author
FROM y""",
)
def query_split(spark, sf_dir):
    return filters.split_query(questions(spark, sf_dir), RULES).select(
        "query_id", "f_year", "f_program", "f_author"
    )


JSON_FORMS = (
    '```json\\n{"semantic_query": "presensi", "tahun": 2023, "prodi": "Informatika", "penulis": null}\\n```',
    'Hasil: {"semantic_query": "", "query": "web", "tahun": "2021.0", "prodi": "-", "penulis": "Sari"} selesai',
    "tidak ada",
    '{"tahun": 1990, "prodi": null, "penulis": "none"}',
    "{rusak: ",
)


@query(
    "json_filter_fields",
    """
WITH f AS (SELECT * FROM (VALUES (0, 2023, 'Informatika', NULL, NULL), (1, 2021, NULL, 'Sari', NULL),
   (2, NULL, NULL, NULL, 'json_extraction_failed:empty_output'), (3, NULL, NULL, NULL, 'no_valid_filters_extracted'),
   (4, NULL, NULL, NULL, 'json_extraction_failed:empty_output')) t(k, f_year, f_program, f_author, fallback_reason))
SELECT conv_id * 1000 + turn AS query_id, f_year, f_program, f_author, fallback_reason
FROM conversations JOIN f ON k = (conv_id + turn) % 5 WHERE role = 'user'""",
)
def json_filter_fields(spark, sf_dir):
    forms = F.array(*[F.lit(s.replace("\\n", "\n")) for s in JSON_FORMS])
    q = questions(spark, sf_dir).withColumn(
        "raw", F.element_at(forms, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    )
    return filters.fields_from_json(q, "raw", RULES).select(
        "query_id", "f_year", "f_program", "f_author", "fallback_reason"
    )


@query(
    "doc_focus",
    f"""WITH {QUESTION_CTE},
a AS (SELECT query_id, regexp_extract_all(text, '(?i)([A-Za-z0-9_]+\\.pdf)', 1) AS files,
  regexp_extract_all(text, '{P['doc_id_style']}') AS ids FROM questions)
SELECT query_id, len(files) * 2 + len(ids) > 0 AS focused,
  array_to_string(flatten([[x, x[1:-5]] FOR x IN list_distinct(files)]) || list_distinct(ids), ',') AS docs FROM a""",
)
def doc_focus(spark, sf_dir):
    return questions(spark, sf_dir).select(
        "query_id",
        (F.size(filters.doc_focus("text", RULES)) > 0).alias("focused"),
        F.array_join(filters.doc_focus("text", RULES), ",").alias("docs"),
    )


