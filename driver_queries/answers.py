"""Answer texts, verification and evaluation over answers made from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import query, sql_any, sql_list, table
from driver_queries.coverage import contexts, expansion_pool, target_queries
from driver_queries.themes import HIT_CTES, QUESTIONS, RULES, choose, sql_choose, themed_hits
from folioscan.functions.text import stripped_lines
from folioscan.operators import aggregation, evaluation, expansion, topic_answers, verification
from folioscan.operators import answers as A
from folioscan.session import job_folder
from folioscan.sources import logs

L, WL = RULES.pattern_lists, RULES.word_lists

# {1} is the whole message in one line, {2} its last line.
FORMS = (
    "Jawaban: {1}\nBukti:\n- {1} [CTX 1]\n- {2} [CTX 2]",
    "Jawaban: {1}\nBukti:\n- zebraqq [CTX 1]\n- {1} [CTX 1]",
    "Jawaban: Tidak ditemukan pada dokumen.\nBukti: -",
    "Jawaban: {1}\nBukti:\n- {1}",
    "Jawaban: {1}\nBukti:\n- {1} [CTX 99]",
    "{1} tanpa format",
    "Jawaban: hasil parsial {1}\nBukti:\n- {1} [CTX 1]",
    "Jawaban: RAD: Tidak ditemukan pada dokumen.\nXP: {1}\nBukti:\n- (RAD) {1} (CTX 1)\n- {1} [CTX 1]\n- {2} [CTX 1]\n- {2} akhir [CTX 1]",
    "Pertanyaan: apa?\nJawaban: {1}\nBukti:\n{1} CTX 1\n{1} [CTX 1] [12]",
)

ANSWER_CTE = f"""
am AS (SELECT conv_id, turn, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS ls
       FROM conversations WHERE role = 'assistant'),
ans AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, ls AS contexts,
   {sql_choose(QUESTIONS, 'conv_id * 7 + turn - 1')} AS question,
   replace(replace(replace({sql_choose(tuple(f.replace(chr(10), '~') for f in FORMS), 'conv_id + turn')}, '~', chr(10)), '{{1}}', array_to_string(ls, ' ')),
       '{{2}}', coalesce(ls[len(ls)], '')) AS answer FROM am)"""


def answers(spark, sf_dir):
    lines = stripped_lines(F.col("text"))
    i = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("contexts", lines)
    form = choose(FORMS, i + F.col("turn"))
    one = F.array_join("contexts", " ")
    two = F.coalesce(F.try_element_at("contexts", F.lit(-1)), F.lit(""))
    return rows.select(
        (i * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "contexts",
        choose(QUESTIONS, i * 7 + F.col("turn") - 1).alias("question"),
        F.replace(F.replace(form, F.lit("{1}"), one), F.lit("{2}"), two).alias("answer"),
    )


@query(
    "parsed_answers",
    f"""WITH {ANSWER_CTE},
t AS (SELECT answer_id, CASE WHEN regexp_matches(answer, '(?im)^\\s*Jawaban\\s*:') THEN trim(regexp_extract(answer, '(?is)(?:^|\\n)\\s*(Jawaban\\s*:.*)$', 1), ' ' || chr(10))
   ELSE trim(answer, ' ' || chr(10)) END AS t FROM ans),
p AS (SELECT answer_id, t, regexp_matches(t, '(?i)\\bBukti\\s*:') AS has, trim(regexp_extract(t, '(?is)^(.*?)\\bBukti\\s*:', 1), ' ' || chr(10)) AS head,
   trim(regexp_extract(t, '(?is)^.*?\\bBukti\\s*:(.*)$', 1), ' ' || chr(10)) AS tail FROM t)
SELECT answer_id, CASE WHEN has THEN trim(regexp_replace(head, '(?is)^\\s*Jawaban\\s*:\\s*', '')) ELSE t END AS parsed,
  CASE WHEN has THEN len([x FOR x IN string_split(tail, chr(10)) IF trim(x) NOT IN ('', '-')]) ELSE 0 END AS n_evidence FROM p""",
)
def parsed_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("answer_id", A.parse_answer("answer").alias("p")).select(
        "answer_id", F.col("p.answer").alias("parsed"), F.size("p.evidence").alias("n_evidence")
    )


@query(
    "citation_checks",
    f"""WITH {ANSWER_CTE},
c AS (SELECT answer_id, answer, len(contexts) AS used, [x::INT FOR x IN regexp_extract_all(answer, '(?i)\\[CTX\\s*(\\d+)\\]', 1)] AS nums FROM ans)
SELECT answer_id, regexp_matches(answer, '(?i)(\\[CTX\\s*\\d+\\]|\\(CTX\\s*\\d+\\)|\\bCTX\\s*\\d+\\b)') AS cited, array_to_string(nums, ',') AS nums,
  array_to_string(list_sort([n FOR n IN list_distinct(nums) IF n BETWEEN 1 AND used]), ',') AS valid_nums,
  len(nums) = len([n FOR n IN nums IF n BETWEEN 1 AND used]) AS in_range,
  regexp_matches(trim(answer), '(?im)^\\s*Jawaban\\s*:') AND regexp_matches(trim(answer), '(?im)^\\s*Bukti\\s*:') AS valid_format FROM c""",
)
def citation_checks(spark, sf_dir):
    used = F.size("contexts")
    return answers(spark, sf_dir).select(
        "answer_id",
        A.has_citation("answer").alias("cited"),
        F.array_join(A.ctx_nums("answer"), ",").alias("nums"),
        F.array_join(F.array_sort(A.valid_ctx_nums(A.ctx_nums("answer"), used)), ",").alias("valid_nums"),
        A.citations_in_range("answer", used).alias("in_range"),
        A.valid_format("answer").alias("valid_format"),
    )


@query("repaired_answers")
def repaired_answers(spark, sf_dir):
    """The fixed order of repairs: normalise, format, list, dedupe, move, clean."""
    rows = answers(spark, sf_dir)
    steps = {
        "a1": lambda c: A.repaired(c, RULES),
        "a6": lambda c: A.evidence_from_answer(c, labels=("RAD", "Prototyping")),
        "a7": A.fix_empty_numbers,
        "a8": A.strip_answer_citations,
    }
    prev = "answer"
    for name, fn in steps.items():
        rows = rows.withColumn(name, fn(F.col(prev)))
        prev = name
    return rows.select(
        "answer_id", F.col(prev).alias("repaired"),
        A.sanity_check(F.col(prev), labels=("RAD", "Prototyping")).alias("checks"),
    )


STOP_G = sql_list(RULES.words("stop_qa", "stop_grounding_extra"))
STOP_S = sql_list(RULES.words("stop_qa", "stop_support_extra"))


def ordered_words(expr: str, stop: str, n: int, k: int) -> str:
    """First k distinct words in text order."""
    w = f"regexp_extract_all(lower({expr}), '[a-z]{{{n},}}')"
    return f"(list_filter({w}, lambda x, i: NOT list_contains({stop}, x) AND list_position({w}, x) = i))[1:{k}]"


@query(
    "answer_keywords",
    f"""WITH {ANSWER_CTE} SELECT answer_id,
  array_to_string({ordered_words("regexp_replace(answer, '(?i)[[]CTX\\s*\\d+[]]', '', 'g')", STOP_G, 3, 10)}, ',') AS grounding,
  array_to_string({ordered_words('question', STOP_S, 4, 8)}, ',') AS support FROM ans""",
)
def answer_keywords(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "answer_id",
        F.array_join(A.grounding_keywords("answer", RULES), ",").alias("grounding"),
        F.array_join(A.support_keywords("question", RULES), ",").alias("support"),
    )


def kws(expr: str, n: int) -> str:
    return ordered_words(f"regexp_replace({expr}, '(?i)[[]CTX\\s*\\d+[]]', '', 'g')", STOP_G, 3, n)


VERIFY_CTES = f"""{ANSWER_CTE},
v0 AS (SELECT *, trim(answer) AS t, len(contexts) AS used, lower(array_to_string(contexts, ' ')) AS hay FROM ans),
v1 AS (SELECT *, contains(t, 'Bukti:') AS mark, trim(split_part(t, 'Bukti:', 1), ' ' || chr(10)) AS head0,
   trim(t[strpos(t, 'Bukti:') + 6:], ' ' || chr(10)) AS tail FROM v0),
v2 AS (SELECT *, CASE WHEN mark THEN [trim(ltrim(trim(x), '-')) FOR x IN string_split(tail, chr(10)) IF trim(x) NOT IN ('', '-')] ELSE [] END AS bl,
   trim(regexp_replace(CASE WHEN mark THEN head0 ELSE t END, '(?im)^\\s*Jawaban\\s*:\\s*', '', 'g'), ' ' || chr(10)) AS body,
   regexp_matches(t, '(?is)^\\s*Jawaban\\s*:\\s*Tidak\\s+ditemukan\\s+pada\\s+dokumen\\.\\s*Bukti\\s*:\\s*-\\s*$') AS nf,
   regexp_matches(t, '(?im)^\\s*Jawaban\\s*:') AND regexp_matches(t, '(?im)^\\s*Bukti\\s*:') AS format_ok,
   mark AND (tail = '-' OR len([x FOR x IN string_split(tail, chr(10)) IF starts_with(trim(x), '-')]) > 0) AS evidence_ok,
   regexp_matches(t, '(?i)(\\[CTX\\s*\\d+\\]|\\(CTX\\s*\\d+\\)|\\bCTX\\s*\\d+\\b)') AS cited,
   [x::INT FOR x IN regexp_extract_all(t, '(?i)\\[CTX\\s*(\\d+)\\]', 1)] AS nums FROM v1),
v3 AS (SELECT *, CASE WHEN used <= 0 THEN len(nums) = 0 ELSE len(nums) = len([n FOR n IN nums IF n BETWEEN 1 AND used]) END AS in_range,
   {kws('body', 12)} AS akw FROM v2),
bu AS (SELECT answer_id, used, contexts, unnest(bl) AS b, generate_subscripts(bl, 1) AS bi FROM v3),
bf AS (SELECT *, [x::INT FOR x IN regexp_extract_all(b, '(?i)\\[CTX\\s*(\\d+)\\]', 1)] AS bn, lower(trim(regexp_extract(b, '^\\(\\s*([A-Za-z_ ]+)\\s*\\)', 1))) AS px,
   {kws('b', 10)} AS kw FROM bu),
bg AS (SELECT *, len([n FOR n IN bn IF n BETWEEN 1 AND used AND ((px <> '' AND contains(lower(contexts[n]), px)) OR len([k FOR k IN kw IF contains(lower(contexts[n]), k)]) > 0)]) > 0 AS gr,
   len(bn) > 0 AND len(bn) = len([n FOR n IN bn IF n BETWEEN 1 AND used]) AS valid FROM bf),
ba AS (SELECT answer_id, count(*) AS total, count(*) FILTER (len(bn) > 0) AS w, count(*) FILTER (valid) AS va, count(*) FILTER (valid AND gr) AS g, bool_and(gr) AS allg
   FROM bg GROUP BY answer_id),
v4 AS (SELECT v3.*, coalesce(total, 0) AS total, coalesce(w, 0) AS w, coalesce(va, 0) AS va, coalesce(g, 0) AS g,
   nf OR used <= 0 OR coalesce(allg, true) AS grounding_ok,
   nf OR used <= 0 OR len(akw) = 0 OR len([k FOR k IN akw IF contains(hay, k)]) >= CASE WHEN len(akw) <= 4 THEN 1 ELSE 2 END AS answer_ok,
   NOT nf AND len([x FOR x IN string_split(body, chr(10)) IF contains(lower(regexp_extract(trim(x), '^([A-Za-z_ ].+?)\\s*:\\s*(.*)$', 2)), 'tidak ditemukan pada dokumen')]) > 0 AS pnf,
   {sql_any('lower(body)', L['caution'])} AS caution, used > 0 AND len([k FOR k IN {ordered_words('question', STOP_S, 4, 8)} IF contains(hay, k)
     AND NOT list_contains({sql_list(WL['generic_support'])}, k)]) > 0 AS sup FROM v3 LEFT JOIN ba USING (answer_id)),
v5 AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN nf THEN 'not_found' WHEN NOT format_ok OR NOT evidence_ok THEN 'invalid_format'
   WHEN used > 0 AND NOT cited THEN 'missing_citation' WHEN used > 0 AND NOT in_range THEN 'invalid_citation_range'
   WHEN used > 0 AND NOT grounding_ok THEN 'weak_grounding_bukti' WHEN used > 0 AND NOT answer_ok THEN 'weak_grounding_jawaban'
   WHEN NOT nf AND total > 3 THEN 'bukti_overflow' ELSE 'ok' END AS status,
   CASE WHEN total > 0 THEN round(va / total, 6) ELSE 0 END AS cr, CASE WHEN total > 0 THEN round(g / total, 6) ELSE 0 END AS gratio FROM v4),
v6 AS (SELECT *, CASE WHEN status = 'not_found' THEN 'not_found' WHEN NOT format_ok OR NOT evidence_ok THEN 'low'
   WHEN used > 0 AND (NOT cited OR NOT in_range) THEN 'low' WHEN total <= 0 THEN 'low'
   WHEN gratio >= 0.999999 AND answer_ok AND NOT caution AND NOT pnf THEN 'verified'
   WHEN gratio >= 0.5 AND (answer_ok OR in_range OR sup) THEN 'partial' ELSE 'low' END AS label,
   0.1 * format_ok::INT + 0.1 * evidence_ok::INT + 0.15 * cited::INT + 0.15 * in_range::INT + 0.2 * cr + 0.2 * gratio + 0.1 * answer_ok::INT AS s FROM v5)"""


def verified(spark, sf_dir):
    rows = verification.with_generation(answers(spark, sf_dir), RULES)
    return verification.with_verification(rows, RULES)


@query(
    "verification",
    f"""WITH {VERIFY_CTES} SELECT answer_id, status, label, total AS bullets, w AS with_citation, va AS valid_citation, g AS grounded,
  CASE WHEN label <> 'not_found' THEN round(CASE WHEN caution OR pnf THEN least(s, 0.79) ELSE s END, 6) END AS score, caution, pnf AS partial_not_found, sup AS supported
FROM v6""",
)
def verification_query(spark, sf_dir):
    return verified(spark, sf_dir).select(
        "answer_id",
        F.col("generation.status").alias("status"),
        F.col("verification.label").alias("label"),
        F.col("verification.evidence_summary.bullet_total").alias("bullets"),
        F.col("verification.evidence_summary.bullet_with_citation").alias("with_citation"),
        F.col("verification.evidence_summary.bullet_valid_citation").alias("valid_citation"),
        F.col("verification.evidence_summary.bullet_grounded").alias("grounded"),
        F.col("verification.score").alias("score"),
        F.col("verification.signals.coverage_caution").alias("caution"),
        F.col("generation.partial_not_found").alias("partial_not_found"),
        F.col("generation.supported").alias("supported"),
    )


@query("guarded_answers")
def guarded_answers(spark, sf_dir):
    rows = verification.with_generation(answers(spark, sf_dir), RULES)
    return verification.guarded_answer(rows, RULES).select("answer_id", "generation.status", "final_answer")


@query("answer_sections")
def answer_sections(spark, sf_dir):
    rows = answers(spark, sf_dir).select(
        "answer_id", "answer",
        F.array(F.lit("RAD"), F.lit("EXTREME_PROGRAMMING"), F.lit("PROTOTYPING")).alias("targets"),
    )
    return topic_answers.topic_sections(rows, RULES)


@query("topic_answers")
def topic_answers_query(spark, sf_dir):
    ctx = contexts(spark, sf_dir)
    q = target_queries(ctx).withColumn("text", F.lit("apa metode yang digunakan"))
    return topic_answers.topic_answers(ctx.select("query_id", "ctx", "text"), q, RULES)


@query("steps_answers")
def steps_answers(spark, sf_dir):
    ctx = contexts(spark, sf_dir)
    q = target_queries(ctx).withColumn("text", F.lit("apa perbedaan tahapannya"))
    return topic_answers.steps_answers(ctx.select("query_id", "ctx", "text"), q, RULES)


@query("comparison_answers")
def comparison_answers(spark, sf_dir):
    ctx = contexts(spark, sf_dir).persist()
    q = target_queries(ctx)
    chosen = aggregation.comparison_contexts(ctx, RULES)
    status = aggregation.comparison_status(chosen, q)
    signals = aggregation.comparison_signals(ctx, chosen, RULES)
    tab = topic_answers.comparison_table(signals, status, q, RULES)
    return topic_answers.comparison_answers(tab, topic_answers.comparison_evidence(tab, RULES), RULES)


@query("single_topic_steps")
def single_topic_steps(spark, sf_dir):
    pool = expansion_pool(spark, sf_dir).persist()
    status = expansion.steps_status(expansion.steps_expansion(pool, RULES))
    i = F.col("query_id") % 4
    none = F.array().cast("array<string>")
    docs = F.when(i == 0, F.array(F.lit("d1"), F.lit("d2"))).when(i == 1, none).otherwise(F.array(F.lit("d1")))
    per = pool.groupBy("query_id").agg(F.first("topic").alias("topic")).withColumn("candidate_docs", docs)
    _, how = expansion.steps_target_doc(allowed=none, accepted=F.col("candidate_docs"))
    return topic_answers.single_topic_steps(status, per.withColumn("resolve_status", how), RULES)


@query(
    "extractive_answers",
    f"""WITH {HIT_CTES},
c AS (SELECT query_id, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM hits WHERE rank <= 3)
SELECT query_id, 'Jawaban: Informasi relevan ditemukan pada potongan dokumen berikut.' || chr(10) || 'Bukti:' || chr(10) ||
  string_agg('- ' || CASE WHEN length(s) > 240 THEN s[1:240] || '...' ELSE s END || ' [CTX ' || rank || ']', chr(10) ORDER BY rank) AS answer
FROM c GROUP BY query_id""",
)
def extractive_answers(spark, sf_dir):
    ctx = themed_hits(spark, sf_dir).where("rank <= 3").groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("c")
    )
    return ctx.select("query_id", A.extractive_answer(F.col("c"), F.size("c"), RULES).alias("answer"))


# -- evaluation -------------------------------------------------------------------------


def log_tables(spark, sf_dir):
    """Answer and retrieval logs: three context ids per answer, one of them
    known to the chunk table, one to the record only, one to neither."""
    a = answers(spark, sf_dir)
    i = F.col("answer_id")
    key = [F.concat(F.lit("run"), F.col("conv_id") % 7).alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id")]
    m = i % 4
    ids = (
        F.when(m == 0, F.array(F.col("conv_id").cast("string"), F.concat(F.lit("p"), i), F.lit("x")))
        .when(m == 1, F.array(F.concat(F.lit("p"), i), F.lit(""), F.concat(F.lit("p"), i)))
        .when(m == 2, F.array(F.col("conv_id").cast("string")))
        .otherwise(F.array().cast("array<string>"))
    )
    ans = a.select(
        *key, F.col("question").alias("user_query"),
        F.when(i % 3 == 0, F.concat("question", F.lit(" detail"))).when(i % 3 == 1, F.col("question")).alias("retrieval_query"),
        "answer", ids.alias("used_context_chunk_ids"),
        F.when(i % 8 == 3, F.array(F.lit(" lama "), F.lit(""))).otherwise(F.array().cast("array<string>")).alias("contexts"),
        F.struct((i % 11 == 0).alias("handled")).alias("metadata_route"),
    )
    node = F.struct(F.concat(F.lit("p"), i).alias("chunk_id"), F.concat(F.lit("pratinjau "), i).alias("text"))
    rec = a.select(
        *key, i.alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("log_pos")
    ).where("answer_id % 5 <> 0").withColumn("_n", node)
    rec = rec.select(
        "run_id", "turn_id", "log_pos", F.concat(F.lit("mode"), "log_pos").alias("retrieval_mode"),
        F.array("_n").alias("retrieved_nodes"),
    )
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit("narasi").alias("stream"), "text"
    )
    return ans, rec, chunks


EVAL_CTE = f"""{ANSWER_CTE},
l AS (SELECT 'run' || (conv_id % 7) AS run_id, answer_id AS turn_id, answer_id % 5 <> 0 AS rec, question, answer, answer_id, conv_id,
   d.doc_id IS NOT NULL AS known, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS doc_text
   FROM ans LEFT JOIN documents d ON d.doc_id = conv_id),
e AS (SELECT *, CASE answer_id % 4 WHEN 0 THEN known::INT + rec::INT WHEN 1 THEN rec::INT WHEN 2 THEN known::INT ELSE 0 END AS nctx,
   CASE answer_id % 4 WHEN 0 THEN known WHEN 2 THEN known ELSE false END AS f, answer_id % 4 IN (0, 1) AND rec AS p, answer_id % 8 = 3 AS old FROM l),
x AS (SELECT *, CASE WHEN nctx > 0 THEN nctx WHEN old THEN 1 ELSE 0 END AS context_count,
   CASE WHEN nctx > 0 AND f AND p THEN 'index_plus_retrieval_fallback' WHEN nctx > 0 AND f THEN 'index_full' WHEN nctx > 0 THEN 'retrieval_join'
        WHEN old THEN 'answers_fallback' ELSE 'none' END AS context_source,
   CASE answer_id % 4 WHEN 0 THEN 3 - nctx WHEN 1 THEN 1 - nctx WHEN 2 THEN 1 - nctx ELSE 0 END AS n_missing,
   md5(concat_ws('|', CASE WHEN f THEN doc_text END, CASE WHEN p THEN 'pratinjau ' || answer_id END, CASE WHEN nctx = 0 AND old THEN 'lama' END)) AS ctx_md5,
   CASE WHEN answer_id % 11 = 0 THEN 'metadata_route_skipped' WHEN (conv_id + turn_id - conv_id * 1000) % 9 = 2 THEN 'global_not_found_skipped'
        WHEN nctx = 0 AND NOT old THEN 'no_final_contexts' END AS skip_reason FROM e)"""


@query(
    "eval_join",
    f"""WITH {EVAL_CTE} SELECT run_id, turn_id, context_count, context_source, n_missing,
  CASE WHEN answer_id % 3 = 0 THEN 'retrieval_query' ELSE 'user_query' END AS question_source,
  skip_reason, ctx_md5, rec AS retrieval_record_found,
  CASE WHEN rec THEN 'mode2' END AS retrieval_mode FROM x""",
)
def eval_join(spark, sf_dir):
    ans, rec, chunks = log_tables(spark, sf_dir)
    rebuilt = evaluation.rebuild_contexts(ans, evaluation.last_per_key(rec), chunks)
    return evaluation.audit_rows(rebuilt).select(
        "run_id", "turn_id", "context_count", "context_source",
        F.size("missing_context_chunk_ids").alias("n_missing"), "question_source", "skip_reason",
        F.md5(F.array_join("contexts", "|")).alias("ctx_md5"),
        "retrieval_record_found", "retrieval_mode",
    )


@query(
    "eval_rows",
    f"""WITH {EVAL_CTE} SELECT run_id, turn_id, context_count, ctx_md5, q AS user_input, q AS question_eval, question AS question_user, a AS response
FROM (SELECT *, CASE WHEN answer_id % 3 = 0 THEN question || ' detail' ELSE question END AS q,
  regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a FROM x WHERE skip_reason IS NULL)""",
)
def eval_rows(spark, sf_dir):
    ans, rec, chunks = log_tables(spark, sf_dir)
    rebuilt = evaluation.rebuild_contexts(ans, evaluation.last_per_key(rec), chunks)
    rows = evaluation.normalize_eval_rows(evaluation.eval_rows(evaluation.audit_rows(rebuilt)))
    return rows.select(
        "run_id", "turn_id", "context_count", F.md5(F.array_join("retrieved_contexts", "|")).alias("ctx_md5"),
        "user_input", "question_eval", "question_user", "response",
    )


METRIC_SQL = """m AS (SELECT source AS run_id, doc_id AS turn_id, quality IS NOT NULL AS matched, quality::DOUBLE AS faithfulness,
   CASE WHEN toxic = 0 THEN n_chars / 1000.0 END AS answer_relevancy,
   CASE WHEN doc_id % 7 <> 0 AND quality IS NOT NULL THEN doc_id / 10.0 END AS context_precision FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    "metric_summary",
    f"""WITH {METRIC_SQL} SELECT run_id, count(*) AS n_rows, round(avg(faithfulness), 6) AS mean_faithfulness, round(avg(answer_relevancy), 6) AS mean_answer_relevancy,
  round(avg(context_precision), 6) AS mean_context_precision, count(*) FILTER (faithfulness IS NULL) AS missing_faithfulness,
  count(*) FILTER (answer_relevancy IS NULL) AS missing_answer_relevancy, count(*) FILTER (context_precision IS NULL) AS missing_context_precision,
  count(*) FILTER (faithfulness IS NOT NULL AND answer_relevancy IS NOT NULL AND context_precision IS NOT NULL) AS rows_ok,
  count(*) FILTER (matched AND (faithfulness IS NULL OR answer_relevancy IS NULL OR context_precision IS NULL)) AS rows_partial,
  count(*) FILTER (NOT matched) AS rows_unmatched FROM m GROUP BY run_id""",
)
def metric_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nan = F.lit(float("nan"))
    m = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("turn_id"),
        F.col("quality").cast("double").alias("faithfulness"),
        F.when(F.col("toxic") == 1, nan).otherwise(F.col("n_chars") / 1000.0).alias("response_relevancy"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") / 10.0).alias("context_precision"),
    )
    rows = evaluation.keyed(docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("turn_id")))
    return evaluation.metric_summary(evaluation.with_metrics(rows, m), "run_id")


@query(
    "reference_flags",
    "SELECT bool_and(quality IS NOT NULL) AS has_reference_answers, bool_and(text <> '') AS has_reference_contexts FROM documents LEFT JOIN labels USING (doc_id)",
)
def reference_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.reference_flags(
        d.select(F.col("quality").cast("string").alias("reference"), F.array("text").alias("reference_contexts"))
    )


@query(
    "retrieval_records",
    f"""WITH {HIT_CTES} SELECT query_id AS turn_id, count(*) AS n_nodes, arg_min(doc_id, rank) AS first_doc,
  max(CASE WHEN length(text) > 500 THEN 513 ELSE length(text) END) AS longest FROM hits GROUP BY query_id""",
)
def retrieval_records(spark, sf_dir):
    hits = themed_hits(spark, sf_dir)
    q = hits.select("query_id").distinct().select(
        "query_id", F.lit("r").alias("run_id"), F.col("query_id").alias("turn_id"), F.lit("q").alias("text")
    )
    rec = logs.retrieval_records(hits, q, config={"top_k": 12}, mode="dense", top_k=12)
    return rec.select(
        "turn_id", F.size("retrieved_nodes").alias("n_nodes"),
        F.get("retrieved_nodes", 0)["doc_id"].alias("first_doc"),
        F.array_max(F.transform("retrieved_nodes", lambda n: F.length(n["text"]))).alias("longest"),
    )


@query(
    "log_append",
    """SELECT 'conv' || conv_id AS run_id, turn::VARCHAR AS turn_id, text AS user_query, role AS strategy
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL""",
)
def log_append(spark, sf_dir):
    """Two batches of a log, the first of them appended twice, read once."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    rows = c.select(
        "conv_id", F.concat(F.lit("conv"), "conv_id").alias("run_id"), F.col("turn").cast("string").alias("turn_id"),
        F.col("text").alias("user_query"), F.col("role").alias("strategy"),
    )
    path = job_folder(spark, "answers-log")
    for batch in ("even", "odd", "even"):
        own = F.col("conv_id") % 2 == (0 if batch == "even" else 1)
        logs.append_jsonl(rows.where(own).drop("conv_id"), path, batch)
    read, _ = logs.read_jsonl(spark, path, logs.ANSWER_SCHEMA)
    return read.select("run_id", "turn_id", "user_query", "strategy")
