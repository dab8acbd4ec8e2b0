"""Derived views with Indonesian sentences, and SQL for the topic rules.

The driver texts are invented words, so the rule data would match nothing.
These views put one template sentence in front of every row of a table; the
sentence follows from the row's id, and the rest of the text stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driver_queries.base import (
    DENSE_CTES,
    DENSE_HITS,
    sql_any,
    sql_contains_any,
    sql_count,
    sql_list,
    squeezed,
    table,
    vector_queries,
    vectors,
)
from folioscan.operators import dense
from folioscan.rules import INDONESIAN as RULES

QUESTIONS = (
    "Apa saja tahapan metode RAD dan Prototyping?",
    "Jelaskan metode Extreme Programming yang digunakan pada skripsi tahun 2022 prodi Teknik Informatika tentang presensi.",
    "Ada berapa skripsi yang menggunakan metode RAD? Sebutkan judulnya dan penulisnya.",
    "Apa metode yang digunakan dalam penelitian karya Budi Santoso?",
    "Bagaimana alur sistem itu?",
    "Bandingkan metode waterfall dan scrum.",
    "Sebutkan referensi jurnal yang digunakan.",
    "Tahapannya apa saja?",
    "Bisa lebih ringkas lagi langkah utamanya?",
    "Ganti topik, sekarang bahas basis data.",
    "Berapa jumlah halaman dokumen E-Ticketing?",
    "Apa isi dokumen ABC_2023_Sistem_Prototyping dan laporan_akhir.pdf?",
    "Semua metode apa saja yang dipakai di beberapa dokumen?",
    "Dokumen yang menggunakan model prototyping",
    "Siapa penulis skripsi pada tahun 1999?",
    "Apa tujuan penelitian ini?",
)

SENTENCES = (
    "Penelitian ini menggunakan metode RAD karena cepat dan fleksibel.",
    "Penelitian terdahulu membahas metode prototyping sebagai studi kasus.",
    "Tahapan metode prototyping meliputi analisis kebutuhan, perancangan sistem, implementasi dan pengujian.",
    "Metode waterfall digunakan karena sesuai kebutuhan pengguna.",
    "Langkah-langkah RAD yaitu planning, design, coding dan testing.\n1. perencanaan sistem\n2. perancangan antarmuka\n3. implementasi kode",
    "Use case diagram dan blackbox testing pada tahap pengujian.",
    "Tinjauan pustaka menjelaskan scrum dan rational unified process.",
    "Sistem ini dikembangkan dengan extreme programming.",
    "Kata pengantar dan ucapan terima kasih.",
    "Prototype sistem informasi dibuat pada fase desain.",
    "Karakteristik metode RAD bersifat incremental dan memungkinkan iterasi.",
)

DOC_NAMES = ("Sistem_Prototyping", "Aplikasi_RAD", "Umum", "SistemWaterfall", "Lain", "Scrum_Web", "Data")
LABELS = ("BAB_I", "BAB_II", "BAB_III", "BAB_IV", "BAB_V", "UNKNOWN")
TARGETS = (
    ("RAD", "PROTOTYPING"),
    ("WATERFALL",),
    ("AGILE", "RAD", "EXTREME_PROGRAMMING"),
    ("PROTOTYPING", "RUP"),
    ("RAD",),
)


def choose(values, index: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_choose(values, index: str) -> str:
    return f"({sql_list(values)})[1 + ({index}) % {len(values)}]"


# -- questions -------------------------------------------------------------------

QUESTION_CTE = f"""
questions AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn,
    {sql_choose(QUESTIONS, 'conv_id * 7 + turn')} || ' ' || text AS text
  FROM conversations WHERE role = 'user')"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        "conv_id",
        "turn",
        F.concat_ws(
            " ",
            choose(QUESTIONS, F.col("conv_id") * 7 + F.col("turn")),
            F.col("text"),
        ).alias("text"),
    )


# -- themed chunks -----------------------------------------------------------------

CHUNK_CTE = f"""
chunks AS (SELECT doc_id AS chunk_id,
    {sql_choose(SENTENCES, 'doc_id')} || ' ' || text AS text,
    'DOC_' || {sql_choose(DOC_NAMES, 'doc_id')} || '_' || (doc_id % 3) AS doc,
    {sql_choose(LABELS, 'doc_id')} AS label
  FROM documents)"""


def themed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"),
        F.concat_ws(" ", choose(SENTENCES, i), F.col("text")).alias("text"),
        F.concat(F.lit("DOC_"), choose(DOC_NAMES, i), F.lit("_"), i % 3).alias("doc_id"),
        choose(LABELS, i).alias("label"),
    )


# -- themed hits: dense hits with themed text ------------------------------------------

HITS_K = 12

#: only vectors of documents are searched, so that every hit has a text
DOC_DENSE_CTES = DENSE_CTES.replace("FROM qv, embeddings)", "FROM qv, embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")

HIT_CTES = f"""{DOC_DENSE_CTES}, {DENSE_HITS.format(k=HITS_K)}, {CHUNK_CTE},
hits AS (SELECT de.query_id, de.rank, de.chunk_id, de.score, c.text, c.doc AS doc_id, c.label,
     ({'[' + ', '.join(sql_list(t) for t in TARGETS) + ']'})[1 + de.query_id % {len(TARGETS)}] AS targets
   FROM de JOIN chunks c USING (chunk_id))"""


def target_array(index: Column) -> Column:
    arr = F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in TARGETS])
    return F.element_at(arr, (F.pmod(index, F.lit(len(TARGETS))) + 1).cast("int"))


def themed_hits(spark: SparkSession, sf_dir: str, k: int = HITS_K) -> DataFrame:
    known = themed_chunks(spark, sf_dir).select("chunk_id")
    hits = dense.dense_topk(
        vectors(spark, sf_dir).join(known, "chunk_id", "left_semi"), vector_queries(spark, sf_dir).select("query_id", "embedding"), k=k
    )
    # k rows a question, read more than once; kept, so that no filter on a hit's text moves below
    # the join and runs its patterns on every document
    return (
        hits.select("query_id", "rank", "chunk_id", "ord", "score")
        .join(themed_chunks(spark, sf_dir), "chunk_id")
        .withColumn("targets", target_array(F.col("query_id")))
        .withColumn("source_file", F.concat("doc_id", F.lit(".pdf")))
        .persist()
    )


# -- SQL for the rules ------------------------------------------------------------------


def low_squeezed(expr: str) -> str:
    return f"lower({squeezed(expr)})"


def topic_text_sql(expr: str) -> str:
    e = f"regexp_replace({expr}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    e = f"regexp_replace({e}, '[_\\-]+', ' ', 'g')"
    return low_squeezed(e)


def topic_list_sql(cond) -> str:
    """Names of the topics for which ``cond(topic)`` holds."""
    cases = ", ".join(f"CASE WHEN {cond(t)} THEN '{t.name}' END" for t in RULES.topics)
    return f"[t FOR t IN [{cases}] IF t IS NOT NULL]"


def topics_in_sql(expr: str) -> str:
    t = topic_text_sql(expr)
    return topic_list_sql(lambda topic: sql_any(t, topic.mention))


def id_hint_sql(doc: str, topic) -> str:
    return sql_contains_any(f"lower({doc})", topic.id_hints)


def supports_sql(doc: str, text: str, topic) -> str:
    out = id_hint_sql(doc, topic)
    if topic.strict:
        out += " OR " + sql_any(f"lower({text})", topic.strict)
    if not topic.strict_only:
        out += " OR " + sql_any(topic_text_sql(f"lower({text})"), topic.mention)
    return f"({out})"


def strong_sql(doc: str, text: str, blob: str, topic) -> str:
    return (
        f"({supports_sql(doc, text, topic)} OR {sql_any(low_squeezed(blob), topic.strong)}"
        f" OR {sql_any(low_squeezed(text), topic.strong)})"
    )


def mention_sql(text: str, topic) -> str:
    return sql_any(low_squeezed(text), topic.mention)


def steps_strength_sql(expr: str) -> str:
    t = low_squeezed(expr)
    return (
        f"(CASE WHEN contains({t}, 'langkah-langkah') OR contains({t}, 'langkah langkah') THEN 4 ELSE 0 END"
        f" + CASE WHEN contains({t}, 'tahapan') THEN 4 ELSE 0 END"
        f" + CASE WHEN {sql_any(t, r'\btiga\s+tahapan\b')} THEN 3 ELSE 0 END"
        f" + CASE WHEN {sql_any(t, r'\bfase\b')} THEN 2 ELSE 0 END"
        f" + CASE WHEN {sql_any(t, r'(?:^|\s)1\.\s')} THEN 2 ELSE 0 END"
        f" + CASE WHEN {sql_any(t, r'(?:^|\s)2\.\s')} THEN 2 ELSE 0 END"
        f" + CASE WHEN {sql_any(t, r'(?:^|\s)3\.\s')} THEN 2 ELSE 0 END"
        f" + CASE WHEN {sql_any(t, r'\btahap\b')} THEN 1 ELSE 0 END)"
    )


def steps_signal_sql(expr: str) -> str:
    t = f"trim(regexp_replace(lower({expr}), '(?im)^doc:\\s.*\\n', '', 'g'))"
    stage = sql_count(t, [rf"\b{w}\b" for w in RULES.word_lists["stage_terms"]])
    return (
        f"({sql_any(t, RULES.patterns['steps_word'])}"
        f" OR regexp_matches({t}, '(?m)^\\s*(\\d+[\\.\\)]|[a-c][\\.\\)]|[-•])\\s+')"
        f" OR ({sql_any(t, RULES.patterns['list_connector'])} AND {stage} >= 2))"
    )


def owner_cue_sql(expr: str) -> str:
    return sql_any(low_squeezed(expr), RULES.pattern_lists["owner_cue"])


def related_sql(text: str, label: str) -> str:
    lits = ", ".join(f"'{x}'" for x in RULES.literature_labels)
    return f"({label} IN ({lits}) OR {sql_any(low_squeezed(text), RULES.pattern_lists['related_work'])})"


def artifact_sql(expr: str) -> str:
    return sql_any(low_squeezed(expr), RULES.pattern_lists["artifact"])


def explain_strength_sql(expr: str) -> str:
    return sql_count(low_squeezed(expr), RULES.pattern_lists["explain_signal"])


def steps_bias_sql(expr: str) -> str:
    return (
        f"({sql_count(low_squeezed(expr), RULES.pattern_lists['steps_bias'])}"
        f" + least({steps_strength_sql(expr)}, 6))"
    )


#: hits with the topic arrays t_id, t_sup, t_strong, t_any, t_direct and signals
FLAG_CTES = f"""{HIT_CTES},
flagged AS MATERIALIZED (SELECT *,
   {topic_list_sql(lambda t: id_hint_sql('doc_id', t))} AS t_id,
   {topic_list_sql(lambda t: supports_sql('doc_id', 'text', t))} AS t_sup,
   {topic_list_sql(lambda t: strong_sql('doc_id', 'text', "(doc_id || ' | ' || doc_id || '.pdf |  | ' || label || ' | ')", t))} AS t_strong,
   {topics_in_sql('text')} AS t_any,
   {topic_list_sql(lambda t: mention_sql('text', t))} AS t_direct,
   {steps_strength_sql('text')} AS steps, {steps_signal_sql('text')} AS signal,
   {owner_cue_sql('text')} AS cue, {related_sql('text', 'label')} AS related,
   {artifact_sql('text')} AS artifact, {explain_strength_sql('text')} AS explain,
   {steps_bias_sql('text')} AS bias
  FROM hits)"""
