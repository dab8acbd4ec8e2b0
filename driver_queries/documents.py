"""Pages, sections, chunks, catalog, conversations, catalog questions, runs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from driver_queries.base import query, sql_any, sql_contains_any, sql_list, table
from driver_queries.themes import QUESTIONS, RULES, choose, sql_choose, topics_in_sql
from folioscan.operators import catalog, chunking, conversation, metadata_qa, runs, structure
from folioscan.plans import segments
from folioscan.session import Stages, job_folder
from folioscan.sources import pages as sources

P, L, WL = RULES.patterns, RULES.pattern_lists, RULES.word_lists


def tag_sql(expr: str, tag: str) -> str:
    return f"regexp_replace({expr}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"


HTML_SQL = "regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
for _t in ("script", "style", "head", "noscript"):
    HTML_SQL = tag_sql(HTML_SQL, _t)
HTML_SQL = f"regexp_replace({HTML_SQL}, '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML_SQL = f"replace({HTML_SQL}, '{_e}', '{_c}')"


@query(
    "html_pages",
    f"""SELECT page_id::VARCHAR AS doc_id, url AS source_file, 0 AS page, trim(regexp_replace({HTML_SQL}, '\\s+', ' ', 'g')) AS text
FROM pages WHERE trim(regexp_replace({HTML_SQL}, '\\s+', ' ', 'g')) <> ''""",
)
def html_pages(spark, sf_dir):
    return sources.pages_from_html(table(spark, sf_dir, "pages"))


# Every third group of lines of a document opens with a header line.
HEADERS = ("BAB I PENDAHULUAN", "", "BAB II TINJAUAN PUSTAKA", "", "BAB\nIII\nMETODE", "", "DAFTAR PUSTAKA", "", "LAMPIRAN A")
LINES = 2

PAGE_CTE = f"""
ln AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
pg AS (SELECT doc_id, unnest(range(0, (len(ls) + {LINES - 1}) // {LINES})) AS page, ls FROM ln),
doc_pages AS (SELECT doc_id::VARCHAR AS doc_id, 'file_' || doc_id || '.pdf' AS source_file, page,
    {sql_choose(tuple(h.replace(chr(10), '|') for h in HEADERS), 'page')} || '|' ||
    array_to_string(ls[page * {LINES} + 1:page * {LINES} + {LINES}], chr(10)) AS text FROM pg)""".replace(
    "|| '|' ||", "|| chr(10) ||"
)
PAGE_CTE = PAGE_CTE.replace("BAB|III|METODE", "BAB' || chr(10) || 'III' || chr(10) || 'METODE")


def doc_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("file_"), "doc_id", F.lit(".pdf")).alias("source_file"),
        "text",
    )
    cut = sources.pages_from_text(docs, lines_per_page=LINES)
    return cut.withColumn("text", F.concat_ws("\n", choose(HEADERS, F.col("page")), "text"))


# Page p of a document has header p % 9; chapters are found by the same rules on whole pages.
EVENT_SQL = f"""{PAGE_CTE},
kind AS (SELECT doc_id, page, CASE page % {len(HEADERS)} WHEN 0 THEN 'BAB_I' WHEN 2 THEN 'BAB_II' WHEN 4 THEN 'BAB_III'
   WHEN 6 THEN 'DAFTAR_PUSTAKA' WHEN 8 THEN 'SKIP' END AS label FROM doc_pages),
ev AS (SELECT *, count(*) OVER (PARTITION BY doc_id, label) AS n, row_number() OVER (PARTITION BY doc_id, label ORDER BY page) AS r
   FROM kind WHERE label IS NOT NULL),
bd AS (SELECT doc_id, page, label FROM ev WHERE n <= 3 OR r = 1)"""


@query("section_boundaries", f"WITH {EVENT_SQL} SELECT doc_id, page, label FROM bd")
def section_boundaries(spark, sf_dir):
    return structure.boundaries(doc_pages(spark, sf_dir), RULES).select("doc_id", "page", "label")


SECTION_SQL = f"""{EVENT_SQL},
sp AS (SELECT p.doc_id, p.source_file, p.page, p.text,
    (SELECT count(*) FROM bd b WHERE b.doc_id = p.doc_id AND b.page <= p.page) AS section_no FROM doc_pages p),
bn AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS section_no FROM bd),
sl AS (SELECT sp.*, CASE WHEN sp.section_no = 0 THEN 'SKIP' ELSE bn.label END AS label FROM sp LEFT JOIN bn USING (doc_id, section_no))"""


@query(
    "sections",
    f"""WITH {SECTION_SQL} SELECT doc_id, section_no, label, CASE label WHEN 'SKIP' THEN NULL WHEN 'DAFTAR_PUSTAKA' THEN 'sitasi'
  ELSE 'narasi' END AS stream, min(page) AS page_start, max(page) AS page_end, count(*) AS n_pages, sum(length(text)) AS n_chars
FROM sl GROUP BY doc_id, section_no, label""",
)
def sections(spark, sf_dir):
    sp = structure.section_pages(doc_pages(spark, sf_dir), RULES).persist()
    return structure.sections(sp).select(
        "doc_id", "section_no", "label", "stream", "page_start", "page_end", "n_pages", "n_chars"
    )


MERGE_SQL = f"""{SECTION_SQL},
np AS (SELECT doc_id, section_no, page, trim(text, ' ' || chr(10)) AS t, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY page) AS i
  FROM sl WHERE label NOT IN ('SKIP', 'DAFTAR_PUSTAKA')),
rec AS (SELECT doc_id, section_no, i, page, t, page AS start, CASE WHEN length(t) >= 150 THEN 0 ELSE length(t) END AS len FROM np WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.section_no, n.i, n.page, n.t, CASE WHEN r.len = 0 THEN n.page ELSE r.start END,
    CASE WHEN CASE WHEN r.len = 0 THEN length(n.t) ELSE r.len + 2 + length(n.t) END >= 150 THEN 0 WHEN r.len = 0 THEN length(n.t) ELSE r.len + 2 + length(n.t) END
  FROM rec r JOIN np n ON n.doc_id = r.doc_id AND n.section_no = r.section_no AND n.i = r.i + 1),
g AS (SELECT doc_id, section_no, start, arg_max(len, page) AS rest FROM rec GROUP BY doc_id, section_no, start),
g2 AS (SELECT *, lag(start) OVER (PARTITION BY doc_id, section_no ORDER BY start) AS prev,
   row_number() OVER (PARTITION BY doc_id, section_no ORDER BY start DESC) = 1 AS tail FROM g)"""


@query(
    "merged_pages",
    f"""WITH RECURSIVE {MERGE_SQL}
SELECT doc_id, section_no, CASE WHEN tail AND rest <> 0 AND prev IS NOT NULL THEN prev ELSE start END AS page,
  string_agg(t, chr(10) || chr(10) ORDER BY rec.page) AS text
FROM rec JOIN g2 USING (doc_id, section_no, start) GROUP BY ALL""",
)
def merged_pages(spark, sf_dir):
    sp = structure.section_pages(doc_pages(spark, sf_dir), RULES).persist()
    return chunking.merge_short_pages(sp.where(F.col("stream") == "narasi"))


ENTRY_SQL = f"""{SECTION_SQL},
cp AS (SELECT doc_id, section_no, page, string_split_regex(text, '\\n+') AS ps FROM sl WHERE label = 'DAFTAR_PUSTAKA'),
cu AS (SELECT doc_id, section_no, page, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM cp),
cn AS (SELECT doc_id, section_no, trim(p) AS t, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY page, n) AS i FROM cu WHERE trim(p) <> ''),
rec AS (SELECT doc_id, section_no, i, t, 1::BIGINT AS entry, length(t) AS len FROM cn WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.section_no, n.i, n.t, CASE WHEN r.len > 80 THEN n.i ELSE r.entry END, CASE WHEN r.len > 80 THEN length(n.t) ELSE r.len + 1 + length(n.t) END
  FROM rec r JOIN cn n ON n.doc_id = r.doc_id AND n.section_no = r.section_no AND n.i = r.i + 1)"""


@query(
    "citation_entries",
    f"""WITH RECURSIVE {ENTRY_SQL}, e AS (SELECT doc_id, section_no, entry, string_agg(t, ' ' ORDER BY i) AS text FROM rec GROUP BY ALL)
SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY entry) AS entry_no, text FROM e""",
)
def citation_entries(spark, sf_dir):
    sp = structure.section_pages(doc_pages(spark, sf_dir), RULES).persist()
    found = chunking.citation_entries(sp.where(F.col("stream") == "sitasi"), separator=r"\n+")
    order = Window.partitionBy("doc_id", "section_no").orderBy("entry")
    return found.withColumn("entry_no", F.row_number().over(order)).drop("entry")


@query("chunks")
def chunks(spark, sf_dir):
    sp = structure.section_pages(doc_pages(spark, sf_dir), RULES).persist()
    return chunking.chunk_sections(sp, citation_separator=r"\n+").drop("text")


@query(
    "file_routes",
    f"""WITH f AS (SELECT doc_id, {sql_choose(('X_Bab_1', 'Y-BAB-IV', 'Z Daftar_Pustaka', 'Halaman_Depan', 'lengkap', 'Cover', 'Bab VIII', 'lampiran 2'), 'doc_id')}
   || '.pdf' AS f FROM documents)
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'BAB_I' WHEN 1 THEN 'BAB_IV' WHEN 2 THEN 'DAFTAR_PUSTAKA' WHEN 3 THEN 'SKIP' WHEN 5 THEN 'SKIP'
  WHEN 6 THEN 'UNKNOWN' WHEN 7 THEN 'SKIP' END AS label,
  CASE doc_id % 8 WHEN 0 THEN 'narasi' WHEN 1 THEN 'narasi' WHEN 2 THEN 'sitasi' WHEN 6 THEN 'narasi' END AS stream FROM f""",
)
def file_routes(spark, sf_dir):
    names = ("X_Bab_1", "Y-BAB-IV", "Z Daftar_Pustaka", "Halaman_Depan", "lengkap", "Cover", "Bab VIII", "lampiran 2")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(choose(names, F.col("doc_id")), F.lit(".pdf")).alias("f")
    )
    return d.select("doc_id", structure.file_route("f", RULES).alias("r")).select(
        "doc_id", "r.label", "r.stream"
    )


@query("document_metadata")
def document_metadata(spark, sf_dir):
    meta = structure.document_metadata(doc_pages(spark, sf_dir), RULES)
    return structure.propagate_cover_metadata(meta, RULES)


@query("document_catalog")
def document_catalog(spark, sf_dir):
    # pages are cut anew by each reader; those with sections are stored, so that only one reader moves texts
    pages, stages = doc_pages(spark, sf_dir), Stages(spark, "catalog")
    sp = stages.stored(structure.section_pages(pages, RULES), "section-pages")
    return catalog.build_catalog(
        pages, structure.document_metadata(pages, RULES), sp,
        chunking.chunk_sections(sp, citation_separator=r"\n+", stages=stages),
    )


# Every line of a document is a page, blank ones too; some documents get faults by their number.
RAW_SQL = """
ln AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM ln),
pg AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 AND i = 0 THEN NULL WHEN doc_id % 13 = 0 THEN i // 2 ELSE i END AS page,
   CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE ls[i + 1] END AS text, CASE WHEN doc_id % 11 = 0 AND i = 0 THEN 'bad font' END AS error FROM raw),
status AS (SELECT doc_id::VARCHAR AS doc_id, 'in/file_' || doc_id || '.pdf' AS relative_path, count(*) AS page_count,
   CASE WHEN count(error) > 0 THEN 'read_error: ' || min(error) WHEN count(page) < count(*) THEN 'no_page_number'
        WHEN count(DISTINCT page) < count(*) THEN 'repeated_page' WHEN NOT bool_or(regexp_matches(text, '\\S')) THEN 'no_text' END AS reason
   FROM pg GROUP BY doc_id)"""


def raw_pages(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("i")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    page = F.when((d % 17 == 0) & (n == 0), None).when(d % 13 == 0, F.floor(n / 2).cast("int")).otherwise(n)
    name = F.concat(F.lit("file_"), d, F.lit(".pdf"))
    return rows.select(
        d.cast("string").alias("doc_id"), name.alias("source_file"), F.concat(F.lit("in/"), name).alias("relative_path"),
        page.alias("page"), F.when(d % 19 == 0, " ").otherwise(F.col("line")).alias("text"),
        F.when((d % 11 == 0) & (n == 0), "bad font").alias("error"),
    )


@query("document_faults", f"WITH {RAW_SQL} SELECT * FROM status")
def document_faults(spark, sf_dir):
    """What an ingest run would do with every document, and the reason where it cannot use it."""
    return segments.page_faults(raw_pages(spark, sf_dir)).select("doc_id", "relative_path", "page_count", "reason")


@query(
    "catalog_two_runs",
    f"""WITH {RAW_SQL} SELECT s.doc_id, s.relative_path, s.page_count, CASE WHEN reason IS NULL AND s.doc_id::BIGINT % 4 = 0 THEN 2 ELSE 1 END AS run
FROM status s JOIN (SELECT doc_id::VARCHAR AS doc_id, bool_or(regexp_matches(text, '\\S')) AS legible FROM documents GROUP BY ALL) USING (doc_id)
WHERE reason IS NULL OR (s.doc_id::BIGINT % 4 = 0 AND legible)""",
)
def catalog_two_runs(spark, sf_dir):
    """Sound pages of every fourth document and all others, then those documents as they are: failed ones keep their row."""
    folder = job_folder(spark, "runs")
    pages = raw_pages(spark, sf_dir)
    fourth = F.col("doc_id").cast("long") % 4 == 0
    sound = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "text")
    )
    name = F.concat(F.lit("file_"), "doc_id", F.lit(".pdf"))
    sound = sound.select("doc_id", name.alias("source_file"), F.concat(F.lit("in/"), name).alias("relative_path"), "page", "text", F.lit(None).cast("string").alias("error"))
    segments.ingest_run(pages.where(~fourth).unionByName(sound.where(fourth)), folder, run=1)
    segments.ingest_run(pages.where(fourth), folder, run=2)
    return segments.current_catalog(spark, folder).select("doc_id", "relative_path", "page_count", "run")


TITLE_SQL = f"""
t0 AS (SELECT doc_id, source, trim(regexp_replace({sql_choose(('', '8. ', 'Puji syukur ', 'a, b, c, d, ', 'Jurusan ', 'Penelitian terdahulu '), 'doc_id')}
   || split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS t FROM documents),
rs AS (SELECT *, list_distinct([x FOR x IN [CASE WHEN t = '' THEN 'empty_title' END,
   CASE WHEN starts_with(lower(t), 'puji syukur') THEN 'preface_puji_syukur' END,
   CASE WHEN length(t) < 20 THEN 'too_short' END,
   CASE WHEN regexp_matches(t, '^\\s*\\d+\\.\\s+') THEN 'looks_like_reference_row' END,
   CASE WHEN length(t) - length(replace(t, ',', '')) >= 4 THEN 'too_many_commas' END,
   CASE WHEN {sql_contains_any('lower(t)', WL['institution_words'])} AND NOT {sql_contains_any('lower(t)', WL['research_words'])}
        THEN 'institution_fragment_without_research_keywords' END,
   CASE {' '.join(f"WHEN {sql_any('t', p)} THEN {chr(39)}pattern:{p}{chr(39)}" for p in L['title_suspicious'])} END] IF x IS NOT NULL]) AS r FROM t0)"""


@query(
    "display_metadata",
    f"""WITH {TITLE_SQL} SELECT doc_id, t AS title_raw, array_to_string(list_sort(r), ';') AS reasons,
  CASE WHEN t <> '' AND len(r) = 0 THEN t ELSE source END AS title_safe,
  CASE WHEN t <> '' AND len(r) = 0 THEN 'high' WHEN t = '' THEN 'fallback' ELSE 'suspicious' END AS title_quality,
  CASE WHEN doc_id % 4 = 0 THEN '-' ELSE (2000 + doc_id % 25)::VARCHAR END AS year_safe FROM rs""",
)
def display_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    first = F.get(F.split("text", "\n"), 0)
    prefix = choose(("", "8. ", "Puji syukur ", "a, b, c, d, ", "Jurusan ", "Penelitian terdahulu "), i)
    cat = d.select(
        "doc_id", F.concat("source", F.lit(".pdf")).alias("source_file"),
        F.concat(prefix, first).alias("title"),
        F.lit("x").alias("author"), F.lit(None).cast("string").alias("program"),
        F.when(i % 4 != 0, (i % 25 + 2000).cast("int")).alias("year"),
    )
    return catalog.display_metadata(cat, RULES).select(
        "doc_id", "title_raw", F.array_join(F.sort_array("title_reasons"), ";").alias("reasons"),
        "title_safe", "title_quality", "year_safe",
    )


@query(
    "catalog_merge",
    """WITH o AS (SELECT doc_id, 'old' AS title FROM documents), n AS (SELECT doc_id, 'new' AS title FROM labels WHERE quality = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)""",
)
def catalog_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("title"))
    new = labels.select("doc_id", F.lit("new").alias("title"))
    return catalog.merge_catalog(old, new, failed=labels.where("quality <> 1"))


@query(
    "display_lookup",
    """WITH p AS (SELECT p_partkey::VARCHAR AS id, replace(p_brand, '#', '_') AS stem, trim(p_name) AS t FROM part),
s AS (SELECT id, lower(stem) AS k, CASE WHEN length(t) < 20 THEN stem ELSE t END AS title, CASE WHEN length(t) < 20 THEN 'suspicious' ELSE 'high' END AS quality,
   CASE WHEN length(t) < 20 THEN 'source_file_fallback' ELSE 'catalog_raw' END AS source FROM p),
f AS (SELECT k, arg_min(title, id) AS title, arg_min(quality, id) AS quality, arg_min(source, id) AS source FROM s GROUP BY k),
h AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'u' END || doc_id AS doc_id, 'BRAND_' || (doc_id % 30) || '.PDF' AS source_file, 'brand_' || (doc_id % 30) AS k FROM documents)
SELECT h.doc_id, h.source_file, coalesce(s.title, f.title, h.source_file) AS title_display,
  CASE WHEN s.id IS NULL AND f.k IS NULL THEN '-' ELSE 'author' END AS author_display,
  CASE WHEN s.id IS NULL AND f.k IS NULL THEN '-' ELSE '2020' END AS year_display,
  coalesce(s.source, f.source, 'runtime_fallback') AS title_source, coalesce(s.quality, f.quality, 'fallback') AS title_quality
FROM h LEFT JOIN s ON s.id = h.doc_id LEFT JOIN f ON f.k = h.k""",
)
def display_lookup(spark, sf_dir):
    cat = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("doc_id"),
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".pdf")).alias("source_file"),
        F.col("p_name").alias("title"), F.lit("author").alias("author"),
        F.lit(2020).alias("year"), F.lit("").alias("program"),
    )
    i = F.col("doc_id")
    hits = table(spark, sf_dir, "documents").select(
        F.concat(F.when(i % 2 == 0, "").otherwise("u"), i).alias("doc_id"),
        F.concat(F.lit("BRAND_"), i % 30, F.lit(".PDF")).alias("source_file"),
    )
    return catalog.display_lookup(hits, catalog.display_metadata(cat, RULES), cat, RULES)


# -- conversations -----------------------------------------------------------------------

TURN_CTE = f"""
msg AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {sql_choose(QUESTIONS, 'conv_id * 7 + turn')} || ' ' ELSE '' END
    || text AS text FROM conversations WHERE role IN ('user', 'assistant')),
nx AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext FROM msg),
pr AS (SELECT conv_id, turn, text AS query, CASE WHEN nrole = 'assistant' THEN ntext ELSE '' END AS answer FROM nx WHERE role = 'user'),
turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, query,
   CASE WHEN length(answer) > 220 THEN answer[1:220] || '...' ELSE answer END AS answer_preview,
   CASE WHEN contains(lower(answer), 'tidak ditemukan pada dokumen') THEN [] ELSE ({topics_in_sql('answer')})[1:5] END AS topics FROM pr)"""


def messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ask = F.concat(choose(QUESTIONS, F.col("conv_id") * 7 + F.col("turn")), F.lit(" "))
    return c.withColumn(
        "text",
        F.concat(F.when(F.col("role") == "user", ask).otherwise(""), F.col("text")),
    )


@query(
    "conversation_turns",
    f"WITH {TURN_CTE} SELECT conv_id, turn, pos, query, answer_preview, array_to_string(topics, ',') AS topics FROM turns",
)
def conversation_turns(spark, sf_dir):
    t = conversation.pair_turns(messages(spark, sf_dir), RULES)
    return t.withColumn("topics", F.array_join("topics", ","))


@query(
    "history_window",
    f"""WITH {TURN_CTE}, w AS (SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM turns)
SELECT conv_id, turn, coalesce(array_to_string(h, ','), '') AS window_turns FROM w""",
)
def history_window(spark, sf_dir):
    t = conversation.with_history(conversation.pair_turns(messages(spark, sf_dir), RULES), 4)
    return t.select(
        "conv_id", "turn",
        F.array_join(F.transform("history", lambda h: h["turn"].cast("string")), ",").alias("window_turns"),
    )


TERMS = "[x FOR x IN list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}')) IF NOT list_contains(" + sql_list(WL["stop_topic"]) + ", x)]"
BOTH = "query || ' ' || answer_preview"

SHIFT_CTES = f"""{TURN_CTE},
facts AS (SELECT conv_id, turn, pos, {TERMS.format('query')} AS qt, {TERMS.format(BOTH)} AS ht,
   {sql_contains_any('lower(query)', WL['shift_markers'])} AS marker, {sql_any('lower(query)', L['compression'])} AS shorten,
   {sql_any('lower(query)', P['q_anaphora'])} AS refers,
   len(topics) > 0 OR {sql_any('lower(query)', P['q_steps'])} OR ({sql_any('lower(query)', P['q_flow'])} AND {sql_any('lower(query)', P['q_flow_context'])})
     OR {sql_any('lower(query)', P['q_topic'])} OR {sql_any(f'lower({BOTH})', P['q_history_context'])} AS ctx FROM turns),
conv AS (SELECT conv_id, list(ht ORDER BY pos) AS hts, list(ctx ORDER BY pos) AS cxs, list(turn ORDER BY pos) AS tls FROM facts GROUP BY conv_id),
rec AS (
  SELECT conv_id, 0::BIGINT AS pos, 0::BIGINT AS turn, []::BOOLEAN[] AS flags, ''::VARCHAR AS shift_reason, NULL::DOUBLE AS overlap, false AS used_pre_shift, ''::VARCHAR AS window_turns FROM conv
  UNION ALL
  SELECT conv_id, pos, turn, list_append(flags, CASE WHEN r = 'explicit_marker' THEN true WHEN r = 'overlap_check' THEN ov < 0.15 ELSE false END), r,
     CASE WHEN r = 'overlap_check' THEN round(ov, 6) END, pre, array_to_string(tls[lo:hi], ',')
  FROM (SELECT *, CASE WHEN hi < lo THEN 'no_history' WHEN marker THEN 'explicit_marker' WHEN shorten AND list_contains(cxs[lo:hi], true) THEN 'compression_followup'
          WHEN refers THEN 'anaphora' WHEN least(len(qt), len(wt)) < 3 THEN 'too_few_terms' ELSE 'overlap_check' END AS r,
          len(list_intersect(qt, wt)) / greatest(len(qt), 1) AS ov
    FROM (SELECT *, list_distinct(flatten(hts[lo:hi])) AS wt
      FROM (SELECT *, CASE WHEN pre THEN greatest(1, last - 4) ELSE greatest(1, pos - 4, last) END AS lo, CASE WHEN pre THEN last - 1 ELSE pos - 1 END AS hi
        FROM (SELECT *, refers AND last > 0 AND last = pos - 1 AS pre
          FROM (SELECT f.*, c.hts, c.cxs, c.tls, rec.flags, CASE WHEN list_contains(rec.flags, true) THEN len(rec.flags) - list_position(list_reverse(rec.flags), true) + 1 ELSE 0 END AS last
                FROM rec JOIN facts f ON f.conv_id = rec.conv_id AND f.pos = rec.pos + 1 JOIN conv c ON c.conv_id = rec.conv_id))))))"""


@query(
    "topic_shift_windows",
    f"WITH RECURSIVE {SHIFT_CTES} SELECT conv_id, turn, flags[-1] AS is_shift, shift_reason, overlap, used_pre_shift, coalesce(window_turns, '') AS window_turns FROM rec WHERE pos > 0",
)
def topic_shift_windows(spark, sf_dir):
    t = conversation.conversation_windows(conversation.pair_turns(messages(spark, sf_dir), RULES), RULES)
    return t.select(
        "conv_id", "turn", "is_shift", "shift_reason", "overlap", "used_pre_shift",
        F.array_join(F.transform("window", lambda h: h["turn"].cast("string")), ",").alias("window_turns"),
    )


@query("standalone_questions")
def standalone_questions(spark, sf_dir):
    from folioscan.functions import intent

    t = conversation.conversation_windows(conversation.pair_turns(messages(spark, sf_dir), RULES), RULES)
    t = t.withColumn("targets", intent.target_topics("query", F.col("window"), RULES))
    return t.select(
        "conv_id", "turn",
        conversation.standalone_question(
            "query", F.col("window"), F.col("targets"), RULES,
            steps_followup=intent.is_anaphora("query", RULES) & intent.is_steps_question("query", RULES),
            compression_followup=intent.is_compression_followup("query", F.col("window"), RULES),
        ).alias("standalone"),
        conversation.is_weak_rewrite("query", F.col("window"), RULES).alias("weak"),
        F.length(conversation.history_block(F.col("window"))).alias("history_chars"),
    )


# -- catalog questions --------------------------------------------------------------------

NAMES_CTE = """
cat AS (SELECT p_partkey::VARCHAR AS doc_id, p_partkey AS ord, replace(p_brand, '#', '_') || '_' || p_partkey || '.pdf' AS source_file,
   p_name || ' ' || p_type AS title FROM part),
raw AS (SELECT doc_id, ord, unnest([doc_id, source_file, title]) AS v FROM cat),
ky AS (SELECT *, CASE WHEN ends_with(lower(v), '.pdf') THEN v[1:-5] ELSE v END AS k FROM raw),
al AS (SELECT doc_id, ord, unnest([v, k] || string_split_regex(k, '[_\\-/]+') || [array_to_string(string_split_regex(k, '[_\\-/]+'), ' ')]) AS a FROM ky),
an AS (SELECT DISTINCT doc_id, ord, regexp_replace(lower(CASE WHEN ends_with(lower(a), '.pdf') THEN a[1:-5] ELSE a END), '[^a-z0-9]+', '', 'g') AS a
       FROM al WHERE a <> ''),
ref AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_brand, '#', ' ') WHEN 2 THEN 'x' || p_name || ' ' || p_type ELSE 'tidak ada ' || p_size END AS ref FROM part),
q AS (SELECT ref, regexp_replace(lower(ref), '[^a-z0-9]+', '', 'g') AS q FROM ref),
sc AS (SELECT ref, doc_id, ord, CASE WHEN q = a THEN 100 ELSE 85 END AS score FROM q, (SELECT a, min(ord) AS ord, arg_min(doc_id, ord) AS doc_id FROM an GROUP BY a)
       WHERE q = a OR ((contains(a, q) OR contains(q, a)) AND least(length(q), length(a)) >= 5))"""


@query(
    "alias_resolve",
    f"""WITH {NAMES_CTE},
by_id AS (SELECT ref, doc_id, ord, 1 AS prio, 0 AS minus FROM ref JOIN cat ON doc_id = ref),
by_alias AS (SELECT ref, doc_id, ord, 3 AS prio, -score AS minus FROM sc)
SELECT ref, doc_id, CASE prio WHEN 1 THEN 'doc_id' ELSE 'alias' END AS how, -minus AS score FROM (FROM by_id UNION ALL FROM by_alias)
QUALIFY row_number() OVER (PARTITION BY ref ORDER BY prio, minus, ord) = 1""",
)
def alias_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    m = F.col("p_partkey") % 4
    ref = (
        F.when(m == 0, F.col("p_name"))
        .when(m == 1, F.replace("p_brand", F.lit("#"), F.lit(" ")))
        .when(m == 2, F.concat(F.lit("x"), "p_name", F.lit(" "), "p_type"))
        .otherwise(F.concat(F.lit("tidak ada "), "p_size"))
    )
    return metadata_qa.resolve_refs(part.select(ref.alias("ref")), part_catalog(spark, sf_dir), RULES)


def part_catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("ord"),
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), "p_partkey", F.lit(".pdf")).alias("source_file"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("page_count"),
    )


@query(
    "page_count_answers",
    """WITH c AS (SELECT p_partkey, replace(p_brand, '#', '_') || '_' || p_partkey AS stem, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS pc FROM part),
q AS (SELECT p_partkey AS query_id, p_partkey % 3 AS k, stem, pc FROM c)
SELECT query_id, CASE k WHEN 0 THEN stem WHEN 1 THEN 'zzz' || query_id || 'yyyyy' END AS doc_ref,
  CASE WHEN k = 0 THEN query_id::VARCHAR END AS doc_id,
  CASE k WHEN 0 THEN CASE WHEN pc IS NULL THEN 'missing_page_count_field' ELSE 'ok' END WHEN 1 THEN 'not_in_catalog' ELSE 'missing_doc_ref' END AS reason,
  CASE k WHEN 0 THEN CASE WHEN pc IS NULL THEN 'Jawaban: Katalog ingest untuk "' || stem || '.pdf" tidak memiliki field page_count.'
     ELSE 'Jawaban: Dokumen "' || stem || '.pdf" memiliki ' || pc || ' halaman.' END
    WHEN 1 THEN 'Jawaban: Dokumen "zzz' || query_id || 'yyyyy" tidak ditemukan pada katalog ingest.'
    ELSE 'Jawaban: Untuk menjawab jumlah halaman, sebutkan nama dokumen (filename/doc_id).' END AS answer FROM q""",
)
def page_count_answers(spark, sf_dir):
    cat = part_catalog(spark, sf_dir)
    k = F.col("ord") % 3
    text = (
        F.when(k == 0, F.concat(F.lit("Berapa halaman "), F.col("source_file"), F.lit("?")))
        .when(k == 1, F.concat(F.lit('Berapa jumlah halaman "zzz'), F.col("ord"), F.lit('yyyyy"?')))
        .otherwise("Berapa jumlah halaman?")
    )
    q = cat.select(F.col("ord").alias("query_id"), text.alias("text"))
    return metadata_qa.page_count_answers(q, cat, RULES).select(
        "query_id", "doc_ref", "doc_id", "reason", "answer"
    )


@query(
    "alias_scores",
    f"""WITH p AS (SELECT p_partkey, p_name AS q, p_type || ' ' || p_name || ' collection' AS a FROM part),
n AS (SELECT *, regexp_replace(lower(q), '[^a-z0-9]+', '', 'g') AS qn, regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') AS an,
  [x FOR x IN list_distinct(string_split_regex(lower(q || ' widget'), '[^a-z0-9]+')) IF length(x) >= 3 AND NOT list_contains({sql_list(WL['stop_alias'])}, x)] AS qt,
  [x FOR x IN list_distinct(string_split_regex(lower(a), '[^a-z0-9]+')) IF length(x) >= 3 AND NOT list_contains({sql_list(WL['stop_alias'])}, x)] AS aw FROM p),
m AS (SELECT *, regexp_replace(lower(q || ' widget'), '[^a-z0-9]+', '', 'g') AS q2, list_intersect(qt, aw) AS b FROM n)
SELECT p_partkey, CASE WHEN q2 = an THEN 100 WHEN contains(an, q2) OR contains(q2, an) THEN CASE WHEN least(length(q2), length(an)) >= 5 THEN 85 ELSE 70 END
  WHEN len(b) = 0 THEN 0 ELSE least(79, 40 + floor(len(b)::DOUBLE / greatest(len(qt), 1) * 40)::INT + CASE WHEN len([x FOR x IN b IF length(x) >= 8]) > 0 THEN 10 ELSE 0 END) END AS score FROM m""",
)
def alias_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        metadata_qa.alias_score(
            F.concat_ws(" ", "p_name", F.lit("widget")),
            F.concat_ws(" ", "p_type", "p_name", F.lit("collection")), RULES,
        ).alias("score"),
    )


# -- runs ------------------------------------------------------------------------------------


@query(
    "retention_plan",
    """WITH r AS (SELECT user_id::VARCHAR AS run_id, max(ts) AS ts, round(sum(value) * 100)::BIGINT AS size_bytes,
     bool_or(event_type = 'error' AND value > 95) AS keep FROM events GROUP BY user_id),
n AS (SELECT run_id FROM r WHERE NOT keep ORDER BY ts DESC, run_id DESC LIMIT 5),
c AS (SELECT *, run_id IN (SELECT run_id FROM n) AS kept_newest, (SELECT max(ts) FROM r) AS now, (SELECT sum(size_bytes) FROM r) AS total FROM r),
a AS (SELECT *, NOT keep AND NOT kept_newest AS cand, NOT keep AND NOT kept_newest AND ts < now - INTERVAL 1 DAY AS age_marked FROM c),
s AS (SELECT *, sum(size_bytes) OVER (PARTITION BY cand ORDER BY age_marked DESC, ts, run_id ROWS UNBOUNDED PRECEDING) - size_bytes AS before FROM a)
SELECT run_id, kept_newest, age_marked, age_marked OR (cand AND before < total - 1000000) AS remove FROM s""",
)
def retention_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(
        F.max("ts").alias("ts"),
        F.round(F.sum("value") * 100).cast("bigint").alias("size_bytes"),
        F.bool_or((F.col("event_type") == "error") & (F.col("value") > 95)).alias("keep"),
    )
    now = r.agg(F.max("ts")).scalar()
    plan = runs.retention_plan(r, keep_last=5, now=now, max_age_days=1, max_total_bytes=1_000_000)
    return plan.select("run_id", "kept_newest", "age_marked", "remove")

