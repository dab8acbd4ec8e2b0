"""Topic coverage, anchors, expansion and aggregation over themed hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import query, sql_any, tokens_sql
from driver_queries.themes import (
    CHUNK_CTE,
    FLAG_CTES,
    HIT_CTES,
    RULES,
    SENTENCES,
    choose,
    low_squeezed,
    mention_sql,
    sql_choose,
    themed_chunks,
    themed_hits,
    topic_list_sql,
)
from folioscan.operators import aggregation, coverage, expansion, filters, lexical, rerank, stats

L = RULES.pattern_lists


def joined(*names):
    return [F.array_join(n, ",").alias(n) for n in names]


def sql_joined(*names):
    return ", ".join(f"array_to_string({n}, ',') AS {n}" for n in names)


@query(
    "topic_support",
    f"WITH {FLAG_CTES} SELECT query_id, chunk_id, {sql_joined('t_id', 't_sup', 't_strong', 't_any', 't_direct')} FROM flagged",
)
def topic_support(spark, sf_dir):
    return coverage.with_topic_columns(themed_hits(spark, sf_dir), RULES).select(
        "query_id", "chunk_id", *joined("t_id", "t_sup", "t_strong", "t_any", "t_direct")
    )


def pick_cte(i: int) -> str:
    """Best unused hit for target ``i`` (1-based)."""
    used = " UNION ALL ".join(f"SELECT query_id, chunk_id FROM p{j}" for j in range(1, i))
    free = (
        f"AND NOT EXISTS (SELECT 1 FROM ({used}) u WHERE u.query_id = f.query_id AND u.chunk_id = f.chunk_id)"
        if used else ""
    )
    return f"""
p{i} AS (SELECT f.*, targets[{i}] AS pick_for, {i} AS pick_no,
   CASE WHEN list_contains(t_id, targets[{i}]) THEN 1 WHEN list_contains(t_sup, targets[{i}]) THEN 2
        WHEN list_contains(t_any, targets[{i}]) AND targets[{i}] <> 'PROTOTYPING' THEN 3 END AS tier
  FROM flagged f WHERE tier IS NOT NULL {free}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) = 1)"""


COVERAGE_CTES = f"""{FLAG_CTES}, {pick_cte(1)}, {pick_cte(2)}, {pick_cte(3)},
picks AS (SELECT query_id, chunk_id, pick_for, pick_no FROM p1 UNION ALL SELECT query_id, chunk_id, pick_for, pick_no FROM p2
          UNION ALL SELECT query_id, chunk_id, pick_for, pick_no FROM p3),
fill AS (SELECT f.*, pick_for, pick_no,
    count(pick_no) OVER (PARTITION BY query_id, doc_id) AS doc_picks,
    row_number() OVER (PARTITION BY query_id, doc_id, pick_no IS NULL ORDER BY rank) AS nth
  FROM flagged f LEFT JOIN picks USING (query_id, chunk_id)),
cov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pick_no NULLS LAST, rank) AS new_rank FROM fill
        WHERE pick_no IS NOT NULL OR doc_picks + nth <= 2 QUALIFY new_rank <= 6)"""


def covered(spark, sf_dir):
    return coverage.select_with_coverage(themed_hits(spark, sf_dir), RULES, top_k=6, max_per_doc=2)


@query(
    "coverage_select",
    f"WITH {COVERAGE_CTES} SELECT query_id, new_rank, chunk_id, doc_id, pick_for FROM cov",
)
def coverage_select(spark, sf_dir):
    return covered(spark, sf_dir).select(
        "query_id", F.col("rank").alias("new_rank"), "chunk_id", "doc_id", "pick_for"
    )


def target_queries(hits):
    return hits.groupBy("query_id").agg(F.first("targets").alias("targets"))


@query(
    "coverage_detail",
    f"""WITH {COVERAGE_CTES},
want AS (SELECT DISTINCT query_id, unnest(targets) AS topic FROM flagged)
SELECT query_id, topic, chunk_id IS NOT NULL AS found, chunk_id, doc_id,
       chunk_id IS NOT NULL AND list_contains(t_id, topic) AS id_hit
FROM want LEFT JOIN (SELECT query_id, pick_for AS topic, chunk_id, doc_id, t_id FROM cov) c USING (query_id, topic)""",
)
def coverage_detail(spark, sf_dir):
    sel = covered(spark, sf_dir)
    return coverage.coverage_detail(sel, target_queries(themed_hits(spark, sf_dir)), RULES).select(
        "query_id", "topic", "found", "chunk_id", "doc_id", F.coalesce("id_hit", F.lit(False)).alias("id_hit")
    )


ANCHOR_CTES = f"""{COVERAGE_CTES},
want AS (SELECT DISTINCT query_id, targets, unnest(targets) AS topic FROM flagged),
pref AS (SELECT w.query_id, w.topic, list_position(w.targets, w.topic) AS tp, c.chunk_id AS pchunk, c.doc_id AS pdoc
         FROM want w LEFT JOIN cov c ON c.query_id = w.query_id AND c.pick_for = w.topic),
cand AS (SELECT f.*, topic, tp, coalesce(f.doc_id = pdoc, false) AS same_doc, coalesce(f.chunk_id = pchunk, false) AS same_chunk,
    list_contains(t_id, topic) AS own, list_contains(t_strong, topic) AS strong, f.query_id % 2 = 0 AS prefer
  FROM flagged f JOIN pref USING (query_id)),
tiers AS (SELECT *, CASE WHEN prefer THEN CASE WHEN own AND steps >= 4 THEN 1 WHEN own THEN 2 WHEN strong AND steps >= 4 THEN 3
       WHEN strong THEN 4 END ELSE CASE WHEN same_chunk AND strong THEN 1 WHEN same_doc AND strong THEN 2 WHEN own THEN 3
       WHEN strong THEN 4 WHEN same_chunk THEN 5 END END AS tier FROM cand),
anch AS (SELECT query_id, topic, tp, chunk_id, doc_id, tier FROM tiers WHERE tier IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, topic ORDER BY tier, CASE WHEN prefer THEN steps ELSE 0 END DESC,
     CASE WHEN prefer THEN same_doc::INT ELSE 0 END DESC, CASE WHEN prefer THEN same_chunk::INT ELSE 0 END DESC, rank) = 1)"""


def anchors(spark, sf_dir):
    hits = themed_hits(spark, sf_dir)
    detail = coverage.coverage_detail(covered(spark, sf_dir), target_queries(hits), RULES)
    return coverage.best_anchors(hits, detail, RULES, prefer_steps=F.col("query_id") % 2 == 0)


@query(
    "topic_anchors",
    f"WITH {ANCHOR_CTES} SELECT query_id, topic, chunk_id, doc_id, tier FROM anch",
)
def topic_anchors(spark, sf_dir):
    return anchors(spark, sf_dir).select("query_id", "topic", "chunk_id", "doc_id", "tier")


@query(
    "anchor_reservation",
    f"""WITH {ANCHOR_CTES},
rr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rr FROM flagged
       QUALIFY rr <= 3),
allc AS (SELECT query_id, chunk_id, 0 AS src, tp AS pos, topic FROM anch
   UNION ALL SELECT query_id, chunk_id, 1, rr, NULL FROM rr UNION ALL SELECT query_id, chunk_id, 2, rank, NULL FROM flagged),
one AS (SELECT *, max(src = 0) OVER (PARTITION BY query_id) AS has_anchor FROM allc
   QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY src, pos) = 1),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, pos) AS rank FROM one WHERE src < 2 OR has_anchor
        QUALIFY rank <= 4),
lists AS (SELECT query_id, list(chunk_id ORDER BY rank) AS a FROM fin GROUP BY query_id),
olds AS (SELECT query_id, list(chunk_id ORDER BY rr) AS b FROM rr WHERE rr <= 4 GROUP BY query_id)
SELECT query_id, rank, chunk_id, topic AS reserved_topic, a <> b AS anchors_modified
FROM fin JOIN lists USING (query_id) JOIN olds USING (query_id)""",
)
def anchor_reservation(spark, sf_dir):
    hits = themed_hits(spark, sf_dir)
    order = coverage.by_query().orderBy(F.desc("score"), "rank")
    rr = hits.withColumn("rerank_rank", F.row_number().over(order)).where("rerank_rank <= 3")
    out = coverage.reserve_anchors(rr, hits, anchors(spark, sf_dir), final_k=4)
    return out.select("query_id", "rank", "chunk_id", "reserved_topic", "anchors_modified")


@query(
    "rerank_sync",
    f"""WITH {ANCHOR_CTES},
rr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rr FROM flagged
       QUALIFY rr <= 5),
nm AS (SELECT query_id, chunk_id, arg_max(topic, tp) AS topic FROM anch GROUP BY query_id, chunk_id)
SELECT f.query_id, f.chunk_id, rr AS rerank_rank, topic IS NOT NULL AS is_reserved_anchor, 'anchor:' || topic AS anchor_label
FROM flagged f LEFT JOIN rr USING (query_id, chunk_id) LEFT JOIN nm USING (query_id, chunk_id)""",
)
def rerank_sync(spark, sf_dir):
    hits = themed_hits(spark, sf_dir)
    order = coverage.by_query().orderBy(F.desc("score"), "rank")
    rr = hits.withColumn("rerank_rank", F.row_number().over(order)).where("rerank_rank <= 5")
    rr = rr.withColumn("rerank_score", F.col("score"))
    return rerank.sync_rerank(hits, rr, anchors(spark, sf_dir)).select(
        "query_id", "chunk_id", "rerank_rank", "is_reserved_anchor", "anchor_label"
    )


@query(
    "topic_doc_map",
    f"""WITH {FLAG_CTES} SELECT query_id, topic, arg_min(doc_id, rank) AS doc_id
FROM (SELECT query_id, rank, doc_id, unnest(targets) AS topic, t_direct FROM flagged) WHERE list_contains(t_direct, topic)
GROUP BY query_id, topic""",
)
def topic_doc_map(spark, sf_dir):
    return coverage.topic_doc_map(themed_hits(spark, sf_dir), RULES)


@query(
    "topic_represented",
    f"""WITH {FLAG_CTES} SELECT query_id, topic, bool_or(list_contains(t_strong, topic) AND (query_id % 2 = 1 OR steps >= 4))
  AS represented FROM (SELECT *, unnest(targets) AS topic FROM flagged) GROUP BY query_id, topic""",
)
def topic_represented(spark, sf_dir):
    return coverage.adequately_represented(
        themed_hits(spark, sf_dir), RULES, prefer_steps=F.col("query_id") % 2 == 0
    )


@query(
    "expansion_queries",
    f"""WITH {FLAG_CTES},
q AS (SELECT query_id, any_value(targets) AS targets, list_distinct(flatten(list(t_any))) AS have FROM flagged GROUP BY query_id),
e AS (SELECT query_id, text, unnest(CASE WHEN query_id % 3 = 0 THEN targets
        ELSE [t FOR t IN targets IF NOT list_contains(have, t)] END) AS topic
      FROM q JOIN benchmark ON item_id = query_id WHERE len(targets) >= 2)
SELECT query_id, topic, CASE WHEN query_id % 3 = 0 THEN 'tahapan ' || topic || '. ' || trim(text)
       ELSE trim(text) || ' metode ' || topic END AS text FROM e""",
)
def expansion_queries(spark, sf_dir):
    hits = themed_hits(spark, sf_dir)
    q = (
        spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        .select(F.col("item_id").alias("query_id"), "text")
        .join(target_queries(hits), "query_id")
        .withColumn("is_steps", F.col("query_id") % 3 == 0)
        .withColumn("needs_coverage", F.lit(True))
    )
    return coverage.expansion_queries(q, hits, RULES).select("query_id", "topic", "text")


@query(
    "doc_focus_filter",
    f"""WITH {HIT_CTES},
a AS (SELECT *, CASE WHEN query_id % 4 = 0 THEN [] WHEN query_id % 4 = 1 THEN ['prototyping'] WHEN query_id % 4 = 2
   THEN ['DOC_Umum_1.pdf', 'doc_data'] ELSE ['nothing'] END AS allowed FROM hits),
k AS (SELECT *, len([x FOR x IN allowed IF contains(lower(doc_id) || '.pdf', lower(x)) OR contains(lower(doc_id), lower(x))
       OR (ends_with(x, '.pdf') AND contains(lower(doc_id), lower(x[1:-5])))]) > 0 AS kept FROM a),
n AS (SELECT *, sum(kept::INT) OVER (PARTITION BY query_id) AS nk FROM k),
r AS (SELECT *, CASE WHEN len(allowed) = 0 THEN 'empty_allowlist' WHEN nk < 3 THEN 'too_few_kept_fallback'
      ELSE 'filtered_ok' END AS focus_reason FROM n)
SELECT query_id, chunk_id, focus_reason FROM r WHERE focus_reason <> 'filtered_ok' OR kept""",
)
def doc_focus_filter(spark, sf_dir):
    m = F.col("query_id") % 4
    allowed = (
        F.when(m == 0, F.array().cast("array<string>"))
        .when(m == 1, F.array(F.lit("prototyping")))
        .when(m == 2, F.array(F.lit("DOC_Umum_1.pdf"), F.lit("doc_data")))
        .otherwise(F.array(F.lit("nothing")))
    )
    hits = themed_hits(spark, sf_dir).withColumn("allowed_docs", allowed)
    return filters.apply_doc_focus(hits, min_keep=3).select("query_id", "chunk_id", "focus_reason")


@query(
    "hit_text_filter",
    f"WITH {HIT_CTES} SELECT query_id, chunk_id FROM hits WHERE contains(lower(doc_id), 'rad') OR contains(lower(doc_id || '.pdf'), 'rad') OR contains(lower(text), 'rad')",
)
def hit_text_filter(spark, sf_dir):
    return (
        themed_hits(spark, sf_dir)
        .where(filters.hit_contains(F.lit(" RAD ")))
        .select("query_id", "chunk_id")
    )


@query(
    "source_snapshot",
    f"""WITH {HIT_CTES} SELECT query_id, rank, CASE WHEN len(doc_id) > 34 THEN doc_id[1:31] || '...' ELSE doc_id END AS doc,
  doc_id || '.pdf' AS file, 'sim=' || printf('%.4f', 1 / (1 + greatest(score, 0))) AS metrics FROM hits WHERE rank <= 6""",
)
def source_snapshot(spark, sf_dir):
    return stats.source_snapshot(themed_hits(spark, sf_dir), hybrid=False)


# -- expansion -----------------------------------------------------------------------

POOL_SQL = """
pool AS (SELECT *, targets[1] AS topic, first_value(doc_id) OVER (PARTITION BY query_id ORDER BY rank) AS target_doc,
         rank <= 4 AS in_base FROM flagged),
fl AS (SELECT *, doc_id = target_doc AS own, list_contains(t_strong, topic) AS sup, steps >= 4 AS rich,
   label IN ('BAB_I', 'BAB_III', 'BAB_IV', 'BAB_V') AS owner_label, label IN ('BAB_III', 'BAB_IV', 'BAB_V') AS process_label,
   label IN ('BAB_II', 'DAFTAR_PUSTAKA') AS lit FROM pool)"""

SCORES = {
    "explain": (
        "own::INT * 5 + sup::INT * 4 + cue::INT * 3 + owner_label::INT * 2 + least(explain, 6) + rich::INT * 2"
        " - related::INT * 5 - lit::INT * 3",
        ("cue", "explain >= 2", "rich"), 2, 4, 1,
    ),
    "steps": (
        "own::INT * 6 + sup::INT * 4 + rich::INT * 7 + CASE WHEN process_label THEN 3 WHEN owner_label THEN 2 ELSE 0 END"
        " + cue::INT * 2 + least(bias, 6) - artifact::INT * 4 - related::INT * 6 - lit::INT * 4",
        ("rich AND process_label", "rich", "sup AND cue"), 4, 4, 4,
    ),
}


def expansion_sql(kind: str) -> str:
    score, preds, floor, limit, fallback = SCORES[kind]
    ctes = [FLAG_CTES, POOL_SQL, f"sc AS (SELECT *, {score} AS expansion_score FROM fl)"]
    for i, p in enumerate(preds):
        used = " ".join(
            f"AND NOT EXISTS (SELECT 1 FROM x{j} WHERE x{j}.query_id = sc.query_id AND x{j}.chunk_id = sc.chunk_id)"
            for j in range(i)
        )
        ctes.append(
            f"x{i} AS (SELECT query_id, chunk_id, {i} AS pick_no FROM sc WHERE ({p}) {used} QUALIFY row_number() OVER "
            "(PARTITION BY query_id ORDER BY expansion_score DESC, score, chunk_id) = 1)"
        )
    ctes.append("xs AS (FROM x0 UNION ALL FROM x1 UNION ALL FROM x2)")
    ctes.append(f"""j AS (SELECT sc.*, pick_no, count(pick_no) OVER (PARTITION BY query_id) AS np,
  CASE WHEN pick_no IS NULL AND expansion_score >= {floor} THEN 1 END AS fit FROM sc LEFT JOIN xs USING (query_id, chunk_id)),
nth AS (SELECT *, CASE WHEN fit = 1 THEN row_number() OVER (PARTITION BY query_id, fit ORDER BY expansion_score DESC, score, chunk_id) END AS n
  FROM j),
ch AS (SELECT *, pick_no IS NOT NULL OR coalesce(n <= greatest({limit} - np, 1), false) AS chosen FROM nth),
anyc AS (SELECT *, bool_or(chosen) OVER (PARTITION BY query_id) AS has_any,
  sum((in_base AND own)::INT) OVER (PARTITION BY query_id ORDER BY score, chunk_id ROWS UNBOUNDED PRECEDING) AS bn FROM ch),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pick_no NULLS LAST, expansion_score DESC, score, chunk_id) AS ctx
  FROM anyc WHERE chosen OR (NOT has_any AND in_base AND own AND bn <= {fallback}))""")
    return "WITH " + ",\n".join(ctes)


def expansion_pool(spark, sf_dir):
    first = F.first("doc_id").over(coverage.by_query().orderBy("rank"))
    return (
        themed_hits(spark, sf_dir)
        .withColumn("ord", F.col("chunk_id"))
        .withColumn("topic", F.get("targets", 0))
        .withColumn("target_doc", first)
        .withColumn("in_base", F.col("rank") <= 4)
    )


@query(
    "explanation_expansion",
    expansion_sql("explain") + " SELECT query_id, ctx, chunk_id, expansion_score, NOT in_base AS is_added FROM sel",
)
def explanation_expansion(spark, sf_dir):
    return expansion.explanation_expansion(expansion_pool(spark, sf_dir), RULES).select(
        "query_id", "ctx", "chunk_id", "expansion_score", "is_added"
    )


@query(
    "steps_expansion",
    expansion_sql("steps")
    + " SELECT query_id, ctx, chunk_id, expansion_score, NOT in_base AS is_added, sup AS supports_topic, rich AS explicit_steps FROM sel",
)
def steps_expansion(spark, sf_dir):
    return expansion.steps_expansion(expansion_pool(spark, sf_dir), RULES).select(
        "query_id", "ctx", "chunk_id", "expansion_score", "is_added", "supports_topic", "explicit_steps"
    )


@query("steps_status")
def steps_status(spark, sf_dir):
    contexts = expansion.steps_expansion(expansion_pool(spark, sf_dir), RULES)
    return expansion.steps_status(contexts)


@query(
    "template_queries",
    f"""WITH {HIT_CTES},
q AS (SELECT query_id, any_value(targets[1]) AS topic, arg_min(doc_id, rank) AS target_doc FROM hits GROUP BY query_id),
t AS (SELECT unnest(range(0, 6)) AS n)
SELECT query_id, n, target_doc AS f_doc, replace({sql_choose(RULES.templates['steps_queries'], 'n')}, '{{label}}',
   CASE topic {' '.join(f"WHEN '{t.name}' THEN '{t.label}'" for t in RULES.topics)} END) AS text FROM q, t""",
)
def template_queries(spark, sf_dir):
    q = themed_hits(spark, sf_dir).groupBy("query_id").agg(
        F.first(F.get("targets", 0)).alias("topic"), F.min_by("doc_id", "rank").alias("target_doc")
    )
    return expansion.template_queries(q, RULES, kind="steps", max_queries=6).select(
        "query_id", "n", "f_doc", "text"
    )


@query(
    "expansion_hits",
    f"""WITH {HIT_CTES},
q AS (SELECT query_id, any_value(targets[1]) AS topic, arg_min(doc_id, rank) AS f_doc FROM hits GROUP BY query_id),
x AS (SELECT query_id, n, f_doc, replace({sql_choose(RULES.templates['steps_queries'], 'n')}, '{{label}}',
        CASE topic {' '.join(f"WHEN '{t.name}' THEN '{t.label}'" for t in RULES.topics)} END) AS text
      FROM q, (SELECT unnest(range(0, 6)) AS n)),
tok AS (SELECT chunk_id, doc, {tokens_sql('text')} AS toks FROM chunks),
stat AS (SELECT count(*) AS n_chunks, avg(len(toks)) AS avgdl FROM tok),
post AS (SELECT chunk_id, doc, dl, term, count(*) AS tf
         FROM (SELECT chunk_id, doc, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, ln((n_chunks - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM post, stat GROUP BY term, n_chunks),
terms AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, (SELECT avg(r) AS mean FROM raw)),
xt AS (SELECT query_id, n, f_doc, term, count(*) AS qtf
       FROM (SELECT query_id, n, f_doc, unnest({tokens_sql('text')}) AS term FROM x) GROUP BY ALL),
sc AS (SELECT query_id, n, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM post JOIN xt ON xt.term = post.term AND f_doc = doc JOIN terms ON terms.term = post.term, stat GROUP BY query_id, n, chunk_id),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, chunk_id) <= 3)
SELECT query_id, chunk_id, max(score) AS score, min(n) AS n FROM top GROUP BY query_id, chunk_id""",
)
def expansion_hits(spark, sf_dir):
    """The template searches run inside their documents and come back as hits."""
    q = themed_hits(spark, sf_dir).groupBy("query_id").agg(
        F.first(F.get("targets", 0)).alias("topic"), F.min_by("doc_id", "rank").alias("target_doc")
    )
    searches = expansion.template_queries(q, RULES, kind="steps", max_queries=6)
    chunks = themed_chunks(spark, sf_dir).select("*", F.col("chunk_id").alias("ord"), F.lit("all").alias("stream"))
    found = expansion.search_inside(searches, lexical.build_bm25_index(chunks), chunks, k=3)
    return found.select("query_id", "chunk_id", "score", "n")


# -- ownership: every document chunk is a hit of one of six topic queries ----------------

OWN_TOPICS = tuple(t.name for t in RULES.topics)

OWN_CTES = f"""{CHUNK_CTE},
oh AS (SELECT q AS query_id, {sql_choose(OWN_TOPICS, 'q')} AS topic, chunk_id AS rank, chunk_id, doc AS doc_id, label, text
       FROM chunks, (SELECT unnest(range(0, {len(OWN_TOPICS)})) AS q)),
of AS MATERIALIZED (SELECT *, {topic_list_sql(lambda t: mention_sql('text', t))} AS t_direct,
   {sql_any(low_squeezed('text'), L['owner_cue'])} AS cue,
   label IN ('BAB_II', 'DAFTAR_PUSTAKA') OR {sql_any(low_squeezed('text'), L['related_work'])} AS related FROM oh),
oc AS (SELECT *, CASE WHEN list_contains(t_direct, topic) THEN CASE WHEN cue AND NOT related THEN 'strong'
   WHEN label IN ('BAB_I', 'BAB_III', 'BAB_IV', 'BAB_V') AND NOT related THEN 'weak' WHEN related THEN 'mention' ELSE 'neutral' END END AS cls,
   CASE topic {' '.join(f"WHEN '{t.name}' THEN {' OR '.join(f"contains(lower(doc_id), '{h}')" for h in t.id_hints)}" for t in RULES.topics)} END AS hint
  FROM of),
pr AS (SELECT *, CASE cls WHEN 'strong' THEN 0 WHEN 'weak' THEN 1 WHEN 'neutral' THEN 2 WHEN 'mention' THEN 3 ELSE 4 END AS prio,
   row_number() OVER (PARTITION BY query_id, doc_id, cls ORDER BY rank) AS nth,
   row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nthd FROM oc),
ow AS (SELECT query_id, topic, doc_id, any_value(hint) AS id_hit,
   count(*) FILTER (cls = 'strong') AS n_strong, count(*) FILTER (cls = 'weak') AS n_weak,
   count(*) FILTER (cls = 'neutral') AS n_neutral, count(*) FILTER (cls = 'mention') AS n_mention,
   arg_min(chunk_id, prio::BIGINT * 1000000000 + rank) AS representative_chunk_id,
   coalesce(arg_min(chunk_id, prio::BIGINT * 1000000000 + rank) FILTER (nth = 2 AND prio < 3),
            any_value(chunk_id) FILTER (nthd = 2)) AS second_chunk_id
  FROM pr GROUP BY query_id, topic, doc_id),
os AS (SELECT *, CASE WHEN id_hit THEN 4 ELSE 0 END + 3 * n_strong + n_weak + n_neutral - 2 * n_mention AS owner_score FROM ow),
acc AS (SELECT *, id_hit OR n_strong > 0 OR (owner_score >= 2 AND (n_weak > 0 OR (n_neutral > 0 AND n_mention = 0))) AS accepted FROM os)"""


def ownership(spark, sf_dir):
    topics = F.array(*[F.lit(t) for t in OWN_TOPICS])
    hits = (
        themed_chunks(spark, sf_dir)
        .withColumn("rank", F.col("chunk_id"))
        .withColumn("source_file", F.concat("doc_id", F.lit(".pdf")))
        .select("*", F.posexplode(topics).alias("query_id", "topic"))
    )
    return aggregation.document_ownership(hits, RULES)


@query(
    "ownership_aggregation",
    f"WITH {OWN_CTES} SELECT query_id, topic, doc_id, id_hit, n_strong, n_weak, n_neutral, n_mention, owner_score, accepted, "
    "representative_chunk_id FROM acc",
)
def ownership_aggregation(spark, sf_dir):
    return ownership(spark, sf_dir).select(
        "query_id", "topic", "doc_id", "id_hit", "n_strong", "n_weak", "n_neutral", "n_mention",
        "owner_score", "accepted", "representative_chunk_id",
    )


SNIP = "CASE WHEN len({0}) <= 280 THEN {0} ELSE rtrim({0}[1:280]) || '...' END"


@query(
    "ownership_contexts",
    f"""WITH {OWN_CTES},
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY owner_score DESC, doc_id) AS ctx FROM acc WHERE accepted QUALIFY ctx <= 5),
s AS (SELECT chunk_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM chunks)
SELECT query_id, ctx, doc_id, owner_score, {SNIP.format('r.t')} AS owner_evidence, coalesce({SNIP.format('z.t')}, '') AS secondary_evidence
FROM b JOIN s r ON r.chunk_id = representative_chunk_id LEFT JOIN s z ON z.chunk_id = second_chunk_id""",
)
def ownership_contexts(spark, sf_dir):
    return aggregation.accepted_documents(ownership(spark, sf_dir)).select(
        "query_id", F.col("doc_rank").alias("ctx"), "doc_id", "owner_score", "owner_evidence",
        "secondary_evidence",
    )


@query(
    "aggregation_summary",
    f"""WITH {OWN_CTES},
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY owner_score DESC, doc_id) AS ctx FROM acc WHERE accepted QUALIFY ctx <= 5),
d AS (SELECT query_id, count(*) AS accepted_doc_count, list(doc_id ORDER BY ctx) AS ids FROM b GROUP BY query_id)
SELECT query_id, topic AS target_topic, count(*) AS candidate_doc_count, coalesce(any_value(accepted_doc_count), 0) AS accepted_doc_count,
  coalesce(array_to_string(any_value(ids), ','), '') AS accepted FROM acc LEFT JOIN d USING (query_id) GROUP BY query_id, topic""",
)
def aggregation_summary(spark, sf_dir):
    return aggregation.aggregation_summary(ownership(spark, sf_dir)).select(
        "query_id", "target_topic", "candidate_doc_count", "accepted_doc_count",
        F.array_join("accepted_doc_ids", ",").alias("accepted"),
    )


# -- comparison ---------------------------------------------------------------------------


def contexts(spark, sf_dir):
    return themed_hits(spark, sf_dir).withColumn("ctx", F.col("rank"))


def take_cte(i: int) -> str:
    prev = "g0" if i == 1 else f"g{i - 1}"
    return f"""
o{i} AS (SELECT *, coalesce(list_contains(t_direct, targets[{i}]), false) AS fits,
   row_number() OVER (PARTITION BY query_id ORDER BY coalesce(list_contains(t_direct, targets[{i}]), false) DESC,
     related::INT * 2 + (len(used) > 0)::INT, rank) AS pos FROM {prev}),
g{i} AS (SELECT * EXCLUDE (fits, pos, used), CASE WHEN fits AND pos <= 2
   THEN list_append(used, {{'tp': {i}, 'topic': targets[{i}], 'pos': pos}}) ELSE used END AS used FROM o{i})"""


CMP_CTES = f"""{FLAG_CTES},
g0 AS (SELECT query_id, rank, targets, t_direct, related, []::STRUCT(tp INT, topic VARCHAR, pos BIGINT)[] AS used FROM flagged),
{take_cte(1)}, {take_cte(2)}, {take_cte(3)},
chosen AS (SELECT query_id, rank AS ctx, related, len(used) > 1 AS shared, unnest(used, recursive := true) FROM g3)"""


@query(
    "comparison_contexts",
    f"WITH {CMP_CTES} SELECT query_id, topic, pos, ctx, NOT related AS strong, shared FROM chosen",
)
def comparison_contexts(spark, sf_dir):
    return aggregation.comparison_contexts(contexts(spark, sf_dir), RULES).select(
        "query_id", "topic", "pos", "ctx", "strong", "shared"
    )


@query(
    "comparison_status",
    f"""WITH {CMP_CTES},
w AS (SELECT DISTINCT query_id, targets, unnest(targets) AS topic FROM flagged WHERE len(targets) >= 2),
w2 AS (SELECT *, list_position(targets, topic) AS tp FROM w),
pt AS (SELECT query_id, tp, bool_or(NOT related) AS strong, count(*) FILTER (NOT shared) AS own FROM chosen GROUP BY query_id, tp),
cx AS (SELECT query_id, count(DISTINCT ctx) AS n, list_sort(list_distinct(list(ctx) FILTER (shared))) AS sh FROM chosen GROUP BY query_id),
r AS (SELECT query_id, list(topic ORDER BY tp) FILTER (strong) AS s, list(topic ORDER BY tp) FILTER (NOT strong) AS w,
    list(topic ORDER BY tp) FILTER (strong IS NULL) AS m, count(*) FILTER (tp <= 2 AND coalesce(own, 0) > 0) AS own2
  FROM w2 LEFT JOIN pt USING (query_id, tp) GROUP BY query_id)
SELECT query_id, coalesce(array_to_string(s, ','), '') AS supported_topics, coalesce(array_to_string(w, ','), '') AS weak_topics,
  coalesce(array_to_string(m, ','), '') AS missing_topics, coalesce(n, 0) AS unique_context_count,
  coalesce(array_to_string(sh, ','), '') AS shared_ctx,
  CASE WHEN coalesce(len(s), 0) >= 2 AND coalesce(len(w), 0) = 0 AND coalesce(len(m), 0) = 0 AND n >= 2 AND own2 = 2
       THEN 'balanced_comparison' WHEN coalesce(len(s), 0) + coalesce(len(w), 0) >= 2 THEN 'asymmetric_comparison'
       ELSE 'insufficient_comparison' END AS comparison_status
FROM r LEFT JOIN cx USING (query_id)""",
)
def comparison_status(spark, sf_dir):
    ctx = contexts(spark, sf_dir)
    chosen = aggregation.comparison_contexts(ctx, RULES)
    return aggregation.comparison_status(chosen, target_queries(ctx)).select(
        "query_id", *joined("supported_topics", "weak_topics", "missing_topics", "shared_ctx"),
        "unique_context_count", "comparison_status",
    )


CAND_SCORE = (
    f"4 + CASE WHEN {sql_any('text', L['compare_usage'])} THEN 2 ELSE 0 END + CASE WHEN {sql_any('text', L['compare_reason'])} THEN 2 ELSE 0 END"
    f" + CASE WHEN {sql_any('text', L['compare_process'])} THEN 1 ELSE 0 END - CASE WHEN {sql_any('text', L['compare_noise'])} THEN 4 ELSE 0 END"
)


@query(
    "comparison_candidates",
    f"""WITH {HIT_CTES},
m AS (SELECT query_id, rank, targets, {CAND_SCORE} AS score, {topic_list_sql(lambda t: sql_any('text', t.mention))} AS t FROM hits),
e AS (SELECT query_id, rank, score, t, unnest(targets) AS topic FROM m)
SELECT query_id, topic, row_number() OVER (PARTITION BY query_id, topic ORDER BY score DESC, rank) AS pos, rank AS ctx, score
FROM e WHERE list_contains(t, topic) AND score >= 1 QUALIFY pos <= 2""",
)
def comparison_candidates(spark, sf_dir):
    return aggregation.comparison_candidates(contexts(spark, sf_dir), RULES).select(
        "query_id", "topic", "pos", "ctx", "score"
    )


@query("comparison_signals")
def comparison_signals(spark, sf_dir):
    ctx = contexts(spark, sf_dir)
    return aggregation.comparison_signals(ctx, aggregation.comparison_candidates(ctx, RULES), RULES)


@query(
    "steps_contexts",
    f"""WITH {FLAG_CTES},
m AS (SELECT query_id, rank, signal, {topic_list_sql(lambda t: sql_any('text', t.mention))} AS t, unnest(targets) AS topic FROM flagged)
SELECT query_id, topic, row_number() OVER (PARTITION BY query_id, topic ORDER BY (NOT signal)::INT, rank) AS pos, rank AS ctx
FROM m WHERE list_contains(t, topic) QUALIFY pos <= 3""",
)
def steps_contexts(spark, sf_dir):
    return aggregation.steps_contexts(contexts(spark, sf_dir), RULES).select(
        "query_id", "topic", "pos", "ctx"
    )


PREFIXES = tuple(f"({t.label}) - " for t in RULES.topics) + ("", "", "")


@query(
    "evidence_cap",
    f"""WITH {HIT_CTES},
b AS (SELECT query_id, rank AS pos, targets, {sql_choose(PREFIXES, 'chunk_id')} || {sql_choose(SENTENCES, 'chunk_id')} AS bullet FROM hits),
h AS (SELECT *, lower(trim(regexp_extract(bullet, '^\\(?\\s*([A-Za-z_ ]+?)\\s*\\)?\\s*[:\\-]', 1))) AS head,
   {topic_list_sql(lambda t: sql_any('lower(trim(bullet))', t.mention))} AS m FROM b),
t AS (SELECT *, coalesce(
   [x FOR x IN targets IF head <> '' AND (CASE x {' '.join(f"WHEN '{t.name}' THEN head = '{t.label.lower()}' OR contains(replace(head, ' ', '_'), '{t.name.lower()}')" for t in RULES.topics)} END)][1],
   [x FOR x IN targets IF list_contains(m, x)][1]) AS topic FROM h),
p AS (SELECT *, coalesce(list_position(targets, topic), 99) AS place FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY pos) AS nth FROM p)
SELECT query_id, pos, topic, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS new_pos FROM n
WHERE place = 99 OR nth <= 2 QUALIFY new_pos <= 5""",
)
def evidence_cap(spark, sf_dir):
    i = F.col("chunk_id")
    bullets = themed_hits(spark, sf_dir).select(
        "query_id", F.col("rank").alias("pos"), "targets",
        F.concat(choose(PREFIXES, i), choose(SENTENCES, i)).alias("bullet"),
    )
    return aggregation.cap_evidence(bullets, RULES, per_topic=2, total=5).select(
        "query_id", "pos", "topic", "new_pos"
    )
