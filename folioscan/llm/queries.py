"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.llm import (
    common, decontam, dialogue, licences, linededup, mixing, negatives, ordermin, packing, quality, sharding, tokens, wand, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(common.documents(spark, sf_dir), tokenizer_path())


@query("op2_boosted_quality")
def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(
    "op3_line_dedup",
    r"""
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
         l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, lines, lines[i] AS line FROM t),
         k AS (SELECT doc_id, i, line,
                      translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
         m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
               GROUP BY key HAVING min(doc_id) <> max(doc_id)),
         d AS (SELECT k.*, m.first IS NOT NULL AND m.first <> doc_id AS gone FROM k LEFT JOIN m USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM d GROUP BY doc_id
    """,
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(common.documents(spark, sf_dir)))


@query("op4_simhash_windows")
def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contaminated(common.documents(spark, sf_dir), items)


@query(
    "op5_block_max_wand",
    r"""
    WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
         stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
         post AS (SELECT doc_id, dl, term, count(*) AS tf
                  FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
         idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stat GROUP BY term, n),
         scored AS (SELECT q.doc_id AS query_id, d.doc_id,
                           round(sum(q.tf * idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * d.dl / mean))), 6) AS score
                    FROM post q JOIN post d USING (term) JOIN idf USING (term), stat
                    WHERE q.doc_id % 20 = 0 GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored QUALIFY rank <= 10
    """,
)
def op5_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return wand.search(docs, asked)


@query("op6_lpt_shards")
def op6_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(common.documents(spark, sf_dir))


@query("op7_licence_rules", licences.scan_sql())
def op7_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.documents(spark, sf_dir))


@query("op8_pivotal_mix")
def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir))


@query(
    "op9_warc_revisits",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
         m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM m
    """,
)
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op10_order_minhash")
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.near_duplicates(common.documents(spark, sf_dir))


@query("op11_dialogue_repair", dialogue.REPAIR_SQL)
def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_digest(dialogue.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query(
    "op12_packed_negatives",
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                      list_dot_product(a.v, c.v)::BIGINT AS score
               FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
         p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
         n AS (SELECT anchor_id, positive_id,
                      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
                      vec_id AS negative_id, positive_score, score AS negative_score
               FROM p JOIN s USING (anchor_id)
               WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT * FROM n WHERE rank <= 10
    """,
)
def op12_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(common.documents(spark, sf_dir), tokenizer_path()))
