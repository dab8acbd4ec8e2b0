"""Registry of the driver queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.session import spread

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question for DuckDB."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(expr: str, patterns) -> str:
    """``expr`` matches one of the patterns, case ignored."""
    pats = [patterns] if isinstance(patterns, str) else list(patterns)
    return "regexp_matches(" + expr + ", " + sql_text("(?i)" + "|".join(f"(?:{p})" for p in pats)) + ")"


def sql_count(expr: str, patterns) -> str:
    return "(" + " + ".join(f"{sql_any(expr, p)}::INT" for p in patterns) + ")"


def sql_contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_text(w)})" for w in words) + ")"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_text(w) for w in words) + "]"


def squeezed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


# -- shared views --------------------------------------------------------------


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk; the source plays the document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("ord"),
        F.lit("all").alias("stream"),
        F.col("source").alias("doc_id"),
        F.col("lang").alias("label"),
        "text",
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("vec_id").alias("ord"),
        F.col("label").alias("doc_id"),
        F.col("label").alias("year"),
        "embedding",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per benchmark item (the vector with its id)."""
    emb = table(spark, sf_dir, "embeddings")
    return (
        table(spark, sf_dir, "benchmark")
        .join(emb, F.col("item_id") == F.col("vec_id"))
        .select(F.col("item_id").alias("query_id"), "text", "embedding", "label")
    )


SQL_TOKENS = (
    "[x FOR x IN string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+')"
    " IF x <> '']"
)


def tokens_sql(c: str) -> str:
    return SQL_TOKENS.format(c=c)


#: scored(query_id, chunk_id, score) of all matching pairs, documents as chunks
BM25_CTES = f"""
tok AS (SELECT doc_id AS chunk_id, {tokens_sql('text')} AS toks FROM documents),
stat AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT chunk_id, dl, term, count(*) AS tf
         FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tok)
         GROUP BY chunk_id, dl, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS r FROM dfs, stat),
terms AS (SELECT term, df,
                 CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, (SELECT avg(r) AS mean FROM raw)),
qterm AS (SELECT query_id, term, count(*) AS qtf
          FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark)
          GROUP BY query_id, term),
scored AS (SELECT query_id, chunk_id,
                  round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM post JOIN qterm USING (term) JOIN terms USING (term), stat
           GROUP BY query_id, chunk_id)"""

#: dist(query_id, chunk_id, doc_id, score) of all pairs of benchmark items and vectors
DENSE_CTES = """
qv AS (SELECT item_id AS query_id, embedding AS q, label AS q_label
       FROM benchmark JOIN embeddings ON item_id = vec_id),
dist AS (SELECT query_id, q_label, vec_id AS chunk_id, label AS doc_id,
                round(list_sum([(q[i]::DOUBLE - embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]), 6) AS score
         FROM qv, embeddings)"""

BM25_HITS = """
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
       FROM scored QUALIFY rank <= {k})"""

DENSE_HITS = """
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank
       FROM dist QUALIFY rank <= {k})"""
