"""JSON-lines logs: readers, writers and the retrieval record."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.functions.text import ellipsis

NODE = (
    "struct<chunk_id:string,doc_id:string,text:string,score:double,score_dense:double,"
    "score_sparse:double,rank_dense:int,rank_sparse:int>"
)
RETRIEVAL_SCHEMA = (
    "run_id string, turn_id string, timestamp string, retrieval_mode string, retrieval_query string, "
    f"top_k int, retrieved_nodes array<{NODE}>, metadata_route struct<handled:boolean>, "
    "config_hash string, _corrupt_record string"
)
ANSWER_SCHEMA = (
    "run_id string, turn_id string, timestamp string, user_query string, retrieval_query string, "
    "question string, answer string, used_context_chunk_ids array<string>, contexts array<string>, "
    "strategy string, generator_status string, verification struct<label:string,score:double>, "
    "metadata_route struct<handled:boolean>, _corrupt_record string"
)
EVAL_SCHEMA = (
    "run_id string, turn_id bigint, question string, question_eval string, question_user string, "
    "answer string, contexts array<string>, reference string, reference_contexts array<string>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log and the lines that do not parse."""
    lines = spark.read.text(path).select(
        F.from_json(
            "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        ).alias("row"),
        F.struct("_metadata.file_path", "_metadata.file_block_start",
                 F.monotonically_increasing_id().alias("i")).alias("log_pos"),
    )
    bad = F.col("row._corrupt_record").isNotNull()
    good = lines.where(~bad).select("row.*", "log_pos").drop("_corrupt_record")
    return good, lines.where(bad).select("row._corrupt_record")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n_rows) of the batches that a log holds."""
    try:
        return spark.read.schema("batch string, n_rows bigint").json(f"{path}/_manifest")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], "batch string, n_rows bigint")


def append_jsonl(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append rows to a JSON-lines log; with ``batch``, once however often it is repeated.

    A batch is a folder of its own, written whole and then entered in the manifest.  A
    batch in the manifest is not written again; what a run left that ended before its
    entry is replaced.  Returns whether rows were written.
    """
    if batch is None:
        df.write.mode("append").json(path)
        return True
    spark = df.sparkSession
    if not batches(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    folder = f"{path}/batch={quote(batch, safe='')}"
    df.write.mode("overwrite").json(folder)
    n = spark.read.text(folder).count()
    spark.createDataFrame([(batch, n)], "batch string, n_rows bigint").coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return True


def read_eval_rows(spark: SparkSession, path: str, *, array: bool = False) -> DataFrame:
    """Evaluation rows from JSON lines, or from one JSON array per file (``array``)."""
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", array).json(path)


def config_hash(config: dict) -> str:
    """Name of a configuration: hash of its canonical JSON."""
    import hashlib

    raw = json.dumps(config, sort_keys=True, ensure_ascii=False).encode()
    return "sha256:" + hashlib.sha256(raw).hexdigest()


def trim_nodes(nodes: Column, max_chars: int = 500) -> Column:
    """Node texts cut to ``max_chars`` with a mark; other fields untouched."""
    return F.transform(
        nodes, lambda n: n.withField("text", ellipsis(n["text"], max_chars, " ...<trimmed>"))
    )


def retrieval_records(hits: DataFrame, queries: DataFrame, *, config: dict, mode: str,
                      top_k: int, max_chars: int = 500, with_config: bool = False) -> DataFrame:
    """One log record per query with its hits as nested nodes, in rank order.

    ``queries(query_id, run_id, turn_id, text)``; a query has at most its top-k
    hits, so the nested list is bounded.
    """
    fields = ["chunk_id", "doc_id", "text", "score", "score_dense", "score_sparse", "rank_dense", "rank_sparse"]
    types = dict(f.split(":") for f in NODE[7:-1].split(","))
    node = F.struct(*[
        (F.col(f) if f in hits.columns else F.lit(None)).cast(types[f]).alias(f) for f in fields
    ])
    nodes = hits.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", node.alias("n")))), lambda x: x["n"]).alias("n")
    )
    out = queries.join(nodes, "query_id", "left").select(
        "run_id", "turn_id", F.lit(mode).alias("retrieval_mode"), F.col("text").alias("retrieval_query"),
        F.lit(top_k).alias("top_k"),
        trim_nodes(F.coalesce(F.col("n"), F.array().cast(f"array<{NODE}>")), max_chars).alias("retrieved_nodes"),
        F.lit(config_hash(config)).alias("config_hash"),
    )
    if with_config:
        out = out.withColumn("config", F.lit(json.dumps(config, sort_keys=True, ensure_ascii=False)))
    return out
