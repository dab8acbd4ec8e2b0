"""Run logs to audit rows, evaluation rows and a metric summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.operators import evaluation
from folioscan.sources import logs


def build_eval_dataset(
    spark: SparkSession, answers_path: str, retrieval_path: str, chunks: DataFrame, out: str
) -> dict[str, DataFrame]:
    """Join the two logs, rebuild the contexts, write audit and evaluation rows."""
    answers, _ = logs.read_jsonl(spark, answers_path, logs.ANSWER_SCHEMA)
    records, _ = logs.read_jsonl(spark, retrieval_path, logs.RETRIEVAL_SCHEMA)
    rebuilt = evaluation.rebuild_contexts(
        answers.drop("log_pos"), evaluation.last_per_key(records), chunks
    )
    evaluation.audit_rows(rebuilt).write.mode("overwrite").parquet(f"{out}/audit_rows")
    audit = spark.read.parquet(f"{out}/audit_rows")
    rows = evaluation.normalize_eval_rows(evaluation.eval_rows(audit))
    rows.write.mode("overwrite").json(f"{out}/eval_rows")
    return {"audit": audit, "eval": rows}


def summarize(rows: DataFrame, metrics: DataFrame, *group: str) -> DataFrame:
    return evaluation.metric_summary(evaluation.with_metrics(rows, metrics), *group)
