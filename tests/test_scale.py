"""How much one task gets: rows, texts and postings are dealt by their size."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import themes
from folioscan.operators import lexical, structure
from folioscan.plans import segments
from folioscan.rules import INDONESIAN as R
from folioscan.session import spread, tasks_for_text


def largest_part(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def chunk_rows(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("chunk_id"), F.col("id").alias("ord"), F.lit("all").alias("stream"),
        F.concat(F.lit("d"), F.col("id") % 4).alias("doc_id"),
        F.concat_ws(" ", F.lit("alpha beta"), F.concat(F.lit("w"), F.col("id"))).alias("text"),
    )


def test_row_groups_and_not_splits_are_spread(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        table = spark.read.parquet(path)
        assert largest_part(table) == 4000  # many splits, one row group
        assert largest_part(spread(table)) < 4000 / 2
        assert spread(table).count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_postings_are_dealt_by_text(spark, monkeypatch):
    rows = chunk_rows(spark)
    assert tasks_for_text(rows, "text") == spark.sparkContext.defaultParallelism
    assert tasks_for_text(rows, "text", chars=10) > 40
    monkeypatch.setattr(lexical, "tasks_for_text", lambda df, text: tasks_for_text(df, text, chars=10))
    index = lexical.build_bm25_index(rows)
    assert index.postings.rdd.getNumPartitions() > 40
    assert {r["term"]: r["df"] for r in index.terms.collect()}["alpha"] == 40
    assert index.stats.first()["avg_dl"] == 3.0


def test_search_in_documents_does_not_sort_the_postings(spark):
    rows = chunk_rows(spark)
    asked = spark.createDataFrame([(1, "alpha w5", "d1")], "query_id int, text string, f_doc string")
    hits = lexical.bm25_topk(lexical.build_bm25_index(rows), asked, k=2, docs=rows)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == [5, 1]


def test_segments_are_read_by_chunk(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    rows = chunk_rows(spark)
    segments.add_chunks(rows.withColumn("text", F.lit("old words")), folder, run=1)
    segments.add_chunks(rows.where("chunk_id < 20"), folder, run=2, removed=rows.where("doc_id = 'd3'").select("doc_id"))
    monkeypatch.setattr(lexical, "TOKENS_PER_TASK", 2)
    index = segments.open_segments(spark, folder)
    assert index.postings.rdd.getNumPartitions() > 20
    live = {(r["chunk_id"], r["term"]) for r in index.postings.collect()}
    want = {(r["chunk_id"], t) for r in rows.where("chunk_id < 20").collect() for t in r["text"].split()}
    assert live == want  # every document of run 1 is replaced or removed


def test_hits_are_kept(spark, tmp_path):
    root = str(tmp_path)
    spark.range(6).select(F.col("id").alias("doc_id"), F.lit("src").alias("source"), F.lit("en").alias("lang"), F.lit("kata").alias("text")).write.parquet(f"{root}/documents.parquet")
    spark.range(6).select(
        F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    ).write.parquet(f"{root}/embeddings.parquet")
    spark.range(2).select(F.col("id").alias("item_id"), F.lit("kata").alias("text")).write.parquet(f"{root}/benchmark.parquet")
    hits = themes.themed_hits(spark, root, k=3)
    searched = hits.where(F.col("text").rlike("metode"))
    assert "InMemoryRelation" in searched._jdf.queryExecution().withCachedData().toString()
    assert hits.count() == 6
    spark.catalog.clearCache()


def test_files_without_a_common_name_are_no_single_task(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    meta = spark.range(400).select(
        F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("file_"), "id", F.lit(".pdf")).alias("source_file"),
        *[F.lit("x").alias(c) for c in ("title", "author")], F.lit(2020).alias("year"), F.lit("p").alias("program"),
    )
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = structure.propagate_cover_metadata(meta, R)
        assert largest_part(out) < 400
        assert out.where("from_cover").count() == 0 and out.count() == 400
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
