"""What lies on the disks between the steps of a job."""

import os

from pyspark.sql import functions as F

from driver_queries import REGISTRY
from folioscan.operators import chunking, ordered, structure
from folioscan.rules import INDONESIAN as R
from folioscan.session import Stages


def cached(spark):
    return len(spark.sparkContext._jsc.getPersistentRDDs())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_pages(spark):
    body = "Penelitian ini membahas metode presensi pegawai. "
    rows = [(d, f"{d}.pdf", p, h + body * (p + 1)) for d in ("a", "b") for p, h in enumerate(("BAB I\n", "", "BAB II\n", "DAFTAR PUSTAKA\n", ""))]
    return spark.createDataFrame(rows, "doc_id string, source_file string, page int, text string")


def test_stages_are_stored_and_dropped(spark):
    stages = Stages(spark, "test")
    one = stages.stored(spark.range(5).withColumn("t", F.lit("x")), "one")
    two = stages.stored(one.where("id > 1"), "two")
    assert one.count() == 5 and two.count() == 3 and os.path.isdir(stages.folder)
    stages.drop()
    assert not os.path.exists(stages.folder)


def test_bins_bring_columns(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 3, 1), ("b", 0, 2), ("c", 1, 1)], "k string, g int, o int")
    names = spark.createDataFrame([("a", 0, "x"), ("a", 3, "y"), ("b", 0, "z")], "k string, g int, name string")
    got = ordered.position(
        rows, keys=["k"], bin=[F.col("g")], order=[F.col("o")], name="n",
        of_bins=lambda b: b.join(names.withColumnRenamed("g", "_bin0"), ["k", "_bin0"]),
    )
    assert {tuple(r) for r in got.select("k", "g", "n", "name").collect()} == {("a", 0, 1, "x"), ("a", 3, 2, "y"), ("b", 0, 1, "z")}


def test_document_catalog_caches_no_texts(spark, tmp_path):
    """Only header lines are cached; pages and pieces are stored, and their counts move no texts."""
    texts = [(i, "\n".join(f"line {j} of some words that go on" for j in range(40))) for i in range(6)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = cached(spark)
    rows = REGISTRY["document_catalog"](spark, str(tmp_path))
    assert cached(spark) - before <= 1
    assert "page_count" in rows.columns and rows.count() == 6
    sections = Stages(spark, "test").stored(structure.section_pages(some_pages(spark), R), "sections")
    counted = plan(chunking.chunk_sections(sections, citation_separator=r"\n+").groupBy("doc_id", "stream").count())
    assert "InMemoryTableScan" not in counted and "text:string" not in counted


def test_fields_of_documents_come_with_the_bins(spark):
    sections = structure.section_pages(some_pages(spark), R)
    fields = spark.createDataFrame([("a", "T")], "doc_id string, title string")
    plain = chunking.chunk_sections(sections, citation_separator=r"\n+")
    want = {tuple(r) for r in plain.join(fields, "doc_id", "left").select(*plain.columns, "title").collect()}
    got = chunking.chunk_sections(sections, citation_separator=r"\n+", fields=fields)
    assert {tuple(r) for r in got.collect()} == want and {r[-1] for r in want} == {"T", None}
