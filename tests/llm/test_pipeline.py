import corpus_pipeline as cp
from folioscan.llm import decontam, ordermin, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixing", "token files"]
    good = cp.keep_quality(spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r["doc_id"] for r in quality.classified(docs, labels).collect() if r["predicted"] == 1}
    unique = cp.keep_one_of_near_duplicates(spark, good, SF).cache()
    assert unique.columns == docs.columns
    assert {r["doc_id"] for r in unique.collect()} == {r["class_id"] for r in ordermin.near_duplicates(good).collect()}
    clean = cp.keep_uncontaminated(spark, unique, SF).cache()
    assert clean.columns == docs.columns
    found = {r["doc_id"] for r in decontam.contaminated(unique, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in unique.collect()} - found
    mixed = cp.mix_sources(spark, clean, SF).cache()
    assert mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    out = cp.write_tokens(spark, mixed, SF).collect()
    assert len(out) == mixed.count()


def test_run_agrees_with_itself(spark):
    first, again = (sorted(map(tuple, cp.run(spark, SF).collect())) for _ in range(2))
    assert first == again and first


def test_entry_registers_one_query_for_each_operator():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
