"""The composed jobs from pages to hits and from logs to evaluation rows."""

from pyspark.sql import functions as F

from folioscan.operators import lexical
from folioscan.plans import evaluate, ingest, retrieve
from folioscan.settings import RetrievalSettings
from folioscan.sources import logs


def test_ingest_then_retrieve(spark, tmp_path):
    rows = [
        ("T1_RAD", "T1_RAD.pdf", 0, "SISTEM PRESENSI PEGAWAI BERBASIS WEB\nOleh\nBudi Santoso\n2022"),
        ("T1_RAD", "T1_RAD.pdf", 1, "BAB I\nPenelitian ini menggunakan metode RAD untuk presensi pegawai. " * 4),
        ("T1_RAD", "T1_RAD.pdf", 2, "DAFTAR PUSTAKA\n\n" + "Pressman, rekayasa perangkat lunak, referensi metode RAD, edisi tujuh. " * 2),
        ("T2", "T2.pdf", 0, "BAB I\nPrototyping dipakai pada aplikasi tiket kereta. " * 5),
        ("T3", "T3.pdf", 0, "  "),
    ]
    pages = spark.createDataFrame(rows, "doc_id string, source_file string, page int, text string")
    folder = str(tmp_path / "store")
    tables = ingest.run_ingest(pages, folder)
    cat = {r.doc_id: r for r in tables["doc_catalog"].collect()}
    assert cat["T1_RAD"].streams == ["narasi", "sitasi"] and cat["T1_RAD"].year == 2022
    assert [r.doc_id for r in tables["rejects"].collect()] == ["T3"]
    rad = F.array(F.lit(1.0), F.lit(0.0))
    chunks = tables["chunks"].withColumn(
        "embedding", F.when(F.col("doc_id") == "T1_RAD", rad).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    )
    q = spark.createDataFrame(
        [(1, "Apa metode RAD pada presensi?"), (2, "Sebutkan referensi metode RAD"), (3, "presensi tahun 2001")],
        "query_id int, text string",
    ).withColumn("embedding", rad)
    index = ingest.open_index(spark, folder)
    assert isinstance(index, lexical.Bm25Index)
    hits = retrieve.retrieve(q, chunks, index, settings=RetrievalSettings(top_k=4)).collect()
    first = {r.query_id: r for r in hits if r.rank == 1}
    assert first[1].doc_id == "T1_RAD" and first[1].is_reserved_anchor
    assert {r.stream for r in hits if r.query_id == 2} >= {"narasi", "sitasi"}
    assert first[3].doc_id == "T1_RAD"  # the filter matched nothing and was dropped


def test_eval_dataset(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "narasi", "teks penuh")], "chunk_id string, stream string, text string")
    answers = spark.createDataFrame(
        [("r", "1", "apa", "Jawaban: x\nBukti: -", ["c1"]), ("r", "2", "apa", "", ["c1"])],
        "run_id string, turn_id string, user_query string, answer string, used_context_chunk_ids array<string>",
    )
    logs.append_jsonl(answers, str(tmp_path / "answers"))
    q = spark.createDataFrame([(1, "r", 1, "apa")], "query_id int, run_id string, turn_id int, text string")
    hits = spark.createDataFrame([(1, 1, "c1", "d", "t", 0.5)], "query_id int, rank int, chunk_id string, doc_id string, text string, score double")
    logs.append_jsonl(logs.retrieval_records(hits, q, config={}, mode="dense", top_k=1), str(tmp_path / "retrieval"))
    out = evaluate.build_eval_dataset(spark, str(tmp_path / "answers"), str(tmp_path / "retrieval"), chunks, str(tmp_path / "out"))
    got = {r.turn_id: (r.skip_reason, r.context_source, r.retrieval_mode) for r in out["audit"].collect()}
    assert got == {1: (None, "index_full", "dense"), 2: ("empty_answer", "index_full", None)}
    metrics = spark.createDataFrame([("r", 1, 0.5, float("nan"))], "run_id string, turn_id int, faithfulness double, answer_relevance double")
    row = evaluate.summarize(out["eval"], metrics).first()
    assert (row.mean_faithfulness, row.missing_answer_relevancy, row.rows_partial) == (0.5, 1, 1)
