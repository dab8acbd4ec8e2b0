"""Answer texts, verification, topic sections, evaluation joins, logs."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import answers as A
from folioscan.operators import evaluation, steps, topic_answers, verification
from folioscan.rules import INDONESIAN as R
from folioscan.sources import logs, pages

NF = "Jawaban: Tidak ditemukan pada dokumen.\nBukti: -"


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text,fn,expected",
    [
        ("a (CTX 2) CTX3 [CTX 1] [12]", A.normalize_citations, "a [CTX 2] [CTX 3] [CTX 1]"),
        ("Pertanyaan: x\nJawaban: y\nBukti: -", A.strip_preamble, "Jawaban: y\nBukti: -"),
        ("hanya teks", lambda c: A.enforce_format(c, R), "Jawaban: hanya teks\nBukti: -"),
        ("isi Bukti: satu", lambda c: A.enforce_format(c, R), "Jawaban: isi\nBukti:\nsatu"),
        ("Jawaban: y", lambda c: A.enforce_format(c, R), "Jawaban: y\n\nBukti: -"),
        ("Tidak ditemukan pada dokumen.", lambda c: A.enforce_format(c, R), NF),
        ("Jawaban: y\nBukti:\nsatu\ndua", A.enforce_evidence_list, "Jawaban: y\nBukti:\n- satu\n- dua"),
        ("Jawaban: y\nBukti:\nsatu\n- dua", A.enforce_evidence_list, "Jawaban: y\nBukti:\n- satu\n- dua"),
        ("Jawaban: y bukti: satu", A.enforce_evidence_list, "Jawaban: y bukti: satu"),
        ("Pertanyaan: p\nJawaban: y (CTX 1)\n- (RAD) z CTX2\nBukti: satu [CTX 1]\n\nbukti",
         lambda c: A.repaired(c, R), "Jawaban: y [CTX 1]\nBukti:\n- satu [CTX 1] bukti\n- (RAD) z [CTX 2]"),
        (None, lambda c: A.repaired(c, R), NF),
        ("Jawaban: y\nBukti: -", lambda c: A.repaired(c, R), "Jawaban: y\nBukti: -"),
        ("Jawaban: y\nBukti:\n- a [CTX 1]\n- A [CTX 2]\n- b", A.dedupe_evidence, "Jawaban: y\nBukti:\n- a [CTX 1]\n- b"),
        ("Jawaban: y\n- z [CTX 1]\nBukti: -", A.move_cited_bullets, "Jawaban: y\nBukti:\n- z [CTX 1]"),
        ("Jawaban: y\n- (RAD) tanpa\n- (RAD) ada [CTX 1]\nBukti: -", A.clean_inline_bullets, "Jawaban: y\nBukti:\n- (RAD) ada [CTX 1]"),
        ("Jawaban:\nRAD: a [CTX 1]\nb [CTX 2]\nBukti: -", lambda c: A.evidence_from_answer(c, labels=("RAD",)),
         "Jawaban:\nRAD: a [CTX 1]\nb [CTX 2]\nBukti:\n- (RAD) RAD: a [CTX 1]\n- (RAD) b [CTX 2]"),
        ("Jawaban: a [CTX 1] b\nBukti:\n- c [CTX 1]", A.strip_answer_citations, "Jawaban: a b\nBukti:\n- c [CTX 1]"),
        ("Jawaban: a\n1.\nb\nBukti: -", A.fix_empty_numbers, "Jawaban: a\n\nb\nBukti: -"),
        (NF, A.is_not_found, True),
        ("Jawaban: Tidak ditemukan pada dokumen.\nBukti:\n-", A.is_not_found, True),
        ("Jawaban: RAD: Tidak ditemukan pada dokumen.\nBukti: -", A.is_not_found, False),
    ],
)
def test_answer_text(spark, text, fn, expected):
    assert value(spark, text, fn) == expected


def test_one_parse_equals_the_rules_in_order(spark):
    texts = ["Jawaban: a CTX 1\n- (RAD) b\n- (RAD) c [CTX 2]\nBukti:\nx [CTX 1]\n- X (CTX 3)\ny", "isi", "", "a Bukti:",
             "JAWABAN RAD: a\n- z [CTX 4]\nBukti: -", "Pertanyaan: q\nJawaban: b\nBukti:\n-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.repaired("t", R).alias("once"))
    c = A.enforce_format(A.normalize_citations(A.strip_preamble("t")), R)
    df = df.withColumn("s", c)
    for rule in (A.enforce_evidence_list, A.dedupe_evidence, A.move_cited_bullets, A.clean_inline_bullets):
        df = df.withColumn("s", rule("s"))
    for r in df.collect():
        assert r.once == r.s, r.t


def test_checks_of_finished_text(spark):
    def checks(text):
        return value(spark, text, lambda c: A.sanity_check(c, labels=("RAD", "Prototyping"))).asDict()

    good = checks("Jawaban:\nRAD: a\nPrototyping: b\nBukti:\n- x [CTX 1]")
    assert all(good.values())
    bad = checks("Jawaban:\nRAD: a [CTX 1]\nrad : b\n1. analisis 2. rancang\nBukti:\n- x")
    assert not any(bad.values())
    assert not checks("")["all_pass"]


def test_steps(spark):
    text = "DOC: a | b p.1\n1. analisis kebutuhan\n2. perancangan sistem\n3. use case diagram"
    assert value(spark, text, lambda c: steps.extract_steps(c, R)) == ["analisis kebutuhan", "perancangan sistem"]
    tail = "Tahapan meliputi analisis kebutuhan, perancangan dan pengujian sistem."
    assert value(spark, tail, lambda c: steps.extract_steps(c, R)) == ["analisis kebutuhan", "perancangan", "pengujian sistem"]
    assert value(spark, "Kelebihan yaitu waktu singkat, adaptasi cepat dan mudah", lambda c: steps.extract_steps(c, R)) == []


def check(spark, answer, contexts, question="apa presensi"):
    df = spark.createDataFrame([(answer, contexts, question)], "answer string, contexts array<string>, question string")
    return verification.with_verification(verification.with_generation(df, R), R).first()


def test_partly_grounded_is_partial(spark):
    row = check(spark, "Jawaban: presensi pegawai\nBukti:\n- presensi wajah [CTX 1]\n- zebra [CTX 1]", ["sistem presensi wajah pegawai"])
    v = row.verification
    assert v.evidence_summary.grounded_ratio == 0.5 and v.label == "partial"
    assert row.generation.status == "weak_grounding_bukti"


def test_verified_and_not_found(spark):
    good = check(spark, "Jawaban: presensi pegawai\nBukti:\n- presensi wajah [CTX 1]", ["sistem presensi wajah pegawai"])
    assert good.verification.label == "verified" and good.verification.score == 1.0
    nf = check(spark, NF, ["x"])
    assert (nf.verification.label, nf.verification.score, nf.generation.status) == ("not_found", None, "not_found")


def test_guard_replaces_bad_answers(spark):
    rows = [("Jawaban: zebra singa\nBukti:\n- zebra [CTX 1]", ["sistem presensi"], "apa presensi"),
            ("Jawaban: zebra singa\nBukti:\n- zebra [CTX 1]", ["sistem presensi"], "apa cuaca"),
            ("Jawaban: presensi [CTX 1]\nBukti:\n- presensi [CTX 1]", ["sistem presensi"], "apa presensi")]
    df = spark.createDataFrame(rows, "answer string, contexts array<string>, question string")
    got = [r.final_answer for r in verification.guarded_answer(verification.with_generation(df, R), R).collect()]
    assert got[0].startswith("Jawaban: Informasi relevan") and got[1] == NF
    assert got[2] == "Jawaban: presensi\nBukti:\n- presensi [CTX 1]"


def test_topic_sections(spark):
    text = "Jawaban:\nRAD: cepat\nScrum: x\nPrototyping:\nXP: Tidak ditemukan pada dokumen.\nBukti:\n- (Prototyping) purwarupa [CTX 1]"
    df = spark.createDataFrame([(1, text)], "answer_id int, answer string").withColumn(
        "targets", F.array(*[F.lit(x) for x in ("RAD", "PROTOTYPING", "EXTREME_PROGRAMMING")])
    )
    got = {r.topic: (r.source, r.text) for r in topic_answers.topic_sections(df, R).collect()}
    assert got == {
        "RAD": ("answer", "RAD: cepat"),
        "PROTOTYPING": ("evidence", "Prototyping:\n- purwarupa [CTX 1]"),
        "EXTREME_PROGRAMMING": ("missing", "Extreme Programming: Tidak ditemukan pada dokumen."),
    }
    free = df.withColumn("answer", F.lit("Jawaban: ada pair programming tiap hari\nBukti: -"))
    got = {r.topic: r.source for r in topic_answers.topic_sections(free, R).collect()}
    assert got == {"RAD": "missing", "PROTOTYPING": "missing", "EXTREME_PROGRAMMING": "answer"}


def test_log_round_trip_and_join(spark, tmp_path):
    path = str(tmp_path / "retrieval")
    hits = spark.createDataFrame([(1, 1, "c1", "d", "t" * 600, 0.5)], "query_id int, rank int, chunk_id string, doc_id string, text string, score double")
    q = spark.createDataFrame([(1, "run", 7, "apa")], "query_id int, run_id string, turn_id int, text string")
    logs.append_jsonl(logs.retrieval_records(hits, q, config={"a": 1}, mode="dense", top_k=1), path)
    logs.append_jsonl(logs.retrieval_records(hits, q, config={"a": 1}, mode="hybrid", top_k=1), path)
    good, bad = logs.read_jsonl(spark, path, logs.RETRIEVAL_SCHEMA)
    assert good.cache().count() == 2 and bad.count() == 0
    assert good.first().retrieved_nodes[0].text == "t" * 500 + " ...<trimmed>"
    rec = good.withColumn("log_pos", F.when(F.col("retrieval_mode") == "hybrid", 2).otherwise(1))
    ans = spark.createDataFrame([("run", "7", "apa", "Jawaban: x", ["c1", "c1", "c9"])],
                                "run_id string, turn_id string, user_query string, answer string, used_context_chunk_ids array<string>")
    none = spark.createDataFrame([], "chunk_id string, stream string, text string")
    row = evaluation.audit_rows(evaluation.rebuild_contexts(ans, evaluation.last_per_key(rec), none)).first()
    assert (row.context_source, row.missing_context_chunk_ids, row.retrieval_mode) == ("retrieval_join", ["c9"], "hybrid")
    assert row.include_in_eval and row.contexts_have_trimmed_preview


def test_text_pages(spark):
    docs = spark.createDataFrame([("d", "d.pdf", "a\fb\f \fc")], "doc_id string, source_file string, text string")
    assert [(r.page, r.text) for r in pages.pages_from_text(docs).collect()] == [(0, "a"), (1, "b"), (3, "c")]
