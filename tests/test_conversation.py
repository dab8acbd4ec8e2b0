"""History windows, topic shifts, questions, catalog references, retention."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions import intent
from folioscan.operators import conversation, metadata_qa, ordered, runs
from folioscan.rules import INDONESIAN as R
from folioscan.settings import HistorySettings

VOCAB = ["presensi", "jaringan", "basis", "data", "web", "mobile", "robot", "sensor", "pasar", "harga"]


def shift_of(spark, query, window):
    rows = [(query, [(i, i, q, a, t) for i, (q, a, t) in enumerate(window)])]
    df = spark.createDataFrame(rows, f"q string, h {conversation.HISTORY}")
    return df.select(conversation.topic_shift("q", F.col("h"), R).alias("s")).first().s


def test_topic_shift_reasons(spark):
    past = [("metode rad untuk sistem presensi pegawai", "jawaban tentang presensi", ["RAD"])]
    assert shift_of(spark, "ganti topik dong", past).reason == "explicit_marker"
    assert shift_of(spark, "lebih ringkas lagi", past).reason == "compression_followup"
    assert shift_of(spark, "bagaimana itu", past).reason == "anaphora"
    assert shift_of(spark, "robot sensor pasar harga", past).is_shift
    assert not shift_of(spark, "presensi pegawai kantor", past).is_shift
    assert shift_of(spark, "apa saja", []).reason == "no_history"


def simulate(turns, w):
    """The sequential rule, turn by turn."""
    flags, out = [], []
    for p, (query, terms, marker, ana) in enumerate(turns):
        last = next((i for i in range(p - 1, -1, -1) if flags[i]), None)
        if ana and last is not None and last == p - 1:
            window = list(range(max(0, last - w), last))
        else:
            lo = max(0, p - w) if last is None else max(last, p - w, 0)
            window = list(range(lo, p))
        seen = {t for i in window for t in turns[i][1]}
        if not window:
            shift = False
        elif marker:
            shift = True
        elif ana:
            shift = False
        elif len(terms) < 3 or len(seen) < 3:
            shift = False
        else:
            shift = len(terms & seen) / len(terms) < 0.15
        flags.append(shift)
        out.append((p + 1, shift, [i + 1 for i in window]))
    return out


@pytest.mark.parametrize("per_bin", [2, 5, 1024])
def test_windows_match_sequential_rule(spark, monkeypatch, per_bin):
    monkeypatch.setattr(conversation, "TURNS_PER_BIN", per_bin)
    rng = random.Random(11)
    rows, want = [], {}
    for conv in range(6):
        turns = []
        for t in range(40 if conv == 0 else 9):
            terms = set(rng.sample(VOCAB, rng.choice([2, 3, 4])))
            marker, ana = rng.random() < 0.15, rng.random() < 0.25
            text = " ".join(sorted(terms)) + (" ganti topik" if marker else "") + (" itu" if ana else "")
            full = terms | ({"ganti", "topik"} if marker else set())
            turns.append((text, full, marker, ana))
            rows.append((conv, t * 3, t + 1, text, "", []))
        want[conv] = simulate(turns, 4)
    df = spark.createDataFrame(
        rows, "conv_id int, turn bigint, pos bigint, query string, answer_preview string, topics array<string>"
    )
    got = {}
    for r in conversation.conversation_windows(df, R, HistorySettings()).orderBy("conv_id", "pos").collect():
        got.setdefault(r.conv_id, []).append((r.pos, r.is_shift, [h.pos for h in r.window]))
    assert got == want


def test_running_total_over_bins(spark):
    rows = [(k, i, i % 7) for k in ("hot", "cold") for i in range(50 if k == "hot" else 3)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    out = ordered.running_total(df, keys=["k"], bin=[F.floor(F.col("o") / 8)], order=[F.col("o")], value=F.col("v"), name="s")
    for r in out.collect():
        assert r.s == sum(i % 7 for i in range(r.o + 1))


def test_standalone_questions(spark):
    h = [(1, 1, "apa itu rad", "RAD adalah metode", ["RAD"])]
    df = spark.createDataFrame([("tahapannya apa?", h)], f"q string, h {conversation.HISTORY}")
    row = df.select(
        conversation.context_rewrite("q", F.col("h"), R).alias("a"),
        conversation.steps_standalone(intent.target_topics("q", F.col("h"), R), R).alias("b"),
        conversation.is_weak_rewrite(F.lit("Apa tahapan adalah metode RAD?"), F.col("h"), R).alias("c"),
        conversation.is_weak_rewrite(F.lit("apa itu"), F.col("h"), R).alias("d"),
        conversation.history_block(F.col("h")).alias("e"),
    ).first()
    assert row.a == "tahapannya apa?\n\n(Konteks sebelumnya: RAD adalah metode)"
    assert row.b == "Apa saja tahapan dari metode RAD?"
    assert (row.c, row.d) == (False, True)
    assert row.e == "User: apa itu rad\nAssistant: RAD adalah metode"


@pytest.mark.parametrize(
    "q,primary",
    [
        ("Bandingkan RAD dan waterfall", "method_comparison"),
        ("Apa tahapan metode RAD?", "single_target_steps"),
        ("Ada berapa skripsi? Sebutkan judulnya", "doc_count_list"),
        ("Pada skripsi yang menggunakan RAD, jelaskan RAD", "method_explanation"),
        ("Sebutkan skripsi yang menggunakan waterfall", "doc_listing"),
        ("Metode apa yang digunakan", "method_identification"),
        ("Siapa ketua kelas", "general_qa"),
    ],
)
def test_intents(spark, q, primary):
    df = spark.createDataFrame([(q,)], "text string")
    assert intent.with_intent_plan(df, R).first().plan.primary_intent == primary


def brute_resolve(ref, names):
    import re

    loose = lambda s: re.sub(r"[^a-z0-9]+", "", re.sub(r"\.pdf$", "", s.lower()))
    best = (0, None)
    for doc, aliases in names:
        top = 0
        for a in aliases:
            q, x = loose(ref), loose(a)
            if not q or not x:
                continue
            s = 100 if q == x else (85 if min(len(q), len(x)) >= 5 else 70) if q in x or x in q else 0
            top = max(top, s)
        if top > best[0]:
            best = (top, doc)
    return best[1] if best[0] >= 80 else None


def test_alias_resolution_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["sistem", "monitoring", "tiket", "presensi", "web", "ta", "gudang", "kas"]
    cat = [(f"D{i:02d}", i, f"D{i:02d}_{rng.choice(words)}_{rng.choice(words)}.pdf",
            " ".join(rng.sample(words, 3))) for i in range(12)]
    df = spark.createDataFrame(cat, "doc_id string, ord int, source_file string, title string")
    refs = [" ".join(rng.sample(words, n)) for n in (1, 2, 2, 3, 3) for _ in range(3)] + ["tidak dikenal", "kas", "D03"]
    got = {r.ref: r.doc_id for r in metadata_qa.resolve_refs(spark.createDataFrame([(x,) for x in refs], "ref string"), df, R).collect()}
    names = {}
    for r in metadata_qa.aliases(df).collect():
        names.setdefault((r.ord, r.doc_id), []).append(r.alias)
    ordered_names = [(d, a) for (_, d), a in sorted(names.items())]
    for ref in set(refs) - {"D03"}:
        assert got.get(ref) == brute_resolve(ref, ordered_names), ref
    assert got["D03"] == "D03"


def test_exploded_grams_are_not_broadcast(spark):
    """Equal answers whether the grams of the references are few or many; names stay in their tasks."""
    df = spark.createDataFrame([(f"d{i}", i, f"Brand_{i % 3}_{i}.pdf", f"red bolt {i % 4}") for i in range(40)], "doc_id string, ord long, source_file string, title string")
    refs = spark.createDataFrame([("brand 1",), ("x red bolt 2",), ("d7",), ("tidak ada",)], "ref string")
    few, many = (metadata_qa.resolve_refs(refs, df, R, few_grams=n) for n in (100_000, 0))
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 3
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().sparkPlan().toString()


def test_unknown_quoted_name(spark):
    cat = spark.createDataFrame([("d", 0, "d.pdf", "judul", 5)], "doc_id string, ord int, source_file string, title string, page_count int")
    q = spark.createDataFrame([(1, 'Berapa halaman "entah apa"?')], "query_id int, text string")
    assert metadata_qa.page_count_answers(q, cat, R).first().reason == "not_in_catalog"


def test_retention_keeps_marked_runs_marked(spark):
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    rows = [("a", day(0), 10, False), ("b", day(1), 10, True), ("c", day(5), 10, False), ("d", day(8), 10, False), ("e", day(9), 10, False)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, size_bytes bigint, keep boolean")
    now = F.lit(day(10))
    plan = runs.retention_plan(df, keep_last=1, now=now, max_age_days=7, max_total_bytes=25)
    assert {r.run_id: r.remove for r in plan.collect()} == {"a": True, "b": False, "c": True, "d": True, "e": False}
    small = runs.retention_plan(df, keep_last=1, now=now, max_age_days=7, max_total_bytes=1000)
    assert {r.run_id for r in small.where("remove").collect()} == {"a"}


def test_run_catalog_prefers_manifest_then_name(spark):
    files = spark.createDataFrame(
        [("2024-01-02_03-04-05", "a.jsonl", 3, dt.datetime(2025, 1, 1)), ("2024-01-02_03-04-05", "KEEP", 0, dt.datetime(2025, 1, 1)),
         ("2024-02-02_03-04-05", "a.jsonl", 7, dt.datetime(2025, 1, 1)), ("other", "x", 1, dt.datetime(2025, 1, 1))],
        "run_id string, name string, length bigint, modified timestamp",
    )
    manifests = spark.createDataFrame([("2024-02-02_03-04-05", "2024-03-01T00:00:00Z")], "run_id string, timestamp string")
    got = {r.run_id: (r.ts, r.size_bytes, r.keep) for r in runs.run_catalog(files, manifests).collect()}
    assert got == {
        "2024-01-02_03-04-05": (dt.datetime(2024, 1, 2, 3, 4, 5), 3, True),
        "2024-02-02_03-04-05": (dt.datetime(2024, 3, 1), 7, False),
    }
