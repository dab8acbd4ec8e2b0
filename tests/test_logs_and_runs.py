"""Log readers, contexts per answer, metric joins and run folders."""

import json

from folioscan.operators import evaluation, lexical, runs
from folioscan.sources import logs
from folioscan.settings import Bm25Settings


def test_json_lines_and_arrays_keep_every_row(spark, tmp_path):
    rows = [{"run_id": "r", "turn_id": i, "question": f"q{i}", "answer": "a", "contexts": ["c"]} for i in range(5)]
    lines, arrays = tmp_path / "lines", tmp_path / "arrays"
    lines.mkdir(), arrays.mkdir()
    (lines / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (arrays / "a.json").write_text(json.dumps(rows))
    assert logs.read_eval_rows(spark, str(lines)).count() == 5
    assert logs.read_eval_rows(spark, str(arrays), array=True).count() == 5


def test_answers_of_one_key_keep_their_own_contexts(spark):
    answers = spark.createDataFrame(
        [("r", "bad", "one", ["c1"]), ("r", "worse", "two", ["c2", "c9"]), ("r", "7", "three", ["c2"]), ("r", "7", "four", [])],
        "run_id string, turn_id string, answer string, used_context_chunk_ids array<string>",
    )
    retrieval = spark.createDataFrame(
        [("r", "7", 1, [("c9", "seen")])],
        "run_id string, turn_id string, log_pos int, retrieved_nodes array<struct<chunk_id:string,text:string>>",
    )
    chunks = spark.createDataFrame([("c1", "narasi", "text 1"), ("c2", "narasi", "text 2")], "chunk_id string, stream string, text string")
    out = evaluation.rebuild_contexts(answers, evaluation.last_per_key(retrieval), chunks).collect()
    assert {r["answer"]: r["contexts"] for r in out} == {"one": ["text 1"], "two": ["text 2"], "three": ["text 2"], "four": []}
    assert {r["answer"]: r["missing_context_chunk_ids"] for r in out}["two"] == ["c9"]


def test_rows_without_metrics_stay(spark):
    rows = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, turn_id long")
    metrics = spark.createDataFrame([("r", 1, 0.5), ("r", 9, 0.1)], "run_id string, turn_id long, faithfulness double")
    joined = {r["turn_id"]: r["row_status"] for r in evaluation.with_metrics(rows, metrics).collect()}
    assert joined == {1: "partial", 2: "unmatched"}
    assert [r["turn_id"] for r in evaluation.unmatched_metrics(rows, metrics).collect()] == [9]


def test_keep_marker_protects_a_run(spark, tmp_path):
    for run, names in {"2024-01-01_00-00-00": ["a.txt", ".keep"], "2024-01-02_00-00-00": ["a.txt"], "other": ["x"]}.items():
        (tmp_path / run).mkdir()
        for n in names:
            (tmp_path / run / n).write_text("12345")
    catalog = {r["run_id"]: r for r in runs.run_catalog(runs.run_files(spark, str(tmp_path))).collect()}
    assert set(catalog) == {"2024-01-01_00-00-00", "2024-01-02_00-00-00"}
    assert catalog["2024-01-01_00-00-00"]["keep"] and not catalog["2024-01-02_00-00-00"]["keep"]
    assert catalog["2024-01-01_00-00-00"]["size_bytes"] == 10


def test_zero_filling_keeps_negative_scores(spark):
    chunks = spark.createDataFrame(
        [(i, i, "all", "common word" if i < 4 else "rare thing") for i in range(5)], "chunk_id long, ord long, stream string, text string"
    )
    queries = spark.createDataFrame([(1, "common")], "query_id long, text string")
    settings = Bm25Settings(epsilon=1.0)
    index = lexical.build_bm25_index(chunks, settings=settings)
    plain = {r["chunk_id"]: r["score"] for r in lexical.bm25_topk(index, queries, k=5, settings=settings).collect()}
    full = {r["chunk_id"]: r["score"] for r in lexical.bm25_topk(index, queries, k=5, settings=settings, fill_zero=True, chunks=chunks).collect()}
    assert full == {**plain, 4: 0.0} and len(plain) == 4
    top = lexical.bm25_topk(index, queries, k=1, settings=settings, fill_zero=True, chunks=chunks).collect()
    assert [(r["chunk_id"], r["score"]) for r in top] == ([(4, 0.0)] if plain[0] < 0 else [(0, plain[0])])


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "turn_id string")
    assert logs.append_jsonl(rows("1", "2"), path, "run/1") and not logs.append_jsonl(rows("1", "2"), path, "run/1")
    rows("5").write.json(f"{path}/batch=half")  # a run that ended before its entry
    assert logs.append_jsonl(rows("3"), path, "half")
    read, bad = logs.read_jsonl(spark, path, logs.ANSWER_SCHEMA)
    assert sorted(r["turn_id"] for r in read.collect()) == ["1", "2", "3"] and bad.count() == 0
    assert sorted(map(tuple, logs.batches(spark, path).collect())) == [("half", 1), ("run/1", 2)]


def test_several_metric_rows_of_a_key_count_once(spark):
    rows = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, turn_id long")
    metrics = spark.createDataFrame([("r", 1, 0.5), ("r", 1, 1.0), ("r", 1, None)], "run_id string, turn_id long, faithfulness double")
    out = {r["turn_id"]: (r["faithfulness"], r["metric_rows"]) for r in evaluation.with_metrics(rows, metrics).collect()}
    assert out == {1: (0.75, 3), 2: (None, None)}
