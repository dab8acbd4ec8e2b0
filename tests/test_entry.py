"""The driver entry works with and without the training-data package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(block: str) -> set[str]:
    code = f"import sys; {block}; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_queries_without_the_training_data_package():
    left = names("sys.modules['folioscan.llm'] = None; sys.modules['corpus_pipeline'] = None")
    assert {"bm25_topk", "eval_join"} <= left and "pipeline" not in left
    assert not [n for n in left if n.startswith("op") and n[2].isdigit()]
