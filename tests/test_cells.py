"""Stored cells: exact mode, recall, folders that are not read, edge rows."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import cells, dense

VECTORS = "chunk_id string, ord long, embedding array<double>, doc_id string"
QUERIES = "query_id int, embedding array<double>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    around = rng.normal(size=(12, 16)) * 4
    rows = [around[i % 12] + rng.normal(size=16) for i in range(600)]
    vectors = [(f"c{i}", i, v.tolist(), f"d{i % 7}") for i, v in enumerate(rows)]
    vectors += [(f"x{i}", 600 + i, rows[5].tolist(), "copy") for i in range(20)]  # ties by ord
    vectors.append(("none", 999, None, "d"))
    asked = [(i, (rows[i * 9] + 0.1).tolist()) for i in range(30)] + [(98, rows[5].tolist()), (99, None)]
    return spark.createDataFrame(vectors, VECTORS).repartition(3), spark.createDataFrame(asked, QUERIES)


@pytest.fixture(scope="module")
def index(data, tmp_path_factory):
    return cells.save_cells(data[0], str(tmp_path_factory.mktemp("cells")), n_cells=12, parts=4, keep=("doc_id",))


def hits(df):
    return {(r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect()}


def test_candidates_are_not_broadcast(data, index):
    """Their number is not known to the planner, which takes them for no more than the codes."""
    plan = cells.search_cells(index, data[1], k=10, n_probe=12, refine=None)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [cell" in plan


def test_bounds_give_the_exact_result(data, index):
    vectors, asked = data
    vectors, asked = vectors.where("embedding IS NOT NULL"), asked.where("embedding IS NOT NULL")
    want = hits(dense.dense_topk(vectors, asked, k=10))
    assert hits(cells.search_cells(index, data[1], k=10, n_probe=12, refine=None)) == want
    # blocks of single queries give the same rows
    assert hits(cells.search_cells(index, data[1], k=10, n_probe=12, refine=None, max_query_rows=1)) == want
    copies = sorted((r, c) for q, r, c, _ in want if q == 98)
    assert [c for _, c in copies] == ["c5", *[f"x{i}" for i in range(9)]]


def test_few_cells_find_most(data, index):
    want = {(q, c) for q, _, c, _ in hits(dense.dense_topk(data[0].where("embedding IS NOT NULL"), data[1].where("query_id < 30"), k=10))}
    got = {(q, c) for q, _, c, _ in hits(cells.search_cells(index, data[1].where("query_id < 30"), k=10, n_probe=4))}
    assert len(want & got) >= 0.95 * len(want)


def test_other_cells_are_not_read(spark, data, tmp_path):
    root = str(tmp_path / "cells")
    index = cells.save_cells(data[0], root, n_cells=12, parts=4)
    one = data[1].where("query_id = 3")
    want = hits(cells.search_cells(index, one, k=5, n_probe=2))
    q = np.array([one.first()["embedding"]])
    probed = set(dense._probe(q, index.centres, 2)[0].tolist())
    for file in glob.glob(f"{root}/codes/cell=*/*.parquet") + glob.glob(f"{root}/vectors/cell=*/*.parquet"):
        if int(file.split("cell=")[1].split("/")[0]) not in probed:
            with open(file, "wb") as f:
                f.write(b"no table")
    schema = {n: getattr(index, n).schema for n in ("codes", "vectors")}
    again = cells.StoredCells(*[spark.read.schema(schema[n]).parquet(f"{root}/{n}") for n in schema], index.centres, index.codebook)
    assert len(want) == 5 and hits(cells.search_cells(again, one, k=5, n_probe=2)) == want


def test_edges(spark, data, index, tmp_path):
    assert cells.search_cells(index, data[1].limit(0), k=3, n_probe=2).count() == 0
    got = cells.search_cells(index, data[1].where("query_id = 1"), k=3, n_probe=2, keep=("doc_id",)).collect()
    assert len(got) == 3 and all(r.doc_id for r in got)
    with pytest.raises(ValueError, match="no vectors"):
        cells.save_cells(data[0].limit(0), str(tmp_path / "a"), n_cells=2)
    same = spark.range(40).select(F.col("id").alias("chunk_id"), F.col("id").alias("ord"), F.array(*[F.lit(1.0)] * 8).alias("embedding"))
    small = cells.save_cells(same, str(tmp_path / "b"), n_cells=4, parts=2)
    q = spark.createDataFrame([(1, [1.0] * 8)], QUERIES)
    assert [r.chunk_id for r in cells.search_cells(small, q, k=4, n_probe=4, refine=None).orderBy("rank").collect()] == [0, 1, 2, 3]
