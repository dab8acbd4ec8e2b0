"""Stored vector cells with product-quantised residuals and exact re-ranking.

A vector lies in the folder of its nearest cell centre.  Its residual is cut into
``parts`` pieces, each replaced by the number of the nearest code, so a row of ``codes``
has one byte a piece and the length of what the codes leave out.  A search reads the
folders of the cells its queries probe and no others, estimates distances from tables
of the query's pieces, and reads whole vectors only to rank the candidates exactly.

Centres and codes are fitted on at most ``sample_rows`` vectors, chosen by a hash of
``chunk_id``; every vector is stored.  What the driver holds is the centres and codes:
``n_cells`` + 256 vectors, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioscan.operators import dense

CODES = 256
#: distances are rounded to six decimals; bounds must not drop a tie
SLACK = 1e-5


@dataclass(frozen=True)
class StoredCells:
    codes: DataFrame  # cell, chunk_id, ord, code, miss
    vectors: DataFrame  # cell, chunk_id, ord, embedding and the kept columns
    centres: np.ndarray  # cell, dimension
    codebook: np.ndarray  # piece, code, dimension of a piece


def save_cells(
    vectors: DataFrame,
    path: str,
    *,
    n_cells: int,
    parts: int = 8,
    sample_rows: int = 65_536,
    keep: tuple[str, ...] = (),
    seed: int = 7,
) -> StoredCells:
    """``vectors(chunk_id, ord, embedding)`` in cells below ``path``; rows without a vector are left out.

    The dimension must be a multiple of ``parts``.  Fewer rows than cells make fewer cells.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding IS NOT NULL").select("chunk_id", "ord", "embedding", *keep)
    sample = rows.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows)
    sample.write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    if sample.isEmpty():
        raise ValueError("no vectors to fit cells on")
    centres = dense.train_cells(sample, n_cells=n_cells, seed=seed)
    spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    codebook = _train_codes(sample, centres, parts, seed)
    codebook.write.mode("overwrite").parquet(f"{path}/codebook")
    book = _codebook(spark, path)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = dense._matrix(batch.column("embedding"))
            cell, code, miss = _encode(v, centres, book)
            new = [
                pa.array(cell.astype(np.int32)),
                pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(miss),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new], names=[*batch.schema.names, "cell", "code", "miss"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(assign, f"{fields}, cell int, code binary, miss double")
    placed.write.mode("overwrite").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    # a cell of a third of all rows is written by several tasks
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(8))
    placed = placed.repartition("cell", spread)
    for name, columns in (("codes", ["chunk_id", "ord", "code", "miss"]), ("vectors", ["chunk_id", "ord", "embedding", *keep])):
        placed.select("cell", *columns).sortWithinPartitions("cell", "ord").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{name}")
    return load_cells(spark, path)


def load_cells(spark: SparkSession, path: str) -> StoredCells:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # n_cells rows
    return StoredCells(
        spark.read.parquet(f"{path}/codes"),
        spark.read.parquet(f"{path}/vectors"),
        np.array([r["centre"] for r in centres]),
        _codebook(spark, path),
    )


def search_cells(
    index: StoredCells,
    queries: DataFrame,
    *,
    k: int,
    n_probe: int,
    refine: int | None = 8,
    max_query_rows: int = 2_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Top ``k`` of the ``n_probe`` nearest cells for ``queries(query_id, embedding)``, ties by ``ord``.

    The best ``k * refine`` by estimated distance are ranked by their exact distance.
    With ``refine=None`` every row is ranked whose distance may be among the ``k`` smallest
    (the estimate is off by at most ``miss``), so the result is exact over the probed cells,
    and over all vectors if all cells are probed.  Queries without a vector find nothing.
    A task holds tables for at most about ``max_query_rows`` queries of a cell, 16 KB each.
    """
    spark = index.codes.sparkSession
    centres, book = index.centres, index.codebook
    n_probe = min(n_probe, len(centres))
    asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("_q"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = dense._matrix(batch.column("_q"))
            cells = dense._probe(q, centres, n_probe).astype(np.int32)
            row = np.repeat(np.arange(len(q)), n_probe)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(row)), pa.array(list(q[row]), pa.list_(pa.float64())), pa.array(cells.ravel())],
                names=["query_id", "_q", "cell"],
            )

    probes = asked.mapInArrow(probe, f"query_id {kind}, _q array<double>, cell int")
    load = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # n_cells rows
    wanted = sorted(load)
    codes = index.codes.where(F.col("cell").isin(wanted))  # other folders are not read
    groups = max([1, *(-(-n // max_query_rows) for n in load.values())])
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(wanted) * groups)))

    # a block of a cell's queries meets a split of its rows under one number
    def block(query_part, row_part):
        return ((F.col("cell").cast("long") * groups + query_part) * splits + row_part).alias("_g")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q_rows = probes.withColumn("_b", every(splits)).withColumn("_a", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    v_rows = codes.withColumn("_a", every(groups)).withColumn("_b", F.pmod(F.xxhash64("chunk_id"), F.lit(splits)))
    both = q_rows.select(block(F.col("_a"), F.col("_b")), "cell", "query_id", "_q").unionByName(
        v_rows.select(block(F.col("_a"), F.col("_b")), "cell", "chunk_id", "ord", "code", "miss"), allowMissingColumns=True
    )
    both = both.repartition("_g").sortWithinPartitions("_g", F.col("_q").isNull())
    most = None if refine is None else k * refine
    chunk = index.codes.schema["chunk_id"].dataType.simpleString()
    found = both.mapInArrow(
        lambda batches: _estimate(batches, centres, book, k, most),
        f"query_id {kind}, cell int, chunk_id {chunk}, ord long, low double, high double",
    )
    by_high = W.partitionBy("query_id").orderBy("high", "ord")
    ranked = found.withColumn("_n", F.row_number().over(by_high))
    if most is not None:
        ranked = ranked.where(F.col("_n") <= most)
    else:
        limit = F.max(F.when(F.col("_n") <= k, F.col("high"))).over(W.partitionBy("query_id"))
        ranked = ranked.withColumn("_limit", limit).where(F.col("low") <= F.col("_limit") + SLACK)
    whole = index.vectors.where(F.col("cell").isin(wanted)).select("cell", "chunk_id", "ord", "embedding", *keep)
    # the planner takes candidates for no larger than the codes and would send them all through the driver
    candidates = ranked.select("query_id", "cell", "chunk_id", "ord").hint("merge").join(whole, ["cell", "chunk_id", "ord"]).join(asked, "query_id")
    parts = F.zip_with("embedding", "_q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    exact = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6)
    return dense._ranked(candidates.select("query_id", "chunk_id", "ord", *keep, exact.alias("score")), k)


def _estimate(batches: Iterator[pa.RecordBatch], centres, book, k: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Candidates of every (block of queries, split of a cell): squared bounds or the estimate twice."""
    group, ids, q = None, [], []
    tables = None
    for batch in batches:
        keys = batch.column("_g").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if keys[a] != group:
                group, ids, q, tables = keys[a], [], [], None
            rows = batch.slice(a, b - a)
            n_asked = len(rows) - rows.column("_q").null_count
            if n_asked:
                ids += rows.column("query_id").slice(0, n_asked).to_pylist()
                q.append(dense._matrix(rows.column("_q").slice(0, n_asked)))
                rows = rows.slice(n_asked)
            if not len(rows) or not ids:
                continue
            cell = rows.column("cell")[0].as_py()
            if tables is None:
                rest = (np.concatenate(q) - centres[cell]).reshape(len(ids), len(book), 1, -1)
                tables = [((rest[:, p] - book[p][None]) ** 2).sum(-1) for p in range(len(book))]
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
            order, miss = rows.column("ord").to_numpy(), rows.column("miss").to_numpy()
            for i, query_id in enumerate(ids):
                d = sum(t[i][code[:, p]] for p, t in enumerate(tables))
                if most is not None:
                    low = high = d
                    pick = dense._smallest(d, order, most)
                else:
                    root = np.sqrt(d)
                    low, high = np.maximum(root - miss, 0) ** 2, (root + miss) ** 2
                    limit = np.partition(high, k - 1)[k - 1] if len(high) > k else np.inf
                    pick = np.flatnonzero(low <= limit + SLACK)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([query_id] * len(pick), batch.schema.field("query_id").type),
                        pa.array(np.full(len(pick), cell, np.int32)),
                        rows.column("chunk_id").take(pa.array(pick)),
                        pa.array(order[pick].astype(np.int64)),
                        pa.array(low[pick]),
                        pa.array(high[pick]),
                    ],
                    names=["query_id", "cell", "chunk_id", "ord", "low", "high"],
                )


def _encode(v: np.ndarray, centres: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell = dense._nearest(v, centres)
    rest = (v - centres[cell]).reshape(len(v), len(book), -1)
    code = np.stack([dense._nearest(rest[:, p], book[p]) for p in range(len(book))], axis=1).astype(np.uint8)
    near = np.stack([book[p][code[:, p]] for p in range(len(book))], axis=1)
    return cell, code, np.sqrt(((rest - near) ** 2).sum((1, 2)))


def _train_codes(sample: DataFrame, centres: np.ndarray, parts: int, seed: int) -> DataFrame:
    """Codes of every piece of the sample's residuals: a task a piece, ``sample_rows`` short rows each."""
    if centres.shape[1] % parts:
        raise ValueError(f"{centres.shape[1]} dimensions do not divide into {parts} parts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = np.array(rows["embedding"].tolist(), float)
            rest = (v - centres[dense._nearest(v, centres)]).reshape(len(v), parts, -1)
            for p in range(parts):
                yield pd.DataFrame({"chunk_id": rows["chunk_id"].astype(str), "piece": p, "rest": list(rest[:, p])})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        x = np.array(rows["rest"].tolist(), float)
        rng = np.random.default_rng(seed)
        centre = x[rng.permutation(len(x))[:CODES]]
        for _ in range(10):
            own = np.concatenate([dense._nearest(x[i : i + 8192], centre) for i in range(0, len(x), 8192)])
            n = np.bincount(own, minlength=len(centre))
            total = np.stack([np.bincount(own, x[:, j], len(centre)) for j in range(x.shape[1])], axis=1)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        return pd.DataFrame({"piece": rows["piece"].iloc[0], "code": np.arange(len(centre)), "centre": list(centre)})

    pieces = sample.mapInPandas(cut, "chunk_id string, piece int, rest array<double>")
    return pieces.groupBy("piece").applyInPandas(fit, "piece int, code int, centre array<double>")


def _codebook(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/codebook").orderBy("piece", "code").collect()  # parts * 256 rows
    parts = rows[-1]["piece"] + 1
    flat = np.array([r["centre"] for r in rows])
    return flat.reshape(parts, len(rows) // parts, -1)
