"""Dense retrieval: exact and cell-probed top-k over unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscan.functions.text import col

FILTERS = ("f_year", "f_program", "f_author")
FILTERED = ("year", "program", "author")


def similarity(distance: Column | str) -> Column:
    """1 / (1 + max(distance, 0))."""
    return 1.0 / (1.0 + F.greatest(col(distance), F.lit(0.0)))


def unit_vector(v: Column | str) -> Column:
    """L2-normalise an array column; a zero vector stays as it is."""
    v = col(v)
    norm = F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int,
    max_query_rows: int = 20_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Exact top ``k`` by squared L2 distance, smaller first, ties by ``ord``.

    ``vectors(chunk_id, ord, embedding[, year, program, author, doc_id])`` and
    ``queries(query_id, embedding[, f_year, f_program, f_author, f_doc])`` meet as rows
    in tasks: queries in groups of about ``max_query_rows``, each of them once with
    every vector.  No query passes the driver, and each task keeps the best ``k`` per
    query over all its batches, so the last shuffle carries ``k`` rows per query and
    task.  Filters are applied before the search.  With ``f_doc`` a query only meets the
    vectors of that document, found by an equi-key (a query without one finds nothing).
    """
    return _ranked(_search(vectors, queries, k, keep, None, 0, max_query_rows), k)


def train_cells(vectors: DataFrame, *, n_cells: int, sample: float = 1.0, seed: int = 7):
    """Cell centres for :func:`dense_topk_cells`: k-means on a sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    train = vectors.select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    if sample < 1.0:
        train = train.sample(sample, seed=seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(train)
    return np.asarray(model.clusterCenters())


def dense_topk_cells(
    vectors: DataFrame,
    queries: DataFrame,
    centres: np.ndarray,
    *,
    k: int,
    n_probe: int,
    max_query_rows: int = 20_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Approximate top ``k`` (opt-in): a query only meets its nearest cells.

    The scan is the one of :func:`dense_topk`; the cell of a vector is found
    inside the task, so a cell with a third of all vectors is never gathered.
    """
    return _ranked(_search(vectors, queries, k, keep, centres, n_probe, max_query_rows), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("score", "ord")
    return (
        hits.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("score_dense", F.col("score"))
    )


def _meet(vectors: DataFrame, queries: DataFrame, max_query_rows: int) -> DataFrame:
    """Queries and vectors in one table, sorted by (``_a``, ``_b``) with the queries first.

    With ``f_doc`` a pair of keys is a document and a split of its vectors, else a group
    of queries and a split of all vectors.  Queries are repeated for every split.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    split = lambda n: F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if "f_doc" in queries.columns:
        # a document of a third of all vectors is spread over all cores
        q = queries.where("f_doc IS NOT NULL").withColumn("_a", F.col("f_doc").cast("string")).withColumn("_b", every(cores))
        wanted = q.select("_a").distinct()
        v = vectors.withColumn("_a", F.col("doc_id").cast("string")).join(wanted, "_a", "left_semi").withColumn("_b", split(cores))
        parts = None
    else:
        groups = max(1, -(-queries.count() // max_query_rows))
        splits = max(1, -(-2 * cores // groups))
        group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("string")
        q = queries.withColumn("_a", group).withColumn("_b", every(splits))
        v = vectors.withColumn("_a", every(groups)).withColumn("_a", F.col("_a").cast("string")).withColumn("_b", split(splits))
        parts = groups * splits
    both = q.withColumnRenamed("embedding", "_q").unionByName(v, allowMissingColumns=True)
    both = both.repartitionByRange(parts, "_a", "_b") if parts else both.repartition("_a", "_b")
    return both.sortWithinPartitions("_a", "_b", F.col("_q").isNull())


class _Best:
    """The best rows of one query: distances, orders and an Arrow table of what is kept."""

    def __init__(self):
        self.d, self.order, self.rows = np.empty(0), np.empty(0, np.int64), None

    def add(self, d: np.ndarray, order: np.ndarray, rows: pa.Table, k: int) -> None:
        if self.rows is not None:
            d, order = np.concatenate([self.d, d]), np.concatenate([self.order, order])
            rows = pa.concat_tables([self.rows, rows])
        pick = _smallest(d, order, k)
        self.d, self.order, self.rows = d[pick], order[pick], rows.take(pick)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(lists), -1)


def _search(vectors, queries, k, keep, centres, n_probe, max_query_rows) -> DataFrame:
    filters = [c for c in FILTERS if c in queries.columns]
    meta = [m for f, m in zip(FILTERS, FILTERED, strict=True) if f in filters]
    doc = ["f_doc"] if "f_doc" in queries.columns else []
    cols = list(dict.fromkeys(["chunk_id", "ord", "embedding", *meta, *keep, *(["doc_id"] if doc else [])]))
    fields = [
        queries.schema["query_id"],
        *[vectors.schema[c] for c in ("chunk_id", "ord", *keep)],
        T.StructField("score", T.DoubleType()),
    ]
    fields = [T.StructField(f.name, f.dataType, True) for f in fields]
    out_schema = to_arrow_schema(T.StructType(fields))

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            at = list(zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist()))
            first = 0
            for i in range(1, len(at) + 1):
                if i == len(at) or at[i] != at[first]:
                    yield at[first], pa.Table.from_batches([batch.slice(first, i - first)])
                    first = i

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, state = None, [], None

        def ready() -> tuple:
            q = pa.concat_tables(asked)
            signatures: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[q.column(f).to_pylist() for f in filters]) if filters else [()] * len(q)):
                signatures.setdefault(key, []).append(i)
            matrix = _matrix(q.column("_q"))
            probes = _probe(matrix, centres, n_probe) if centres is not None else None
            return q.column("query_id"), matrix, signatures, probes, [_Best() for _ in range(len(q))]

        def result() -> Iterator[pa.RecordBatch]:
            if state is None:
                return
            ids, best = state[0], state[4]
            for i, b in enumerate(best):
                if b.rows is not None and len(b.rows):
                    n = len(b.rows)
                    columns = [pa.array([ids[i].as_py()] * n, out_schema.field(0).type)]
                    columns += [b.rows.column(c).combine_chunks() for c in ("chunk_id", "ord", *keep)] + [pa.array(b.d)]
                    columns = [c.cast(f.type) for c, f in zip(columns, out_schema)]
                    yield from pa.Table.from_arrays(columns, schema=out_schema).to_batches()

        for key, rows in groups_of(batches):
            if key != at:
                yield from result()
                at, asked, state = key, [], None
            is_query = pc.is_valid(rows.column("_q"))
            some = rows.filter(is_query)
            if len(some):
                asked.append(some)
            batch = rows.filter(pc.invert(is_query))
            if not len(batch) or not asked:
                continue
            if state is None:
                state = ready()
            _, q, signatures, probes, best = state
            v = _matrix(batch.column("embedding"))
            vv = np.einsum("ij,ij->i", v, v)
            cell = _nearest(v, centres) if centres is not None else None
            orders = batch.column("ord").to_numpy()
            kept = batch.select(list(dict.fromkeys(["chunk_id", "ord", *keep])))
            frame = batch.select(meta).to_pandas() if meta else pd.DataFrame(index=range(len(batch)))
            for signature, members in signatures.items():
                pool = np.flatnonzero(_mask(frame, meta, signature))
                if not len(pool):
                    continue
                qm = q[members]
                d = (qm * qm).sum(1)[:, None] + vv[pool][None, :] - 2.0 * (qm @ v[pool].T)
                d = np.round(np.maximum(d, 0.0), 6)
                for j, i in enumerate(members):
                    ok = np.ones(len(pool), bool) if probes is None else np.isin(cell[pool], probes[i])
                    if len(best[i].d) == k:
                        ok &= d[j] <= best[i].d[-1]
                    own = np.flatnonzero(ok)
                    own = own[_smallest(d[j][own], orders[pool[own]], k)]
                    if len(own):
                        best[i].add(d[j][own], orders[pool[own]], kept.take(pool[own]), k)
        yield from result()

    both = _meet(vectors.select(*cols), queries.select("query_id", "embedding", *filters, *doc), max_query_rows)
    return both.mapInArrow(search, T.StructType(fields))


def _mask(batch: pd.DataFrame, meta: list[str], signature: tuple) -> np.ndarray:
    mask = np.ones(len(batch), dtype=bool)
    for name, wanted in zip(meta, signature, strict=True):
        if wanted is None:
            continue
        if name == "year":
            mask &= (batch[name] == wanted).fillna(False).to_numpy(dtype=bool)
        else:
            mask &= (
                batch[name].fillna("").str.contains(wanted, regex=False).to_numpy(dtype=bool)
            )
    return mask


def _smallest(d: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances, ties by order (exact)."""
    if len(d) > k:
        cut = np.partition(d, k - 1)[k - 1]
        keep = np.flatnonzero(d <= cut)
    else:
        keep = np.arange(len(d))
    return keep[np.lexsort((order[keep], d[keep]))[:k]]


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2.0 * (v @ centres.T)
    return d.argmin(1)


def _probe(q: np.ndarray, centres: np.ndarray, n_probe: int) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2.0 * (q @ centres.T)
    return np.argsort(d, axis=1, kind="stable")[:, :n_probe]
