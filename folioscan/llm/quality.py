"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are counts of byte classes, words and lines.  Trees are
grown on a sample of at most ``sample_rows`` labelled documents (those with the
smallest hash of their id, so any rerun takes the same ones); features are cut
into quantile bins and splits are searched over gradient histograms.  The model is
a few arrays, and all trees are walked for all rows of a batch at once.

Every document is scored by its whole text.  Rows whose crc32 of the id is
divisible by ``FOLDS`` are held out and never give labels.

Defined results: null text counts as empty text, which has statistics like any
other; rows without doc_id are scored and not held out; labels without value or
without document are not used, and the mean of repeated labels counts; without
labels every score is 0.5; an empty table gives no rows; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folioscan.llm import common

FOLDS = 5
SAMPLE_ROWS = 20_000
KEEP_FROM = 0.3


# -- statistics ----------------------------------------------------------------

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": (9, 11, 12, 13, 32),
    "exclaim": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>\\_{}[]",
    "stop": b".,;:?",
    "quote": b"\"'()-/`",
    "control": (*range(9), *range(14, 32), 127),
    "high_first": range(192, 256),
    "high_capital": range(128, 159),
}
_MEMBER = np.zeros((256, len(_CLASSES)), np.float64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1.0

FEATURES = (
    *(f"{k}_share" for k in _CLASSES),
    "bytes",
    "words",
    "lines",
    "capitals",
    "exclaim_per_word",
    "bar_per_word",
    "symbol_per_word",
    "stop_per_word",
    "word_bytes",
    "distinct_words",
    "commonest_word",
    "repeated_pairs",
    "line_bytes",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if n == 0:
        return out
    words, first = common.word_hashes(texts)
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    counts = np.zeros((n, 256))
    repeats = np.zeros((n, 3))
    for i in range(n):
        counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        own = words[first[i] : first[i + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            repeats[i, :2] = len(times) / len(own), times.max() / len(own)
            if len(own) > 1:
                pairs = np.sort(common.mix64(own[:-1] * common.BASE + own[1:]))
                repeats[i, 2] = (pairs[1:] == pairs[:-1]).sum() / len(pairs)
    classes = counts @ _MEMBER
    size, n_words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    lines = counts[:, 10] + 1
    per = lambda a, b: a / np.maximum(b, 1)
    k = {name: i for i, name in enumerate(_CLASSES)}
    m = len(_CLASSES)
    out[:, :m] = per(classes, size[:, None])
    capitals = classes[:, k["upper"]] + classes[:, k["high_capital"]]
    letters = classes[:, k["upper"]] + classes[:, k["lower"]] + classes[:, k["high_first"]]
    out[:, m:] = np.column_stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            np.log1p(lines),
            per(capitals, letters),
            *(per(classes[:, k[c]], n_words) for c in ("exclaim", "bar", "symbol", "stop")),
            per(letters, n_words),
            repeats,
            per(size, lines),
        ]
    )
    return out


# -- trees ---------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """All trees as complete binary trees in arrays: (tree, node) and (tree, leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        out = np.full(len(x), self.base)
        if self.feature.shape[0]:
            tree, row = np.arange(self.feature.shape[0])[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), self.feature.shape[0]), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
            out += self.leaf[tree, at - self.feature.shape[1]].sum(1)
        return 1.0 / (1.0 + np.exp(-out))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0
) -> Trees:
    """Boosted trees for log loss, grown level by level over histograms of the bins."""
    n_nodes, n_leaves = 2**depth - 1, 2**depth
    empty = np.zeros((0, n_nodes), np.int64), np.zeros((0, n_nodes)), np.zeros((0, n_leaves))
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(mean, 1e-3, 1 - 1e-3) / (1 - np.clip(mean, 1e-3, 1 - 1e-3))))
    if len(np.unique(y)) < 2:
        return Trees(*empty, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    n_features = x.shape[1]
    raw = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            local = at - start
            best = np.full(width, 1e-6)
            chosen, chosen_bin = np.zeros(width, np.int64), np.full(width, bins)
            for f in range(n_features):
                key = local * bins + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), 1)
                hs = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), 1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < 0.5) | (ha - hs < 0.5)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], chosen[better], chosen_bin[better] = top[better], f, k[better]
            for node in range(width):
                if chosen_bin[node] < len(edges[chosen[node]]):
                    feature[start + node], cut[start + node] = chosen[node], edges[chosen[node]][chosen_bin[node]]
            at = 2 * at + 1 + (binned[np.arange(len(y)), chosen[local]] > chosen_bin[local])
        own = at - n_nodes
        leaf = rate * np.bincount(own, g, n_leaves) / (np.bincount(own, h, n_leaves) + ridge)
        raw += leaf[own]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), base)


# -- over tables ---------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample, in order of doc_id.

    The sampled ids (at most ``sample_rows``) are broadcast, so no text is shuffled.
    """
    common.bounded_batches(docs.sparkSession)
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), schema.types[2])], schema=schema)

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(read, "doc_id long, label int, x array<double>")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.min("x").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]) if rows else np.zeros((0, len(FEATURES)))
    return x, np.array([r["label"] for r in rows], float)


def score_documents(docs: DataFrame, model: Trees, *keep: str) -> DataFrame:
    """``keep`` columns, doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            score = shared.value.score(statistics(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(read, f"{fields}, score double").withColumn(
        "predicted", (F.col("score") >= KEEP_FROM).cast("int")
    )


def classified(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Scores of ``docs(doc_id, text)`` by a model of ``labels(doc_id, quality)``."""
    return score_documents(docs, fit(*training_rows(docs, labels, sample_rows)))


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; all columns stay."""
    model = fit(*training_rows(docs, labels, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(statistics(pa.Array.from_pandas(texts, type=pa.string()))))

    return docs.where(score(F.col("text")) >= KEEP_FROM)

