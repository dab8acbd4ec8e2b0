"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Every window of a document with as many words as a benchmark item has a 64-bit
SimHash of its five-word runs, weighted by their rarity among the items.  The
items' fingerprints are indexed by their eight bytes.  Two fingerprints within
``radius`` of each other agree in some byte up to ``radius // 8`` bits, so looking
up every byte's neighbours finds all items within the radius.  Candidates are then
compared exactly: weighted Jaccard similarity of the runs, counted with repeats.

A window that shares no run with an item has similarity 0 to it, so windows are
fingerprinted only where the document has a run of an item; that loses nothing.
Equal texts are one entry with the list of its item ids.  Documents are read once for
each block of ``block_items`` entries.  Weights come from the whole benchmark: the runs
that several items share are counted once and broadcast (16 bytes each) beside every
block, so blocks don't change the result.  No text of a document is shuffled, and each document is worked on alone, so
there is no hot key.

Defined results: null and empty texts contain nothing; items without words match
nothing; items of fewer than five words are one run of all their words; a document
shorter than an item is one window; ties between windows go to the first; equal
documents give equal results, and repeated items one; empty tables give no rows; further columns are not looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscan.llm import common

SHINGLE = 5
BITS, BLOCKS = 64, 8
FOUND = "doc_id long, item_id long, start long, n_words long, distance int, similarity double"
_BIT = np.arange(BITS, dtype=np.uint64)


def simhash(runs: np.ndarray, weights: np.ndarray) -> np.uint64:
    bits = ((runs[:, None] >> _BIT) & np.uint64(1)).astype(np.float64)
    on = (weights[:, None] * (2 * bits - 1)).sum(0) > 1e-9
    return np.bitwise_or.reduce(np.where(on, np.uint64(1) << _BIT, np.uint64(0)))


def neighbours(radius: int) -> np.ndarray:
    """Bytes that differ from 0 in at most ``radius`` bits."""
    return np.array([x for x in range(256) if x.bit_count() <= radius], np.uint8)


class HammingIndex:
    """Multi-index over the bytes of fingerprints: all items within a radius, no others.

    An item stands under every byte that differs from its own in at most
    ``radius // 8`` bits.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        masks = neighbours(radius // BLOCKS).astype(np.int64)
        self.tables = []
        for block in range(BLOCKS):
            keys = (self._byte(prints, block)[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange(257))
            self.tables.append(((order // len(masks)).astype(np.int32), starts))

    @staticmethod
    def _byte(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``prints``, item, distance) of all items within the radius."""
        found = []
        for block, (items, starts) in enumerate(self.tables):
            key = self._byte(prints, block)
            n = starts[key + 1] - starts[key]
            at = np.repeat(np.arange(len(prints)), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[key], n)
            item = items[place]
            near = np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius
            found.append(at[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        at, item = np.divmod(pairs, max(1, len(self.prints)))
        return at, item, np.bitwise_count(prints[at] ^ self.prints[item])


class Items:
    """A block of benchmark items, ready for lookups.

    ``shared`` has the rising runs that several items of the whole benchmark hold, how
    many do, and the number of all items; without it the block is the benchmark.
    """

    def __init__(self, ids: list[int], texts: list[str], radius: int, shared: tuple | None = None):
        words, first = common.word_hashes(pa.array(texts, pa.string()))
        self.ids, self.words = [], []
        for k, item_id in enumerate(ids):
            if first[k] < first[k + 1]:
                self.ids.append(item_id)
                self.words.append(words[first[k] : first[k + 1]])
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.runs = [common.shingles(w, SHINGLE) for w in self.words]
        if shared is None:
            every = np.concatenate([np.unique(r) for r in self.runs]) if self.runs else np.empty(0, np.uint64)
            shared = *np.unique(every, return_counts=True), len(self.runs)
        self.known, n, n_items = shared
        self.most = 1.0 + np.log(max(1, n_items))
        self.rarity = 1.0 + np.log(max(1, n_items) / np.maximum(n, 1))
        owner = np.concatenate([np.full(len(r), i) for i, r in enumerate(self.runs)]) if self.runs else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(r)) for r in self.runs]) if self.runs else np.empty(0, np.int64)
        flat = np.concatenate(self.runs) if self.runs else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.place = flat[order], owner[order], place[order]
        self.sizes = np.array([min(SHINGLE, n) for n in self.lengths], np.int64)
        prints = np.array([simhash(r, self.weight(r)) for r in self.runs], np.uint64)
        self.index = HammingIndex(prints, radius)

    def weight(self, runs: np.ndarray) -> np.ndarray:
        """Rarity among all items; runs of one item or none weigh most."""
        if not len(self.known):
            return np.full(len(runs), self.most)
        at = np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)
        return np.where(self.known[at] == runs, self.rarity[at], self.most)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two lists of runs, repeats counted."""
        runs, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        x = np.bincount(back[: len(a)], minlength=len(runs))
        y = np.bincount(back[len(a) :], minlength=len(runs))
        w = self.weight(runs)
        return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())

    def starts(self, runs: np.ndarray, size: int) -> dict[int, np.ndarray]:
        """For each length of items made of runs of ``size`` words: where windows that share a run begin.

        A run at place p of the document and q of the item puts the window at
        p - q; words put in or taken out before it move that, so all windows that
        hold the run count.
        """
        lo = np.searchsorted(self.flat, runs, "left")
        n = np.searchsorted(self.flat, runs, "right") - lo
        at = np.flatnonzero(n)
        if not len(at):
            return {}
        p = np.repeat(at, n[at])
        k = np.concatenate([np.arange(lo[i], lo[i] + n[i]) for i in at])
        fits = self.sizes[self.owner[k]] == size
        p, length = p[fits], self.lengths[self.owner[k[fits]]]
        return {int(m): np.unique(p[length == m]) for m in np.unique(length)}


def _windows(places: np.ndarray, span: int, n_runs: int) -> np.ndarray:
    """Begins of all windows of ``span`` runs that hold one of ``places``."""
    last = max(0, n_runs - span)
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, np.minimum(np.maximum(places - span + 1, 0), last), 1)
    np.add.at(edge, np.minimum(places, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def window_prints(runs: np.ndarray, weights: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each window of runs, by running sums over the stretches that windows cover."""
    out = np.empty(len(begins), np.uint64)
    cuts = np.flatnonzero(begins[1:] > np.maximum.accumulate(ends)[:-1]) + 1
    for group in np.split(np.arange(len(begins)), cuts):
        lo, hi = int(begins[group[0]]), int(ends[group].max())
        bits = ((runs[lo:hi, None] >> _BIT) & np.uint64(1)).astype(np.float64)
        sums = np.zeros((hi - lo + 1, BITS))
        np.cumsum((2.0 * bits - 1.0) * weights[lo:hi, None], axis=0, out=sums[1:])
        on = sums[ends[group] - lo] - sums[begins[group] - lo] > 1e-9
        out[group] = np.bitwise_or.reduce(np.where(on, np.uint64(1) << _BIT, np.uint64(0)), axis=1)
    return out


def contained(items: Items, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(item, start, words of the window, distance, similarity): the best window of each item found."""
    best: dict[int, tuple] = {}
    for size in np.unique(items.sizes):
        if len(words) < size:
            continue
        runs = common.shingles(words, int(size))
        for length, places in items.starts(runs, int(size)).items():
            span = max(1, length - int(size) + 1)
            begins = _windows(places, span, len(runs))
            weights = items.weight(runs)
            for at in range(0, len(begins), 1024):
                part = begins[at : at + 1024]
                ends = np.minimum(part + span, len(runs))
                prints = window_prints(runs, weights, part, ends)
                for w, item, distance in zip(*items.index.within(prints)):
                    if items.lengths[item] != length:
                        continue
                    start, end = int(part[w]), int(ends[w])
                    found = items.similarity(runs[start:end], items.runs[item])
                    if found >= threshold and found > best.get(item, (0,) * 5)[4]:
                        n = min(length, len(words) - start)
                        best[item] = (int(items.ids[item]), start, n, int(distance), found)
    return [best[k] for k in sorted(best)]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 23, block_items: int = 20_000
) -> DataFrame:
    """Items found in ``docs(doc_id, text)``: one row per document and item, its best window.

    The radius of 23 of 64 bits lies five standard deviations above the mean
    distance of windows at the threshold.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    entries = common.stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .groupBy("text")
        .agg(F.collect_list(F.struct("item_id")).alias("ids")),
        "benchmark-texts",
    )
    table = spark.sparkContext.broadcast(_shared_runs(entries))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    left = entries.toLocalIterator()
    while own := list(islice(left, block_items)):
        block = spark.sparkContext.broadcast(([[x[0] for x in r["ids"]] for r in own], [r["text"] for r in own]))
        found = rows.mapInArrow(_finder(block, table, threshold, radius), FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def _shared_runs(entries: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Rising runs that two or more items of ``entries(text, ids)`` hold, how many do, and the number of items with words.

    Any other run weighs as much as one of no item, so it need not be told.
    """
    schema = pa.schema([("run", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = common.word_hashes(batch.column(0))
            for k, n in enumerate(batch.column(1).to_pylist()):
                if first[k] < first[k + 1]:
                    runs = np.unique(common.shingles(words[first[k] : first[k + 1]], SHINGLE)).view(np.int64)
                    runs = pa.concat_arrays([pa.array(runs), pa.nulls(1, pa.int64())])  # null counts the items
                    yield pa.RecordBatch.from_arrays([runs, pa.array(np.full(len(runs), n), pa.int64())], schema=schema)

    counted = entries.select("text", F.size("ids").cast("long").alias("n")).mapInArrow(count, "run long, n long")
    totals = counted.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("run").isNull() | (F.col("n") > 1)).toArrow()
    run, n = totals.column("run").combine_chunks(), np.asarray(totals.column("n"))
    null = np.asarray(run.is_null())
    runs, n_items = np.asarray(run.fill_null(0)).view(np.uint64)[~null], int(n[null].sum())
    order = np.argsort(runs)
    return runs[order], n[~null][order], n_items


_CACHE: dict = {}


def _items(block, table, radius: int) -> Items:
    """The block of a broadcast, indexed once per Python worker."""
    key = (id(block.value), radius)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = (block.value, Items([*range(len(block.value[1]))], block.value[1], radius, table.value))
    return _CACHE[key][1]


def _finder(block, table, threshold: float, radius: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("item_id", pa.int64()),
            ("start", pa.int64()),
            ("n_words", pa.int64()),
            ("distance", pa.int32()),
            ("similarity", pa.float64()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in batches:
            items = items or _items(block, table, radius)
            if not items.ids:
                return
            words, first = common.word_hashes(batch.column(1))
            likely = _likely(items, words, first)
            rows = []
            for k in likely:
                own = contained(items, words[first[k] : first[k + 1]], threshold)
                doc_id = batch.column(0)[k].as_py()
                rows.extend((doc_id, item_id, *x[1:]) for x in own for item_id in block.value[0][x[0]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return find


def _likely(items: Items, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents that hold a run of some item (runs that cross documents do no harm)."""
    hit = np.zeros(len(words), bool)
    for size in np.unique(items.sizes):
        if len(words) >= size:
            known = items.flat[items.sizes[items.owner] == size]
            runs = common.shingles(words, int(size))
            at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            hit[: len(runs)] |= known[at] == runs
    return np.unique(np.searchsorted(first, np.flatnonzero(hit), "right") - 1)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; all columns stay.

    Rows are told apart by (doc_id, hash of the text).
    """
    none = F.lit(-(1 << 63))
    marked = docs.select(
        F.struct("*").alias("_row"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), none), F.coalesce(F.col("text"), F.lit(""))).alias("_h"),
    )
    keyed = marked.select(F.col("_h").alias("doc_id"), F.col("_row.text").alias("text"))
    found = contaminated(keyed, benchmark, threshold).select(F.col("doc_id").alias("_h")).distinct()
    return marked.join(found, "_h", "left_anti").select("_row.*")
