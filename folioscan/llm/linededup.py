"""Incremental, reversible line dedup: cuckoo filters over exact reference tables.

State of a corpus, sharded by line key:

* ``pairs``   (shard, key, doc_id, n): which document holds which line key;
* ``counts``  (shard, key, refs, min_doc, max_doc): exact references of a key;
* ``filters`` (shard, n_buckets, table): a cuckoo filter that holds a key once if
  one document has it and twice if several have it.

``insert`` and ``delete`` change the three by the documents given; keys that no
document holds any more leave the filter, so a deletion undoes an insertion.
``repeated`` asks the filters for lines that may be shared, which nearly all lines
are not, and only those go to the exact table.

A line's key is the line without blanks, tabs, line breaks, vertical tabs and form
feeds at both ends, A-Z in lower case; keys of ``min_chars`` code points or more
count, and a key held by two documents or more stays only in the smallest doc_id.

Defined results: null text is one empty line; rows with equal doc_id are one
document; rows without doc_id are one document that comes last; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioscan.llm import common

NO_DOC = (1 << 63) - 1
BLANK = b" \t\n\x0b\x0c\r"
SALTS = 16
SLOTS = 4
KEYS_PER_SHARD = 100_000


# -- line keys -----------------------------------------------------------------


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"),
        F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"),
    )


def line_pairs(docs: DataFrame, shards: int, min_chars: int = 10) -> DataFrame:
    """(shard, key, doc_id, n): every key of every document once per row."""
    common.bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {line_key(line, min_chars) for line in text.as_py().split(b"\n")}
                own.discard(None)
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "key": keys}, schema=schema)

    found = _ids(docs).mapInArrow(read, "doc_id long, key binary")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    return found.select(shard, "key", "doc_id", F.lit(1).cast("long").alias("n"))


# -- cuckoo filter -------------------------------------------------------------


def _fingerprints(keys: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    fp = (raw[:, 0] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return fp, (raw[:, 1] & np.uint64(n_buckets - 1)).astype(np.int64)


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; works on arrays of 16-byte keys."""

    def __init__(self, n_buckets: int, table: bytes | None = None):
        self.n_buckets = n_buckets
        shape = (n_buckets, SLOTS)
        self.table = np.zeros(shape, np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(shape).copy()

    @staticmethod
    def buckets_for(n: int) -> int:
        return 1 << max(3, int(n / (SLOTS * 0.8)).bit_length())

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return (bucket ^ common.mix64(fp.astype(np.uint64)).astype(np.int64)) & (self.n_buckets - 1)

    def insert(self, keys: list[bytes]) -> bool:
        """Add keys (with repeats); False if the table got too full, then it must be built anew."""
        if not keys:
            return True
        fp, bucket = _fingerprints(keys, self.n_buckets)
        rng, tries = np.random.default_rng(len(keys)), 0
        while len(fp):
            order = np.argsort(bucket, kind="stable")
            fp, bucket = fp[order], bucket[order]
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            rank = np.arange(len(fp)) - np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
            self.table[bucket[fits], slot[fits]] = fp[fits]
            fp, bucket, first = fp[~fits], bucket[~fits], new[~fits]
            tries += 1
            if tries > 500:
                return False
            if tries > 1 and len(fp):  # one kick per bucket and round; the others go to their second bucket
                kick = np.concatenate([[True], bucket[1:] != bucket[:-1]]) | first
                kick &= np.concatenate([[True], bucket[1:] != bucket[:-1]])
                slots = rng.integers(0, SLOTS, int(kick.sum()))
                out = self.table[bucket[kick], slots].copy()
                self.table[bucket[kick], slots] = fp[kick]
                fp[kick] = out
            bucket = self._other(bucket, fp)
        return True

    def count(self, keys: list[bytes]) -> np.ndarray:
        """How often the fingerprints of keys are held; never less than the truth."""
        if not keys:
            return np.zeros(0, np.int64)
        fp, bucket = _fingerprints(keys, self.n_buckets)
        other = self._other(bucket, fp)
        n = (self.table[bucket] == fp[:, None]).sum(1)
        return n + np.where(other != bucket, (self.table[other] == fp[:, None]).sum(1), 0)

    def remove(self, keys: list[bytes]) -> None:
        """Take out one copy of each key; all of them must be held."""
        if not keys:
            return
        fp, bucket = _fingerprints(keys, self.n_buckets)
        for f, a, b in zip(fp, bucket, self._other(bucket, fp)):
            for at in (a, b):
                slot = np.flatnonzero(self.table[at] == f)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break
            else:
                raise KeyError("the filter does not hold this key")


# -- state ---------------------------------------------------------------------


@dataclass(frozen=True)
class LineState:
    pairs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int


FILTER = "shard int, n_buckets int, table binary"


def _keys(column) -> list[bytes]:
    return [bytes(k) for k in column]


def _build_filter(shard: int, counts: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(counts["key"])
    keys += [k for k, several in zip(keys, counts["several"]) if several]
    n_buckets = CuckooFilter.buckets_for(len(keys))
    while True:
        built = CuckooFilter(n_buckets)
        if built.insert(keys):
            return pd.DataFrame({"shard": [shard], "n_buckets": [n_buckets], "table": [built.table.tobytes()]})
        n_buckets *= 2


def _counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("shard", "key").agg(
        F.sum("n").alias("refs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc")
    )


def _several(counts: DataFrame) -> DataFrame:
    return counts.select("shard", "key", (F.col("min_doc") != F.col("max_doc")).alias("several"))


def create(docs: DataFrame, min_chars: int = 10, shards: int | None = None) -> LineState:
    """State of a first set of documents."""
    if shards is None:
        shards = common.parts_for(docs, common.text_bytes(), 32 << 20)
    pairs = common.stored(line_pairs(docs, shards, min_chars), "line-pairs")
    counts = common.stored(_counts(pairs), "line-counts")
    filters = (
        _several(counts)
        .groupBy("shard")
        .applyInPandas(lambda key, rows: _build_filter(int(key[0]), rows), FILTER)
    )
    return LineState(pairs, counts, common.stored(filters, "line-filters"), shards, min_chars)


def _update_filters(state: LineState, counts: DataFrame, touched: DataFrame) -> DataFrame:
    """Filters after the keys of ``touched`` went from their old to their new counts."""
    held = lambda c: F.when(F.col(c).isNull(), 0).when(F.col(c), 2).otherwise(1)
    before = _several(state.counts).withColumnRenamed("several", "old")
    after = _several(counts).withColumnRenamed("several", "new")
    change = (
        touched.select("shard", "key")
        .distinct()
        .join(before, ["shard", "key"], "left")
        .join(after, ["shard", "key"], "left")
        .select("shard", "key", (held("new") - held("old")).alias("by"))
        .where("by <> 0")
    )

    def update(key, changes: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if len(filters):
            cuckoo = CuckooFilter(int(filters["n_buckets"][0]), bytes(filters["table"][0]))
        else:
            cuckoo = CuckooFilter(8)
        names, by = _keys(changes["key"]), changes["by"].to_numpy()
        cuckoo.remove([k for k, n in zip(names, by) for _ in range(-n)])
        done = cuckoo.insert([k for k, n in zip(names, by) for _ in range(n)])
        return pd.DataFrame(
            {"shard": [key[0]], "n_buckets": [cuckoo.n_buckets if done else 0], "table": [cuckoo.table.tobytes()]}
        )

    updated = common.stored(
        change.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInPandas(update, FILTER), "line-filters"
    )
    full = updated.where("n_buckets = 0").select("shard")  # outgrown filters are built anew from the exact table
    rebuilt = (
        _several(counts)
        .join(full, "shard", "left_semi")
        .groupBy("shard")
        .applyInPandas(lambda key, rows: _build_filter(int(key[0]), rows), FILTER)
    )
    return common.stored(updated.where("n_buckets > 0").unionByName(rebuilt), "line-filters")


def _change(state: LineState, pairs: DataFrame, touched: DataFrame) -> LineState:
    pairs = common.stored(pairs, "line-pairs")
    keys = common.stored(touched.select("shard", "key").distinct(), "line-touched")
    same = state.counts.join(keys, ["shard", "key"], "left_anti")
    fresh = _counts(pairs.join(keys, ["shard", "key"], "left_semi"))
    counts = common.stored(same.unionByName(fresh), "line-counts")
    return LineState(pairs, counts, _update_filters(state, counts, keys), state.shards, state.min_chars)


def insert(state: LineState, docs: DataFrame) -> LineState:
    """State with further documents (their ids must be new)."""
    new = common.stored(line_pairs(docs, state.shards, state.min_chars), "line-pairs")
    return _change(state, state.pairs.unionByName(new), new)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """State without the documents of ``doc_ids(doc_id)``."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id")).distinct()
    return _change(
        state, state.pairs.join(gone, "doc_id", "left_anti"), state.pairs.join(gone, "doc_id", "left_semi")
    )


def repeated(state: LineState) -> DataFrame:
    """(doc_id, key): lines that a document loses because a smaller doc_id holds them.

    A shard's pairs are read in ``SALTS`` parts, each beside the shard's filter;
    a line that very many documents hold is spread over all of them, there and in
    the join with the exact table.
    """
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = state.pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    filters = state.filters.withColumn("salt", F.explode(salts))

    def ask(pairs: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(filters):
            return pairs[["key", "doc_id", "salt"]][:0]
        cuckoo = CuckooFilter(int(filters["n_buckets"][0]), bytes(filters["table"][0]))
        return pairs[["key", "doc_id", "salt"]][cuckoo.count(_keys(pairs["key"])) >= 2]

    maybe = (
        salted.groupBy("shard", "salt")
        .cogroup(filters.groupBy("shard", "salt"))
        .applyInPandas(ask, "key binary, doc_id long, salt int")
    )
    shared = state.counts.where("min_doc <> max_doc").select("key", "min_doc", F.explode(salts).alias("salt"))
    return maybe.join(shared, ["key", "salt"]).where("doc_id <> min_doc").select("doc_id", "key")


def rewritten(docs: DataFrame, lost: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the lines that stay: doc_id, n_lines, n_dropped, kept (the text)."""
    common.bounded_batches(docs.sparkSession)
    per_doc = lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]
    )

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            for doc_id, text, lost in zip(*batch.columns):
                lines = text.as_py().split(b"\n")
                gone = set(lost.as_py() or ())
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                doc = doc_id.as_py()
                out.append((None if doc == NO_DOC else doc, len(lines), len(lines) - len(kept), b"\n".join(kept)))
            if out:
                cols = list(zip(*out))
                cols[3] = pa.array(cols[3], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema
                )

    return (
        _ids(docs)
        .join(per_doc, "doc_id", "left")
        .select("doc_id", "text", "lost")
        .mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One pass over ``docs(doc_id, text)``: the texts without lines that a smaller doc_id holds."""
    state = create(docs, min_chars)
    return rewritten(docs, repeated(state), min_chars)


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
