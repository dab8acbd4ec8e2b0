"""What the operators of this subpackage share: shared folders, stored stages, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound Arrow batches by bytes as well as rows, since single texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``.  Only a local session without that
    setting (tests) gets a temporary folder; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        root = tempfile.mkdtemp(prefix="folioscan-llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts_of(spark: SparkSession, rows: int, part_rows: int) -> int:
    """Tasks for so many rows, one per core at least."""
    return int(max(spark.sparkContext.defaultParallelism, -(-rows // part_rows)))


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back.

    Lost executors then cost no more than the tasks they ran.  ``parts`` bounds
    the tasks of a stage that is known to be small.
    """
    path = shared_folder(df.sparkSession, name)
    if parts is not None:
        df = df.coalesce(parts)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored stages of one operator, which it drops when its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def stored(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        out = stored(df, f"{self.name}-{name}", parts)
        self.paths += [f.rpartition("/")[0] for f in out.inputFiles()[:1]]
        return out

    def drop(self) -> None:
        for path in self.paths:
            store, folder = open_store(path)
            store.delete_dir(folder)
        self.paths = []


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def parts_for(df: DataFrame, size, part_bytes: int) -> int:
    """Partitions of about ``part_bytes`` each for the sum of ``size``, one per core at least."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return int(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer for unsigned 64-bit integers (multiplications wrap)."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX2
    return x ^ (x >> np.uint64(33))


def one_task_each(files: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """A task for every row of a list of files (several rows beyond ``most``)."""
    return files.repartitionByRange(max(1, min(files.count(), most)), key)


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        m = max(n, 2 * len(_POWERS))
        grown, inverse = np.full(m, BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        grown[0] = inverse[0] = 1
        _POWERS, _INVERSES = np.cumprod(grown, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _POWERS[:n], _INVERSES[:n]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash every word of a column of texts.

    A word is a run of ASCII letters, ASCII digits and characters beyond ASCII,
    in lower case.  Returns the 64-bit hashes of all words, and for each text the
    index of its first word (one more entry at the end).  Null is an empty text.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(low)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, off, buf = low.buffers()
    offsets = np.frombuffer(off, np.int64)[low.offset : low.offset + n + 1]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, starts = [], np.zeros(n + 1, np.int64)
    at, done = 0, 0
    while at < n:  # blocks of some MB keep the work arrays small; a long text is a block of its own
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 21), "right")) - 1)
        h, first = _block_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        hashes.append(h)
        starts[at : to + 1] = first + done
        done += len(h)
        at = to
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), starts


def _block_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix64((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, offsets, "left").astype(np.int64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text of at least one word is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = mix64(h * BASE + words[i : n - k + 1 + i])
    return h


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.RecordBatch.from_pydict(r, schema=schema)
