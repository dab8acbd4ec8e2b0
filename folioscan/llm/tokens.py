"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

A shard file holds the ids of its documents one after the other.  The end
positions of the documents are a rising sequence and are stored in Elias-Fano
form: the low bits packed, the high bits in unary, and every 256th set bit
sampled, so that ``select`` finds a boundary by a short scan instead of a table
of 64-bit offsets.

File, little endian: ids (2 or 4 bytes each), document ids (8 bytes each), low
bits, high bits, select samples (4 bytes each), then the footer.

Defined results: null text is empty text (only the end id); documents without an
id come first; equal ids are ordered by the hash of their text, repeated rows
stay repeated; an empty table gives no file and no row; further columns are not
looked at.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from folioscan.llm import common

FOOTER = "<8sIIQQQQQQQ"
FOOTER_SIZE = struct.calcsize(FOOTER)
MAGIC = b"EFTOKEN1"
SAMPLE = 256


# -- Elias-Fano ----------------------------------------------------------------


def ef_encode(values: np.ndarray, upper: int) -> tuple[int, bytes, bytes, bytes]:
    """Low-bit width, low bits, high bits and select samples of rising values up to ``upper``."""
    n = len(values)
    width = max(0, int(upper // n).bit_length() - 1) if n else 0
    v = values.astype(np.uint64)
    low = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    high = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(upper) >> width) + n + 1, np.uint8)
    bits[high] = 1
    return (
        width,
        np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
        np.packbits(bits, bitorder="little").tobytes(),
        high[::SAMPLE].astype("<u4").tobytes(),
    )


class EliasFano:
    """Reads single values (``select``) or all of them without unpacking a table."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    def _low(self, i: int) -> int:
        out = 0
        for k in range(self.width):
            bit = i * self.width + k
            out |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """Value ``i``: from the sampled bit on, whole bytes are skipped by their bit counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, shift = at >> 3, at & 7
        word = int(self.high[byte]) >> shift << shift
        while left >= (count := word.bit_count()):
            left -= count
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.width | self._low(i)

    def values(self) -> np.ndarray:
        if self.n == 0:
            return np.empty(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        low = bits.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return (high << self.width) | low


class TokenFile:
    """A shard file, read by position."""

    def __init__(self, uri: str):
        store, path = common.open_store(uri)
        self.f = store.open_input_file(path)
        size = self.f.size()
        magic, self.id_bytes, width, self.n_docs, self.n_null, self.n_ids, *ends = struct.unpack(
            FOOTER,
            self.f.read_at(FOOTER_SIZE, size - FOOTER_SIZE)
        )
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        docs_at, low_at, high_at, samples_at = ends
        tail = self.f.read_at(size - FOOTER_SIZE - docs_at, docs_at)
        part = lambda a, b: tail[a - docs_at : b - docs_at]
        self.doc_ids = np.frombuffer(part(docs_at, low_at), "<i8")
        self.ends = EliasFano(
            self.n_docs, width, part(low_at, high_at), part(high_at, samples_at), part(samples_at, size - FOOTER_SIZE)
        )

    def ids(self, start: int, end: int) -> np.ndarray:
        raw = self.f.read_at((end - start) * self.id_bytes, start * self.id_bytes)
        return np.frombuffer(raw, f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        return self.ids(start, self.ends.select(i))


# -- encoding ------------------------------------------------------------------

# The alternatives by which the vocabulary file cuts words, for lower-case text.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")


class Encoder:
    """Ids of whole texts as bytes, equal to those of the tokenizers library.

    The vocabulary file cuts a text at white space and into pieces before it merges,
    so the ids of a text are those of its pieces in order.  The library encodes every
    distinct piece once per Python worker, and words between white space are looked up
    whole; a full cache is emptied.  That holds for files that drop white space and
    cut as ``PIECE`` says, and for texts of plain Latin characters; any other text
    goes to the library whole.
    """

    def __init__(self, path: str, id_bytes: int, by_piece: bool, cache_size: int = 600_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.by_piece, self.cache_size = f"<u{id_bytes}", by_piece, cache_size
        self.words: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, self.dtype).tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > self.cache_size:
            self.words.clear()
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        pieces = {w: PIECE.findall(w) for w in {w for w in words if w not in self.words}}
        new = list({p for own in pieces.values() for p in own if p not in self.cache})
        self.cache.update(zip(new, self._library(new)))
        for w, own in pieces.items():
            self.words[w] = b"".join([self.cache[p] for p in own])

    def encode(self, text: str) -> bytes:
        if not self.by_piece or "<|" in text or not PLAIN.fullmatch(text):
            return self._library([text])[0]
        words = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.words.__getitem__, words))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_for(*args) -> Encoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    if args not in _ENCODERS:
        _ENCODERS[args] = Encoder(*args)
    return _ENCODERS[args]


def cuts_by_piece(path: str) -> bool:
    """Whether the vocabulary file lower-cases, drops white space and cuts as ``PIECE`` does."""
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    norm = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", [])]
    pre = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and pre.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and (pre.get("behavior"), pre.get("invert")) == ("Removed", True)
    )


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_bytes: int = 2, shard_bytes: int = 64 << 20
) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files in ascending id order.

    Returns the list of files: (shard, path, n_docs, n_tokens, base), ``base``
    being the number of ids before the file.  One range partition becomes one
    file of about ``shard_bytes`` text.  A file has a name of its own for every
    attempt, and only those of finished tasks are listed.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    n = common.parts_for(docs, common.text_bytes(), shard_bytes)
    folder = common.shared_folder(spark, "tokens")
    store, path = common.open_store(folder)
    store.create_dir(path, recursive=True)
    by_piece = cuts_by_piece(tokenizer)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
        .select("doc_id", "text")
    )
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:07d}-{uuid.uuid4().hex}.eft"
        encoder, out = encoder_for(tokenizer, id_bytes, by_piece), None
        doc_ids, ends, n_ids, n_null = [], [], 0, 0
        end = int(end_id).to_bytes(id_bytes, "little")
        for batch in rows:
            if batch.num_rows == 0:
                continue
            if out is None:
                store, path = common.open_store(uri)
                out = store.open_output_stream(path)
            ids = batch.column(0)
            n_null += ids.null_count
            doc_ids.append(np.asarray(ids.fill_null(0)))
            sizes, block = [], []
            for text in batch.column(1):
                block.append(encoder.encode(text.as_py() or "") + end)
                sizes.append(len(block[-1]) // id_bytes)
            out.write(b"".join(block))
            ends.append(n_ids + np.cumsum(sizes, dtype=np.int64))
            n_ids = int(ends[-1][-1])
        if out is None:
            return
        ids, ends = np.concatenate(doc_ids).astype("<i8"), np.concatenate(ends)
        width, low, high, samples = ef_encode(ends, n_ids)
        at = n_ids * id_bytes
        places = [at, at + ids.nbytes, at + ids.nbytes + len(low), at + ids.nbytes + len(low) + len(high)]
        out.write(ids.tobytes() + low + high + samples)
        out.write(struct.pack(FOOTER, MAGIC, id_bytes, width, len(ids), n_null, n_ids, *places))
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [uri], "n_docs": [len(ids)], "n_tokens": [n_ids]}, schema=schema
        )

    files = common.stored(
        ordered.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "token-list"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame, block_ids: int = 1 << 21) -> DataFrame:
    """Per document of the listed files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(uri)
                ends = file.ends.values()
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                at = 0
                while at < file.n_docs:
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + block_ids, "right")))
                    ids = file.ids(int(starts[at]), int(ends[to - 1])).astype("<u4").tobytes()
                    view, first = memoryview(ids), int(starts[at])
                    crc = [
                        zlib.crc32(view[(a - first) * 4 : (b - first) * 4])
                        for a, b in zip(starts[at:to].tolist(), ends[at:to].tolist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[at:to], mask=np.arange(at, to) < file.n_null),
                            pa.array(starts[at:to] + base),
                            pa.array(ends[at:to] - starts[at:to]),
                            pa.array(crc, pa.int64()),
                        ],
                        schema=schema,
                    )
                    at = to

    return (
        common.one_task_each(files.select("path", "base", "shard"), "shard")
        .select("path", "base")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` and return what is read back from them."""
    return read_token_files(write_token_files(docs, tokenizer))
