"""Best-fit packing of documents into sequences of bounded length.

Bounded-space online best-fit: a task keeps at most ``open_bins`` open sequences in
a bitset keyed by free space (bit f is set while some open sequence has f tokens
free).  A piece goes to the open sequence with the least free space that holds it,
found by one shift and one lowest-bit step.  If none holds it a new one opens, and
beyond ``open_bins`` the fullest closes first.

Tasks pack their own documents where they are read, so no text and no ids are
shuffled.  What is still open when a task ends is packed again as one item with its
used length: ``fan`` tasks' leftovers meet in one group of the next round, longest
first, until one group is left.  A group has at most ``fan * open_bins`` small rows.

Only documents longer than a sequence are cut, into pieces of the full length; the
last piece may be shorter.

Defined results: a null or empty text is one piece, the end id alone; repeated rows
are packed as often as they stand there; documents without an id keep a null id; an
empty table gives no rows; further columns are not looked at.  Sequence numbers are
any numbers, distinct for each sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from folioscan.llm import common, tokens

LENGTH = 2048
OPEN_BINS = 512
FAN = 64


class OpenBins:
    """Open sequences of one task: a bitset of free spaces, and the sequences of every free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.count = length, most, 0
        self.free = 0
        self.of: list[list[int]] = [[] for _ in range(length + 1)]
        self.next = 0

    def _take(self, space: int) -> int:
        stack = self.of[space]
        bin = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.count -= 1
        return bin

    def _put(self, bin: int, space: int) -> None:
        if space == 0:
            return
        if self.count == self.most:  # the fullest closes first, be it the new one
            fullest = (self.free & -self.free).bit_length() - 1
            if space <= fullest:
                return
            self._take(fullest)
        self.of[space].append(bin)
        self.free |= 1 << space
        self.count += 1

    def add(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of an item of ``size`` tokens."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin = self._take(space)
        else:
            bin, space = self.next, self.length
            self.next += 1
        self._put(bin, space - size)
        return bin, self.length - space

    def left(self) -> list[tuple[int, int]]:
        """(sequence, used) of what is still open."""
        return [(bin, self.length - space) for space, stack in enumerate(self.of) for bin in stack]


def pieces(ids: bytes, length: int, id_bytes: int = 4) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces of a document."""
    step = length * id_bytes
    return [(at // id_bytes, ids[at : at + step]) for at in range(0, len(ids), step)]


def _packed_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, open_bins: int) -> DataFrame:
    """Pieces with their place among the task's sequences, and a row without ids for each open sequence."""
    common.bounded_batches(docs.sparkSession)
    by_piece = tokens.cuts_by_piece(tokenizer)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids", pa.binary()), ("part", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64())]
    )

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, bins = tokens.encoder_for(tokenizer, 4, by_piece), OpenBins(length, open_bins)
        end = int(end_id).to_bytes(4, "little")

        def block(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 7
            columns.insert(5, [part] * len(out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in rows:
            out, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, (start, ids) in enumerate(pieces(encoder.encode(text.as_py() or "") + end, length)):
                    size = len(ids) // 4
                    out.append((doc_id, n, start, size, ids, *bins.add(size)))
                    held += len(ids)
                    if held > 8 << 20:
                        yield block(out)
                        out, held = [], 0
            yield block(out)
        yield block([(None, -1, None, used, None, bin, 0) for bin, used in bins.left()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        pack, "doc_id long, piece int, start long, length long, ids binary, part int, bin long, offset long"
    )


def _merged(items: DataFrame, length: int, open_bins: int, fan: int) -> DataFrame:
    """``items(part, bin, used)`` packed again, ``fan`` parts together: with ``to_part``, ``to_bin``, ``shift``, ``open``.

    A group has at most ``fan * open_bins`` items.  The ``open_bins`` emptiest of its
    sequences stay open for the next round.
    """
    schema = pa.schema(
        [("part", pa.int32()), ("bin", pa.int64()), ("used", pa.int64()),
         ("to_part", pa.int32()), ("to_bin", pa.int64()), ("shift", pa.int64()), ("open", pa.bool_())]
    )

    def repack(key: tuple, group: pa.Table) -> pa.Table:
        bins = OpenBins(length, fan * open_bins)
        columns = [group.column(c).to_pylist() for c in ("part", "bin", "used")]
        order = sorted(range(group.num_rows), key=lambda i: (-columns[2][i], columns[0][i], columns[1][i]))
        part, bin, used = ([c[i] for i in order] for c in columns)
        to_bin, shift = zip(*[bins.add(n) for n in used])
        left = {b for b, _ in sorted(bins.left(), key=lambda x: x[1])[:open_bins]}
        values = [part, bin, used, [key[0].as_py()] * len(part), to_bin, shift, [b in left for b in to_bin]]
        return pa.table([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    together = items.select(F.floor(F.col("part") / F.lit(fan)).cast("int").alias("into"), "part", "bin", "used")
    return together.groupBy("into").applyInArrow(
        repack, "part int, bin long, used long, to_part int, to_bin long, shift long, open boolean"
    )


def packed(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, open_bins: int = OPEN_BINS, fan: int = FAN
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids (4 bytes each), sequence_id, offset."""
    rows = common.stored(_packed_pieces(docs, tokenizer, length, end_id, open_bins), "packed")
    parts = rows.agg(F.max("part")).first()[0] or 0
    left = rows.where("piece < 0").select("part", "bin", F.col("length").alias("used"))
    moved, rounds = left.select("part", "bin", F.lit(0).alias("shift"), number(0, "part", "bin").alias("to")), 0
    while parts > 0:
        rounds, parts = rounds + 1, parts // fan
        step = common.stored(_merged(left, length, open_bins, fan), "repacked")
        into = step.select(
            number(rounds - 1, "part", "bin").alias("to"), number(rounds, "to_part", "to_bin").alias("next"),
            F.col("shift").alias("more"),
        )
        moved = common.stored(
            moved.join(into, "to", "left").select(
                "part", "bin", (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("next", "to").alias("to")
            ),
            "moved",
        )
        left = (
            step.where("open")
            .groupBy(F.col("to_part").alias("part"), F.col("to_bin").alias("bin"))
            .agg(F.sum("used").alias("used"))
        )
    own = rows.where("piece >= 0").withColumnRenamed("offset", "at")
    return own.join(moved, ["part", "bin"], "left").select(
        "doc_id", "piece", "start", "length", "ids",
        F.coalesce("to", number(0, "part", "bin")).alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def number(rounds: int, part: str, bin: str) -> Column:
    """A number for each sequence of each round: 4 bits for the round, 28 for the task, 32 within it."""
    return F.lit(rounds << 60).cast("long") + F.shiftleft(F.col(part).cast("long"), 32) + F.col(bin)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the token sequences themselves, from the rows of ``packed``."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``length`` pieces
    joined = F.aggregate(held, F.lit(b""), lambda all, x: F.concat(all, x["ids"]))
    return rows.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), joined.alias("ids"))


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``packed`` with the checksum of a piece's ids in place of the ids."""
    return rows.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
