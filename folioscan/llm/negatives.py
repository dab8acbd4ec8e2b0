"""Hard negatives from labelled vectors, scored by Kronecker-packed products.

Components become integers, floor(256 x).  A tile holds rows of one label; for every
component, the values of all rows of the tile stand in separated fields of one wide
integer, biased to be at least 0.  For an anchor, that integer is multiplied once by
the anchor's component; the sum over the components, plus a constant in every field
that makes it positive, unpacks to the exact inner products of the whole tile.  Fields
are 32 bits wide where the bound of the sums allows it, 64 bits or whole multiples of
64 bits beyond it, so that no component is too large.

Tiles are made where rows are read.  Anchors and tiles meet by group and split:
anchors are cut into groups of at most ``group_anchors``, and every group sees every
tile once, dealt over ``splits`` tasks.  A task keeps the best rows of its anchors
and sends only those.  The first pass multiplies tiles of the anchor's own label, the
second the others.

Defined results: a row with a null label or vector, or with a null or non-finite
component, takes no part.  Equal scores go by smaller ``vec_id``, nulls last.  A row
with the anchor's id is not another row.  Repeated rows count as often as they stand
there, but an anchor and a pair of anchor and positive are reported once.  Vectors of
different lengths are compared over the shorter one.  A positive score below 0 has
no negatives, as the bounds then exclude each other.  Without anchors there are no
rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscan.llm import common

TILE = 4096
POSITIVES, NEGATIVES = 5, 10
LAST = (1 << 63) - 1  # stands for a null id in the order of ties


# -- wide integers -------------------------------------------------------------


def width_for(bound: int) -> int:
    """Bits of a field that holds 0 to ``bound``: 32, or whole multiples of 64."""
    bits = int(bound).bit_length()
    return 32 if bits <= 32 else -(-bits // 64) * 64


def pack_fields(values: list[int] | np.ndarray, width: int) -> int:
    """One integer with ``values`` (from 0, below 2 ** width) in fields of ``width`` bits."""
    if width <= 64:
        return int.from_bytes(np.asarray(values, f"<u{width // 8}").tobytes(), "little")
    return int.from_bytes(b"".join(int(v).to_bytes(width // 8, "little") for v in values), "little")


def unpack_fields(packed: int, n: int, width: int) -> np.ndarray:
    """The ``n`` fields of a wide integer."""
    raw = packed.to_bytes(n * width // 8, "little")
    if width <= 64:
        return np.frombuffer(raw, f"<u{width // 8}")
    step = width // 8
    return np.array([int.from_bytes(raw[i : i + step], "little") for i in range(0, len(raw), step)], object)


class Tile:
    """Rows of one label with their components packed for multiplication."""

    def __init__(self, columns: list[np.ndarray]):
        self.n = len(columns[0]) if columns else 0
        self.low, self.range = [int(c.min()) for c in columns], [int(c.max()) - int(c.min()) for c in columns]
        self.columns, self.packed = columns, {}

    def fields(self, width: int) -> tuple[list[int], int]:
        """An integer for each component, and one with 1 in every field."""
        if width not in self.packed:
            values = [pack_fields(c - low, width) for c, low in zip(self.columns, self.low)]
            self.packed[width] = values, pack_fields([1] * self.n, width)
        return self.packed[width]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products of an anchor with all rows; beyond a long, the nearest long."""
        pairs = [(j, a) for j, a in enumerate(anchor[: len(self.columns)]) if a]
        least = sum(a * self.range[j] for j, a in pairs if a < 0)
        most = sum(a * self.range[j] for j, a in pairs if a > 0)
        width = width_for(most - least)
        fields, ones = self.fields(width)
        total = ones * -least
        for j, a in pairs:
            total += fields[j] * a
        bias = least + sum(a * self.low[j] for j, a in pairs)
        out = unpack_fields(total, self.n, width)
        if width <= 64 and abs(bias) + most - least <= LAST:
            return out.astype(np.int64) + bias
        return np.array([max(-LAST, min(LAST, int(v) + bias)) for v in out], np.int64)


# -- tables --------------------------------------------------------------------


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as 64-bit integers where they hold it."""
    with np.errstate(over="ignore"):
        y = np.floor(x * 256.0)
    if len(y) == 0 or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    return np.array([int(b) if np.isfinite(b) else int(a) * 256 for a, b in zip(x.tolist(), y.tolist())], object)


def to_bytes(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest form that holds them, after one byte that names it."""
    if values.dtype != object:
        for code in "<i2", "<i4":
            if len(values) == 0 or np.abs(values).max() <= np.iinfo(code).max:
                return code[2:].encode() + values.astype(code).tobytes()
        return b"8" + values.astype("<i8").tobytes()
    return b"x" + ",".join(map(str, values)).encode()


def from_bytes(raw: bytes) -> np.ndarray:
    if raw[:1] == b"x":
        return np.array([int(v) for v in raw[1:].split(b",")], object)
    return np.frombuffer(raw[1:], f"<i{raw[:1].decode()}").astype(np.int64)


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with their label and components as doubles."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    return (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            F.col("embedding").cast("array<double>").alias("v"),
        )
        .where(F.col("label").isNotNull() & F.col("v").isNotNull())
        .where(~bad)
    )


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (nulls last), labels, offsets and all components of a batch of (vec_id, label, v)."""
    ids = np.asarray(batch.column(0).fill_null(LAST))
    v = batch.column(2)
    return ids, np.asarray(batch.column(1)), np.asarray(v.offsets), np.asarray(v.values)


def tiles(rows: DataFrame, most: int = TILE) -> DataFrame:
    """(label, dim, ids, v): up to ``most`` rows of one label, components one after the other."""
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def tile(key: tuple) -> pa.RecordBatch:
            own = held.pop(key)
            ids, v = np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])
            row = ([key[0]], [key[1]], [ids.astype("<i8").tobytes()], [to_bytes(whole(v.T.ravel()))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in batches:
            ids, labels, offsets, values = _rows(batch)
            dims = np.diff(offsets)
            for label, dim in set(zip(labels.tolist(), dims.tolist())):
                at = np.flatnonzero((labels == label) & (dims == dim))
                v = values[offsets[at][:, None] + np.arange(dim)] if dim else np.empty((len(at), 0))
                for k in range(0, len(at), most):
                    held.setdefault((label, dim), []).append((ids[at[k : k + most]], v[k : k + most]))
                    if sum(len(x) for x, _ in held[label, dim]) >= most:
                        yield tile((label, dim))
            while sum(len(x) for own in held.values() for x, _ in own) > 8 * most:  # many labels: the largest go
                yield tile(max(held, key=lambda k: sum(len(x) for x, _ in held[k])))
        for key in list(held):
            yield tile(key)

    return rows.mapInArrow(cut, "label long, dim int, ids binary, v binary")


def anchors_of(rows: DataFrame, every: int) -> DataFrame:
    """(anchor, anchor_id, label, v): rows whose id is divisible by ``every``, equal rows once."""
    schema = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, offsets, values = _rows(batch)
            v = [to_bytes(whole(values[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(v, pa.binary())], schema=schema)

    own = rows.where(F.col("vec_id") % every == 0).mapInArrow(pack, "anchor_id long, label long, v binary")
    return own.dropDuplicates().withColumn("anchor", F.xxhash64("anchor_id", "label", "v"))


# -- the two passes ------------------------------------------------------------


class Best:
    """The ``k`` best (score, id) seen, higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows in any order; all that can't be among the best are left out before sorting."""
        if len(self.rows) == self.k:
            good = scores >= self.rows[-1][0]
            scores, ids = scores[good], ids[good]
        if len(scores) > 4 * self.k:
            good = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[good], ids[good]
        if len(scores):
            new = zip(scores.tolist(), ids.tolist())
            self.rows = sorted([*self.rows, *new], key=lambda r: (-r[0], r[1]))[: self.k]


class Anchor:
    def __init__(self, row: dict):
        self.key, self.id, self.label = row["anchor"], row["anchor_id"], row["label"]
        self.v = from_bytes(row["v"]).tolist()
        self.best = Best(POSITIVES)
        self.wanted = [(p["id"], p["score"], -(-30 * p["score"] // 100), 90 * p["score"] // 100, Best(NEGATIVES))
                       for p in row["positives"] or []]
        self.wanted = [w for w in self.wanted if w[2] <= w[3]]

    def see(self, tile: Tile, ids: np.ndarray, same: bool) -> None:
        if not same and not self.wanted:
            return
        scores = tile.scores(self.v)
        if same:
            other = ids != self.id
            self.best.add(scores[other], ids[other])
            return
        for _, _, low, high, best in self.wanted:
            if len(best.rows) == best.k:
                low = max(low, best.rows[-1][0])
            good = np.flatnonzero((scores >= low) & (scores <= high))
            if len(good):
                best.add(scores[good], ids[good])

    def found(self, same: bool) -> list[tuple]:
        if same:
            return [(self.key, self.id, None, None, i, s) for s, i in self.best.rows]
        return [(self.key, self.id, p, ps, i, s) for p, ps, _, _, best in self.wanted for s, i in best.rows]


def _met(anchors: DataFrame, tiled: DataFrame, same: bool, groups: int, splits: int) -> DataFrame:
    """Best rows of every anchor over the tiles of its label (``same``) or of the others, by task."""
    schema = pa.schema(
        [("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
         ("id", pa.int64()), ("score", pa.int64())]
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors = None, []

        def result() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(anchors), 1000):
                out = [r for a in anchors[k : k + 1000] for r in a.found(same)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["slot"] != at:
                    yield from result()
                    at, anchors = row["slot"], []
                if row["ids"] is None:
                    anchors.append(Anchor(row))
                    continue
                ids = np.frombuffer(row["ids"], "<i8")
                tile = Tile(list(from_bytes(row["v"]).reshape(row["dim"], len(ids)))) if row["dim"] else None
                for a in anchors:
                    if (a.label == row["label"]) == same:
                        a.see(tile or Flat(len(ids)), ids, same)
        yield from result()

    group, split = F.pmod(F.xxhash64("anchor"), F.lit(groups)), F.pmod(F.xxhash64("ids"), F.lit(splits))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("split", every(splits)).select(
        (group * splits + F.col("split")).cast("int").alias("slot"), "anchor", "anchor_id", "label", "v", "positives",
        F.lit(None).cast("int").alias("dim"), F.lit(None).cast("binary").alias("ids"),
    )
    right = tiled.withColumn("group", every(groups)).select(
        (F.col("group") * splits + split).cast("int").alias("slot"), F.lit(None).cast("long").alias("anchor"),
        F.lit(None).cast("long").alias("anchor_id"), "label", "v", F.lit(None).cast(left.schema["positives"].dataType).alias("positives"),
        "dim", "ids",
    )
    rows = left.unionByName(right).repartitionByRange(groups * splits, "slot")
    return rows.sortWithinPartitions("slot", F.col("ids").isNotNull()).mapInArrow(
        meet, "anchor long, anchor_id long, positive_id long, positive_score long, id long, score long"
    )


class Flat(Tile):
    """Rows without components: all scores are 0."""

    def __init__(self, n: int):
        super().__init__([])
        self.n = n


def hard_negatives(vectors: DataFrame, every: int = 100, tile_rows: int = TILE, group_anchors: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = taking_part(vectors)
    tiled = common.stored(tiles(rows, tile_rows), "tiles")
    anchors = common.stored(anchors_of(rows, every), "anchors")
    groups = max(1, -(-anchors.count() // group_anchors))
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups))
    positive = "array<struct<id: bigint, score: bigint>>"
    order = [F.desc("score"), "id"]
    best = (
        _met(anchors.withColumn("positives", F.lit(None).cast(positive)), tiled, True, groups, splits)
        .withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
        .where(F.col("place") <= POSITIVES)
        .groupBy("anchor")
        .agg(F.collect_set(F.struct("id", "score")).cast(positive).alias("positives"))
    )
    asked = common.stored(anchors.join(best, "anchor"), "positives")
    pair = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(*order)
    real = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return (
        _met(asked, tiled, False, groups, splits)
        .withColumn("rank", F.row_number().over(pair))
        .where(F.col("rank") <= NEGATIVES)
        .select("anchor_id", real("positive_id").alias("positive_id"), "rank", real("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))
    )
