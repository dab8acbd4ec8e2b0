"""Longest-processing-time sharding of groups that must stay together.

Rows with equal text form a group.  Groups of more than a fixed share of all
bytes are few (their number is bounded by that share); each of them is scheduled
on its own.  All other groups fall by hash into ``bundles`` bundles, which are
scheduled like groups.  Both lists together have a fixed bound whatever the
input, so a heap on the driver can place them by longest processing time.

Defined results: a null text has no bytes, size 1 and checksum 0, and rows
without text are one group of their own; equal rows stay together and get
different slots; slots follow (bin, doc_id), null ids first; an empty table gives
no rows; further columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from folioscan.llm import common


def lpt(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Largest first, each to the least-loaded shard (the lowest number among equals)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_rows(rows: DataFrame, shards: int = 8, bundles: int = 4096, bin_rows: int = 10_000) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows(doc_id, size, grp, ...)``; equal ``grp`` share a shard.

    Loads differ by about the smallest of ``bundles`` bundles, unless a single
    group is larger than a shard's share.  Slots are numbered within bins of a
    shard and shifted by the rows of the bins before, so no task numbers a whole
    shard.
    """
    spark = rows.sparkSession
    bundle = F.pmod(F.xxhash64("grp"), F.lit(bundles)).cast("string")
    groups = common.stored(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes"), F.sum("n")).first()
    large = max(1, (total[0] or 0) // (4 * bundles))
    alone = F.col("bytes") > large  # fewer than 4 * bundles groups
    items = (
        groups.groupBy(F.when(alone, F.col("grp")).otherwise(bundle).alias("item")).agg(F.sum("bytes").alias("bytes"))
    ).collect()
    placed = spark.createDataFrame(
        sorted(lpt([(r["item"], r["bytes"]) for r in items], shards).items()), "item string, shard int"
    )
    single = placed.join(F.broadcast(groups.where(alone).select(F.col("grp").alias("item"))), "item", "left_semi")
    single = single.select(F.col("item").alias("grp"), F.col("shard").alias("own"))
    rest = placed.where(F.length("item") < 32).select(F.col("item").alias("bundle"), F.col("shard").alias("shared"))
    n_bins = max(1, -(-(total[1] or 0) // (bin_rows * shards)))
    at = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(single), "grp", "left")
        .join(F.broadcast(rest), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
        .withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_bins)).cast("int"))
        .drop("bundle", "own", "shared")
    )
    counts = at.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start")
    )
    within = Window.partitionBy("shard", "bin").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        at.withColumn("pos", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bin"])
        .withColumn("slot", F.col("start") + F.col("pos"))
        .drop("bin", "pos", "start")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of ``docs(doc_id, text)`` with nearly equal bytes; equal texts stay together."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (common.text_bytes() + 1).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("-" * 32)).otherwise(F.md5(F.encode("text", "UTF-8"))).alias("grp"),
    )
    placed = shard_rows(common.stored(rows, "sizes"), shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
