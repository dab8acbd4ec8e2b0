"""Run catalog and retention plan (a plan only, nothing is deleted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.operators.ordered import running_total

# Run folder names and the files that protect a run.
RUN_ID = r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$"
RUN_ID_FORMAT = "yyyy-MM-dd_HH-mm-ss"
KEEP_FILES = (".keep", "KEEP", "keep.txt")


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below the run folders: ``run_id, name, length, modified``.

    The run folders are listed by the driver (one name each); their files, hidden
    ones such as ``.keep`` too, are listed in tasks.
    """
    from pyarrow import fs as pafs

    def listing(uri: str, deep: bool):
        store, path = pafs.FileSystem.from_uri(uri)
        return store.get_file_info(pafs.FileSelector(path, recursive=deep))

    names = [i.base_name for i in listing(folder, False) if i.type == pafs.FileType.Directory]
    runs = spark.createDataFrame([(n,) for n in names], "run_id string").where(F.col("run_id").rlike(RUN_ID))

    def files(batches):
        import pandas as pd

        for batch in batches:
            for run_id in batch["run_id"]:
                found = [i for i in listing(f"{folder}/{run_id}", True) if i.type == pafs.FileType.File]
                yield pd.DataFrame(
                    {
                        "run_id": [run_id] * len(found),
                        "name": [i.base_name for i in found],
                        "length": [i.size for i in found],
                        "modified": pd.to_datetime([i.mtime_ns or 0 for i in found], utc=True).floor("us"),
                    }
                )

    return runs.mapInPandas(files, "run_id string, name string, length long, modified timestamp")


def run_catalog(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """One row per run: time, size, protection.

    The time comes from the manifest (``run_id, timestamp`` text), else from
    the folder name, else from the newest file.
    """
    runs = files.where(F.col("run_id").rlike(RUN_ID)).groupBy("run_id").agg(
        F.sum("length").alias("size_bytes"),
        F.max("modified").alias("_mtime"),
        F.bool_or(F.col("name").isin(*KEEP_FILES)).alias("keep"),
    )
    named = F.try_to_timestamp("run_id", F.lit(RUN_ID_FORMAT))
    stated = F.lit(None).cast("timestamp")
    if manifests is not None:
        runs = runs.join(
            manifests.groupBy("run_id").agg(F.max("timestamp").alias("_stated")), "run_id", "left"
        )
        stated = F.try_to_timestamp("_stated")
    return runs.select(
        "run_id", F.coalesce(stated, named, "_mtime").alias("ts"), "size_bytes", "keep"
    )


def retention_plan(
    runs: DataFrame,
    *,
    keep_last: int,
    now: Column,
    max_age_days: int | None = None,
    max_total_bytes: int | None = None,
) -> DataFrame:
    """Adds ``kept_newest``, ``age_marked`` and ``remove`` to ``runs``.

    The newest ``keep_last`` unprotected runs and all protected ones stay.  Of
    the rest, runs older than the age limit go, and then, age-marked first and
    oldest first, as many as bring the total under the size limit; age-marked
    runs go even when the total is small enough.  The running total is cut into
    days, so no task sees all runs.
    """
    newest = (
        runs.where(~F.col("keep"))
        .orderBy(F.desc("ts"), F.desc("run_id"))
        .limit(max(0, keep_last))
        .select("run_id", F.lit(True).alias("kept_newest"))
    )
    rows = runs.join(newest, "run_id", "left").withColumn(
        "kept_newest", F.coalesce("kept_newest", F.lit(False))
    )
    candidate = ~F.col("keep") & ~F.col("kept_newest")
    if max_age_days is None:
        aged = F.lit(False)
    else:
        aged = candidate & (F.col("ts") < now - F.make_dt_interval(F.lit(max_age_days)))
    rows = rows.withColumn("age_marked", aged).withColumn("_candidate", candidate)
    if max_total_bytes is None:
        return rows.withColumn("remove", F.col("age_marked")).drop("_candidate")
    total = runs.agg(F.sum("size_bytes")).scalar()
    day = F.floor(F.unix_timestamp("ts") / 86400)
    place = F.when(~F.col("_candidate"), 2).when(F.col("age_marked"), 0).otherwise(1)
    summed = running_total(
        rows, keys=[], bin=[place, day], order=[F.col("ts"), F.col("run_id")],
        value=F.col("size_bytes"), name="_sum",
    )
    before = F.col("_sum") - F.col("size_bytes")
    over = F.col("_candidate") & (before < total - F.lit(max_total_bytes))
    return summed.withColumn("remove", F.col("age_marked") | over).drop("_sum", "_candidate")
