"""Session helpers: settings a job needs, and where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "folioscan") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only a local session may
    leave it unset, as in tests, and then uses a temporary folder.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscan-ckpt-"))
    return df.checkpoint()


def job_folder(spark: SparkSession, name: str) -> str:
    """A new folder for stored tables that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``; only a local session may leave that unset, as
    in tests, and then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        root = tempfile.mkdtemp(prefix="folioscan-job-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which a driver with free memory
    does not do for long; until then the shuffles of all finished stages lie on the disks.
    """
    spark.sparkContext._jvm.System.gc()


class Stages:
    """Stored intermediate tables of one job, in one folder of their own.

    A stored table takes compressed bytes instead of a cache that spills as it is, gives each
    reader only the columns it wants, and cuts the lineage, so that the shuffles it came from go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, job_folder(spark, name), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:02d}-{name}"
        df.write.parquet(path)
        free_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; what reads them must be stored elsewhere before."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in few splits.

    A table in one small file is one task whatever the work on it, and so is a file of one
    large row group, however many splits its bytes make: only splits with rows count.  A
    table with at least as many of those as cores is left alone.
    """
    from pyspark.sql import functions as F

    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and df.groupBy(F.spark_partition_id()).count().count() >= cores:
        return df
    return df.repartition(max(cores, splits))


#: characters of text whose word counts one task holds in memory
CHARS_PER_TASK = 8_000_000


def tasks_for_text(df: DataFrame, text: str, chars: int = CHARS_PER_TASK) -> int:
    """Number of tasks among which texts are dealt: one per core, more for more text."""
    from pyspark.sql import functions as F

    total = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // chars))


def query_blocks(queries: DataFrame, key: str, max_rows: int) -> list[DataFrame]:
    """Split a query table into blocks of about ``max_rows`` rows.

    The operators broadcast one block at a time, so that what is broadcast has
    a checked bound however many queries there are.  One block when it fits.
    """
    from pyspark.sql import functions as F

    n = queries.count()
    if n <= max_rows:
        return [queries]
    n_blocks = -(-n // max_rows) * 2
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks))
    return [queries.where(block == i) for i in range(n_blocks)]
