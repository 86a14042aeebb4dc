"""Session and folder helpers."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What a table was shuffled through is of no use once the table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table is broadcast by its size on disk, and takes 15 times that in the driver.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_OWN_DIRS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in a session without one (tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="codestrata-")
    return _OWN_DIRS[app]


def bounded_batches(spark: SparkSession, rows: int = 4000, mb: int = 4) -> None:
    """From now on a batch sent to Python holds at most so many rows and MB, whatever the length of the texts.

    The session keeps the setting, as plans run after the operator has returned them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key over at least two tasks a core; a fixed number, which AQE does not make smaller."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


@contextlib.contextmanager
def merged_joins(spark: SparkSession) -> Iterator[None]:
    """What is written in this block joins by merging: no table passes through the driver. The session's own setting is put back."""
    names = (BROADCAST, "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Scratch:
    """Written tables in the shared folder that cut lineage; `drop` removes those that no later plan reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0, []

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:04d}"
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
        """The written table and its rows, or those for which `what` holds, counted while it is written."""
        seen = Observation()
        written = self.write(df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")))
        return written, seen.get["n"]

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def drop(self, keep: int = 0) -> None:
        """Delete all written tables but the last `keep`."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(self.paths) - keep :]
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in gone:
            jp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            jp.getFileSystem(hadoop).delete(jp, True)


def drop_own_dirs() -> None:
    """Remove the temporary folders made where no shared folder was set."""
    while _OWN_DIRS:
        shutil.rmtree(_OWN_DIRS.popitem()[1], ignore_errors=True)
