"""Re-scanning as files arrive: a file stream whose batches run the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.functions.text import decoded, is_vendored
from codestrata.operators.relational import latest_per_key
from codestrata.sources import cpp, scan

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, rows_path: str, checkpoint: str) -> StreamingQuery:
    """Parse files of a tree as they come; each batch's rows go to their own folder, so a batch that is repeated replaces itself. Ends when all present files are read."""
    stream = spark.readStream.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(scan.SUFFIXES) + "}").load(root)

    def each(batch: DataFrame, number: int) -> None:
        files = batch.select(F.col("path").alias("file_path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), F.lit(cpp.PARSER_VERSION).alias("parser_version"), decoded(F.col("content")).alias("text"))
        files = files.filter(~is_vendored(F.col("file_path")))
        _, packed = scan.parse_cached(files, None)
        packed.write.mode("overwrite").parquet(f"{rows_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, rows_path: str) -> DataFrame:
    """The tagged rows of each file's last version among all batches."""
    held = spark.read.parquet(rows_path)
    return scan.unpack(latest_per_key(held, ["file_path"], [F.col("mtime"), F.col("batch")]))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, of a stream or a table (ts, event_type, value); rows later than `late` are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
