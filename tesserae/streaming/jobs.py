"""Structured Streaming twins of the batch operators.

State is kept per key and bounded by watermarks where time allows it; results go to a table in the shared
folder batch by batch, so a restarted or lost executor neither loses nor repeats rows of the final table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tesserae.runtime import ensure_checkpoint_dir


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table, file or folder, as a stream of its files."""
    path = f"{root}/{name}.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there and return the result table: the last one in complete mode, else all batches with ``_batch``."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        target = f"{base}/rows" if mode == "complete" else f"{base}/rows/_batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    numbered = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    return spark.read.schema(stream.schema if mode == "complete" else numbered).parquet(f"{base}/rows")


def latest_per_key(stream: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Latest row per key as it changes, kept in state: one row of the key's columns, whatever the number of events.

    Every batch emits the keys that it touched; the last emission of a key is its final row.
    """
    names = [*order, *columns]
    best = F.max_by(F.struct(*names), F.struct(*order)).alias("_best")
    return stream.groupBy(key).agg(best).select(key, *[F.col("_best")[n].alias(n) for n in names])


def windowed_counts(stream: DataFrame, at: str, by: str, size: str, late: str) -> DataFrame:
    """``begin, by, n`` per event-time window; rows later than the watermark are dropped, which bounds the state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), by, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """``key, begin, end, n`` of runs of events with less than ``gap`` between them."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, apply) -> None:
    """Hand every micro-batch to ``apply(batch, number)`` exactly once per number."""
    ensure_checkpoint_dir(stream.sparkSession)
    state = f"{stream.sparkSession.sparkContext.getCheckpointDir()}/drain-{uuid.uuid4()}"
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
