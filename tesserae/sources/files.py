"""File collections: workspace scans, logs, event-stream texts, line-wise JSON, bundles and backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.text import glob


def scan_files(spark: SparkSession, folder: str, *, ignore: list[str] | None = None, only: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """``path, digest, size, modified_at, content`` of the files below a folder; paths are relative to it.

    Globs in ``ignore`` drop paths, globs in ``only`` keep those that match any; larger files are left out before
    their content is read, as the size is a filter on the scan.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    base = folder.rstrip("/") + "/"
    files = raw.select(F.expr(f"substring(path, locate('{base}', path) + {len(base)})").alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    if ignore:
        files = files.where(~F.col("path").rlike("|".join(glob(g) for g in ignore)))
    if only:
        files = files.where(F.col("path").rlike("|".join(glob(g) for g in only)))
    return files.select("path", F.sha2("content", 256).alias("digest"), "size", "modified_at", "content")


def content_if_unchanged(files: DataFrame, path: str, digest: str) -> DataFrame:
    """The content of one file, if it still has the given digest."""
    return files.where((F.col("path") == path) & (F.col("digest") == digest)).select("content")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of an exported log with lines ``hash|author|email|time|subject|refs``; a bar inside the subject stays in it."""
    line = F.split(F.col("value"), r"\|")
    n = F.size(line)
    raw = spark.read.text(path).where(F.length("value") > 0).where(F.size(F.split("value", r"\|")) >= 6)
    subject = F.array_join(F.slice(line, F.lit(5), n - 5), "|")
    return raw.select(line[0].alias("hash"), line[1].alias("author"), line[2].alias("email"), F.to_timestamp(line[3]).alias("at"), subject.alias("subject"), F.element_at(line, -1).alias("refs"))


def event_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Payloads of ``data:`` lines of recorded event streams; comments and the end mark are skipped, broken JSON gives nulls."""
    data = spark.read.text(path).where(F.col("value").startswith("data:")).select(F.trim(F.substring("value", 6, 1 << 30)).alias("d")).where("d <> '[DONE]'")
    return data.select(F.from_json("d", schema).alias("j")).select("j.*")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, streaming: bool = False) -> DataFrame:
    """One JSON document per line, read at once or as a stream; broken lines give nulls."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("mode", "PERMISSIVE").json(path)


def backup(df: DataFrame, path: str) -> None:
    """Rows as gzip-compressed line-wise JSON."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def restore(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_bundle(df: DataFrame, key: str, keys: list | None = None, since: tuple[str, str] | None = None) -> DataFrame:
    """``key, document``: chosen rows, each as one JSON document; chosen by key, by a time column's least value, or both."""
    if keys is not None:
        df = df.where(F.col(key).isin(*keys))
    if since is not None:
        df = df.where(F.col(since[0]) >= F.lit(since[1]).cast(df.schema[since[0]].dataType))
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document"))


def import_bundle(bundle: DataFrame, existing: DataFrame, key: str, schema: StructType | str) -> DataFrame:
    """Rows of a bundle whose key is not there yet, once each."""
    new = bundle.join(existing.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.first("document").alias("document")).select(F.from_json("document", schema).alias("j")).select("j.*")


def write_by_key(df: DataFrame, path: str, partition: str) -> None:
    """Columnar copy with one folder per value of ``partition``; rows of a value are spread by hash, so that a large value has several writers."""
    df.repartition(partition, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode("overwrite").partitionBy(partition).parquet(path)
