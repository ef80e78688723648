"""Where messages come from: tables of (seq, raw), streams of new files, and logs of length-prefixed messages, stored or growing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweir.sources import log_files
from pixelweir.sources.log_source import MessageLog

SCHEMA = "seq long, raw binary"
LOG = "file string, seq long, raw binary"
#: Bytes of a log that one task reads, and that a stream admits at once.
RANGE_BYTES, BYTES_PER_TRIGGER = 64 << 20, 256 << 20
RANGES = "file string, first long, begins long, ends long, size long"


def message_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored copy of a stream: Parquet with seq (order of arrival) and raw."""
    return spark.read.schema(SCHEMA).parquet(path)


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The same as a stream of files; how many are admitted at once is the back-pressure."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def log_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of about range_bytes of the log files: file, number of the first message, first byte, byte after the last, and the file's size.

    Messages have no mark to begin at, so each file's lengths are read one after the other, by one task a file; it skips what stands between them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                rows = [(file, *r, size) for r in log_files.ranges(file, size, range_bytes)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.string(), *[pa.int64()] * 4], strict=True)], names=[x.split(" ")[0] for x in RANGES.split(", ")])

    return files.repartition("path").mapInArrow(run, RANGES)


def message_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, index: str | None = None) -> DataFrame:
    """file, seq and raw of the messages of log files in which each is preceded by its length (u32, big-endian).

    seq orders the messages of all files: files by name, messages by place. Ranges of a file are read by tasks of their own, some messages at a time; none holds a
    range. What is left of a cut last message is given as a message, which cannot be read and so goes to quarantine. With `index`, ranges are
    written there once, and a file whose size is still the same is not looked through again.
    """
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    ranges = log_ranges(spark, path, range_bytes) if index is None else indexed_ranges(spark, path, range_bytes, index)
    # as many rows as there are files
    numbers = ranges.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("number"))
    tasks = max(1, math.ceil(total / range_bytes))
    dealt = ranges.join(F.broadcast(numbers), "file").withColumn("first", F.col("number") * log_files.MOST + F.col("first")).drop("number")
    return dealt.repartition(tasks, "file", "begins").select("file", "first", "begins", "ends").mapInArrow(_read_ranges, LOG)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for seqs, raw in log_files.messages(row["file"], row["first"], row["begins"], row["ends"]):
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(raw), pa.string()), pa.array(seqs, pa.int64()), pa.array(raw, pa.binary())], names=["file", "seq", "raw"])


def indexed_ranges(spark: SparkSession, path: str, range_bytes: int, index: str) -> DataFrame:
    """log_ranges(), kept as a Parquet table at `index`; files that are new or have grown are looked through and added."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        log_ranges(spark, path, range_bytes).write.parquet(index)
    known = spark.read.schema(RANGES).parquet(index).join(F.broadcast(files), ["file", "size"], "left_semi")
    new = files.where("size > 0").join(F.broadcast(known.select("file").distinct()), "file", "left_anti").select("file").collect()
    if new:
        many = [r["file"] for r in new]
        log_ranges(spark, many, range_bytes).write.mode("append").parquet(index)
        known = spark.read.schema(RANGES).parquet(index).join(F.broadcast(files), ["file", "size"], "left_semi")
    return known.select(*(x.split(" ")[0] for x in RANGES.split(", ")))


def log_stream(spark: SparkSession, path: str, progress: str, bytes_per_trigger: int = BYTES_PER_TRIGGER, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """seq and raw of growing log files, as a stream that admits about bytes_per_trigger at once and resumes within a file.

    `progress` is a folder that belongs to the query, as its checkpoint does. A cut last message waits until it is whole.
    """
    spark.dataSource.register(MessageLog)
    options = {"path": path, "progress": progress, "bytesPerTrigger": bytes_per_trigger, "rangeBytes": range_bytes}
    return spark.readStream.format(MessageLog.name()).options(**options).load()
