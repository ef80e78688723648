"""Images kept up to date while messages come: decode, gate and image in one streaming plan, and an image that is added to, not made anew.

The frames that a micro-batch lets through become a small table of its own (delta): the last sum of each run and position. After every `compact` batches the deltas are
merged with the image so far into a new base. A snapshot reads one base and fewer than `compact` deltas, so its cost is bounded by the image and
these, however long the stream has run. A batch that runs again writes its own delta, and the base it makes, again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.functions.config import ScanConfig
from pixelweir.operators import decode, image
from pixelweir.streaming import held_gate

COMPACT = 16
SUMS = "run_seq long, series long, image_id long, seq long, s double"
ERRORS = "seq long, image_id long, error string"


def last_sums(frames: DataFrame) -> DataFrame:
    """Of each run and position the sum of the latest frame."""
    last = F.max_by(F.struct("series", "seq", "s"), "seq")
    return frames.groupBy("run_seq", "image_id").agg(last.alias("x")).select("run_seq", "x.series", "image_id", "x.seq", "x.s")


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders n=... whose table was written to its end, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    done = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/n=*/_SUCCESS"))
    return sorted(int(x.getPath().getParent().getName()[2:]) for x in done)


def pieces(spark: SparkSession, place: str, before: int | None = None) -> list[str]:
    """The folders that make up the image (before batch `before`): the newest base and the deltas after it."""
    bases, deltas = ([n for n in finished(spark, f"{place}/{kind}") if before is None or n < before] for kind in ("base", "delta"))
    last = bases[-1] if bases else -1
    return [f"{place}/base/n={last}"] * bool(bases) + [f"{place}/delta/n={n}" for n in deltas if n > last]


def sums(spark: SparkSession, place: str, before: int | None = None) -> DataFrame:
    found = pieces(spark, place, before)
    return last_sums(spark.read.schema(SUMS).parquet(*found)) if found else spark.createDataFrame([], SUMS)


def add_batch(frames: DataFrame, number: int, place: str, compact: int = COMPACT) -> None:
    """Adds the frames of a micro-batch to the image, and its failed frames to the quarantine."""
    spark = frames.sparkSession
    held = frames.persist()
    try:
        last_sums(held.where("s IS NOT NULL")).write.mode("overwrite").parquet(f"{place}/delta/n={number}")
        held.where("error IS NOT NULL").select("seq", "image_id", "error").write.mode("overwrite").parquet(f"{place}/quarantine/n={number}")
    finally:
        held.unpersist()
    if number % compact == compact - 1:
        # from what was there before this batch and from this batch: the same if it runs again
        found = [*pieces(spark, place, number), f"{place}/delta/n={number}"]
        last_sums(spark.read.schema(SUMS).parquet(*found)).write.mode("overwrite").parquet(f"{place}/base/n={number}")


def run_live(raw: DataFrame, weights: list[float], config: ScanConfig, place: str, checkpoint: str, delay: int = held_gate.DELAY, shards: int = held_gate.SHARDS, compact: int = COMPACT, verify_all: bool = False, once: bool = True) -> None:
    """Reads what a stream of (seq, raw) has, to its end, and keeps the images of its runs at `place`.

    Messages may come up to `delay` places late. The last `delay` messages stay in the state until later ones come. Sources that plan a batch at a
    time are read until they have no more (once=False).
    """
    rows = decode.decoded_rows(raw, weights, config, verify_all)
    passed = held_gate.held_gate(rows, delay, shards)
    writer = passed.writeStream.foreachBatch(lambda frames, number: add_batch(frames, number, place, compact)).option("checkpointLocation", checkpoint).outputMode("append")
    query = writer.trigger(availableNow=True).start() if once else writer.start()
    try:
        if once:
            query.awaitTermination()
        else:
            query.processAllAvailable()
    finally:
        query.stop()


def live_images(spark: SparkSession, place: str, config: ScanConfig) -> DataFrame:
    """The images so far: run_seq, series, scan_y, scan_x, s and visited of every scan position of each run."""
    found = sums(spark, place)
    return image.run_grids(found, found.select("run_seq", "series").distinct(), config)


def quarantine(spark: SparkSession, place: str) -> DataFrame:
    """seq, image_id and error of the frames that could not be decoded."""
    done = finished(spark, f"{place}/quarantine")
    return spark.read.schema(ERRORS).parquet(*(f"{place}/quarantine/n={n}" for n in done)) if done else spark.createDataFrame([], ERRORS)
