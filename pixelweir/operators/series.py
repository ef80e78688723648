"""Runs of messages: which run a message belongs to, the start gate, the end, chunks and counters.

A run begins with the first start message of a series, or with the first start that names none. A message belongs to the run of the
series that it names, once that has begun. A message that names no series belongs to the run that began last before it; so an end
message, which names none, ends that run. A run that began without a name also takes messages of series that have no run. A run ends with the first
end message that belongs to it; later starts of its series, and all that comes before a start or after the end, count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweir.functions.config import ScanConfig
from pixelweir.operators.ranking import RANGE, carried, running, split_join


def openings(messages: DataFrame) -> DataFrame:
    """series and start_seq of every run. messages: series, seq, type."""
    return messages.where("type = 'start'").groupBy("series").agg(F.min("seq").alias("start_seq"))


def attributed(messages: DataFrame, width: int = RANGE) -> DataFrame:
    """messages (series, seq, type and others) that belong to a run, with run_seq: the seq of the start that opened it.

    Most messages name a series, and a join tells where its run begins. The others are looked up by order: ranges of messages, in order of seq,
    pass on the last start that they hold.
    """
    opened = openings(messages)
    named = split_join(messages, opened.where("series IS NOT NULL"), "series", "left")
    named = named.withColumn("run_seq", F.when(F.col("start_seq") < F.col("seq"), F.col("start_seq"))).drop("start_seq")
    unnamed = opened.where("series IS NULL").select("start_seq").first()
    # a message of a series without a run can only belong to a run without a name
    open_ = (F.col("type") != "start") & F.col("run_seq").isNull() & (F.col("series").isNull() if unnamed is None else F.lit(True))
    lone = named.where(open_)
    own = named.where("run_seq IS NOT NULL")
    if lone.isEmpty():
        return own
    begins = opened.select(F.col("start_seq").alias("seq"), F.struct(F.col("start_seq").alias("at"), F.col("series").isNull().alias("unnamed")).alias("begun_"))
    placed = carried(lone.unionByName(begins, allowMissingColumns=True), "seq", F.col("begun_"), "last_", width).where("begun_ IS NULL AND last_ IS NOT NULL")
    found = placed.where(F.col("series").isNull() | F.col("last_.unnamed")).withColumn("run_seq", F.col("last_.at"))
    return own.unionByName(found.select(*own.columns))


def run_bounds(belonging: DataFrame) -> DataFrame:
    """run_seq and end_seq (or null) of the runs that have messages after their start."""
    return belonging.groupBy("run_seq").agg(F.min(F.when(F.col("type") == "end", F.col("seq"))).alias("end_seq"))


def gated(messages: DataFrame, width: int = RANGE) -> DataFrame:
    """The image messages between their run's start and its end, with run_seq."""
    # images don't tell where a run begins or ends, so the bounds are found without them
    bounds = run_bounds(attributed(messages.where("type IN ('start', 'end')"), width))
    images = attributed(messages.where("type IN ('start', 'image')"), width).where("type = 'image'")
    found = split_join(images, bounds, "run_seq", "left")
    return found.where("end_seq IS NULL OR seq < end_seq").drop("end_seq")


def start_errors(size_y: Column, size_x: Column, images: Column, config: ScanConfig) -> Column:
    """Why a start message does not fit the configuration, or null. Sizes count only if both are there."""
    h, w = config.detector
    shape = size_y.isNotNull() & size_x.isNotNull() & ((size_y != h) | (size_x != w))
    return F.when(shape, F.lit("detector shape")).when(images > config.positions, F.lit("too many images"))


def chunks(frames: DataFrame, size: int) -> DataFrame:
    """frames with chunk: runs of `size` frames of a series, in order of seq; the last may be shorter."""
    return running(frames, "seq", "chunk", by="series").withColumn("chunk", F.expr(f"chunk DIV {size}"))


def counters(messages: DataFrame, decodes: Column) -> DataFrame:
    """For each series: messages received, image messages, decoded and failed frames."""
    image = F.col("type") == "image"
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("long")
    return messages.groupBy("series").agg(
        F.count("*").alias("received"),
        count(image).alias("images"),
        count(image & decodes).alias("decoded"),
        count(image & ~decodes).alias("decode_errors"),
    )
