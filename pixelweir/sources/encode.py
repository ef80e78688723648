"""Messages made from frames, for round trips and tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pixelweir.functions import cbor, messages
from pixelweir.functions.config import ScanConfig

SERIES = 1
#: Frames that are laid out together.
TOGETHER = 1024


def encode_hits(hits: DataFrame, config: ScanConfig, dtype: str = "<u4", algorithm: str | None = "bslz4", block_size: int = 8192, series: int | None = SERIES) -> DataFrame:
    """image_id and raw: each image's hits (image_id, y, x, count) as one message; an image has at most as many pixels as the detector."""
    lists = hit_lists(hits, config).withColumn("series", F.lit(series).cast("long"))
    return encode_lists(lists, config, dtype, algorithm, block_size).select("image_id", "raw")


def hit_lists(hits: DataFrame, config: ScanConfig, parts: int | None = None) -> DataFrame:
    """image_id, and p and n: the pixels of an image that were hit, in row-major order, and their counts. With `parts`, in so many partitions."""
    pixel = F.col("y") * config.detector[1] + F.col("x")
    sums = hits.groupBy("image_id", pixel.cast("int").alias("p")).agg(F.sum("count").cast("long").alias("n"))
    dealt = sums if parts is None else sums.repartition(parts, "image_id")
    return dealt.groupBy("image_id").agg(F.collect_list(F.struct("p", "n")).alias("hits")).select("image_id", F.col("hits.p").alias("p"), F.col("hits.n").alias("n"))


def encode_lists(lists: DataFrame, config: ScanConfig, dtype: str = "<u4", algorithm: str | None = "bslz4", block_size: int = 8192) -> DataFrame:
    """raw for p and n: a message for each row of hit_lists() with a series (or null); other columns stay."""
    kept = [c for c in lists.columns if c not in ("p", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            frames = np.zeros((batch.num_rows, config.pixels), np.int64)
            row = np.repeat(np.arange(batch.num_rows), batch.column("p").value_lengths().to_numpy())
            frames[row, batch.column("p").flatten().to_numpy()] = batch.column("n").flatten().to_numpy()
            frames = frames.reshape(-1, *config.detector).astype(dtype)
            ids, of = batch.column("image_id").to_pylist(), batch.column("series").to_pylist()
            raw: list = [None] * batch.num_rows
            for series in dict.fromkeys(of):
                ks = [k for k, x in enumerate(of) if x == series]
                named = {} if series is None else {"series_id": series}
                for k, made in zip(ks, messages.frame_messages([ids[k] for k in ks], frames[ks], algorithm, block_size, **named), strict=True):
                    raw[k] = made
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(raw, pa.binary())], names=[*kept, "raw"])

    schema = StructType([*(lists.schema[c] for c in kept), StructField("raw", BinaryType())])
    return lists.select(*kept, "p", "n").mapInArrow(run, schema)


def encode_frames(frames: DataFrame, config: ScanConfig, dtype: str = "<u4", algorithm: str | None = "bslz4", block_size: int = 8192, series: int | None = SERIES) -> DataFrame:
    """seq and raw of the image messages of frames (seq, image_id, frame)."""
    named = {} if series is None else {"series_id": series}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            pixels = batch.column("frame").flatten().to_numpy(zero_copy_only=False).reshape(-1, *config.detector).astype(dtype)
            raw = messages.frame_messages(batch.column("image_id").to_pylist(), pixels, algorithm, block_size, **named)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(raw, pa.binary())], names=["seq", "raw"])

    return frames.select("seq", "image_id", "frame").mapInArrow(run, "seq long, raw binary")


def with_bounds(images: DataFrame, config: ScanConfig, last: int) -> DataFrame:
    """The image messages between a start (seq 0) and an end (seq `last`), which names no series."""
    rows = [(0, bytearray(start_message(config))), (last, bytearray(cbor.dumps({"type": "end"})))]
    return images.unionByName(images.sparkSession.createDataFrame(rows, "seq long, raw binary"))


def start_message(config: ScanConfig, series: int | None = SERIES) -> bytes:
    named = {} if series is None else {"series_id": series}
    return cbor.dumps({"type": "start", **named, "image_size_y": config.detector[0], "image_size_x": config.detector[1], "number_of_images": config.positions})
