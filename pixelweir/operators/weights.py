"""The weight of each detector pixel: disk x good pixel x gain."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.functions.config import ScanConfig
from pixelweir.functions.pixels import in_disk, row_major


def pixel_grid(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """y and x of every detector pixel."""
    y, x = row_major(F.col("id"), config.detector[1])
    return spark.range(config.pixels).select(y.alias("y"), x.alias("x"))


def load_mask(spark: SparkSession, path: str | None, config: ScanConfig, name: str) -> DataFrame | None:
    """(y, x, name) from an .npy file of the detector's shape, read by Spark; None (all ones) without a path or file."""
    if not path:
        return None
    folder, _, file = path.rpartition("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", file).load(folder or ".").select("content").take(1)
    if not found:
        return None
    mask = np.load(io.BytesIO(bytes(found[0]["content"])))
    if mask.shape != tuple(config.detector):
        raise ValueError(f"{name} has the shape {mask.shape}, the detector {tuple(config.detector)}")
    rows = [(int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(mask.astype(np.float32))]
    return spark.createDataFrame(rows, f"y int, x int, {name} double")


def weight_map(grid: DataFrame, config: ScanConfig, gain: DataFrame | None = None, good: DataFrame | None = None) -> DataFrame:
    """y, x and w of every pixel of the grid; a pixel that a mask does not list counts as 1 there."""
    out = grid.withColumn("w", in_disk(F.col("y"), F.col("x"), config).cast("double"))
    for mask, column in ((gain, "gain"), (good, "good")):
        if mask is not None:
            out = out.join(mask.select("y", "x", column), ["y", "x"], "left").withColumn("w", F.col("w") * F.coalesce(F.col(column), F.lit(1.0))).drop(column)
    return out.select("y", "x", "w")


def outside_detector(mask: DataFrame, config: ScanConfig) -> DataFrame:
    """Rows of a mask that no detector pixel has: a mask of another shape."""
    h, w = config.detector
    return mask.where((F.col("y") < 0) | (F.col("y") >= h) | (F.col("x") < 0) | (F.col("x") >= w))


def active(weights: DataFrame) -> DataFrame:
    """Pixels that can add to a sum; one row for each detector pixel at most, so it may be sent to every executor."""
    return F.broadcast(weights.where(F.col("w") != 0))
