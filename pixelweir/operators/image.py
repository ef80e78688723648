"""The virtual image: one weighted sum for each frame, placed on the scan grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweir.functions.config import ScanConfig
from pixelweir.functions.pixels import scan_position
from pixelweir.operators.exact import exact_sums
from pixelweir.operators.weights import active


def frame_sums(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """image_id and s over hits (image_id, y, x, count). Images whose hits all have weight 0 are missing; grid() restores them.

    The weights are joined by broadcast, and sums are formed before the only shuffle, on image_id.
    """
    weighted = hits.join(active(weights), ["y", "x"]).select("image_id", (F.col("count").cast("double") * F.col("w")).alias("v"))
    return weighted.groupBy("image_id").agg(F.sum("v").alias("s"))


def exact_frame_sums(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """frame_sums() whose sums are the doubles nearest to the true ones, whatever the order of the hits; decoded frames have the same sums."""
    weighted = hits.join(active(weights), ["y", "x"]).select("image_id", (F.col("count").cast("double") * F.col("w")).alias("v"))
    return exact_sums(weighted, ["image_id"], "v")


def dense_sum(frame: Column, weights: Column) -> Column:
    """The weighted sum of a dense row-major frame and a row-major weight array of the same length; null if lengths differ."""
    total = F.aggregate(F.zip_with(frame, weights, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(frame) == F.size(weights), total)


def weight_array(weights: DataFrame) -> list[float]:
    """All weights in row-major order; as many as the detector has pixels."""
    return [r["w"] for r in weights.orderBy("y", "x").select("w").collect()]


def positions(df: DataFrame, config: ScanConfig) -> DataFrame:
    """image_id of every scan position."""
    return df.sparkSession.range(config.positions).withColumnRenamed("id", "image_id")


def grid(sums: DataFrame, seen: DataFrame, config: ScanConfig) -> DataFrame:
    """scan_y, scan_x, s and visited of every scan position: 0 where nothing was measured. Ids outside the scan are left out.

    sums has one row for each image_id at most. Positions, sums and what was seen meet in one aggregation.
    """
    none, no = F.lit(None).cast("double"), F.lit(False)
    rows = positions(sums, config).select("image_id", none.alias("s"), no.alias("visited"))
    rows = rows.union(sums.select("image_id", F.col("s").cast("double"), no)).union(seen.select("image_id", none, F.lit(True)))
    return _placed(rows, [], config)


def _placed(rows: DataFrame, keys: list[str], config: ScanConfig) -> DataFrame:
    y, x = scan_position(F.col("image_id"), config)
    inside = rows.where((F.col("image_id") >= 0) & (F.col("image_id") < config.positions))
    full = inside.groupBy(*keys, "image_id").agg(F.max("s").alias("s"), F.max("visited").alias("visited"))
    return full.select(*keys, y.alias("scan_y"), x.alias("scan_x"), F.coalesce("s", F.lit(0.0)).alias("s"), "visited")


def run_grids(frames: DataFrame, runs: DataFrame, config: ScanConfig) -> DataFrame:
    """The image of each run: run_seq, series, scan_y, scan_x, s and visited of every scan position.

    frames: run_seq, image_id, seq and s (null if the frame could not be decoded); of an id sent twice the later decoded frame counts. runs: run_seq and series.
    """
    last = F.max_by("s", F.when(F.col("s").isNotNull(), F.col("seq")))
    sums = frames.groupBy("run_seq", "image_id").agg(last.alias("s"), F.max(F.col("s").isNotNull()).alias("visited"))
    scan = positions(frames, config).join(F.broadcast(runs.select("run_seq")))
    rows = scan.select("run_seq", "image_id", F.lit(None).cast("double").alias("s"), F.lit(False).alias("visited")).unionByName(sums)
    return _placed(rows, ["run_seq"], config).join(F.broadcast(runs), "run_seq").select("run_seq", "series", "scan_y", "scan_x", "s", "visited")


def last_wins(sums: DataFrame, key: str = "image_id", order: str = "seq", value: str = "s") -> DataFrame:
    """One row for each key: the value of the largest order."""
    return sums.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def unvisited(seen: DataFrame, config: ScanConfig) -> DataFrame:
    """image_id of the scan positions that no frame has."""
    return positions(seen, config).join(seen.select("image_id").distinct(), "image_id", "left_anti")


def out_of_range(seen: DataFrame, config: ScanConfig) -> DataFrame:
    """Rows whose image_id is no scan position."""
    return seen.where((F.col("image_id") < 0) | (F.col("image_id") >= config.positions) | F.col("image_id").isNull())
