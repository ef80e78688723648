"""Virtual image of a stored or growing stream of messages.

    spark-submit run_image.py --messages PATH --out PATH [--log] [--binned] [--scan NY NX] [--gain NPY] [--good NPY] [--verify-all]
        [--stream [--live]] [--delay N] [--files-per-trigger N] [--bytes-per-trigger N] [--npy FILE]

Messages are a Parquet table of (seq, raw), or with --log files of length-prefixed messages. With --stream what is there is read in micro-batches, and a later call goes on
from there. Writes the image of every run as Parquet (run_seq, series, scan_y, scan_x, s, visited), optionally as .npy arrays, and the messages that could not be read or decoded
(quarantine: seq, image_id, error), and prints a report. Every message is parsed once, into a table of one narrow row each.

With --live batches may come in any order, up to --delay messages late, and the images are added to instead of made from all rows. The session then keeps its
state in RocksDB, and the last --delay messages wait for later ones. Only frames of a run are told of, and no counts of messages.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from pixelweir.functions.config import BINNED, UNBINNED, ScanConfig
from pixelweir.operators import decode, image, weights
from pixelweir.sources import messages, npy
from pixelweir.streaming import held_gate, image_stream, live_image


def report(frames: dict[str, int], batches: list[dict], config: ScanConfig, elapsed_s: float, progress: list[dict] | None = None) -> dict:
    """Messages received, frames in the runs, decoded and failed, messages that cannot be read, batches, rates, how they compare with the detector's, and the
    seconds of each stage of the work over all tasks.

    frames counts those that passed the gate; batches are what the jobs that wrote them counted, so nothing is read again. With the progress of
    micro-batches also the average and largest batch, the milliseconds of Spark's phases, and for logs the average and largest backlog that a batch left.
    """
    total = {k: sum(b[k] for b in batches) for k in ("received", "unreadable", *decode.STAGES)}
    n = frames["decoded"]
    rate = n / elapsed_s if elapsed_s else float("nan")
    out = {
        "received": total["received"], "unreadable": total["unreadable"], "batches": len({b["batch"] for b in batches}), **frames,
        "elapsed_s": elapsed_s, "rate_hz": rate, "detector_rate_hz": config.detector_rate_hz, "realtime_factor": rate / config.detector_rate_hz,
        "acquisition_s": n * config.frame_period_us / 1e6, "us_per_frame": elapsed_s * 1e6 / n if n else float("nan"), "stage_s": {k.removesuffix("_ns"): total[k] / 1e9 for k in decode.STAGES},
    }
    if progress:
        stages = sorted({k for b in progress for k in b} - {"rows", "batch", "behind"})
        out |= {"batch_rows_avg": sum(b["rows"] for b in progress) / len(progress), "batch_rows_max": max(b["rows"] for b in progress), "phase_ms": {k: sum(b.get(k, 0) for b in progress) for k in stages}}
        left = [b["behind"] for b in progress if "behind" in b]
        out |= {"backlog_bytes_avg": sum(left) / len(left) if left else 0, "backlog_bytes_max": max(left, default=0)}
    return out


def run_live(spark: SparkSession, args: argparse.Namespace, config: ScanConfig, table: list[float]) -> dict:
    """The run with --live; returns frames, failed frames and seconds."""
    place, began = f"{args.out}/live", time.perf_counter()
    raw = messages.log_stream(spark, args.messages, f"{args.out}/progress", args.bytes_per_trigger) if args.log else messages.message_stream(spark, args.messages, args.files_per_trigger)
    live_image.run_live(raw, table, config, place, f"{args.out}/checkpoint", args.delay, once=not args.log)
    live_image.live_images(spark, place, config).write.mode("overwrite").partitionBy("run_seq").parquet(f"{args.out}/image")
    live_image.quarantine(spark, place).write.mode("overwrite").parquet(f"{args.out}/quarantine")
    if args.npy:
        npy.write_images(spark.read.parquet(f"{args.out}/image"), args.npy, config)
    return {"positions": live_image.sums(spark, place).count(), "decode_errors": live_image.quarantine(spark, place).count(), "elapsed_s": time.perf_counter() - began}


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = BINNED if args.binned else UNBINNED
    config = config.with_(scan=tuple(args.scan)) if args.scan else config
    grid = weights.pixel_grid(spark, config)
    table = image.weight_array(weights.weight_map(grid, config, weights.load_mask(spark, args.gain, config, "gain"), weights.load_mask(spark, args.good, config, "good")))
    if args.live:
        return run_live(spark, args, config, table)
    # a stored copy and a stream have tables of their own, so that one run leaves nothing in the other's image
    place = f"{args.out}/{'stream' if args.stream else 'stored'}"
    progress = image_stream.Progress() if args.stream else None
    began = time.perf_counter()
    if args.stream:
        raw = messages.log_stream(spark, args.messages, f"{args.out}/progress", args.bytes_per_trigger) if args.log else messages.message_stream(spark, args.messages, args.files_per_trigger)
        batches = image_stream.run_sums(raw, table, config, place, f"{args.out}/checkpoint", args.verify_all, progress, once=not args.log)
    else:
        raw = messages.message_log(spark, args.messages) if args.log else messages.message_table(spark, args.messages)
        batches = [{"batch": 0, **image_stream.write_batch(raw, 0, table, config, place, args.verify_all)}]
    elapsed = time.perf_counter() - began
    passed = Observation("frames")
    counted = image_stream.passed_sums(spark, place).observe(passed, F.count(F.lit(1)).alias("frames"), F.count("s").alias("decoded"), F.count("error").alias("decode_errors"))
    images = image.run_grids(counted, image_stream.runs(spark, place), config)
    images.write.mode("overwrite").partitionBy("run_seq").parquet(f"{args.out}/image")
    image_stream.quarantine(spark, place).write.mode("overwrite").parquet(f"{args.out}/quarantine")
    if args.npy:
        npy.write_images(spark.read.parquet(f"{args.out}/image"), args.npy, config)
    return report({k: v or 0 for k, v in passed.get.items()}, batches, config, elapsed, progress.batches if progress else None)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--messages", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--scan", type=int, nargs=2)
    for name in ("gain", "good", "npy"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--files-per-trigger", type=int, default=8)
    parser.add_argument("--bytes-per-trigger", type=int, default=messages.BYTES_PER_TRIGGER)
    parser.add_argument("--delay", type=int, default=held_gate.DELAY)
    for name in ("binned", "verify-all", "stream", "log", "live"):
        parser.add_argument(f"--{name}", action="store_true")
    return parser.parse_args(given)


if __name__ == "__main__":
    print(json.dumps(run(SparkSession.builder.appName("virtual image").getOrCreate(), arguments())))
