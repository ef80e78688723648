"""Gate, chunks, ranks, masks, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweir.functions.config import ScanConfig
from pixelweir.operators import decode, image, series, weights
from pixelweir.operators.ranking import running
from pixelweir.sources import encode, messages
from pixelweir.streaming import image_stream

CONFIG = ScanConfig(detector=(8, 8), scan=(2, 3), centre=(4.0, 4.0), radius=3.0)


def table(spark, rows):
    return spark.createDataFrame(rows, "series long, seq long, type string")


MESSAGES = [
    (1, 0, "image"), (1, 1, "start"), (1, 2, "image"), (1, 3, "start"), (1, 4, "image"), (1, 5, "other"), (1, 6, "end"), (1, 7, "image"), (1, 8, "end"),
    (2, 0, "end"), (2, 1, "start"), (2, 2, "image"), (3, 0, "image"), (None, 0, "start"), (None, 1, "image"),
]


def test_gate(spark):
    got = {(r["series"], r["seq"]) for r in series.gated(table(spark, MESSAGES)).collect()}
    assert got == {(1, 2), (1, 4), (2, 2), (None, 1)}  # a start without a series begins a run too
    assert series.gated(table(spark, [])).count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_stream_gate_equals_gate(spark, tmp_path, files):
    rows = [r for r in MESSAGES if r[0] is not None]
    for k in range(files):
        part = [r for r in rows if r[1] * files // 9 == k]
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series long, seq long, type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    image_stream.run_gate(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {(r["series"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 2), (1, 4), (2, 2)}


def test_start_errors(spark):
    rows = [(8, 8, 6, None), (8, 8, 7, "too many images"), (9, 8, 1, "detector shape"), (None, 9, 6, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "y int, x int, n long, expected string")
    for r in df.select("expected", series.start_errors(F.col("y"), F.col("x"), F.col("n"), CONFIG).alias("got")).collect():
        assert r["got"] == r["expected"]


def test_running_sums_across_ranges(spark):
    rows = [(k % 2, k, k * 3 if k != 7 else None) for k in range(-20, 60)] + [(None, 5, 1), (1, None, 4)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = {(r["g"], r["o"]): r["s"] for r in running(df, "o", "s", "v", by="g", width=7).collect()}
    for g, o, _ in rows:
        low = -(10**9) if o is None else o
        assert got[g, o] == sum(v or 0 for g2, o2, v in rows if g2 == g and (-(10**9) if o2 is None else o2) < low)
    whole = [r["s"] for r in running(df.where("o IS NOT NULL AND g IS NOT NULL"), "o", "s", width=7).orderBy("o").collect()]
    assert whole == list(range(80))


def test_chunks_close_and_flush(spark):
    df = spark.createDataFrame([(1, k * 10) for k in range(10)], "series long, seq long")
    sizes = [r["count"] for r in series.chunks(df, 4).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [4, 4, 2]


def test_grid_fills_and_ignores_outside(spark):
    sums = spark.createDataFrame([(0, 1.5), (5, 2.0), (99, 7.0), (-1, 3.0)], "image_id long, s double")
    seen = spark.createDataFrame([(0,), (5,), (2,), (99,), (-1,)], "image_id long")
    got = {(r["scan_y"], r["scan_x"]): (r["s"], r["visited"]) for r in image.grid(sums, seen, CONFIG).collect()}
    assert got == {(0, 0): (1.5, True), (0, 1): (0.0, False), (0, 2): (0.0, True), (1, 0): (0.0, False), (1, 1): (0.0, False), (1, 2): (2.0, True)}
    assert {r["image_id"] for r in image.out_of_range(seen, CONFIG).collect()} == {99, -1}


def test_last_write_wins(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 9, 2.0), (1, 7, 3.0)], "image_id long, seq long, s double")
    assert image.last_wins(df).collect()[0]["s"] == 2.0


def test_dense_sum_refuses_other_lengths(spark):
    df = spark.createDataFrame([([1, 2],), ([1],), (None,)], "f array<int>")
    got = [r["s"] for r in df.select(image.dense_sum(F.col("f"), F.array(F.lit(0.5), F.lit(2.0))).alias("s")).collect()]
    assert got == [4.5, None, None]


def test_masks(spark, tmp_path):
    mask = np.ones((8, 8), np.float32)
    mask[4, 4] = 0
    np.save(tmp_path / "good.npy", mask)
    good = weights.load_mask(spark, f"{tmp_path}/good.npy", CONFIG, "good")
    w = weights.weight_map(weights.pixel_grid(spark, CONFIG), CONFIG, good=good)
    plain = weights.weight_map(weights.pixel_grid(spark, CONFIG), CONFIG, gain=weights.load_mask(spark, f"{tmp_path}/none.npy", CONFIG, "gain"))
    assert w.where("w = 1").count() == plain.where("w = 1").count() - 1
    np.save(tmp_path / "bad.npy", np.ones((4, 4)))
    with pytest.raises(ValueError, match="shape"):
        weights.load_mask(spark, f"{tmp_path}/bad.npy", CONFIG, "gain")
    assert weights.outside_detector(spark.createDataFrame([(9, 0, 1.0), (0, 0, 1.0)], "y int, x int, gain double"), CONFIG).count() == 1


def sent(spark, path, n=6, last=None, files=3):
    frames = spark.range(n).select((F.col("id") + 1).alias("seq"), F.col("id").alias("image_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: (p + F.col("id")).cast("long")).alias("frame"))
    images = encode.encode_frames(frames, CONFIG, "<u2", block_size=48)
    encode.with_bounds(images, CONFIG, n + 1).repartition(files, "seq").write.parquet(path)


def test_stream_image_any_split(spark, tmp_path):
    ws = image.weight_array(weights.weight_map(weights.pixel_grid(spark, CONFIG), CONFIG))
    results = []
    for files in (1, 4):
        base = f"{tmp_path}/{files}"
        sent(spark, f"{base}/in", files=files)
        for _ in range(2):  # a restart from the checkpoint adds nothing
            image_stream.run_sums(messages.message_stream(spark, f"{base}/in", 1), ws, CONFIG, f"{base}/sums", f"{base}/checkpoint")
        results.append(sorted(map(tuple, image_stream.snapshot(spark, f"{base}/sums", CONFIG).collect())))
    w = np.array(ws)
    assert results[0] == results[1] == [(k // 3, k % 3, float(((np.arange(1, 65) + k) * w).sum()), True) for k in range(6)]


def test_stream_image_skips_frames_outside_the_gate(spark, tmp_path):
    ws = image.weight_array(weights.weight_map(weights.pixel_grid(spark, CONFIG), CONFIG))
    sent(spark, f"{tmp_path}/in")
    stray = spark.createDataFrame([(-5, 1), (20, 0), (21, 7)], "seq long, image_id long").withColumn("frame", F.array_repeat(F.lit(9).cast("long"), 64))
    encode.encode_frames(stray, CONFIG, "<u2", block_size=48).write.mode("append").parquet(f"{tmp_path}/in")
    image_stream.run_sums(messages.message_stream(spark, f"{tmp_path}/in", 1), ws, CONFIG, f"{tmp_path}/sums", f"{tmp_path}/checkpoint")
    got = sorted(map(tuple, image_stream.snapshot(spark, f"{tmp_path}/sums", CONFIG).collect()))
    w = np.array(ws)
    assert got == [(k // 3, k % 3, float(((np.arange(1, 65) + k) * w).sum()), True) for k in range(6)]
    assert image_stream.passed_sums(spark, f"{tmp_path}/sums").count() == 6


def test_stream_stops_on_a_start_that_does_not_fit(spark, tmp_path):
    sent(spark, f"{tmp_path}/in")
    other = CONFIG.with_(detector=(4, 4))
    with pytest.raises(Exception, match="detector shape"):
        image_stream.run_sums(messages.message_stream(spark, f"{tmp_path}/in"), [1.0] * 16, other, f"{tmp_path}/sums", f"{tmp_path}/checkpoint")


def test_message_log(spark, tmp_path):
    parts = [b"abc", b"", b"x" * 300]
    (tmp_path / "a.log").write_bytes(b"".join(len(p).to_bytes(4, "big") + p for p in parts) + b"\0\0\0\x09cut")
    got = [bytes(r["raw"]) for r in messages.message_log(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [*parts, b"cut"]
    assert decode.quarantine(decode.envelopes(messages.message_log(spark, str(tmp_path)).where("seq = 3"))).count() == 1
    (tmp_path / "a.log").write_bytes(b"".join(len(p).to_bytes(4, "big") + p for p in [b"m"] * 600))
    assert [r["seq"] for r in messages.message_log(spark, str(tmp_path)).orderBy("seq").collect()] == list(range(600))


def test_capture_encodes_each_frame_once(spark, sf_dir, tmp_path):
    """Of all copies of a frame the hits are gathered once, and the start needs none of them."""
    from pixelweir.jobs import stream_queries

    start, raw, last, config = stream_queries.capture_parts(spark, sf_dir)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (start, raw, last)]
    assert [p.count("lineitem") + p.count("Relation [l_") for p in plans] == [0, 1, 0]
    assert [p.count("MapInArrow") for p in plans] == [0, 1, 0]
    assert start.count() == 1
    assert last.count() == 2
    frames = {r["image_id"] for r in stream_queries.hits(spark, sf_dir).select("image_id").distinct().collect()}
    assert raw.count() == len(frames) + 4 * len([k for k in frames if k % 50 == 0])
