"""The job from messages to images: tables, streams and logs, several runs, odd messages, and what is reported."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweir.functions import cbor, messages
from pixelweir.functions.config import BINNED, ScanConfig
from pixelweir.jobs import run_image
from pixelweir.operators import decode, image, weights
from pixelweir.streaming import image_stream

SMALL = ScanConfig(detector=(8, 8), scan=(2, 3), centre=(4.0, 4.0), radius=3.0)


def log_of(raws):
    return b"".join(len(r).to_bytes(4, "big") + r for r in raws)


def table(spark, rows, path, files=1):
    """Files in order of seq, one after the other, as a stream brings them."""
    rows = sorted(rows)
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame([(s, bytearray(r)) for s, r in part], "seq long, raw binary").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("stream", [False, True])
def test_job(spark, tmp_path, stream):
    rng = np.random.default_rng(4)
    frames = [rng.poisson(0.5, BINNED.detector).astype("<u4") for _ in range(5)]
    start = cbor.dumps({"type": "start", "image_size_y": 96, "image_size_x": 96, "number_of_images": 6})
    rows = [(1, start), *((k + 2, messages.frame_message(k, f)) for k, f in enumerate(frames)), (7, messages.frame_message(4, frames[0])), (8, messages.frame_message(3, frames[3])[:-9]), (9, cbor.dumps({"type": "end"}))]
    rows += [(0, messages.frame_message(5, frames[0])), (10, messages.frame_message(5, frames[0]))]  # before the start, after the end
    rows += [(11, b"\xa1\x61"), (12, cbor.dumps({"type": "start", "image_size_y": 192, "image_size_x": 192}))]  # not readable; a later start counts for nothing
    table(spark, rows, f"{tmp_path}/in", files=4)
    good = np.ones(BINNED.detector)
    good[48, 40:50] = 0
    np.save(tmp_path / "good.npy", good)
    given = ["--messages", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--binned", "--scan", "2", "3", "--good", f"{tmp_path}/good.npy", "--npy", f"{tmp_path}/image.npy", "--files-per-trigger", "1"]
    found = run_image.run(spark, run_image.arguments(given + ["--stream"] * stream))
    y, x = np.mgrid[:96, :96]
    w = ((y - 48.0) ** 2 + (x - 48.0) ** 2 <= 15**2) * good
    sums = [float((f * w).sum()) for f in frames]
    assert np.load(tmp_path / "image.npy").reshape(-1).tolist() == [*sums[:4], sums[0], 0.0]
    assert (found["received"], found["unreadable"], found["frames"], found["decoded"], found["decode_errors"]) == (13, 2, 6, 6, 0)
    bad = spark.read.parquet(f"{tmp_path}/out/quarantine").collect()
    assert {r["seq"] for r in bad} == {8, 11}
    assert found["realtime_factor"] > 0
    assert all(found["stage_s"][k] > 0 for k in ("parse", "inflate", "unshuffle", "sum"))
    # what the jobs counted is what the table holds
    rows = image_stream.table_of(spark, f"{tmp_path}/out/{'stream' if stream else 'stored'}")
    sizes = [r["count"] for r in rows.groupBy("batch").count().collect()]
    assert (found["received"], found["batches"]) == (sum(sizes), len(sizes))
    if stream:
        assert len(sizes) == 4
        assert (found["batch_rows_max"], found["batch_rows_avg"]) == (max(sizes), sum(sizes) / len(sizes))
        assert found["phase_ms"]["triggerExecution"] > 0


def test_job_stops_on_another_detector(spark, tmp_path):
    table(spark, [(1, cbor.dumps({"type": "start", "image_size_y": 192, "image_size_x": 192}))], f"{tmp_path}/in")
    with pytest.raises(ValueError, match="detector shape"):
        run_image.run(spark, run_image.arguments(["--messages", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--binned"]))


def test_progress_tells_every_batch(spark, tmp_path):
    table(spark, [(k, cbor.dumps({"type": "other"})) for k in range(42)], f"{tmp_path}/in", files=4)
    said = []
    for go in range(3):
        progress = image_stream.Progress(said.append)
        from pixelweir.sources.messages import message_stream

        counted = image_stream.run_sums(message_stream(spark, f"{tmp_path}/in", 1), [1.0] * 64, SMALL, f"{tmp_path}/{go}/sums", f"{tmp_path}/{go}/checkpoint", listener=progress)
        assert progress.messages == 42
        assert [b["rows"] for b in progress.batches] == [c["received"] for c in counted]
        assert [b["batch"] for b in progress.batches] == list(range(4))


# --- runs by order of arrival


def plain_gate(rows):
    """The messages (seq, series, type) that pass, one after the other: a run opens with the first start of its series (None: a start without one)."""
    begun, ended, last, passed = {}, set(), None, []
    for seq, series, kind in sorted(rows):
        if kind == "start":
            if series not in begun:
                begun[series], last = seq, series
            continue
        if series is not None and series in begun:
            run = series
        elif begun and (series is None or last is None):
            run = last
        else:
            continue
        if run in ended:
            continue
        if kind == "end":
            ended.add(run)
        elif kind == "image":
            passed.append((seq, begun[run]))
    return passed


@pytest.mark.parametrize("width", [3, 1000])
def test_gate_equals_the_plain_one(spark, width):
    import random

    from pixelweir.operators import series

    random.seed(width)
    for trial in range(3):
        ids = [[None, 1, 2, 3], [1, 2, None, None, None], [1, 2, 3]][trial]
        rows = [(seq * 7, random.choice(ids), random.choices(["image", "start", "end", "other"], [12, 2, 1, 1])[0]) for seq in range(300)]
        df = spark.createDataFrame(rows, "seq long, series long, type string").repartition(3)
        got = sorted((r["seq"], r["run_seq"]) for r in series.gated(df, width).collect())
        assert got == plain_gate(rows)


def small_weights(spark):
    return image.weight_array(weights.weight_map(weights.pixel_grid(spark, SMALL), SMALL))


def frame(k, value, **more):
    return messages.frame_message(k, np.full((8, 8), value, "<u2"), block_size=48, **more)


START = {"type": "start", "image_size_y": 8, "image_size_x": 8, "number_of_images": 6}
END = cbor.dumps({"type": "end"})
#: A documented capture: the end names no series, some frames don't either; then a second run, and frames that are late.
CAPTURE = [
    frame(5, 7, series_id=1), cbor.dumps(START | {"series_id": 1}), frame(0, 1, series_id=1), frame(1, 2), frame(1, 3), cbor.dumps(START | {"series_id": 1, "image_size_y": 9}), END, frame(0, 9, series_id=1), frame(2, 9),
    cbor.dumps(START | {"series_id": 2}), frame(0, 4), frame(3, 5, series_id=2), frame(4, 9, series_id=3), frame(2, 9, series_id=1), b"\xa1", END, frame(5, 9),
]
AREA = 29  # pixels of the disk


def expected_images():
    one, two = [0.0] * 6, [0.0] * 6
    one[0], one[1], two[0], two[3] = 1.0 * AREA, 3.0 * AREA, 4.0 * AREA, 5.0 * AREA
    return {1: one, 2: two}


def images_of(df):
    out = {}
    for r in df.orderBy("scan_y", "scan_x").collect():
        out.setdefault(r["series"], []).append(r["s"])
        assert r["visited"] == (r["s"] > 0)
    return out


@pytest.mark.parametrize("way", ["stored", "stream", "log", "log-stream"])
def test_runs_by_order_of_arrival(spark, tmp_path, monkeypatch, way):
    monkeypatch.setattr(run_image, "BINNED", SMALL)
    if "log" in way:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.log").write_bytes(log_of(CAPTURE[:7]))
        (tmp_path / "in" / "b.log").write_bytes(log_of(CAPTURE[7:]))
    else:
        table(spark, list(enumerate(CAPTURE)), f"{tmp_path}/in", files=5)
    given = ["--messages", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--binned", "--npy", f"{tmp_path}/image.npy", "--files-per-trigger", "1", "--bytes-per-trigger", "300"]
    found = run_image.run(spark, run_image.arguments(given + ["--stream"] * ("stream" in way) + ["--log"] * ("log" in way)))
    assert images_of(spark.read.parquet(f"{tmp_path}/out/image")) == expected_images()
    assert (found["received"], found["unreadable"], found["frames"], found["decoded"], found["decode_errors"]) == (len(CAPTURE), 1, 5, 5, 0)
    assert found["batches"] > 2 or "stream" not in way
    if way == "log-stream":  # what was left when each batch was admitted
        batches = image_stream.table_of(spark, f"{tmp_path}/out/stream").groupBy("batch").count().orderBy("batch").collect()
        sizes, left, at = [len(r) + 4 for r in CAPTURE], [], 0
        for r in batches:
            at += r["count"]
            left.append(sum(sizes[at:]))
        assert left[-1] == 0
        assert (found["backlog_bytes_avg"], found["backlog_bytes_max"]) == (sum(left) / len(left), max(left))
    assert {p.name for p in tmp_path.glob("*.npy")} == {"image-1.npy", "image-2.npy"}
    assert not list(tmp_path.glob(".image*"))
    for series, values in expected_images().items():
        assert np.load(tmp_path / f"image-{series}.npy").reshape(-1).tolist() == values


def test_snapshot_refuses_several_runs(spark, tmp_path):
    raw = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(CAPTURE)], "seq long, raw binary")
    image_stream.write_batch(raw, 0, small_weights(spark), SMALL, f"{tmp_path}/sums")
    assert images_of(image_stream.images(spark, f"{tmp_path}/sums", SMALL)) == expected_images()
    with pytest.raises(ValueError, match="several runs"):
        image_stream.snapshot(spark, f"{tmp_path}/sums", SMALL)


def test_failed_image_leaves_no_file(spark, tmp_path):
    from pixelweir.sources import npy

    bad = spark.createDataFrame([(1, 1, 0, 0, 1.0), (1, 1, 99, 0, 1.0)], "run_seq long, series long, scan_y int, scan_x int, s double")
    with pytest.raises(Exception, match="99"):
        npy.write_images(bad, f"{tmp_path}/image.npy", SMALL)
    assert list(tmp_path.iterdir()) == []
    assert npy.write_images(bad.limit(0), f"{tmp_path}/image.npy", SMALL) == []


# --- odd fields

BIG = 1 << 63


def odd(**changes):
    shape, algorithm, size = changes.pop("shape", [8, 8]), changes.pop("algorithm", "bslz4"), changes.pop("size", 2)
    good = cbor.loads(frame(0, 1))
    tag = good["data"]["threshold_1"]
    body = tag.value[1]
    data = cbor.Tag(40, [shape, cbor.Tag(body.number, cbor.Tag(56500, [algorithm, size, body.value.value[2]]))])
    return cbor.dumps({"type": "image", "image_id": 0, "series_id": 1} | changes | {"data": {"threshold_1": data}})


ODD = {
    "series text": odd(series_id="a"), "series large": odd(series_id=BIG), "id large": odd(image_id=BIG), "id text": odd(image_id="x"), "id infinite": odd(image_id=float("inf")), "id list": odd(image_id=[1]), "shape large": odd(shape=[1 << 31, 1]),
    "shape of truth": odd(shape=[True, 64]), "algorithm number": odd(algorithm=5), "size text": odd(size="2"), "size large": odd(size=1 << 40), "size list": odd(size=[2]),
    "start rows text": cbor.dumps(START | {"image_size_y": "8"}), "start rows large": cbor.dumps(START | {"image_size_x": 1 << 40}), "start images float": cbor.dumps(START | {"number_of_images": 1.5}), "start series list": cbor.dumps(START | {"series_id": [1]}),
    "end series text": cbor.dumps({"type": "end", "series_id": "x"}), "type number": cbor.dumps({"type": 5}), "no map": cbor.dumps([1]), "empty": b"",
    "data bytes": cbor.dumps({"type": "image", "image_id": 0, "data": {"a": b"xx"}}), "content number": cbor.dumps({"type": "image", "image_id": 0, "data": {"a": cbor.Tag(40, [[8, 8], cbor.Tag(69, 5)])}}),
    "content list": cbor.dumps({"type": "image", "image_id": 0, "data": {"a": cbor.Tag(40, [[8, 8], cbor.Tag(69, [1, 2])])}}), "dimensions number": cbor.dumps({"type": "image", "image_id": 0, "data": {"a": cbor.Tag(40, 7)}}),
}


def test_odd_fields_lose_their_own_message_only(spark):
    rows = [(0, cbor.dumps(START | {"series_id": 1})), *((k + 1, r) for k, r in enumerate(ODD.values())), (100, frame(2, 6, series_id=1))]
    raw = spark.createDataFrame([(s, bytearray(r)) for s, r in rows], "seq long, raw binary")
    got = {r["seq"]: r for r in decode.decoded_rows(raw, small_weights(spark), SMALL).collect()}
    for k, name in enumerate(ODD):
        row = got[k + 1]
        assert row["error"], name
        assert row["s"] is None, name
        assert (row["type"] is None) == (name.startswith("start") or name in ("type number", "no map", "empty")), name
    assert got[100]["s"] == 6.0 * AREA
    assert {r["seq"] for r in decode.quarantine(decode.envelopes(raw)).collect()} <= set(range(1, len(ODD) + 1))


def test_odd_fields_in_a_stream(spark, tmp_path):
    from pixelweir.sources.messages import message_stream

    ends = [r for name, r in ODD.items() if name.startswith("end")]  # an end is one whatever else it says
    others = [r for r in ODD.values() if r not in ends]
    rows = [(0, cbor.dumps(START | {"series_id": 1})), *((k + 1, r) for k, r in enumerate(others)), (100, frame(2, 6)), *((101 + k, r) for k, r in enumerate(ends)), (110, frame(3, 6))]
    table(spark, rows, f"{tmp_path}/in", files=3)
    image_stream.run_sums(message_stream(spark, f"{tmp_path}/in", 1), small_weights(spark), SMALL, f"{tmp_path}/sums", f"{tmp_path}/checkpoint")
    assert image_stream.quarantine(spark, f"{tmp_path}/sums").count() == len(ODD)
    assert [r["s"] for r in image_stream.snapshot(spark, f"{tmp_path}/sums", SMALL).orderBy("scan_y", "scan_x").collect()] == [0, 0, 6.0 * AREA, 0, 0, 0]


# --- logs


def test_log_is_read_by_ranges(spark, tmp_path):
    from pixelweir.sources import messages as sources

    bodies = [bytes([k % 251]) * (k % 700) for k in range(3000)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "b.log").write_bytes(log_of(bodies) + b"\0\0\0\x09cut")
    (tmp_path / "logs" / "a.log").write_bytes(log_of([b"first"]) + b"\0\0")
    (tmp_path / "logs" / "empty.log").write_bytes(b"")
    ranges = sources.log_ranges(spark, f"{tmp_path}/logs", 50_000).collect()
    assert len(ranges) > 15
    assert max(r["ends"] - r["begins"] for r in ranges) < 50_000 + 704
    for index in (None, f"{tmp_path}/index"):
        for _ in range(2):
            found = sources.message_log(spark, f"{tmp_path}/logs", 50_000, index)
            assert [bytes(r["raw"]) for r in found.orderBy("seq").collect()] == [b"first", b"\0\0", *bodies, b"cut"]
    (tmp_path / "logs" / "a.log").write_bytes(log_of([b"first", b"second"]))
    assert [bytes(r["raw"]) for r in sources.message_log(spark, f"{tmp_path}/logs", 50_000, f"{tmp_path}/index").orderBy("seq").limit(3).collect()] == [b"first", b"second", bodies[0]]


def test_large_log_is_planned_as_many_ranges(tmp_path):
    """A log of over 2 GB (a sparse file of a few long messages): only lengths are read."""
    from pixelweir.sources import log_files

    size, n = 300 << 20, 9
    with open(tmp_path / "big.log", "wb") as f:
        for k in range(n):
            f.seek(k * (size + 4))
            f.write(size.to_bytes(4, "big"))
        f.truncate(n * (size + 4))
    found = log_files.ranges(f"{tmp_path}/big.log", n * (size + 4), 64 << 20)
    assert [(first, begins) for first, begins, _ in found] == [(k, k * (size + 4)) for k in range(n)]


def test_growing_log_resumes_within_a_file(spark, tmp_path):
    from pixelweir.sources import messages as sources

    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs" / "a.log"
    bodies = [f"{k}:".encode() * 20 for k in range(400)]
    log.write_bytes(log_of(bodies[:200]) + log_of(bodies[200:201])[:7])  # the last one is not whole yet
    sizes, fail = [], [3]

    def batch(df, number):
        rows = df.collect()
        if fail and number == fail[0]:
            fail.clear()
            raise RuntimeError("lost")
        sizes.append(sum(len(r["raw"]) + 4 for r in rows))
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    def go():
        stream = sources.log_stream(spark, f"{tmp_path}/logs", f"{tmp_path}/progress", bytes_per_trigger=2000, range_bytes=700)
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost"):
        go()
    go()
    assert max(sizes) <= 2000
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
    log.write_bytes(log_of(bodies))
    (tmp_path / "logs" / "0.log").write_bytes(log_of([b"later file"]))
    go()
    found = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").select("seq", "raw").collect()
    assert [bytes(r["raw"]) for r in found] == [*bodies, b"later file"]
    assert len({r["seq"] for r in found}) == 401


# --- ranges


def test_ranges_hold_equal_numbers_of_rows(spark):
    from pixelweir.operators.ranking import in_ranges, mixed

    df = spark.range(20_000).select((F.col("id") * F.col("id") * F.col("id")).alias("sparse"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"), "id")
    df = df.withColumn("tie", mixed(df))
    for order in (["sparse"], ["half", "tie"]):
        found = in_ranges(df, order, "range", width=50)
        sizes = [r["count"] for r in found.groupBy("range").count().collect()]
        assert len(sizes) > 300
        assert max(sizes) < 250
        assert sum(sizes) == 20_000
        edges = found.groupBy("range").agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).orderBy("range").collect()
        key = lambda r: tuple((x is not None, x) for x in r)
        assert all(key(a["high"]) < key(b["low"]) for a, b in zip(edges, edges[1:], strict=False))


def test_carried_values_cross_ranges(spark):
    from pixelweir.operators.ranking import carried

    rows = [(k * k, k if k in (40, 41, 700) else None) for k in range(1000)]
    got = carried(spark.createDataFrame(rows, "at long, v long").repartition(3), "at", F.col("v"), "last", width=20).collect()
    assert {r["at"]: r["last"] for r in got} == {k * k: None if k <= 40 else 40 if k == 41 else 41 if k <= 700 else 700 for k in range(1000)}


def test_split_join_of_hot_and_null_keys(spark, monkeypatch):
    from pixelweir.operators import ranking

    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ranking, "HOT_KEYS", 10)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(spark.createDataFrame([(7, 70)], "k long, v long"))
    for how in ("inner", "left"):
        got = sorted(ranking.split_join(left, right, "k", how).select("id", "v").collect(), key=repr)
        assert got == sorted(left.join(right, "k", how).select("id", "v").collect(), key=repr)
