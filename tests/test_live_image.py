"""The gate that holds messages back, and images that are added to."""

import random

import pyarrow as pa
import pytest

from pixelweir.functions import cbor
from pixelweir.streaming import held_gate, live_image
from tests.test_run_image import CAPTURE, SMALL, START, expected_images, frame, images_of, plain_gate, small_weights

STORE = "spark.sql.streaming.stateStore.providerClass"
NARROW = "seq long, series long, type string, image_id long, s double, error string"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, held_gate.ROCKS)
    yield spark
    spark.conf.set(STORE, before)


def files(spark, rows, schema, path, n):
    for k in range(n):
        spark.createDataFrame(rows[len(rows) * k // n : len(rows) * (k + 1) // n], schema).coalesce(1).write.mode("append").parquet(path)


def test_shuffled_batches_give_the_plain_gate(rocks, tmp_path):
    random.seed(2)
    kinds = random.choices(["image", "start", "end", "other"], [30, 2, 1, 1], k=300)
    rows = [(seq, random.choice([None, 1, 2, 3]), kind, seq, float(seq), None) for seq, kind in enumerate(kinds)]
    shuffled = sorted(rows, key=lambda r: r[0] + random.random() * 60)
    files(rocks, [*shuffled, (1000, None, "other", None, None, None), (2000, None, "image", 7, 7.0, None)], NARROW, f"{tmp_path}/in", 5)
    stream = rocks.readStream.schema(NARROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = held_gate.held_gate(stream, 200, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = rocks.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["seq"], r["run_seq"]) for r in got) == plain_gate([r[:3] for r in rows])
    assert len(got) > 30
    assert all(r["s"] == r["image_id"] == r["seq"] for r in got)
    # nothing is held but the message that nothing has come after
    assert [r["list_element"]["seq"] for r in rocks.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/checkpoint").collect()] == [2000]


def test_state_holds_packs_over_a_restart(rocks, tmp_path):
    """Held messages lie in few large state entries; a query that goes on from them decides as the plain gate does."""
    random.seed(3)
    kinds = random.choices(["image", "start", "end"], [30, 1, 1], k=5000)
    rows = [(seq, random.choice([None, *range(80)]), kind, seq, float(seq), None) for seq, kind in enumerate(kinds)]

    def run():
        stream = rocks.readStream.schema(NARROW).parquet(f"{tmp_path}/in")
        held_gate.held_gate(stream, 10_000, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return rocks.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/checkpoint")

    files(rocks, random.sample(rows, len(rows)), NARROW, f"{tmp_path}/in", 4)
    assert 0 < run().count() <= 4 * 3
    files(rocks, [(20_000, None, "image", 7, 7.0, None)], NARROW, f"{tmp_path}/in", 1)
    assert [r["list_element"]["seq"] for r in run().collect()] == [20_000]
    got = sorted((r["seq"], r["run_seq"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
    assert got == plain_gate([r[:3] for r in rows])
    assert len(got) > 1000


@pytest.mark.parametrize("ids", [[None, 1, 2, 3], [1, 2, None, None, None], [1, 2, 3], [None]])
def test_gate_on_arrays_equals_the_plain_one(ids):
    """Whatever parts of a stream the watermark lets through together."""
    random.seed(len(ids))
    rows = [(seq * 7 - 500, random.choice(ids), random.choices(["image", "start", "end"], [12, 2, 1])[0]) for seq in range(400)]
    schema = pa.schema([("seq", pa.int64()), ("series", pa.int64()), ("kind", pa.int8()), ("image_id", pa.int64()), ("s", pa.float64()), ("error", pa.string())])
    for parts in (1, 3, 400):
        runs, got = held_gate.Runs.read(None), []
        for k in range(parts):
            some = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
            ready = [(seq, series, held_gate.KINDS.index(kind), 1 << 60, None, "broken") for seq, series, kind in random.sample(some, len(some))]
            runs, out = held_gate.decided(held_gate.Runs.read(runs.bytes()), pa.table([pa.array(x, f.type) for x, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema))
            got += out.to_pylist()
        assert sorted((r["seq"], r["run_seq"]) for r in got) == plain_gate(rows)
        assert all((r["image_id"], r["s"], r["error"]) == (1 << 60, None, "broken") for r in got)
        opened = {r[0]: r[1] for r in rows if r[2] == "start"}
        assert all(r["series"] == opened[r["run_seq"]] for r in got)


def test_late_messages_are_left_out(rocks, tmp_path):
    rows = [(0, 1, "start", None, None, None), (1, 1, "image", 0, 1.0, None), (500, 1, "image", 1, 2.0, None), (2, 1, "image", 2, 3.0, None), (1000, 1, "image", 3, 4.0, None)]
    files(rocks, rows, NARROW, f"{tmp_path}/in", 5)
    stream = rocks.readStream.schema(NARROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held_gate.held_gate(stream, 100, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["seq"] for r in rocks.read.parquet(f"{tmp_path}/out").collect()) == [1, 500]


def test_live_image_of_shuffled_batches(rocks, tmp_path):
    random.seed(5)
    rows = list(enumerate(bytearray(r) for r in [*CAPTURE, frame(1, 3)[:-4]]))
    random.shuffle(rows)
    tick = [(1000, bytearray(cbor.dumps({"type": "tick"}))), (2000, bytearray(cbor.dumps(START)))]
    files(rocks, rows + tick, "seq long, raw binary", f"{tmp_path}/in", 5)
    for _ in range(2):  # a second call finds nothing new
        stream = rocks.readStream.schema("seq long, raw binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live_image.run_live(stream, small_weights(rocks), SMALL, f"{tmp_path}/image", f"{tmp_path}/checkpoint", delay=100, shards=2, compact=3)
    assert images_of(live_image.live_images(rocks, f"{tmp_path}/image", SMALL)) == expected_images()
    assert live_image.quarantine(rocks, f"{tmp_path}/image").count() == 0  # the cut message cannot be read, so it is of no run


def test_snapshots_read_a_bounded_number_of_rows(spark, tmp_path):
    """After any batch an image is read from one base and fewer than `compact` deltas; a batch that runs again changes nothing."""
    random.seed(1)
    place, latest = f"{tmp_path}/image", {}
    schema = "run_seq long, series long, seq long, image_id long, s double, error string"
    for n in range(12):
        rows = [(0, 1, n * 10 + k, random.randrange(6), float(n * 10 + k), None) for k in range(10)] + [(0, 1, n * 10, 3, None, "broken")]
        random.shuffle(rows)
        for _ in range(2 if n in (3, 4) else 1):
            live_image.add_batch(spark.createDataFrame(rows, schema), n, place, compact=4)
        latest |= {r[3]: r[4] for r in sorted(rows, key=lambda r: r[2]) if r[4] is not None}
        found = live_image.pieces(spark, place)
        assert len(found) <= 4
        assert spark.read.parquet(*found).count() <= 6 * 4
        assert {r["image_id"]: r["s"] for r in live_image.sums(spark, place).collect()} == latest
    assert live_image.quarantine(spark, place).count() == 12
    grid = live_image.live_images(spark, place, SMALL)
    assert {r["scan_y"] * 3 + r["scan_x"]: r["s"] for r in grid.collect()} == {k: latest.get(k, 0.0) for k in range(6)}


@pytest.mark.parametrize("log", [False, True])
def test_live_job(rocks, tmp_path, monkeypatch, log):
    from pixelweir.jobs import run_image

    monkeypatch.setattr(run_image, "BINNED", SMALL)
    rows = [*CAPTURE, *[cbor.dumps({"type": "tick"})] * 40, cbor.dumps(START)]
    if log:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.log").write_bytes(b"".join(len(r).to_bytes(4, "big") + r for r in rows))
    else:
        files(rocks, list(enumerate(map(bytearray, rows))), "seq long, raw binary", f"{tmp_path}/in", 2)
    given = ["--messages", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--binned", "--stream", "--live", "--delay", "20", "--npy", f"{tmp_path}/image.npy", "--bytes-per-trigger", "2000"]
    found = run_image.run(rocks, run_image.arguments(given + ["--log"] * log))
    assert images_of(rocks.read.parquet(f"{tmp_path}/out/image")) == expected_images()
    assert (found["positions"], found["decode_errors"]) == (4, 0)
    assert {p.name for p in tmp_path.glob("*.npy")} == {"image-1.npy", "image-2.npy"}
