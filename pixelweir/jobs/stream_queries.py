"""Queries that encode the given tables as detector messages, and decode or stream those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.functions.config import UNBINNED, ScanConfig
from pixelweir.jobs import image_queries
from pixelweir.jobs.image_queries import SMALL, _GATED, _SUMS, hits, small_weights
from pixelweir.operators import decode, image
from pixelweir.sources import encode, messages
from pixelweir.streaming import held_gate, image_stream

BLOCK = 96  # bytes: two full blocks and a short one for an 8 x 8 frame of four-byte pixels
#: Files that a capture is written to at least, images of a file, and bytes of a row group: small, so that a few files are read by many tasks.
FILES, FILE_IMAGES, ROW_GROUP = 16, 1 << 19, 4 << 20


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and raw: every order's hits as one compressed frame."""
    return encode.encode_hits(hits(spark, sf_dir), SMALL, block_size=BLOCK).select((F.col("image_id") + 1).alias("seq"), "raw")


def capture_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, ScanConfig]:
    """A whole stream of messages (seq, raw), and its scan: the start; the frames, every third without its series; an end that names none, and a second start with another detector.

    Before the start, after the end and in a series without a start there are frames of twice the counts; and every 50th frame is sent once more, cut off.
    """
    frames = hits(spark, sf_dir).where("image_id IS NOT NULL")
    config = image_queries.scan_for(frames).with_(detector=SMALL.detector)
    end, image_id = config.positions + 1, F.col("image_id")
    own = F.when(image_id % 3 != 0, encode.SERIES)
    copy = lambda seq, series, times, cut: F.struct(seq.alias("seq"), series.cast("long").alias("series"), F.lit(times).cast("long").alias("times"), F.lit(cut).alias("cut"))
    once = copy(image_id + 1, own, 1, 0)
    more = [copy(-1 - image_id, F.lit(encode.SERIES), 2, 0), copy(image_id + end + 2, F.lit(None), 2, 0), copy(image_id + 1, F.lit(7), 2, 0), copy(image_id + 1, own, 1, 5)]
    # all copies of a frame are made where its hits are gathered
    lists = encode.hit_lists(frames, SMALL, max(FILES, -(-config.positions // FILE_IMAGES)))
    copies = lists.withColumn("copy", F.explode(F.when(image_id % 50 == 0, F.array(once, *more)).otherwise(F.array(once))))
    told = copies.select("copy.seq", "copy.series", "image_id", "copy.cut", "p", F.transform("n", lambda n: n * F.col("copy.times")).alias("n"))
    raw = encode.encode_lists(told, SMALL, block_size=BLOCK).select("seq", F.expr("substring(raw, 1, length(raw) - cut)").alias("raw"))
    bounds = encode.with_bounds(spark.createDataFrame([], messages.SCHEMA), config, end)
    second = spark.createDataFrame([(end + 1, bytearray(encode.start_message(UNBINNED)))], messages.SCHEMA)
    return bounds.where("seq = 0"), raw, bounds.where("seq <> 0").union(second), config


def capture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ScanConfig]:
    """All messages (seq, raw) of the stream, and its scan."""
    start, raw, last, config = capture_parts(spark, sf_dir)
    return start.union(raw).union(last), config


def stream_capture(spark: SparkSession, sf_dir: str) -> tuple[str, ScanConfig]:
    """The table that a stream of message files, read to its end in micro-batches, has left."""
    start, raw, last, config = capture_parts(spark, sf_dir)
    folder = image_stream.work_folder(spark, "image-stream")
    # the start comes first, as a stream that began earlier would have it
    for part in (start.coalesce(1), raw, last.coalesce(1)):
        part.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/messages")
    ws = image.weight_array(small_weights(spark, sf_dir))
    image_stream.run_sums(messages.message_stream(spark, f"{folder}/messages"), ws, config, f"{folder}/sums", f"{folder}/checkpoint")
    return f"{folder}/sums", config


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, counts and a digest of each frame after encoding and decoding."""
    found = decode.frames(decode.envelopes(encoded(spark, sf_dir)))
    place = F.aggregate(F.transform("frame", lambda v, p: v.cast("long") * (p + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return found.select("image_id", F.size("frame").cast("long").alias("pixels"), F.aggregate("frame", F.lit(0.0), lambda a, v: a + v).cast("long").alias("counts"), place.alias("placed"), F.coalesce("error", F.lit("")).alias("error"))


def decoded_virtual_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image sums from compressed messages, decoded and summed in one pass."""
    sums = decode.decoded_sums(decode.envelopes(encoded(spark, sf_dir)), image.weight_array(small_weights(spark, sf_dir)), SMALL)
    return sums.where("error IS NULL AND s <> 0").select("image_id", "s")


def framing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, and the plain bytes that they stand for, of each frame's container."""
    found = decode.framing(decode.envelopes(encoded(spark, sf_dir)))
    return found.groupBy("image_id").agg(F.count("block_no").alias("blocks"), F.sum("plain_size").alias("plain_bytes"), F.min("begins").alias("first_offset"), F.count("error").alias("errors"))


def stream_virtual_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole image from a stream of message files, which also has frames outside the run, another start and cut messages."""
    place, config = stream_capture(spark, sf_dir)
    return image_stream.snapshot(spark, place, config)


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of the stored capture were refused, by reason, and how many frames were of the run."""
    raw, config = capture(spark, sf_dir)
    folder = image_stream.work_folder(spark, "capture")
    image_stream.write_batch(raw, 0, image.weight_array(small_weights(spark, sf_dir)), config, f"{folder}/sums")
    refused = image_stream.quarantine(spark, f"{folder}/sums").groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("messages"))
    passed = image_stream.passed_sums(spark, f"{folder}/sums").agg(F.lit("passed").alias("reason"), F.count("s").alias("messages"))
    return refused.union(passed)


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the start gate lets through, decided message by message with state."""
    folder = image_stream.work_folder(spark, "gate-stream")
    events = spark.readStream.schema("event_id long, user_id long, event_type string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("image")
    image_stream.run_gate(events.select(F.col("user_id").alias("series"), F.col("event_id").alias("seq"), kind.alias("type")), f"{folder}/passed", f"{folder}/checkpoint")
    return spark.read.schema("series long, seq long").parquet(f"{folder}/passed")


def stream_gate_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the start gate lets through when messages come up to a quarter of the stream late, in batches that overlap."""
    folder = image_stream.work_folder(spark, "held-gate")
    rows = image_queries.messages(spark, sf_dir).select("seq", "series", "type", F.lit(None).cast("long").alias("image_id"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("string").alias("error"))
    top = rows.agg(F.max("seq").alias("m")).first()["m"] or 0
    delay = top // 4 + 1
    late = F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(delay))
    # after all others comes a message that nothing belongs to, so that the last ones are decided on
    tick = spark.createDataFrame([(top + 2 * delay + 2, None, "image", None, None, None)], rows.schema)
    # few shards need few partitions of state
    shards = 4
    settings = {"spark.sql.streaming.stateStore.providerClass": held_gate.ROCKS, "spark.sql.shuffle.partitions": str(2 * shards)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # each part is written by as many tasks as read it, and is a batch of a query that goes on where the last one ended
        for k in range(4):
            part = rows.where(F.floor(late * 4 / (top + delay + 1)) == k)
            (part.union(tick) if k == 3 else part).write.mode("append").parquet(f"{folder}/messages")
            passed = held_gate.held_gate(spark.readStream.schema(rows.schema).parquet(f"{folder}/messages"), 2 * delay, shards)
            passed.writeStream.format("parquet").option("path", f"{folder}/passed").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema("run_seq long, series long, seq long").parquet(f"{folder}/passed").select("series", "seq")


QUERIES = {f.__name__: f for f in (decode_roundtrip, decoded_virtual_image, framing_blocks, stream_virtual_image, quarantine_counts, stream_gate, stream_gate_any_order)}

ORACLE_SQL = {
    "decode_roundtrip": """SELECT l_orderkey AS image_id, CAST(64 AS BIGINT) AS pixels, CAST(sum(l_quantity) AS BIGINT) AS counts,
  CAST(sum(l_quantity * ((l_partkey % 8) * 8 + l_suppkey % 8 + 1)) AS BIGINT) AS placed, '' AS error FROM lineitem GROUP BY 1""",
    "decoded_virtual_image": f"WITH {_SUMS} SELECT image_id, s FROM sums WHERE s <> 0",
    "framing_blocks": "SELECT l_orderkey AS image_id, CAST(3 AS BIGINT) AS blocks, CAST(256 AS BIGINT) AS plain_bytes, CAST(16 AS BIGINT) AS first_offset, CAST(0 AS BIGINT) AS errors FROM lineitem GROUP BY 1",
    "stream_virtual_image": image_queries.ORACLE_SQL["virtual_image_grid"],
    "quarantine_counts": """SELECT 'cut off' AS reason, count(DISTINCT l_orderkey) AS messages FROM lineitem WHERE l_orderkey % 50 = 0
  UNION ALL SELECT 'passed', count(DISTINCT l_orderkey) FROM lineitem""",
    "stream_gate": f"WITH {_GATED} SELECT series, seq FROM gated",
    "stream_gate_any_order": f"WITH {_GATED} SELECT series, seq FROM gated",
}
