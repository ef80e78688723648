"""The virtual image of a stream of messages, and the start gate of a stream of series."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelweir.functions.config import ScanConfig
from pixelweir.operators import decode, image, series
from pixelweir.sources import log_source

#: The table of a run: one narrow row for each message, and the micro-batch that it came in (0 for a stored copy).
TABLE = f"{decode.NARROW}, batch int"
#: Seconds that a listener is waited for after the end of a query.
PATIENCE = 60


def table_of(spark: SparkSession, table: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.schema(TABLE).parquet(table)


def gate(rows: DataFrame, config: ScanConfig) -> DataFrame:
    """The first start message of each series that does not fit the configuration, with its reason; later starts are ignored."""
    first = rows.where("type = 'start'").groupBy("series").agg(F.min_by(F.struct("seq", "image_size_y", "image_size_x", "number_of_images"), "seq").alias("start"))
    reason = series.start_errors(F.col("start.image_size_y"), F.col("start.image_size_x"), F.col("start.number_of_images"), config)
    return first.withColumn("reason", reason).where("reason IS NOT NULL")


def counted() -> dict[str, Column]:
    """What a batch of messages is and took, counted while it is written."""
    kind = F.col("type")
    return {
        "received": F.count(F.lit(1)), "unreadable": F.count_if(kind.isNull()), "starts": F.count_if(kind == "start"), "images": F.count_if(kind == "image"), "decoded": F.count("s"),
        "decode_errors": F.count_if((kind == "image") & F.col("error").isNotNull()), **{c: F.sum(c) for c in decode.STAGES},
    }


def write_batch(raw: DataFrame, number: int, weights: list[float], config: ScanConfig, table: str, verify_all: bool = False) -> dict[str, int]:
    """Decodes messages (seq, raw) into the table's folder for a batch, replacing what an interrupted try left there. Returns counted(), which
    the same job observes.

    Raises ValueError if the first start of any series so far does not fit the configuration.
    """
    seen = Observation(f"batch-{uuid.uuid4().hex}")
    rows = decode.decoded_rows(raw, weights, config, verify_all, timed=True)
    rows.observe(seen, *(c.alias(k) for k, c in counted().items())).drop(*decode.STAGES).write.mode("overwrite").parquet(f"{table}/batch={number}")
    found = {k: v or 0 for k, v in seen.get.items()}
    # batches without a start need no look at the others
    bad = gate(table_of(raw.sparkSession, table), config).take(1) if found["starts"] else []
    if bad:
        raise ValueError(f"series start: {bad[0]['reason']}")
    return found


def run_sums(raw: DataFrame, weights: list[float], config: ScanConfig, table: str, checkpoint: str, verify_all: bool = False, listener: Progress | None = None, once: bool = True) -> list[dict[str, int]]:
    """Reads what a stream of (seq, raw) has, to its end, and adds a narrow row for each message to the Parquet table. Returns what write_batch()
    counted, batch by batch, with its number.

    Each micro-batch writes a folder named by its number, so a replay after a lost driver or executor changes nothing. A first start message
    that does not fit stops the run. A listener is told of the progress. Sources that plan a batch at a time are read until they have no more (once=False).
    """
    streams, batches = raw.sparkSession.streams, []

    def batch(messages: DataFrame, number: int) -> None:
        batches.append({"batch": number, **write_batch(messages, number, weights, config, table, verify_all)})

    if listener is not None:
        streams.addListener(listener)
    try:
        writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start() if once else writer.start()
        try:
            if once:
                query.awaitTermination()
            else:
                query.processAllAvailable()
        finally:
            query.stop()
        # events come in order but later than the query's end; the last one tells that all have come
        if listener is not None:
            listener.ended.wait(PATIENCE)
    finally:
        if listener is not None:
            streams.removeListener(listener)
    return batches


class Progress(StreamingQueryListener):
    """Keeps the rows and the milliseconds of each micro-batch, by stage of its work, and prints the count of messages so far.

    Of message logs also how many bytes each batch left behind, from the offsets that it was planned with.
    """

    def __init__(self, say=print):
        self.say, self.messages, self.batches, self.ended = say, 0, [], threading.Event()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        found = event.progress
        if found.numInputRows:
            self.messages += found.numInputRows
            left = [x for x in (log_source.behind(s.endOffset) for s in found.sources) if x is not None]
            self.batches.append({"batch": found.batchId, "rows": found.numInputRows, **{k: int(v) for k, v in found.durationMs.items()}, **({"behind": sum(left)} if left else {})})
            self.say(f"{self.messages} messages")

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended.set()


def runs(spark: SparkSession, table: str) -> DataFrame:
    """run_seq and series of every run that began."""
    return series.openings(table_of(spark, table)).select(F.col("start_seq").alias("run_seq"), "series")


def passed_sums(spark: SparkSession, table: str) -> DataFrame:
    """The frames written so far that stand between their run's start and its end, whatever batches these came in."""
    return series.gated(table_of(spark, table)).select("run_seq", "series", "seq", "image_id", "s", "error", "batch")


def quarantine(spark: SparkSession, table: str) -> DataFrame:
    """seq, image_id and error of the messages that cannot be read, and of the frames that cannot be decoded."""
    return table_of(spark, table).where("error IS NOT NULL").select("seq", "image_id", "error")


def images(spark: SparkSession, table: str, config: ScanConfig) -> DataFrame:
    """The image of every run (run_seq, series, scan_y, scan_x, s, visited), of all its frames written so far; of an id sent twice the later frame counts."""
    return image.run_grids(passed_sums(spark, table), runs(spark, table), config)


def snapshot(spark: SparkSession, table: str, config: ScanConfig) -> DataFrame:
    """scan_y, scan_x, s and visited of the one run that the table holds; of several, images() tells them apart."""
    found = [r["run_seq"] for r in runs(spark, table).take(2)]
    if len(found) > 1:
        raise ValueError("the table holds several runs: use images()")
    return images(spark, table, config).select("scan_y", "scan_x", "s", "visited") if found else image.grid(*(spark.createDataFrame([], "image_id long, s double"),) * 2, config)


def stream_gate(messages: DataFrame) -> DataFrame:
    """series and seq of the image messages of a stream (series, seq, type) between a series' start and its end.

    The state of a series is two flags; messages of a series must come in order of seq from batch to batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended = state.get if state.exists else (False, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        passed = []
        for seq, kind in zip(rows["seq"], rows["type"], strict=True):
            if ended:
                break
            if not started:
                started = kind == "start"
            elif kind == "end":
                ended = True
            elif kind == "image":
                passed.append(seq)
        state.update((started, ended))
        yield pd.DataFrame({"series": [key[0]] * len(passed), "seq": passed}).astype("int64")

    return messages.groupBy("series").applyInPandasWithState(step, "series long, seq long", "started boolean, ended boolean", "append", GroupStateTimeout.NoTimeout)


def run_gate(messages: DataFrame, table: str, checkpoint: str) -> None:
    """Writes what passes the gate to a Parquet table, until the stream has no more."""
    query = stream_gate(messages).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir; a local session may do without)."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
