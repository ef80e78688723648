"""The start gate of a stream whose batches may come in any order: messages are held back until nothing earlier can come.

The order of arrival (seq) bears a watermark: a message is decided on, in order of seq, once one has come whose seq is `delay` and at most a quarter of it above its own. So the result is
that of the gate over the whole stream, whatever batches the messages came in. A message that comes when the watermark has passed it is late and left out.

Images are dealt to shards by a hash of their seq, so a series of any length is spread evenly. Starts and ends go to all shards; each so knows
every run. A shard's state is what it holds back (of an image its id and sum), and a row for each run: where it began, where it ended.

Messages reach a shard, are held and leave it in packs: Arrow tables of many rows, as bytes. So the state is read and written a few packs at a time, and
a shard decides on all the messages that the watermark has passed at once, on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 16
#: Messages that one may come after others that were sent later.
DELAY = 10_000
OUT = "run_seq long, series long, seq long, image_id long, s double, error string"
#: A pack, and the smallest seq in it.
HELD = "seq long, rows binary"
#: What is kept of a message: kind is a place in KINDS.
KEPT = "seq long, series long, kind byte, image_id long, s double, error string"
FIELDS = [x.split(" ")[0] for x in KEPT.split(", ")]
KINDS = ("start", "end", "image")
START, END, IMAGE = range(3)
#: Rows of a pack at most.
PACK = 1 << 16
#: Where a run ends that has not ended.
NEVER = np.iinfo(np.int64).max
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LZ4 = pa.ipc.IpcWriteOptions(compression="lz4")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_LZ4) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


class Runs:
    """Runs, in order of their begin: series (0 where it is not named), begin and end."""

    def __init__(self, series: np.ndarray, named: np.ndarray, begin: np.ndarray, end: np.ndarray):
        order = np.lexsort((series, named, begin))
        self.series, self.named, self.begin, self.end = (x[order] for x in (series, named, begin, end))

    @classmethod
    def read(cls, rows: bytes | None) -> Runs:
        if rows is None:
            none = np.zeros(0, np.int64)
            return cls(none, none.astype(bool), none, none)
        table = unpacked(rows)
        return cls(*(table.column(c).to_numpy() for c in ("series", "named", "begin", "end")))

    def bytes(self) -> bytes:
        return packed(pa.table({"series": self.series, "named": self.named, "begin": self.begin, "end": self.end}))

    def opened(self, seq: np.ndarray, series: np.ndarray, named: np.ndarray) -> Runs:
        """With the runs that start messages open: the first of each series that has none, the first without a series."""
        order = np.lexsort((seq, series, named))
        seq, series, named = seq[order], series[order], named[order]
        first = np.ones(len(seq), bool)
        first[1:] = (series[1:] != series[:-1]) | (named[1:] != named[:-1])
        new = first & np.where(named, ~np.isin(series, self.series[self.named]), not (~self.named).any())
        more = (series[new], named[new], seq[new], np.full(new.sum(), NEVER))
        return Runs(*(np.concatenate(x) for x in zip((self.series, self.named, self.begin, self.end), more, strict=True)))

    def of(self, seq: np.ndarray, series: np.ndarray, named: np.ndarray) -> np.ndarray:
        """The place of the run that each message (no start) belongs to, or -1: its series' if that has begun, else the run that began last, if the message or that run names no series."""
        if not len(self.begin):
            return np.full(len(seq), -1)
        places = np.flatnonzero(self.named)
        places = places[np.argsort(self.series[places], kind="stable")]
        own = np.full(len(seq), -1)
        if len(places):
            at = np.minimum(np.searchsorted(self.series[places], series), len(places) - 1)
            found = places[at]
            own = np.where(named & (self.series[found] == series) & (self.begin[found] < seq), found, -1)
        last = np.searchsorted(self.begin, seq) - 1
        open_ = (own < 0) & (last >= 0) & (~named | ~self.named[last])
        return np.where(open_, last, own)


def decided(runs: Runs, ready: pa.Table) -> tuple[Runs, pa.Table]:
    """The runs after the messages that are ready, and those that pass (OUT)."""
    seq, kind = ready.column("seq").to_numpy(), ready.column("kind").to_numpy()
    named = ready.column("series").is_valid().to_numpy()
    series = ready.column("series").fill_null(0).to_numpy()
    starts = kind == START
    runs = runs.opened(seq[starts], series[starts], named[starts])
    run = runs.of(seq, series, named)
    ends = (kind == END) & (run >= 0)
    np.minimum.at(runs.end, run[ends], seq[ends])
    images = np.flatnonzero((kind == IMAGE) & (run >= 0))
    images = images[seq[images] < runs.end[run[images]]]
    of, rest = run[images], ready.select(["seq", "image_id", "s", "error"]).take(pa.array(images))
    columns = [pa.array(runs.begin[of]), pa.array(runs.series[of], mask=~runs.named[of]), *rest.columns]
    return runs, pa.table(columns, names=[x.split(" ")[0] for x in OUT.split(", ")])


class HeldGate(StatefulProcessor):
    """The gate of one shard."""

    def __init__(self, delay: int):
        self.step = max(1, delay // 4)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.runs = handle.getValueState("runs", "rows binary")
        self.done: set[tuple] = set()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        packs, times = [], set()
        for row in rows:
            new = unpacked(row["rows"])
            new = new.filter(pc.greater_equal(new.column("seq"), passed))
            if new.num_rows:
                seqs = new.column("seq").to_numpy()
                packs.append((int(seqs.min()), packed(new)))
                times.update(np.unique(seqs // self.step).tolist())
        if packs:
            # once: the store looks at the whole list whenever something is appended
            self.held.appendList(packs)
            # the time of a message is its seq, in milliseconds; timers stand at multiples of a step, the next one after each message
            for at in times:
                self.handle.registerTimer((at + 1) * self.step)
        yield from self._decide(key, passed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._decide(key, timerValues.getCurrentWatermarkInMs())

    def _decide(self, key: tuple, passed: int) -> Iterator[Row]:
        # the watermark stands still within a batch, and what comes in it is not before the watermark: the first look finds all that is ready
        if key in self.done:
            return
        self.done.add(key)
        ready, rest = [], []
        for seq, rows in self.held.get() if self.held.exists() else ():
            if seq >= passed:
                rest.append((seq, bytes(rows)))
                continue
            table = unpacked(bytes(rows))
            late = pc.less(table.column("seq"), passed)
            ready.append(table.filter(late))
            left = table.filter(pc.invert(late))
            if left.num_rows:
                rest.append((pc.min(left.column("seq")).as_py(), packed(left)))
        if not ready:
            return
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        runs, out = decided(Runs.read(bytes(self.runs.get()[0]) if self.runs.exists() else None), pa.concat_tables(ready))
        self.runs.update((runs.bytes(),))
        for at in range(0, out.num_rows, PACK):
            yield Row(rows=packed(out.slice(at, PACK)))

    def close(self) -> None:
        pass


def _pack(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A pack for each shard of the messages (shard, or null for all; FIELDS) of a task, PACK at a time."""

    def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        own = table.column("shard").fill_null(-1).to_numpy()
        table = table.drop_columns("shard")
        for shard in range(shards):
            here = table.take(pa.array(np.flatnonzero((own == shard) | (own < 0))))
            if here.num_rows:
                top = pc.max(here.column("seq")).as_py()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([top], pa.int64()), pa.array([packed(here)], pa.binary())], names=["shard", "top", "rows"])

    parts, held = [], 0
    for whole in batches:
        for batch in (whole.slice(k, PACK) for k in range(0, whole.num_rows, PACK)):
            if held + batch.num_rows > PACK:
                yield from made(parts)
                parts, held = [], 0
            parts.append(batch)
            held += batch.num_rows
    if parts:
        yield from made(parts)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column("rows"):
            yield from unpacked(rows.as_py()).to_batches()


def held_gate(messages: DataFrame, delay: int = DELAY, shards: int = SHARDS) -> DataFrame:
    """The frames (run_seq, series of the run, seq, image_id, s, error) of a stream of narrow rows (seq, series, type, image_id, s, error) that pass the gate.

    The session has to keep its state in RocksDB: spark.sql.streaming.stateStore.providerClass = ROCKS.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("type")) - 1
    # of starts and ends no more than their place is needed
    kept = messages.where(F.col("type").isin(*KINDS) & F.col("seq").isNotNull()).withColumn("kind", kind.cast("byte"))
    shard = F.when(F.col("type") == "image", F.pmod(F.xxhash64("seq"), F.lit(shards))).cast("int")
    packs = kept.select(shard.alias("shard"), *FIELDS).mapInArrow(lambda batches: _pack(batches, shards), "shard int, top long, rows binary")
    marked = packs.withColumn("at", F.timestamp_millis("top")).withWatermark("at", f"{delay} milliseconds").drop("at", "top")
    return marked.groupBy("shard").transformWithState(HeldGate(delay), "rows binary", "Append", "EventTime").mapInArrow(_unpack, OUT)
