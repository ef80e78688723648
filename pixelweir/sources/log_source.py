"""Growing message logs as a stream source whose offsets are places in files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pixelweir.sources import log_files

#: An offset: of each file its number, the byte that is read next, the messages before it, and its size when the batch was planned.
Offset = dict[str, dict[str, int]]


@dataclass
class LogRange(InputPartition):
    file: str
    first: int
    begins: int
    ends: int


class MessageLog(DataSource):
    """Options: path (a file or folder), progress (a folder of the query's own), bytesPerTrigger, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "seq long, raw binary"

    def streamReader(self, schema) -> MessageLogReader:  # noqa: N802, ARG002
        return MessageLogReader(self.options)


class MessageLogReader(DataSourceStreamReader):
    """Plans batches of whole messages of bounded size.

    Spark asks for the latest offset without saying where it is. It writes an offset to its checkpoint before it has the batch planned, so the end of
    the batch that was planned last, kept in the progress folder, is where the next one begins, after a restart as well.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.progress = options["path"], options["progress"]
        self.most, self.range_bytes = int(options["bytesPerTrigger"]), int(options["rangeBytes"])
        self.planned: Offset | None = None

    def _place(self) -> tuple[pafs.FileSystem, str]:
        store, folder = log_files._found(self.progress)
        store.create_dir(folder, recursive=True)
        return store, f"{folder}/planned.json"

    def initialOffset(self) -> Offset:  # noqa: N802
        return {}

    def _start(self) -> Offset:
        if self.planned is None:
            store, place = self._place()
            if store.get_file_info(place).type == pafs.FileType.NotFound:
                self.planned = {}
            else:
                with store.open_input_stream(place) as f:
                    self.planned = json.loads(f.read())
        return self.planned

    def latestOffset(self) -> Offset:  # noqa: N802
        """Up to bytesPerTrigger beyond the batch planned last: the rest of the files in order of their names, new ones after those that are known."""
        start = self._start()
        end = {k: dict(v) for k, v in start.items()}
        sizes, left = log_files.sizes(self.path), self.most
        for file in sizes:
            end.setdefault(file, {"number": len(end), "byte": 0, "count": 0, "size": 0})
        for file, at in end.items():
            at["size"] = max(sizes.get(file, 0), at["byte"])
        for file, at in end.items():
            if at["size"] == at["byte"]:
                continue
            found = log_files.ranges(file, at["size"], self.range_bytes, at["byte"], at["count"], left, whole=True, one=left == self.most)
            if found:
                first, begins, ends = found[-1]
                left -= ends - at["byte"]
                at |= {"byte": ends, "count": first + log_files.count(file, begins, ends)}
            if log_files.ranges(file, at["size"], self.range_bytes, at["byte"], at["count"], 0, whole=True):
                break  # later files wait until this one is read
        return end if left < self.most else start

    def partitions(self, start: Offset, end: Offset) -> list[LogRange]:
        out = []
        for file, to in end.items():
            at = start.get(file, {"byte": 0, "count": 0})
            if to["byte"] > at["byte"]:
                base = to["number"] * log_files.MOST
                out += [LogRange(file, base + first, begins, ends) for first, begins, ends in log_files.ranges(file, to["byte"], self.range_bytes, at["byte"], at["count"])]
        store, place = self._place()
        with store.open_output_stream(f"{place}.new") as f:
            f.write(json.dumps(end).encode())
        store.move(f"{place}.new", place)
        self.planned = end
        return out

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        for seqs, raw in log_files.messages(partition.file, partition.first, partition.begins, partition.ends):
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(raw, pa.binary())], names=["seq", "raw"])


def behind(offset: str | None) -> int | None:
    """Bytes of the log files that a batch with this end offset (as a query's progress tells it) left to later ones; None for other sources' offsets."""
    try:
        found = json.loads(offset or "")
        return sum(x["size"] - x["byte"] for x in found.values())
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
