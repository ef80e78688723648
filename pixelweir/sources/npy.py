"""Images as .npy files, written by the tasks that hold them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pixelweir.functions.config import ScanConfig


class NpyImages(DataSource):
    """Writes rows (file, scan_y, scan_x, s) as float32 arrays. Options: height, width; files lie in a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "npy_images"

    def writer(self, schema, overwrite: bool) -> NpyWriter:  # noqa: ARG002
        return NpyWriter(int(self.options["height"]), int(self.options["width"]), self.options["files"].split("\n"))


class NpyWriter(DataSourceArrowWriter):
    """The driver lays out a hidden file of zeros for each image, tasks put their pixels into it, and a commit gives it its name.

    A task that runs again writes the same pixels to the same places. If the job fails the hidden files go, and no image appears.
    """

    def __init__(self, height: int, width: int, files: list[str]):
        self.hidden = {f: str(Path(f).parent / f".{Path(f).name}.{uuid.uuid4().hex}") for f in files}
        for place in self.hidden.values():
            np.lib.format.open_memmap(place, "w+", np.float32, (height, width)).flush()

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        open_: dict[str, np.ndarray] = {}
        for batch in iterator:
            names = np.array(batch.column("file").to_pylist())
            y, x, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("scan_y", "scan_x", "s"))
            for name in np.unique(names) if len(names) else ():
                if name not in open_:
                    open_[name] = np.lib.format.open_memmap(self.hidden[name], "r+")
                mine = names == name
                open_[name][y[mine], x[mine]] = s[mine]
        for array in open_.values():
            array.flush()
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:  # noqa: ARG002
        for file, place in self.hidden.items():
            os.replace(place, file)

    def abort(self, messages: list) -> None:  # noqa: ARG002
        for place in self.hidden.values():
            Path(place).unlink(missing_ok=True)


def image_files(images: DataFrame, file: str) -> dict[int, str]:
    """The file of each run, by run_seq: the one that is given, or for several runs one each, with the series (or the first seq) in its name."""
    found = sorted((r["run_seq"], r["series"]) for r in images.select("run_seq", "series").distinct().collect())
    path = Path(file)
    names = {run: f"{series}" if series is not None else f"from-{run}" for run, series in found}
    return {run: file if len(found) == 1 else str(path.with_name(f"{path.stem}-{name}{path.suffix}")) for run, name in names.items()}


def write_images(images: DataFrame, file: str, config: ScanConfig) -> list[str]:
    """Writes each run's image (run_seq, series, scan_y, scan_x, s) as an .npy file of its own; returns their names."""
    spark = images.sparkSession
    files = image_files(images, file)
    if not files:
        return []
    spark.dataSource.register(NpyImages)
    named = F.create_map(*(F.lit(x) for pair in files.items() for x in pair))[F.col("run_seq")]
    rows = images.select(named.alias("file"), F.col("scan_y").cast("long").alias("scan_y"), F.col("scan_x").cast("long").alias("scan_x"), F.col("s").cast("double").alias("s"))
    rows.write.format(NpyImages.name()).mode("append").option("height", config.scan[0]).option("width", config.scan[1]).option("files", "\n".join(files.values())).save()
    return list(files.values())
