"""Decoding of messages in Arrow batches: envelope first, pixels later, and only those that carry weight."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweir.functions import container, messages
from pixelweir.functions.cbor import CborError
from pixelweir.functions.config import ScanConfig
from pixelweir.operators import exact

ENVELOPE = (
    "seq long, type string, series long, image_size_y int, image_size_x int, number_of_images long, image_id long, algorithm string, elem_size int, "
    "encoded binary, dtype string, shape array<int>, column_major boolean, error string"
)
_NAMES = [x.strip().split(" ")[0] for x in ENVELOPE.split(",")]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.string()]
#: What a broken message may raise while it is read.
BROKEN = (CborError, container.ContainerError, ValueError, TypeError, KeyError, OverflowError)


#: Whole numbers that a column of each type holds.
INT, LONG = range(-(1 << 31), 1 << 31), range(-(1 << 63), 1 << 63)


def _number(message: dict, field: str, kind: range) -> int | None:
    """A field that is absent, null or a whole number of the given range."""
    value = message.get(field)
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value not in kind:
        raise CborError(f"field {field}")
    return value


def _open(seq: int, raw: bytes | None) -> dict:
    """A message's row. What it says is checked field by field, so that whatever comes fits the columns or is an error of this message alone.

    A start with a broken field is no start and has no type; an image with one is a frame that cannot be decoded; an end remains one.
    """
    row = dict.fromkeys(_NAMES) | {"seq": seq}
    try:
        message = messages.parse(raw or b"")
        if not isinstance(message, dict) or not isinstance(message.get("type"), str):
            raise CborError("message without type")
        kind = message["type"]
        row["type"] = None if kind == "start" else kind
        row["series"] = _number(message, "series_id", LONG)
        if kind == "start":
            row |= {k: _number(message, k, r) for k, r in (("image_size_y", INT), ("image_size_x", INT), ("number_of_images", LONG))} | {"type": kind}
        if kind == "image":
            found = messages.envelope(message)
            if found.image_id not in LONG:
                raise CborError("field image_id")
            row["image_id"] = found.image_id
            if found.algorithm is not None and not isinstance(found.algorithm, str):
                raise CborError("field algorithm")
            if not all(n in INT for n in found.shape):
                raise CborError("shape of a frame")
            if found.elem_size is not None and (isinstance(found.elem_size, bool) or not isinstance(found.elem_size, int) or found.elem_size not in INT):
                raise CborError("field elem_size")
            row |= {"algorithm": found.algorithm, "elem_size": found.elem_size, "encoded": found.encoded, "dtype": found.dtype, "shape": list(found.shape), "column_major": found.column_major}
    except BROKEN as e:
        row["error"] = str(e) or type(e).__name__
    return row


#: Forms of image messages that are remembered, and messages that are tried for one.
FORMS, TRIES = 8, 64


class _Opener:
    """_open() for many messages: one that differs from an earlier one only in its image_id and compressed bytes is not parsed again."""

    def __init__(self):
        self.known: list[messages.Likeness] = []
        self.tries = TRIES

    def __call__(self, seq: int, raw: bytes | None) -> tuple[dict, int | None, bytes | None]:
        """A row as of _open(), and its image_id and compressed bytes; a row may be that of a like message, whose seq and those two are others."""
        for k, form in enumerate(self.known if raw else ()):
            found = form.read(raw)
            if found is not None:
                if k:  # the latest comes first
                    self.known.insert(0, self.known.pop(k))
                return form.row, *found
        row = _open(seq, raw)
        if self.tries and row["encoded"] is not None and row["error"] is None and raw.endswith(row["encoded"]):
            self.tries -= 1
            form = self._form(raw, row)
            if form is not None:
                self.known = [form, *self.known[: FORMS - 1]]
        return row, row["image_id"], row["encoded"]

    def _form(self, raw: bytes, row: dict) -> messages.Likeness | None:
        """What is like this message; None unless messages made so, with other ids and bytes, are read as they should be."""
        try:
            form = messages.Likeness(raw, row["image_id"], row["encoded"])
        except CborError:
            return None
        for image_id, encoded in ((row["image_id"], row["encoded"]), (5, b"abc"), (70_000, bytes(300)), ((1 << 63) - 1, b"")):
            if _open(row["seq"], form.message(image_id, encoded)) != row | {"image_id": image_id, "encoded": encoded}:
                return None
        form.row = row
        return form


def envelopes(raw: DataFrame) -> DataFrame:
    """One row for each message (seq, raw): its type and fields, for images the frame still compressed, for broken ones the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opener()
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            found = [opened(s, r) for s, r in zip(seqs, batch.column("raw").to_pylist(), strict=True)]
            rows = [row | {"seq": s, "image_id": image_id, "encoded": encoded} for s, (row, image_id, encoded) in zip(seqs, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)

    return raw.select(F.col("seq").cast("long"), "raw").mapInArrow(run, ENVELOPE)


def framing(frames: DataFrame) -> DataFrame:
    """image_id, block_no, begins, ends (packed bytes) and plain_size of every block, or one row with the error of a broken container."""
    schema = "image_id long, block_no int, begins long, ends long, plain_size long, error string"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, data in zip(batch.column("image_id").to_pylist(), batch.column("encoded").to_pylist(), strict=True):
                try:
                    found = container.frames_of(data or b"")
                    rows += [(image, k, *x, None) for k, x in enumerate(zip(found.begins.tolist(), found.ends.tolist(), found.plain_sizes().tolist(), strict=True))]
                except container.ContainerError as e:
                    rows.append((image, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return frames.select("image_id", "encoded").mapInArrow(run, schema)


def _envelopes(batch: pa.RecordBatch) -> list[messages.Envelope]:
    """The batch's envelopes; each column is taken once."""
    columns = [batch.column(c).to_pylist() for c in ("image_id", "algorithm", "elem_size", "encoded", "dtype", "shape", "column_major")]
    return [messages.Envelope(*x[:5], tuple(x[5]), x[6]) for x in zip(*columns, strict=True)]


def _exact(frame: np.ndarray) -> np.ndarray:
    """Pixels as doubles; whole numbers that a double cannot hold are refused rather than rounded or wrapped."""
    if frame.dtype.kind in "iu" and frame.dtype.itemsize == 8 and frame.size and (int(frame.max()) > 1 << 53 or int(frame.min()) < -(1 << 53)):
        raise ValueError("pixel beyond 2 ** 53")
    return frame.astype(np.float64)


#: Frames that are decoded together: about 1 MB of the full detector's, which a core's cache holds; of smaller detectors as many as have that many pixels.
TOGETHER, PIXELS = 8, 8 * 192 * 192

FIELDS = ("seq", "image_id", "algorithm", "elem_size", "encoded", "dtype", "shape", "column_major")


def frames(found: DataFrame) -> DataFrame:
    """seq, image_id, shape and frame (row-major, exact) of image envelopes; a frame that cannot be decoded has an error instead."""
    schema = "seq long, image_id long, shape array<int>, frame array<double>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for frame in _envelopes(batch):
                try:
                    out.append(_exact(messages.pixels(frame)).reshape(-1))
                    errors.append(None)
                except BROKEN as e:
                    out.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("image_id"), batch.column("shape"), pa.array(out, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["seq", "image_id", "shape", "frame", "error"])

    return found.where("type = 'image' AND error IS NULL").select(*FIELDS).mapInArrow(run, schema)


def _summer(weights: list[float], config: ScanConfig, verify_all: bool):
    """A function from envelopes to their sums and errors. It adds the nanoseconds of its stages to a dict that it is given.

    Only blocks that hold rows with weight are decompressed, unless verify_all asks to read (and so check) every block. Frames of one layout
    are unshuffled and summed together, TOGETHER of the full detector at a time. A frame that cannot be decoded, or is not of the detector's shape, has an
    error instead of a sum.
    """
    h, w = config.detector
    table = np.array(weights, np.float64).reshape(h, w)
    rows, columns = np.flatnonzero(table.any(axis=1)), np.flatnonzero(table.any(axis=0))
    first, last = (int(rows[0]), int(rows[-1])) if len(rows) else (0, -1)
    # pixels outside these rows and columns have no weight and are left alone
    part = (slice(first, last + 1), slice(int(columns[0]), int(columns[-1]) + 1) if len(columns) else slice(0, 0))
    weight = np.ascontiguousarray(table[part])

    k = exact.grain(weight)
    many = max(TOGETHER, PIXELS // max(1, h * w))

    def total(frames: np.ndarray) -> np.ndarray:
        """The doubles nearest to the weighted sums of frames (frame, y, x).

        If all products are whole numbers of one power of two and their sum is not too large, as with counts and a mask, plain sums are exact.
        """
        kept = frames[:, *part]
        products = _exact(kept) * weight
        if k is not None and kept.dtype.kind in "iu":
            sums = products.sum(axis=(1, 2))
            if not products.size or np.abs(products).sum(axis=(1, 2)).max() < 2.0 ** (53 - k):
                return sums
        return np.array([math.fsum(x.reshape(-1)) if np.isfinite(x).all() else x.sum() for x in products])

    def one(frame: messages.Envelope) -> float:
        if frame.shape != (h, w):
            raise ValueError(f"frame of shape {frame.shape}, detector {(h, w)}")
        return float(total(messages.pixels(frame)[None])[0])

    def alike(frame: messages.Envelope) -> tuple:
        """Frames with one value here may be decoded together; an empty one for those that are decoded alone."""
        if frame.algorithm not in container.ALGORITHMS or frame.column_major or frame.shape != (h, w) or frame.dtype in messages.QUADS:
            return ()
        return (frame.algorithm, frame.elem_size, frame.dtype, frame.encoded[: container.HEADER.itemsize])

    def together(given: list[messages.Envelope], spent: dict[str, int]) -> np.ndarray:
        """The sums of frames that are alike; raises if any of them is broken."""
        dtype, head = np.dtype(given[0].dtype), given[0]
        found = container.frames_of_all([x.encoded for x in given])
        if found.plain != h * w * dtype.itemsize:
            raise ValueError("bytes of a frame")
        wanted = None if verify_all else container.blocks_of_rows(first, last, w * dtype.itemsize, found.block) if last >= first else set()
        plain = container.decompress_all([x.encoded for x in given], found, head.algorithm, head.elem_size or dtype.itemsize, wanted, spent)
        began = time.perf_counter_ns()
        sums = total(plain.view(dtype).reshape(len(given), h, w))
        spent["sum_ns"] = spent.get("sum_ns", 0) + time.perf_counter_ns() - began
        return sums

    def run(given: list[messages.Envelope], spent: dict[str, int]) -> tuple[list[float | None], list[str | None]]:
        sums: list = [None] * len(given)
        errors: list = [None] * len(given)
        groups: dict[tuple, list[int]] = {}
        for k, frame in enumerate(given):
            groups.setdefault(alike(frame), []).append(k)
        alone = groups.pop((), [])
        # a group that holds a broken frame is tried again in small ones, so that few frames are decoded alone
        tried = [members[at : at + many] for members in groups.values() for at in range(0, len(members), many)]
        while tried:
            ks = tried.pop()
            try:
                for k, s in zip(ks, together([given[k] for k in ks], spent), strict=True):
                    sums[k] = float(s)
            except BROKEN:
                if len(ks) > TOGETHER:
                    tried += [ks[at : at + TOGETHER] for at in range(0, len(ks), TOGETHER)]
                else:
                    alone += ks
        for k in alone:
            try:
                sums[k] = float(together([given[k]], spent)[0]) if alike(given[k]) else one(given[k])
            except BROKEN as e:
                errors[k] = str(e) or type(e).__name__
        return sums, errors

    return run


def decoded_sums(found: DataFrame, weights: list[float], config: ScanConfig, verify_all: bool = False) -> DataFrame:
    """seq, image_id, s and error of image envelopes, decoded and summed in one pass: a narrow row for each frame leaves the task."""
    summed = _summer(weights, config, verify_all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, errors = summed(_envelopes(batch), {})
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("image_id"), pa.array(sums, pa.float64()), pa.array(errors, pa.string())], names=["seq", "image_id", "s", "error"])

    return found.where("type = 'image' AND error IS NULL").select(*FIELDS).mapInArrow(run, "seq long, image_id long, s double, error string")


#: What is left of a message once it is decoded: of a start its sizes, of an image its sum or error, of one that cannot be read its error.
NARROW = "seq long, type string, series long, image_size_y int, image_size_x int, number_of_images long, image_id long, s double, error string"


#: Stages of the work on a message, in nanoseconds: reading it, LZ4, unshuffling, weighting and summing.
STAGES = ("parse_ns", "inflate_ns", "unshuffle_ns", "sum_ns")
#: Messages that are read together.
AT_ONCE = 256


def decoded_rows(raw: DataFrame, weights: list[float], config: ScanConfig, verify_all: bool = False, timed: bool = False) -> DataFrame:
    """One narrow row for each message (seq, raw): every message is parsed once, and every frame decoded once, in one pass of the task that reads it.

    If timed, with the columns STAGES: what AT_ONCE messages took together, on the first of their rows.
    """
    summed = _summer(weights, config, verify_all)
    kept = [x.split(" ")[0] for x in NARROW.split(", ")]
    kinds = dict(zip(_NAMES, _KINDS, strict=True)) | {"s": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opener()
        for batch in (whole.slice(k, AT_ONCE) for whole in batches for k in range(0, whole.num_rows, AT_ONCE)):
            began, spent = time.perf_counter_ns(), {}
            rows, ids, encoded = zip(*map(opened, batch.column("seq").to_pylist(), batch.column("raw").to_pylist()), strict=True)
            spent["parse_ns"] = time.perf_counter_ns() - began
            errors, sums = [r["error"] for r in rows], [None] * len(rows)
            images = [k for k, r in enumerate(rows) if r["type"] == "image" and errors[k] is None]
            given = [messages.Envelope(ids[k], r["algorithm"], r["elem_size"], encoded[k], r["dtype"], tuple(r["shape"]), r["column_major"]) for k, r in ((k, rows[k]) for k in images)]
            for k, s, e in zip(images, *summed(given, spent), strict=True):
                sums[k], errors[k] = s, e
            own = {"image_id": ids, "s": sums, "error": errors}
            columns = [batch.column(c) if c == "seq" else pa.array(own[c] if c in own else [r[c] for r in rows], kinds[c]) for c in kept]
            times = [pa.array([spent.get(c, 0)] + [0] * (len(rows) - 1), pa.int64()) for c in STAGES] if timed else []
            yield pa.RecordBatch.from_arrays(columns + times, names=[*kept, *(STAGES if timed else ())])

    schema = NARROW + "".join(f", {c} long" for c in STAGES) if timed else NARROW
    return raw.select(F.col("seq").cast("long"), "raw").mapInArrow(run, schema)


def quarantine(found: DataFrame) -> DataFrame:
    """seq and error of messages whose envelope cannot be read."""
    return found.where("error IS NOT NULL").select("seq", "error")
