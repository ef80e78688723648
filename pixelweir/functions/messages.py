"""Detector messages: typed arrays, envelopes and frames in CBOR."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, NamedTuple

import numpy as np

from pixelweir.functions import cbor, container, quad
from pixelweir.functions.cbor import CborError, Tag

ROW_MAJOR, COLUMN_MAJOR, COMPRESSED = 40, 1040, 56500
_IMAGE_ID = cbor.dumps("image_id")

#: Typed-array tags (RFC 8746) and their element types. 76 is not assigned; 83 and 87 are 128-bit floats, which become doubles.
TYPED = {
    64: "u1", 65: ">u2", 66: ">u4", 67: ">u8", 68: "u1", 69: "<u2", 70: "<u4", 71: "<u8",
    72: "i1", 73: ">i2", 74: ">i4", 75: ">i8", 77: "<i2", 78: "<i4", 79: "<i8",
    80: ">f2", 81: ">f4", 82: ">f8", 84: "<f2", 85: "<f4", 86: "<f8",
    83: ">quad", 87: "<quad",
}
QUADS = (">quad", "<quad")


class Envelope(NamedTuple):
    """A frame as sent: pixels still compressed."""

    image_id: int
    algorithm: str | None
    elem_size: int | None
    encoded: bytes
    dtype: str
    shape: tuple[int, ...]
    column_major: bool


def item_size(dtype: str) -> int:
    """Bytes of an element."""
    return quad.SIZE if dtype in QUADS else np.dtype(dtype).itemsize


def numbers(plain: bytes, dtype: str) -> np.ndarray:
    """The elements that the bytes hold; 128-bit floats as doubles."""
    return quad.doubles(plain, dtype == ">quad") if dtype in QUADS else np.frombuffer(plain, dtype)


def parse(raw: bytes) -> Any:
    """A message with its tags kept; no pixel is touched."""
    return cbor.loads(raw)


def message_type(raw: bytes) -> str | None:
    """start, image, end or another type; None if the message cannot be read or has none."""
    try:
        message = parse(raw)
    except CborError:
        return None
    kind = message.get("type") if isinstance(message, Mapping) else None
    return kind if isinstance(kind, str) else None


def first_channel(message: Mapping) -> Any:
    """The data of the first channel, in the order sent."""
    data = message.get("data")
    if not isinstance(data, Mapping) or not data:
        raise CborError("image without data")
    return next(iter(data.values()))


def envelope(message: Mapping) -> Envelope:
    """An image message's frame, still compressed."""
    frame = first_channel(message)
    try:
        image_id = int(message["image_id"])
    except (KeyError, TypeError, ValueError, OverflowError) as e:
        raise CborError("image without image_id") from e
    if not isinstance(frame, Tag) or frame.number not in (ROW_MAJOR, COLUMN_MAJOR) or not isinstance(frame.value, list) or len(frame.value) != 2:
        raise CborError("frame is no multi-dimensional array")
    shape, content = frame.value
    if not isinstance(shape, list) or not all(isinstance(n, int) and not isinstance(n, bool) and n >= 0 for n in shape):
        raise CborError("shape of a frame")
    if not isinstance(content, Tag) or content.number not in TYPED:
        raise CborError("frame is no typed array")
    dtype, body = TYPED[content.number], content.value
    if isinstance(body, Tag) and body.number == COMPRESSED:
        if not isinstance(body.value, list) or len(body.value) != 3 or not isinstance(body.value[2], bytes):
            raise CborError("compressed payload")
        algorithm, elem_size, encoded = body.value
    elif isinstance(body, bytes):
        algorithm, elem_size, encoded = None, None, body
    else:
        raise CborError("typed array is no byte string")
    return Envelope(image_id, algorithm, elem_size, encoded, dtype, tuple(shape), frame.number == COLUMN_MAJOR)


def pixels(found: Envelope, wanted: set[int] | None = None) -> np.ndarray:
    """The frame in row-major order, in the type sent (128-bit floats as doubles). Blocks not wanted are left at 0."""
    plain = found.encoded if found.algorithm is None else container.decompress(found.encoded, found.algorithm, found.elem_size or item_size(found.dtype), wanted)
    if len(plain) != int(np.prod(found.shape, dtype=np.int64)) * item_size(found.dtype):
        raise CborError(f"{len(plain)} bytes for a frame of shape {found.shape}")
    return np.ascontiguousarray(numbers(plain, found.dtype).reshape(found.shape, order="F" if found.column_major else "C"))


def _tag_of(dtype: np.dtype) -> int:
    return next(n for n, t in TYPED.items() if n != 68 and t not in QUADS and np.dtype(t) == dtype)


def frame_message(image_id: int, frame: np.ndarray, algorithm: str | None = "bslz4", block_size: int = 8192, tag: int | None = None, column_major: bool = False, **more: Any) -> bytes:
    """An image message around a frame, for fixtures and tests."""
    number = tag or _tag_of(frame.dtype)
    plain = frame.astype(TYPED[number]).tobytes(order="F" if column_major else "C")
    size = frame.dtype.itemsize
    body = plain if algorithm is None else Tag(COMPRESSED, [algorithm, size, container.compress(plain, algorithm, size, block_size)])
    return _around(image_id, list(frame.shape), number, body, column_major, more)


def frame_messages(image_ids: list[int], frames: np.ndarray, algorithm: str | None = "bslz4", block_size: int = 8192, **more: Any) -> list[bytes]:
    """Image messages around row-major frames (frame, y, x), compressed together."""
    number = _tag_of(frames.dtype)
    plain = np.ascontiguousarray(frames).view(np.uint8).reshape(len(frames), int(np.prod(frames.shape[1:])) * frames.dtype.itemsize)
    size = frames.dtype.itemsize
    shape = list(frames.shape[1:])
    bodies = [x.tobytes() for x in plain] if algorithm is None else container.compress_all(plain, algorithm, size, block_size)
    # messages differ in the image_id and in the bytes at their end
    whole = _around(0, shape, number, b"" if algorithm is None else Tag(COMPRESSED, [algorithm, size, b""]), False, more)
    at = whole.index(_IMAGE_ID) + len(_IMAGE_ID)
    before, after = whole[:at], whole[at + 1 : -1]
    return [b"".join((before, cbor.dumps(k), after, cbor.head(2, len(body)), body)) for k, body in zip(image_ids, bodies, strict=True)]


class Likeness:
    """Image messages that differ from one that was parsed in nothing but the image_id and the compressed bytes at their end, so that they need not be parsed again.

    What stands before, between and after these is compared byte by byte; what a reader makes of it cannot differ.
    """

    def __init__(self, raw: bytes, image_id: int, encoded: bytes):
        """Raises CborError if the message is none of which this can be told."""
        if image_id < 0:
            raise CborError("negative image_id")
        head = raw[: len(raw) - len(encoded) - len(cbor.head(2, len(encoded)))]
        at = head.find(_IMAGE_ID) + len(_IMAGE_ID)
        number = cbor.head(0, image_id)
        if at < len(_IMAGE_ID) or not head.startswith(number, at):
            raise CborError("no image_id in its usual form")
        self.before, self.after = head[:at], head[at + len(number) :]
        self.row: Any = None

    def message(self, image_id: int, encoded: bytes) -> bytes:
        return b"".join((self.before, cbor.head(0, image_id), self.after, cbor.head(2, len(encoded)), encoded))

    def read(self, raw: bytes) -> tuple[int, bytes] | None:
        """image_id and the compressed bytes of a message that is like this one."""
        at = len(self.before)
        if not raw.startswith(self.before) or len(raw) <= at:
            return None
        image_id = raw[at]
        at += 1
        if image_id > 23:
            if image_id > 27:
                return None
            size = 1 << (image_id - 24)
            image_id = int.from_bytes(raw[at : at + size], "big")
            at += size
        if not raw.startswith(self.after, at):
            return None
        at += len(self.after)
        if len(raw) <= at or image_id >= 1 << 63:
            return None
        size = raw[at] - 64
        at += 1
        if size > 23:
            if size > 27:
                return None
            width = 1 << (size - 24)
            size = int.from_bytes(raw[at : at + width], "big")
            at += width
        return (image_id, raw[at:]) if size >= 0 and at + size == len(raw) else None


def _around(image_id: int, shape: list[int], number: int, body: Any, column_major: bool, more: dict[str, Any]) -> bytes:
    data = {"threshold_1": Tag(COLUMN_MAJOR if column_major else ROW_MAJOR, [shape, Tag(number, body)])}
    return cbor.dumps({"type": "image", "image_id": image_id, **more, "data": data})
