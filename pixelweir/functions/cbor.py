"""A small CBOR reader and writer (RFC 8949), enough for detector messages.

A reader may be given tag functions; a tag without one is kept as Tag. Anything malformed raises CborError: a message is
read whole or not at all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import Any, NamedTuple


class CborError(ValueError):
    """The bytes are not one whole CBOR item."""


class Tag(NamedTuple):
    number: int
    value: Any


class _Break:
    pass


_BREAK = _Break()
_SIMPLE = {20: False, 21: True, 22: None, 23: None}
_FLOATS = {25: ">e", 26: ">f", 27: ">d"}
DEPTH = 64


class _Reader:
    def __init__(self, data: bytes, tags: dict[int, Callable[[Any], Any]]):
        self.data, self.at, self.tags = data, 0, tags

    def take(self, n: int) -> bytes:
        end = self.at + n
        if end > len(self.data):
            raise CborError("cut off")
        out = self.data[self.at : end]
        self.at = end
        return out

    def item(self, depth: int = 0) -> Any:
        if depth > DEPTH:
            raise CborError("nested too deeply")
        head = self.take(1)[0]
        major, info = head >> 5, head & 31
        if major == 7:
            return self.simple(info)
        size = self.size(info, major)
        if major in (0, 1):
            return size if major == 0 else -1 - size
        if major in (2, 3):
            return self.string(major, size, depth)
        if major == 4:
            return self.many(size, depth)
        if major == 5:
            flat = self.many(None if size is None else 2 * size, depth)
            if len(flat) % 2:
                raise CborError("key without value")
            try:
                return dict(zip(flat[::2], flat[1::2], strict=True))
            except TypeError as e:
                raise CborError("key of a map") from e
        value = self.item(depth + 1)
        if value is _BREAK:
            raise CborError("break within a tag")
        return self.tags[size](value) if size in self.tags else Tag(size, value)

    def size(self, info: int, major: int) -> int | None:
        if info < 24:
            return info
        if info <= 27:
            return int.from_bytes(self.take(1 << (info - 24)), "big")
        if info == 31 and 2 <= major <= 5:
            return None
        raise CborError("reserved length")

    def string(self, major: int, size: int | None, depth: int) -> bytes | str:
        if size is None:
            parts = []
            while (part := self.item(depth + 1)) is not _BREAK:
                if not isinstance(part, bytes if major == 2 else str):
                    raise CborError("chunk of another type")
                parts.append(part)
            return (b"" if major == 2 else "").join(parts)
        raw = self.take(size)
        try:
            return raw if major == 2 else raw.decode()
        except UnicodeDecodeError as e:
            raise CborError("text is not UTF-8") from e

    def many(self, size: int | None, depth: int) -> list:
        out: list = []
        while size is None or len(out) < size:
            value = self.item(depth + 1)
            if value is _BREAK:
                if size is None:
                    break
                raise CborError("break in a list of known length")
            out.append(value)
        return out

    def simple(self, info: int) -> Any:
        if info == 31:
            return _BREAK
        if info in _FLOATS:
            return struct.unpack(_FLOATS[info], self.take(struct.calcsize(_FLOATS[info])))[0]
        if info in _SIMPLE:
            return _SIMPLE[info]
        raise CborError("simple value")


def loads(data: bytes, tags: dict[int, Callable[[Any], Any]] | None = None) -> Any:
    """The one item that the bytes hold."""
    reader = _Reader(data, tags or {})
    value = reader.item()
    if value is _BREAK or reader.at != len(data):
        raise CborError("not one item")
    return value


def head(major: int, n: int) -> bytes:
    """The first bytes of an item: its kind, and its number or length."""
    if n < 24:
        return bytes([major << 5 | n])
    for info, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | info]) + n.to_bytes(size, "big")
    raise CborError("number of more than 64 bits")


def dumps(value: Any) -> bytes:
    """CBOR of None, booleans, numbers, bytes, text, lists, dicts and Tags."""
    if value is None or isinstance(value, bool):
        return b"\xf6" if value is None else b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, Tag):
        return head(6, value.number) + dumps(value.value)
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(dumps, value))
    raise CborError(f"no form for {type(value).__name__}")
