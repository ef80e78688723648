"""Log files of messages, each preceded by its length (u32, big-endian), read by ranges of bytes. Files may lie in any store that Arrow opens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs

#: Bytes of a length.
LENGTH = 4
#: Messages of one file at most: the number of a file stands above the number of a message in it.
MOST = 1 << 40
#: Messages, and bytes of them, that are given on together.
AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20
#: Bytes that are read ahead while lengths are looked through.
AHEAD = 1 << 16


def _found(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the place in it; plain paths and file: addresses are local."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """The files at a path (a file or a folder), by name, with their bytes. Hidden ones are left out."""
    store, place = _found(path)
    found = store.get_file_info(place)
    many = store.get_file_info(pafs.FileSelector(place)) if found.type == pafs.FileType.Directory else [found]
    return {x.path: x.size for x in sorted(many, key=lambda x: x.path) if x.type == pafs.FileType.File and x.base_name[:1] not in "._"}


def _lengths(path: str, begins: int, size: int) -> Iterator[tuple[int, int]]:
    """First byte and byte after each message (its length included) from a place on; the last one may end beyond the size, if it is cut."""
    store, place = _found(path)
    with store.open_input_file(place) as file:
        at, held, held_at = begins, b"", begins
        while at < size:
            if at + LENGTH > size:
                yield at, at + LENGTH + 1
                return
            if not held_at <= at <= held_at + len(held) - LENGTH:
                held_at = at
                held = file.read_at(min(AHEAD, size - at), at)
            n = int.from_bytes(held[at - held_at : at - held_at + LENGTH], "big")
            yield at, at + LENGTH + n
            at += LENGTH + n


def ranges(path: str, size: int, range_bytes: int, begins: int = 0, first: int = 0, most: int | None = None, whole: bool = False, one: bool = True) -> list[tuple[int, int, int]]:
    """Ranges of whole messages of about range_bytes: number of the first message, first byte and byte after the last.

    From byte `begins` on, where message `first` stands; at most `most` bytes (but, if asked for, one message at least). A cut last message is part of the last range,
    or left out if only whole ones are asked for.
    """
    out: list[tuple[int, int, int]] = []
    start, number, count = begins, first, first
    for at, end in _lengths(path, begins, size):
        if end > size and whole:
            break
        if most is not None and end > begins + most and not (one and count == first):
            break
        if at - start >= range_bytes:
            out.append((number, start, at))
            start, number = at, count
        count += 1
        last = min(end, size)
    if count > number:
        out.append((number, start, last))
    return out


def count(path: str, begins: int, ends: int) -> int:
    """Messages between two places."""
    return sum(1 for _ in _lengths(path, begins, ends))


def messages(path: str, first: int, begins: int, ends: int) -> Iterator[tuple[range, list[bytes]]]:
    """Numbers and bytes of the messages of a range, some at a time."""
    store, place = _found(path)
    with store.open_input_file(place) as file:
        file.seek(begins)
        at, out, held = begins, [], 0
        while at < ends:
            head = file.read(min(LENGTH, ends - at))
            n = int.from_bytes(head, "big") if len(head) == LENGTH else 0
            body = file.read(min(n, ends - at - len(head))) if len(head) == LENGTH else head
            out.append(body)
            held += len(body)
            at += len(head) + len(body) if len(head) == LENGTH else len(head)
            if len(out) == AT_ONCE or held > BYTES_AT_ONCE:
                yield range(first, first + len(out)), out
                first, out, held = first + len(out), [], 0
        if out:
            yield range(first, first + len(out)), out
