"""Block containers of compressed pixels: framing, LZ4 blocks, bit shuffling.

A container is a header (u64 uncompressed bytes, u32 bytes of a block, both big-endian) and blocks, each with a u32 length. In
`lz4` a block is LZ4 of plain bytes, in `bslz4` of bit-shuffled elements: bit k of byte c of all elements stands together,
lowest bit first.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

HEADER = np.dtype([("plain", ">u8"), ("block", ">u4")])
LENGTH = np.dtype(">u4")
ALGORITHMS = ("lz4", "bslz4")


class ContainerError(ValueError):
    """The container's framing or content does not add up."""


@dataclass(frozen=True)
class Frames:
    """Block k's packed bytes are those from begins[k] to ends[k], and stand for the plain bytes from k * block on.

    Of several containers of one layout, begins and ends have a row for each.
    """

    plain: int
    block: int
    begins: np.ndarray
    ends: np.ndarray

    def plain_sizes(self) -> np.ndarray:
        """Bytes that each block stands for: a whole block, but for the last one."""
        return np.minimum(self.block, self.plain - self.block * np.arange(self.begins.shape[-1], dtype=np.int64))


def frames_of(data: bytes) -> Frames:
    """Where the blocks of a container stand. How many there must be follows from the header alone; nothing is decompressed."""
    size = len(data)
    try:
        plain, block = map(int, np.frombuffer(data, HEADER, 1)[0])
        count = -(-plain // block)
    except (ValueError, ZeroDivisionError) as e:
        raise ContainerError("no header, or one without a block size") from e
    # a block takes five bytes at least, so a header that promises more than fit is refused before anything is allocated
    if count * (LENGTH.itemsize + 1) > size - HEADER.itemsize:
        raise ContainerError(f"{count} blocks do not fit in {size} bytes")
    ends = np.empty(count + 1, np.int64)
    ends[0] = HEADER.itemsize
    for k in range(count):
        begin = int(ends[k]) + LENGTH.itemsize
        packed = int.from_bytes(data[begin - LENGTH.itemsize : begin], "big")
        ends[k + 1] = begin + packed
        if not packed or ends[k + 1] > size:
            raise ContainerError(f"block {k} of {count} is empty or cut off")
    if ends[count] != size:
        raise ContainerError(f"bytes are left after block {count - 1}")
    return Frames(plain, block, ends[:-1] + LENGTH.itemsize, ends[1:])


def frames_of_all(many: list[bytes]) -> Frames:
    """frames_of() for containers that have one header; all are walked through together, a block at a time.

    Raises if any of them does not add up.
    """
    first = many[0]
    if len(many) == 1 or any(x[: HEADER.itemsize] != first[: HEADER.itemsize] for x in many):
        found = [frames_of(x) for x in many]
        if any((f.plain, f.block) != (found[0].plain, found[0].block) for f in found):
            raise ContainerError("containers of several layouts")
        return Frames(found[0].plain, found[0].block, np.stack([f.begins for f in found]), np.stack([f.ends for f in found]))
    sizes = np.array([len(x) for x in many], np.int64)
    try:
        plain, block = map(int, np.frombuffer(first, HEADER, 1)[0])
        count = -(-plain // block)
    except (ValueError, ZeroDivisionError) as e:
        raise ContainerError("no header, or one without a block size") from e
    if count * (LENGTH.itemsize + 1) > int(sizes.min()) - HEADER.itemsize:
        raise ContainerError(f"{count} blocks do not fit in {int(sizes.min())} bytes")
    joined = np.frombuffer(b"".join(many), np.uint8)
    starts = np.cumsum(sizes) - sizes
    ends = np.empty((len(many), count + 1), np.int64)
    ends[:, 0] = HEADER.itemsize
    for k in range(count):
        at = ends[:, k, None] + np.arange(LENGTH.itemsize)
        if (at[:, -1] >= sizes).any():
            raise ContainerError(f"block {k} of {count} is empty or cut off")
        packed = joined[starts[:, None] + at].view(LENGTH)[:, 0].astype(np.int64)
        ends[:, k + 1] = ends[:, k] + LENGTH.itemsize + packed
        if not packed.all() or (ends[:, k + 1] > sizes).any():
            raise ContainerError(f"block {k} of {count} is empty or cut off")
    if (ends[:, count] != sizes).any():
        raise ContainerError(f"bytes are left after block {count - 1}")
    return Frames(plain, block, ends[:, :-1] + LENGTH.itemsize, ends[:, 1:])


def _transpose8(x: np.ndarray) -> np.ndarray:
    """The transpose of each 8 x 8 bit matrix held in a u64 (three swaps of ever larger squares)."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        s, m = np.uint64(shift), np.uint64(mask)
        t = (x ^ (x >> s)) & m
        x = x ^ t ^ (t << s)
    return x


def unshuffle(data: np.ndarray, elem_size: int) -> np.ndarray:
    """Plain bytes of bit-shuffled ones; data is (blocks, bytes) of uint8, all blocks of one size.

    The bits of each byte of the elements stand together. Where all of them are zero, as in the upper bytes of small counts, nothing has to be moved.
    """
    count, size = data.shape
    n = size // elem_size
    if n * elem_size != size or n % 8:
        raise ContainerError(f"{size} bytes are not a multiple of eight elements of {elem_size}")
    # of one byte of the elements: rows are bits, columns are groups of eight elements; a group's eight rows make one 8 x 8 matrix
    planes = data.reshape(count, elem_size, 8, n // 8)
    out = np.zeros((count, n, elem_size), np.uint8)
    for byte in range(elem_size):
        if planes[:, byte].any():
            matrices = np.ascontiguousarray(planes[:, byte].transpose(0, 2, 1)).view("<u8")[..., 0]
            out[:, :, byte] = _transpose8(matrices)[..., None].view(np.uint8).reshape(count, n)
    return out.reshape(count, size)


def shuffle(data: np.ndarray, elem_size: int) -> np.ndarray:
    """The inverse of unshuffle()."""
    count, size = data.shape
    n = size // elem_size
    if n * elem_size != size or n % 8:
        raise ContainerError(f"{size} bytes are not a multiple of eight elements of {elem_size}")
    groups = np.ascontiguousarray(data.reshape(count, n // 8, 8, elem_size).transpose(0, 1, 3, 2)).view("<u8")[..., 0]
    bits = _transpose8(groups)[..., None].view(np.uint8)  # (blocks, groups, byte, bit)
    return np.ascontiguousarray(bits.transpose(0, 2, 3, 1)).reshape(count, size)


_LZ4 = pa.Codec("lz4_raw")


def inflate(data: bytes, begins: list[int], ends: list[int], ks: list[int], size: int) -> list[bytes]:
    """The bytes that the LZ4 of each of the blocks ks stands for, `size` of them."""
    out, unpack = [], _LZ4.decompress
    for k, begin, end in zip(ks, begins, ends, strict=True):
        try:
            plain = unpack(data[begin:end], size, asbytes=True)
        except (OSError, pa.ArrowException) as e:
            raise ContainerError(f"block {k} is no LZ4: {e}") from e
        if len(plain) != size:
            raise ContainerError(f"block {k} holds {len(plain)} of {size} bytes")
        out.append(plain)
    return out


def decompress(data: bytes, algorithm: str, elem_size: int, wanted: set[int] | None = None) -> bytes:
    """The plain bytes of a container. With `wanted`, only those blocks are decompressed and the rest are zero bytes."""
    return decompress_all([data], frames_of_all([data]), algorithm, elem_size, wanted)[0].tobytes()


def decompress_all(many: list[bytes], found: Frames, algorithm: str, elem_size: int, wanted: set[int] | None = None, spent: dict[str, int] | None = None) -> np.ndarray:
    """The plain bytes of containers that have one layout (plain and block size), a row for each; their blocks are unshuffled together.

    The nanoseconds that LZ4 and unshuffling take are added to inflate_ns and unshuffle_ns of `spent`.
    """
    if algorithm not in ALGORITHMS:
        raise ContainerError(f"algorithm {algorithm!r}")
    spent = {} if spent is None else spent
    sizes = found.plain_sizes()
    chosen = np.array([k for k in range(len(sizes)) if wanted is None or k in wanted], np.int64)
    out = np.zeros((len(many), found.plain), np.uint8)
    for size in np.unique(sizes[chosen]):  # whole blocks, and the last one if it is shorter
        ks = chosen[sizes[chosen] == size]
        began = time.perf_counter_ns()
        here, n = ks.tolist(), int(size)
        spans = zip(many, found.begins[:, ks].tolist(), found.ends[:, ks].tolist(), strict=True)
        parts = [plain for data, begins, ends in spans for plain in inflate(data, begins, ends, here, n)]
        plain = np.frombuffer(b"".join(parts), np.uint8).reshape(len(many), len(ks), n)
        done = time.perf_counter_ns()
        if algorithm == "bslz4":
            plain = unshuffle(plain.reshape(-1, size), elem_size).reshape(plain.shape)
        if len(ks) and ks[-1] - ks[0] == len(ks) - 1:  # one after the other
            out[:, ks[0] * found.block : ks[-1] * found.block + size] = plain.reshape(len(many), -1)
        else:
            for j, k in enumerate(ks):
                out[:, k * found.block : k * found.block + size] = plain[:, j]
        spent["inflate_ns"] = spent.get("inflate_ns", 0) + done - began
        spent["unshuffle_ns"] = spent.get("unshuffle_ns", 0) + time.perf_counter_ns() - done
    return out


def compress(plain: bytes, algorithm: str, elem_size: int, block_size: int) -> bytes:
    """A container of plain bytes."""
    return compress_all(np.frombuffer(plain, np.uint8)[None, :], algorithm, elem_size, block_size)[0]


def compress_all(plain: np.ndarray, algorithm: str, elem_size: int, block_size: int) -> list[bytes]:
    """Containers of the rows of plain bytes; all their blocks are shuffled together."""
    if algorithm not in ALGORITHMS:
        raise ContainerError(f"algorithm {algorithm!r}")
    count, size = plain.shape
    whole = size // block_size
    parts = [plain[:, : whole * block_size].reshape(count * whole, block_size), plain[:, whole * block_size :]]
    if algorithm == "bslz4":
        parts = [shuffle(x, elem_size) if x.size else x for x in parts]
    blocks, tail = (np.ascontiguousarray(x) for x in parts)
    head, pack, n = size.to_bytes(8, "big") + block_size.to_bytes(4, "big"), _LZ4.compress, tail.shape[1]
    cuts = [slice(k * block_size, (k + 1) * block_size) for k in range(count * whole)]
    views = memoryview(blocks).cast("B") if blocks.size else b"", memoryview(tail).cast("B") if tail.size else b""
    out = []
    for k in range(count):
        made = [head]
        mine = [views[0][c] for c in cuts[k * whole : (k + 1) * whole]]
        for block in (*mine, views[1][k * n : (k + 1) * n]) if n else mine:
            packed = pack(block, asbytes=True)
            made += [len(packed).to_bytes(4, "big"), packed]
        out.append(b"".join(made))
    return out


def blocks_of_rows(first: int, last: int, row_bytes: int, block_size: int) -> set[int]:
    """Blocks that hold any byte of the frame's rows first to last."""
    return set(range(first * row_bytes // block_size, ((last + 1) * row_bytes - 1) // block_size + 1))
