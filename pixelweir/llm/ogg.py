"""Media columns in Ogg.

Writing: the bytes of a text, padded with zero bytes, are 8-bit samples of one channel. They go into packets of one logical
stream, a second logical stream holds a header and a closing packet about the samples, and both are laid out in pages with
lacing values, granule positions and checksums. Reading: pages are found by their capture pattern, their
checksums verified, packets put together from the lacing values across pages, logical streams kept apart by serial
number, and timestamps taken from the granule positions.

Defined results: a null or empty text is 64 zero bytes of samples; a very long text is one medium of many pages, made and read by one task; equal texts (and
rows that repeat) give equal media, a row each; nothing is ranked, so nothing can tie; a damaged, cut or
reordered medium gives an error (read_media puts it into a column) and never wrong samples; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pixelweir.llm.common import documents, per_row

UNIT = 64
RATE = 8000
PACKET = 4080  # sixteen full segments and an empty one
SEGMENTS = 255
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445
CONTINUED, FIRST, LAST = 1, 2, 4
NONE_ENDS = -1
HEAD = struct.Struct("<4sBBqIIIB")
MAGIC = b"\x01pcm8\x00"
NOTE_MAGIC = b"\x01note\x00"

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32: polynomial 04C11DB7, highest bit first, from 0, without a final inversion.

    zlib has the same polynomial lowest bit first and inverted; mirrored bytes and result turn one into the other.
    """
    value = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_MIRROR), "big")


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg medium."""


def lacing(size: int) -> bytes:
    """A packet's lacing values: full segments of 255, then one that is shorter."""
    return b"\xff" * (size // 255) + bytes((size % 255,))


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets come with their granule position. The first packet has a page to itself."""
    out: list[bytes] = []
    groups = [packets[:1], packets[1:]]
    for group, given in enumerate(groups):
        values = b"".join(lacing(len(x)) for x, _ in given)
        body = b"".join(x for x, _ in given)
        ends = np.cumsum([len(x) // 255 + 1 for x, _ in given]) if given else np.zeros(0, int)
        granules = [g for _, g in given]
        at = 0
        for k in range(0, len(values), SEGMENTS):
            part = values[k : k + SEGMENTS]
            size = sum(part)
            complete = int(np.searchsorted(ends, k + len(part), side="right"))
            before = int(np.searchsorted(ends, k, side="right"))
            granule = granules[complete - 1] if complete > before else NONE_ENDS
            flags = (CONTINUED if k and values[k - 1] == 255 else 0) | (FIRST if not out else 0)
            if k + SEGMENTS >= len(values) and (group == 1 or len(packets) == 1):
                flags |= LAST
            page = bytearray(HEAD.pack(b"OggS", 0, flags, granule, serial, len(out), 0, len(part)) + part + body[at : at + size])
            page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
            out.append(bytes(page))
            at += size
    return out


@dataclass
class Stream:
    """One logical stream as read: packets, the granule position of each (or -1), and what is still open."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pieces: list[bytes] = field(default_factory=list)
    pages: int = 0
    open: bool = False
    ended: bool = False


def demultiplex(media: bytes) -> dict[int, Stream]:
    """All logical streams of a medium, by serial number."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(media)
    while at < size:
        if size - at < HEAD.size or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        values = media[at + HEAD.size : at + HEAD.size + n]
        start = at + HEAD.size + n
        end = start + sum(values)
        if version or len(values) < n or end > size:
            raise OggError(f"page at byte {at} is cut or of another version")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        stream = streams.setdefault(serial, Stream())
        if stream.ended or number != stream.pages or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != stream.open:
            raise OggError(f"page {number} of stream {serial:#x} is out of order")
        _segments(stream, media, values, start, granule)
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        at = end
    for serial, stream in streams.items():
        if stream.open or not stream.ended:
            raise OggError(f"stream {serial:#x} does not end")
    return streams


def _segments(stream: Stream, media: bytes, values: bytes, start: int, granule: int) -> None:
    """Puts a page's segments together; the page's granule position belongs to the last packet that ends on it."""
    first = len(stream.packets)
    at = start
    for size, closed in _packet_sizes(values):
        stream.pieces.append(media[at : at + size])
        at += size
        stream.open = not closed
        if closed:
            stream.packets.append(b"".join(stream.pieces))
            stream.granules.append(NONE_ENDS)
            stream.pieces = []
    if len(stream.packets) > first:
        stream.granules[-1] = granule


def _packet_sizes(values: bytes):
    """Size of each packet's part on a page, and whether it ends there."""
    size = 0
    for value in values:
        size += value
        if value < 255:
            yield size, True
            size = 0
    if values and values[-1] == 255:
        yield size, False


def payload(text: bytes) -> bytes:
    """The text with zero bytes appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def write_samples(samples: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """An Ogg medium with the samples in one logical stream and notes on them in another."""
    sound = [(MAGIC + struct.pack("<IBQ", rate, 1, len(samples)), 0)]
    sound += [(samples[k : k + PACKET], min(k + PACKET, len(samples))) for k in range(0, len(samples), PACKET)]
    notes = [(NOTE_MAGIC, 0), (struct.pack("<QI", n_bytes, zlib.crc32(samples)), len(samples))]
    a, b = pages(SAMPLES, sound), pages(NOTES, notes)
    return b"".join([a[0], b[0], *a[1:], *b[1:]])


@dataclass(frozen=True)
class Sound:
    samples: bytes
    n_bytes: int
    rate: int
    #: Time in seconds at which each packet of samples ends, where its page says so.
    times: tuple[float, ...]
    packets: int


def read_samples(media: bytes) -> Sound:
    """The samples of a medium, checked against its notes and granule positions."""
    streams = demultiplex(media)
    if SAMPLES not in streams or NOTES not in streams:
        raise OggError("a stream is missing")
    sound, notes = streams[SAMPLES], streams[NOTES]
    if not sound.packets[0].startswith(MAGIC) or notes.packets[0] != NOTE_MAGIC or len(notes.packets) != 2:
        raise OggError("a header is missing")
    rate, _, expected = struct.unpack("<IBQ", sound.packets[0][len(MAGIC) :])
    n_bytes, crc = struct.unpack("<QI", notes.packets[1])
    samples = b"".join(sound.packets[1:])
    if len(samples) != expected or sound.granules[-1] != expected or zlib.crc32(samples) != crc:
        raise OggError("samples are missing")
    times = tuple(g / rate for g in sound.granules[1:] if g != NONE_ENDS)
    return Sound(samples, n_bytes, rate, times, len(sound.packets) - 1)


def feature(sound: Sound) -> str:
    """Duration, packets, mean, root mean square about the mean, peak and crossings of the mean, as text."""
    x = np.frombuffer(sound.samples, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    squares = int(np.dot(x.astype(np.float64), x))
    rms = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    above = x > total / n
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"seconds={sound.times[-1]:.6f};packets={sound.packets};mean={total / n:.6f};rms={rms:.6f};peak={int(x.max())};crossings={crossings}"


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (the Ogg bytes) of every document."""
    return per_row(docs, ["doc_id", "text"], "media binary", lambda x: {"media": [write_samples(payload(t), len(t)) for t in x["text"]]}).drop("text")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, samples, n_bytes, seconds and error of every row of (doc_id, media); a damaged medium has an error only."""

    def work(given: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"samples": [], "n_bytes": [], "seconds": [], "error": []}
        for data in given["media"]:
            try:
                sound = read_samples(data or b"")
                row = (sound.samples, sound.n_bytes, sound.times[-1], None)
            except (ValueError, struct.error, IndexError) as e:
                row = (None, None, None, str(e) or type(e).__name__)
            for kept, value in zip(out.values(), row, strict=True):
                kept.append(value)
        return out

    return per_row(media, ["doc_id", "media"], "samples binary, n_bytes long, seconds double, error string", work).drop("media")


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(text: bytes) -> tuple:
    media = write_samples(payload(text), len(text))
    sound = read_samples(media)
    return (sound.n_bytes, len(sound.samples), hashlib.sha256(sound.samples).hexdigest(), zlib.crc32(sound.samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(sound))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id and digests of the samples read back and of the medium; each text is written and read in one go, so no medium leaves its task."""
    names = [x.strip().split(" ")[0] for x in COLUMNS.split(",")]

    def work(given: dict[str, list]) -> dict[str, list]:
        return dict(zip(names, map(list, zip(*map(_digest, given["text"]), strict=True)), strict=True)) if given["text"] else {c: [] for c in names}

    return per_row(docs, ["doc_id", "text"], COLUMNS, work).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
