"""Packing of documents into sequences of a fixed number of tokens, by best-fit decreasing.

A document is its token ids and one end id. Overlong documents are first cut into full windows, each a sequence of its own. What is left of
every document is shorter than a window; these rests are taken by falling length, each into the open window with the least
remaining capacity that still holds it. A segment tree indexed by remaining capacity finds that window.

A rest may be cut too, so windows that best-fit leaves with more than `slack` tokens to pad are closed up: their tokens, one after the other, are cut
into full windows, and the last ones into lengths that are powers of two, which need no padding.

Every task packs what it reads, by buffers of BUFFER tokens of rests, so that nothing is shuffled, no key exists that could be hot, and memory
is bounded by a buffer and one document. A sequence's number is its task's number (upper bits) and its place there; a task that
runs again after a lost executor gives the same numbers, as it reads the same rows in the same order.

Token ids are those of the tokenizers library. As words repeat, a text is cut at single spaces between characters that are no white
space: there a token always ends. Pieces are encoded once and remembered (REMEMBERED at most); texts in which the string of a special token
stands are encoded whole. If the file is a byte-level BPE whose ids follow the order of its merges, pieces go through tiktoken with the file's own
vocabulary, which gives the same ids in a quarter of the time; else, and for all other texts, the library encodes them.

Defined results: a null or empty text is the end id alone, one piece; equal texts are packed one by one; rests of equal length go in
the order of the rows; of windows with equal capacity the one opened last is taken; rows that repeat are separate documents; a null doc_id stays null; a very long text
is encoded by one task, its full windows leave at once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import SLICE, documents

WINDOW = 1024
END = 0
#: Tokens of rests that a task packs together.
BUFFER = 1 << 23
#: Words whose ids are remembered, and the longest of these.
REMEMBERED, LONGEST = 600_000, 64
#: Bytes of ids that a task gives on together.
TOGETHER = 4 << 20
#: A piece of a text that does not begin and end at a safe place.
UNSAFE = b""

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ID = np.dtype("<u4")


#: How a byte-level vocabulary cuts text into words (fixed by it).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others in order from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def word_encoding(path: str):
    """A tiktoken encoding with the file's vocabulary, or None if it would not be the same."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    same = model.get("type") == "BPE" and spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not same or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocabulary, special = model["vocab"], {x["content"] for x in spec["added_tokens"]}
    merged = [vocabulary["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    if merged != sorted(set(merged)):
        return None
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}
    return tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts, as little-endian u32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.words = word_encoding(path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, ID).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        # the first piece has no space before it, so it is encoded apart; all others begin with one
        parts = [x.split(" ") for x in texts]
        long = self._learn({x for many in parts for x in many[1:]})
        out = [self._joined(text, many) for text, many in zip(texts, parts, strict=True)]
        for piece in long:
            del self.known[piece]
        return out

    def _learn(self, pieces: set[str]) -> list[str]:
        """Adds the pieces that are not known yet; returns those of them that are too long to be kept."""
        new = []
        for piece in pieces.difference(self.known):
            if not piece or piece[0].isspace() or piece[-1].isspace():
                self.known[piece] = UNSAFE
            else:
                new.append(piece)
        if self.words is None:
            self.known.update(zip(new, self.whole([f" {x}" for x in new]), strict=True))
        else:
            word = self.words.encode_ordinary
            self.known.update((x, array("I", word(f" {x}")).tobytes()) for x in new)
        return [x for x in new if len(x) > LONGEST]

    def _joined(self, text: str, parts: list[str]) -> bytes:
        if any(x in text for x in self.special):
            return self.whole([text])[0]
        found = [self.known[x] for x in parts[1:]]
        first = parts[0]
        safe = bool(first) and not first[0].isspace() and not first[-1].isspace()
        if safe and UNSAFE not in found:
            out = b"".join([self.whole([first])[0], *found])
        else:
            out = b"".join(self.whole(self._merged(parts)))
        return out

    @staticmethod
    def _merged(parts: list[str]) -> list[str]:
        """The text in pieces again, cut only where it is safe."""
        out, open_ = [], [parts[0]]
        for before, piece in zip(parts, parts[1:], strict=False):
            if before and not before[-1].isspace() and piece and not piece[0].isspace():
                out.append(" ".join(open_))
                open_ = ["", piece]
            else:
                open_.append(piece)
        return [*out, " ".join(open_)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Capacities:
    """Open windows by remaining capacity: a segment tree over capacities whose nodes count the windows below them."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the least capacity that is `size` or more."""
        node = self.leaves + size
        while not self.count[node]:
            while node & 1:  # a right child: nothing greater below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Windows as lists of items (indexes into sizes), by best-fit decreasing."""
    tree, out = Capacities(window), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            found = window, len(out)
            out.append([])
        capacity, number = found
        out[number].append(item)
        tree.put(capacity - sizes[item], number)
    return out


def padding(fill: int, window: int) -> int:
    """Tokens added to a sequence: none at a power of two."""
    return 0 if fill & (fill - 1) == 0 else window - fill


def lay_out(sizes: list[int], window: int = WINDOW, slack: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, first token, tokens) that hold all items, none of which is larger than a window."""
    slack = window // 256 if slack is None else slack
    out, loose = [], []
    for items in best_fit(sizes, window):
        if padding(sum(sizes[i] for i in items), window) > slack:
            loose += items
        else:
            out.append([(i, 0, sizes[i]) for i in items])
    left = sum(sizes[i] for i in loose)
    room, now = 0, []
    for i in loose:
        at = 0
        while at < sizes[i]:
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
                now = []
                out.append(now)
            n = min(room, sizes[i] - at)
            now.append((i, at, n))
            at, room, left = at + n, room - n, left - n
    return out


class _Out:
    """Rows of pieces, given on in batches of bounded size."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.bytes = kind, [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += len(row[3])

    def batch(self) -> pa.RecordBatch:
        kinds = [self.kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", *(x.split(" ")[0] for x in PIECES.split(", "))])
        self.rows, self.bytes = [], 0
        return made


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, slack: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """doc_id and the pieces (start, length, ids as little-endian u32, doc_tokens, sequence_id, offset) of every document."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(path).encode, TaskContext.get().partitionId() << 33
        ending, out, rests, held = np.array([end], ID).tobytes(), None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, rests, held
            for pieces in lay_out([len(x[1]) // ID.itemsize for x in rests], window, slack):
                offset = 0
                for item, at, n in pieces:
                    doc, ids, start = rests[item]
                    out.add(doc, start + at, n, ids[at * ID.itemsize : (at + n) * ID.itemsize], start + len(ids) // ID.itemsize, number, offset)
                    offset += n
                number += 1
                if out.bytes > TOGETHER:
                    yield out.batch()
            rests, held = [], 0

        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            out = out or _Out(batch.column(0).type)
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(ids_of, encode(texts), strict=True):
                ids += ending
                total = len(ids) // ID.itemsize
                full = total // window * window
                for start in range(0, full, window):
                    out.add(doc, start, window, ids[start * ID.itemsize : (start + window) * ID.itemsize], total, number, 0)
                    number += 1
                    if out.bytes > TOGETHER:
                        yield out.batch()
                if total > full:
                    rests.append((doc, ids[full * ID.itemsize :], full))
                    held += total - full
                if held >= buffer:
                    yield from close()
        if out is not None:
            yield from close()
            yield out.batch()

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, {PIECES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
