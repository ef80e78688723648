"""Language-model scores by deleted interpolation.

The model is a bigram model: the chance of a token after its predecessor h mixes three estimates, the bigram's relative frequency
c(h w) / c(h), the token's c(w) / N, and 1 / (V + 1). Contexts are put into buckets by how often they occur (powers of two), and each
bucket has its own three weights. The weights are learned by expectation-maximisation on held-out counts: one tenth of the
training documents is taken out of the counts and then predicted by the rest. Scores use the counts of all training documents.

No table of words or bigrams is ever whole in one place. Documents form blocks of about 8 MB by a hash, and the key space is cut into as
many shards. A block sends its distinct words and bigrams, sorted and compressed, towards their shards; a shard adds up what it gets and
answers with the totals of just the keys that were asked for, in the order they came in. With more than FAN blocks this goes over
levels, as in a sort of many passes: a node between takes the same part of the key space from a group of at most FAN blocks, adds
their keys up, asks on, and hands the answers back. So a block or node sends FAN rows at most, a node or shard gets FAN rows at most
and holds about as many keys as a block, a frequent word included; rows and bytes grow in proportion to the input (times one
more level for each factor of FAN).

Words are keyed by 63-bit hashes, bigrams by 56-bit fingerprints. Held-out counts reach the driver as a table over buckets and
probabilities rounded to an eighth of a binary logarithm, whose size does not depend on the input; on the small test tables this moves the
learned weights by less than 0.02 against the exact probabilities (a test holds it to that).

Defined results: a null or empty text is one end token; a text larger than a block makes its block larger, and is held whole by one
task, as are its copies; rows are never merged; rows without doc_id are neither training nor held out; scores do not depend on the order of
rows; an empty table gives an empty result; without training rows every known count is 0 and every score 0; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import documents, remainder, text_bytes, written

BLOCK_BYTES = 8 << 20
HELD_OUT, DELETED = 0, 5
BUCKETS = 48
STEPS = 8
ZERO = -(1 << 20)  # the step that stands for a probability of 0
END_HASH = np.uint64(0xD6E8FEB86659FD93)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Rows that a block or node sends to the next level, and gets from the one before, at most.
FAN = 4096
#: Partitions of an exchange are as many as there are blocks, up to this number.
PARTITIONS = 100_000
#: part: 0 for all documents of a block, 1 for those deleted from the counts. `node` asks `next`; blocks are the nodes of level 0.
REQUEST = "node long, next long, part int, n_words int, n_pairs int, data binary"
RESPONSE = "node long, next long, part int, n_words int, n_pairs int, data binary, vocabulary long, tokens long, deleted long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte plane by byte plane, compressed."""
    return pa.compress(b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays), codec="zstd", asbytes=True)


def _fields(raw: bytes, at: int, n: int, kinds: tuple[type, ...]) -> tuple[list[np.ndarray], int]:
    """Arrays of n numbers each, read back from their byte planes, and where they end."""
    out = []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n) if n else np.zeros((width, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out, at


class Block:
    """The tokens of some documents, as numbers into the block's own vocabulary (0: the end), with keys of its words and bigrams.

    Keys are sorted; word_at and pair_at say for each token which key is its word's and its bigram's.
    """

    def __init__(self, texts: list[bytes]):
        own: dict[bytes, int] = {}
        pieces = [np.fromiter((own.setdefault(w, len(own) + 1) for w in x.lower().split()), np.int64) for x in texts]
        self.sizes = np.array([len(x) + 1 for x in pieces], np.int64)
        stop = np.cumsum(self.sizes)
        tokens = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        for piece, end in zip(pieces, stop, strict=True):
            tokens[end - 1 - len(piece) : end - 1] = piece
        hashes = np.concatenate(([END_HASH], np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))))
        words = hashes >> np.uint64(1)
        order = np.argsort(words, kind="stable")
        self.words = words[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.concatenate((np.zeros(1, np.int64), tokens[:-1])) if len(tokens) else tokens
        self.word_at, self.context_at = place[tokens], place[before]
        pairs, inverse = np.unique(before * len(hashes) + tokens, return_inverse=True)
        keys = _mix(_mix(hashes[pairs // len(hashes)]) * FACTOR + hashes[pairs % len(hashes)]) >> np.uint64(8)
        order = np.argsort(keys, kind="stable")
        self.pairs = keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_at = place[inverse]

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each bigram occurs in the chosen documents."""
        tokens = np.repeat(chosen, self.sizes)
        return (
            np.bincount(self.word_at[tokens], minlength=len(self.words)).astype(np.uint32),
            np.bincount(self.pair_at[tokens], minlength=len(self.pairs)).astype(np.uint32),
        )


@dataclass(frozen=True)
class Layout:
    """How many blocks there are, over how many levels they ask, and into how many parts each level cuts the key space further.

    A node of level l stands for blocks with one quotient by fan ** l and keys of one of fan ** l ranges; its number puts the two together.
    """

    blocks: int
    levels: int
    fan: int

    @classmethod
    def of(cls, blocks: int) -> Layout:
        levels = 1
        while FAN**levels < blocks:
            levels += 1
        fan = max(1, int(blocks ** (1 / levels)))
        return cls(blocks, levels, fan if fan**levels >= blocks else fan + 1)

    @property
    def partitions(self) -> int:
        return min(self.blocks, PARTITIONS)

    def cuts(self, keys: np.ndarray, bits: int, node: int, level: int) -> dict[int, slice]:
        """Where the sorted keys for each node of the level after `level` stand, for nodes that get any."""
        here = self.fan**level
        top = (keys >> np.uint64(bits - 32)) * np.uint64(here * self.fan) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(keys) else np.zeros(0, np.int64)
        group = node // here // self.fan * here * self.fan
        return {group + int(top[a]): slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)}

    def asked(self, node: int, level: int, part: int, words: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, ...]) -> list[tuple]:
        """The requests of a node for its sorted keys, given with two counts each."""
        cuts = self.cuts(words[0], 63, node, level), self.cuts(pairs[0], 56, node, level)
        out = []
        for target in sorted(cuts[0].keys() | cuts[1].keys()):
            data = []
            for kind, cut in zip((words, pairs), cuts, strict=True):
                at = cut.get(target, slice(0, 0))
                data += [np.diff(kind[0][at], prepend=np.uint64(0)), kind[1][at].astype(np.uint64), kind[2][at].astype(np.uint64)]
            out.append((node, target, part, len(data[0]), len(data[3]), _planes(*data)))
        return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _documents_of(table: pa.Table) -> pa.Table:
    """The documents of a block, in one order whatever the order of the rows."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("payload").combine_chunks()] if table.num_rows else []
    docs = pa.concat_tables(parts)
    texts = text_bytes(docs.column("text").combine_chunks())
    return docs.append_column("sha", pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in texts], pa.int64())).sort_by([("doc_id", "ascending"), ("sha", "ascending")])


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """block and payload: documents put together by block, as compressed Arrow streams, before they are shuffled."""
    rest = F.coalesce(remainder("doc_id", 10), F.lit(-1)).cast("int")
    rows = docs.select("doc_id", "text", rest.alias("rest"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("block")
            block = table.column("block").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, int)
            payloads = []
            for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                    writer.write_table(table.slice(a, b - a).combine_chunks())
                payloads.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(payloads, pa.binary())], names=["block", "payload"])

    return rows.mapInArrow(run, "block long, payload binary")


def _each(df: DataFrame, key: str, layout: Layout):
    return df.repartition(layout.partitions, key).groupBy(key)


def requests(docs: DataFrame, layout: Layout) -> DataFrame:
    """What each block asks: its keys with counts (part 0), and the keys of the documents deleted for training (part 1)."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        given = _documents_of(table)
        texts, rest = text_bytes(given.column("text").combine_chunks()), given.column("rest").to_numpy()
        out = []
        for part in (0, 1):
            chosen = np.ones(len(texts), bool) if part == 0 else rest == DELETED
            if not chosen.any():
                continue
            block = Block([x for x, c in zip(texts, chosen, strict=True) if c])
            kind = rest[chosen]
            train, deleted = block.counts((kind != HELD_OUT) & (kind >= 0) & (part == 0)), block.counts((kind == DELETED) & (part == 0))
            out += layout.asked(number, 0, part, (block.words, train[0], deleted[0]), (block.pairs, train[1], deleted[1]))
        return _table(out, REQUEST)

    return _each(blocks(docs, layout.blocks), "block", layout).applyInArrow(run, REQUEST)


class Sums:
    """The keys that a node was asked for, added up: for words and for bigrams the sorted keys, both counts, and where each asked key is."""

    def __init__(self, table: pa.Table):
        self.head = [table.column(c).to_pylist() for c in ("node", "next", "part", "n_words", "n_pairs")]
        asked = []
        for data, n_words, n_pairs in zip(table.column("data").to_pylist(), self.head[3], self.head[4], strict=True):
            raw = pa.decompress(data, decompressed_size=24 * (n_words + n_pairs), codec="zstd", asbytes=True)
            both, at = [], 0
            for n in (n_words, n_pairs):
                fields, at = _fields(raw, at, n, (np.uint64, np.int64, np.int64))
                fields[0] = np.cumsum(fields[0], dtype=np.uint64)
                both.append(fields)
            asked.append(both)
        self.sizes = [[len(x[kind][0]) for x in asked] for kind in (0, 1)]
        self.keys, self.inverse, self.train, self.deleted = [], [], [], []
        for kind in (0, 1):
            unique, inverse = np.unique(np.concatenate([x[kind][0] for x in asked]), return_inverse=True)
            self.keys.append(unique)
            self.inverse.append(inverse)
            for kept, k in ((self.train, 1), (self.deleted, 2)):
                kept.append(np.bincount(inverse, np.concatenate([x[kind][k] for x in asked]), len(unique)).astype(np.int64))

    def replies(self, train: list[np.ndarray], deleted: list[np.ndarray]) -> list[tuple]:
        """The answers to all that asked, from the totals of the node's keys."""
        at, out = [0, 0], []
        for k, head in enumerate(zip(*self.head, strict=True)):
            data = []
            for kind in (0, 1):
                where = self.inverse[kind][at[kind] : at[kind] + self.sizes[kind][k]]
                data += [train[kind][where], deleted[kind][where]]
                at[kind] += self.sizes[kind][k]
            out.append((*head, _planes(*data), 0, 0, 0))
        return out


def _shard(table: pa.Table) -> pa.Table:
    """A shard's totals for every node that asked, and one row (node -1) of the shard's own sums."""
    found = Sums(table)
    train, deleted = found.train[0], found.deleted[0]
    own = (-1, found.head[1][0], 0, 0, 0, None, int((train > 0).sum()), int(train.sum()), int(deleted.sum()))
    return _table([*found.replies(found.train, found.deleted), own], RESPONSE)


def _asks_on(layout: Layout, level: int):
    def run(table: pa.Table) -> pa.Table:
        found = Sums(table)
        return _table(layout.asked(found.head[1][0], level, 0, *((found.keys[k], found.train[k], found.deleted[k]) for k in (0, 1))), REQUEST)

    return run


def answers(asked: DataFrame, layout: Layout) -> DataFrame:
    """The shards' answers to the blocks' requests, by way of the nodes between, and the shards' own sums."""
    levels = [asked]
    for level in range(1, layout.levels):
        levels[-1] = written(levels[-1], "requests")  # read again when the answers come back
        levels.append(_each(levels[-1], "next", layout).applyInArrow(_asks_on(layout, level), REQUEST))
    out = _each(levels.pop(), "next", layout).applyInArrow(_shard, RESPONSE)

    def hand_back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # the shards' own sums
            return right
        (w, wd), (p, pd) = _totals(right)
        return _table(Sums(left).replies([w, p], [wd, pd]), RESPONSE)

    while levels:
        out = written(out, "answers")
        own = out.where("node < 0")
        back = _each(levels.pop(), "next", layout).cogroup(_each(out.where("node >= 0"), "node", layout)).applyInArrow(hand_back, RESPONSE)
        out = back.unionByName(own)
    return out


def _totals(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(train, deleted) totals of a block's words and of its bigrams, in the order of its keys."""
    found = ([], [], [], [])
    for row in table.sort_by("next").select(["n_words", "n_pairs", "data"]).to_pylist():
        raw = pa.decompress(row["data"], decompressed_size=16 * (row["n_words"] + row["n_pairs"]), codec="zstd", asbytes=True)
        words, at = _fields(raw, 0, row["n_words"], (np.int64, np.int64))
        pairs, _ = _fields(raw, at, row["n_pairs"], (np.int64, np.int64))
        for kept, x in zip(found, (*words, *pairs), strict=True):
            kept.append(x)
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
    return joined[:2], joined[2:]


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context_count + 1.0).astype(np.int64), BUCKETS - 1)


def _rounded(p: np.ndarray) -> np.ndarray:
    """Probabilities as whole eighths of their binary logarithm; ZERO for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1.0)) * STEPS), ZERO).astype(np.int64)


def _probability(steps: np.ndarray) -> np.ndarray:
    return np.where(steps == ZERO, 0.0, np.exp2(np.maximum(steps, -1000.0 * STEPS) / STEPS))


def held_out_counts(docs: DataFrame, found: DataFrame, layout: Layout, tokens: int) -> DataFrame:
    """bucket, p2, p1 (rounded) and n of the tokens of the deleted documents, by the counts without those documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "p2", "p1", "n"]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        block = Block(text_bytes(_documents_of(left).column("text").combine_chunks()))
        (w, wd), (p, pd) = _totals(right)
        context = (w - wd)[block.context_at]
        p2 = np.where(context > 0, (p - pd)[block.pair_at] / np.maximum(context, 1), 0.0)
        p1 = (w - wd)[block.word_at] / max(tokens, 1)
        rows, count = np.unique(np.stack([bucket(context), _rounded(p2), _rounded(p1)]), axis=1, return_counts=True)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (*rows, count)], names=names)

    chosen = blocks(docs.where(remainder("doc_id", 10) == DELETED), layout.blocks)
    made = _each(chosen, "block", layout).cogroup(_each(found.where("part = 1"), "node", layout)).applyInArrow(run, "bucket long, p2 long, p1 long, n long")
    return made.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))


def learn_weights(counts: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """The three weights of each bucket by expectation-maximisation over rows of (bucket, p2, p1, n)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(counts):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    b, n = counts[:, 0], counts[:, 3].astype(np.float64)
    p = np.stack([_probability(counts[:, 1]), _probability(counts[:, 2]), np.full(len(counts), uniform)], axis=1)
    whole = np.full(3, 1 / 3)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], axis=1)
        whole = mass.sum(axis=0) / mass.sum()
        seen = mass.sum(axis=1) > 0
        weights[seen] = mass[seen] / mass[seen].sum(axis=1)[:, None]
    weights[~np.isin(np.arange(BUCKETS), b)] = whole
    weights = np.maximum(weights, 1e-9)  # no token is impossible
    return weights / weights.sum(axis=1)[:, None]


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the counts."""

    weights: np.ndarray
    tokens: int
    vocabulary: int

    def scores(self, block: Block, words: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
        starts = np.cumsum(block.sizes) - block.sizes
        c1, context = words[block.word_at], words[block.context_at]
        base = np.log10((c1 + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        p2 = np.where(context > 0, pairs[block.pair_at] / np.maximum(context, 1), 0.0)
        w = self.weights[bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * (c1 / max(self.tokens, 1)) + w[:, 2] / (self.vocabulary + 1)
        return {
            "n_tokens": block.sizes,
            "n_known": np.add.reduceat((c1 > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(np.log10(p), starts),
        }


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    size = docs.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 1
    layout = Layout.of(max(1, math.ceil(size / block_bytes)))
    found = written(answers(requests(docs, layout), layout), "counts")
    sums = found.where("node = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "tokens", "deleted"))).first()
    held = held_out_counts(docs, found.where("node >= 0"), layout, sums["tokens"] - sums["deleted"]).toArrow()
    counts = np.stack([held.column(c).to_numpy() for c in ("bucket", "p2", "p1", "n")], axis=1)
    model = Model(learn_weights(counts, 1 / (sums["vocabulary"] + 1)), sums["tokens"], sums["vocabulary"])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = _documents_of(left)
        block = Block(text_bytes(given.column("text").combine_chunks()))
        (w, _), (p, _) = _totals(right)
        made = model.scores(block, w, p)
        columns = [given.column("doc_id"), pa.array(given.column("rest").to_numpy() == HELD_OUT), pa.array(made["n_tokens"]), pa.array(made["n_known"]), pa.array(np.full(len(block.sizes), model.tokens)), pa.array(made["base_score"]), pa.array(made["score"])]
        return pa.Table.from_arrays(columns, names=[x.split(" ")[0] for x in schema.split(", ")])

    return _each(blocks(docs, layout.blocks), "block", layout).cogroup(_each(found.where("node >= 0 AND part = 0"), "node", layout)).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
