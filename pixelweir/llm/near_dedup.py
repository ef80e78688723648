"""Near duplicates by MinHash.

Many universal hash minima over a document's word shingles are cut into bands; documents that share a band meet in a
bucket. Candidates are compared by signature and then on their full shingle sets, and links become components by
alternating large-star and small-star.

No bucket is expanded into pairs. Documents with equal sets become one node first. Each node is then compared with one other, the
smallest that any of its buckets holds; that links most groups. Buckets whose nodes still belong to several components are
searched for links between these, in blocks, and give a spanning forest. So a link is lost only if no band brings its two ends
together (about 8 in a million at a similarity of exactly 0.8, far fewer above).

A node is a 64-bit hash of a shingle set. Sets are compared by 48-bit fingerprints of their shingles.

Defined results: a document without words or text has an empty set, is linked with nothing and is kept; one with fewer words
than a shingle has one shingle, the whole sequence; rows without doc_id take no part, get no component_id and are kept;
rows with the same doc_id and text are one node; of equal similarities none is preferred, as all links count, and the smallest doc_id
stands for its group; a very long text is one large set, held whole by the task that compares it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import checkpointed, documents, fresh_name, give_back, hot_join, with_made, written
from pixelweir.llm.components import connected_components

BANDS, ROWS = 50, 7
SIGNATURE = 128
#: Shingles that one task compares with as many others.
BLOCK = 1 << 20
#: Candidates whose signatures agree less are over five standard deviations below the similarity asked for.
SLACK = 0.2
#: Ids up to this number (8 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB)


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * FACTOR + each[k : len(words) - n + 1 + k]
    out = np.sort(_mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


@lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    odd = random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd[:, None], random.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of n universal hashes (multiply and add over 32 bits) over a set."""
    a, b = _family(n)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, np.uint32(0xFFFFFFFF))
    for k in range(0, len(x), 256):
        block = a * x[None, k : k + 256]
        block += b
        np.minimum(out, block.min(axis=1), out=out)
    return out


def _bands(mins: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band for each row of minima."""
    cut = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(ROWS):
        out = _mix(out * FACTOR + cut[:, :, k])
    return out.view(np.int64)


def _sketch(texts: list[bytes], width: int) -> pa.Array:
    hashes = WordHashes()
    sets = [shingle_set(x, width, hashes) for x in texts]
    full = [k for k, x in enumerate(sets) if len(x)]
    bands: list = [None] * len(texts)
    if full:
        made = _bands(np.stack([minima(sets[k], BANDS * ROWS) for k in full]))
        for k, row in zip(full, made, strict=True):
            bands[k] = row
    node = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64))) if len(x) else None for x in sets]
    sizes = pa.array([len(x) for x in sets], pa.int64())
    return pa.StructArray.from_arrays([sizes, pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["n_shingles", "node", "bands"])


def sketches(docs: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """The given columns, n_shingles, node and bands of every document."""
    made = with_made(docs.select(*columns, "text"), "sketch_", "struct<n_shingles: bigint, node: bigint, bands: array<bigint>>", lambda x: _sketch(x, width))
    return made.select(*columns, "sketch_.*")


def pack(shingles: np.ndarray) -> bytes:
    """48-bit fingerprints of a sorted set as steps, byte plane by byte plane; the upper planes are almost all zero."""
    short = shingles >> np.uint64(16)
    steps = np.diff(short, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _sets(texts: list[bytes], width: int) -> pa.Array:
    hashes = WordHashes()
    out: dict[str, list] = {"node": [], "signature": [], "shingles": [], "n": []}
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
    for text in texts:
        x = shingle_set(text, width, hashes)
        out["node"].append(int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64)) if len(x) else None)
        out["signature"].append(minima(x, SIGNATURE).astype(np.uint8).tobytes())
        out["shingles"].append(pack(x))
        out["n"].append(len(x))
    return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))


def only_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose doc_id is (or, with left_anti, is not) among ids; a small set of ids is sent along, a large one joined."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", how)


def candidate_buckets(sketched: DataFrame) -> DataFrame:
    """bucket and node, for buckets with two nodes or more; of buckets with the same members one is kept."""
    placed = sketched.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = checkpointed(placed.join(shared, "bucket").select("bucket", "node").distinct())
    marks = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    one = marks.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return checkpointed(members.join(one, "bucket", "left_semi"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets reach the similarity: first by signature, then on the full sets.

    A hub u of very many pairs makes an uneven partition, which Spark's adaptive joins split.
    """
    left = sets.select(F.col("node").alias("u"), F.col("signature").alias("su"), F.col("shingles").alias("xu"))
    right = sets.select(F.col("node").alias("v"), F.col("signature").alias("sv"), F.col("shingles").alias("xv"))
    least = percent / 100 - SLACK

    def run(batches):
        for batch in batches:
            u, v, su, xu, sv, xv = (batch.column(c).to_pylist() for c in ("u", "v", "su", "xu", "sv", "xv"))
            keep = []
            for k in range(len(u)):
                same = np.count_nonzero(np.frombuffer(su[k], np.uint8) == np.frombuffer(sv[k], np.uint8)) / SIGNATURE
                if (same - 1 / 256) / (1 - 1 / 256) < least:
                    continue
                both = np.concatenate([unpack(xu[k]), unpack(xv[k])])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64())], names=["u", "v"])
        give_back()

    return pairs.join(right, "v").join(left, "u").select("u", "v", "su", "xu", "sv", "xv").mapInArrow(run, "u long, v long")


def bucket_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join the components within each bucket: a spanning forest of them, never all pairs.

    A bucket of more than BLOCK shingles is cut into blocks, and each two of its blocks meet in one task, so no task holds a whole
    hot bucket. Within a task an index of the shingles gives one node's common shingles with all others at once.
    """
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    sized = placed.join(sets.select("node", "n"), "node")
    mixed = checkpointed(sized.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n_")).where("lo <> hi").select("bucket", "blocks", "n_"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = hot_join(placed, mixed, "bucket", "n_", members.count()).withColumn("own", own)
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = met.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "part")
    full = tasks.join(sets.select("node", "shingles"), "node")

    def run(table: pa.Table) -> pa.Table:
        node, part, packed = (table.column(c).to_pylist() for c in ("node", "part", "shingles"))
        found = forest(part, [unpack(x) for x in packed], percent)
        if table.nbytes > BLOCK:
            give_back()
        return pa.table({"u": pa.array([node[i] for i, _ in found], pa.int64()), "v": pa.array([node[j] for _, j in found], pa.int64())})

    return full.groupBy("bucket", "a", "b").applyInArrow(run, "u long, v long").distinct()


def forest(parts: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs (i, j) that join the parts as far as links between them do; at most one fewer than there are parts."""
    names, part = np.unique(np.array(parts), return_inverse=True)
    if len(names) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, starts = owner[order], np.append(np.searchsorted(shingle[order], np.arange(shingle.max() + 1)), len(order))
    begins = np.cumsum(sizes) - sizes
    largest, out = np.argmax(np.bincount(part)), []
    for i in np.flatnonzero(part != largest):
        own = shingle[begins[i] : begins[i] + sizes[i]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common)):
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(i), int(j)))
    return out


def roots(sketched: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """node and root for every node that is linked with another."""
    members = candidate_buckets(sketched)
    spark = docs.sparkSession
    if members.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    nodes = members.select("node").distinct()
    # the rows of a text that is copied very often become one before they meet the nodes
    least = sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = least.join(nodes, "node", "left_semi").select("doc_id").distinct()
    texts = only_ids(docs.select("doc_id", "text"), checkpointed(chosen))
    kind = "struct<node: bigint, signature: binary, shingles: binary, n: bigint>"
    made = with_made(texts.select("text"), "set_", kind, lambda x: _sets(x, width)).select("set_.*").where("node IS NOT NULL")
    sets = written(made.groupBy("node").agg(F.first("signature").alias("signature"), F.first("shingles").alias("shingles"), F.max("n").alias("n")), "sets")

    # first each node meets one other only: the smallest that any of its buckets holds
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n_"))
    first = hot_join(members, hubs, "bucket", "n_", members.count()).where("node <> hub").groupBy("node").agg(F.min("hub").alias("hub"))
    links = checkpointed(verified(first.select(F.col("hub").alias("u"), F.col("node").alias("v")), sets, percent))
    labels = checkpointed(connected_components(links))
    # then buckets that still hold several components look for links between these
    more = checkpointed(bucket_links(members, labels, sets, percent))
    if more.isEmpty():
        return labels
    # a component found before is said by its root alone
    return checkpointed(connected_components(labels.select(F.col("root").alias("u"), F.col("node").alias("v")).union(more)))


def with_least(docs: DataFrame, width: int, percent: int, columns: list[str]) -> DataFrame:
    """The given columns, n_shingles and `least` of every document: the least values of these columns in its group.

    least is null for a document without shingles or doc_id, and for one that stands alone. Only groups of two or more take part in joins, and
    keys that very many rows or nodes have (a text copied very often, a very large component) are joined by broadcast.
    """
    sketched = written(sketches(docs, width, columns), "sketches")
    labels = roots(sketched.where("doc_id IS NOT NULL"), docs, width, percent)
    rows = sketched.select(*columns, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n_"), F.min(F.struct(*columns)).alias("own"))
    groups = checkpointed(nodes.join(labels, "node", "left").where("n_ > 1 OR root IS NOT NULL"))
    linked = groups.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("m_"))
    within = hot_join(linked, least, "root", "m_", linked.count()).select("node", "n_", "least")
    copies = groups.where("root IS NULL").select("node", "n_", F.col("own").alias("least"))
    table = checkpointed(within.union(copies))
    return hot_join(rows, table, "node", "n_", rows.count(), "left").select(*columns, "n_shingles", "least")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; links need a similarity of percent / 100 or more."""
    placed = with_least(docs, width, percent, ["doc_id"])
    out = placed.select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another of their group stands for; the columns stay.

    Rows are told apart by doc_id and text (its 64-bit hash): the least row of a group stays, whatever other texts its doc_id or
    theirs has. Rows that repeat a doc_id and a text stand for each other too: one of them stays.
    """
    mark = fresh_name(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    placed = with_least(marked, width, percent, ["doc_id", mark])
    stays = F.col("least").isNull() | (F.struct("doc_id", mark) == F.col("least"))
    found = checkpointed(placed.select("doc_id", mark, stays.alias("kept")))
    again = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    if again.isEmpty():
        return only_ids(docs, gone, "left_anti")
    # an id on one row goes by the id alone; rows that share an id go by their text as well
    single = only_ids(docs, gone.union(again).distinct(), "left_anti")
    chosen = only_ids(found.where("kept"), again).select("doc_id", mark).distinct()
    repeated = only_ids(marked, again).dropDuplicates(["doc_id", mark]).join(chosen, ["doc_id", mark], "left_semi")
    return single.unionByName(repeated.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, percent=80)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT root, y FROM reach JOIN links ON node = x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY 1) c ON c.node = w.doc_id
"""
