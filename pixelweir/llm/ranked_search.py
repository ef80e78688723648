"""Ranked lexical search through bit-sliced Bloom signatures.

The index holds documents in blocks of about the same number of terms. A block is a matrix of bits: a column for each document, and a row (a slice) for each
place of a Bloom filter. A document sets the places of each of its terms, and of the term with each level of LEVELS that its count reaches. The slices of a
term's places, combined by AND, mark every document that holds the term so often, and a few that don't.

For a set of items each block gives upper bounds: the greatest count that the levels allow a term, put into the score with the document's exact length, times
the term's weight, summed over the item's terms. Bounds are never below scores. The documents with the highest bounds are scored exactly from their
texts; the score (and doc_id) of the last of these that would make the list is a threshold that the list cannot fall below. Then every document whose bound
does not prove that it comes after the threshold is scored exactly, and the list is taken from these, so it is exact whatever the filters say.

Only the items' terms (at most MAX_TERMS in a batch of items; more items go in several batches) are sent to the tasks. A task keeps no more than
`top` documents of an item while it reads blocks. Documents to be scored are found by doc_id and a hash of the text, by broadcast if they are few.

Defined results: a null text has no terms, nor has an empty one; such documents count in neither N nor L and are never found; a null doc_id comes first among equal scores;
rows that repeat are all ranked; a term that an item repeats counts once; items that repeat with the same text are one; an item without terms, or whose terms no
document holds, finds nothing; very long texts count whole, in blocks of their like; without documents or items the result is empty; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pixelweir.llm.common import BROADCAST_ROWS, SLICE, documents, text_bytes, written

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Counts of a term in a document that the signature tells apart; a term of level j stands less often than level j + 1 says.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096])
#: Places of a term, and of a term with a level above the first (which is asked for only where the term was found); at least so many bits for each key.
FIRST, OTHER, BITS = 6, 3, 12
#: Documents of a block, and bits of its matrix.
BLOCK, MATRIX_BITS = 512, 1 << 25
TOP = 50
#: Documents that are scored for a threshold, for each place of the list.
TRIED = 2
#: Distinct terms, and items, of a batch.
MAX_TERMS, MAX_ITEMS = 50_000, 4096
#: The score's terms (fixed by its definition): tf * ONE div (1000 * tf + 20 * m), and what no count exceeds.
ONE, MOST = 1_000_000_000, 1_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "width long, marks array<long>, n_terms array<long>, bits binary, df_terms array<long>, df array<long>"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, in order; only A-Z are lower-cased."""
    return TERM.findall(text.lower())


def _keys(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    x = hashes + levels.astype(np.uint64) * FACTOR
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _places(keys: np.ndarray, width: int, n: int) -> np.ndarray:
    """n places in a filter of `width` bits for each key."""
    a, b = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(n, dtype=np.uint64) * b[:, None]) % np.uint64(width)).astype(np.int64)


def width_for(keys: int) -> int:
    """Bits of the filter for so many keys: a power of two or one and a half of it."""
    width = 1 << max(6, (BITS * keys - 1).bit_length())
    return width * 3 // 4 if width * 3 // 4 >= BITS * keys else width


class Hashes(dict):
    """64-bit hashes of terms, kept for terms seen before."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[term] = value = xxhash.xxh3_64_intdigest(term)
        return value


class _Block:
    """Documents of one width that are collected for a matrix."""

    def __init__(self, width: int):
        self.width, self.ids, self.marks, self.n, self.places = width, [], [], [], []

    def full(self) -> bool:
        return len(self.ids) >= BLOCK or (len(self.ids) + 8) * self.width > MATRIX_BITS

    def add(self, doc_id, mark: int, n: int, keys: np.ndarray, first: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.marks.append(mark)
        self.n.append(n)
        self.places.append(np.concatenate([_places(keys[first], self.width, FIRST).reshape(-1), _places(keys[~first], self.width, OTHER).reshape(-1)]))

    def matrix(self) -> bytes:
        columns = np.repeat(np.arange(len(self.places)), [len(x) for x in self.places])
        bits = np.zeros((self.width, -(-len(self.ids) // 8) * 8), bool)
        bits[np.concatenate(self.places), columns] = True
        return np.packbits(bits, axis=1).tobytes()


def index(docs: DataFrame, vocabulary: set[int]) -> DataFrame:
    """Blocks of the documents with terms: doc_ids, marks (hash of the text), numbers of terms and the bits, width by width; and in the last row of a
    task, in how many of its documents each term (by its hash) of the vocabulary stands."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("text IS NOT NULL")
    id_kind = to_arrow_type(kept.schema["doc_id"].dataType)
    longs = pa.list_(pa.int64())
    kinds = [pa.list_(id_kind), pa.int64(), longs, longs, pa.binary(), longs, longs]
    names = ["doc_ids", *(x.split(" ")[0] for x in BLOCKS.split(", "))]
    signed = np.array(sorted(vocabulary), np.uint64)

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, open_, df = Hashes(), {}, np.zeros(len(signed), np.int64)
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                each = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
                if len(signed):
                    at = np.minimum(np.searchsorted(signed, each), len(signed) - 1)
                    df[at[signed[at] == each]] += 1
                reached = np.searchsorted(LEVELS, np.fromiter(counts.values(), np.int64, len(counts)), "right")
                of = np.repeat(np.arange(len(each)), reached)
                level = np.arange(len(of)) - np.repeat(np.cumsum(reached) - reached, reached)
                keys = _keys(each[of], level)
                width = width_for(len(keys))
                block = open_.setdefault(width, _Block(width))
                block.add(doc_id, mark, len(found), keys, level == 0)
                if block.full():
                    yield row(block.ids, width, block.marks, block.n, block.matrix(), [], [])
                    del open_[width]
        for width, block in open_.items():
            yield row(block.ids, width, block.marks, block.n, block.matrix(), [], [])
        seen = np.flatnonzero(df)
        if len(seen):
            yield row([], 0, [], [], b"", signed[seen].view(np.int64), df[seen])

    return kept.mapInArrow(run, f"doc_ids array<{kept.schema['doc_id'].dataType.simpleString()}>, {BLOCKS}")


class Items:
    """A batch of items: their terms, and once the corpus is known these terms' weights."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        named = [list(dict.fromkeys(terms(x))) for x in texts]
        self.vocabulary = sorted({t for many in named for t in many})
        place = {t: k for k, t in enumerate(self.vocabulary)}
        self.terms = [np.array([place[t] for t in many], np.int64) for many in named]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.vocabulary], np.uint64)
        self.weights, self.df = np.zeros(len(self.vocabulary), np.int64), np.zeros(len(self.vocabulary))
        self.n_docs = self.n_terms = 0

    def know(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        """Sets the weights from the number of documents and terms, and the documents of each term (by its signed hash)."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.df = np.array([df.get(int(h), 0) for h in self.hashes.view(np.int64)], np.float64)
        self.weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * self.df + 1))).astype(np.int64)

    def length(self, n: int) -> int:
        """m of a document of n terms."""
        return 50 + 50 * n * self.n_docs // self.n_terms

    def score(self, counts: dict[bytes, int], n: int, item: int) -> int:
        m, out = self.length(n), 0
        for k in self.terms[item].tolist():
            tf = counts.get(self.vocabulary[k], 0)
            if tf:
                out += int(self.weights[k]) * (ONE * tf // (1000 * tf + 20 * m))
        return out

    def bounds(self, width: int, n_terms: list[int], bits: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds (item, document) of a block, and the scores to be expected."""
        docs = len(n_terms)
        matrix = np.frombuffer(bits, np.uint8).reshape(width, -1)
        level = np.zeros((len(self.vocabulary), docs), np.uint8)
        alive, held = np.arange(len(self.vocabulary)), None
        for j in range(len(LEVELS)):
            places = _places(_keys(self.hashes[alive], np.full(len(alive), j)), width, OTHER if j else FIRST)
            slices = np.bitwise_and.reduce(matrix[places], axis=1)
            held = slices if held is None else held & slices
            some = held.any(axis=1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            level[alive] += np.unpackbits(held, axis=1, count=docs)
        m = np.array([self.length(n) for n in n_terms], np.int64)
        most = np.append(LEVELS[1:] - 1, 0)[:, None]
        worth = np.vstack([np.zeros(docs, np.int64), ONE * most // (1000 * most + 20 * m)])
        worth[-1] = MOST
        columns = np.arange(docs)
        false = (int(np.bitwise_count(matrix).sum()) / (width * docs)) ** FIRST
        trust = self.weights * self.df / np.maximum(self.df + false * (self.n_docs - self.df), 1e-9)
        most, likely = np.zeros((len(self.terms), docs), np.int64), np.zeros((len(self.terms), docs))
        for i, t in enumerate(self.terms):
            found = worth[level[t], columns]
            most[i], likely[i] = self.weights[t] @ found, trust[t] @ found
        return most, likely


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], list[int], int, bytes]]:
    """doc_ids, marks, n_terms, width and bits, a block at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in ("doc_ids", "marks", "n_terms", "width", "bits"))


def most_likely(blocks: DataFrame, items: Items, top: int) -> DataFrame:
    """item, doc_id, mark and expected: of each task's documents those with the highest expected scores."""
    kind = blocks.schema["doc_ids"].dataType.elementType
    types = [pa.int32(), to_arrow_type(kind), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items.ids]
        for ids, marks, n_terms, width, bits in _blocks(batches):
            for i, row in enumerate(items.bounds(width, n_terms, bits)[1]):
                few = np.flatnonzero(row > (best[i][-1][0] if len(best[i]) == top else 0))
                if len(few) > top:
                    few = few[np.argpartition(-row[few], top)[:top]]
                if len(few):
                    best[i] = sorted(best[i] + [(float(row[k]), ids[k], marks[k]) for k in few], key=lambda x: -x[0])[:top]
        rows = [(i, doc, mark, expected) for i, many in enumerate(best) for expected, doc, mark in many]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names=["item", "doc_id", "mark", "expected"])

    return blocks.mapInArrow(run, f"item int, doc_id {kind.simpleString()}, mark long, expected double")


def not_excluded(blocks: DataFrame, items: Items, least: dict[int, tuple]) -> DataFrame:
    """item, doc_id and mark of the documents that may come before an item's threshold (score, doc_id), or be it."""
    kind = blocks.schema["doc_ids"].dataType.elementType
    types = [pa.int32(), to_arrow_type(kind), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, n_terms, width, bits in _blocks(batches):
            rows = []
            for i, row in enumerate(items.bounds(width, n_terms, bits)[0]):
                score, last = least.get(i, (0, None))
                rows += [(i, ids[k], marks[k]) for k in np.flatnonzero(row > score)]
                if score:  # of documents that can only tie, those up to the threshold's id
                    rows += [(i, ids[k], marks[k]) for k in np.flatnonzero(row == score) if ids[k] is None or (last is not None and ids[k] <= last)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names=["item", "doc_id", "mark"])

    return blocks.mapInArrow(run, f"item int, doc_id {kind.simpleString()}, mark long")


def scored(docs: DataFrame, wanted: DataFrame, items: Items) -> DataFrame:
    """item, doc_id and the exact score of the wanted documents (item, doc_id, mark), where it is above 0. Rows that repeat are all scored."""
    by_doc = written(wanted.distinct().groupBy("doc_id", "mark").agg(F.collect_list("item").alias("items")), "wanted")
    few = by_doc.select(F.sum(F.size("items") + 2)).first()[0] or 0
    right = by_doc.withColumnsRenamed({"doc_id": "doc_id_", "mark": "mark_"})
    right = F.broadcast(right) if few <= 4 * BROADCAST_ROWS else right.hint("shuffle_hash")
    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("text IS NOT NULL")
    found = kept.join(right, (F.col("mark") == F.col("mark_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))).select("doc_id", "text", "items")
    types = [pa.int32(), to_arrow_type(kept.schema["doc_id"].dataType), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            rows = []
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                all_ = terms(text)
                counts = Counter(all_)
                rows += [(i, doc_id, s) for i in asked if (s := items.score(counts, len(all_), i)) > 0]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, types, strict=True)], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, f"item int, doc_id {kept.schema['doc_id'].dataType.simpleString()}, score long")


def first_of_each(rows: DataFrame, order: list, top: int, salt: str) -> DataFrame:
    """The first `top` rows of each item, with their rank; chosen within salted parts first."""
    part = F.pmod(F.xxhash64(salt), F.lit(64))
    some = rows.withColumn("part_", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part_").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part_")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def batches_of(items: DataFrame) -> Iterator[Items]:
    """Items (item_id, text) in batches of bounded size; they pass through the driver one by one."""
    ids, texts, seen = [], [], set()
    for row in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"].encode())
        seen.update(terms(texts[-1]))
        if len(ids) == MAX_ITEMS or len(seen) > MAX_TERMS:
            yield Items(ids, texts)
            ids, texts, seen = [], [], set()
    if ids:
        yield Items(ids, texts)


def search_batch(docs: DataFrame, items: Items, kind: str, top: int) -> DataFrame:
    """search() for one batch; kind is the type of item_id."""
    spark = docs.sparkSession
    held = written(index(docs, set(items.hashes.tolist())), "signatures")
    blocks = held.where("width > 0")
    known = blocks.agg(F.sum(F.size("n_terms")).alias("n"), F.sum(F.expr("aggregate(n_terms, 0L, (a, x) -> a + x)")).alias("terms")).first()
    counted = held.where("width = 0").select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.df").alias("n"))
    items.know(known["n"] or 0, known["terms"] or 0, {r[0]: r[1] for r in counted.collect()})
    likely = first_of_each(most_likely(blocks, items, TRIED * top), [F.col("expected").desc(), F.col("mark")], TRIED * top, "mark")
    rank = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    tried = first_of_each(scored(docs, likely.select("item", "doc_id", "mark"), items), rank, top, "doc_id")
    least = {r["item"]: (r["score"], r["doc_id"]) for r in tried.where(F.col("rank") == top).collect()}
    wanted = written(not_excluded(blocks, items, least), "not-excluded")
    found = first_of_each(scored(docs, wanted, items), rank, top, "doc_id")
    names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's highest-scoring documents."""
    out, kinds = None, [frame.schema[c].dataType.simpleString() for frame, c in ((items, "item_id"), (docs, "doc_id"))]
    for batch in batches_of(items):
        found = search_batch(docs, batch, kinds[0], top)
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    return docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH asked AS (SELECT DISTINCT item_id, text FROM benchmark),
wanted AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM asked),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
lengths AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM held, corpus),
scores AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}
"""
