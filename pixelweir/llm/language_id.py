"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, with word edges), by rank. A
document's own list is compared with each profile: an n-gram adds the difference of its two ranks, or the length of
the profile if it is missing there. The language of least out-of-place distance wins; ties go to the first name.

Profiles are counted over all training documents. Their size is bounded: `profile_size` n-grams for each language.

Defined results: a null text, a text without letters, or a table without training rows gives `und` and score 0; a very long text is
counted whole, in pieces; equal distances go to the first name, n-grams of equal counts to the smaller one; rows with null
lang or doc_id teach nothing; rows that repeat teach and are judged each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweir.llm.common import documents, per_row, remainder, text_bytes

PROFILE_SIZE = 400
UNKNOWN = "und"
#: Texts are cut here while n-grams are counted, at a word edge; counts are then summed.
PIECE = 1 << 18
#: Larger than any code point, so that n-grams of different lengths are different numbers.
EDGE = (1 << 21) - 1


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point its lower case letter, or 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            lower = x.lower()
            table[c] = ord(lower) if len(lower) == 1 else c
    return table


def _ngrams(letters: np.ndarray) -> np.ndarray:
    """All n-grams of one to three letters as numbers of base 2 ** 21. EDGE stands for what is between two words, once."""
    gaps = letters == 0
    x = letters[~(gaps & np.concatenate(([True], gaps[:-1])))].astype(np.int64)
    x[x == 0] = EDGE
    ends = [EDGE] if len(x) and x[-1] != EDGE else []
    x = np.concatenate(([EDGE], x, ends)).astype(np.int64)
    pairs = (x[:-1] << 21) | x[1:]
    triples = (pairs[:-1] << 21) | x[2:]
    return np.concatenate((x[x != EDGE], pairs, triples[x[1:-1] != EDGE]))


def _count(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs; counting in a sort, without an inverse."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.append(first, len(values)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    if not len(grams):
        return grams, counts
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.add.reduceat(counts, first)


def ngram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text and how often each occurs."""
    letters = _folding()[np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, at = [], 0
    while at < len(letters):
        end = min(at + PIECE, len(letters))
        if end < len(letters):
            edge = np.flatnonzero(letters[at:end] == 0)
            end = at + int(edge[-1]) + 1 if len(edge) else end
        parts.append(_count(_ngrams(letters[at:end])))
        at = end
    return parts[0] if len(parts) == 1 else _merge(parts)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, by falling count, ties by number."""
    if len(grams) > 4 * size:  # only those that can be among them
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        able = counts >= least
        grams, counts = grams[able], counts[able]
    return grams[np.lexsort((grams, -counts))][:size]


@dataclass(frozen=True)
class Profiles:
    """For each language the sorted n-grams of its profile with their ranks."""

    names: list[str]
    grams: list[np.ndarray]
    ranks: list[np.ndarray]
    size: int

    def predict(self, text: bytes) -> tuple[str, float]:
        own = _top(*ngram_counts(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        distances = []
        for grams, ranks in zip(self.grams, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            distances.append(int(np.where(grams[at] == own, np.minimum(np.abs(ranks[at] - place), self.size), self.size).sum()))
        best = int(np.argmin(distances))
        return self.names[best], 1 - distances[best] / (self.size * len(own))


def count_by_language(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all rows of docs (text, lang): each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                parts = held.setdefault(lang, [])
                parts.append(ngram_counts(text))
                if len(parts) >= 400:
                    held[lang] = [_merge(parts)]
        for lang, parts in held.items():
            grams, counts = _merge(parts)
            for k in range(0, len(grams), 50_000):
                g = pa.array(grams[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), g, pa.array(counts[k : k + 50_000], pa.int64())], names=["lang", "gram", "n"])

    partial = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of every language among the rows of docs (text, lang); `size` rows for each language reach the driver."""
    counts = count_by_language(docs.where("lang IS NOT NULL AND text IS NOT NULL"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    held: dict[str, list[tuple[int, int]]] = {}
    for row in rows:
        held.setdefault(row["lang"], []).append((row["gram"], row["rank"] - 1))
    names = sorted(held)
    made = [np.array(sorted(held[x]), np.int64) for x in names]
    return Profiles(names, [x[:, 0].copy() for x in made], [x[:, 1].copy() for x in made], size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score (1: the profile's own order, 0: no n-gram in common) of every document."""

    def work(given: dict[str, list]) -> dict[str, list]:
        found = [profiles.predict(x) for x in given["text"]]
        return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return per_row(docs, ["doc_id", "text"], "lang_pred string, score double", work).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rest = remainder("doc_id", 4)
    found = identify(docs, learn(docs.where(rest != 2)))
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
