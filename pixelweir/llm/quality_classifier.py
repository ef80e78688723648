"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text: rates of characters, lines and repeats, and the
shares of its words by WORD_BUCKETS hashes. Training looks only at preference pairs, a document labelled 1 beating one labelled 0, and
minimises the logistic loss of the difference of their features. The score is the strength, moved so that the share of labelled
documents below the threshold equals the share labelled 0 (the score quantile), and squeezed into 0 to 1.

The fit uses at most `max_rows` labelled rows (the smallest by a hash of the id), each of which meets `PAIRS` rows of the other label; so
the fit on the driver has the same size whatever the input. Only these rows' texts are read for it: their ids, bounded in number, are
sent to every executor. Scores cover every document.

Defined results: a null or empty text, or one without words, has all features 0 and is scored; a very long text is measured whole;
labels that contradict each other for one id are left out; without labels of both kinds every score is 0.5; repeated rows are scored alike;
a score equal to the threshold is predicted 1; rows with equal strength have equal scores; an empty table gives an empty result; other
columns are not read, and keep_predicted() passes them through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import documents, fresh_name, per_row, remainder, with_made

THRESHOLD = 0.3
KEPT_WORDS = 200_000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>@^~_=+\\{}[]"
STRONG = b"!?"
COMMON = b".,;:'\"()-"
FEATURES = ("length", "distinct_words", "symbols", "capitals", "digits", "exclamations", "punctuation", "word_length", "repeated_lines", "repeated_neighbours", "top_word", "symbol_words", "short_lines", "has_words")
WORD_BUCKETS = 128
SIZE = len(FEATURES) + WORD_BUCKETS
#: Penalties on squared weights: this for a word bucket's, 1 for a rate's; words need more evidence.
WORD_PENALTY = 10.0
#: Rows of the other label that each labelled row meets.
PAIRS = 5


def _n(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


class WordBuckets(dict):
    """The hash bucket of a word, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = zlib.crc32(word) % WORD_BUCKETS
        return value


def features(text: bytes, buckets: WordBuckets) -> np.ndarray:
    """The features of one text; each is between 0 and about 1."""
    words = text.split()
    if not words:
        return np.zeros(SIZE, np.float32)
    n, size = len(words), len(text)
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    counts = np.bincount(seq)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = _n(text, UPPER), _n(text, LOWER)
    symbols = _n(text, SYMBOLS)
    next_to = int((seq[1:] == seq[:-1]).sum()) if n > 1 else 0
    shares = np.bincount(np.fromiter((buckets[w.lower()] for w in ids), np.int64, len(ids)), counts, WORD_BUCKETS) / n
    rates = (
        min(1.0, np.log1p(n) / 10),
        len(ids) / n ** 0.9,
        min(1.0, symbols / n) ** 0.5,
        upper / (upper + lower) if upper + lower else 0.0,
        _n(text, DIGITS) / size,
        min(1.0, _n(text, STRONG) / n) ** 0.5,
        min(1.0, _n(text, COMMON) / n),
        min(1.0, size / n / 20),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        (next_to / n) ** 0.5,
        counts.max() / n if n > 20 else 0.0,
        min(1.0, symbols / n),
        len(lines) / n,
        1.0,
    )
    return np.concatenate((rates, np.sqrt(shares))).astype(np.float32)


def featurise(texts: list[bytes]) -> np.ndarray:
    buckets = WordBuckets()
    return np.array([features(x, buckets) for x in texts], np.float32).reshape(len(texts), SIZE)


@dataclass(frozen=True)
class Ranking:
    """Strength weights over standardised features, and the strength at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    usable: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable or not len(x):
            return np.full(len(x), 0.5)
        strength = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Weights that rank rows with y = 1 above rows with y = 0; Newton steps on the pairwise logistic loss.

    Every row meets `pairs` rows of the other label, drawn at random from a fixed seed; the order of the rows does not matter.
    """
    order = sorted(range(len(x)), key=lambda k: x[k].tobytes())
    x, y = x[order], y[order]
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1] if x.ndim > 1 else 0), np.ones(1), np.zeros(1), 0.0, usable=False)
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-2
    random = np.random.default_rng(seed)
    won = np.concatenate((np.repeat(np.arange(len(good)), pairs), random.integers(0, len(good), len(bad) * pairs)))
    lost = np.concatenate((random.integers(0, len(bad), len(good) * pairs), np.repeat(np.arange(len(bad)), pairs)))
    difference = ((good[won] - bad[lost]) / scale).astype(np.float32)
    weights = np.zeros(x.shape[1])
    penalty = np.where(np.arange(x.shape[1]) < len(FEATURES), 1.0, WORD_PENALTY)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(difference @ weights.astype(np.float32), -30, 30)))  # chance of the wrong order
        gradient = difference.T @ p - penalty * weights
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    strength = ((x - mean) / scale) @ weights
    below, above = np.sort(strength[y == 0]), np.sort(strength[y == 1])
    cut = float(np.quantile(strength, len(bad) / len(x)))
    if below[-1] < above[0]:  # any cut between the two has that quantile; the middle is the safest
        cut = float((below[-1] + above[0]) / 2)
    return Ranking(mean, scale, weights, cut)


def clean_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and label, for ids whose labels agree and are 0 or 1."""
    marked = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
    return marked.where("label = other AND doc_id IS NOT NULL").select("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Ranking:
    """A ranking from the labelled rows of docs (doc_id, text) outside the held-out fifth.

    If there are more labels than max_rows, only ids whose hash is below that share are taken; so no task sorts more rows than
    the bound (and a little for chance). Features are worked out for rows with these ids only.
    """
    marked = clean_labels(labels).where(remainder("doc_id", 5) != 0).withColumn("h", F.xxhash64("doc_id"))
    share = max_rows / max(1, marked.count())
    if share < 1:
        marked = marked.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = F.broadcast(marked)  # max_rows at most, and a little for chance
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    made = per_row(texts, ["h", "label", "text"], "features binary", lambda x: {"features": [r.tobytes() for r in featurise(x["text"])]}).drop("text")
    rows = made.orderBy("h", "features").limit(max_rows).toArrow()
    x = np.frombuffer(b"".join(rows.column("features").to_pylist()), np.float32).reshape(-1, SIZE)
    return fit_pairs(x, rows.column("label").to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, max_rows)
    scored = per_row(docs, ["doc_id", "text"], "score double", lambda x: {"score": model.score(featurise(x["text"]))}).drop("text")
    found = scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_predicted(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The documents predicted to be of quality, with the columns they came with."""
    model = fit(docs, labels, max_rows)

    name = fresh_name(docs, "score")
    scored = with_made(docs, name, "double", lambda x: pa.array(model.score(featurise(x)), pa.float64()))
    return scored.where(F.col(name) >= THRESHOLD).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
