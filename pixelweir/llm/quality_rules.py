"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. Policies are
masks over those bits, with a version in their name, so a policy can be changed, compared or ablated without reading a
text again.

Defined results: a null or empty text is one without words and so fails the base rules; a very long text is measured whole by one task; rules compare
measurements with fixed limits, so nothing can tie (a measurement at a limit passes); rows are never merged, so repeated ids
give repeated rows; an empty table gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import documents, fresh_name, per_row, with_made

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
NOT_WORD_CODE_POINTS = SPACE + bytes(range(0x80, 0xC0))

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"

#: Rules in the order of their bits: name and failing condition over the measurements, as SQL for Spark and DuckDB alike.
RULES = (
    ("too_short", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 30 * n_letters"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[x] for x in names)


#: Versioned policies: which rules reject a document.
POLICIES = {
    "base-1": mask("too_short", "repeated_words"),
    "prose-1": mask("too_short", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"),
}


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeat_words(words: list[bytes]) -> int:
    """Words within a window of three that stands at two or more places."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs, n = ids[:-1] * len(seen) + ids[1:], len(seen)
    if n >= 1 << 20:  # the product of three would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= hit
    return int(covered.sum())


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def measure(texts: Iterable[bytes]) -> dict[str, list[int]]:
    """The measurements of each text."""
    out: dict[str, list[int]] = {x.strip().split(" ")[0]: [] for x in MEASURES.split(",")}
    for text in texts:
        words = text.split()
        again, lines = dup_lines(text)
        values = (len(words), len(text.translate(None, NOT_WORD_CODE_POINTS)), _count(text, SYMBOLS), again, repeat_words(words), lines, _count(text, UPPER), _count(text, LETTERS))
        for kept, value in zip(out.values(), values, strict=True):
            kept.append(value)
    return out


def failure_bits() -> Column:
    """One bit for each rule that the measurements fail."""
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every document."""
    return per_row(docs, ["doc_id", "text"], MEASURES, lambda x: measure(x["text"])).drop("text").withColumn("fail_bits", failure_bits())


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, documents that only it rejects, documents kept with and without it.

    One pass over a ledger that counts rows by their failure bits; there are at most 2 ** len(RULES) such groups.
    """
    chosen = POLICIES[policy]
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & chosen]
    each = counts.withColumn("rule", F.explode(F.array(*rules))).select("bits", "n", "rule.*")
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("failed_only"),
        total(F.col("bits") == 0).alias("kept"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"),
    )


def keep_passing(docs: DataFrame, policy: str) -> DataFrame:
    """The documents that a policy keeps, with the columns they came with."""
    bits, held = fresh_name(docs, "fail_bits"), fresh_name(docs, "measured")
    names = [x.strip().split(" ")[0] for x in MEASURES.split(",")]

    def work(texts: list[bytes]) -> pa.Array:
        found = measure(texts)
        return pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in names], names)

    rows = with_made(docs, held, f"struct<{', '.join(f'{c}: bigint' for c in names)}>", work)
    failing = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        for name in names:
            condition = _qualified(condition, name, held)
        failing = failing.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn(bits, failing).where(passes(policy, bits)).select(*docs.columns)


def _qualified(condition: str, name: str, struct: str) -> str:
    return " ".join(f"{struct}.{x}" if x == name else x for x in condition.split(" "))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under both policies."""
    base, full = passes("base-1"), passes("prose-1")
    rows = ledger(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), full.alias("kept"), "fail_bits")


_BITS = " + ".join(f"(CASE WHEN {condition} THEN {1 << k} ELSE 0 END)" for k, (_, condition) in enumerate(RULES))

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
full_lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN full_lines ON w.r = full_lines.r
),
bits AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {POLICIES["base-1"]}) <> 0 AS base_failed, (fail_bits & {POLICIES["prose-1"]}) = 0 AS kept, fail_bits
FROM bits
"""
