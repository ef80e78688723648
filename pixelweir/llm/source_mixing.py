"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Every source's documents form blocks. A source with a share of q out of Q slots must run its block k in the window from its
release, floor(k * Q / q), to its deadline, ceil((k + 1) * Q / q). Earliest deadline first among the released blocks meets
every deadline, so at any slot each source has had its share to within less than one block.

The target weights are whole numbers and are taken as they are: Q is their sum (without a common factor), and the schedule repeats
after Q slots. One period is worked out from the weights alone, on the driver with two heaps (Q steps); every block of every
source takes its slot from it by arithmetic, on the executors. Only if the sum exceeds PERIOD are the shares rounded to that many
slots: every source gets one slot, and the others follow what the weights are above that slot, by largest remainders.

All documents are placed. When a source has run out, its slots stay empty and the others keep their order and proportions.
Within a source the order is by md5 of the doc_id. Rows are numbered in ranges that Spark cuts to equal size, so a hot source
is numbered by many tasks.

Defined results: a null source is a source of its own (weighted as any other); a null doc_id is ordered by the md5 of
the empty text; rows that repeat an id get places next to each other, in any order; of blocks with the same deadline that of the
first name runs first; a weight below 1 is an error, a source without a weight is left out, and so is a weight without documents;
empty and very long texts count as one document each; an empty table gives an empty schedule; other columns pass through mix()
as they are, and schedule() does not read them.

mix_and_note() also writes the places and names their folder in the metadata of the column `source`, which goes along with the rows through
files; noted_places() gives later rows these places. Rows are found by doc_id and source; of rows that share both, each takes one of their places. Rows
that came after the mixture have no place (null), and neither has any row if nothing was noted.
"""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import documents, fresh_name, numbered, shared_folder, written

#: Slots of a period that is worked out; also the largest number of sources.
PERIOD = 1 << 19
BLOCK_DOCS = 64
#: Where the metadata of `source` name the folder of the places.
NOTE = "mixture_places"


def tempered_weights(docs: DataFrame, source: Column) -> DataFrame:
    """name and share of each source: the whole part of the square root of its documents."""
    return docs.groupBy(source.alias("name")).agg(F.floor(F.sqrt(F.count("*"))).alias("share"))


def whole_shares(weights: list[int], period: int = PERIOD) -> list[int]:
    """The weights without their common factor; scaled to `period` slots, by largest remainders, if their sum is larger."""
    if any(w < 1 for w in weights) or len(weights) > period:
        raise ValueError(f"weights must be positive whole numbers, at most {period} of them")
    factor = math.gcd(*weights) or 1
    shares, total = [w // factor for w in weights], sum(weights) // factor
    if total <= period:
        return shares
    # one slot for each source first, the others in proportion to what its weight is above that slot
    above = [max(0, w * period - total) for w in shares]
    free = period - len(shares)
    scaled = [1 + x * free // sum(above) for x in above]
    rest = sorted(range(len(shares)), key=lambda i: (-(above[i] * free % sum(above)), i))
    for i in rest[: period - sum(scaled)]:
        scaled[i] += 1
    return scaled


def one_period(shares: list[int]) -> list[int]:
    """Which source runs at each slot of a period: of the released blocks the one of earliest deadline."""
    total = sum(shares)
    waiting, ready, order = [(0, i) for i in range(len(shares))], [], []  # by release; by deadline
    done = [0] * len(shares)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // shares[i]), i))
        _, i = heapq.heappop(ready)
        order.append(i)
        done[i] += 1
        if done[i] < shares[i]:
            heapq.heappush(waiting, (done[i] * total // shares[i], i))
    return order


def period_table(shares: DataFrame) -> DataFrame:
    """slot_name, share, total, k (block in the period) and slot, for each slot of one period.

    shares has name and share (the target weight) of each source.
    """
    given = sorted((r["name"], r["share"]) for r in shares.collect())
    whole = whole_shares([w for _, w in given]) if given else []
    total, seen, rows = sum(whole), [0] * len(given), []
    for slot, i in enumerate(one_period(whole)):
        rows.append((given[i][0], whole[i], total, seen[i], slot))
        seen[i] += 1
    return shares.sparkSession.createDataFrame(rows, "slot_name string, share long, total long, k long, slot long")


def placed(docs: DataFrame, shares: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with the columns rank_, block_no_, release_slot_, deadline_slot_, slot_ and in_block_ of each document added.

    docs needs doc_id and source, and none of these names or mix_name, mix_key, mix_number, first, share_name, slot_name, share, total, k and slot.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    given = tempered_weights(docs, source) if shares is None else shares.select(source.alias("name"), F.col("share").cast("long").alias("share"))
    period = period_table(given)
    keyed = docs.withColumn("mix_name", source).withColumn("mix_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = numbered(keyed, ["mix_name", "mix_key"], "mix_number")
    # both tables have PERIOD rows at most, so they may be sent to every executor
    shares_of = F.broadcast(period.where("k = 0").select(F.col("slot_name").alias("share_name"), "share", "total"))
    table = F.broadcast(period.select("slot_name", "k", "slot"))
    first = rows.groupBy("mix_name").agg(F.min("mix_number").alias("first")).join(shares_of, F.col("mix_name") == F.col("share_name"))
    blocks = rows.join(F.broadcast(first.drop("mix_name")), F.col("mix_name") == F.col("share_name")).withColumn("rank_", F.col("mix_number") - F.col("first"))
    blocks = blocks.withColumn("block_no_", F.expr(f"rank_ DIV {block_docs}")).withColumn("in_block_", F.expr(f"rank_ % {block_docs}"))
    found = blocks.join(table, (F.col("mix_name") == F.col("slot_name")) & (F.expr("block_no_ % share") == F.col("k")))
    return found.select(
        *docs.columns, "rank_", "block_no_", "in_block_",
        F.expr("block_no_ * total DIV share").alias("release_slot_"),
        F.expr("((block_no_ + 1) * total + share - 1) DIV share").alias("deadline_slot_"),
        F.expr("(block_no_ DIV share) * total + slot").alias("slot_"),
    )


def schedule(docs: DataFrame, shares: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block_no, in_block, release_slot, deadline_slot and slot of every document."""
    found = placed(docs.select("doc_id", "source"), shares, block_docs)
    return found.select("doc_id", "source", *(F.col(f"{x}_").cast("long").alias(x) for x in ("block_no", "in_block", "release_slot", "deadline_slot", "slot")))


def mix(docs: DataFrame, shares: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All documents, with their own columns, in the order of the schedule."""
    kept = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "source")
    return placed(kept, shares, block_docs).orderBy("slot_", "in_block_").select("row_.*")


def mix_and_note(docs: DataFrame, shares: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """What mix() gives, with the places written (doc_id, source, slot, in_block) and noted."""
    found = placed(docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "source"), shares, block_docs)
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/places-{uuid.uuid4().hex}"
    found.select("doc_id", "source", F.col("slot_").cast("long").alias("slot"), F.col("in_block_").cast("long").alias("in_block")).write.parquet(folder)
    rows = found.orderBy("slot_", "in_block_").select("row_.*")
    return rows.withMetadata("source", docs.schema["source"].metadata | {NOTE: folder})


def alike(other: str) -> Column:
    """doc_id and source are those that another table calls other_id and other_source; null equals null."""
    return F.col("doc_id").eqNullSafe(F.col(f"{other}_id")) & F.col("source").eqNullSafe(F.col(f"{other}_source"))


def numbered_alike(rows: DataFrame) -> DataFrame:
    """rows with nth: their number, from 0, among those of the same doc_id and source."""
    found = numbered(rows, [F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), F.col("doc_id")], "at")
    first = found.groupBy(F.col("doc_id").alias("first_id"), F.col("source").alias("first_source")).agg(F.min("at").alias("first"))
    return found.join(first, alike("first")).select(*rows.columns, (F.col("at") - F.col("first")).alias("nth"))


def noted_places(rows: DataFrame) -> DataFrame:
    """rows with slot and in_block as mix_and_note() noted them.

    rows needs doc_id and source, and no column slot, in_block, at, first, nth, places or one that begins with first_, place_ or many_.
    """
    note = rows.schema["source"].metadata
    rows = rows.withMetadata("source", {k: v for k, v in note.items() if k != NOTE})
    if NOTE not in note:
        return rows.withColumns({x: F.lit(None).cast("long") for x in ("slot", "in_block")})
    kind = rows.schema["doc_id"].dataType.simpleString()
    places = rows.sparkSession.read.schema(f"doc_id {kind}, source string, slot long, in_block long").parquet(note[NOTE])
    keys = places.groupBy(F.col("doc_id").alias("place_id"), F.col("source").alias("place_source")).agg(F.count("*").alias("places"), F.min("slot").alias("slot"), F.min("in_block").alias("in_block"))
    # rows that share doc_id and source go apart, so that none of the keys joined below is hot
    many = written(keys.where("places > 1").select(F.col("place_id").alias("many_id"), F.col("place_source").alias("many_source")), "many")
    some = not many.isEmpty()
    alone = rows.join(many, alike("many"), "left_anti") if some else rows
    # a table of places of each partition is held in memory, so that rows with long texts are not sorted
    found = alone.join(keys.where("places = 1").hint("shuffle_hash"), alike("place"), "left").select(*rows.columns, "slot", "in_block")
    if not some:
        return found
    free = numbered_alike(places.join(many, alike("many"), "left_semi")).select(F.col("doc_id").alias("place_id"), F.col("source").alias("place_source"), F.col("nth").alias("place_nth"), "slot", "in_block")
    shared = numbered_alike(rows.join(many, alike("many"), "left_semi")).join(free, alike("place") & (F.col("nth") == F.col("place_nth")), "left")
    return found.unionByName(shared.select(*rows.columns, "slot", "in_block"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE shares AS (
  SELECT name, CAST(floor(sqrt(n)) AS BIGINT) AS share, row_number() OVER (ORDER BY name) AS i
  FROM (SELECT coalesce('=' || source, '') AS name, count(*) AS n FROM documents GROUP BY 1)
),
given AS (SELECT list(share ORDER BY i) AS share, sum(share)::BIGINT AS total FROM shares),
run AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(share, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM given
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, list_min(list_filter(list_transform(range(1, len(share) + 1), lambda i: CASE
      WHEN done[i] < share[i] AND done[i] * total < (t + 2) * share[i]
      THEN (((done[i] + 1) * total + share[i] - 1) // share[i]) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS p, total
    FROM run, given WHERE t + 1 < total)
),
period AS (SELECT t AS slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM run WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS r FROM documents
),
blocks AS (SELECT doc_id, source, name, r // {BLOCK_DOCS} AS block_no, r % {BLOCK_DOCS} AS in_block FROM ranked)
SELECT b.doc_id, b.source, block_no, in_block, block_no * total // s.share AS release_slot,
  ((block_no + 1) * total + s.share - 1) // s.share AS deadline_slot, (block_no // s.share) * total + p.slot AS slot
FROM blocks b JOIN shares s ON b.name = s.name JOIN period p ON p.i = s.i AND p.k = b.block_no % s.share, given
"""
