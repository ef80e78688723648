"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Arrow types of simple columns; columns of other types must come as Arrow arrays.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
#: Rows that a task turns into Python values at a time.
SLICE = 1000
#: Rows of one range of numbered(): at first this many, beyond MANY ranges up to the second figure.
RANGE_ROWS, MOST_RANGE_ROWS, MANY = 20_000, 1_000_000, 1000
#: A key with more than this share of all rows is hot; there are at most as many such keys.
HOT_KEYS = 4096
#: Rows of a few numbers that may be sent to every executor.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def per_row(df: DataFrame, columns: list[str], made: str, work: Callable[[dict[str, list]], dict[str, list]], read: list[str] | None = None) -> DataFrame:
    """Keeps `columns` of df and adds those of the schema `made`, computed by `work` from a batch's columns (or only those in `read`).

    Texts come as bytes (null as empty), other columns as Python values, SLICE rows at a time. Rows stay in their task; nothing is shuffled.
    """
    read = columns if read is None else read
    kept = df.select(*columns)
    added = {f.name: ARROW.get(f.dataType.simpleString()) for f in StructType.fromDDL(made)}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            given = {c: text_bytes(batch.column(c)) if pa.types.is_string(batch.column(c).type) or pa.types.is_large_string(batch.column(c).type) else batch.column(c).to_pylist() for c in read}
            got = work(given)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(got[c] if isinstance(got[c], pa.Array) else pa.array(got[c], kind) for c, kind in added.items())], names=[*columns, *added])

    return kept.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that this Python process no longer uses to the system; Spark keeps its workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_made(df: DataFrame, name: str, kind: str, work: Callable[[list[bytes]], pa.Array], text: str = "text") -> DataFrame:
    """df with a column `name` of the type `kind`, computed by `work` from the texts of a column, SLICE at a time, as bytes (null as empty).

    Only the texts go to Python and only the new column comes back; rows stay in their task and other columns in the JVM.
    """

    @F.arrow_udf(kind)
    def made(column: pa.Array) -> pa.Array:
        out = pa.concat_arrays([work(text_bytes(column.slice(k, SLICE))) for k in range(0, max(1, len(column)), SLICE)])
        give_back()
        return out

    # not deterministic, so that a filter on the new column is not moved below it and computes it a second time
    return df.withColumn(name, made.asNondeterministic()(F.col(f"`{text}`")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed now and held in the shared folder, with the lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like checkpointed(), as a Parquet table: smaller, and read by column."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[str | Column], name: str, rows: int | None = None) -> DataFrame:
    """df with `name`: each row's number, from 0, in the given order (of equal rows any may come first).

    Ranges of the order are cut by Spark so that they hold about equally many rows, however the values lie; each is sorted by one
    task, and starts at the number of rows before it. The ranges are written to the shared folder first, so that their numbers stay.
    """
    rows = df.count() if rows is None else rows
    ranges = max(1, min(MANY, math.ceil(rows / RANGE_ROWS)), math.ceil(rows / MOST_RANGE_ROWS))
    part, at = fresh_name(df, "range_part"), fresh_name(df, "range_at")
    # rows that are equal in the order but not altogether (many nulls, say) may be parted too
    order = [*order, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))]
    cut = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(cut.withColumn(part, F.spark_partition_id()).withColumn(at, number), "ranges")
    counts = held.groupBy(F.col(part).alias("part_key")).agg(F.count("*").alias("part_rows"))
    before = F.sum("part_rows").over(Window.orderBy("part_key").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part_key", F.coalesce(before, F.lit(0)).alias("part_start"))
    found = held.join(F.broadcast(starts), F.col(part) == F.col("part_key"))
    return found.withColumn(name, F.col(at) + F.col("part_start")).select(*df.columns, name)


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key and says in `count` how many rows of left have it (of `rows` in all).

    Keys of more than one row in HOT_KEYS are joined by broadcast (there are at most HOT_KEYS of them), so that no task gets all the
    rows of one; the others by a shuffle on the key. Rows with a null key have no partner and are not shuffled.
    """
    hot = F.col(count) * HOT_KEYS > rows
    few, rest = F.broadcast(right.where(hot).drop(count)), right.where(~hot).drop(count)
    keyed = left.where(F.col(key).isNotNull())
    others = keyed.join(F.broadcast(right.where(hot).select(key)), key, "left_anti")
    found = keyed.join(few, key).unionByName(others.join(rest, key, how))
    return found if how == "inner" else found.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
