"""Ranges of equal size, and row numbers, running sums and carried values over them, so that no single task has to order a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range that are asked for, the largest number of ranges, and how many of these one step tells apart.
RANGE, MOST_RANGES, STEP = 1 << 18, 1 << 16, 1 << 8
#: Rows of the sample that the edges of a range are taken from.
SAMPLE = 32
#: Rows that may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Keys with more than one row in so many are hot; there are at most as many of them.
HOT_KEYS = 4096


def edges(df: DataFrame, order: list[str], width: int = RANGE) -> list[tuple]:
    """Values of the order columns at which ranges of about `width` rows begin (all but the first), from a sample of bounded size."""
    rows = df.count()
    ranges = min(MOST_RANGES, -(-rows // width))
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE * ranges / rows)
    seen = df.select(*order) if share == 1 else df.select(*order).sample(share, seed=7)
    rank = lambda row: tuple((x is not None, x) for x in row)
    found = sorted(map(tuple, seen.collect()), key=rank)
    cut = [found[k * len(found) // ranges] for k in range(1, ranges)] if found else []
    return [x for k, x in enumerate(cut) if not k or x != cut[k - 1]]


def in_ranges(df: DataFrame, order: list[str], name: str, width: int = RANGE) -> DataFrame:
    """df with `name`: the number of the range that a row lies in; ranges follow the order of the columns (nulls first), and equal rows share one.

    Where the ranges begin is looked up in two steps: among every STEP-th edge, then among the edges that follow this one, which a join brings.
    """
    given = edges(df, order, width)
    if not given:
        return df.withColumn(name, F.lit(0))
    fields = [df.schema[c] for c in order]
    kind = f"struct<{', '.join(f'k{i}: {f.dataType.simpleString()}' for i, f in enumerate(fields))}>"
    spark = df.sparkSession
    groups = [given[k : k + STEP] for k in range(0, len(given), STEP)]
    # rows before the first edge of all are in a group of their own, without edges
    table = spark.createDataFrame([(0, 0, []), *((k + 1, k * STEP, g) for k, g in enumerate(groups))], f"group_ int, before_ int, edges_ array<{kind}>")
    row = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)))
    literal = lambda x: F.struct(*(F.lit(v).cast(f.dataType).alias(f"k{i}") for i, (v, f) in enumerate(zip(x, fields, strict=True))))
    count = lambda many, here: F.size(F.filter(many, lambda e: e <= here))
    found = df.withColumn("row_", row).withColumn("group_", count(F.array(*(literal(g[0]) for g in groups)), F.col("row_")))
    return found.join(F.broadcast(table), "group_").withColumn(name, F.col("before_") + count(F.col("edges_"), F.col("row_"))).drop("row_", "group_", "before_", "edges_")


def mixed(df: DataFrame) -> Column:
    """A number that parts rows which are equal in an order, unless they are equal altogether."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


def running(df: DataFrame, order: str, name: str, value: str | None = None, by: str | None = None, width: int = RANGE) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before (in `order`, within `by`), or their number without a value.

    Rows are cut into ranges of about `width` rows, however their values lie, by key, order and a mixture of the whole row. A range's start is the sum over the
    key's ranges before it; only rows of one range are sorted together. A null order comes first; a null value counts as 0; rows
    that are equal in the order follow that mixture.
    """
    keys = [by] if by else []
    worth = F.coalesce(F.col(value), F.lit(0)).cast("long") if value else F.lit(1).cast("long")
    ranged = in_ranges(df.withColumn("tie_", mixed(df)).withColumn("worth_", worth), [*keys, order, "tie_"], "range_", width)
    sums = ranged.groupBy(*keys, "range_").agg(F.sum("worth_").alias("sum_"))
    # as many rows as there are keys and ranges
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("sum_").over(whole.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("start_", F.coalesce(before, F.lit(0))).drop("sum_")
    inside = Window.partitionBy(*keys, "range_").orderBy(F.col(order).asc_nulls_first(), "tie_").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn(name, F.coalesce(F.sum("worth_").over(inside), F.lit(0)))
    if by:  # a null key is a key of its own
        right = starts.withColumnsRenamed({by: "key_", "range_": "other_"})
        found = near.join(right, F.col(by).eqNullSafe(F.col("key_")) & (F.col("range_") == F.col("other_"))).drop("key_", "other_")
    else:  # MOST_RANGES rows at most
        found = near.join(F.broadcast(starts), "range_")
    return found.withColumn(name, (F.col(name) + F.col("start_")).cast("long")).drop("range_", "worth_", "start_", "tie_")


def carried(df: DataFrame, order: str, value: Column, name: str, width: int = RANGE) -> DataFrame:
    """df with `name`: the last value that is not null among the rows before, in `order`.

    Ranges pass on the last value that they hold, so a value is carried over any number of ranges without one.
    """
    ranged = in_ranges(df.withColumn("tie_", mixed(df)), [order, "tie_"], "range_", width).withColumn("value_", value)
    last = ranged.where("value_ IS NOT NULL").groupBy("range_").agg(F.max_by("value_", F.struct(order, "tie_")).alias("last_"))
    # MOST_RANGES rows at most
    ranges = ranged.select("range_").distinct().join(last, "range_", "left")
    ahead = Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range_", F.last("last_", ignorenulls=True).over(ahead).alias("start_"))
    inside = Window.partitionBy("range_").orderBy(F.col(order).asc_nulls_first(), "tie_").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn(name, F.last("value_", ignorenulls=True).over(inside))
    return near.join(F.broadcast(starts), "range_").withColumn(name, F.coalesce(name, "start_")).drop("range_", "value_", "start_", "tie_")


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key, without sending all rows of a hot key to one task.

    A small right side is sent to every executor. Else the rows of hot keys (at most HOT_KEYS, by a count of left's) meet their partners by broadcast,
    rows without a key are set aside, and the others are shuffled.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_"))
    most = left.count() // HOT_KEYS
    hot = F.broadcast(counts.where(F.col("n_") > most).select(key))
    out = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    rest = left.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(right, key, how)
    out = out.unionByName(rest)
    return out if how == "inner" else out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
