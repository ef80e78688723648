"""Queries of the virtual-detector workload on the given tables.

The tables hold no detector frames. lineitem stands for sparse hits: the order is the image, part and supplier give the pixel of an
8 x 8 detector, the quantity is the count. events stand for messages: the user is the series, the id the order of arrival,
signup a start, error an end, anything else an image. embeddings stand for dense 8 x 8 frames, documents for blobs of varying
length. part and supplier give the calibration masks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.functions import pixels
from pixelweir.functions.config import BINNED, UNBINNED, ScanConfig
from pixelweir.operators import image, series, weights
from pixelweir.operators.ranking import running

SMALL = ScanConfig(detector=(8, 8), centre=(4.0, 4.0), radius=3.0, frame_period_us=33.30)
PERIOD = SMALL.frame_period_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("image_id"), F.pmod("l_partkey", F.lit(8)).cast("int").alias("y"), F.pmod("l_suppkey", F.lit(8)).cast("int").alias("x"), F.col("l_quantity").cast("long").alias("count"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("image")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("seq"), kind.alias("type"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of 0.5, 1 and 1.5 from the parts; pixels of even y and x are not listed."""
    part = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(8)).cast("int").alias("y"), F.pmod(F.expr("p_partkey DIV 8"), F.lit(8)).cast("int").alias("x"), "p_size")
    return part.where("(y % 2 = 1 OR x % 2 = 1)").groupBy("y", "x").agg((F.pmod(F.max("p_size"), F.lit(3)) * 0.5 + 0.5).cast("double").alias("gain"))


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel is dead where a supplier of it is in nation 7 and none is in nation 3."""
    supplier = table(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", F.lit(8)).cast("int").alias("x"), F.pmod(F.expr("s_suppkey DIV 8"), F.lit(8)).cast("int").alias("y"), "s_nationkey")
    return supplier.groupBy("y", "x").agg(F.when(F.max((F.col("s_nationkey") == 7).cast("int")) > F.max((F.col("s_nationkey") == 3).cast("int")), 0.0).otherwise(1.0).alias("good"))


def small_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.weight_map(weights.pixel_grid(spark, SMALL), SMALL, gain(spark, sf_dir), good(spark, sf_dir))


_MASKS = """
gain AS (SELECT CAST(p_partkey % 8 AS INTEGER) AS y, CAST((p_partkey // 8) % 8 AS INTEGER) AS x, CAST((max(p_size) % 3) * 0.5 + 0.5 AS DOUBLE) AS gain
  FROM part WHERE p_partkey % 2 = 1 OR (p_partkey // 8) % 2 = 1 GROUP BY 1, 2),
good AS (SELECT CAST((s_suppkey // 8) % 8 AS INTEGER) AS y, CAST(s_suppkey % 8 AS INTEGER) AS x,
  CASE WHEN max(CASE WHEN s_nationkey = 7 THEN 1 ELSE 0 END) > max(CASE WHEN s_nationkey = 3 THEN 1 ELSE 0 END) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS good
  FROM supplier GROUP BY 1, 2),
grid AS (SELECT CAST(range // 8 AS INTEGER) AS y, CAST(range % 8 AS INTEGER) AS x FROM range(64)),
weights AS (SELECT grid.y, grid.x, CAST(((grid.y - 4) * (grid.y - 4) + (grid.x - 4) * (grid.x - 4) <= 9) AS DOUBLE) * coalesce(gain, 1.0) * coalesce(good, 1.0) AS w
  FROM grid LEFT JOIN gain ON grid.y = gain.y AND grid.x = gain.x LEFT JOIN good ON grid.y = good.y AND grid.x = good.x)"""
_HITS = "hits AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 8 AS INTEGER) AS y, CAST(l_suppkey % 8 AS INTEGER) AS x, CAST(l_quantity AS BIGINT) AS count FROM lineitem)"
_SUMS = f"{_MASKS}, {_HITS}, sums AS (SELECT image_id, sum(count * w) AS s FROM hits JOIN weights ON hits.y = weights.y AND hits.x = weights.x WHERE w <> 0 GROUP BY 1)"
_MESSAGES = """messages AS (SELECT user_id AS series, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'end' ELSE 'image' END AS type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
_GATED = f"""{_MESSAGES},
starts AS (SELECT series, min(seq) AS a FROM messages WHERE type = 'start' GROUP BY 1),
bounds AS (SELECT s.series, a, min(seq) AS b FROM starts s LEFT JOIN messages m ON m.series = s.series AND type = 'end' AND seq > a GROUP BY 1, 2),
gated AS (SELECT m.series, seq, cents FROM messages m JOIN bounds b ON m.series = b.series WHERE type = 'image' AND seq > a AND (b IS NULL OR seq < b))"""


def weight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_weights(spark, sf_dir)


def flat_dark_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both masks on the whole grid: what is not listed counts as 1."""
    grid = weights.pixel_grid(spark, SMALL)
    full = grid.join(gain(spark, sf_dir), ["y", "x"], "left").join(good(spark, sf_dir), ["y", "x"], "left")
    return full.select("y", "x", F.coalesce("gain", F.lit(1.0)).alias("gain"), F.coalesce("good", F.lit(1.0)).alias("good"))


def disk_pixel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on the full and the binned detector, in all and in the disk; the pixel comes from the line's keys."""
    lines = table(spark, sf_dir, "lineitem")
    out = None
    for name, config in (("unbinned", UNBINNED), ("binned", BINNED)):
        h, w = config.detector
        y, x = F.pmod("l_partkey", F.lit(h)), F.pmod(F.col("l_orderkey") + F.col("l_suppkey"), F.lit(w))
        inside = F.when(pixels.in_disk(y, x, config), 1).otherwise(0)
        row = lines.agg(F.count("*").alias("n_hits"), F.coalesce(F.sum(inside), F.lit(0)).cast("long").alias("n_in_disk")).select(F.lit(name).alias("preset"), "n_hits", "n_in_disk")
        out = row if out is None else out.union(row)
    return out


def virtual_image_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.frame_sums(hits(spark, sf_dir), small_weights(spark, sf_dir))


def virtual_image_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums through an accumulator that no order of the hits can change."""
    return image.exact_frame_sums(hits(spark, sf_dir), small_weights(spark, sf_dir))


def scan_for(frames: DataFrame, width: int = 128) -> ScanConfig:
    """A scan of the given width that holds the largest image id."""
    top = frames.agg(F.max("image_id").alias("m")).first()["m"]
    return SMALL.with_(scan=((0 if top is None else top) // width + 1, width))


def virtual_image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hits(spark, sf_dir)
    return image.grid(image.frame_sums(frames, small_weights(spark, sf_dir)), frames, scan_for(frames))


def unvisited_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hits(spark, sf_dir)
    return image.unvisited(frames, scan_for(frames))


def image_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest and highest value of the image, and whether it can be scaled to a range."""
    out = virtual_image_grid(spark, sf_dir).agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return out.withColumn("scalable", F.coalesce(F.col("high") > F.col("low"), F.lit(False)))


def virtual_image_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dense frames, in millionths, under the small detector's weights."""
    ws = image.weight_array(small_weights(spark, sf_dir))
    frame = F.transform("embedding", lambda v: F.round(v.cast("double") * 1e6).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), image.dense_sum(frame, F.array(*map(F.lit, ws))).alias("s"))


def scatter_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written to 4096 positions in order of arrival."""
    rows = messages(spark, sf_dir).select(F.pmod("seq", F.lit(4096)).alias("image_id"), "seq", "cents")
    return image.last_wins(rows, value="cents")


def series_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gated(messages(spark, sf_dir)).select("series", "seq", "cents")


def gate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose frames would not fit a scan of 2 x 1, or whose detector differs (even series state one of 9 rows)."""
    config = SMALL.with_(scan=(2, 1))
    counts = messages(spark, sf_dir).groupBy("series").agg(F.sum(F.when(F.col("type") == "image", 1).otherwise(0)).cast("long").alias("images"))
    size_y = F.when(F.pmod("series", F.lit(4)) == 0, 9).when(F.pmod("series", F.lit(4)) == 1, 8)
    reason = series.start_errors(size_y, F.lit(8), F.col("images"), config)
    return counts.select("series", "images", F.coalesce(reason, F.lit("")).alias("reason"))


def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = messages(spark, sf_dir).where("type = 'image'").select("series", "seq")
    return series.chunks(frames, 16).select("series", "seq", "chunk")


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_assign(spark, sf_dir).groupBy("series", "chunk").agg(F.count("*").alias("frames"))


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's text would start if all were put one after the other."""
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return running(blobs, "doc_id", "offset", "n_bytes").select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "offset")


def column_major_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x) of each line's pixel on a 16 x 12 detector, in both orders."""
    pixel = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(16 * 12))
    (ry, rx), (cy, cx) = pixels.row_major(F.col("p"), 12), pixels.column_major(F.col("p"), 16)
    seen = table(spark, sf_dir, "lineitem").select(pixel.alias("p"))
    return seen.groupBy("p").agg(F.count("*").alias("n")).select("p", "n", ry.alias("row_y"), rx.alias("row_x"), cy.alias("col_y"), cx.alias("col_x"))


def u32_reinterpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as unsigned 32-bit values, and as what a signed reader would make of them."""
    value = F.pmod(F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 7919, F.lit(1 << 32))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("u32"))
    return rows.withColumn("i32", pixels.as_int32(F.col("u32")))


def pixel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel type of each element size among the lines (their number as the size)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("elem_size")).agg(F.count("*").alias("n"))
    return rows.withColumn("pixel_type", F.coalesce(pixels.pixel_type(F.col("elem_size")), F.lit("none")))


def frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("type = 'image'").agg(F.count("*").alias("frames"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and rates of each series; a frame of less than 1.00 stands for one that cannot be decoded, one message a second."""
    out = series.counters(messages(spark, sf_dir), F.col("cents") >= 100)
    made = pixels.rates(F.col("decoded"), F.col("received").cast("double"), PERIOD)
    return out.select("series", "received", "images", "decoded", "decode_errors", *(F.round(made[k], 6).alias(k) for k in ("rate_hz", "acquisition_s")))


def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.counters(messages(spark, sf_dir), F.col("cents") >= 100).agg(F.sum("decode_errors").alias("decode_errors"), F.min((F.col("decode_errors") == 0)).alias("all_good"))


def queue_depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and largest number of messages a day, by type of message."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("image")
    depth = table(spark, sf_dir, "events").groupBy(kind.alias("type"), F.to_date("ts").alias("day")).agg(F.count("*").alias("depth"))
    return depth.groupBy("type").agg(F.round(F.avg("depth"), 6).alias("avg_depth"), F.max("depth").alias("max_depth"))


QUERIES = {
    f.__name__: f
    for f in (
        weight_map, flat_dark_masks, disk_pixel_count, virtual_image_long, virtual_image_exact, virtual_image_grid, virtual_image_dense, unvisited_positions, image_min_max, scatter_last_wins, series_gate, gate_validation,
        chunk_assign, chunk_sizes, byte_offsets, column_major_index, u32_reinterpret, pixel_types, frame_count, run_counters, decode_errors, queue_depth_stats,
    )
}

_TOP = "top AS (SELECT max(image_id) // 128 + 1 AS rows FROM hits)"
_GRID = f"""WITH {_SUMS}, {_TOP}, seen AS (SELECT DISTINCT image_id FROM hits),
image AS (SELECT CAST(range // 128 AS INTEGER) AS scan_y, CAST(range % 128 AS INTEGER) AS scan_x, coalesce(s, 0.0) AS s, seen.image_id IS NOT NULL AS visited
  FROM range((SELECT rows * 128 FROM top)) LEFT JOIN sums ON range = sums.image_id LEFT JOIN seen ON range = seen.image_id)"""
_CHUNKS = f"WITH {_MESSAGES}, chunks AS (SELECT series, seq, (row_number() OVER (PARTITION BY series ORDER BY seq) - 1) // 16 AS chunk FROM messages WHERE type = 'image')"
_COUNTERS = f"""WITH {_MESSAGES}, counters AS (SELECT series, count(*) AS received, count(*) FILTER (type = 'image') AS images,
  count(*) FILTER (type = 'image' AND cents >= 100) AS decoded, count(*) FILTER (type = 'image' AND cents < 100) AS decode_errors FROM messages GROUP BY 1)"""


def _disk(name: str, c: ScanConfig) -> str:
    h, w = c.detector
    y, x = f"(l_partkey % {h} - {c.centre[0]})", f"((l_orderkey + l_suppkey) % {w} - {c.centre[1]})"
    return f"SELECT '{name}' AS preset, count(*) AS n_hits, count(*) FILTER ({y} * {y} + {x} * {x} <= {c.radius**2}) AS n_in_disk FROM lineitem"


ORACLE_SQL = {
    "weight_map": f"WITH {_MASKS} SELECT y, x, w FROM weights",
    "flat_dark_masks": f"WITH {_MASKS} SELECT grid.y, grid.x, coalesce(gain, 1.0) AS gain, coalesce(good, 1.0) AS good FROM grid LEFT JOIN gain ON grid.y = gain.y AND grid.x = gain.x LEFT JOIN good ON grid.y = good.y AND grid.x = good.x",
    "disk_pixel_count": f"{_disk('unbinned', UNBINNED)} UNION ALL {_disk('binned', BINNED)}",
    "virtual_image_long": f"WITH {_SUMS} SELECT image_id, s FROM sums",
    "virtual_image_exact": f"WITH {_SUMS} SELECT image_id, s FROM sums",
    "virtual_image_grid": f"{_GRID} SELECT * FROM image",
    "image_min_max": f"{_GRID} SELECT min(s) AS low, max(s) AS high, coalesce(max(s) > min(s), false) AS scalable FROM image",
    "unvisited_positions": f"WITH {_HITS}, {_TOP} SELECT range AS image_id FROM range((SELECT rows * 128 FROM top)) WHERE range NOT IN (SELECT image_id FROM hits)",
    "virtual_image_dense": f"""WITH {_MASKS}, px AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS p FROM embeddings)
SELECT vec_id AS image_id, sum(CAST(round(CAST(v AS DOUBLE) * 1e6) AS BIGINT) * w) AS s FROM px JOIN weights ON y = p // 8 AND x = p % 8 GROUP BY 1""",
    "scatter_last_wins": f"WITH {_MESSAGES} SELECT seq % 4096 AS image_id, arg_max(cents, seq) AS cents, max(seq) AS seq FROM messages GROUP BY 1",
    "series_gate": f"WITH {_GATED} SELECT series, seq, cents FROM gated",
    "gate_validation": f"""WITH {_MESSAGES}, c AS (SELECT series, count(*) FILTER (type = 'image') AS images FROM messages GROUP BY 1)
SELECT series, images, CASE WHEN series % 4 = 0 THEN 'detector shape' WHEN images > 2 THEN 'too many images' ELSE '' END AS reason FROM c""",
    "chunk_assign": f"{_CHUNKS} SELECT series, seq, chunk FROM chunks",
    "chunk_sizes": f"{_CHUNKS} SELECT series, chunk, count(*) AS frames FROM chunks GROUP BY 1, 2",
    "byte_offsets": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents",
    "column_major_index": "SELECT p, count(*) AS n, CAST(p // 12 AS INTEGER) AS row_y, CAST(p % 12 AS INTEGER) AS row_x, CAST(p % 16 AS INTEGER) AS col_y, CAST(p // 16 AS INTEGER) AS col_x FROM (SELECT (l_partkey * 7 + l_suppkey) % 192 AS p FROM lineitem) GROUP BY p",
    "u32_reinterpret": "SELECT l_orderkey, l_linenumber, u32, CAST(CASE WHEN u32 >= 2147483648 THEN u32 - 4294967296 ELSE u32 END AS INTEGER) AS i32 FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 1000003 + l_partkey * 7919) % 4294967296 AS u32 FROM lineitem)",
    "pixel_types": "SELECT l_linenumber AS elem_size, count(*) AS n, CASE l_linenumber WHEN 1 THEN 'uint8' WHEN 2 THEN 'uint16' WHEN 4 THEN 'uint32' ELSE 'none' END AS pixel_type FROM lineitem GROUP BY 1",
    "frame_count": f"WITH {_MESSAGES} SELECT count(*) AS frames FROM messages WHERE type = 'image'",
    "run_counters": f"""{_COUNTERS} SELECT series, received, images, decoded, decode_errors, round(decoded / CAST(received AS DOUBLE), 6) AS rate_hz,
  round(decoded * {PERIOD}::DOUBLE / 1e6, 6) AS acquisition_s FROM counters""",
    "decode_errors": f"{_COUNTERS} SELECT CAST(sum(decode_errors) AS BIGINT) AS decode_errors, bool_and(decode_errors = 0) AS all_good FROM counters",
    "queue_depth_stats": """SELECT type, round(avg(depth), 6) AS avg_depth, max(depth) AS max_depth FROM (
  SELECT CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'end' ELSE 'image' END AS type, CAST(ts AS DATE) AS day, count(*) AS depth FROM events GROUP BY 1, 2) GROUP BY 1""",
}
