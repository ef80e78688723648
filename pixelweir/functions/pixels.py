"""Scalar column expressions over pixels, ids and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelweir.functions.config import ScanConfig

#: Pixel type by bytes of an element.
PIXEL_TYPES = {1: "uint8", 2: "uint16", 4: "uint32"}


def pixel_type(elem_size: Column) -> Column:
    """The unsigned pixel type of an element size; null for sizes that no detector sends."""
    out = F.lit(None).cast("string")
    for size, name in PIXEL_TYPES.items():
        out = F.when(elem_size == size, F.lit(name)).otherwise(out)
    return out


def in_disk(y: Column, x: Column, config: ScanConfig) -> Column:
    """Whether a pixel's centre lies in the disk, its edge included."""
    cy, cx = config.centre
    return (y - F.lit(cy)) * (y - F.lit(cy)) + (x - F.lit(cx)) * (x - F.lit(cx)) <= F.lit(config.radius**2)


def row_major(pixel: Column, width: int) -> tuple[Column, Column]:
    """(y, x) of a position in a row-major frame."""
    return F.floor(pixel / F.lit(width)).cast("int"), F.pmod(pixel, F.lit(width)).cast("int")


def column_major(pixel: Column, height: int) -> tuple[Column, Column]:
    """(y, x) of a position in a column-major frame."""
    return F.pmod(pixel, F.lit(height)).cast("int"), F.floor(pixel / F.lit(height)).cast("int")


def scan_position(image_id: Column, config: ScanConfig) -> tuple[Column, Column]:
    """(scan_y, scan_x) of an image; null for ids outside the scan."""
    inside = (image_id >= 0) & (image_id < config.positions)
    y, x = row_major(image_id, config.scan[1])
    return F.when(inside, y), F.when(inside, x)


def as_int32(value: Column) -> Column:
    """An unsigned 32-bit value read as a signed one, as a reinterpreting reader sees it."""
    low = F.pmod(value.cast("long"), F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - F.lit(1 << 32)).otherwise(low).cast("int")


def rates(decoded: Column, elapsed_s: Column, period_us: float) -> dict[str, Column]:
    """Detector rate, rate, real-time factor, acquisition time and time a frame; null where nothing elapsed or was decoded."""
    rate = F.when(elapsed_s > 0, decoded / elapsed_s)
    detector = F.lit(1e6 / period_us)
    return {
        "detector_rate_hz": detector,
        "rate_hz": rate,
        "realtime_factor": rate / detector,
        "acquisition_s": decoded * F.lit(period_us) / F.lit(1e6),
        "us_per_frame": F.when(decoded > 0, elapsed_s * F.lit(1e6) / decoded),
    }
