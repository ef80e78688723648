"""Sums that do not depend on the order."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelweir.functions import messages
from pixelweir.functions.config import ScanConfig
from pixelweir.operators import decode, exact, image

CONFIG = ScanConfig(detector=(8, 8), scan=(2, 3), centre=(4.0, 4.0), radius=3.0)


def true_sum(values):
    try:
        return float(sum(map(Fraction, values), Fraction(0)))
    except OverflowError:
        return math.inf


def test_sums_are_the_nearest_doubles_in_any_order(spark):
    random.seed(6)
    rows = []
    for key in range(40):
        scale = random.choice([0, 0, 30, -300, 300, -1060])
        values = [math.ldexp(random.uniform(-1, 1), scale + random.randint(-60, 60)) for _ in range(random.choice([1, 2, 50]))]
        rows += [(key, v) for v in [*values, *(-v for v in values[: len(values) // 2]), 0.0, None]]
    rows += [(100, 5e-324), (100, 5e-324), (101, 1e308), (101, 1e308), (102, -0.0), (103, None), (104, 2.0**1023), (104, -(2.0**1023)), (104, 1e-300)]
    want = {}
    for key, v in rows:
        want.setdefault(key, []).extend([] if v is None else [v])
    for seed in range(3):
        random.seed(seed)
        random.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(seed + 1)
        got = {r["k"]: r["s"] for r in exact.exact_sums(df, ["k"], "v").collect()}
        assert got == {key: true_sum(values) for key, values in want.items()}


def test_odd_values_are_what_they_are_in_a_plain_sum(spark):
    df = spark.createDataFrame([(1, math.inf), (1, 1.0), (2, math.inf), (2, -math.inf), (3, math.nan), (4, -math.inf)], "k int, v double")
    got = {r["k"]: r["s"] for r in exact.exact_sums(df, ["k"], F.col("v")).collect()}
    assert (got[1], got[4]) == (math.inf, -math.inf)
    assert math.isnan(got[2])
    assert math.isnan(got[3])


@given(st.lists(st.tuples(st.integers(-40, 32), st.integers(-(10**37), 10**37)), max_size=8))
@settings(deadline=None)
def test_bins_are_rounded_once(bins):
    try:
        want = float(sum((Fraction(n) * Fraction(2) ** (32 * b) for b, n in bins), Fraction(0)))
    except OverflowError:
        return
    assert exact.nearest(bins) == want


def test_grain():
    assert exact.grain(np.array([0.0, 1.0, 7.0])) == 0
    assert exact.grain(np.array([0.5, 0.25])) == 2
    assert exact.grain(np.array([0.1])) is None


@pytest.mark.parametrize("gain", [1.0, 0.5, 1 / 3])
@pytest.mark.parametrize("kind", ["<u2", "<f8"])
def test_decoded_and_joined_sums_agree_to_the_bit(spark, gain, kind):
    """The same frames as sparse hits in any order, and as messages decoded one by one or together."""
    rng = np.random.default_rng(2)
    table = np.zeros((8, 8))
    table[2:7, 1:6] = gain * rng.integers(1, 5, (5, 5)) + (rng.random((5, 5)) if gain < 0.5 else 0)
    frames = (rng.poisson(4.0, (20, 8, 8)) * (1 if kind == "<u2" else 1.1)).astype(kind)
    raw = spark.createDataFrame([(k, bytearray(messages.frame_message(k, f, block_size=48 if kind == "<u2" else 64))) for k, f in enumerate(frames)], "seq long, raw binary")
    decoded = {r["image_id"]: r["s"] for r in decode.decoded_rows(raw, table.reshape(-1).tolist(), CONFIG).collect()}
    hits = [(k, y, x, float(f[y, x])) for k, f in enumerate(frames) for y in range(8) for x in range(8)]
    random.shuffle(hits)
    df = spark.createDataFrame(hits, "image_id long, y int, x int, count double").repartition(3)
    weights = spark.createDataFrame([(y, x, float(table[y, x])) for y in range(8) for x in range(8)], "y int, x int, w double")
    joined = {r["image_id"]: r["s"] for r in image.exact_frame_sums(df, weights).collect()}
    assert decoded == joined
    assert joined == {k: true_sum((f.astype(float) * table).reshape(-1).tolist()) for k, f in enumerate(frames)}
