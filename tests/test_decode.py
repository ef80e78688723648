"""Decoder: golden bytes, the bit formula, round trips, every broken container, and pruned decoding."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweir.functions import cbor, container, messages, quad
from pixelweir.functions.cbor import CborError, Tag
from pixelweir.functions.config import BINNED, UNBINNED, ScanConfig
from pixelweir.operators import decode, image, weights
from pixelweir.sources import encode


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        (b"\x00", 0), (b"\x18\x64", 100), (b"\x1b\xff\xff\xff\xff\xff\xff\xff\xff", 2**64 - 1), (b"\x20", -1), (b"\x38\x63", -100),
        (b"\xf9\x3c\x00", 1.0), (b"\xfa\x47\xc3\x50\x00", 100000.0), (b"\xfb\x3f\xf1\x99\x99\x99\x99\x99\x9a", 1.1), (b"\xf4", False), (b"\xf6", None),
        (b"\x43\x01\x02\x03", b"\x01\x02\x03"), (b"\x62\xc3\xbc", "ü"), (b"\x83\x01\x02\x03", [1, 2, 3]), (b"\xa1\x61\x61\x01", {"a": 1}),
        (b"\x9f\x01\x82\x02\x03\xff", [1, [2, 3]]), (b"\xbf\x61\x61\x01\xff", {"a": 1}), (b"\x5f\x42\x01\x02\x41\x03\xff", b"\x01\x02\x03"), (b"\xc1\x01", Tag(1, 1)),
    ],
)
def test_cbor_reads_standard_examples(raw, value):
    assert cbor.loads(raw) == value


@pytest.mark.parametrize("raw", [b"", b"\x18", b"\x43\x01", b"\x82\x01", b"\xa1\x01", b"\xff", b"\x01\x01", b"\x1c", b"\x61\xff", b"\xbf\x01\xff", b"\xc1\xff", b"\xa1\x80\x01", b"\x81" * 200])
def test_cbor_refuses_what_is_not_one_item(raw):
    with pytest.raises(CborError):
        cbor.loads(raw)


items = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.binary() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@given(items)
def test_cbor_round_trip(value):
    assert cbor.loads(cbor.dumps(value)) == value


@given(st.sampled_from([1, 2, 4, 8]), st.integers(1, 40), st.integers(0, 2**32 - 1))
@settings(deadline=None)
def test_unshuffle_is_the_bit_formula(size, groups, seed):
    n = groups * 8
    data = np.random.default_rng(seed).integers(0, 256, size * n, dtype=np.uint8)
    bits = np.unpackbits(data, bitorder="little").reshape(size * 8, n).T
    expected = np.packbits(bits, axis=1, bitorder="little").reshape(-1)
    assert (container.unshuffle(data[None], size)[0] == expected).all()
    assert (container.shuffle(expected[None], size)[0] == data).all()


@pytest.mark.parametrize(("size", "n", "block"), [(2, 4096, 4096), (4, 2048, 2048), (2, 10000, 4096), (1, 64, 16), (4, 36864, 2048)])
@pytest.mark.parametrize("algorithm", ["lz4", "bslz4"])
def test_container_round_trip(size, n, block, algorithm):
    plain = np.random.default_rng(0).integers(0, 4, n * size, dtype=np.uint8).tobytes()
    data = container.compress(plain, algorithm, size, block * size)
    assert container.decompress(data, algorithm, size) == plain
    found = container.frames_of(data)
    assert len(found.begins) == -(-n // block)
    assert found.plain_sizes().sum() == len(plain)
    assert (found.begins[1:] == found.ends[:-1] + 4).all()


GOOD = container.compress(bytes(range(64)), "lz4", 1, 32)


@pytest.mark.parametrize(
    "data",
    [
        b"short", GOOD[:8] + b"\0\0\0\0" + GOOD[12:], GOOD[:14], GOOD[:-1], GOOD + b"x", GOOD[:12] + b"\0\0\0\0" + GOOD[16:], GOOD[:12] + b"\xff\xff\xff\xff" + GOOD[16:],
        (65).to_bytes(8, "big") + GOOD[8:], (2**63).to_bytes(8, "big") + GOOD[8:],
    ],
)
def test_container_refuses_bad_framing(data):
    with pytest.raises(container.ContainerError):
        container.decompress(data, "lz4", 1)


def test_container_refuses_bad_content():
    inner = GOOD[:16] + bytes(len(GOOD[16:]))
    with pytest.raises(container.ContainerError):
        container.decompress(inner, "lz4", 1)
    with pytest.raises(container.ContainerError):
        container.decompress(container.compress(bytes(12), "lz4", 1, 12), "bslz4", 1)
    with pytest.raises(container.ContainerError):
        container.decompress(GOOD, "zstd", 1)


@pytest.mark.parametrize("tag", sorted(k for k, t in messages.TYPED.items() if t not in messages.QUADS))
@pytest.mark.parametrize("column_major", [False, True])
def test_every_typed_array(tag, column_major):
    frame = np.arange(48).reshape(6, 8).astype(messages.TYPED[tag])
    for algorithm in (None, "lz4", "bslz4"):
        raw = messages.frame_message(3, frame, algorithm, 32 * frame.dtype.itemsize, tag=tag, column_major=column_major)
        found = messages.envelope(messages.parse(raw))
        assert found.image_id == 3
        assert (messages.pixels(found) == frame).all()


def quad_bytes(value: Fraction, big: bool) -> bytes:
    """The binary128 nearest to a value, by its definition."""
    sign, size = int(value < 0), abs(value)
    if not size:
        bits = 0
    else:
        e = max(-16382, size.numerator.bit_length() - size.denominator.bit_length() - 1)
        while e > -16382 and size < Fraction(2) ** e:
            e -= 1
        while size >= Fraction(2) ** (e + 1):
            e += 1
        whole = round(size / Fraction(2) ** (e - 112))  # ties to even
        bits = whole + ((e + 16382) << 112) if whole >> 112 else whole
    return ((sign << 127) | bits).to_bytes(16, "big" if big else "little")


def quad_value(raw: bytes, big: bool) -> Fraction:
    bits = int.from_bytes(raw, "big" if big else "little")
    e, fraction = (bits >> 112) & 0x7FFF, bits & ((1 << 112) - 1)
    size = Fraction(fraction, 1 << 112) * Fraction(2) ** -16382 if e == 0 else (1 + Fraction(fraction, 1 << 112)) * Fraction(2) ** (e - 16383)
    return -size if bits >> 127 else size


def nearest(value: Fraction) -> float:
    try:
        return float(value)
    except OverflowError:
        return -math.inf if value < 0 else math.inf


@given(st.integers(0, 2**128 - 1), st.booleans(), st.sampled_from([None, 0, 1, 2, 1022, 1023, 1024, -1021, -1022, -1023, -1050, -1073, -1074, -1075, -1076, 5]), st.sampled_from([None, 0, 1 << 59, (1 << 60) - 1, (1 << 60) + (1 << 59), 1 << 111, (1 << 112) - 1]))
@settings(max_examples=400, deadline=None)
def test_long_doubles_become_the_nearest_doubles(bits, big, exponent, fraction):
    if exponent is not None:
        bits = bits & ~(0x7FFF << 112) | (exponent + 16383) << 112
    if fraction is not None:
        bits = bits & ~((1 << 112) - 1) | fraction
    raw = bits.to_bytes(16, "big" if big else "little")
    got = float(quad.doubles(raw, big)[0])
    if (bits >> 112) & 0x7FFF == 0x7FFF:
        assert math.isnan(got) if bits & ((1 << 112) - 1) else got == (-math.inf if bits >> 127 else math.inf)
    else:
        want = nearest(quad_value(raw, big))
        assert (got, math.copysign(1, got)) == (want, -1.0 if bits >> 127 else 1.0)


@given(st.floats(allow_nan=False, allow_infinity=False), st.booleans())
def test_long_doubles_hold_doubles(value, big):
    assert quad.doubles(quad_bytes(Fraction(value), big), big)[0] == value


@pytest.mark.parametrize(("tag", "big"), [(83, True), (87, False)])
@pytest.mark.parametrize("algorithm", [None, "lz4", "bslz4"])
def test_frames_of_long_doubles(spark, tag, big, algorithm):
    values = [Fraction(k, 3) for k in range(64)]
    plain = b"".join(quad_bytes(v, big) for v in values)
    body = plain if algorithm is None else Tag(56500, [algorithm, 16, container.compress(plain, algorithm, 16, 512)])
    raw = cbor.dumps({"type": "image", "image_id": 3, "data": {"a": Tag(40, [[8, 8], Tag(tag, body)])}})
    df = spark.createDataFrame([(1, bytearray(raw))], "seq long, raw binary")
    assert decode.frames(decode.envelopes(df)).first()["frame"] == [float(v) for v in values]
    summed = decode.decoded_rows(df, [1.0] * 64, ScanConfig(detector=(8, 8))).first()
    assert (summed["error"], summed["s"]) == (None, float(np.array([float(v) for v in values]).reshape(8, 8).sum()))



def test_message_type():
    assert messages.message_type(cbor.dumps({"type": "end"})) == "end"
    assert messages.message_type(cbor.dumps({"a": 1})) is None
    assert messages.message_type(b"\xff\xff") is None


def test_disk_sizes(spark):
    for config, n in ((UNBINNED, 2821), (BINNED, 709)):
        assert weights.weight_map(weights.pixel_grid(spark, config), config).where("w = 1").count() == n


CONFIG = ScanConfig(detector=(16, 8), scan=(2, 4), centre=(8.0, 4.0), radius=3.0)


def test_decoded_sums_quarantine_and_pruning(spark):
    rng = np.random.default_rng(1)
    frames = [rng.integers(0, 9, CONFIG.detector).astype("<u2") for _ in range(8)]
    rows = [(k + 1, bytearray(messages.frame_message(k, f, block_size=64, column_major=k == 5))) for k, f in enumerate(frames)]
    rows[2] = (3, rows[2][1][:-5])  # cut
    rows[3] = (4, bytearray(messages.frame_message(3, np.zeros((4, 4), "<u2"))))  # another shape
    rows.append((20, bytearray(b"\xff")))
    rows.append((21, None))
    raw = spark.createDataFrame(rows, "seq long, raw binary")
    found = decode.envelopes(raw)
    assert {r["seq"] for r in decode.quarantine(found).collect()} == {3, 20, 21}
    w = np.array(image.weight_array(weights.weight_map(weights.pixel_grid(spark, CONFIG), CONFIG))).reshape(CONFIG.detector)
    for verify in (False, True):
        sums = {r["image_id"]: (r["s"], r["error"]) for r in decode.decoded_sums(found, w.reshape(-1).tolist(), CONFIG, verify).collect()}
        assert sums.pop(3)[1]
        assert sums == {k: (float((f * w).sum()), None) for k, f in enumerate(frames) if k not in (2, 3)}


def test_empty_messages(spark):
    raw = spark.createDataFrame([], "seq long, raw binary")
    assert decode.decoded_sums(decode.envelopes(raw), [0.0] * 128, CONFIG).count() == 0


def test_values_beyond_doubles_are_refused(spark):
    frame = np.full((2, 8), 2**60, "<u8")
    raw = spark.createDataFrame([(1, bytearray(messages.frame_message(0, frame, None)))], "seq long, raw binary")
    row = decode.frames(decode.envelopes(raw)).first()
    assert row["frame"] is None
    assert "2 ** 53" in row["error"]


def test_encoded_hits_add_repeated_hits(spark):
    config = ScanConfig(detector=(2, 2))
    hits = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 3), (2, 1, 0, 4)], "image_id long, y int, x int, count long")
    for kind, algorithm in (("<u4", None), ("<u2", "lz4")):
        raw = encode.encode_hits(hits, config, kind, algorithm).selectExpr("image_id AS seq", "raw")
        assert {r["image_id"]: r["frame"] for r in decode.frames(decode.envelopes(raw)).collect()} == {1: [0, 5, 0, 0], 2: [0, 0, 4, 0]}


@pytest.mark.parametrize("algorithm", [None, "lz4", "bslz4"])
def test_messages_made_together_are_those_made_alone(algorithm):
    frames = np.random.default_rng(3).poisson(0.5, (5, 16, 12)).astype("<u2")
    assert messages.frame_messages([3, 4, 5, 6, 7], frames, algorithm, 80, series_id=2) == [messages.frame_message(k + 3, f, algorithm, 80, series_id=2) for k, f in enumerate(frames)]
    assert messages.frame_messages([], frames[:0], algorithm, 80) == []


def test_messages_like_an_earlier_one_are_read_as_if_parsed():
    """Forms are remembered, whatever decoys a message holds; what is not like one is parsed."""
    frame = np.arange(64).reshape(8, 8).astype("<u4")
    decoy = {"note": "himage_id\x07", "image_id": 3, "type": "image", "data": {"a": Tag(40, [[8, 8], Tag(70, frame.tobytes())])}}
    ids = [0, 23, 24, 255, 256, 70_000, 1 << 40, (1 << 63) - 1, 1 << 63, -1, -14]
    raws = [messages.frame_message(k, frame, algorithm, 96, series_id=series) for k in ids for algorithm in (None, "lz4", "bslz4") for series in (1, 2, -7)]
    raws += [cbor.dumps(decoy | {"image_id": k}) for k in ids] + [cbor.dumps({"data": decoy["data"], "type": "image", "image_id": k}) for k in ids]
    raws += [messages.frame_message(9, frame, "bslz4", 96)[:-n] for n in (1, 50, 150)] + [messages.frame_message(9, frame, "bslz4", 96) + b"x", b"", b"\xff", None, cbor.dumps({"type": "end"})]
    raws += [r[:-1] for r in raws[:20]]
    order = np.random.default_rng(5).permutation(4 * len(raws)) % len(raws)
    opened = decode._Opener()
    for seq, k in enumerate(order):
        row, image_id, encoded = opened(seq, raws[k])
        assert row | {"seq": seq, "image_id": image_id, "encoded": encoded} == decode._open(seq, raws[k])
    assert len(opened.known) == decode.FORMS


def test_containers_walked_through_together_are_those_walked_alone():
    rng = np.random.default_rng(6)
    many = container.compress_all(rng.integers(0, 5, (20, 256), dtype=np.uint8), "bslz4", 4, 96)
    found = container.frames_of_all(many)
    for k, data in enumerate(many):
        one = container.frames_of(data)
        assert (one.plain, one.block, one.begins.tolist(), one.ends.tolist()) == (found.plain, found.block, found.begins[k].tolist(), found.ends[k].tolist())
    for bad in (many[3][:-1], many[3] + b"x", many[3][:12], many[3][:12] + b"\0\0\0\0" + many[3][16:], many[3][:12] + b"\xff\xff\xff\xff" + many[3][16:], many[4][:8] + b"\0\0\0\0" + many[4][12:]):
        with pytest.raises(container.ContainerError):
            container.frames_of(bad)
        with pytest.raises(container.ContainerError):
            container.frames_of_all([*many[:5], bad, *many[5:]])


def test_a_broken_frame_among_many_loses_itself_only(spark):
    rng = np.random.default_rng(7)
    config = ScanConfig(detector=(8, 8))
    frames = rng.integers(0, 9, (300, 8, 8)).astype("<u4")
    raws = messages.frame_messages(list(range(300)), frames, "bslz4", 96, series_id=1)
    bad = {17, 150}
    rows = []
    for k, raw in enumerate(raws):
        found = messages.envelope(messages.parse(raw))
        rows.append((k, bytearray(raw[: len(raw) - len(found.encoded) + 16] + b"\xff" * (len(found.encoded) - 16)) if k in bad else bytearray(raw)))
    got = {r["seq"]: (r["s"], r["error"]) for r in decode.decoded_rows(spark.createDataFrame(rows, "seq long, raw binary").coalesce(1), [1.0] * 64, config).collect()}
    assert {k for k, (_, error) in got.items() if error} == bad
    assert all(got[k][0] == float(frames[k].sum()) for k in range(300) if k not in bad)
