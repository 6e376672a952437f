import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockwright.functions import codecs, fixed, measure
from blockwright.plans import blockplan
from blockwright.plans.blockplan import Options

RNG = np.random.default_rng(7)
TEXT = b"".join(b'{"id": %d, "name": "user-%d", "active": true, "score": %d}\n' % (i, i * 7 % 101, i * i % 997) for i in range(1500))
BLOCKS = {
    "empty": b"", "one": b"x", "text": TEXT, "zeros": bytes(9000), "random": RNG.bytes(20000),
    "timestamps": (1780000000000 + np.cumsum(1000 + np.arange(8192) % 3)).astype("<u8").tobytes(), "fixed-step": (5 + 1000 * np.arange(4000)).astype("<u8").tobytes() + b"tail",
    "counter": (10000 + 3 * np.arange(5000)).astype("<u4").tobytes(), "u16-wrapping": (65000 + np.cumsum(RNG.integers(0, 7, 9000))).astype("<u2").tobytes(),
    "outliers": np.cumsum(np.where(np.arange(9000) % 1024 == 0, 100000, 1)).astype("<u4").tobytes(), "constant": np.full(4000, 21.5).tobytes(), "steps": np.repeat([20.5, 21.0, 20.0], 1500).tobytes(),
    "price": np.round(100 + np.cumsum(RNG.normal(0, 0.02, 6000)), 2).tobytes(), "sensor32": np.round(20 + np.cumsum(RNG.normal(0, 0.01, 6000)), 2).astype("<f4").tobytes(),
    "noise": RNG.normal(0, 1, 4000).tobytes(), "specials": np.array([np.nan, 0.0, -0.0, np.inf, 5e-324, -1e308] * 300).tobytes(), "odd-size": bytes(range(251)) * 3 + b"abc",
}


@pytest.mark.parametrize("profile", ["fast", "balanced", "dense"])
@pytest.mark.parametrize("name", list(BLOCKS))
def test_round_trip(name, profile):
    data, o = BLOCKS[name], Options(profile)
    s = blockplan.encode(data, o)
    assert blockplan.decode(s.payload, s.label, len(data)) == data and len(s.payload) <= len(data)
    again = blockplan.encode(data, o)
    assert (again.label, again.payload) == (s.label, s.payload)
    if profile == "dense":
        assert len(s.payload) <= len(blockplan.encode(data, Options("balanced")).payload)


def test_sizes_are_exact():
    for name, data in BLOCKS.items():
        for label, (encode, decode) in fixed.LAYOUTS.items():
            if label == "num1" and fixed.numeric_best(data) is None:
                continue
            out = encode(data)
            assert decode(out) == data, (name, label)
            width = int(label[-1])
            want = {"num1": lambda d: fixed.numeric_best(d).size, "run_delta": lambda d: fixed.run_delta_size(d, width), "gorilla": lambda d: fixed.xor_size(d, width), "alp": lambda d: fixed.alp_size(d, width)}  # noqa: B023
            assert len(out) == want[label if label == "num1" else label[:-1]](data), (name, label)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), min_size=0, max_size=70), st.binary(max_size=7), st.sampled_from([2, 4, 8]))
def test_any_lane_round_trips(values, tail, width):
    data = np.array(values, np.uint64).astype(f"<u{width}").tobytes() + tail[: width - 1]
    for label, (encode, decode) in fixed.LAYOUTS.items():
        if label == "num1" and fixed.numeric_best(data) is None:
            continue
        assert decode(encode(data)) == data
    best = fixed.numeric_best(data)
    if best:
        sizes = [len(fixed.numeric_encode(data, x)) for w in fixed.NUMERIC_WIDTHS if (x := fixed.patched(data, w))]
        assert best.size <= min([len(fixed.numeric_encode(data, b[0])) for w in fixed.NUMERIC_WIDTHS if (b := fixed._best_base(data, w))]) and all(n >= 40 for n in sizes)


def test_layouts_and_ratios():
    plan = lambda name, profile="balanced": blockplan.encode(BLOCKS[name], Options(profile))
    assert plan("fixed-step").label == "num1" and len(plan("fixed-step").payload) == 40 + 4 and plan("fixed-step").plan.route == "numeric-fast"
    assert plan("timestamps").label == "num1" and len(BLOCKS["timestamps"]) / len(plan("timestamps").payload) > 31
    assert fixed.numeric_layout(plan("u16-wrapping").payload)["width"] == 2
    assert fixed.numeric_layout(plan("outliers").payload)["mode"] == 4
    assert plan("constant").plan.route == "float-fast" and len(plan("constant").payload) < 40
    assert plan("price").label == "alp8" and plan("steps").label.startswith("run_delta")
    assert plan("random").label == "raw"


@pytest.mark.parametrize("name", ["text", "random", "specials", "noise", "timestamps", "counter"])
def test_no_float_lane_for_other_data(name):
    assert not blockplan.route(BLOCKS[name], Options())[0].startswith("float")


def test_the_oracle_finds_nothing_much_smaller():
    for name in ("text", "timestamps", "counter", "u16-wrapping", "outliers", "price", "sensor32", "steps"):
        best, label = blockplan.exhaustive(BLOCKS[name], Options())[0]
        got = blockplan.encode(BLOCKS[name], Options())
        assert len(got.payload) <= 1.25 * best + 64, (name, got.label, label)


def test_options_turn_routes_off():
    assert blockplan.route(BLOCKS["timestamps"], Options(numeric=False))[0] == "generic"
    assert blockplan.encode(BLOCKS["price"], Options(floats=False)).label not in fixed.LAYOUTS or blockplan.encode(BLOCKS["price"], Options(floats=False)).label == "num1"


def test_segments_and_columns():
    mixed = bytes(200_000) + (10000 + 3 * np.arange(50_000)).astype("<u4").tobytes() + TEXT * 2 + RNG.bytes(200_000)
    o = Options(segment=32768, window=16384)
    s = blockplan.encode(mixed, o)
    cuts = blockplan.segments(mixed, o)
    assert s.label == "seg" and len(s.inner) == len(cuts) > 2 and cuts[0][0] == 0 and cuts[-1][1] == len(mixed)
    assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and min(b - a for a, b in cuts) >= 32768
    assert len(s.payload) < len(blockplan.encode(mixed, Options()).payload) and blockplan.decode(s.payload, s.label, len(mixed)) == mixed
    n = 4000
    rows = np.zeros(n, np.dtype([("ts", "<u8"), ("price", "<f8"), ("qty", "<u4"), ("tag", "S4")]))
    rows["ts"], rows["price"] = 1780000000000 + 1000 * np.arange(n), np.round(100 + np.cumsum(RNG.normal(0, 0.02, n)), 2)
    rows["qty"], rows["tag"] = RNG.integers(1, 100, n), [(b"AAPL", b"MSFT")[i % 2] for i in range(n)]
    data = rows.tobytes() + b"rest"
    s = blockplan.encode(data, Options(fields=((8, "u"), (8, "f"), (4, "u"), (4, "b"))))
    assert s.label == "col" and len(s.inner) == 4 and s.inner[0] == "num1" and s.inner[1] == "alp8"
    assert blockplan.decode(s.payload, s.label, len(data)) == data and len(s.payload) * 3 < len(data)


def test_dictionary():
    common, part = TEXT[:3000], TEXT[40_000:44_000]
    o = Options(dictionary=common, dictionary_id=77)
    s = blockplan.encode(part, o)
    assert s.label.startswith("dict") and s.saved > 0 and len(s.payload) < len(blockplan.encode(part, Options()).payload)
    assert blockplan.decode(s.payload, s.label, len(part), common) == part
    with pytest.raises(ValueError, match="missing"):
        blockplan.decode(s.payload, s.label, len(part))
    assert blockplan.encode(BLOCKS["timestamps"], o).label == "num1"


@pytest.mark.parametrize("name", ["text", "timestamps", "u16-wrapping", "outliers", "price", "steps", "sensor32"])
def test_damage_is_refused_or_seen(name):
    """Cut payloads raise; flipped bytes raise or give other bytes of the same size, which the checksum sees."""
    data = BLOCKS[name]
    s = blockplan.encode(data, Options())
    for cut in range(0, len(s.payload), max(1, len(s.payload) // 25)):
        with pytest.raises((ValueError, IndexError, KeyError)):
            blockplan.decode(s.payload[:cut], s.label, len(data))
    for at in range(0, len(s.payload), max(1, len(s.payload) // 25)):
        bad = bytearray(s.payload)
        bad[at] ^= 0x55
        try:
            out = blockplan.decode(bytes(bad), s.label, len(data))
        except (ValueError, IndexError, KeyError):
            continue
        assert len(out) == len(data)


def test_policies():
    assert [blockplan.top_k("fast", c, 9) for c in (0.96, 0.9)] == [1, 2] and [blockplan.top_k("balanced", c, 9) for c in (0.95, 0.8, 0.7)] == [2, 3, 4] and blockplan.top_k("dense", 0.1, 5) == 5
    assert blockplan.sample_ranges(100, 3, 50) == [(0, 100)] and blockplan.sample_ranges(1000, 3, 100) == [(0, 100), (450, 550), (900, 1000)]
    assert measure.sample_windows(70) == [(0, 70)] and measure.sample_windows(0) == [] and len(measure.sample_windows(10_000)) == 4
    assert measure.ring_distance(np.array([1], np.uint64), np.array([65535], np.uint64), 2)[0] == 2
    assert measure.float_prefilter(RNG.normal(0, 1, 200).tobytes())[1] in ("exponent-spread", "noisy-mantissa")
    assert blockplan.series_beats(90, True, 100, 320) and not blockplan.series_beats(91, True, 100, 100) and not blockplan.series_beats(80, False, 100, 32)


def plain_repetition(data):
    last, probes, hits, matched = {}, 0, 0, 0
    for i in range(0, len(data) - 3, 16):
        slot = (int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> 20
        p = last.get(slot)
        if p is not None and data[p : p + 4] == data[i : i + 4]:
            n = 4
            while n < min(64, len(data) - i, i - p) and data[p + n] == data[i + n]:
                n += 1
            hits, matched = hits + 1, matched + n
        last[slot] = i
        probes += 1
    return probes, hits, matched


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: b * 3) | st.lists(st.sampled_from([b"abcdefgh" * 4, b"x" * 17, b"0123456789abcdef"]), max_size=40).map(b"".join))
def test_repetition(data):
    assert measure.repetition(np.frombuffer(data, np.uint8)) == plain_repetition(data)


def test_no_sample_is_encoded_twice(monkeypatch):
    """Layouts that share a codec share what it made of a sample, in both stages."""
    seen = []
    for name, (encode, decode) in list(codecs.BYTES.items()):
        if name != "raw":
            monkeypatch.setitem(codecs.BYTES, name, (lambda d, name=name, encode=encode: (seen.append((name, d)), encode(d))[1], decode))
    data = b" ".join(b"%d" % (k * k % 977) for k in range(1500))
    blockplan.plan(data, Options("balanced"))
    assert seen and len(seen) == len(set(seen))
