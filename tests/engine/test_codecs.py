import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockwright.functions import codecs as C

DATA = [b"", b"a", b"a" * 500, bytes(range(256)) * 3, b"abcabcabcabcabc" * 40, np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8).tobytes(), b"aaabbbbccccc" * 30, b"x" * 131 + b"y" * 3]
PLANS = [f"{t}{c}{e}" for t in ("", "delta+") for c in C.BYTES for e in ("", "+huffman", "+rans", "+rans4x")]


@pytest.mark.parametrize("plan", PLANS)
def test_plans_round_trip(plan):
    for d in DATA:
        if d or "+" not in plan:
            assert C.decode_plan(C.encode_plan(d, plan), plan, len(d)) == d


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62 - 1), min_size=1, max_size=80) | st.lists(st.integers(0, 5), min_size=1, max_size=200))
def test_numeric_round_trip(v):
    a = np.array(v, np.int64)
    for mode in (2, 3) if max(v) - min(v) >= 2**62 else (1, 2, 3):
        assert (C.numeric_decode(C.numeric_encode(a, mode)) == a).all()
    assert (C.run_delta_decode(C.run_delta_encode(a)) == a).all()
    if max(v) - min(v) < 2**62:
        for bits in (0, 1, 7, int(max(v) - min(v)).bit_length()):
            if bits <= int(max(v) - min(v)).bit_length():
                assert (C.patched_decode(C.patched_encode(a, bits)) == a).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(width=64) | st.integers(0, 10**6).map(lambda x: x / 100), min_size=1, max_size=80))
def test_float_round_trip(v):
    a = np.array(v, np.float64)
    bits = a.view(np.uint64)
    assert (C.gorilla_decode(C.gorilla_encode(a)).view(np.uint64) == bits).all()
    for e, f in ((14, 12), (2, 0), (18, 18), (0, 0)):
        assert (C.alp_decode(C.alp_encode(a, e, f)).view(np.uint64) == bits).all()


def test_special_floats_keep_their_bits():
    bits = np.array([0x7FF8000000000001, 0xFFF8000000000002, 0x8000000000000000, 0, 1, 0x7FF0000000000000, 0xFFF0000000000000], np.uint64)
    assert (C.gorilla_decode(C.gorilla_encode(bits.view(np.float64))).view(np.uint64) == bits).all()
    assert (C.alp_decode(C.alp_encode(bits.view(np.float64), 14, 12)).view(np.uint64) == bits).all()


def test_dictionary_history():
    history = b'{"name": "value", "kind": "record"}'
    data = b'{"name": "value", "kind": "other"}'
    packed = C.lz_encode(data, history)
    assert len(packed) < len(C.lz_encode(data)) and C.lz_decode(packed, len(data), history) == data


def test_checksum():
    assert C.crc32c(b"123456789") == 0xE3069283 and C.crc32c(b"") == 0


@pytest.mark.parametrize("plan", ["rle", "lz_balanced", "raw+huffman", "raw+rans", "raw+rans4x", "rle+huffman"])
def test_damage_is_noticed_or_harmless(plan):
    """Truncation and flipped bytes raise ValueError or decode to the right length; nothing else escapes."""
    data = b"abcdabcdabcdeeeeeeeeeeee" * 20
    good = C.encode_plan(data, plan)
    for k in range(0, len(good), 7):
        for bad in (good[:k], good[:k] + bytes([good[k] ^ 0x5A]) + good[k + 1 :]):
            try:
                assert len(C.decode_plan(bad, plan, len(data))) == len(data)
            except (ValueError, struct.error):
                pass


@pytest.mark.parametrize("made", [lambda v: C.numeric_encode(v, 2), C.run_delta_encode, lambda v: C.patched_encode(v, 2)])
def test_truncated_numeric_payloads(made):
    v = np.arange(300, dtype=np.int64) ** 2 % 97
    good = made(v)
    decode = {b"TS1R": C.run_delta_decode}.get(good[:4], C.patched_decode if good[5] == 4 else C.numeric_decode)
    for k in range(len(good) - 1):
        with pytest.raises((ValueError, struct.error)):
            decode(good[:k])


def test_checksum_and_prefix_codes_of_all_lengths():
    """The checksum in spans equals the one byte by byte; codes longer than the decoder's window come back."""
    rng = random.Random(11)
    for n in (0, 1, 63, 64, 65, 255, 256, 257, 5000):
        data, c = rng.randbytes(n), 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        assert C.crc32c(data) == c ^ 0xFFFFFFFF
    counts = [1, 1]
    while len(counts) < 22:
        counts.append(counts[-1] + counts[-2])
    data = bytes(rng.sample([k for k, n in enumerate(counts) for _ in range(n)], sum(counts)))
    coded = C.huffman_encode(data)
    assert max(coded[4:260]) == 21 and C.huffman_decode(coded, len(data)) == data and C.huffman_size(data) == len(coded)
    broken = bytearray(coded)
    broken[4:260] = bytes([1, 1, 1] + [200] * 253)  # no code table: an overflow before, which stopped the other blocks
    with pytest.raises(ValueError):
        C.huffman_decode(bytes(broken), len(data))
