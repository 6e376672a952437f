"""Fixed-width lanes inside byte blocks: integer layouts at 2, 4 and 8 bytes a value, run/delta, XOR and decimal series.

Values are held as unsigned 64-bit numpy arrays on the ring of their width. Sizes are exact and need no encoding but for
``xor_estimate``, which samples. Bytes after the last whole value travel as they are. Payloads describe themselves, so a
plan's label names the layout only.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from blockwright.functions.codecs import MAX_VALUES, NUMERIC_HEADER, SERIES_HEADER, BitReader, pack, pack_fields, unpack

#: Widths in bytes, in the order that wins ties between equal sizes; fixed values.
NUMERIC_WIDTHS = (4, 8, 2)
RUN_WIDTHS = (8, 4, 2)
#: A patched layout is tried where the base layout needs so many bits, and is within a quarter of the best width's.
PATCH_LEAST_BITS, PATCH_SLACK = 4, 4
#: Windows, and values of each, that decide whether patching is worth a look.
PATCH_WINDOWS = 64
#: Windows, and values of each, on which the decimal exponents are chosen; the largest exponent.
ALP_WINDOWS, ALP_VALUES, ALP_MOST = 4, 16, 18
_HEAD = "<4sBBBBIQQQHBB"
_SERIES = "<4sBBHIQQ"
_POWERS = np.array([1 << k for k in range(64)], np.uint64)
_UP = np.array([float(10**k) for k in range(ALP_MOST + 1)])
_DOWN = np.array([1.0 / 10**k for k in range(ALP_MOST + 1)])
_PAIRS = [(e, f) for e in range(ALP_MOST + 1) for f in range(e + 1)]


def mask(width: int) -> np.uint64:
    return np.uint64((1 << 8 * width) - 1)


def lane(data: bytes, width: int) -> tuple[np.ndarray, bytes]:
    """The values of a block, and the bytes that fill no value."""
    n = len(data) // width
    return np.frombuffer(data, f"<u{width}", n).astype(np.uint64), data[n * width :]


def lane_bytes(v: np.ndarray, width: int) -> bytes:
    return v.astype(f"<u{width}").tobytes()


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POWERS, x, side="right")


def signed(x: np.ndarray, width: int) -> np.ndarray:
    sign = np.uint64(1 << 8 * width - 1)
    return ((x ^ sign) - sign).view(np.int64)


def zigzag(x: np.ndarray, width: int) -> np.ndarray:
    s = signed(x, width)
    return ((s << 1) ^ (s >> 63)).view(np.uint64) & mask(width)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)) ^ (~(u & np.uint64(1)) + np.uint64(1))


def differences(v: np.ndarray, width: int) -> np.ndarray:
    return (v[1:] - v[:-1]) & mask(width)


def streams(v: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """By mode what is packed: 1 offsets from the least, 2 differences, 3 differences of differences."""
    d = differences(v, width)
    return {1: (v - v.min()) & mask(width), 2: zigzag(d, width), 3: zigzag(differences(d, width), width)}


def _packed(n: int, bits: int) -> int:
    return (n * bits + 7) // 8


@dataclass(frozen=True)
class Numeric:
    """An integer layout and its exact size. ``source`` is the mode whose stream is patched (mode 4), else the mode."""

    size: int
    width: int
    mode: int
    bits: int
    source: int

    @property
    def order(self) -> tuple[int, int, int]:
        return self.size, NUMERIC_WIDTHS.index(self.width), self.mode


def _best_base(data: bytes, width: int) -> tuple[Numeric, np.ndarray] | None:
    v, tail = lane(data, width)
    if len(v) < 2:
        return None
    made = []
    for mode, s in streams(v, width).items():
        bits = int(s.max()).bit_length() if len(s) else 0
        made.append(Numeric(NUMERIC_HEADER + _packed(len(s), bits) + len(tail), width, mode, bits, mode))
    return min(made, key=lambda x: x.order), v


def _sections(counts: np.ndarray, n: int, fixed: int) -> tuple[int, int]:
    """(size, bits) of the cheapest split of a stream, from the number of its values by bit length."""
    top = int(np.flatnonzero(counts)[-1]) if counts.any() else 0
    place = (n - 1).bit_length() if n > 1 else 0
    over = counts.sum() - np.cumsum(counts)
    sizes = []
    for bits in range(top + 1):
        e = int(over[bits]) if bits < top else 0
        sizes.append(fixed + _packed(n, bits) + (1 + _packed(e, place) + _packed(e, top - bits) if e else 0))
    best = int(np.argmin(sizes))
    return sizes[best], best


def patched(data: bytes, width: int) -> Numeric | None:
    """The smallest patched layout over the three streams and all widths of the part kept in place."""
    v, tail = lane(data, width)
    if len(v) < 2:
        return None
    made = []
    for source, s in streams(v, width).items():
        size, bits = _sections(np.bincount(bit_lengths(s), minlength=65), len(s), NUMERIC_HEADER + len(tail))
        made.append((size, source, bits))
    size, source, bits = min(made)
    return Numeric(size, width, 4, bits, source)


def patching_pays(v: np.ndarray, width: int, tail: int, base: int) -> bool:
    """Whether a sample promises more than a 64th less than ``base`` bytes; short lanes always do."""
    span = PATCH_WINDOWS * (PATCH_WINDOWS + 2)
    if len(v) < 2 * span:
        return True
    every = streams(v, width)
    start = (len(v) - PATCH_WINDOWS - 2) * np.arange(PATCH_WINDOWS) // (PATCH_WINDOWS - 1)
    at = (start[:, None] + np.arange(2, PATCH_WINDOWS + 2)).ravel()
    for mode, s in every.items():
        lengths, top, n = bit_lengths(s[at - (mode - 1)]), int(s.max()).bit_length(), len(s)
        place = (n - 1).bit_length()
        for bits in range(top + 1):
            e = 0 if bits >= top else max(1, -(-int((lengths > bits).sum()) * n // len(at)))
            if NUMERIC_HEADER + _packed(n, bits) + (1 + _packed(e, place) + _packed(e, top - bits) if e else 0) + tail < base - base // 64:
                return True
    return False


def numeric_best(data: bytes, widths=NUMERIC_WIDTHS) -> Numeric | None:
    """The smallest integer layout; None for less than two values at every width."""
    bases = [b for w in widths if (b := _best_base(data, w))]
    if not bases:
        return None
    limit = min(b.size for b, _ in bases)
    limit += limit // PATCH_SLACK
    out = []
    for base, v in bases:
        if base.size <= limit and base.bits >= PATCH_LEAST_BITS and patching_pays(v, base.width, len(data) % base.width, base.size):
            other = patched(data, base.width)
            base = other if other.size < base.size else base
        out.append(base)
    return min(out, key=lambda x: x.order)


def numeric_encode(data: bytes, layout: Numeric | None = None) -> bytes:
    layout = layout or numeric_best(data)
    if layout is None:
        raise ValueError("a numeric layout needs two values")
    v, tail = lane(data, layout.width)
    s = streams(v, layout.width)[layout.source]
    first, second, base = int(v[0]), int(differences(v, layout.width)[0]), int(v.min())
    if layout.mode != 4:
        return struct.pack(_HEAD, b"NUM2", layout.width, layout.mode, 0, layout.bits, len(v), first, second, base, len(tail), 0, 0) + pack(s, layout.bits) + tail
    odd = np.flatnonzero(bit_lengths(s) > layout.bits)
    top = int(s.max()).bit_length() if len(odd) else layout.bits
    # A patched frame of reference needs its base, the others the first value; the number of exceptions takes the free place.
    head = struct.pack(_HEAD, b"NUM2", layout.width, 4, layout.source, layout.bits, len(v), base if layout.source == 1 else first, second, len(odd), len(tail), 0, 0)
    low = s & np.uint64((1 << layout.bits) - 1)
    if not len(odd):
        return head + pack(low, layout.bits) + tail
    place = (len(s) - 1).bit_length()
    return head + pack(low, layout.bits) + bytes([top]) + pack(odd.astype(np.uint64), place) + pack(s[odd] >> np.uint64(layout.bits), top - layout.bits) + tail


def numeric_layout(data: bytes) -> dict:
    """What the header of a payload says."""
    if len(data) < NUMERIC_HEADER or data[:4] != b"NUM2":
        raise ValueError("not a numeric payload")
    _, width, mode, source, bits, n, first, second, base, tail, _, _ = struct.unpack(_HEAD, data[:NUMERIC_HEADER])
    if width not in NUMERIC_WIDTHS or mode not in (1, 2, 3, 4) or not 2 <= n <= MAX_VALUES or bits > 8 * width or tail >= width or (mode == 4) != (source in (1, 2, 3)):
        raise ValueError("numeric header out of bounds")
    return {"width": width, "mode": mode, "source": source or mode, "bits": bits, "n": n, "first": first, "second": second, "base": base, "tail": tail}


def numeric_decode(data: bytes) -> bytes:
    h = numeric_layout(data)
    width, n, bits = h["width"], h["n"], h["bits"]
    m = n - (h["source"] - 1)
    at = NUMERIC_HEADER + _packed(m, bits)
    s = unpack(data[NUMERIC_HEADER:at], m, bits)
    base, odd = h["base"], 0
    if h["mode"] == 4:
        base, odd = h["first"], h["base"]
        if odd > m:
            raise ValueError("more exceptions than values")
    if odd:
        top, place = data[at], (m - 1).bit_length()
        if not bits < top <= 8 * width:
            raise ValueError("exceptions out of bounds")
        cut = at + 1 + _packed(odd, place)
        where = unpack(data[at + 1 : cut], odd, place).astype(np.int64)
        at = cut + _packed(odd, top - bits)
        if where.max() >= m:
            raise ValueError("exception outside the block")
        s[where] |= unpack(data[cut:at], odd, top - bits) << np.uint64(bits)
    if len(data) != at + h["tail"]:
        raise ValueError("numeric payload has a wrong length")
    if h["source"] == 1:
        v = s + np.uint64(base)
    else:
        d = unzigzag(s)
        if h["source"] == 3:
            d = np.cumsum(np.concatenate([[np.uint64(h["second"])], d]), dtype=np.uint64)
        v = np.cumsum(np.concatenate([[np.uint64(h["first"])], d]), dtype=np.uint64)
    return lane_bytes(v & mask(width), width) + data[at:]


# Run and delta ---------------------------------------------------------------------------------------------------------


def _gamma_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        up = x + np.uint64(1)
    return 2 * np.where(up == 0, 65, bit_lengths(up)) - 1


def _changes(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the runs, zigzag changes after each, 0 after the last)."""
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return np.diff(np.append(start, len(v))), np.append(zigzag(differences(v[start], width), width), np.uint64(0))


def run_delta_size(data: bytes, width: int) -> int:
    v, tail = lane(data, width)
    if not len(v):
        return SERIES_HEADER + len(tail)
    runs, change = _changes(v, width)
    return SERIES_HEADER + -(-int(_gamma_bits(runs.astype(np.uint64)).sum() + _gamma_bits(change).sum()) // 8) + len(tail)


def _gamma_fields(x: list[int]) -> tuple[list[int], list[int]]:
    values, widths = [], []
    for v in x:
        low = (v + 1).bit_length() - 1
        values += [1 << low, v + 1 - (1 << low)] if low < 64 else [0, 1, v + 1 - (1 << low)]
        widths += [low + 1, low] if low < 64 else [64, 1, low]  # no field is wider than 64 bits
    return values, widths


def run_delta_encode(data: bytes, width: int) -> bytes:
    v, tail = lane(data, width)
    head = struct.pack(_SERIES, b"TS2R", width, 1, len(tail), len(v), int(v[0]) if len(v) else 0, 0)
    if not len(v):
        return head + tail
    runs, change = _changes(v, width)
    values, widths = _gamma_fields(np.stack([runs.astype(np.uint64), change], 1).ravel().tolist())
    return head + pack_fields(np.array(values, np.uint64), np.array(widths)) + tail


def _series(data: bytes, magic: bytes) -> tuple[int, int, int, int, int, bytes, bytes]:
    if len(data) < SERIES_HEADER or data[:4] != magic:
        raise ValueError("not a payload of this series")
    _, width, kind, tail, n, first, more = struct.unpack(_SERIES, data[:SERIES_HEADER])
    if n > MAX_VALUES or width not in RUN_WIDTHS or tail >= width or len(data) < SERIES_HEADER + tail:
        raise ValueError("series header out of bounds")
    cut = len(data) - tail
    return width, kind, n, first, more, data[SERIES_HEADER:cut], data[cut:]


def run_delta_decode(data: bytes) -> bytes:
    width, _, n, now, _, body, tail = _series(data, b"TS2R")
    bits, values, lengths, left, ring = BitReader(body), [], [], n, int(mask(width))
    while left:
        run, z = bits.gamma(), bits.gamma()
        if not 0 < run <= left:
            raise ValueError("run outside the block")
        values.append(now)
        lengths.append(run)
        left -= run
        now = now + ((z >> 1) ^ -(z & 1)) & ring
    bits.finish()
    return lane_bytes(np.repeat(np.array(values, np.uint64), lengths), width) + tail


# XOR with the predecessor ----------------------------------------------------------------------------------------------


def _xor_fields(v: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """0 for an equal value; 1 0 and the bits of the last window; or 1 1, leading zeros (5 bits), length - 1 (5 or 6), bits."""
    whole, size_bits = 8 * width, 6 if width == 8 else 5
    values, widths = [], []
    lead, tail = whole + 1, 0
    for w in (v[1:] ^ v[:-1]).tolist():
        if not w:
            values.append(0)
            widths.append(1)
            continue
        l, t = min(whole - w.bit_length(), 31), (w & -w).bit_length() - 1  # noqa: E741
        if l >= lead and t >= tail:
            values += [1, w >> tail]
            widths += [2, whole - lead - tail]
        else:
            lead, tail = l, t
            values += [3, l | (whole - 1 - l - t) << 5, w >> t]
            widths += [2, 5 + size_bits, whole - l - t]
    return values, widths


def xor_size(data: bytes, width: int) -> int:
    v, tail = lane(data, width)
    return SERIES_HEADER + -(-sum(_xor_fields(v, width)[1]) // 8) + len(tail)


def xor_encode(data: bytes, width: int) -> bytes:
    v, tail = lane(data, width)
    values, widths = _xor_fields(v, width)
    return struct.pack(_SERIES, b"TS2G", width, 2, len(tail), len(v), int(v[0]) if len(v) else 0, 0) + pack_fields(np.array(values, np.uint64), np.array(widths, np.int64)) + tail


def xor_decode(data: bytes) -> bytes:
    width, _, n, now, _, body, rest = _series(data, b"TS2G")
    whole, size_bits = 8 * width, 6 if width == 8 else 5
    bits, out, size, tail = BitReader(body), [now] if n else [], 0, 0
    for _ in range(n - 1):
        if bits.read(1):
            if bits.read(1):
                lead, size = bits.read(5), bits.read(size_bits) + 1
                tail = whole - lead - size
                if tail < 0:
                    raise ValueError("damaged window")
            now ^= bits.read(size) << tail
        out.append(now)
    bits.finish()
    return lane_bytes(np.array(out, np.uint64), width) + rest


def xor_estimate(data: bytes, width: int) -> tuple[int, float]:
    """(bytes, confidence) from the mean bits a value costs in the sample windows; the spread of the windows lowers confidence."""
    from blockwright.functions.measure import sample_windows

    v, tail = lane(data, width)
    costs = [sum(_xor_fields(v[a:b], width)[1]) / (b - a - 1) for a, b in sample_windows(len(v)) if b - a > 1]
    if not costs:
        return xor_size(data, width), 1.0
    mean = sum(costs) / len(costs)
    sure = 1.0 if mean <= 0 else min(max(1 - (max(costs) - min(costs)) / mean, 0.0), 1.0)
    return SERIES_HEADER + int(np.ceil(mean * (len(v) - 1) / 8)) + len(tail), sure


# Decimals --------------------------------------------------------------------------------------------------------------


def _floats(v: np.ndarray, width: int) -> np.ndarray:
    return v.view(np.float64) if width == 8 else v.astype(np.uint32).view(np.float32).astype(np.float64)


def _bits_of(x: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x.view(np.uint64) if width == 8 else x.astype(np.float32).view(np.uint32).astype(np.uint64)


def digits(v: np.ndarray, width: int, e: int, f: int) -> tuple[np.ndarray, np.ndarray]:
    """(integers, whether each gives its value back bit for bit): v * 10^e * 10^-f, rounded half away from zero."""
    with np.errstate(all="ignore"):
        x = _floats(v, width) * _UP[e] * _DOWN[f]
        fits = np.isfinite(x) & (np.abs(x) < 2.0**53)
        x = np.where(fits, x, 0.0)
        whole = np.trunc(x)
        d = (whole + (x - whole >= 0.5) - (x - whole <= -0.5)).astype(np.int64)
        return d, fits & (_bits_of(d.astype(np.float64) * _UP[f] * _DOWN[e], width) == v)


def alp_sample(v: np.ndarray) -> np.ndarray:
    if len(v) <= ALP_WINDOWS * ALP_VALUES:
        return v
    start = (len(v) - ALP_VALUES) * np.arange(ALP_WINDOWS) // (ALP_WINDOWS - 1)
    return v[(start[:, None] + np.arange(ALP_VALUES)).ravel()]


def alp_exponents(v: np.ndarray, width: int) -> tuple[int, int]:
    """The pair (e, f), f <= e, that costs the sample the fewest bits: exceptions * (value + 8) + values * offset width.
    The lower e, then the lower f, on a tie."""
    s, best = alp_sample(v), None
    for e, f in _PAIRS:
        d, ok = digits(s, width, e, f)
        kept = d[ok]
        bits = int(int(kept.max()) - int(kept.min())).bit_length() if len(kept) else 0
        cost = int((~ok).sum()) * (8 * width + 8) + len(s) * bits
        if best is None or cost < best[0]:
            best = cost, e, f
    return best[1], best[2]


def alp_plausible(data: bytes, width: int) -> bool:
    """Whether at least half of the sample are decimals of fewer bits than a value less a byte."""
    v, _ = lane(data, width)
    if not len(v):
        return False
    s = alp_sample(v)
    good = np.zeros(len(s), bool)
    for e in range(ALP_MOST + 1):
        d, ok = digits(s, width, e, 0)
        good |= ok & (bit_lengths(np.abs(d).astype(np.uint64)) <= 8 * width - 8)
    return int((~good).sum()) <= len(s) // 2


def _alp_parts(v: np.ndarray, width: int) -> tuple:
    e, f = alp_exponents(v, width)
    d, ok = digits(v, width, e, f)
    kept = d[ok]
    base = int(kept.min()) if len(kept) else 0
    bits = (int(kept.max()) - base).bit_length() if len(kept) else 0
    odd = np.flatnonzero(~ok)
    gaps = np.diff(odd, prepend=-1) - 1
    return e, f, d, ok, base, bits, odd, gaps


def alp_size(data: bytes, width: int) -> int:
    v, tail = lane(data, width)
    if not len(v):
        return SERIES_HEADER + len(tail)
    _, _, _, _, _, bits, odd, gaps = _alp_parts(v, width)
    n = 5 + 5 + 7 + 64 + int(_gamma_bits(np.array([len(odd)], np.uint64))[0] + _gamma_bits(gaps.astype(np.uint64)).sum()) + len(odd) * 8 * width + len(v) * bits
    return SERIES_HEADER + -(-n // 8) + len(tail)


def alp_encode(data: bytes, width: int) -> bytes:
    """Exponents (5 bits each), offset width (7), base (64), gamma(exceptions), gamma(gap) and value of each, then packed offsets."""
    v, tail = lane(data, width)
    head = struct.pack(_SERIES, b"TS2A", width, 4, len(tail), len(v), 0, 0)
    if not len(v):
        return head + tail
    e, f, d, ok, base, bits, odd, gaps = _alp_parts(v, width)
    values, widths = [e, f, bits, base & (1 << 64) - 1], [5, 5, 7, 64]
    more = _gamma_fields([len(odd), *gaps.tolist()])
    values, widths = values + more[0][:2], widths + more[1][:2]
    for k, raw in enumerate(v[odd].tolist(), 1):  # each gap with its value
        values += [*more[0][2 * k : 2 * k + 2], raw]
        widths += [*more[1][2 * k : 2 * k + 2], 8 * width]
    off = np.where(ok, d - base, 0).astype(np.uint64)
    return head + pack_fields(np.concatenate([np.array(values, np.uint64), off]), np.concatenate([np.array(widths, np.int64), np.full(len(off), bits)])) + tail


def alp_decode(data: bytes) -> bytes:
    width, _, n, _, _, body, tail = _series(data, b"TS2A")
    if not n:
        return tail
    bits = BitReader(body)
    e, f, size, base = bits.read(5), bits.read(5), bits.read(7), bits.read(64)
    if max(e, f) > ALP_MOST or size > 64:
        raise ValueError("decimal header out of bounds")
    base -= (base >> 63) << 64
    count, at, odd, raw = bits.gamma(), 0, [], []
    if count > n:
        raise ValueError("more exceptions than values")
    for _ in range(count):
        at += bits.gamma()
        odd.append(at)
        raw.append(bits.read(8 * width))
        at += 1
    if at > n:
        raise ValueError("exception outside the block")
    off = bits.fields(n, size)
    bits.finish()
    out = _bits_of((off.view(np.int64) + base).astype(np.float64) * _UP[f] * _DOWN[e], width).copy()
    out[np.array(odd, np.int64)] = np.array(raw, np.uint64)
    return lane_bytes(out, width) + tail


# By label --------------------------------------------------------------------------------------------------------------

#: Layouts of whole blocks by the label of a plan.
LAYOUTS = {"num1": (numeric_encode, numeric_decode)}
for _w in RUN_WIDTHS:
    LAYOUTS[f"run_delta{_w}"] = (lambda d, w=_w: run_delta_encode(d, w), run_delta_decode)
for _w in (8, 4):
    LAYOUTS[f"gorilla{_w}"] = (lambda d, w=_w: xor_encode(d, w), xor_decode)
    LAYOUTS[f"alp{_w}"] = (lambda d, w=_w: alp_encode(d, w), alp_decode)


def smallest_series(data: bytes, labels=("gorilla8", "run_delta8", "alp8")) -> tuple[str, bytes]:
    """The series layout of fewest bytes, the first of ``labels`` on a tie."""
    made = [(len(out), k, label, out) for k, label in enumerate(labels) for out in [LAYOUTS[label][0](data)]]
    return min(made)[2:]
