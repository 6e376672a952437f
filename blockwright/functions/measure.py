"""What the planner measures of one block, as whole-array numpy operations: bytes in, a few numbers out.

The same statistics stand as DataFrame operations in ``operators.profile``; tests hold both, and SQL, against each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from blockwright.functions.fixed import bit_lengths, differences, lane, mask, signed, zigzag

#: Sample windows of a lane, and values of each.
WINDOWS, WINDOW = 4, 64
#: Places between probes for repeated bytes, slots, and the longest match that is measured.
STEP, SLOTS, MATCH = 16, 4096, 64


def _entropy(counts: np.ndarray) -> float:
    n = counts[counts > 0].astype(np.float64)
    p = n / n.sum() if len(n) else n
    return round(float(-(p * np.log2(p)).sum()) + 0.0, 6)


def entropy_after(a: np.ndarray, stride: int = 8) -> float:
    """Entropy of a byte given the one before it, over every ``stride``-th transition."""
    if len(a) < 2:
        return 0.0
    at = np.arange(1, len(a), stride)
    pair, joint = np.unique(a[at - 1].astype(np.int64) * 256 + a[at], return_counts=True)
    given = np.bincount(pair >> 8, joint)[pair >> 8]
    return round(float(-(joint / len(at) * np.log2(joint / given)).sum()) + 0.0, 6)


def repetition(a: np.ndarray) -> tuple[int, int, int]:
    """(probes, hits, matched bytes): prints of four bytes at every 16th place that equal the last one of their slot, and how
    far the bytes go on alike, up to 64 and to the probe itself."""
    at = np.arange(0, len(a) - 3, STEP)
    if not len(at):
        return 0, 0, 0
    wide = a.astype(np.uint32)
    word = wide[at] | wide[at + 1] << 8 | wide[at + 2] << 16 | wide[at + 3] << 24
    slot = (word * np.uint32(2654435761)) >> np.uint32(20)
    order = np.argsort(slot, kind="stable")
    same = (slot[order][1:] == slot[order][:-1]) & (word[order][1:] == word[order][:-1])
    now, before = at[order[1:][same]], at[order[:-1][same]]
    room = np.minimum(np.minimum(len(a) - now, MATCH), now - before)
    length, going = np.full(len(now), 4), np.ones(len(now), bool)
    for k in range(4, MATCH):
        going &= k < room
        if not going.any():
            break
        going[going] = a[now[going] + k] == a[before[going] + k]
        length += going
    return len(at), len(now), int(length.sum())


def block_profile(data: bytes, level: str = "balanced") -> dict:
    """Size, entropies, runs, repetition and the scores made of them; at level fast the conditional entropy is the plain one."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    if not n:
        return dict.fromkeys(("size", "unique_bytes", "runs", "longest"), 0) | dict.fromkeys(("h0", "h1", "zero_ratio", "run_score", "delta_score", "repetition", "match_length", "incompressibility"), 0.0)
    counts = np.bincount(a, minlength=256)
    h0 = _entropy(counts)
    h_delta = _entropy(np.bincount(np.diff(a, prepend=np.uint8(0)), minlength=256))
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    length = np.diff(np.append(start, n))
    probes, hits, matched = repetition(a)
    long = length >= 4
    out = {
        "size": n, "h0": h0, "h1": h0 if level == "fast" else entropy_after(a), "zero_ratio": round(int(counts[0]) / n, 6), "unique_bytes": int((counts > 0).sum()), "runs": int(long.sum()),
        "longest": int(length.max()), "run_score": round(int(length[long].sum()) / n, 6), "delta_score": round(max(h0 - h_delta, 0.0) / 8, 6), "repetition": round(hits / probes if probes else 0.0, 6),
        "match_length": round(matched / hits if hits else 0.0, 6),
    }
    structure = max(out["run_score"], out["delta_score"], out["repetition"])
    return out | {"incompressibility": round(min(max(0.72 * h0 / 8 + 0.28 * (1 - structure), 0.0), 1.0), 4)}


def sample_windows(n: int) -> list[tuple[int, int]]:
    """Ranges of values at the start, the thirds and the end; ranges that touch are one."""
    out: list[list[int]] = []
    if not n:
        return []
    size = min(WINDOW, n)
    for at in (0, n // 3, 2 * n // 3, n - size):
        at = min(at, n - size)
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + size)
        else:
            out.append([at, at + size])
    return [tuple(x) for x in out]


def _windows(data: bytes, width: int) -> list[np.ndarray]:
    """The values of a lane's sample windows."""
    v = np.frombuffer(data, f"<u{width}", len(data) // width)
    return [v[a:b].astype(np.uint64) for a, b in sample_windows(len(v))]


# Integers --------------------------------------------------------------------------------------------------------------


def _share(x: np.ndarray) -> float:
    """The mean; of integers and truths its sum is exact."""
    if not len(x):
        return 0.0
    return (np.count_nonzero(x) if x.dtype == bool else int(x.sum())) / len(x)


def numeric_prefilter(data: bytes, sample: int = 1024, small_bits: int = 20) -> dict:
    """Per width of 4, 8 and 2 bytes the ratios of the first values; the width of highest confidence and its verdicts."""
    best = {"likely": False, "strong": False, "confidence": 0.0, "width": None}
    for width in (4, 8, 2):
        v, _ = lane(data[: sample * width], width)
        if len(v) < 2:
            continue
        raw = differences(v, width)
        d = signed(raw, width)
        monotonic, nonzero, small = _share(d >= 0), _share(d != 0), _share(bit_lengths(zigzag(raw, width)) <= small_bits)
        constant = _share(raw[1:] == raw[:-1])
        c = min(0.10 + 0.30 * monotonic + 0.25 * small + 0.30 * constant + 0.20 * nonzero, 1.0)
        likely = c >= 0.72 and monotonic >= 0.8 and nonzero >= 0.1 and small >= 0.8
        strong = c >= 0.995 and min(monotonic, nonzero, small, constant) >= 0.999
        if c > best["confidence"]:
            best = {"likely": likely, "strong": strong, "confidence": c, "width": width}
    return best


def may_be_numeric(data: bytes, sample: int = 1024) -> bool:
    """Whether the values rise often enough at any width for ``numeric_prefilter`` to find them likely."""
    for width in (4, 8, 2):
        v, _ = lane(data[: sample * width], width)
        if len(v) >= 2 and _share(signed(differences(v, width), width) >= 0) >= 0.8:
            return True
    return False


def fixed_step(data: bytes, width: int) -> tuple[int, int, int] | None:
    """(first value, step, values) where every difference of 16 values or more is one positive step."""
    v, _ = lane(data, width)
    if len(v) < 16:
        return None
    d = signed(differences(v, width), width)
    return (int(v[0]), int(d[0]), len(v)) if d[0] > 0 and (d == d[0]).all() else None


def ring_distance(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The shorter way round between two values of a ring."""
    return np.minimum((a - b) & mask(width), (b - a) & mask(width))


def run_profile(data: bytes, width: int, least: float = 0.0) -> dict | None:
    """Shares of equal and nearly equal neighbours, and of values made of one byte, in the sample windows; None for a block of
    few values, or where the share of equal ones is under ``least``."""
    parts = _windows(data, width)
    if sum(map(len, parts)) < WINDOW:
        return None
    equal = np.concatenate([p[1:] == p[:-1] for p in parts])
    if _share(equal) < least:
        return None
    near = np.concatenate([ring_distance(p[:-1], p[1:], width) <= np.uint64(255) for p in parts])
    every = np.concatenate(parts)
    one = (every & np.uint64(255)) * np.uint64(int.from_bytes(b"\1" * width, "little"))
    p = {"width": width, "n": len(data) // width, "equal": _share(equal), "small": _share(near), "splat": _share(one == every)}
    return p | {"admitted": (p["equal"] >= 0.8 or (p["equal"] >= 0.5 and p["small"] >= 0.95)) and p["splat"] <= 0.5}


# Floats ----------------------------------------------------------------------------------------------------------------

#: By width: bits of the mantissa, greatest exponent field, bias, greatest distance from it that is plausible.
FLOATS = {8: (52, 2047, 1023, 200), 4: (23, 255, 127, 60)}


@dataclass(frozen=True)
class FloatProfile:
    width: int
    n: int
    non_finite: float
    zero: float
    subnormal: float
    implausible: float
    exponents: int
    xor_zero: float
    xor_bits: float
    sign_changes: float

    @property
    def verdict(self) -> str:
        """The first rule that the lane fails, in their order."""
        rules = (
            ("too-short", self.n < WINDOW), ("non-finite", self.non_finite > 0.05), ("zero-dominated", self.zero > 0.25), ("subnormal", self.subnormal > 0.05),
            ("exponent-spread", self.exponents > 16), ("implausible-magnitude", self.implausible > 0.05), ("noisy-mantissa", self.xor_bits > 0.75 * 8 * self.width),
        )
        return next((name for name, failed in rules if failed), "admitted")

    @property
    def bits_a_byte(self) -> float:
        """What a byte of the lane costs, about: changing neighbours cost their meaningful bits, equal ones a bit."""
        return ((1 - self.xor_zero) * self.xor_bits + self.xor_zero) / self.width


def float_profile(v: np.ndarray, width: int) -> FloatProfile:
    """``v`` holds the bits of the values."""
    mantissa, most, bias, far = FLOATS[width]
    parts = [v[a:b] for a, b in sample_windows(len(v))]
    every = np.concatenate([v[:0], *parts])
    exponent = (every >> np.uint64(mantissa)) & np.uint64(most)
    rest = every & np.uint64((1 << mantissa) - 1)
    x = np.concatenate([v[:0], *(p[1:] ^ p[:-1] for p in parts)])
    low = x & (~x + np.uint64(1))
    bits = (bit_lengths(x) - bit_lengths(low) + 1)[x != 0]
    normal = (exponent > 0) & (exponent < most)
    return FloatProfile(
        width, len(v), _share(exponent == most), _share((exponent == 0) & (rest == 0)), _share((exponent == 0) & (rest != 0)), _share(normal & (np.abs(exponent.astype(np.int64) - bias) > far)),
        np.count_nonzero(np.bincount(exponent.astype(np.int64))), _share(x == 0), _share(bits), _share(x >> np.uint64(8 * width - 1) == 1),
    )


def float_prefilter(data: bytes) -> tuple[FloatProfile | None, str]:
    """The admitted reading that costs less, 8 bytes a value on a tie; else the reason that 8 bytes were refused."""
    refused = [_refused(data, w) for w in (8, 4)]
    found = [None if r else float_profile(lane(data, w)[0], w) for w, r in zip((8, 4), refused, strict=True)]
    admitted = [p for p in found if p and p.verdict == "admitted"]
    return (min(admitted, key=lambda p: p.bits_a_byte), "admitted") if admitted else (None, refused[0] or found[0].verdict)


def _refused(data: bytes, width: int) -> str | None:
    """The rules that need no differences, in the order of ``FloatProfile.verdict``; most blocks fail one."""
    mantissa, most, bias, far = FLOATS[width]
    if len(data) // width < WINDOW:
        return "too-short"
    every = np.concatenate(_windows(data, width))
    exponent = (every >> np.uint64(mantissa)).astype(np.int64) & most
    counts = np.bincount(exponent, minlength=most + 1)
    n = len(every)
    if counts[most] / n > 0.05:
        return "non-finite"
    if counts[0]:
        zeros = np.count_nonzero((exponent == 0) & (every & np.uint64((1 << mantissa) - 1) == 0))
        if zeros / n > 0.25:
            return "zero-dominated"
        if (counts[0] - zeros) / n > 0.05:
            return "subnormal"
    if np.count_nonzero(counts) > 16:
        return "exponent-spread"
    return "implausible-magnitude" if (counts[1 : bias - far].sum() + counts[bias + far + 1 : most].sum()) / n > 0.05 else None
