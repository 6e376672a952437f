"""The layout of one block, from its bytes: route, candidates, estimates, verified samples, envelope, lanes, containers.

``planner`` and ``policies`` hold the same rules as relations, for whole tables of profiles; here a block is planned and
encoded where it lies, in one Arrow batch, so that nothing about single bytes is ever shuffled. All decisions depend on the
block and the options alone.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from blockwright.functions import codecs, fixed, measure
from blockwright.plans.planner import CANDIDATES, ENVELOPE, WEIGHTS

#: By profile: least block for range coders, least gain of a range coder over prefix codes, confidence for the integer fast
#: route. Fixed values.
RANS_LEAST = {"fast": 16384, "balanced": 4096, "dense": 1024}
RANS_GAIN = {"fast": 0.05, "balanced": 0.02, "dense": 0.0}
NUMERIC_FAST = {"fast": 0.995, "balanced": 0.98, "dense": 0.97}
#: By profile: sample windows as (count, bytes) of both stages, candidates of the second stage, cap of the pool. Fixed values.
SAMPLES = {"fast": ((1, 4096), (1, 8192), 1, 2), "balanced": ((3, 8192), (3, 32768), 2, 8), "dense": ((4, 16384), (3, 65536), 3, 10)}
#: Shares of the block that series layouts must keep to, and bytes that a container or dictionary must save.
SERIES_SHARE, SERIES_SHARE_SAMPLED, SERIES_SAVING, MIN_GAIN = 0.9, 0.75, 32, 32
#: A block's own header and a dictionary's descriptor, where stored sizes are compared.
BLOCK_HEADER, DICTIONARY_DESCRIPTOR = 32, 9
LEAST_NUMERIC = 4096
_META = {"none": 0, "huffman": 260, "rans": 516, "rans4x": 2064}
_ENCODE = {"raw": 1, "rle": 2, "fast": 4, "balanced": 9, "num1": 5, "none": 0, "huffman": 4, "rans": 9, "rans4x": 5}
_DECODE = {"raw": 1, "rle": 2, "lz": 3, "num1": 2, "none": 0, "huffman": 6, "rans": 5, "rans4x": 3}


@dataclass(frozen=True)
class Options:
    """What decides a block's layout besides its bytes."""

    profile: str = "balanced"
    numeric: bool = True
    floats: bool = True
    dictionary: bytes = b""
    dictionary_id: int = 0
    #: Least bytes of a segment; 0 leaves blocks whole. Bytes of the windows that segments are made of, and most of a segment.
    segment: int = 0
    window: int = 65536
    most: int = 1 << 20
    #: Field widths and kinds (u, i, f, b) of records, if blocks hold records.
    fields: tuple[tuple[int, str], ...] = ()


@dataclass(frozen=True)
class Candidate:
    plan: int
    transform: str
    codec: str
    lz: str
    entropy: str
    size: int = 0
    confidence: float = 0.0
    score: int = 0

    @property
    def label(self) -> str:
        made = [self.transform] * bool(self.transform) + [self.codec + (f"_{self.lz}" if self.lz else "")] + [self.entropy] * (self.entropy != "none")
        return "+".join(made)

    @property
    def family(self) -> tuple[str, str]:
        return self.transform, self.codec

    @property
    def order(self) -> tuple:
        return self.score, self.transform, self.codec, self.entropy, self.lz


@dataclass
class Plan:
    label: str
    estimate: int
    route: str
    reason: str
    payload: bytes | None = None
    ranked: list[Candidate] = field(default_factory=list)
    qualified: list[Candidate] = field(default_factory=list)
    pool: int = 0
    second: int = 0
    sampled: int = 0


# Routes ----------------------------------------------------------------------------------------------------------------


def route(data: bytes, o: Options) -> tuple[str, str, dict]:
    """(route, reason, evidence): numeric-fast, numeric-general, float-fast, float-general or generic."""
    base, reason, found = "generic", "numeric-off", {}
    if o.numeric:
        reason = "prefilter"
        if measure.may_be_numeric(data) and (pre := measure.numeric_prefilter(data))["likely"]:
            found["prefilter"] = pre
            base, reason = "numeric-general", "numeric-candidate"
            if pre["strong"] and pre["confidence"] >= NUMERIC_FAST[o.profile] and (step := measure.fixed_step(data, pre["width"])):
                return "numeric-fast", "fixed-step", found | {"step": step}
    found["base"] = base
    if o.floats:
        admitted, verdict = measure.float_prefilter(data)
        found["verdict"] = verdict
        if admitted:
            found["series"] = series = float_evidence(data, admitted.width)
            fast = series[1] * 32 <= len(data)
            return ("float-fast", "dominant-float", found) if fast else ("float-general", "float-candidate", found)
        found["runs"] = [p for w in fixed.RUN_WIDTHS if (p := measure.run_profile(data, w, 0.5)) and p["admitted"]]
    return base, reason, found


def float_evidence(data: bytes, width: int) -> tuple[str, int, bool]:
    """(label, bytes, exact): XOR coding as sampled, run coding where values repeat, decimals where they look so and nothing
    else is dominant already; the first of them on a tie."""
    short = len(data) // width < 2
    best = (f"gorilla{width}", fixed.xor_estimate(data, width)[0], short)
    runs = measure.run_profile(data, width)
    if runs and runs["equal"] >= 0.5 and (n := fixed.run_delta_size(data, width)) < best[1]:
        best = (f"run_delta{width}", n, True)
    if best[1] * 32 > len(data) and fixed.alp_plausible(data, width) and (n := fixed.alp_size(data, width)) < best[1]:
        best = (f"alp{width}", n, True)
    return best


# Candidates and estimates ----------------------------------------------------------------------------------------------


def early_raw(p: dict) -> bool:
    return p["h0"] > 7.985 and max(p["run_score"], p["delta_score"], p["repetition"]) < 0.002 and p["match_length"] < 4.5


def fast_path(p: dict, profile: str) -> str | None:
    """The layout that a clear profile decides at once."""
    if p["incompressibility"] > 0.985 and p["h0"] > 7.985 and p["repetition"] < 0.003:
        return "raw"
    if profile == "fast":
        if p["zero_ratio"] > 0.985 or p["run_score"] > 0.92:
            return "rle"
        if p["repetition"] > 0.55 and p["match_length"] >= 12:
            return "lz_fast+huffman"
        if p["delta_score"] > 0.75 and p["h0"] > 4.0:
            return "delta+raw+huffman"
    return None


def lz_signal(p: dict) -> float:
    return max(p["repetition"], min(p["match_length"] / 32, 1.0))


def candidates(p: dict, o: Options, base: str) -> list[Candidate]:
    """The layouts that compete; at profile fast only those that the profile speaks for."""
    n, signal = p["size"], lz_signal(p)
    if early_raw(p):
        return [Candidate(1, "", "raw", "", "none")]
    out = []
    for plan, transform, codec, lz, entropy, _ in CANDIDATES:
        if entropy.startswith("rans") and n < RANS_LEAST[o.profile] or entropy == "rans4x" and n < 16384:
            continue
        if o.profile == "fast":
            gate = {1: True, 2: True, 5: p["run_score"] >= 0.12 or p["zero_ratio"] >= 0.2, 9: p["delta_score"] >= 0.1, 10: p["delta_score"] >= 0.3, 12: signal >= 0.06 or p["match_length"] >= 7, 13: signal >= 0.25}
            if not gate.get(5 if plan == 6 else plan, False):
                continue
        out.append(Candidate(plan, transform, codec, lz or "", entropy))
    wanted = n >= LEAST_NUMERIC and (o.profile != "fast" or p["delta_score"] >= 0.15)
    if o.numeric and (base == "numeric-general" or base != "generic" and wanted or wanted and base == "generic" and p["delta_score"] >= 0.15):
        out.append(Candidate(22, "", "num1", "", "none"))
    return out


def _clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def score(c: Candidate, n: int, size: int, profile: str) -> int:
    """The weighted cost in integers: size, work and memory."""
    w_size, w_encode, w_decode, w_memory, scale_encode, scale_decode = WEIGHTS[profile]
    extra = 1 if c.transform else 0
    encode = _ENCODE[c.lz or c.codec] + _ENCODE[c.entropy] + extra
    decode = _DECODE[c.codec] + _DECODE[c.entropy] + extra
    return size * 1_000_000 // max(n, 1) * w_size + encode * scale_encode * w_encode + decode * scale_decode * w_decode + (3 if c.codec == "lz" else 2) * 1000 * w_memory


def estimated(c: Candidate, p: dict, o: Options, exact: int | None) -> Candidate:
    """The candidate with its analytic size, confidence and score."""
    share, sure = 1.0, 0.78
    if c.transform:
        share *= 1 - 0.55 * _clamp(p["delta_score"], 0.0, 0.85)
        sure = max(sure, _clamp(0.60 + p["delta_score"] * 0.35, 0.0, 0.98))
    if c.codec == "rle":
        s = _clamp(max(p["run_score"], p["zero_ratio"]), 0.0, 1.0)
        share, sure = share * _clamp(1 - 0.9 * s, 0.015, 1.05), max(sure, _clamp(0.62 + 0.36 * s, 0.0, 0.99))
    elif c.codec == "lz":
        s = max(_clamp(p["repetition"], 0.0, 1.0), _clamp(p["match_length"] / 48, 0.0, 1.0))
        share, sure = share * _clamp(1 - s * (0.72 if c.lz == "balanced" else 0.62), 0.05, 1.04), max(sure, _clamp(0.54 + 0.34 * s, 0.0, 0.94))
    elif c.codec == "num1":
        gain = _clamp(0.75 * _clamp(p["delta_score"], 0.0, 1.0) + 0.25 * _clamp(1 - p["h0"] / 8, 0.0, 1.0), 0.0, 0.9)
        share, sure = share * _clamp(1 - gain, 0.04, 1.02), max(sure, _clamp(0.58 + 0.35 * p["delta_score"], 0.0, 0.96))
    h = _clamp(p["h0"] / 8, 0.02, 1.0)
    entropy = {"none": 1.0, "huffman": _clamp(0.04 + 0.96 * h, 0.04, 1.03)}.get(c.entropy, _clamp(0.025 + 0.94 * h, 0.03, 1.02))
    size = max(int(p["size"] * share * entropy + 0.5), 1) + _META[c.entropy]
    if c.codec == "num1" and exact is not None:
        size, sure = exact, 1.0
    return replace(c, size=size, confidence=sure, score=score(c, p["size"], size, o.profile))


def without_weak_rans(ranked: list[Candidate], profile: str) -> list[Candidate]:
    """Range coders that gain too little over the same layout with prefix codes go to the end."""
    peer = {(c.transform, c.codec, c.lz): c.size for c in ranked if c.entropy == "huffman"}

    def weak(c: Candidate) -> bool:
        h = peer.get((c.transform, c.codec, c.lz))
        return c.entropy.startswith("rans") and h is not None and max(h - c.size, 0) / max(h, 1) < RANS_GAIN[profile]

    return sorted(ranked, key=lambda c: (weak(c), c.order))


# Verification ----------------------------------------------------------------------------------------------------------


def top_k(profile: str, confidence: float, total: int) -> int:
    """How many candidates are verified: fewer where the best estimate is sure."""
    sure, fair, least = {"fast": (1, 2, 2), "balanced": (2, 3, 4), "dense": (4, 5, 6)}[profile]
    return min(sure if confidence >= 0.95 else fair if confidence >= 0.80 else least, total)


def pool(ranked: list[Candidate], profile: str) -> list[Candidate]:
    """The first candidates, and the best of every family that is not among them, up to the profile's cap."""
    k = top_k(profile, ranked[0].confidence, len(ranked)) if ranked else 0
    out, cap = ranked[:k], SAMPLES[profile][3]
    if profile != "fast":
        for c in ranked[k:]:
            if len(out) >= cap:
                break
            if c.family not in {x.family for x in out}:
                out.append(c)
    return sorted(out, key=lambda c: ranked.index(c))


def second_k(ranked: list[Candidate], profile: str) -> int:
    """The width of the second stage: one more where the two best are close or the best is unsure, three at least when dense."""
    k = min(SAMPLES[profile][2], len(ranked))
    if len(ranked) > 1:
        margin = max(ranked[1].size - ranked[0].size, 0) / max(ranked[0].size, 1)
        k += margin < 0.03 or ranked[0].confidence < 0.8
    return min(max(k, 3) if profile == "dense" else k, len(ranked))


def sample_ranges(n: int, count: int, length: int) -> list[tuple[int, int]]:
    """Evenly spaced windows; a block that they would fill is one window."""
    if n <= count * length:
        return [(0, n)]
    return [((n - length) * k // max(count - 1, 1), (n - length) * k // max(count - 1, 1) + length) for k in range(count)]


def blend_weight(c: Candidate, stage: int, profile: str) -> int:
    """Percent of the sampled size in the blend."""
    steps = (20, 25, 30) if c.codec == "lz" else (25, 40, 55)
    w = steps[0 if c.confidence >= 0.9 else 1 if c.confidence >= 0.75 else 2]
    w = min(w + 5, 60) if stage == 2 else w
    return w - 5 if profile == "dense" else min(w + 5, 65) if profile == "fast" else w


class Trials:
    """Sizes of layouts really encoded, over ranges of one block. Layouts that differ in the entropy coder share the rest, and no
    range is encoded twice."""

    def __init__(self, data: bytes):
        self.data, self.inner, self.sizes = data, {}, {}

    def size(self, c: Candidate, a: int, b: int) -> int:
        if (c.label, a, b) not in self.sizes:
            key = c.transform, c.codec, c.lz, a, b
            if key not in self.inner:
                self.inner[key] = codecs.encode_plan(self.data[a:b], replace(c, entropy="none").label)
            inner = self.inner[key]
            coded = 0 if c.entropy == "none" else codecs.huffman_size(inner) if c.entropy == "huffman" else len(codecs.ENTROPY[c.entropy][0](inner))
            self.sizes[c.label, a, b] = 4 + coded if coded else len(inner)
        return self.sizes[c.label, a, b]


def verified(data: bytes, c: Candidate, o: Options, stage: int, trials: Trials | None = None) -> Candidate:
    """The candidate with its size blended from the estimate and encoded samples, and scored anew. Integers are exact already."""
    if c.codec == "num1":
        return c
    trials = trials or Trials(data)
    count, length = SAMPLES[o.profile][stage - 1]
    if c.codec == "lz":
        length = min(length, 32768)
    parts = sample_ranges(len(data), count, length)
    meta = _META[c.entropy]
    taken = sum(b - a for a, b in parts)
    coded = sum(max(trials.size(c, a, b) - meta, 1) for a, b in parts)
    whole = coded * len(data) // max(taken, 1) + meta
    w = blend_weight(c, stage, o.profile)
    size = (whole * w + c.size * (100 - w)) // 100
    if taken == len(data):
        size = whole
    return replace(c, size=size, score=score(c, len(data), size, o.profile))


def generic(data: bytes, o: Options, base: str, p: dict, why: str) -> Plan:
    """The candidates' competition: estimates, pool, two stages of samples, the size envelope, the least score."""
    if found := fast_path(p, o.profile):
        return Plan(found, 0, base, "fast-path")
    made = candidates(p, o, base)
    exact = None
    if any(c.codec == "num1" for c in made):
        best = fixed.numeric_best(data)
        exact = best.size if best else None
        made = [c for c in made if c.codec != "num1" or best]
    ranked = without_weak_rans([estimated(c, p, o, exact) for c in made], o.profile)
    few, trials = pool(ranked, o.profile), Trials(data)
    one = without_weak_rans([verified(data, c, o, 1, trials) for c in few], o.profile)
    k = second_k(one, o.profile)
    two = without_weak_rans([verified(data, c, o, 2, trials) for c in one[:k]] + one[k:], o.profile)
    least = min(c.size for c in two)
    limit = least + (least * ENVELOPE[o.profile] + 999_999) // 1_000_000
    inside = [c for c in two if c.size <= limit]
    return Plan(inside[0].label, inside[0].size, base, why, None, two + [c for c in ranked if c.plan not in {x.plan for x in two}], inside, len(few), k, len(few))


def series_beats(size: int, exact: bool, other: int, n: int) -> bool:
    return size <= (SERIES_SHARE if exact else SERIES_SHARE_SAMPLED) * other and (other - size) * SERIES_SAVING >= n


def plan(data: bytes, o: Options) -> Plan:
    """The layout of a block without containers or dictionaries."""
    kind, why, found = route(data, o)
    if kind == "numeric-fast":
        return Plan("num1", fixed.NUMERIC_HEADER + len(data) % found["prefilter"]["width"], kind, why)
    if kind == "float-fast":
        payload = codecs.encode_plan(data, found["series"][0])
        if len(payload) * 16 <= len(data):
            return Plan(found["series"][0], len(payload), kind, why, payload)
    out = generic(data, o, found.get("base", "generic"), measure.block_profile(data, o.profile), why)
    out.route = kind
    if not o.floats or out.reason == "fast-path" or out.estimate * SERIES_SAVING <= len(data):
        return out
    best = found.get("series")
    if best is None:
        sizes = [(fixed.run_delta_size(data, r["width"]), k, f"run_delta{r['width']}") for k, r in enumerate(found.get("runs", []))]
        best = (min(sizes)[2], min(sizes)[0], True) if sizes else None
    if best and series_beats(best[1], best[2], out.estimate, len(data)):
        out.label, out.estimate, out.reason = best[0], best[1], "series-dominance"
    return out


# Blocks as stored ------------------------------------------------------------------------------------------------------


@dataclass
class Stored:
    label: str
    payload: bytes
    plan: Plan
    saved: int = 0
    inner: list[str] = field(default_factory=list)


def _planned(data: bytes, o: Options) -> Stored:
    p = plan(data, o)
    payload = p.payload if p.payload is not None else codecs.encode_plan(data, p.label)
    if len(payload) + MIN_GAIN >= len(data):
        return Stored("raw", data, p)
    return Stored(p.label, payload, p)


def _plain(data: bytes, o: Options) -> Stored:
    """Dense is never larger than balanced would be; text may use the dictionary."""
    out = _planned(data, o)
    if o.profile == "dense":
        other = _planned(data, replace(o, profile="balanced"))
        out = other if len(other.payload) < len(out.payload) else out
    if not o.dictionary or len(data) < 8 or out.label.split("+")[0].rstrip("248") in ("num1", "num", "run_delta", "gorilla", "alp"):
        return out
    matched = codecs.lz_encode(data, o.dictionary, 1 if o.profile == "fast" else 16)
    made = []
    for k, entropy in enumerate(("none", "huffman", "rans")):
        coded = struct.pack("<I", len(matched)) + codecs.ENTROPY[entropy][0](matched) if entropy != "none" else matched
        made.append((len(coded), k, entropy, coded))
    size, _, entropy, coded = min(made)
    if len(out.payload) - size - DICTIONARY_DESCRIPTOR < max(MIN_GAIN, 1):
        return out
    return Stored("dict" + (f"+{entropy}" if entropy != "none" else ""), struct.pack("<Q", o.dictionary_id) + coded, out.plan, len(out.payload) - size - DICTIONARY_DESCRIPTOR)


def _beats(plain: Stored, payload: int) -> bool:
    framed = BLOCK_HEADER + len(plain.payload)
    return framed - BLOCK_HEADER - payload >= max(MIN_GAIN, framed // 100)


def _frame(parts: list[Stored], sizes: list[int]) -> bytes:
    """Inner blocks with their sizes, checksums, labels and payloads."""
    out = [struct.pack("<I", len(parts))]
    for s, n in zip(parts, sizes, strict=True):
        name = s.label.encode()
        out += [struct.pack("<IIB", n, len(s.payload), len(name)), name, s.payload]
    return b"".join(out)


def _framed(data: bytes, dictionary: bytes, size: int) -> tuple[list[bytes], bytes]:
    """(inner blocks, what follows them)."""
    if len(data) < 4:
        raise ValueError("truncated container")
    (count,), at, out, total = struct.unpack("<I", data[:4]), 4, [], 0
    for _ in range(count):
        if at + 9 > len(data):
            raise ValueError("truncated container")
        n, coded, name = struct.unpack("<IIB", data[at : at + 9])
        at += 9 + name + coded
        total += n
        if at > len(data) or total > size:
            raise ValueError("container out of bounds")
        label = data[at - coded - name : at - coded].decode()
        if label.startswith(("seg", "col")):
            raise ValueError("a container inside a container")
        out.append(decode(data[at - coded : at], label, n, dictionary))
    return out, data[at:]


def segments(data: bytes, o: Options) -> list[tuple[int, int]]:
    """Stretches of windows that look alike (alphabet and route), none smaller than ``segment``, none larger than ``most``."""
    n, w = len(data), max(o.window, 1)
    starts = list(range(0, max(n // w, 1) * w, w))
    runs: list[list] = []
    for k, a in enumerate(starts):
        part = data[a : n if k == len(starts) - 1 else a + w]
        distinct = len(np.unique(np.frombuffer(part, np.uint8)))
        kind = (int(np.searchsorted([1, 16, 64, 192], distinct)), route(part, o)[0])
        if runs and runs[-1][0] == kind:
            runs[-1][2] += len(part)
        else:
            runs.append([kind, a, len(part)])
    while len(runs) > 1 and min(r[2] for r in runs) < o.segment:
        i = min(range(len(runs)), key=lambda k: (runs[k][2], k))
        j = i - 1 if i and (i + 1 == len(runs) or runs[i - 1][2] >= runs[i + 1][2]) else i + 1
        a, b = sorted((i, j))
        runs[a : b + 1] = [[runs[j][0], runs[a][1], runs[a][2] + runs[b][2]]]
        if a + 1 < len(runs) and runs[a][0] == runs[a + 1][0]:
            runs[a : a + 2] = [[runs[a][0], runs[a][1], runs[a][2] + runs[a + 1][2]]]
        if a and runs[a - 1][0] == runs[a][0]:
            runs[a - 1 : a + 1] = [[runs[a][0], runs[a - 1][1], runs[a - 1][2] + runs[a][2]]]
    out = []
    for _, a, size in runs:
        pieces = -(-size // o.most)
        out += [(a + size * k // pieces, a + size * (k + 1) // pieces) for k in range(pieces)]
    return out


def _column_options(o: Options, kind: str) -> Options:
    """Bytes are no numbers, integers are no floats."""
    return replace(o, numeric=o.numeric and kind != "b", floats=o.floats and kind == "f", dictionary=b"")


def encode(data: bytes, o: Options) -> Stored:
    """The smallest of the plain block, its segments and its columns; a container must save clearly."""
    plain = _plain(data, o)
    best = None
    if o.segment and len(data) >= 2 * o.segment and len(cuts := segments(data, o)) > 1:
        parts = [_plain(data[a:b], o) for a, b in cuts]
        payload = _frame(parts, [b - a for a, b in cuts])
        if _beats(plain, len(payload)):
            best = Stored("seg", payload, plain.plan, sum(p.saved for p in parts), [p.label for p in parts])
    record = sum(w for w, _ in o.fields)
    if record and len(data) >= record:
        n = len(data) // record
        table = np.frombuffer(data, np.uint8, n * record).reshape(n, record)
        edges = np.cumsum([0, *(w for w, _ in o.fields)])
        columns = [table[:, a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        parts = [_plain(c, _column_options(o, kind)) for c, (_, kind) in zip(columns, o.fields, strict=True)]
        payload = struct.pack("<B", len(o.fields)) + bytes(w for w, _ in o.fields) + _frame(parts, [len(c) for c in columns]) + data[n * record :]
        if _beats(plain, len(payload)) and (best is None or len(payload) < len(best.payload)):
            best = Stored("col", payload, plain.plan, 0, [p.label for p in parts])
    return best or plain


def decode(payload: bytes, label: str, size: int, dictionary: bytes = b"") -> bytes:
    """The block again. ``dictionary`` is the one that its label asks for."""
    if label == "seg":
        parts, rest = _framed(payload, dictionary, size)
        out = b"".join(parts)
        if rest or len(out) != size or len(parts) < 2:
            raise ValueError("segments of a wrong length")
        return out
    if label == "col":
        k = payload[0] if payload else 0
        widths = list(payload[1 : 1 + k])
        if len(widths) != k or not k:
            raise ValueError("truncated columns")
        parts, tail = _framed(payload[1 + k :], dictionary, size)
        rows = len(parts[0]) // widths[0] if parts else 0
        if [len(p) for p in parts] != [rows * w for w in widths]:
            raise ValueError("columns of different lengths")
        made = np.concatenate([np.frombuffer(p, np.uint8).reshape(rows, w) for p, w in zip(parts, widths, strict=True)], axis=1).tobytes() + tail
        if len(made) != size:
            raise ValueError("columns of a wrong length")
        return made
    if label.startswith("dict"):
        if not dictionary:
            raise ValueError("dictionary missing")
        data = payload[8:]
        if "+" in label:
            if len(data) < 4:
                raise ValueError("truncated payload")
            n = struct.unpack("<I", data[:4])[0]
            if n > 2 * size + 1024:
                raise ValueError("inner length out of bounds")
            data = codecs.ENTROPY[label.split("+")[1]][1](data[4:], n)
        return codecs.lz_decode(data, size, dictionary)
    return codecs.decode_plan(payload, label, size)


def exhaustive(data: bytes, o: Options) -> list[tuple[int, str]]:
    """Every layout really encoded: (bytes, label), smallest first; the oracle that plans are judged by."""
    n = len(data)
    labels = [Candidate(i, t, c, z or "", e).label for i, t, c, z, e, _ in CANDIDATES if not (e.startswith("rans") and n < RANS_LEAST[o.profile] or e == "rans4x" and n < 16384)]
    labels += ["num1"] * (o.numeric and n >= 4) + [x for x in fixed.LAYOUTS if x != "num1" and o.floats and n >= 16]
    return sorted((len(codecs.encode_plan(data, label)), label) for label in labels)
