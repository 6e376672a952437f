"""Reversible block codecs over numpy: bytes in, bytes out. They run inside Arrow batches; plans never depend on them.

Every encoder's length equals the size that the SQL estimates give for it. Decoders check lengths before they allocate and raise
``ValueError`` on damaged input.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

NUMERIC_HEADER, SERIES_HEADER = 40, 28
MAX_VALUES = 1 << 24


# Bits ------------------------------------------------------------------------------------------------------------------


def pack_fields(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of given widths, one after the other, least significant bit first."""
    widths = np.asarray(widths, np.int64)
    total = int(widths.sum())
    if not total:
        return b""
    start = np.repeat(np.cumsum(widths) - widths, widths)
    bit = np.arange(total) - start
    bits = (np.repeat(np.asarray(values, np.uint64), widths) >> bit.astype(np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def pack(values: np.ndarray, width: int) -> bytes:
    return pack_fields(values, np.full(len(values), width))


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(count, np.uint64)
    if len(data) * 8 < count * width:
        raise ValueError("truncated bit stream")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class BitReader:
    """Reads fields from the least significant bit on; a field costs one slice of bytes, whatever its width."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("truncated bit stream")
        first = self.at >> 3
        out = int.from_bytes(self.data[first : first + (n + 14 >> 3)], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        return out

    def gamma(self) -> int:
        first = self.at >> 3
        ahead = int.from_bytes(self.data[first : first + 10], "little") >> (self.at & 7)
        if not ahead:
            raise ValueError("damaged gamma code" if self.at + 72 <= self.end else "truncated bit stream")
        zeros = (ahead & -ahead).bit_length() - 1
        if zeros > 64:
            raise ValueError("damaged gamma code")
        self.at += zeros + 1
        return (1 << zeros | self.read(zeros)) - 1

    def fields(self, count: int, width: int) -> np.ndarray:
        """``count`` fields of one width."""
        if self.at + count * width > self.end:
            raise ValueError("truncated bit stream")
        first, last = self.at >> 3, self.at + count * width + 7 >> 3
        bits = np.unpackbits(np.frombuffer(self.data[first:last], np.uint8), bitorder="little")[self.at & 7 :][: count * width]
        self.at += count * width
        return unpack(np.packbits(bits, bitorder="little").tobytes(), count, width)

    def finish(self) -> None:
        """Nothing but the filling of the last byte may be left, and that is zero."""
        if self.end - self.at >= 8 or self.read(self.end - self.at):
            raise ValueError("bytes after the end of the stream")


def _gamma_fields(v: int) -> tuple[int, int, int, int]:
    """(value, width) of the unary part and of the rest."""
    low = (v + 1).bit_length() - 1
    return 1 << low if low < 64 else 0, low + 1, v + 1 - (1 << low), low


def zigzag(d: np.ndarray) -> np.ndarray:
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def _width(top: int) -> int:
    return int(top).bit_length()


# Transforms and byte codecs --------------------------------------------------------------------------------------------


def delta_encode(data: bytes) -> bytes:
    return np.diff(np.frombuffer(data, np.uint8), prepend=np.uint8(0)).tobytes()


def delta_decode(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def _literals(out: bytearray, data: bytes) -> None:
    for i in range(0, len(data), 128):
        part = data[i : i + 128]
        out.append(len(part) - 1)
        out += part


def rle_encode(data: bytes) -> bytes:
    """Runs of 4 to 128 as 0x80 | length - 1 and the byte; literals of up to 128 as length - 1 and the bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    length = np.diff(np.append(start, len(a)))
    long = length >= 4
    out, held = bytearray(), 0
    for s, n in zip(start[long].tolist(), length[long].tolist(), strict=True):
        _literals(out, data[held:s])
        held = s
        while n >= 4:
            k = min(n, 128)
            out += bytes((0x80 | k - 1, data[s]))
            n -= k
            held += k
    _literals(out, data[held:])
    return bytes(out)


def rle_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = (data[i] & 0x7F) + 1
        part = data[i + 1 : i + 2] * n if data[i] & 0x80 else data[i + 1 : i + 1 + n]
        if len(part) != n or len(out) + n > size:
            raise ValueError("damaged run-length packet")
        out += part
        i += 2 if data[i] & 0x80 else 1 + n
    return _sized(bytes(out), size)


def _sized(out: bytes, size: int) -> bytes:
    if len(out) != size:
        raise ValueError(f"decoded {len(out)} bytes, {size} expected")
    return out


def lz_encode(data: bytes, history: bytes = b"", chain: int = 16) -> bytes:
    """Matches of 4 to 130 bytes within 65535, as 0x80 | length - 4 and the distance; literals as in run-length packets.

    ``history`` is a dictionary that stands before the block; ``chain`` earlier places are tried, 1 for the fast mode.
    """
    text = history[-65535:] + data
    base, n = len(text) - len(data), len(text)
    before, near = _earlier(text, base)
    out, held, i = bytearray(), base, base
    while i < n:
        i = near[i - base] if i + 4 <= n else n  # places without an earlier one are literals
        if i >= n:
            break
        best, at, top, left, p = 0, 0, min(130, n - i), chain, before[i]
        word = int.from_bytes(text[i : i + top], "little")
        while left and p >= 0 and i - p <= 65535:
            if not best or text[p + best] == text[i + best]:
                other = word ^ int.from_bytes(text[p : p + top], "little")
                k = (other & -other).bit_length() - 1 >> 3 if other else top
                if k > best:
                    best, at = k, p
                    if k == top:
                        break
            left, p = left - 1, before[p]
        if best >= 4:
            _literals(out, text[held:i])
            out += struct.pack("<BH", 0x80 | best - 4, i - at)
            i += best
            held = i
        else:
            i += 1
    _literals(out, text[held:])
    return bytes(out)


def _earlier(text: bytes, base: int) -> tuple[list[int], list[int]]:
    """For each place the last earlier one with the same four bytes, or -1; and from each place on, less ``base``, the next that
    has one. The three words across the end of the history count as no place."""
    n = len(text)
    if n < 4:
        return [], []
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    word = a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24
    known = np.concatenate([np.arange(max(0, base - 3)), np.arange(base, n - 3)])
    order = known[np.argsort(word[known], kind="stable")]
    before = np.full(n - 3, -1)
    same = word[order[1:]] == word[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    near = np.where(before[base:] >= 0, np.arange(base, n - 3), n)
    return before.tolist(), np.minimum.accumulate(near[::-1])[::-1].tolist()


def lz_decode(data: bytes, size: int, history: bytes = b"") -> bytes:
    out = bytearray(history[-65535:])
    base, i = len(out), 0
    while i < len(data):
        if data[i] & 0x80:
            if i + 3 > len(data):
                raise ValueError("truncated match")
            n, d = (data[i] & 0x7F) + 4, data[i + 1] | data[i + 2] << 8
            if not 0 < d <= len(out) or len(out) - base + n > size:
                raise ValueError("match outside the block")
            part = out[len(out) - d : len(out) - d + n]
            out += part if d >= n else (part * (n // d + 1))[:n]
            i += 3
        else:
            n = data[i] + 1
            if i + 1 + n > len(data) or len(out) - base + n > size:
                raise ValueError("truncated literals")
            out += data[i + 1 : i + 1 + n]
            i += 1 + n
    return _sized(bytes(out[base:]), size)


# Numeric lanes ---------------------------------------------------------------------------------------------------------


def numeric_encode(v: np.ndarray, mode: int) -> bytes:
    """A 64-bit lane: 1 frame of reference, 2 differences, 3 second differences; 40 bytes and the packed stream."""
    v = np.asarray(v, np.int64)
    first = int(v[0]) if len(v) else 0
    second, base = 0, 0
    with np.errstate(over="ignore"):
        if mode == 1:
            base = int(v.min()) if len(v) else 0
            stream = (v - base).view(np.uint64)
        elif mode == 2:
            stream = zigzag(np.diff(v))
        elif mode == 3:
            d = np.diff(v)
            second = int(d[0]) if len(d) else 0
            stream = zigzag(np.diff(d))
        else:
            raise ValueError(f"mode {mode}")
    width = _width(stream.max()) if len(stream) else 0
    return struct.pack("<4sBBHIqqqI", b"NUM1", 8, mode, width, len(v), first, second, base, 0) + pack(stream, width)


def numeric_decode(data: bytes) -> np.ndarray:
    if len(data) < NUMERIC_HEADER or data[:4] != b"NUM1":
        raise ValueError("not a numeric payload")
    _, _, mode, width, n, first, second, base, _ = struct.unpack("<4sBBHIqqqI", data[:NUMERIC_HEADER])
    if n > MAX_VALUES or width > 64 or mode not in (1, 2, 3):
        raise ValueError("numeric header out of bounds")
    stream = unpack(data[NUMERIC_HEADER:], max(n - (mode - 1), 0), width)
    with np.errstate(over="ignore"):
        if mode == 1:
            return (stream.view(np.int64) + base)[:n]
        if mode == 2:
            return np.cumsum(np.concatenate([[first], unzigzag(stream)]).astype(np.int64), dtype=np.int64)[:n]
        d = np.cumsum(np.concatenate([[second], unzigzag(stream)]).astype(np.int64), dtype=np.int64)
        return np.cumsum(np.concatenate([[first], d]).astype(np.int64), dtype=np.int64)[:n]


def patched_encode(v: np.ndarray, bits: int) -> bytes:
    """Frame of reference with ``bits`` in place; higher parts follow with their places."""
    v = np.asarray(v, np.int64)
    off = (v - v.min()).view(np.uint64)
    top = _width(off.max())
    odd = np.flatnonzero(off >> np.uint64(bits)) if bits < 64 else np.zeros(0, np.int64)
    head = struct.pack("<4sBBHIqqqI", b"NUM1", 8, 4, bits, len(v), int(v.min()), len(odd), 0, 0)
    low = off & np.uint64((1 << bits) - 1)
    return head + bytes([top]) + pack(low, bits) + pack(odd.astype(np.uint64), _width(len(v) - 1)) + pack(off[odd] >> np.uint64(bits), top - bits)


def patched_decode(data: bytes) -> np.ndarray:
    if len(data) < NUMERIC_HEADER + 1 or data[:4] != b"NUM1" or data[5] != 4:
        raise ValueError("not a patched payload")
    _, _, _, bits, n, base, count, _, _ = struct.unpack("<4sBBHIqqqI", data[:NUMERIC_HEADER])
    top, place = data[NUMERIC_HEADER], _width(n - 1)
    if n > MAX_VALUES or count > n or bits > top:
        raise ValueError("patched header out of bounds")
    at = NUMERIC_HEADER + 1
    cut = [(n * bits + 7) // 8, (count * place + 7) // 8]
    off = unpack(data[at : at + cut[0]], n, bits)
    odd = unpack(data[at + cut[0] : at + sum(cut)], count, place).astype(np.int64)
    if len(odd) and odd.max() >= n:
        raise ValueError("exception outside the block")
    off[odd] |= unpack(data[at + sum(cut) :], count, top - bits) << np.uint64(bits)
    return off.view(np.int64) + base


def run_delta_encode(v: np.ndarray) -> bytes:
    """Per change gamma(run) and gamma(zigzag change), then gamma(last run) and gamma(0)."""
    v = np.asarray(v, np.int64)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(start, len(v)))
    change = zigzag(np.diff(v[start])) if len(start) else np.zeros(0, np.uint64)
    fields = []
    for n, z in zip(lengths.tolist(), [*change.tolist(), 0], strict=False):
        fields += [_gamma_fields(n), _gamma_fields(z)]
    flat = np.array(fields, np.uint64).reshape(-1, 4)
    values, widths = flat[:, [0, 2]].ravel(), flat[:, [1, 3]].ravel().astype(np.int64)
    return struct.pack("<4sBBHIqq", b"TS1R", 8, 1, 0, len(v), int(v[0]) if len(v) else 0, 0) + pack_fields(values, widths)


def run_delta_decode(data: bytes) -> np.ndarray:
    if len(data) < SERIES_HEADER or data[:4] != b"TS1R":
        raise ValueError("not a run payload")
    n, now = struct.unpack("<Iq", data[8:20])
    if n > MAX_VALUES:
        raise ValueError("run header out of bounds")
    bits, values, lengths, left = BitReader(data[SERIES_HEADER:]), [], [], n
    while left:
        run, z = bits.gamma(), bits.gamma()
        if not 0 < run <= left:
            raise ValueError("run outside the block")
        values.append(now)
        lengths.append(run)
        left -= run
        step = (z >> 1) ^ -(z & 1)
        now = (now + step + (1 << 63)) % (1 << 64) - (1 << 63)
    return np.repeat(np.array(values, np.int64), lengths)


def gorilla_encode(v: np.ndarray) -> bytes:
    """XOR with the predecessor: 0; or 1 0 and the bits of the last window; or 1 1, leading (5), length - 1 (6), bits."""
    b = np.asarray(v, np.float64).view(np.uint64)
    x = (b[1:] ^ b[:-1]).tolist()
    values, widths = [], []
    lead, tail = 65, 0
    for w in x:
        if not w:
            values.append(0)
            widths.append(1)
            continue
        l, t = min(64 - w.bit_length(), 31), (w & -w).bit_length() - 1  # noqa: E741
        if l >= lead and t >= tail:
            values += [1, w >> tail]
            widths += [2, 64 - lead - tail]
        else:
            lead, tail = l, t
            values += [3, l | (63 - l - t) << 5, w >> t]
            widths += [2, 11, 64 - l - t]
    return struct.pack("<4sBBHIQQ", b"TS1G", 8, 2, 0, len(b), int(b[0]) if len(b) else 0, 0) + pack_fields(np.array(values, np.uint64), np.array(widths, np.int64))


def gorilla_decode(data: bytes) -> np.ndarray:
    if len(data) < SERIES_HEADER or data[:4] != b"TS1G":
        raise ValueError("not an XOR payload")
    n, now = struct.unpack("<IQ", data[8:20])
    if n > MAX_VALUES:
        raise ValueError("XOR header out of bounds")
    bits, out, size, tail = BitReader(data[SERIES_HEADER:]), [now] if n else [], 0, 0
    for _ in range(n - 1):
        if bits.read(1):
            if bits.read(1):
                lead, size = bits.read(5), bits.read(6) + 1
                tail = 64 - lead - size
                if tail < 0:
                    raise ValueError("damaged window")
            now ^= bits.read(size) << tail
        out.append(now)
    return np.array(out, np.uint64).view(np.float64)


def alp_encode(v: np.ndarray, e: int, f: int) -> bytes:
    """Decimals as packed integers; what does not come back exactly follows raw, with its place."""
    v = np.asarray(v, np.float64)
    with np.errstate(all="ignore"):
        scaled = v * float(10**e) * (1.0 / 10**f)
        q = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
        ok = np.isfinite(q) & (np.abs(q) < 9e15)
        q = np.where(ok, q, 0).astype(np.int64).astype(np.float64)  # a negative zero does not survive
        odd = ~ok | ((q * float(10**f) * (1.0 / 10**e)).view(np.uint64) != v.view(np.uint64))
    ints = np.where(odd, 0, q).astype(np.int64)
    base = int(ints[~odd].min()) if (~odd).any() else 0
    off = np.where(odd, 0, ints - base).view(np.uint64)
    width = _width(off.max()) if len(off) else 0
    at = np.flatnonzero(odd)
    head = struct.pack("<4sBBBBIqII", b"TS1A", 8, e, f, width, len(v), base, len(at), 0)
    return head + pack(off, width) + pack(at.astype(np.uint64), _width(max(len(v) - 1, 0))) + v[at].tobytes()


def alp_decode(data: bytes) -> np.ndarray:
    if len(data) < SERIES_HEADER or data[:4] != b"TS1A":
        raise ValueError("not a decimal payload")
    _, _, e, f, width, n, base, count, _ = struct.unpack("<4sBBBBIqII", data[:SERIES_HEADER])
    place = _width(max(n - 1, 0))
    if n > MAX_VALUES or count > n or width > 64 or max(e, f) > 18:
        raise ValueError("decimal header out of bounds")
    cut = SERIES_HEADER + (n * width + 7) // 8
    end = cut + (count * place + 7) // 8
    if len(data) != end + 8 * count:
        raise ValueError("decimal payload has a wrong length")
    out = (unpack(data[SERIES_HEADER:cut], n, width).view(np.int64) + base).astype(np.float64) * float(10**f) * (1.0 / 10**e)
    at = unpack(data[cut:end], count, place).astype(np.int64)
    if len(at) and at.max() >= n:
        raise ValueError("exception outside the block")
    out[at] = np.frombuffer(data[end:], np.float64)
    return out


# Entropy coders --------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths; equal weights by the lower symbol first."""
    return _code_lengths(counts.astype(np.int64).tobytes())


@functools.lru_cache(8)  # a layout is sized and then encoded
def _code_lengths(counts: bytes) -> np.ndarray:
    counts = np.frombuffer(counts, np.int64)
    heap = [(int(c), s, k) for k, (s, c) in enumerate((s, c) for s, c in enumerate(counts.tolist()) if c)]
    out, symbols = np.zeros(256, np.uint8), [s for _, s, _ in heap]
    if len(heap) == 1:
        out[symbols[0]] = 1
        return out
    heapq.heapify(heap)
    above = [0] * (2 * len(heap))
    for made in range(len(heap), 2 * len(heap) - 1):
        a = heapq.heappop(heap)
        b = heap[0]
        above[a[2]] = above[b[2]] = made
        heapq.heapreplace(heap, (a[0] + b[0], min(a[1], b[1]), made))
    deep = [0] * len(above)
    for k in range(2 * len(symbols) - 3, -1, -1):
        deep[k] = deep[above[k]] + 1
    out[symbols] = deep[: len(symbols)]
    return out


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes with their first bit lowest."""
    code, last, out = 0, 0, [0] * 256
    for n, s in sorted((n, s) for s, n in enumerate(lengths.tolist()) if n):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return np.array(out, np.uint64)


def huffman_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    lengths = code_lengths(np.bincount(a, minlength=256))
    return struct.pack("<I", len(data)) + lengths.tobytes() + pack_fields(_canonical(lengths)[a], lengths[a])


def huffman_size(data: bytes) -> int:
    """Bytes that ``huffman_encode`` makes."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return 260 + (int((counts * code_lengths(counts)).sum()) + 7) // 8


def huffman_decode(data: bytes, size: int) -> bytes:
    if len(data) < 260 or struct.unpack("<I", data[:4])[0] != size:
        raise ValueError("damaged code table")
    lengths = np.frombuffer(data[4:260], np.uint8)
    if not size:
        return b""
    used, coded, most = lengths.tolist(), len(data) - 260, int(lengths.max())
    if most > 56:
        raise ValueError("damaged code table")  # no block is large enough for such a code
    codes = _canonical(lengths).tolist()
    window = min(most, 16)
    symbol, wide = np.zeros(1 << window, np.uint8), np.zeros(1 << window, np.uint8)
    for n, s in sorted(((n, s) for s, n in enumerate(used) if 0 < n <= window and codes[s] >> n == 0), key=lambda x: (-x[0], x[1])):
        symbol[codes[s] :: 1 << n] = s
        wide[codes[s] :: 1 << n] = n
    # At every bit, how long the code is that would start there: symbols are read off at the places that follow from the first.
    body = np.frombuffer(data[260:] + bytes(8), np.uint8)
    a = body.astype(np.int64)
    ahead = a[:coded] | a[1 : coded + 1] << 8 | a[2 : coded + 2] << 16
    at = ((ahead[:, None] >> np.arange(8)) & (1 << window) - 1).ravel()
    end, step = 8 * coded, wide[at]
    long = _long_codes(body, used, codes, window, step) if most > window else None
    hop = np.arange(end + 2)
    hop[:end] += step
    hop[:end][step == 0] = end + 1  # nothing fits there
    np.minimum(hop, end + 1, out=hop)
    hop[end] = end + 1
    first_hop, hops = hop, [hop]
    while len(hops) < 4 and 1 << len(hops) < size:
        hops.append(hops[-1].take(hops[-1]))
    far, starts, p = hops.pop(), [], 0
    jump = 1 << len(hops)
    for _ in range(-(-size // jump)):
        starts.append(p)
        p = far.item(p)
    place = np.array(starts)
    for hop in reversed(hops):
        both = np.empty(2 * len(place), np.int64)
        both[::2], both[1::2] = place, hop.take(place)
        place = both
    place = place[:size]
    if place.item(-1) >= end or first_hop.item(place.item(-1)) > end:
        raise ValueError(f"decoded less than {size} bytes")
    out = symbol.take(at.take(place))
    if long is not None:
        found = long[place]
        out = np.where(found >= 0, found, out).astype(np.uint8)
    return out.tobytes()


def _long_codes(body: np.ndarray, used: list[int], codes: list[int], window: int, step: np.ndarray) -> np.ndarray:
    """Symbols whose codes are longer than the window, where no shorter one fits, else -1; fills in their lengths."""
    here = np.full(len(step), -1)
    open_ = np.flatnonzero(step == 0)
    word = np.zeros(len(open_), np.uint64)
    for k in range(8):
        word |= body[(open_ >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    word >>= (open_ & 7).astype(np.uint64)
    for n, s in sorted(((n, s) for s, n in enumerate(used) if n > window and codes[s] >> n == 0), key=lambda x: (x[0], -x[1])):
        hit = (word & np.uint64((1 << n) - 1) == np.uint64(codes[s])) & (step[open_] == 0)
        here[open_[hit]] = s
        step[open_[hit]] = n
    return here


SCALE = 1 << 12
_LOW = 1 << 23


def normalized(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 4096, at least 1 for each symbol present, the rest by largest remainder."""
    total = counts.sum()
    exact = counts * SCALE / max(total, 1)
    out = np.where(counts > 0, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
    order = sorted(range(256), key=lambda s: (-(exact[s] - np.floor(exact[s])), s))
    k = 0
    while total and out.sum() < SCALE:
        s = order[k % 256]
        out[s] += counts[s] > 0
        k += 1
    while out.sum() > SCALE:
        out[int(np.argmax(out))] -= 1
    return out


def rans_encode(data: bytes, lanes: int = 1) -> bytes:
    """Static range coder of 12 bits: the model (512 bytes), one state a lane, then each lane's bytes; ``lanes`` 1 or 4."""
    f = normalized(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    start = np.cumsum(f) - f
    fl, sl = f.tolist(), start.tolist()
    states, streams = [], []
    for lane in range(lanes):
        x, out = _LOW, bytearray()
        for s in reversed(data[lane::lanes]):
            while x >= (_LOW >> 12 << 8) * fl[s]:
                out.append(x & 0xFF)
                x >>= 8
            x = x // fl[s] * SCALE + x % fl[s] + sl[s]
        states.append(x)
        streams.append(bytes(reversed(out)))
    head = f.astype("<u2").tobytes() + b"".join(struct.pack("<I", x) for x in states)
    return head + (b"" if lanes == 1 else b"".join(struct.pack("<I", len(s)) for s in streams)) + b"".join(streams)


def rans_decode(data: bytes, size: int, lanes: int = 1) -> bytes:
    head = 512 + 4 * lanes * (1 if lanes == 1 else 2)
    if len(data) < head:
        raise ValueError("truncated model")
    f = np.frombuffer(data[:512], "<u2").astype(np.int64)
    if size and f.sum() != SCALE:
        raise ValueError("damaged model")
    slot = np.repeat(np.arange(256), f).tolist()
    fl, sl = f.tolist(), (np.cumsum(f) - f).tolist()
    states = list(struct.unpack(f"<{lanes}I", data[512 : 512 + 4 * lanes]))
    sizes = [len(data) - head] if lanes == 1 else list(struct.unpack(f"<{lanes}I", data[512 + 4 * lanes : head]))
    out, at = bytearray(size), head
    for lane in range(lanes):
        x, i, end = states[lane], at, at + sizes[lane]
        for k in range(lane, size, lanes):
            s = slot[x & SCALE - 1]
            out[k] = s
            x = fl[s] * (x >> 12) + (x & SCALE - 1) - sl[s]
            while x < _LOW:
                if i >= min(end, len(data)):
                    raise ValueError("truncated range coder")
                x = x << 8 | data[i]
                i += 1
        at = end
    return bytes(out)


def crc32c_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


#: Bytes that a checksum takes at once; tables of the checksum of a byte so many places before the end of them, and of a state
#: after so many zeros.
_SPAN = 256
_BYTE = crc32c_table()
_CRC = _BYTE.tolist()


def _after(states: np.ndarray) -> np.ndarray:
    """States after one more zero byte."""
    return _BYTE[states & np.uint32(255)] ^ (states >> np.uint32(8))


def _crc_tables() -> tuple[np.ndarray, list[list[int]]]:
    ahead = [_BYTE]
    for _ in range(_SPAN - 1):
        ahead.append(_after(ahead[-1]))
    zeros = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(_SPAN):
        zeros = _after(zeros)
    return np.concatenate(ahead[::-1]), zeros.tolist()


_AHEAD, _ZEROS = _crc_tables()
_PLACES = np.arange(_SPAN, dtype=np.int64) * 256


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum."""
    if len(data) < 64:
        c = 0xFFFFFFFF
        for b in data:
            c = _CRC[(c ^ b) & 0xFF] ^ c >> 8
        return c ^ 0xFFFFFFFF
    rows = -(-len(data) // _SPAN)
    a = np.zeros(rows * _SPAN, np.uint8)  # zeros in front change nothing
    a[-len(data) :] = np.frombuffer(data, np.uint8)
    a[-len(data) :][:4] ^= 0xFF
    one, two, three, four = _ZEROS
    c = 0
    for part in np.bitwise_xor.reduce(_AHEAD[a.reshape(rows, _SPAN) + _PLACES], axis=1).tolist():
        c = one[c & 0xFF] ^ two[c >> 8 & 0xFF] ^ three[c >> 16 & 0xFF] ^ four[c >> 24] ^ part
    return c ^ 0xFFFFFFFF


ENTROPY = {
    "none": (lambda d: d, lambda d, n: _sized(d, n)), "huffman": (huffman_encode, huffman_decode), "rans": (rans_encode, rans_decode),
    "rans4x": (lambda d: rans_encode(d, 4), lambda d, n: rans_decode(d, n, 4)),
}
BYTES = {
    "raw": (lambda d: d, lambda d, n: _sized(d, n)), "rle": (rle_encode, rle_decode), "lz_fast": (lambda d: lz_encode(d, chain=1), lz_decode), "lz_balanced": (lz_encode, lz_decode),
}


def encode_plan(data: bytes, label: str) -> bytes:
    """Transforms, then the codec, then the entropy coder that a plan's label names; the inner length stands before an entropy coder.

    Labels without an entropy coder may also name a layout of fixed-width lanes (``fixed.LAYOUTS``).
    """
    from blockwright.functions.fixed import LAYOUTS

    if label in LAYOUTS:
        return LAYOUTS[label][0](data)
    parts = label.split("+")
    if parts[0] == "delta":
        data, parts = delta_encode(data), parts[1:]
    out = BYTES[parts[0]][0](data)
    return struct.pack("<I", len(out)) + ENTROPY[parts[1]][0](out) if len(parts) > 1 else out


def decode_plan(data: bytes, label: str, size: int) -> bytes:
    from blockwright.functions.fixed import LAYOUTS

    if label in LAYOUTS:
        return _sized(LAYOUTS[label][1](data), size)
    parts = label.split("+")
    delta = parts[0] == "delta"
    parts = parts[delta:]
    if len(parts) > 1:
        if len(data) < 4:
            raise ValueError("truncated payload")
        n = struct.unpack("<I", data[:4])[0]
        if n > 2 * size + 1024:
            raise ValueError("inner length out of bounds")
        data = ENTROPY[parts[1]][1](data[4:], n)
    out = BYTES[parts[0]][1](data, size)
    return delta_decode(out) if delta else out
