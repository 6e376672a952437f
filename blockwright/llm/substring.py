"""Substring dedup: words inside any window of 35 words that also starts anywhere else are removed.

1. Every window has a landmark, the least 12-word hash inside it; equal windows have equal landmarks at equal places.
   Each task counts the landmarks it selects in a count-min sketch (kept sparse, as the cells it touched), and the
   partial sketches are added cell range by cell range on the executors. A landmark stands for all windows around it,
   so a cell is touched about once in 12 words, and the sum can only overestimate how often a window occurs.
   What reaches the driver, and is broadcast, is one bit a cell ("two or more"): DEPTH * WIDTH / 8 bytes, 24 MB,
   whatever the size of the corpus. In a corpus of far more landmarks than cells more windows pass; no result changes.
2. Windows estimated at two or more are grouped exactly by a 64-bit hash of their words. Those that occur once after
   all were estimated wrongly, and are written, by text, as exceptions.
3. In a last pass every text drops the words of its windows that pass the sketch and are no exception.

No window is lost: a window that repeats has a landmark at two places. A frequent window costs one row a task after
map-side combining, never a group in one task.

Defined cases: null text has no words and comes back null; an empty text stays empty; texts under 35 words keep all words;
equal rows repeat each other's windows, so both lose them; other columns pass through and the operator's own columns
replace clashing ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm._store import plain_names, small_batches, stored, table
from blockwright.llm._words import Words, mix, released, runs, slices, windows

LENGTH, LANDMARK = 35, 12
#: The sketch: rows, cells a row (a power of two), and the ranges it is merged by.
DEPTH, WIDTH, SEGMENTS = 3, 1 << 26, 256
#: Cells that a task gathers before it hands them on.
FLUSH = 1 << 21
#: Columns that stand beside the caller's on the way.
_KEY, _ONCE = "_substring_key", "_substring_once"
_SALT = np.array([0x632BE59BD9B4E019, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _least(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Over each ``span`` consecutive values the least, and the place of the first that is least."""
    at, n = np.arange(len(h)), len(h) - span + 1
    low, size = h, 1
    while size * 2 <= span:
        m = len(low) - size
        right = low[size:] < low[:m]
        low, at, size = np.where(right, low[size:], low[:m]), np.where(right, at[size:], at[:m]), size * 2
    if size < span:
        right = low[span - size : span - size + n] < low[:n]
        low, at = np.where(right, low[span - size : span - size + n], low[:n]), np.where(right, at[span - size : span - size + n], at[:n])
    return low[:n], at[:n]


def landmarks(words: Words, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, landmark of each window as an index into the third, hashes of the landmarks)."""
    short = min(LANDMARK, length)
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(words.doc[: len(words) - length + 1] == words.doc[length - 1 :])
    grams = runs(words.hash, short)
    _, at = _least(grams, length - short + 1)
    at = at[first]
    if not len(at):
        return first, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return first, np.cumsum(new) - 1, grams[at[new]]


def _cells(h: np.ndarray, width: int) -> np.ndarray:
    """Cell of each hash in each row of the sketch, numbered through all rows."""
    return np.stack([(mix(h ^ _SALT[d]) & np.uint64(width - 1)).astype(np.int64) + d * width for d in range(DEPTH)])


def _partial_sketch(length: int, width: int):
    per = DEPTH * width // SEGMENTS

    def out(parts):
        cells, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(cells, np.arange(SEGMENTS + 1) * per)
        seg = [s for s in range(SEGMENTS) if cut[s] < cut[s + 1]]
        return pa.RecordBatch.from_pydict({
            "segment": pa.array(seg, pa.int32()),
            "cells": pa.array([zlib.compress((cells[cut[s] : cut[s + 1]] - s * per).astype("<u4").tobytes(), 1) for s in seg], pa.binary()),
            "counts": pa.array([zlib.compress(np.minimum(n[cut[s] : cut[s + 1]], 2).astype(np.uint8).tobytes(), 1) for s in seg], pa.binary()),
        })

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for _, _, words in slices(b.column("text")):
                h = landmarks(words, length)[2]
                parts.append(_cells(h, width).ravel())
                held += len(parts[-1])
                if held >= FLUSH:
                    yield out(parts)
                    parts, held = [], 0
        if held:
            yield out(parts)

    return released(run)


def _merged(width: int):
    """Adds partial sketches that come sorted by range; holds one range at a time."""
    per = DEPTH * width // SEGMENTS

    def run(batches):
        now, total = None, None

        def out():
            return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

        for b in batches:
            for seg, cells, counts in zip(b.column("segment").to_pylist(), b.column("cells"), b.column("counts"), strict=True):
                if seg != now:
                    if now is not None:
                        yield out()
                    now, total = seg, np.zeros(per, np.uint8)
                at = np.frombuffer(zlib.decompress(cells.as_buffer()), "<u4")
                total[at] = np.minimum(total[at] + np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint8), 2)
        if now is not None:
            yield out()

    return released(run)


def repeated_bits(docs: DataFrame, length: int = LENGTH, width: int = WIDTH) -> bytes:
    """One bit a cell of the merged sketch: whether it counts two or more. Its size is fixed by DEPTH and ``width``."""
    if DEPTH * width % (8 * SEGMENTS) or width & (width - 1):
        raise ValueError(f"width must be a power of two, at least {8 * SEGMENTS}")
    partial = docs.select("text").mapInArrow(_partial_sketch(length, width), "segment int, cells binary, counts binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged(width), "segment int, bits binary")
    per = DEPTH * width // SEGMENTS // 8
    out = np.zeros(per * SEGMENTS, np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"] * per : (r["segment"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _estimated(words: Words, bits: np.ndarray, length: int, width: int) -> np.ndarray:
    """First words of the windows that the sketch puts at two or more."""
    first, mark, h = landmarks(words, length)
    if not len(first):
        return first
    cells = _cells(h, width)
    twice = np.logical_and.reduce([(bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 for c in cells]).astype(bool)
    return first[twice[mark]]


def _candidates(shared, length: int, width: int):
    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            key = b.column(_KEY).to_numpy(zero_copy_only=False)
            for i, _, words in slices(b.column("text")):
                at = _estimated(words, bits, length, width)
                if not len(at):
                    continue
                h = np.zeros(len(words), np.uint64)
                where, every = windows(words, length)
                h[where] = every
                doc = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(key[i + doc]), pa.array((at - words.first[doc]).astype(np.int32))], names=["window", "key", "start"])

    return released(run)


def _removed(shared, length: int, width: int, spaced: bool):
    """Replaces text; adds n_words and n_removed."""

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            texts = b.column("text")
            once = b.column(_ONCE)
            n_words, n_removed, kept = [], [], []
            for i, j, words in slices(texts):
                at = _estimated(words, bits, length, width)
                lone = [words.first[k - i] + np.asarray(once[k].as_py(), np.int64) for k in range(i, j) if once[k].is_valid]
                if lone:
                    at = np.setdiff1d(at, np.concatenate(lone), assume_unique=True)
                edge = np.zeros(len(words) + 1, np.int32)
                edge[at] += 1
                np.subtract.at(edge, at + length, 1)
                gone = np.cumsum(edge[:-1]) > 0
                data = words.data.tobytes()
                for k in range(j - i):
                    a, z = words.first[k], words.first[k + 1]
                    drop = gone[a:z]
                    n = int(drop.sum())
                    n_words.append(int(z - a))
                    n_removed.append(n)
                    raw = data[words.offsets[k] : words.offsets[k + 1]]
                    if not texts[i + k].is_valid:
                        kept.append(None)
                    elif spaced and not n:
                        kept.append(raw.decode())
                    elif spaced:
                        nxt = np.append(words.start[a + 1 : z], words.offsets[k + 1])
                        kept.append("".join([data[words.offsets[k] : words.start[a]].decode(), *(data[s:e].decode() for s, e, d in zip(words.start[a:z], nxt, drop, strict=True) if not d)]))
                    else:
                        own = raw.split()  # on the same six bytes
                        kept.append(b" ".join(own if not n else [w for w, d in zip(own, drop, strict=True) if not d]).decode())
            names = [c for c in b.schema.names if c not in (_ONCE, _KEY, "text")]
            columns = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "text", "n_words", "n_removed"])

    return released(run)


def substring_deduped(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, spaced: bool = True) -> DataFrame:
    """``docs`` with the repeated words cut out of text, and n_words, n_removed.

    ``spaced`` keeps the white space after each kept word; otherwise kept words are joined by one space.
    """
    spark = docs.sparkSession
    docs, named = plain_names(small_batches(docs).drop("n_words", "n_removed", _KEY, _ONCE))
    bits = spark.sparkContext.broadcast(repeated_bits(docs, length, width))
    keyed = docs.withColumn(_KEY, F.xxhash64("text"))
    found = keyed.where("text is not null").select(_KEY, "text").mapInArrow(_candidates(bits, length, width), "window long, key long, start int")
    exact = found.groupBy("window").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("start").alias("start"))
    per_text = exact.where("n = 1").groupBy(F.col("key").alias(_KEY)).agg(F.collect_list("start").alias(_ONCE))  # as long as a text at most
    # Written first: the join then reads plain exchanges, of which adaptive execution splits the one that a hot text fills.
    joined = keyed.join(stored(per_text, "substring-once"), _KEY, "left")
    kinds = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)
    names = [c for c in joined.columns if c not in (_ONCE, _KEY, "text")]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "text string", "n_words long", "n_removed long"])
    out = joined.mapInArrow(_removed(bits, length, width, spaced), schema)
    return named(out.select(*docs.columns, "n_words", "n_removed"))


def op10_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_deduped(docs, spaced=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


