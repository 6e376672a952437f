"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lowers case, drops diacritics, maps look-alike letters of other scripts and digits or signs that stand for
letters, and turns everything else into spaces. The lexicon holds whole words and word beginnings; their weights are
squares of lower bounds of log odds learned from labelled rows, so that doubtful entries hardly add up. Of the entries
that match at one word the heaviest counts, a word that comes again counts less each time, and words inside an exception phrase do not count. The score is a logistic
function, fitted on the same rows, of the weight found over the root of the text's length.

Defined cases: null and empty texts score as texts in which nothing is found; repeated rows score alike; labels that
are null or of unknown documents teach nothing; without any usable label the built-in words and slope serve; other
columns pass through and the operator's own columns replace clashing ones.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm._store import fields, plain_names, small_batches, stored, table
from blockwright.llm._words import released

#: Labelled rows that teach, at most (the first by a hash of the id).
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
#: Lengths of the word beginnings that may become entries.
STEMS = range(4, 8)
#: Words known without labels, and their weight. Learned log odds replace it.
SEED_WORDS = "idiot moron stupid loser scum worthless pathetic disgusting imbecile dumbass".split()
SEED_WEIGHT = 4.0
#: Phrases in which such words offend nobody.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "circus clown", "pond scum", "soap scum", "loser bracket", "stupid mistake on my part")
#: Log odds that an entry needs, less this many standard errors, and toxic documents that hold it.
LEAST_ODDS, ERRORS, LEAST_DOCS = 2.0, 1.0, 4
#: Words added to a text's length, so that one hit in a very short text is no certainty.
PAD_WORDS = 10
DEFAULT_FIT = (2.5, -4.0)
BINS, BIN = 64, 0.125

_LOOKALIKES = dict(zip("авеѕкмнорсухіјһԁուԛԝɡαβεικνορτυχοøłđıßæœ", ["a", "b", "e", "s", "k", "m", "h", "o", "p", "c", "y", "x", "i", "j", "h", "d", "n", "u", "q", "w", "g", "a", "b", "e", "i", "k", "v", "o", "p", "t", "u", "x", "o", "o", "l", "d", "i", "s", "a", "o"], strict=True))
_DIGITS = dict(zip("013457@$", "oieastas", strict=True))


@lru_cache(1)
def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the folded one (a space where no letter is meant), and whether it is a letter by itself."""
    fold, letter = np.full(0x110000, 0x20, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or (c > 0x2FFFF):
            continue
        ch = chr(c)
        if not ch.isalpha():
            continue
        low = ch.lower()[0]
        base = unicodedata.normalize("NFKD", low)[0].lower()[0]
        fold[c], letter[c] = ord(_LOOKALIKES.get(low) or _LOOKALIKES.get(base, base)), True
    for a, b in _DIGITS.items():
        fold[ord(a)] = ord(b)
    return fold, letter


def folded(text: str) -> str:
    """Letters and spaces, with one space at either end. Digits and signs count as letters only next to letters."""
    fold, letter = _fold_table()
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4")
    out, is_letter = fold[codes], letter[codes]
    odd = (out != 0x20) & ~is_letter
    if odd.any():
        for at in _groups(np.flatnonzero(odd)):  # a run of such signs is meant as letters if a letter follows
            if not is_letter[at[-1] + 1] or at[-1] - at[0] > 2:
                out[at] = 0x20
    return out.astype("<u4").tobytes().decode("utf-32-le")


def _groups(ix: np.ndarray) -> list[np.ndarray]:
    return np.split(ix, np.flatnonzero(np.diff(ix) > 1) + 1)


def _counts(batches):
    """Documents that hold each entry, by label, of this task's training rows."""
    toxic, clean, docs = Counter(), Counter(), [0, 0]
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(folded(text or "").split())
            stems = {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}
            (toxic if y else clean).update({f" {w} " for w in words} | stems)
            docs[y] += 1
    entries = [*toxic, "#"]
    yield pa.RecordBatch.from_pydict({"entry": entries, "toxic": [*toxic.values(), docs[1]], "clean": [*(clean[e] for e in toxic), docs[0]]})
    rest = [e for e in clean if e not in toxic]
    for i in range(0, len(rest), 100_000):
        part = rest[i : i + 100_000]
        yield pa.RecordBatch.from_pydict({"entry": part, "toxic": [0] * len(part), "clean": [clean[e] for e in part]})


def _automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for entry, w in lexicon.items():
        made.add_word(entry, (len(entry), w))
    for phrase in EXCEPTIONS:
        made.add_word(f" {folded(phrase).strip()} ", (len(phrase) + 2, -1.0))
    made.make_automaton()
    return made


def found_weight(text: str, automaton) -> tuple[float, int]:
    """The weight of the words that count, and how many words the text has."""
    t = folded(text)
    at: dict[int, tuple[float, int]] = {}
    exempt: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(t):
        start = end - n + 1
        if w < 0:
            exempt.append((start, end))
        elif start not in at or w > at[start][0]:
            at[start] = (w, start)
    if exempt:
        at = {s: m for s, m in at.items() if not any(a <= s < b for a, b in exempt)}
    times = Counter((w, t[a : t.find(" ", a + 1)]) for w, a in at.values())
    return sum(w * (1 + math.log(n)) for (w, _), n in sorted(times.items())), len(t.split())


def density(weight: float, words: int) -> float:
    return math.log1p(4 * weight / math.sqrt(words + PAD_WORDS))


def _weight(odds: float) -> float:
    return max(0.0, odds) ** 2 / 4


def _fit(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic function by Newton's method, on counts of (bin, label); lightly bound."""
    x = np.array([(b + 0.5 * (b > 0)) * BIN for b, _, _ in bins])
    y, n = np.array([t for _, t, _ in bins], float), np.array([t + c for _, t, c in bins], float)
    a, b = DEFAULT_FIT
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - n * p) * x).sum() - 0.05 * (a - DEFAULT_FIT[0]), (y - n * p).sum() - 0.05 * (b - DEFAULT_FIT[1])])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.05, (v * x).sum()], [(v * x).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.1), b


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The lexicon and the logistic function, from labelled rows whose crc32(id) mod 4 is not 2.

    At most TRAINING_ROWS rows teach. Every entry with enough evidence in them is taken; entries need LEAST_DOCS toxic
    rows each, so what reaches the driver and is broadcast is bounded by those rows, whatever the size of the corpus.
    """
    small_batches(docs)
    rows = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAINING_ROWS)
    train = stored(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic"), "toxicity-train")
    counted = stored(train.mapInArrow(released(_counts), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    whole = counted.where("entry = '#'").first()
    lexicon = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS}
    if not whole or not whole["toxic"] or not whole["clean"]:
        return {"lexicon": lexicon, "fit": DEFAULT_FIT}
    odds = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1))
    odds = odds - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    seen = counted.where("entry <> '#'").withColumn("odds", odds)
    for r in seen.where(F.col("entry").isin(list(lexicon))).collect():
        lexicon[r["entry"]] = _weight(r["odds"])
    best = seen.where((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= LEAST_DOCS))
    lexicon |= {r["entry"]: _weight(r["odds"]) for r in best.collect()}
    lexicon = {e: w for e, w in lexicon.items() if w > 0}

    def binned(batches):
        automaton = _automaton(lexicon)
        for b in batches:
            z = [density(*found_weight(t or "", automaton)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([min(BINS, int(v / BIN) + (v > 0)) for v in z], pa.int32()), b.column("toxic")], names=["bin", "toxic"])

    bins = train.mapInArrow(binned, "bin int, toxic int").groupBy("bin").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    return {"lexicon": lexicon, "fit": _fit([(r["bin"], r["t"], r["c"]) for r in bins])}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from THRESHOLD on). A map over rows: nothing is shuffled."""
    docs = small_batches(docs).drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAINING_ROWS

    def run(batches):
        automaton, (a, b) = _automaton(shared.value["lexicon"]), shared.value["fit"]
        for batch in batches:
            texts = batch.column("text")
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * density(*found_weight(t.as_py() or "", automaton)) + b)))) for t in texts]
            predicted = pa.array([int(s >= THRESHOLD) for s in score], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), predicted], names=[*batch.schema.names, "score", "predicted"])

    docs, named = plain_names(docs)
    return named(docs.mapInArrow(released(run), f"{fields(docs)}, score double, predicted int"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
