"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle's weight is how often the text holds it. Every shingle sends a Poisson process of arrivals whose rate is its
weight, each arrival to a random slot; a slot keeps the shingle that arrives first. A shingle stops as soon as its next
arrival is later than all slots' first ones, so a text costs little more than one draw per shingle. Two texts agree in
a slot with a probability equal to their probability Jaccard similarity.

Slots are banded; texts that share a band share the band's least key, so candidates are grouped by least keys, once for
all bands. A group is dealt into chunks of bounded size, and each chunk, with the group's least key in it, is compared
completely by exact similarity; chunks hand on their links as stars. That settles every group of one chunk, and of a
larger one all texts linked with its least key. Only texts of a larger group that are still apart from it are compared
with the group's other chunks, block against block. So pairs are never emitted, copies linked with the least key cost
time in proportion to their number, and no candidate link is left untested but inside what is linked already.

At a similarity of 0.8, 20 bands of 4 slots miss about 3 pairs in 100,000, and groups are held by many pairs.

Keys are 64-bit hashes of whole texts: equal texts are one node. Defined cases: null texts stand alone and are kept;
empty texts equal each other; a text of 1 to 4 words is one shingle; texts without words link only with equal texts; of
repeated rows ``kept`` holds for all rows of the chosen id and text; null ids are chosen last; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm._graph import components
from blockwright.llm._store import small_batches, stored, table
from blockwright.llm._words import Words, mix, released, runs, slices

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
_TEXT_BYTES, _TEXTS = 2 << 20, 4000
#: Texts, and bytes of text, that are compared at once, about.
CHUNK, CHUNK_BYTES = 128, 8 << 20
_COLUMNS = 4096
_BITS = np.uint64(52)
_LOW = np.uint64((1 << 52) - 1)
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 52-bit shingle hash, count), sorted by both; at most 4096 texts at once."""
    parts = []
    if len(words) >= size:
        inside = words.doc[: len(words) - size + 1] == words.doc[size - 1 :]
        parts.append((words.doc[: len(words) - size + 1][inside], runs(words.hash, size)[inside]))
    per = np.diff(words.first)
    for n in range(1, size):  # a short text is one shingle
        if len(at := np.flatnonzero(per == n)):
            first = words.first[at]
            parts.append((at, runs_at(words.hash, first, n)))
    if not parts:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none.astype(np.float64)
    doc = np.concatenate([d for d, _ in parts]).astype(np.uint64)
    both = np.sort((doc << _BITS) | (np.concatenate([h for _, h in parts]) >> np.uint64(12)))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.append(new, len(both))).astype(np.float64)
    both = both[new]
    return (both >> _BITS).astype(np.int64), both & _LOW, count


def runs_at(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    out = mix(h[first] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * _G + h[first + k])
    return out


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """``n_docs`` x ``k`` slots; a text without shingles has zeros."""
    first = np.full(n_docs * k, np.inf)
    kept = np.zeros(n_docs * k, np.uint64)
    per = np.bincount(doc, minlength=n_docs)
    single = per[doc] == 1  # one shingle takes every slot
    if single.any():
        kept.reshape(n_docs, k)[doc[single]] = h[single, None]
    active = np.flatnonzero(~single)
    time = np.zeros(len(h))
    turn = 0
    while len(active):
        a, d = h[active], doc[active]
        draw = mix(a + np.uint64(int(_G) * (2 * turn + 1) & 0xFFFFFFFFFFFFFFFF))
        time[active] += -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[active]
        slot = d * k + (mix(draw ^ _G) % np.uint64(k)).astype(np.int64)
        t = time[active]
        better = t < first[slot]
        s, ts = slot[better], t[better]
        np.minimum.at(first, s, ts)
        won = first[s] == ts
        kept[s[won]] = a[better][won]
        last = first.reshape(n_docs, k).max(1)
        active = active[t < last[d]]
        turn += 1
    return kept.reshape(n_docs, k)


def probability_jaccard(ha: np.ndarray, xa: np.ndarray, hb: np.ndarray, yb: np.ndarray) -> float:
    """Exact similarity of two weighted sets given as sorted unique hashes and weights."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = xa[i], yb[j]
    only_a, only_b = xa.sum() - x.sum(), yb.sum() - y.sum()
    total = 0.0
    ratio = y / x
    for r in np.unique(ratio):
        total += x[ratio == r].sum() / (np.maximum(x, y / r).sum() + only_a + only_b / r)
    return float(total)


def _banded(bands: int, rows: int, size: int):
    def run(batches):
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(b.column("text")).cast(pa.int32()).to_numpy(zero_copy_only=False)
            for a in range(0, b.num_rows, _TEXTS):
                part = b.slice(a, _TEXTS)
                for i, j, words in slices(part.column("text"), _TEXT_BYTES):
                    doc, h, w = shingles(words, size)
                    sig = signatures(doc, h, w, j - i, bands * rows).reshape(j - i, bands, rows)
                    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (j - i, bands)).copy()
                    for r in range(rows):
                        out = mix(out * _G + sig[:, :, r])
                    some = np.flatnonzero(np.bincount(doc, minlength=j - i) > 0)
                    key = keys[a + i : a + j][some]
                    _, one = np.unique(key, return_index=True)  # copies in this slice are one node
                    held = [out[some][one].ravel().view(np.int64), np.repeat(key[one], bands), np.repeat(sizes[a + i : a + j][some][one], bands)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["band", "key", "bytes"])

    return released(run)


def similar(words: Words, least: float, size: int = WORDS, across: np.ndarray | None = None) -> np.ndarray:
    """The root (an index) of each text, after linking all texts of similarity >= ``least``.

    ``across`` (bool by text) limits the pairs to those of a True and any other text. Shared shingles of all pairs come from
    products of dense column chunks; where no weight exceeds 1 they give the similarity, elsewhere a bound for it.
    """
    n = words.n_docs
    doc, h, w = shingles(words, size)
    _, column, held = np.unique(h, return_inverse=True, return_counts=True)
    total, count = np.bincount(doc, w, minlength=n), np.bincount(doc, minlength=n).astype(float)
    shared = held[column] > 1
    d, c, x = doc[shared], column[shared], w[shared]
    used, c = np.unique(c, return_inverse=True)
    both, part = np.zeros((n, n)), np.zeros((n, n))
    weighted = np.zeros(n, bool)
    weighted[doc[w > 1]] = True
    order = np.argsort(c, kind="stable")
    d, c, x = d[order], c[order], x[order]
    for at in range(0, len(used), _COLUMNS):
        lo, hi = np.searchsorted(c, [at, at + _COLUMNS])
        ones = np.zeros((n, min(_COLUMNS, len(used) - at)), np.float32)
        ones[d[lo:hi], c[lo:hi] - at] = 1
        both += ones @ ones.T
        if weighted.any():
            mass = np.zeros_like(ones)
            mass[d[lo:hi], c[lo:hi] - at] = x[lo:hi]
            part += mass @ ones.T
    with np.errstate(invalid="ignore", divide="ignore"):
        exact = both / (count[:, None] + count[None, :] - both)
        bound = np.minimum(part / total[:, None], (part / total[:, None]).T) if weighted.any() else exact
    plain = ~(weighted[:, None] | weighted[None, :])
    wanted = np.triu(np.where(plain, exact, bound) >= least - 1e-9, 1) & (both > 0)
    if across is not None:
        wanted &= across[:, None] | across[None, :]
    parent = np.arange(n)

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    edge = np.searchsorted(doc, np.arange(n + 1))
    for i, j in zip(*np.nonzero(wanted), strict=True):
        a, b = find(i), find(j)
        if a == b:
            continue
        if not plain[i, j]:
            p, q = slice(edge[i], edge[i + 1]), slice(edge[j], edge[j + 1])
            if probability_jaccard(h[p], w[p], h[q], w[q]) < least - 1e-12:
                continue
        parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _compared(size: int, least: float):
    """Links of one chunk, or of two, as stars: (a, b)."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        key = block.column("key").to_numpy()
        _, one = np.unique(key, return_index=True)
        block, key = block.take(pa.array(one)), key[one]
        across = block.column("apart").to_numpy(zero_copy_only=False) if "apart" in block.schema.names else None
        out_a, out_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(key) > 1:
            for _, _, words in slices(block.column("text").combine_chunks(), 1 << 62):
                root = similar(words, least, size, across)
                moved = np.flatnonzero(root != np.arange(len(root)))
                out_a, out_b = key[moved], key[root[moved]]
        return pa.table({"a": out_a, "b": out_b})

    return run


def near_links(docs: DataFrame, size: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root): groups of two or more different texts, by their keys; ``docs`` has key, doc_id, text."""
    docs = small_batches(docs).where("text is not null")
    banded = stored(docs.select("key", "text").mapInArrow(_banded(bands, rows, size), "band long, key long, bytes int"), "bands")
    ends = banded.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("band", "lo")
    members = banded.join(ends, "band").groupBy("lo", "key").agg(F.max("bytes").alias("bytes"))
    members = stored(members, "candidate-groups")
    # One text per candidate key. The chosen row is joined by id too, so copies of one text do not meet in one task.
    # The least id of a key is found first, with map-side combining, and only then compared with the candidates.
    least_ids = docs.groupBy("key").agg(F.min("doc_id").alias("_id"))
    wanted = least_ids.join(members.select("key").distinct(), "key", "left_semi").withColumnRenamed("key", "_key")
    # Candidates grow with the corpus, so they are never broadcast, however few they are today.
    texts = docs.join(wanted.hint("merge"), (docs["key"] == F.col("_key")) & docs["doc_id"].eqNullSafe(F.col("_id"))).select("key", "text")
    texts = stored(texts.dropDuplicates(["key"]), "candidate-texts")
    pieces_needed = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int")
    groups = stored(members.groupBy("lo").agg(pieces_needed.alias("chunks")).where("chunks > 1"), "large-groups")
    chunk = F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int")
    dealt = members.join(groups, "lo", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0))).select("lo", "key", "chunk")
    heads = groups.select("lo", F.col("lo").alias("key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    first = dealt.unionByName(heads).join(texts, "key").select("lo", "chunk", "key", "text")
    links = stored(first.groupBy("lo", "chunk").applyInArrow(_compared(size, least), "a long, b long"), "links-1")
    linked = stored(components(links).withColumnRenamed("node", "key"), "linked-1")
    if groups.isEmpty():
        return linked.withColumnRenamed("key", "node")
    # What is still apart from its group's least key, against the whole group.
    heads = groups.join(linked.withColumnRenamed("key", "lo"), "lo", "left").select("lo", "chunks", F.coalesce("root", "lo").alias("head_root"))
    heads = stored(heads, "large-group-heads")
    large = members.join(heads, "lo").withColumn("chunk", chunk).join(linked, "key", "left")
    large = stored(large.withColumn("apart", F.coalesce("root", "key") != F.col("head_root")), "large-group-members")
    sides = large.where("apart").groupBy("lo").agg(pieces_needed.alias("sides"))
    large = large.join(sides, "lo")
    side = F.pmod(F.xxhash64("key", F.lit(2)), F.col("sides")).cast("int")
    mine = large.where("apart").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    theirs = large.withColumn("other", F.col("chunk")).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    pieces = ["lo", "side", "other", "key", "apart"]
    blocks = mine.select(*pieces).unionByName(theirs.select(*pieces))
    more = blocks.join(texts, "key").groupBy("lo", "side", "other").applyInArrow(_compared(size, least), "a long, b long")
    more = stored(more, "links-2")
    if more.isEmpty():
        return linked.withColumnRenamed("key", "node")
    return stored(components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more)), "linked-2")


def near_deduped(docs: DataFrame, size: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, key, class_id (the least id of its group), kept."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    groups = near_links(keyed, size, least, bands, rows)
    own = keyed.select("doc_id", F.when(F.col("text").isNotNull(), F.col("key")).alias("key"))
    narrow = own.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    narrow = stored(narrow.select("doc_id", "key", "root"), "document-keys")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "key")).alias("best")
    # Classes of one row need no look-up. Stored, so that the hot keys of the next join come from plain exchanges.
    classes = narrow.where("root is not null").groupBy("root").agg(best, F.count("*").alias("rows")).where("rows > 1")
    classes = stored(classes.select("root", "best"), "document-classes")
    out = narrow.join(classes, "root", "left")
    kept = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key")))
    return out.select("doc_id", "key", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("class_id"), kept.alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_deduped(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")
