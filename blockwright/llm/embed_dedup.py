"""Near-duplicate vectors by sorted projection passes.

In every pass each vector, less the mean of its label, gets a code, the signs of its products with 64 random directions;
vectors are ordered by (label, code) and each is compared with the WINDOW next ones. Order is global: narrow rows are range-sorted and numbered
by partition offsets, then cut into blocks that also hold the first WINDOW rows of the next block, so no pair is lost at
a border. Pairs are verified by the cosine in double precision; each block hands on its links as stars, and groups are
joined across passes. Vectors close to each other share long code beginnings; without the mean taken off, a direction
that a label shares would set the same bits in all its codes.

How often two near vectors meet falls with the size of a label and depends on its spread, so the number of passes is not
fixed: labels of more than WINDOW + 1 nodes get rounds of ``passes`` new passes until a round joins no two groups, one
such round at least beyond the first. Smaller labels are compared whole in the first pass. A pair that no round
brings within a window is still missed; the README states the recall measured against brute force.

Windows join groups but do not see every pair of a large one, so links are then counted exactly: inside each group all
vectors are multiplied in blocks on the executors, where only counts leave a block, never pairs.

Equal vectors of a label are one node with a count, so thousands of copies cost one row. Defined cases: vectors that are
null, zero or hold null or non-finite components, and rows with a null label, link with nothing and are kept; vectors of
different lengths do not link; null ids take part but give no component its name; repeated rows link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwright.llm._graph import components
from blockwright.llm._store import release, stored, table
from blockwright.llm._words import released

COSINE = 0.98
PASSES, WINDOW, BLOCK = 12, 48, 2048
#: Side of the blocks in which links of a group are counted.
SIDE = 256
#: Cosines nearer to the limit than this are summed exactly.
EDGE = 1e-12


def _matrix(column, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # no overflow in the squares
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _by_dim(b):
    dims = b.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), b.take(pa.array(at))


def _sums(batches):
    """Sums of unit vectors by label, a row per batch and label."""
    for b in batches:
        for dim, part in _by_dim(b):
            labels, own = np.unique(part.column("label").to_numpy(), return_inverse=True)
            order = np.argsort(own, kind="stable")
            x = np.add.reduceat(_matrix(part.column("embedding"), dim)[order], np.searchsorted(own[order], np.arange(len(labels))))
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.full(len(labels), dim, np.int32)), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "dim", "sums"])


def _codes(first: int, passes: int, seed: int):
    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, part in _by_dim(b):
                x = _matrix(part.column("embedding"), dim)
                centred = part.column("centre").is_valid().to_numpy(zero_copy_only=False)
                x[centred] -= np.asarray(part.column("centre").filter(pa.array(centred)).flatten(), np.float64).reshape(-1, dim)
                for p in range(first, first + passes):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, p, dim]).standard_normal((dim, 64))
                    bits = np.packbits(x @ planes[p, dim] > 0, axis=1)
                    code = bits.reshape(-1).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)  # signed order is code order
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), p, np.int32)), part.column("label"), part.column("dim"), pa.array(code.view(np.int64)), part.column("key")], names=["pass", "label", "dim", "code", "key"])

    return released(run)


def _numbered(batches):
    part, row = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))], names=[*b.schema.names, "part", "local"])
        row += n


def _roots(n: int, pairs) -> np.ndarray:
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _near(s: np.ndarray, x, y, least: float) -> np.ndarray:
    """Which cosines ``s`` reach ``least``. Sums round differently in different kernels, so a cosine that lies on the edge is
    summed exactly from its two vectors (``x`` and ``y`` of its place): every caller decides alike on a pair."""
    near = s >= least
    for at in zip(*np.nonzero(np.abs(s - least) < EDGE), strict=True):
        near[at] = math.fsum(x(*at) * y(*at)) >= least
    return near


def _compared(window: int, least: float):
    """Links inside one block of the order, as stars: (key, root's key)."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("row").combine_chunks()
        group = [block.column(c).to_numpy() for c in ("pass", "label", "dim")]
        row, key = block.column("row").to_numpy(), block.column("key").to_numpy()
        edge = np.flatnonzero(np.logical_or.reduce([g[1:] != g[:-1] for g in group])) + 1
        out_a, out_b = [], []
        for lo, hi in zip([0, *edge], [*edge, len(row)], strict=True):
            if hi - lo < 2:
                continue
            x = _matrix(block.column("embedding").slice(lo, hi - lo).combine_chunks(), int(group[2][lo]))
            pairs = []
            for d in range(1, min(window, hi - lo - 1) + 1):
                at = np.flatnonzero(_near(np.einsum("ij,ij->i", x[:-d], x[d:]), lambda i: x[i], lambda i: x[i + d], least))  # noqa: B023
                pairs.extend(zip(at.tolist(), (at + d).tolist(), strict=True))
            if pairs:
                root = _roots(hi - lo, pairs)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                out_a.append(key[lo + moved])
                out_b.append(key[lo + root[moved]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return run


def _counted(least: float):
    """For two blocks of a group (or one): how many vectors each key links with in the other."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        i, j, own = (rows.column(c).to_numpy() for c in ("i", "j", "own"))
        key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        x = _matrix(rows.column("embedding").combine_chunks(), rows.column("dim")[0].as_py())
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = _near(x[a] @ x[b].T, lambda p, q: x[a[p]], lambda p, q: x[b[q]], least)
        if i[0] == j[0]:
            np.fill_diagonal(near, False)
            return pa.table({"key": key[a], "links": near @ n[b]})
        return pa.table({"key": np.concatenate([key[a], key[b]]), "links": np.concatenate([near @ n[b], near.T @ n[a]])})

    return run


def _links(rows: DataFrame, nodes: DataFrame, first: int, passes: int, window: int, least: float, seed: int) -> DataFrame:
    """(a, b), stored: the links that ``passes`` passes, the first of them numbered ``first``, find among ``rows``."""
    order = ["pass", "label", "dim", "code", "key"]
    schema = "pass int, label long, dim int, code long, key long"
    codes = rows.select("key", "label", "dim", "embedding", "centre").mapInArrow(_codes(first, passes, seed), schema)
    placed = stored(codes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"{schema}, part int, local long"), "vector-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = stored(placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")), "vector-parts")
    row = placed.join(F.broadcast(parts), "part").select("pass", "label", "dim", "key", (F.col("n0") + F.col("local")).alias("row"))
    block = F.floor(F.col("row") / BLOCK)
    own = F.array(block)
    both = F.when((F.col("row") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(own)
    dealt = row.withColumn("block", F.explode(both)).join(nodes.select("key", "embedding"), "key")
    links = stored(dealt.groupBy("block").applyInArrow(_compared(window, least), "a long, b long").distinct(), "vector-links")
    release(placed, parts)
    return links


def vector_groups(vectors: DataFrame, least: float = COSINE, passes: int = PASSES, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept."""
    e = F.col("embedding")
    e = e.cast("array<double>")
    sound = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", e.alias("embedding"), F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", e)).alias("key"))
    nodes = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("id"))
    nodes = stored(nodes.withColumn("label", F.xxhash64("label")).withColumn("dim", F.size("embedding")), "vectors")
    # Labels that one window does not hold whole, and the mean of each.
    large = stored(nodes.groupBy("label", "dim").agg(F.count("*").alias("size")).where(F.col("size") > window + 1), "large-labels")
    wide = nodes.select("key", "label", "dim", "embedding").join(large, ["label", "dim"])
    sums = wide.select("label", "dim", "embedding").mapInArrow(_sums, "label long, dim int, sums array<double>").select("label", "dim", F.posexplode("sums").alias("place", "v"))
    means = sums.groupBy("label", "dim", "place").agg(F.sum("v").alias("v")).join(large, ["label", "dim"])
    # Rounded, so that codes do not depend on the order of summing.
    means = means.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("place", F.round(F.col("v") / F.col("size"), 9).alias("v")))).alias("c"))
    centres = stored(means.select("label", "dim", F.col("c.v").alias("centre")), "label-centres")
    every = nodes.select("key", "label", "dim", "embedding").join(centres, ["label", "dim"], "left")
    links = _links(every, nodes, 0, passes, window, least, seed)
    groups = stored(components(links).withColumnRenamed("node", "key"), "vector-groups")
    more, first = not large.isEmpty(), passes
    while more:
        links = _links(every.where("centre is not null"), nodes, first, passes, window, least, seed)
        a, b = (groups.select(F.col("key").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
        new = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        new = stored(new.where("a <> b").distinct(), "new-links")
        release(links)
        first, more = first + passes, not new.isEmpty()
        if more:
            was, joined = groups, new.unionByName(groups.select(F.col("key").alias("a"), F.col("root").alias("b")))
            groups = stored(components(joined).withColumnRenamed("node", "key"), "vector-groups")
            release(was)
        release(new)
    # Links inside each group, counted block against block.
    sides = groups.groupBy("root").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    member = groups.join(sides, "root").join(nodes, "key").withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("sides")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    member = member.select("root", "key", "n", "dim", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    counted = member.groupBy("root", "i", "j").applyInArrow(_counted(least), "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))
    named = groups.join(nodes.select("key", "id"), "key").groupBy("root").agg(F.min("id").alias("component_id"))
    grouped = groups.join(named, "root").join(counted, "key", "left").select("key", "component_id", "links")
    info = nodes.select("key", "n", "id").join(grouped, "key", "left")
    info = info.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("vec_id", "key").join(stored(info, "vector-info"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_near_dedup(spark, sf_dir):
    return vector_groups(table(spark, sf_dir, "embeddings"))
