"""Random access: the block index, range intersection, reading a range, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import read_amplification


#: Blocks of a page of the index; bytes of a cell by which ranges find blocks.
PAGE, CELL = 4096, 1 << 20


def block_index(rows: DataFrame, bytes_per_value: int = 8) -> DataFrame:
    """(block_id, values, size, original_offset): running offsets over blocks, one row each.

    Sums run inside pages of PAGE block ids, and over one row a page, so no task sees all blocks.
    """
    sizes = rows.groupBy("block_id").agg(F.count("*").alias("values")).withColumn("size", F.col("values") * bytes_per_value)
    paged = sizes.withColumn("page", F.floor(F.col("block_id") / PAGE))
    before = Window.partitionBy("page").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    pages = paged.groupBy("page").agg(F.sum("size").alias("whole"))
    pages = pages.select("page", F.coalesce(F.sum("whole").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row per page
    inside = paged.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return inside.join(pages, "page").select("block_id", "values", "size", (F.col("start") + F.col("inside")).alias("original_offset"))


def _cells(first: Column, last: Column) -> Column:
    return F.sequence(F.floor(first / CELL), F.floor(F.greatest(last - 1, first) / CELL))


def intersecting(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that each range [first, last) touches, and the part of the block inside it.

    Blocks and ranges meet by the cells of CELL bytes they lie in, an equality that shuffles or broadcasts as sizes
    allow; each pair counts in its first common cell only. Work grows with the blocks touched.
    """
    end = F.col("original_offset") + F.col("size")
    b = index.withColumn("cell", F.explode(_cells(F.col("original_offset"), end)))
    r = ranges.withColumn("cell", F.explode(_cells(F.col("first"), F.col("last"))))
    hit = (F.col("original_offset") < F.col("last")) & (end > F.col("first"))
    x = b.join(r, "cell").where(hit & (F.col("cell") == F.floor(F.greatest("original_offset", "first") / CELL))).drop("cell")
    return x.withColumn("take_from", F.greatest(F.col("first") - F.col("original_offset"), F.lit(0))).withColumn("take_to", F.least(F.col("last") - F.col("original_offset"), F.col("size")))


def range_metrics(touched: DataFrame) -> DataFrame:
    """Per range: blocks, physical and logical bytes, amplification; from the index alone."""
    m = touched.groupBy("range_id").agg(F.count("*").alias("blocks"), F.sum("size").alias("physical"), F.sum(F.col("take_to") - F.col("take_from")).alias("logical"))
    return m.withColumn("amplification", F.round(read_amplification(F.col("physical"), F.col("logical")), 6))


def read_values(table: DataFrame, key: str, first: int, last: int, *columns: str) -> DataFrame:
    """Rows whose dense key lies in [first, last): a predicate that reaches the scan and prunes row groups."""
    return table.where((F.col(key) >= first) & (F.col(key) < last)).select(key, *columns)


def resolve_dictionaries(blocks: DataFrame, embedded: DataFrame, registry: DataFrame) -> DataFrame:
    """Each block with its dictionary, the embedded one before the registry's; both tables are small and checked by size."""
    x = blocks.join(embedded.select("dict_id", F.col("bytes").alias("own")), "dict_id", "left").join(registry.select("dict_id", F.col("bytes").alias("external")), "dict_id", "left")
    scope = F.when(F.col("own").isNotNull(), "embedded").when(F.col("external").isNotNull(), "registry").otherwise("missing")
    return x.withColumn("bytes", F.coalesce("own", "external")).withColumn("scope", scope).drop("own", "external")


def missing_dictionaries(blocks: DataFrame, embedded: DataFrame, registry: DataFrame) -> DataFrame:
    known = embedded.select("dict_id").unionByName(registry.select("dict_id"))
    return blocks.where("dict_id is not null").join(known, "dict_id", "left_anti")
