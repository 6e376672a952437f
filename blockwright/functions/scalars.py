"""Scalar formulas of the engine as column expressions: integers only, so plans agree in any order of evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ...; for magnitudes under 2^62."""
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.floor(u / 2)).otherwise(-F.floor(u / 2) - 1).cast("long")


def bit_width(v: Column) -> Column:
    """Bits that a non-negative number needs; 0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v))).cast("long")


def packed_bytes(count: Column, width: Column) -> Column:
    return F.expr("0").cast("long") + F.ceil(count * width / F.lit(8)).cast("long")


def ring_delta(d: Column, bits: int) -> Column:
    """A difference in the ring of ``bits``-bit integers, sign-extended (bits <= 32)."""
    half = 1 << (bits - 1)
    return F.pmod(d + F.lit(half), F.lit(1 << bits)) - F.lit(half)


def gamma_bits(v: Column) -> Column:
    """Length of the Elias gamma code of v + 1."""
    return (2 * (bit_width(v + 1) - 1) + 1).cast("long")


def label(transforms: Column, codec: Column, lz: Column, entropy: Column) -> Column:
    """A plan's name, as in "delta+lz_balanced+huffman"."""
    name = F.when(lz.isNotNull(), F.concat_ws("_", codec, lz)).otherwise(codec)
    return F.concat_ws("+", F.when(transforms != "", transforms), name, F.when(entropy != "none", entropy))


def aligned_block_size(block_size: Column, record: Column) -> Column:
    """The block size rounded down to whole records, one record at least."""
    return (F.greatest(F.floor(block_size / record), F.lit(1)) * record).cast("long")


def read_amplification(physical: Column, logical: Column) -> Column:
    return F.when(logical == 0, F.lit(0.0)).otherwise(physical / logical).cast("double")


def ratio(before: Column, after: Column) -> Column:
    """Compression ratio; 1 where nothing came out."""
    return F.when(after == 0, F.lit(1.0)).otherwise(before / after).cast("double")
