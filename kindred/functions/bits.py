"""Sketch bits as Column expressions: blocks, Hamming distances, flips, binarisers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = ("b0", "b1", "b2", "b3")


def popcount(c: Column) -> Column:
    return F.bit_count(c).cast("bigint")


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Differing bits of two sketches given as blocks."""
    total = F.lit(0).cast("bigint")
    for x, y in zip(a, b, strict=True):
        total = total + popcount(x.bitwiseXOR(y))
    return total


def _sum_of_set(weights: Column, flags: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.transform(weights, lambda w, i: F.when(
        F.call_function("getbit", flags, i) == 1, w).otherwise(zero)), zero, lambda s, w: s + w)


def weighted_hamming(a: Sequence[Column], b: Sequence[Column], weights: Sequence[int], bits: int) -> Column:
    """Sum of the weights of differing bits; bit i of block k has weight k * bits + i."""
    total = F.lit(0).cast("bigint")
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        own = F.array(*[F.lit(w).cast("bigint") for w in weights[k * bits:(k + 1) * bits]])
        diff = x.bitwiseXOR(y)
        total = total + _sum_of_set(own, diff)
    return total


def delta_hamming(own: Column, other: Column, deltas: Column) -> Column:
    """Sum of a query's deltas, how far each bit is from changing, over the bits in which it differs from another sketch."""
    differ = F.zip_with(own, other, lambda x, y: x != y)
    return F.aggregate(F.zip_with(differ, deltas, lambda d, w: F.when(d, w).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, w: s + w)


def flips(key: Column, bits: int, most: int) -> Column:
    """All keys within ``most`` flipped bits of key."""
    masks = [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: key.bitwiseXOR(m))


def pack_bits(flags: Column, block: int, bits: int) -> Column:
    """Block number ``block`` of an array of booleans, bit i from element block * bits + i."""
    part = F.slice(flags, block * bits + 1, bits)
    return F.aggregate(F.transform(part, lambda f, i: F.when(f, F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sign_bits(x: Column) -> Column:
    return F.transform(x, lambda v: v > 0)


def trimmed_mean_bits(x: Column, size: int, trim: int = 10) -> Column:
    """Component above the mean of the rest once ``trim`` least and greatest are set aside."""
    rest = size - 2 * trim
    mean = F.aggregate(F.slice(F.array_sort(x), trim + 1, rest), F.lit(0.0), lambda s, v: s + v) / rest
    return F.transform(x, lambda v: v > mean)


def texture_bits(x: Column, size: int) -> Column:
    """Component above the next one; the last is compared with the first."""
    return F.transform(x, lambda v, i: v > F.element_at(x, (i + 1) % size + 1))


def hex_sketch(blocks: Sequence[Column], bits: int) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(b), bits // 4, "0")) for b in blocks])


def unsigned_order(c: Column) -> Column:
    """A sort key that orders a signed long as its unsigned bits."""
    return c.bitwiseXOR(F.lit(-(2**63)))
