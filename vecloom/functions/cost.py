"""Storage cost, cluster counts and entropies, as columns and as plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_BITS = 32


def subspace_bits(k: Column, dims: Column, true_n: int) -> Column:
    """N log2 k bits of codes and k float codewords of ``dims`` components."""
    return F.lit(float(true_n)) * F.log2(k.cast("double")) + k * dims * FLOAT_BITS


def subspace_bits_of(k: float, dims: int, true_n: int) -> float:
    return true_n * math.log2(k) + k * dims * FLOAT_BITS


def corrected_of(e: float, product: float, n: int, true_n: int) -> float:
    """Clusters expected among true_n vectors, from the 2**entropy seen among n and the product of the
    dimensions' numbers of blocks: e**r * product**(1 - r), r = log n / log true_n.  A table of more
    than true_n vectors has r > 1: fewer clusters are expected than it shows, as in ``corrected``."""
    if true_n <= 1 or n < 1:
        raise ValueError("the correction needs vectors, and true_n > 1")
    if e > product * (1 + 1e-9):
        raise ValueError("a joint partition can't have more clusters than the product")
    r = math.log2(n) / math.log2(true_n)
    return e**r * product ** (1 - r)


def corrected(e: Column, product: Column, n: int, true_n: int) -> Column:
    r = math.log2(n) / math.log2(true_n)
    return F.pow(e, F.lit(r)) * F.pow(product, F.lit(1 - r))


def entropy(count: Column, n: Column, many: Column | None = None) -> Column:
    """Aggregate: bits of a partition from its blocks' sizes, and how many have each; 0 for an empty one."""
    p = count / n
    bits = p * F.log2(p)
    return F.coalesce(-F.sum(bits if many is None else many * bits), F.lit(0.0))


def codewords_of(clusters_log2: float, blocks: int) -> int:
    """The power of two that holds so many clusters, at most the number of blocks."""
    return min(1 << min(62, max(0, math.ceil(clusters_log2 - 1e-9))), blocks)


def codewords(clusters_log2: Column, blocks: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.ceil(clusters_log2 - 1e-9).cast("double")).cast("long"), blocks.cast("long"))
