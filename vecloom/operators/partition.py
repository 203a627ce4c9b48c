"""Set partitions of vectors: (vec_id, block_id) tables, or codes (vec_id, codes) with one block per dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.cost import entropy
from vecloom.operators import contingency


def equal(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, is_equal: whether both have the same blocks, whatever their labels; or one for each ``by``.

    Blocks are the same if pairing them off by vectors gives each block one partner and both tables
    have the same vectors; no block is gathered.  by: names of columns that tell several partitions apart.
    """
    both = a.select(*by, "vec_id", F.col("block_id").alias("x")).join(b.select(*by, "vec_id", F.col("block_id").alias("y")), [*by, "vec_id"], "full")
    pairs = both.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*by).agg((F.coalesce(F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0, F.lit(True)) & (F.count(F.lit(1)) == F.count_distinct("x")) & (F.count(F.lit(1)) == F.count_distinct("y"))).alias("is_equal"))


def joint(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """vec_id, x, y: the block of the common refinement is the pair (x, y); of several partitions told apart by ``by``."""
    return a.select(*by, "vec_id", F.col("block_id").alias("x")).join(b.select(*by, "vec_id", F.col("block_id").alias("y")), [*by, "vec_id"])


def consistent(assigned: DataFrame, sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, is_consistent: whether each vector has one block, and blocks the sizes that are said of them; or one for each ``by``.

    assigned: vec_id, block_id; sizes: block_id, n.
    """
    many = assigned.groupBy(*by, "vec_id").agg(F.count(F.lit(1)).alias("n")).select(*by, (F.col("n") == 1).alias("right"))
    found = assigned.groupBy(*by, "block_id").agg(F.count(F.lit(1)).alias("found"))
    same = found.join(sizes.select(*by, "block_id", "n"), [*by, "block_id"], "full").select(*by, F.col("found").eqNullSafe(F.col("n")).alias("right"))
    return many.unionByName(same).groupBy(*by).agg(F.coalesce(F.every("right"), F.lit(True)).alias("is_consistent"))


def joint_blocks(coded: DataFrame, dims: Sequence[int]) -> DataFrame:
    """key, n: blocks of the joint partition of some dimensions."""
    return joint_blocks_of(coded, [dims]).select("key", "n")


def joint_blocks_of(coded: DataFrame, sets: Sequence[Sequence[int]]) -> DataFrame:
    """set_id, key, n: blocks of the joint partition of each set of dimensions, from one scan."""
    if not all(sets):
        raise ValueError("a joint partition needs dimensions")
    return contingency.blocks(coded, sets)


def block_entropy(sizes: DataFrame) -> DataFrame:
    """One row: h bits, exp_h = 2**h and blocks, from a table with the block sizes n; 0, 1 and 0 for no blocks."""
    total = sizes.agg(F.sum("n").alias("total"))
    h = sizes.crossJoin(F.broadcast(total)).agg(entropy(F.col("n"), F.col("total")).alias("h"), F.count(F.lit(1)).alias("blocks"))
    return h.select("h", F.pow(F.lit(2.0), "h").alias("exp_h"), "blocks")


def set_entropies(coded: DataFrame, sets: Sequence[Sequence[int]]) -> DataFrame:
    """set_id, h, blocks of the joint partition of each set of dimensions, all in one job.

    coded: codes, and n where a row stands for several vectors.
    """
    many = F.col("n") if "n" in coded.columns else F.lit(1)
    return contingency.entropies(coded, [contingency.recipe(s) for s in sets], coded.agg(F.sum(many)).first()[0] or 0)
