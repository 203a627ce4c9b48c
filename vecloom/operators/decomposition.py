"""Groupings of dimensions into subspaces; a subspace is named by its smallest dimension."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Decomposition:
    def __init__(self, subspace_of: Iterable[int]) -> None:
        self.of = list(subspace_of)

    @classmethod
    def singletons(cls, d: int) -> Decomposition:
        return cls(range(d))

    @classmethod
    def whole(cls, d: int) -> Decomposition:
        return cls([0] * d)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Decomposition) and self.of == other.of

    def __len__(self) -> int:
        return len(self.of)

    def subspaces(self) -> list[int]:
        return sorted(set(self.of))

    def dims(self, subspace: int) -> list[int]:
        return [i for i, s in enumerate(self.of) if s == subspace]

    def together(self, i: int, j: int) -> bool:
        if i == j:
            raise ValueError("two different dimensions are needed")
        return self.of[i] == self.of[j]

    def merge(self, i: int, j: int) -> int:
        """Joins the subspaces of two dimensions; gives the new one's name."""
        a, b = sorted((self.of[i], self.of[j]))
        if a == b:
            raise ValueError("the dimensions share a subspace")
        self.of = [a if s == b else s for s in self.of]
        return a

    def splits(self, a: list[int], b: list[int]) -> bool:
        """Whether the lists divide one subspace in two."""
        both = [*a, *b]
        return bool(a) and bool(b) and len(both) == len(set(both)) and sorted(both) == self.dims(self.of[both[0]])

    def split(self, a: list[int], b: list[int]) -> tuple[int, int]:
        if not self.splits(a, b):
            raise ValueError("the lists don't divide a subspace")
        for part in (a, b):
            for i in part:
                self.of[i] = min(part)
        return min(a), min(b)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.of)), "dim int, subspace_id int")
