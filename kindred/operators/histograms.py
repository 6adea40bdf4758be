"""Random histograms: groups of vectors as weights over the bins of several sets of hashes, and distances between groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.lsh import Lsh


@dataclass(frozen=True)
class RandomHistogram:
    """N sets of M hashes, each below ``bins``. A set has bins of its own, and each of its hashes gives a vote to one of them."""
    sets: tuple[tuple[Lsh, ...], ...]
    bins: int

    def dim(self) -> int:
        return len(self.sets) * self.bins

    def votes(self, vec: Column) -> Column:
        """The bins, of all sets one after the other, that get the vector's weight; one may come several times."""
        return F.array(*[(h.hash(vec) + n * self.bins).cast("int") for n, hashes in enumerate(self.sets) for h in hashes])


def histograms(rows: DataFrame, by: Sequence[str], vec: str, weight: Column, of: RandomHistogram) -> DataFrame:
    """(by, bin, weight): the bins of each group that hold any weight; votes are summed before they are shuffled."""
    voted = rows.where(F.col(vec).isNotNull()).select(*by, weight.alias("weight"), F.explode(of.votes(F.col(vec))).alias("bin"))
    return voted.groupBy(*by, "bin").agg(F.sum("weight").alias("weight"))


def distances(held: DataFrame, group: str) -> DataFrame:
    """(a, b, l1, shared) of all pairs a < b of groups that share a bin, for held(group, bin, weight).

    l1 is the sum of differences: what both weigh less twice what they share, so only shared bins are joined. Groups that
    share none are as far apart as both weigh; they are not listed.
    """
    side = lambda name: held.select(F.col(group).alias(name), "bin", F.col("weight").alias(f"{name}_weight"))
    total = held.groupBy(group).agg(F.sum("weight").alias("total"))
    shared = side("a").join(side("b"), "bin").where("a < b").groupBy("a", "b").agg(F.sum(F.least("a_weight", "b_weight")).alias("shared"))
    of = lambda name: total.select(F.col(group).alias(name), F.col("total").alias(f"{name}_total"))
    return shared.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("a_total") + F.col("b_total") - 2 * F.col("shared")).alias("l1"), "shared")
