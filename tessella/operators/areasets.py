"""Sets of areas by number: the bits of a number are areas.

A number holds what a set has of 36 areas whose area_idx follow each other: a bit for each in its lower part, and above them
which 36 these are. A set is one row for each such group that it has areas of, at least one, and at most as many as it has
areas, however large area_idx are. A union is the bitwise or by element and group, a partial aggregate of fixed width: no set
is looked up anywhere, no dictionary grows with the number of different sets, and what an element gathers (a way its
nodes' sets, a relation its members') is never held beyond its own areas. Arrays are made once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 36  # with 26 bits above them for the group of the largest area_idx


def numbered_area(area: Column) -> Column:
    """The number of the set of one area."""
    group = F.floor(area / BITS).cast("long")
    return F.shiftleft(group, BITS).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (area - group * BITS).cast("int")))


def _group(number: Column) -> Column:
    return F.shiftright(number, BITS)


def _bits(number: Column) -> Column:
    return number.bitwiseAND((1 << BITS) - 1)


def areas_of(number: Column) -> Column:
    """The area_idx of a number's bits, ascending."""
    has = lambda i: F.call_function("shiftright", number, i).bitwiseAND(1) == 1
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), has), lambda i: (_group(number) * BITS + i).cast("int"))


def _keys(numbered: DataFrame) -> list[str]:
    return [c for c in numbered.columns if c != "set_no"]


class AreaSets:
    """Makes sets and takes them apart; local is of no effect, as the driver holds none."""

    def __init__(self, spark: SparkSession, local: int = 0) -> None:
        self.spark, self.made = spark, []

    @property
    def known(self) -> DataFrame:
        """set_no, areas: every number that a step has made."""
        empty = self.spark.createDataFrame([], "set_no long")
        return reduce(DataFrame.union, (m.select("set_no") for m in self.made), empty).distinct().select("set_no", areas_of(F.col("set_no")).alias("areas"))

    def united(self, pairs: DataFrame, key: str) -> DataFrame:
        """key, set_no: the union of the sets of each key; pairs: key and set_no, or area_idx."""
        self.made.append(out := union(pairs, key))
        return out

    def numbered(self, sets: DataFrame, key: str) -> DataFrame:
        """key, set_no for key and areas (arrays); empty sets drop out."""
        return self.united(sets.select(key, F.explode("areas").alias("area_idx")), key)

    def arrays(self, numbered: DataFrame, key: str) -> DataFrame:
        """key, areas (canonical)."""
        groups = numbered.groupBy(key).agg(F.array_sort(F.collect_list("set_no")).alias("numbers"))
        return groups.select(key, F.flatten(F.transform("numbers", areas_of)).alias("areas"))

    def several(self, numbered: DataFrame) -> DataFrame:
        """The elements in more than one area, a row each."""
        return self._counted(numbered).where("n > 1").select(_keys(numbered))

    def single(self, numbered: DataFrame) -> DataFrame:
        """The elements in one area, a row each, and its area_idx."""
        place = F.bit_count(_bits(F.col("set_no")) - 1)
        return self._counted(numbered).where("n = 1").select(*_keys(numbered), (_group(F.col("set_no")) * BITS + place).cast("int").alias("area_idx"))

    def _counted(self, numbered: DataFrame) -> DataFrame:
        """One of the numbers of each element, and n: how many areas all have."""
        return numbered.groupBy(_keys(numbered)).agg(F.max("set_no").alias("set_no"), F.sum(F.bit_count(_bits(F.col("set_no")))).alias("n"))


def union(pairs: DataFrame, key: str) -> DataFrame:
    """As AreaSets.united."""
    number = F.col("set_no") if "set_no" in pairs.columns else numbered_area(F.col("area_idx"))
    own = pairs.select(key, number.alias("set_no"))
    return own.groupBy(key, _group(F.col("set_no")).alias("_group")).agg(F.bit_or("set_no").alias("set_no")).select(key, "set_no")
