"""Count profiles: the counts of a state as a descending array, each distinct one with its multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_profiles(counts: DataFrame, states: list[str]) -> DataFrame:
    """``states.., profile, total``: a state's positive counts, largest first.

    A state has at most as many counts as there are symbols, so symbols must be capped; ``state_classes`` has no such limit.
    """
    return counts.filter("n > 0").groupBy(*states).agg(F.sort_array(F.collect_list("n"), asc=False).alias("profile"), F.sum("n").alias("total"))


def state_classes(counts: DataFrame, states: list[str]) -> DataFrame:
    """``states.., profile, total``: the same as count classes, an array of (c, symbols), largest count first.

    A state of n occurrences has at most the root of 2 n classes, however large the alphabet.
    """
    classes = class_sizes(counts, states)
    return classes.groupBy(*states).agg(F.sort_array(F.collect_list(F.struct("c", "symbols")), asc=False).alias("profile"), F.sum(F.col("c") * F.col("symbols")).alias("total"))


def profile_multiset(profiles: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``groups.., profile, states``: each distinct profile once, with the number of states that have it.

    What is costly per profile is computed on this table and joined back.
    """
    return profiles.groupBy(*(groups or []), "profile").agg(F.count("*").alias("states"))


def class_sizes(counts: DataFrame, states: list[str]) -> DataFrame:
    """``states.., c, symbols``: how many symbols of a state have count c; bounded by the root of twice its total."""
    return counts.filter("n > 0").groupBy(*states, F.col("n").alias("c")).agg(F.count("*").alias("symbols"))


def spelled(profile: Column) -> Column:
    """A profile as comma-separated text, for comparison across engines."""
    return F.array_join(profile.cast("array<string>"), ",")


def spelled_classes(profile: Column) -> Column:
    """A profile of count classes as text, ``count:symbols`` separated by commas."""
    return F.array_join(F.transform(profile, lambda x: F.concat_ws(":", x["c"], x["symbols"])), ",")


def augment(profile: Column, c: Column) -> Column:
    """The profile after one more occurrence of a symbol with count ``c`` (0: a new symbol).

    A null profile stays null; a count that the profile lacks leaves the profile as it is.
    """
    at = F.array_position(profile, c)
    raised = F.transform(profile, lambda v, i: F.when(i + 1 == at, v + 1).otherwise(v))
    grown = F.when(c == 0, F.concat(profile, F.array(F.lit(1).cast("bigint")))).when(at > 0, raised).otherwise(profile)
    return F.sort_array(grown, asc=False)
