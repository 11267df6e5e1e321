"""Joins of households, persons, pools and censuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .sampling import keyed


def persons_with_household(persons: DataFrame, households: DataFrame, key: str = "hhid") -> DataFrame:
    return persons.join(households, key)


def household_with_main(households: DataFrame, mains: DataFrame, key: str = "hhid") -> DataFrame:
    """Households with their one Main person; of columns that both have, the household's stays."""
    clash = [c for c in mains.columns if c in households.columns and c != key]
    return households.join(mains.drop(*clash), key)


def main_with_relation(mains: DataFrame, others: DataFrame, key: str = "hhid") -> DataFrame:
    """All persons of a relation with their Main person, whose columns end in ``_main``."""
    return mains.withColumnsRenamed({c: f"{c}_main" for c in mains.columns if c != key}).join(others, key, "right")


def pair_by_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    return left.join(right, F.col(left_id) == F.col(right_id))


def matched_and_missing(records: DataFrame, pool: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records joined to the pool on all shared attributes, and the records whose combination the pool lacks."""
    keys = list(keys)
    return records.join(pool, keys), records.join(pool.select(*keys).distinct(), keys, "left_anti")


def wildcard_match(records: DataFrame, pool: DataFrame, att: str, keys: Sequence[str], wild: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """A pool combination for each record: equal on ``keys``, and on ``att`` equal or with a wild state on either side.

    The equal keys make it an equi-join with a residual; of several candidates
    the one with the smallest keyed hash is taken.
    """
    wild = list(wild)
    p = pool.withColumnRenamed(att, "__p_att")
    fits = (F.col(att) == F.col("__p_att")) | F.col(att).isin(wild) | F.col("__p_att").isin(wild)
    j = records.join(p, list(keys)).where(fits)
    pick = W.partitionBy(*order).orderBy(keyed(seed, *order, "__p_att"), "__p_att")
    return j.withColumn("__n", F.row_number().over(pick)).where("__n = 1").drop("__n")


def mutual_semi(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each side whose key the other side has."""
    return left.join(right, key, "left_semi"), right.join(left, key, "left_semi")


def consistent_pools(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of each pool whose combination of ``keys`` occurs in the other."""
    keys = list(keys)
    return left.join(right.select(*keys).distinct(), keys, "left_semi"), right.join(left.select(*keys).distinct(), keys, "left_semi")


def households_without_member(persons: DataFrame, condition, key: str = "hhid") -> DataFrame:
    """Persons of the households in which nobody meets the condition."""
    return persons.join(persons.where(condition).select(key).distinct(), key, "left_anti")


def crosswalk(df: DataFrame, codes: DataFrame, key: str, old: str, new: str, out: str) -> DataFrame:
    """Codes of one edition looked up in another; a code that is listed twice takes its largest match."""
    one = codes.groupBy(F.col(old).alias(key)).agg(F.max(new).alias(out))
    return df.join(one, key, "left")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns])


def union_runs(runs: Mapping[str, DataFrame], name: str = "run") -> DataFrame:
    """One long table of several runs' rows."""
    out = None
    for k, df in runs.items():
        df = df.withColumn(name, F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out


def sub_population(households: DataFrame, persons: DataFrame, ids: DataFrame, key: str = "hhid") -> tuple[DataFrame, DataFrame]:
    """The households of a list of ids, and all their persons."""
    some = ids.select(key).distinct()
    return households.join(some, key, "left_semi"), persons.join(some, key, "left_semi")
