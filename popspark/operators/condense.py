"""Condensed tables: attribute combinations with counts, long and wide."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import numbered


def condense(df: DataFrame, cols: Sequence[str] | None = None, id_col: str | None = None) -> DataFrame:
    """One row for each combination of ``cols`` with its ``count`` (and, with ``id_col``, its ids in order)."""
    cols = list(cols or [c for c in df.columns if c != id_col])
    more = [F.sort_array(F.collect_list(id_col)).alias("ids")] if id_col else []
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"), *more)


def inflate(df: DataFrame, count: str = "count") -> DataFrame:
    """The inverse: as many rows as ``count`` says; none where it is not positive."""
    n = F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(0)).cast("int")
    return df.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n))).drop("__copy", count)


def inflate_weights(df: DataFrame, weight: str) -> DataFrame:
    """Rows repeated by the whole part of their weight."""
    return inflate(df.withColumn("__n", F.floor(F.col(weight).cast("double"))).drop(weight), "__n")


def marginals(df: DataFrame, zone: str, attributes: Sequence[str]) -> DataFrame:
    """Long counts (zone, att, state, value) of each attribute, from one pass over the rows."""
    long = df.select(F.col(zone), F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in attributes])).alias("x"))
    return long.groupBy(zone, F.col("x.att").alias("att"), F.col("x.state").alias("state")).agg(F.count(F.lit(1)).alias("value"))


def weighted_marginals(df: DataFrame, attributes: Sequence[str], weight: str, zone: str | None = None) -> DataFrame:
    """Long sums of ``weight`` by attribute state."""
    keys = [zone] if zone else []
    long = df.select(*keys, F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in attributes])).alias("x"))
    return long.groupBy(*keys, F.col("x.att").alias("att"), F.col("x.state").alias("state")).agg(F.sum("w").alias("value"))


def widen(long: DataFrame, keys: Sequence[str], states: Sequence[tuple[str, str]]) -> DataFrame:
    """One column ``att__state`` for each of ``states``; absent cells are 0."""
    label = F.concat_ws("__", "att", "state")
    wide = long.withColumn("__label", label).groupBy(*keys).pivot("__label", [f"{a}__{s}" for a, s in states]).agg(F.sum("value"))
    return wide.na.fill(0)


def count_matrix(counts: DataFrame, rows: Sequence[str], att: str, states: Sequence[str]) -> DataFrame:
    """Rows of prior attributes, a column for each state; null marks a combination that does not occur."""
    return counts.groupBy(*rows).pivot(att, list(states)).agg(F.sum("count"))


def matrix_to_counts(matrix: DataFrame, rows: Sequence[str], att: str, states: Sequence[str]) -> DataFrame:
    """The inverse of ``count_matrix``; absent combinations give no row."""
    return matrix.unpivot(list(rows), list(states), att, "count").where(F.col("count").isNotNull())


def shares(df: DataFrame, keys: Sequence[str], weight: Column | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Share of rows, or of ``weight``, of each combination of ``keys``, within groups of ``within``."""
    got = df.groupBy(*within, *keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__v"))
    total = F.sum("__v").over(W.partitionBy(*within))
    return got.select(*within, *keys, (F.col("__v") / total).alias("share"))


def ordered_list(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each group's values as a list in the order of ``order``."""
    got = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__l"))
    return got.select(key, F.transform("__l", lambda x: x["v"]).alias("values"))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each group's first row by an explicit order, without a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    ahead = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ahead).alias("__r"))
    return got.select(*keys, "__r.*").select(df.columns)


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Numbers from 1 in a stated order."""
    return numbered(df, order, name)[0]


def household_total(marg: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Households of a zone: the sum of all cells over the number of attributes."""
    return marg.groupBy(zone).agg((F.sum("target") / F.countDistinct("att")).alias("total"))


def densify(counts: DataFrame, zone: str, reference: DataFrame) -> DataFrame:
    """(zone, att, state, value) for every zone and every state of ``reference`` (att, state); what is missing is 0.

    The state list is a dimension of a few hundred rows: it is exploded from one
    array per zone, not joined.
    """
    states = reference.select("att", "state").distinct().agg(F.sort_array(F.collect_list(F.struct("att", "state"))).alias("all"))
    grid = counts.select(zone).distinct().join(F.broadcast(states)).select(zone, F.explode("all").alias("x")).select(zone, "x.att", "x.state")
    return grid.join(counts, [zone, "att", "state"], "left").select(zone, "att", "state", F.coalesce("value", F.lit(0)).alias("value"))


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """left - right over the union of the cells; a missing cell is 0."""
    a, b = left.select(*keys, F.col(value).alias("__a")), right.select(*keys, F.col(value).alias("__b"))
    j = a.join(b, list(keys), "full")
    return j.select(*keys, (F.coalesce("__a", F.lit(0)) - F.coalesce("__b", F.lit(0))).alias("diff"))


def row_sum(*cols: str) -> Column:
    """Sum across columns, a null counting as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def control_table(df: DataFrame, attributes: Sequence[str], geography: str = "zone", table: str = "households", importance: int = 1000) -> DataFrame:
    """A control row for each attribute state of a full population, with its count."""
    counts = marginals(df.select(F.lit(0).alias("__z"), *attributes), "__z", attributes)
    name = F.concat_ws("__", "att", "state")
    return counts.select(name.alias("target"), F.lit(geography).alias("geography"), F.lit(table).alias("seed_table"), F.lit(importance).alias("importance"), "att", "state", name.alias("control_field"), F.concat(F.lit(f"{table}."), "att", F.lit(" == '"), "state", F.lit("'")).alias("expression"), F.col("value").alias("count"))


def chunks(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows with the number, from 0, of their chunk of ``size`` rows."""
    return row_index(df, order, "__i").withColumn("chunk", F.floor((F.col("__i") - 1) / size)).drop("__i")


def percentile_clip(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values held to the exact outer percentiles."""
    ends = df.agg(F.percentile(column, F.lit(low)).alias("__lo"), F.percentile(column, F.lit(high)).alias("__hi"))
    return df.join(F.broadcast(ends)).withColumn(column, F.greatest("__lo", F.least("__hi", F.col(column)))).drop("__lo", "__hi")
