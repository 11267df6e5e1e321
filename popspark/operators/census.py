"""Preparation of census marginals in long form (zone, att, state, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def remap_states(marg: DataFrame, rules: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Census states to sample states by rules (att, state, rule).

    A rule is a sample state, ``SHIFT`` (spread the value evenly over the
    states of the attribute that are neither shifted nor deleted),
    ``BREAK:a|b`` (spread it over the census states that map to a or b, each
    name taking an equal part) or ``DELETE``. Missing values count as 0; states
    without a rule keep their name.
    """
    m = marg.join(rules, ["att", "state"], "left").select(zone, "att", "state", F.coalesce("value", F.lit(0)).cast("double").alias("value"), F.coalesce("rule", "state").alias("rule"))
    m = m.where("rule != 'DELETE'")
    cell = W.partitionBy(zone, "att")
    shift = F.col("rule") == "SHIFT"
    m = m.withColumn("__more", F.sum(F.when(shift, F.col("value")).otherwise(0.0)).over(cell)).withColumn("__kept", F.sum(F.when(shift, 0).otherwise(1)).over(cell))
    m = m.where(~shift).withColumn("value", F.col("value") + F.col("__more") / F.col("__kept"))
    names = F.split(F.regexp_replace("rule", "^BREAK:", ""), r"\|")
    broken = F.col("rule").startswith("BREAK:")
    parts = m.select(zone, "att", F.explode(names).alias("name"), (F.col("value") / F.when(broken, F.size(names)).otherwise(1)).alias("value"))
    return parts.groupBy(zone, "att", F.col("name").alias("state")).agg(F.sum("value").alias("value"))


def repair_negative(marg: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Negative cells to 0, taken from the largest state of their zone and attribute (ties by name)."""
    cell = W.partitionBy(zone, "att")
    m = marg.withColumn("__neg", F.sum(F.least("value", F.lit(0))).over(cell)).withColumn("__k", F.row_number().over(cell.orderBy(F.desc("value"), "state")))
    value = F.greatest("value", F.lit(0)) + F.when(F.col("__k") == 1, F.col("__neg")).otherwise(0)
    return m.select(zone, "att", "state", value.alias("value"))


def percent_of_total(marg: DataFrame, zone: str = "zone_id") -> DataFrame:
    total = F.sum("value").over(W.partitionBy(zone, "att"))
    return marg.withColumn("percent", F.when(total != 0, 100 * F.col("value") / total))


def households_by_size(marg: DataFrame, att: str, plus: int = 0, zone: str = "zone_id") -> DataFrame:
    """Households of a zone from the states of its size attribute, with an explicit correction."""
    return marg.where(F.col("att") == att).groupBy(zone).agg((F.sum("value") + plus).alias("total"))


def state_names(columns: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """(column, type, code, state) of names such as ``Type_CODE desc__state``."""
    out = []
    for c in columns:
        head, _, state = c.partition("__")
        kind, _, rest = head.partition("_")
        out.append((c, kind, rest.split(" ")[0], state))
    return out


def derived(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns computed from others, such as those not working: persons less employed."""
    return df.withColumns(columns)


def to_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in ``columns``, these as integers."""
    return df.na.drop(subset=list(columns)).withColumns({c: F.col(c).cast("long") for c in columns})


def zones_present(df: DataFrame, zones: DataFrame, zone: str) -> DataFrame:
    return df.join(zones.select(zone).distinct(), zone, "left_semi")
