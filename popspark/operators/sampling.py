"""Sampling and integerisation with layout-independent randomness.

Every draw is a keyed hash of stable columns, so that results do not depend on
how rows are partitioned. Weighted draws look a uniform number up in running
sums: a stratum's unit interval is cut into as many buckets as it has pool
rows, a row goes to the buckets that it overlaps, and a draw meets the few rows
of its bucket in an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..durable import cut
from .condense import inflate
from .ordered import numbered, running_total


def keyed(seed: object, *keys: str | Column) -> Column:
    """Hex digest that orders rows at random, alike in every SQL engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def uniform(seed: object, *keys: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(keyed(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sample_exact(df: DataFrame, fraction: float, keys: Sequence[str], seed: object = 0, within: Sequence[str] = ()) -> DataFrame:
    """round(n * fraction) rows of each group, without replacement; of the whole table without ``within``."""
    d = df.withColumn("__o", keyed(seed, *keys))
    if within:
        order = W.partitionBy(*within).orderBy("__o", *keys)
        d = d.withColumn("__n", F.row_number().over(order)).withColumn("__all", F.count(F.lit(1)).over(W.partitionBy(*within)))
        return d.where(F.col("__n") <= F.round(F.col("__all") * fraction)).drop("__o", "__n", "__all")
    d, n = numbered(d, ["__o", *keys], "__n")
    return d.where(F.col("__n") <= int(n * fraction + 0.5)).drop("__o", "__n")


def split_exact(df: DataFrame, fraction: float, keys: Sequence[str], seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """(round(n * fraction) rows at random, the rest): every row is on one side."""
    d, n = numbered(df.withColumn("__o", keyed(seed, *keys)), ["__o", *keys], "__n")
    some = F.col("__n") <= int(n * fraction + 0.5)
    return d.where(some).drop("__o", "__n"), d.where(~some).drop("__o", "__n")


def bernoulli(df: DataFrame, rate: float, keys: Sequence[str], seed: object = 0) -> DataFrame:
    """Rows that each stay with probability ``rate``, by their own number: no count of the table."""
    return df.where(uniform(seed, *keys) < rate)


def sample_count(df: DataFrame, within: Sequence[str], wanted: Column, keys: Sequence[str], seed: object = 0) -> DataFrame:
    """The first ``wanted`` rows of each group in keyed order."""
    order = W.partitionBy(*within).orderBy(keyed(seed, *keys), *keys)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= wanted).drop("__n")


def running_weights(pool: DataFrame, strata: Sequence[str], weight: str, order: Sequence[str], spread: bool = False) -> tuple[DataFrame, DataFrame | tuple[int, float]]:
    """``pool`` with the interval [lo, hi) of its running weight in the stratum; number of rows and total of each stratum.

    Without strata the running sum goes over range partitions, and the number
    and the total are plain ones. With ``spread`` it does so with strata as well:
    a stratum with most of the pool's rows lies in many partitions, whose sums
    are added up by stratum.
    """
    strata = list(strata)
    w = F.col(weight).cast("double")
    pool = pool.where(F.col(weight) > 0)
    if not strata:
        cdf, total = running_total(pool, order, w, "hi")
        cdf = cdf.withColumn("lo", F.col("hi") - w)
        return cdf, (cdf.count(), total)
    if spread:
        n = max(1, int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts = cut(pool.repartitionByRange(n, *strata, *order).withColumn("__part", F.spark_partition_id()))
        totals = parts.groupBy(*strata, "__part").agg(F.sum(w).alias("__s"))  # a row for each partition and stratum in it
        base = F.coalesce(F.sum("__s").over(W.partitionBy(*strata).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        bases = totals.select(*[F.col(c).alias(f"__b_{c}") for c in strata], F.col("__part").alias("__p"), base.alias("__base"))
        inside = W.partitionBy("__part", *strata).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in strata], F.col("__part") == F.col("__p"))
        cdf = parts.withColumn("__in", F.sum(w).over(inside)).join(bases, same).withColumn("hi", F.col("__base") + F.col("__in")).withColumn("lo", F.col("hi") - w)
        cdf = cdf.drop("__in", "__base", "__part", "__p", *[f"__b_{c}" for c in strata])
        return cdf, parts.groupBy(*strata).agg(F.count(F.lit(1)).alias("__rows"), F.sum(w).alias("__total"))
    up = W.partitionBy(*strata).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cdf = pool.withColumn("hi", F.sum(w).over(up)).withColumn("lo", F.col("hi") - w)
    return cdf, pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("__rows"), F.sum(w).alias("__total"))


def weighted_draws(draws: DataFrame, pool: DataFrame, strata: Sequence[str], weight: str, order: Sequence[str], keys: Sequence[str], seed: object = 0, spread: bool = False) -> DataFrame:
    """One pool row for each row of ``draws``, by weight within the stratum, with replacement.

    Draws of a stratum that the pool lacks give no row; without ``strata`` the
    pool is one. ``keys`` identify a draw. ``spread`` is for pools of which one
    stratum may have most of the rows.
    """
    strata = list(strata)
    cdf, sums = running_weights(pool, strata, weight, order, spread)
    d = draws.withColumn("__u", uniform(seed, *keys))
    if strata:
        d, cdf = d.join(sums, strata), cdf.join(sums, strata)
    else:
        both = lambda x: x.withColumn("__rows", F.lit(sums[0]).cast("long")).withColumn("__total", F.lit(float(sums[1])))
        d, cdf = both(d), both(cdf)
    bucket = lambda x: F.least(F.floor(x / F.col("__total") * F.col("__rows")), F.col("__rows") - 1)
    d = d.withColumn("__x", F.col("__u") * F.col("__total")).withColumn("__bucket", bucket(F.col("__x"))).drop("__rows", "__total")
    cdf = cdf.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi"))))).drop("__rows", "__total")
    return d.join(cdf, [*strata, "__bucket"]).where((F.col("__x") >= F.col("lo")) & (F.col("__x") < F.col("hi"))).drop("__u", "__x", "__bucket", "lo", "hi")


def draws_for(counts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``count`` numbered draws (``draw`` from 1) for each row."""
    n = F.greatest(F.coalesce(F.col(count).cast("int"), F.lit(0)), F.lit(0))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return counts.select(*keys, F.explode(every).alias("draw"))


def largest_remainder(df: DataFrame, value: str, within: Sequence[str], order: Sequence[str], total: Column | None = None, out: str = "n") -> DataFrame:
    """Integers with the group's rounded sum (or ``total``) that are each the floor or one more.

    The largest fractions go up, ties in the order of ``order``. A ``total``
    beyond that spreads evenly; a total of 0 is a total, not a missing one.
    """
    g = W.partitionBy(*within)
    v = F.col(value).cast("double")
    goal = F.round(F.sum(v).over(g)) if total is None else total
    d = df.withColumn("__f", F.floor(v)).withColumn("__goal", goal).withColumn("__r", F.round(v - F.floor(v), 9))
    d = d.withColumn("__short", F.col("__goal") - F.sum("__f").over(g)).withColumn("__k", F.row_number().over(g.orderBy(F.desc("__r"), *order))).withColumn("__m", F.count(F.lit(1)).over(g))
    each = F.floor(F.col("__short") / F.col("__m"))
    extra = F.when(F.col("__k") <= F.col("__short") - each * F.col("__m"), 1).otherwise(0)
    return d.withColumn(out, (F.col("__f") + each + extra).cast("long")).drop("__f", "__goal", "__r", "__short", "__k", "__m")


def truncate_replicate_sample(df: DataFrame, value: str, within: Sequence[str], keys: Sequence[str], seed: object = 0, out: str = "n") -> DataFrame:
    """As ``largest_remainder`` to the rounded sum, but the units that are left go at random by fraction.

    Fractions compete by an exponential race (u ** (1 / fraction)), a weighted
    draw without replacement; each value is its floor or one more.
    """
    g = W.partitionBy(*within)
    v = F.col(value).cast("double")
    frac = v - F.floor(v)
    race = F.when(frac > 0, F.pow(F.greatest(uniform(seed, *keys), F.lit(1e-12)), 1 / frac)).otherwise(-1.0)
    d = df.withColumn("__race", race).withColumn("__short", F.round(F.sum(v).over(g)) - F.sum(F.floor(v)).over(g)).withColumn("__k", F.row_number().over(g.orderBy(F.desc("__race"), *keys)))
    return d.withColumn(out, (F.floor(v) + F.when(F.col("__k") <= F.col("__short"), 1).otherwise(0)).cast("long")).drop("__race", "__short", "__k")


def agents_from_weights(joint: DataFrame, weight: str, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Agents of a fitted joint table: integers by largest remainder, then one row each."""
    return inflate(largest_remainder(joint, weight, within, order, out="__n").drop(weight), "__n")


def balanced_types(pool: DataFrame, kind: str, n: int, weight: str, order: Sequence[str], seed: object = 0) -> DataFrame:
    """n rows whose types have the pool's shares, drawn by weight within each type."""
    share = pool.groupBy(kind).agg(F.sum(weight).alias("w"))
    all_types = W.partitionBy()
    share = share.select(kind, (F.col("w") / F.sum("w").over(all_types) * n).alias("want"))
    wanted = largest_remainder(share, "want", [], [kind])
    return weighted_draws(draws_for(wanted, [kind], "n"), pool, [kind], weight, order, [kind, "draw"], seed)


def conditioned_counts(candidates: DataFrame, household: str, size_ok: Column, weight: str, order: Sequence[str], seed: object = 0) -> DataFrame:
    """One candidate for each household among those of the right size.

    Conditioning first draws from the same distribution as drawing again until
    the size matches. Households without a right candidate give no row.
    """
    ok = candidates.where(size_ok)
    return weighted_draws(ok.select(household).distinct(), ok, [household], weight, order, [household], seed)


def fill_household(sizes: DataFrame, household: str, size: str, pool: DataFrame, is_main: str, weight: str, order: Sequence[str], seed: object = 0, open_top: tuple[int, int] = (8, 11)) -> DataFrame:
    """One Main and size - 1 other persons for each household; ``8+`` stands for a number in ``open_top``."""
    lo, hi = open_top
    n = F.when(F.col(size).endswith("+"), lo + F.floor(uniform(f"{seed}-size", household) * (hi - lo + 1))).otherwise(F.col(size).try_cast("int")).cast("int")
    d = draws_for(sizes.withColumn("__n", n), [household], "__n").withColumn(is_main, F.col("draw") == 1)
    return weighted_draws(d, pool, [is_main], weight, order, [household, "draw"], seed)
