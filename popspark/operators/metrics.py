"""Evaluation of a synthetic population against a census, a seed or a full population."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .condense import condense, differences, marginals
from .sampling import bernoulli

CELL = ("zone_id", "att", "state")


def rmse(census: DataFrame, syn: DataFrame, by: str = "attribute", zone: str = "zone_id") -> DataFrame:
    """Root mean squared cell difference of long marginals, missing cells counting as 0.

    ``zonal``: over the states of each zone; ``attribute``: over the zones of
    each state. Cells that both lack but their zone and state occur count too.
    """
    d = differences(census, syn, (zone, "att", "state"))
    keys, other = (["att", "state"], zone) if by == "attribute" else ([zone], None)
    if other:
        n = d.select(zone).distinct().agg(F.count(F.lit(1)).alias("__n"))
    else:
        n = d.select("att", "state").distinct().agg(F.count(F.lit(1)).alias("__n"))
    sums = d.groupBy(*keys).agg(F.sum(F.col("diff") * F.col("diff")).alias("__s"))
    return sums.join(F.broadcast(n)).select(*keys, F.sqrt(F.col("__s") / F.col("__n")).alias("rmse"))


def jensen_shannon(left: DataFrame, right: DataFrame, state: str, weight: str, within: Sequence[str] = (), base: float = math.e) -> DataFrame:
    """Jensen-Shannon distance (root of the divergence) of two weighted state tables, per group.

    Weights are normalised within the group; a state that one side lacks has
    share 0; a group that one side lacks altogether gives null.
    """
    keys = [*within, state]
    j = left.groupBy(*keys).agg(F.sum(weight).cast("double").alias("__p")).join(right.groupBy(*keys).agg(F.sum(weight).cast("double").alias("__q")), keys, "full").na.fill(0, ["__p", "__q"])
    g = W.partitionBy(*within)
    j = j.withColumn("p", F.try_divide("__p", F.sum("__p").over(g))).withColumn("q", F.try_divide("__q", F.sum("__q").over(g))).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("m"))).when(F.col(x).isNotNull(), 0.0)
    return j.groupBy(*within).agg(F.sqrt(F.greatest((F.sum(term("p")) + F.sum(term("q"))) / 2 / math.log(base), F.lit(0.0))).alias("jsd"))


def srmse(actual: DataFrame, predicted: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Standardised RMSE of the joint distributions: root of the summed squared share differences times the actual support."""
    atts = list(attributes)
    share = lambda d, n: condense(d, atts).withColumn(n, F.col("count") / F.sum("count").over(W.partitionBy())).drop("count")
    j = share(actual, "a").join(share(predicted, "p"), atts, "full")
    total = F.sum(F.pow(F.coalesce("a", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)), 2))
    return j.agg(F.sqrt(total * F.count("a")).alias("srmse"))


def srmse_product(actual: DataFrame, predicted: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """SRMSE over the product of the actual attribute states; predicted combinations outside it do not count."""
    atts = list(attributes)
    inside, cells = predicted, None
    for a in atts:
        states = actual.select(a).distinct()
        inside = inside.join(states, a, "left_semi")
        n = states.agg(F.count(F.lit(1)).alias(f"__{a}"))
        cells = n if cells is None else cells.join(F.broadcast(n))
    na, np_ = (d.agg(F.count(F.lit(1)).alias(c)) for d, c in ((actual, "__na"), (predicted, "__np")))
    j = condense(actual, atts).withColumnRenamed("count", "a").join(condense(inside, atts).withColumnRenamed("count", "p"), atts, "full").na.fill(0, ["a", "p"])
    j = j.join(F.broadcast(na)).join(F.broadcast(np_)).join(F.broadcast(cells))
    product = F.lit(1.0)
    for a in atts:
        product = product * F.col(f"__{a}")
    d = F.col("a") / F.col("__na") - F.col("p") / F.col("__np")
    return j.agg(F.sqrt(F.sum(d * d) * F.max(product)).alias("srmse"))


def control_rmse(df: DataFrame, controls: Sequence[tuple[str, str, float]], skip: Sequence[str] = ()) -> DataFrame:
    """RMSE of expected control counts against those of ``df``, in one pass."""
    used = [c for c in controls if c[0] not in skip]
    d = [F.pow(F.lit(float(n)) - F.count_if(F.col(a).cast("string") == s), 2) for a, s, n in used]
    total: Column = F.lit(0.0)
    for x in d:
        total = total + x
    return df.agg(F.sqrt(total / max(1, len(used))).alias("rmse"))


def missing_combinations(seed: DataFrame, syn: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Percentage of the seed's combinations that the synthetic population lacks."""
    atts = list(attributes)
    s = seed.select(*atts).distinct()
    found = s.join(syn.select(*atts).distinct().withColumn("__f", F.lit(1)), atts, "left")
    return found.agg((100 * F.count_if(F.col("__f").isNull()) / F.count(F.lit(1))).alias("missing_percent"))


def combination_coverage(pool: DataFrame, syn: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Distinct combinations of pool and population, those in both, and their share of the pool's."""
    atts = list(attributes)
    a, b = pool.select(*atts).distinct().withColumn("__a", F.lit(1)), syn.select(*atts).distinct().withColumn("__b", F.lit(1))
    j = a.join(b, atts, "full")
    both = F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return j.agg(F.count("__a").alias("pool"), F.count("__b").alias("syn"), both.alias("both"), (100 * both / F.count("__a")).alias("coverage_percent"))


def rare_state(counts: DataFrame, att: str, state: str, zone: str = "zone_id") -> DataFrame:
    """The cell of one state in every zone, 0 where it does not occur."""
    return counts.groupBy(zone).agg(F.sum(F.when((F.col("att") == att) & (F.col("state") == state), F.col("value")).otherwise(0)).alias("value"))


def validate(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise on an empty table or on null, NaN or infinite values."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns]
    got = df.agg(F.count(F.lit(1)).alias("__n"), *bad).collect()[0].asDict()
    if not got.pop("__n"):
        raise ValueError("the table is empty")
    if any(got.values()):
        raise ValueError(f"values missing or not finite: {got}")


def cross_entropy(actual: DataFrame, predicted: DataFrame, state: str, weight: str) -> DataFrame:
    """Bits that the predicted shares need for the actual ones; null where a state has no share predicted."""
    share = lambda d, n: d.groupBy(state).agg(F.sum(weight).cast("double").alias(n)).withColumn(n, F.col(n) / F.sum(n).over(W.partitionBy()))
    j = share(actual, "p").join(share(predicted, "q"), state, "left")
    return j.agg(F.when(F.count_if(F.col("q").isNull()) == 0, -F.sum(F.col("p") * F.log2("q"))).alias("bits"))


def run_metrics(census: DataFrame, runs: DataFrame, zone: str, attributes: Sequence[str], run: str = "run") -> DataFrame:
    """(run, att, state, rmse) of all runs at once, from one table with a run column.

    A run has every census cell: its own differences there, and the census' own
    squares where it has none; the census is added up once, whatever the runs are.
    """
    got = runs.select(run, zone, F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in attributes])).alias("x")).groupBy(run, zone, "x.att", "x.state").agg(F.count(F.lit(1)).alias("value"))
    names = runs.select(F.col(run).alias("__run")).distinct().groupBy().agg(F.collect_set("__run").alias("__runs"))  # one row: the runs' names
    base = census.select(zone, "att", "state", F.col("value").alias("__c")).join(F.broadcast(names)).withColumn(run, F.explode("__runs")).drop("__runs")
    j = base.join(got, [run, zone, "att", "state"], "full")
    d = F.coalesce("__c", F.lit(0)) - F.coalesce("value", F.lit(0))
    n = j.select(zone).distinct().agg(F.count(F.lit(1)).alias("__n"))
    return j.groupBy(run, "att", "state").agg(F.sum(d * d).alias("__s")).join(F.broadcast(n)).select(run, "att", "state", F.sqrt(F.col("__s") / F.col("__n")).alias("rmse"))


def run_summary(census: DataFrame, pool: DataFrame, runs: DataFrame, zone: str, attributes: Sequence[str], rare: tuple[str, str], run: str = "run") -> DataFrame:
    """(run, rmse, jsd, missing_percent, rare): every run's mean error and distance, the pool's combinations that it lacks, its records of a rare state.

    The distance is that of an attribute's shares, over all zones, from the
    census', averaged over the attributes.
    """
    atts = list(attributes)
    error = run_metrics(census, runs, zone, atts, run).groupBy(run).agg(F.avg("rmse").alias("rmse"))
    long = runs.select(run, F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in atts])).alias("x")).groupBy(run, "x.att", "x.state").agg(F.count(F.lit(1)).alias("value"))
    names = runs.select(F.col(run).alias("__run")).distinct().groupBy().agg(F.collect_set("__run").alias("__runs"))
    want = census.groupBy("att", "state").agg(F.sum("value").alias("value")).join(F.broadcast(names)).withColumn(run, F.explode("__runs")).drop("__runs")
    distance = jensen_shannon(want, long, "state", "value", [run, "att"]).groupBy(run).agg(F.avg("jsd").alias("jsd"))
    combos = pool.select(*atts).distinct()
    has = runs.select(run, *atts).distinct().join(combos, atts, "left_semi").groupBy(run).agg(F.count(F.lit(1)).alias("__has"))
    every = F.broadcast(combos.agg(F.count(F.lit(1)).alias("__all")))
    missing = runs.select(run).distinct().join(has, run, "left").join(every).select(run, (100.0 * (F.col("__all") - F.coalesce("__has", F.lit(0))) / F.col("__all")).alias("missing_percent"))
    seldom = runs.groupBy(run).agg(F.count_if(F.col(rare[0]) == rare[1]).alias("rare"))
    return error.join(distance, run).join(missing, run).join(seldom, run)


def population_rmse(full: DataFrame, sample: DataFrame, zone: str, attributes: Sequence[str], scale: float = 1.0) -> DataFrame:
    """RMSE by attribute state of a sample, scaled up, against the full population."""
    s = marginals(sample, zone, attributes).withColumn("value", F.col("value") * scale)
    return rmse(marginals(full, zone, attributes), s, "attribute", zone)


def rmse_over_rates(full: DataFrame, zone: str, attributes: Sequence[str], rates: Sequence[float], keys: Sequence[str], rate: str = "rate") -> DataFrame:
    """(rate, att, state, rmse) of samples at every rate, scaled up, against the full population; each rate draws anew."""
    out = None
    for r in rates:
        part = population_rmse(full, bernoulli(full, r, keys, r), zone, attributes, 1 / r).withColumn(rate, F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out
