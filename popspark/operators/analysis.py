"""Tables behind the evaluation plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window as W, DataFrame, functions as F

from ..functions.attributes import step_numbers
from .condense import shares


def metric_summary(long: DataFrame, keys: Sequence[str], run: str, value: str) -> DataFrame:
    """Mean, least and most over runs of the mean over states."""
    per = long.groupBy(*keys, run).agg(F.avg(value).alias("__v"))
    return per.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"))


def error_points(rmse: DataFrame, jsd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y): mean RMSE and mean distance of every run, the total attribute left out."""
    x = rmse.where("att != 'total'").groupBy(*keys).agg(F.avg("rmse").alias("x"))
    y = jsd.where("att != 'total'").groupBy(*keys).agg(F.avg("jsd").alias("y"))
    return x.join(y, list(keys))


def step_trace(meta: DataFrame, name: str, value: str, steps: int = 75, per_loop: int = 5) -> DataFrame:
    """Mean, least and most at every step from 1; a step without a record has nulls."""
    loop, step = step_numbers(F.col(name), per_loop)
    got = meta.withColumn("step", step).groupBy("step").agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    every = meta.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    return every.join(F.broadcast(got), "step", "left")


def loop_table(meta: DataFrame, name: str, rerun: str, value: str, reruns: Sequence[str]) -> DataFrame:
    """Mean by loop, a column for each rerun."""
    loop, _ = step_numbers(F.col(name))
    return meta.withColumn("loop", loop).groupBy("loop").pivot(rerun, list(reruns)).agg(F.avg(value))


def income_errors(rmse: DataFrame, att: str = "hhinc") -> DataFrame:
    """Mean RMSE of each income band by method, with the band's lower end as sort key."""
    low = F.when(F.col("state").contains("Negative"), -1).when(F.col("state").contains("Nil"), 0).otherwise(F.regexp_extract("state", r"(\d+)", 1).try_cast("int"))
    return rmse.where(F.col("att") == att).groupBy("method", "state").agg(F.avg("rmse").alias("rmse")).withColumn("band_low", low)


def shares_by(df: DataFrame, within: Sequence[str], state: str) -> DataFrame:
    """Shares of a state within groups, such as vehicles by household type."""
    return shares(df, [state], within=within)


def convergence(left: DataFrame, loop: str, value: str) -> DataFrame:
    """Agents left to place after every loop."""
    return left.groupBy(loop).agg(F.sum(value).alias("left"))


def zone_counts(df: DataFrame, zones: DataFrame, zone: str) -> DataFrame:
    """Records of every zone of a list, 0 where there are none."""
    n = df.groupBy(zone).agg(F.count(F.lit(1)).alias("n"))
    return zones.select(zone).distinct().join(n, zone, "left").select(zone, F.coalesce("n", F.lit(0)).alias("n"))


def saa_trace(steps: DataFrame, kept: DataFrame, census: DataFrame, attributes: Sequence[str], zone: str = "zone_id", run: str = "run", step: str = "step") -> DataFrame:
    """(run, step, att, state, rmse): every step's population against the census, with what earlier runs kept.

    ``steps`` and ``kept`` are the sinks' tables, partitioned by run and step and
    by run. Both are condensed to marginal counts first; what a run keeps counts
    for every later one, as a running sum over its cell's runs. Over the zones
    of the census a missing cell is 0; states that it lacks count as well.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in attributes])).alias("x")
    counts = lambda df, *keys: df.select(*keys, zone, cells).groupBy(*keys, zone, "x.att", "x.state").agg(F.count(F.lit(1)).alias("n"))
    at = [zone, "att", "state"]
    now = counts(steps, run, step)
    # (run, step) pairs are few; a cell that any run keeps has a row for each run from there on
    shown = steps.select(run, step).distinct()
    upto = W.partitionBy(*at).orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    held = counts(kept, run)
    grid = held.select(*at).distinct().join(F.broadcast(shown.select(run).distinct().withColumn("__one", F.lit(1))), F.lit(True)).drop("__one").join(held, [run, *at], "left")
    before = grid.withColumn("n", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("n > 0").join(F.broadcast(shown), run)
    goal = census.select(*at, (-F.col("value")).alias("n")).join(F.broadcast(shown.withColumn("__one", F.lit(1))), F.lit(True)).drop("__one")
    every = now.unionByName(before.select(*now.columns)).unionByName(goal.select(*now.columns))
    diff = every.groupBy(run, step, *at).agg(F.sum("n").alias("d"))
    zones = F.broadcast(census.select(zone).distinct().agg(F.count(F.lit(1)).alias("__z")))
    return diff.groupBy(run, step, "att", "state").agg(F.sum(F.col("d") * F.col("d")).alias("__s")).join(zones).select(run, step, "att", "state", F.sqrt(F.col("__s") / F.col("__z")).alias("rmse"))


def trace_means(trace: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """(run, step, mean): the mean RMSE over all states at each step."""
    return trace.groupBy(run, step).agg(F.avg("rmse").alias("mean"))


def error_columns(rmse: DataFrame, runs: Sequence[str], run: str = "run") -> DataFrame:
    """(att, state, a column for each run): the runs' errors side by side on the attribute's states, null where a run has none."""
    return rmse.groupBy("att", "state").pivot(run, list(runs)).agg(F.first("rmse"))
