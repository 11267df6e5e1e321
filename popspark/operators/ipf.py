"""Iterative proportional fitting of all zones at once (Deming and Stephan, 1940)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..durable import cut


def joint_states(spark, states: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every combination of the attributes' states, exploded from one row."""
    df = spark.range(1).select()
    for att, values in states.items():
        df = df.withColumn(att, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def seeded(joint: DataFrame, seed: DataFrame, attributes: Sequence[str], zero_cell: float = 0.001) -> DataFrame:
    """Weights of all combinations: the seed's counts, and a small number where it has none."""
    atts = list(attributes)
    return joint.join(seed.select(*atts, F.col("count").cast("double").alias("weight")), atts, "left").withColumn("weight", F.when(F.coalesce("weight", F.lit(0.0)) > 0, F.col("weight")).otherwise(zero_cell))


def sweep(w: DataFrame, targets: DataFrame, attributes: Sequence[str], zone: str, zero_marginal: float) -> DataFrame:
    """One fit to every attribute in turn: a window sum and a lookup of the target each."""
    for a in attributes:
        t = targets.where(F.col("att") == a).select(F.col(zone).alias("__z"), F.col("state").alias("__s"), F.greatest(F.col("value").cast("double"), F.lit(zero_marginal)).alias("__t"))
        w = w.join(t, (F.col(zone) == F.col("__z")) & (F.col(a) == F.col("__s")), "left")
        total = F.sum("weight").over(W.partitionBy(zone, a))
        w = w.withColumn("weight", F.when(total > 0, F.col("weight") * F.coalesce("__t", F.lit(zero_marginal)) / total).otherwise(0.0)).drop("__z", "__s", "__t")
    return w


def fit(seed: DataFrame, targets: DataFrame, attributes: Sequence[str], zone: str = "zone_id", sweeps: int | None = None, tolerance: float = 1e-5, max_sweeps: int = 1000, zero_marginal: float = 0.0, check_every: int = 5, max_zones: int = 100_000) -> DataFrame:
    """(zone, attributes, weight) fitted to long targets (zone, att, state, value).

    ``seed`` has a ``weight`` and may have the zone; without it every zone
    starts from the whole seed (the list of zones, ``max_zones`` at most, is what
    is exploded, not the seed). With ``sweeps`` that many are made in one plan;
    else until no weight of any zone moves by more than ``tolerance``. Lineage
    is cut every ``check_every`` sweeps.
    """
    atts = list(attributes)
    if zone not in seed.columns:
        zones = [r[0] for r in targets.select(zone).distinct().orderBy(zone).limit(max_zones + 1).collect()]
        if len(zones) > max_zones:
            raise ValueError(f"more than {max_zones} zones share one seed: give it a zone column")
        seed = seed.withColumn(zone, F.explode(F.lit(zones)) if zones else F.lit(None).cast(targets.schema[zone].dataType)).where(F.lit(bool(zones)))
    w = seed.select(zone, *atts, F.col("weight").cast("double").alias("weight"))
    if sweeps is not None:
        for _ in range(sweeps):
            w = sweep(w, targets, atts, zone, zero_marginal)
        return w
    w, done = cut(w), 0
    while done < max_sweeps:
        before = w.withColumnRenamed("weight", "__b")
        for _ in range(min(check_every, max_sweeps - done)):
            w = sweep(w, targets, atts, zone, zero_marginal)
        w, done = cut(w), done + check_every
        if (w.join(before, [zone, *atts]).agg(F.max(F.abs(F.col("weight") - F.col("__b")))).collect()[0][0] or 0.0) <= tolerance:
            break
    return w


def fit_joint(spark, states: Mapping[str, Sequence[str]], seed: DataFrame, targets: DataFrame, zone: str = "zone_id", zero_marginal: float = 0.01, zero_cell: float = 0.001, **how) -> DataFrame:
    """Fit over the full product of states, zero cells and zero marginals replaced before scaling."""
    joint = seeded(joint_states(spark, states), seed, list(states), zero_cell)
    return fit(joint, targets, list(states), zone, zero_marginal=zero_marginal, **how)
