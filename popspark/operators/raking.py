"""Fitting to a table of controls, whose conditions may overlap, and what a fit is worth at each sampling rate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..durable import cut
from ..functions.attributes import control_expression
from . import ipf
from .condense import marginals
from .ordered import numbered
from .sampling import keyed

#: The weight of a combination that the whole population has and the sample has not; fixed value.
UNSEEN = 1e-25


def labelled(seed: DataFrame, controls: Sequence[Mapping[str, str]]) -> DataFrame:
    """``seed`` with a column for each attribute of a control table: the state of the last control whose expression holds.

    A control has ``att``, ``state`` and ``expression`` over the seed's columns; a
    row for which none of an attribute's expressions holds has no state of it.
    """
    last: dict[str, Column] = {}
    for c in controls:
        state = F.when(control_expression(c["expression"]), F.lit(c["state"]))
        last[c["att"]] = F.coalesce(state, last[c["att"]]) if c["att"] in last else state
    return seed.withColumns(last)


def control_targets(census: DataFrame, controls: Sequence[Mapping[str, str]], zone: str = "zone_id") -> DataFrame:
    """(zone, att, state, value) from a census with a column ``control_field`` for each control."""
    cells = [F.struct(F.lit(c["att"]).alias("att"), F.lit(c["state"]).alias("state"), F.col(c["control_field"]).cast("double").alias("value")) for c in controls]
    return census.select(zone, F.explode(F.array(*cells)).alias("c")).groupBy(zone, "c.att", "c.state").agg(F.sum("c.value").alias("value"))


def fit_controls(seed: DataFrame, census: DataFrame, controls: Sequence[Mapping[str, str]], zone: str = "zone_id", seed_table: str = "households", **how) -> DataFrame:
    """(zone, attributes, weight): each zone's own seed rows fitted to its census by the controls of one seed table.

    Rows without a state of some attribute are left out, as is a zone's target
    for a state that its rows lack. ``how`` goes to ``ipf.fit``.
    """
    some = [c for c in controls if c.get("seed_table", seed_table) == seed_table]
    atts = list(dict.fromkeys(c["att"] for c in some))
    cells = labelled(seed, some).na.drop(subset=atts).groupBy(zone, *atts).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return ipf.fit(cells, control_targets(census, some, zone), atts, zone, **how)


def rake(rows: DataFrame, controls: Sequence[tuple[str, str]], targets: DataFrame, zone: str = "zone_id", sweeps: int = 10, cut_every: int = 5) -> DataFrame:
    """``rows`` (zone, weight, ...) with weights scaled to each control of (name, expression) in turn, ``sweeps`` times.

    Controls may overlap: a row is in all whose expression holds. ``targets`` are
    (zone, control, value); a control without a target in a zone, or without a
    row or weight there, changes nothing. Zones are shuffled once, and a control
    is one sum over the zone's rows; targets travel as one array a row.
    """
    names = [n for n, _ in controls]
    wanted = targets.where(F.col("control").isin(names)).groupBy(zone).agg(F.map_from_entries(F.collect_list(F.struct("control", F.col("value").cast("double")))).alias("__m"))
    wanted = wanted.select(F.col(zone).alias("__z"), F.array(*[F.element_at("__m", F.lit(n)) for n in names]).alias("__goal"))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    holds = [control_expression(e) for _, e in controls]
    d = rows.withColumn("__in", F.array(*holds)).join(wanted, F.col(zone).eqNullSafe(F.col("__z")), "left").drop("__z")
    d = d.withColumn("weight", F.col("weight").cast("double")).repartition(n, zone)
    of_zone = W.partitionBy(zone)
    for k in range(sweeps):
        for i in range(len(names)):
            inside = F.get("__in", F.lit(i))
            d = d.withColumn("__s", F.sum(F.when(inside, F.col("weight"))).over(of_zone))
            goal = F.get("__goal", F.lit(i))
            d = d.withColumn("weight", F.when(inside & (F.col("__s") > 0) & goal.isNotNull(), F.col("weight") * goal / F.col("__s")).otherwise(F.col("weight"))).drop("__s")
        if (k + 1) % cut_every == 0:
            d = cut(d)
    return d.drop("__in", "__goal")


def shuffled_heads(full: DataFrame, rates: Sequence[float], keys: Sequence[str], seed: object = 0) -> DataFrame:
    """``full`` once for each rate (``rate``) in whose head of round-down(rate * rows) a row falls, in keyed order."""
    d, n = numbered(full.withColumn("__o", keyed(seed, *keys)), ["__o", *keys], "__n")
    heads = F.array(*[F.struct(F.lit(float(r)).alias("rate"), F.lit(int(r * n + 1e-9)).alias("upto")) for r in rates])
    return d.withColumn("__r", F.explode(F.filter(heads, lambda h: h["upto"] >= F.col("__n")))).withColumn("rate", F.col("__r.rate")).drop("__o", "__n", "__r")


def fit_by_rate(full: DataFrame, attributes: Sequence[str], rates: Sequence[float], keys: Sequence[str], seed: object = 0, **how) -> DataFrame:
    """(rate, attributes, weight): the joint table of each rate's sample fitted to the whole population's marginals.

    Combinations that the population has and the sample has not weigh ``UNSEEN``.
    All rates are fitted in one plan, each as a zone.
    """
    atts = list(attributes)
    rates = [float(r) for r in rates]
    each = F.explode(F.array(*[F.lit(r) for r in rates])).alias("rate")
    cells = full.groupBy(*atts).count().select(*atts).select("*", each)
    got = shuffled_heads(full, rates, keys, seed).groupBy("rate", *atts).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    joint = cells.join(got, ["rate", *atts], "left").withColumn("weight", F.coalesce("weight", F.lit(UNSEEN)))
    goals = marginals(full.withColumn("__all", F.lit(1)), "__all", atts).select("att", "state", "value", each)
    return ipf.fit(joint, goals, atts, "rate", **how)


def errors_by_rate(full: DataFrame, fitted: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(rate, rmse, srmse) of rounded weights against the population: over all its marginals, and over its joint table.

    The joint error is the root of the squared differences of shares times the
    number of combinations.
    """
    atts = list(attributes)
    whole = fitted.select("rate", *atts, F.bround(F.round("weight", 6), 0).alias("n"))
    cells = full.groupBy(*atts).agg(F.count(F.lit(1)).cast("double").alias("m"))
    total = cells.agg(F.sum("m").alias("__all"))
    sums = whole.groupBy("rate").agg(F.sum("n").alias("__n"))
    j = whole.join(cells, atts).join(F.broadcast(total)).join(sums, "rate")
    joint = j.groupBy("rate").agg(F.sqrt(F.sum(F.pow(F.col("n") / F.col("__n") - F.col("m") / F.col("__all"), F.lit(2))) * F.count(F.lit(1))).alias("srmse"))
    one = lambda d, v: d.select(*([c for c in ("rate",) if c in d.columns]), F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).alias("state")) for a in atts])).alias("c"), v)
    want = one(cells, "m").groupBy("c.att", "c.state").agg(F.sum("m").alias("want"))
    got = one(whole, "n").groupBy("rate", "c.att", "c.state").agg(F.sum("n").alias("got"))
    marg = got.join(want, ["att", "state"]).groupBy("rate").agg(F.sqrt(F.avg(F.pow(F.col("got") - F.col("want"), F.lit(2)))).alias("rmse"))
    return marg.join(joint, "rate").select("rate", "rmse", "srmse")
