"""Iterative proportional updating of household weights (Ye et al., 2009), all zones in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..durable import cut
from .condense import marginals
from .sampling import largest_remainder

#: A target of 0 is this much, so that weights never vanish; fixed value.
LEAST = 1e-9


def incidence(households: DataFrame, persons: DataFrame, household: str, household_atts: Sequence[str], person_atts: Sequence[str]) -> DataFrame:
    """(household, level, att, state, freq): 1 for a household's own states, numbers of persons for theirs."""
    own = marginals(households, household, household_atts).withColumn("level", F.lit("household"))
    people = marginals(persons, household, person_atts).withColumn("level", F.lit("person"))
    return own.unionByName(people).select(household, "level", "att", "state", F.col("value").alias("freq"))


def constraints(incidence_rows: DataFrame, max_constraints: int = 5000) -> list[tuple[str, str, str]]:
    """The states that the sample has, by level, attribute and name: what one census table has as columns."""
    rows = incidence_rows.select("level", "att", F.coalesce("state", F.lit("")).alias("state")).distinct().orderBy("level", "att", "state").limit(max_constraints + 1).collect()
    if len(rows) > max_constraints:
        raise ValueError(f"more than {max_constraints} constraints")
    return [tuple(r) for r in rows]


def _wide(rows: DataFrame, key: str, states: Sequence[tuple[str, str, str]], value: str, out: str) -> DataFrame:
    """(key, out): an array of each constraint's value, 0 where there is none."""
    of = F.create_map(*[F.lit(x) for i, (a, b, c) in enumerate(states) for x in ("\x1f".join((a, b, c)), i)])
    at = F.get(F.transform(F.array(F.concat_ws("\x1f", "level", "att", F.coalesce("state", F.lit("")))), lambda k: F.element_at(of, k)), 0)
    known = rows.withColumn("__i", at).where(F.col("__i").isNotNull()).groupBy(key, "__i").agg(F.sum(F.col(value).cast("double")).alias("__v"))
    full = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("__m"))
    return full.select(key, F.transform(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda i: F.coalesce(F.element_at("__m", i), F.lit(0.0))).alias(out))


def one_pass(w: DataFrame, states: Sequence[tuple[str, str, str]], zone: str) -> DataFrame:
    """One update by every constraint in turn; a row stands for ``same`` households.

    A household has one state of an attribute of its own, so that attribute's
    constraints do not meet and are one step; numbers of persons are a step for
    each state. A step is the sum over its zone's rows, which stay where they are.
    """
    of_zone = W.partitionBy(zone)
    at = lambda c, i: F.get(F.col(c), F.lit(i))

    def scaled(w: DataFrame, some: list[int]) -> DataFrame:
        sums = {i: F.sum(F.col("weight") * F.col("same") * at("freq", i)).over(of_zone) for i in some}
        w = w.withColumns({f"__s{i}": s for i, s in sums.items()})
        factor = F.coalesce(*[F.when((at("freq", i) > 0) & (F.col(f"__s{i}") > 0), at("goal", i) / F.col(f"__s{i}")) for i in some], F.lit(1.0))
        return w.withColumn("weight", F.col("weight") * factor).drop(*[f"__s{i}" for i in some])

    own: dict[str, list[int]] = {}
    for i, (level, att, _) in enumerate(states):
        if level == "household":
            own.setdefault(att, []).append(i)
    for att in sorted(own):
        w = scaled(w, own[att])
    for i, (level, _, _) in enumerate(states):
        if level != "household":
            w = scaled(w, [i])
    return w


def fits(w: DataFrame, n: int, zone: str) -> DataFrame:
    """(zone, fit): the mean relative error of the constraints; sums are added up before they are shuffled."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    sums = w.groupBy(zone).agg(*[F.sum(F.col("weight") * F.col("same") * at("freq", i)).alias(f"__s{i}") for i in range(n)], F.first("goal").alias("goal"))
    error: Column = sum((F.abs(F.col(f"__s{i}") - at("goal", i)) / F.greatest(at("goal", i), F.lit(1.0)) for i in range(n)), F.lit(0.0))
    return sums.select(zone, (error / n).alias("fit"))


def run(incidence_rows: DataFrame, targets: DataFrame, household: str = "hhid", zone: str = "zone_id", iterations: int = 200, tolerance: float = 1e-6, check_every: int = 5) -> DataFrame:
    """(zone, household, weight, fit, iterations): weights of the sample households in every zone.

    ``targets`` are (zone, level, att, state, value); a state that the sample
    lacks has no constraint, one that a zone's targets lack a target of 0. All
    households of a zone begin alike, with its mean total of the household
    attributes. Passes go on, ``check_every`` in a plan, until no zone's mean
    relative error moves by more than ``tolerance`` from one check to the next
    or ``iterations`` are made; a zone keeps the weights of its best check.

    Households that are alike in all constraints begin and stay alike, so that
    the passes go over zones by kinds of households, each with the number of its
    households; these take their kind's weights at the end. Rows are shuffled by
    zone once; nothing but the constraints' names is collected.
    """
    states = constraints(incidence_rows)
    freq = cut(_wide(incidence_rows, household, states, "freq", "freq"))
    kinds = cut(freq.groupBy("freq").agg(F.count(F.lit(1)).alias("same")).withColumn("__kind", F.monotonically_increasing_id()))
    goal = _wide(targets, zone, states, "value", "__goal")
    zones = targets.select(zone).distinct().join(goal, zone, "left")
    goal = zones.select(zone, F.transform(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda i: F.greatest(F.coalesce(F.get("__goal", i), F.lit(0.0)), F.lit(LEAST))).alias("goal"))
    per_att = targets.where("level = 'household'").groupBy(zone, "att").agg(F.sum(F.col("value").cast("double")).alias("v")).groupBy(zone).agg(F.avg("v").alias("__homes"))
    every = freq.agg(F.count(F.lit(1)).alias("__n"))
    # each zone gets every kind: a join on a constant, as the result has all households
    both = goal.join(per_att, zone, "left").withColumn("__one", F.lit(1)).join(kinds.withColumn("__one", F.lit(1)), "__one").drop("__one").join(F.broadcast(every))
    start = F.greatest(F.coalesce("__homes", F.col("__n").cast("double")), F.lit(1.0)) / F.col("__n")
    n = max(1, int(incidence_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = both.select(zone, "__kind", "same", "freq", "goal", start.alias("weight")).repartition(n, zone)
    best = w.select(zone, "__kind", "weight", F.lit(float("inf")).alias("fit"), F.lit(0).alias("iterations"))
    done, before = 0, None
    while done < iterations:
        k = min(check_every, iterations - done)
        for _ in range(k):
            w = one_pass(w, states, zone)
        w, done = cut(w), done + k
        now = cut(fits(w, len(states), zone))
        step = w.join(now, zone).select(zone, "__kind", "weight", "fit", F.lit(done).alias("iterations"))
        if before is None:
            best = step
        else:
            old = best.select(zone, "__kind", *[F.col(c).alias(f"__{c}") for c in ("weight", "fit", "iterations")])
            keep = F.col("__fit") <= F.col("fit")
            best = step.join(old, [zone, "__kind"]).select(zone, "__kind", *[F.when(keep, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("weight", "fit", "iterations")])
            best = cut(best)
            moved = now.join(before.withColumnRenamed("fit", "__f"), zone).agg(F.max(F.abs(F.col("fit") - F.col("__f")))).first()[0]
            if (moved or 0.0) < tolerance:
                break
        before = now
    # a row for each kind, with its zones: no zone's rows meet in one task
    of_kind = best.groupBy("__kind").agg(F.collect_list(F.struct(zone, "weight", "fit", "iterations")).alias("__zones"))
    members = freq.join(kinds.select("freq", "__kind"), "freq").select(household, "__kind")
    return members.join(of_kind, "__kind").select(household, F.explode("__zones").alias("x")).select(f"x.{zone}", household, "x.weight", "x.fit", "x.iterations")


def synthesise(weights: DataFrame, household: str = "hhid", zone: str = "zone_id") -> DataFrame:
    """(zone, household, n): whole numbers of each sample household by largest remainder."""
    return largest_remainder(weights, "weight", [zone], [household]).where("n > 0").select(zone, household, "n")
