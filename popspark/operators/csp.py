"""Persons for households by relationship-constrained sampling from paired pools.

An edge such as Main-Spouse has a pool of observed pairs with counts. Every
level of a household draws its persons from the pairs whose source side matches
the person already there; a household that the pairs cannot serve falls back to
the next edge or is given back as impossible.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..durable import cut
from .bayes import conditional, learn_structure, sample, state_names
from .condense import condense
from .relations import RELATIONS, relation_counts
from .sampling import draws_for, keyed, uniform, weighted_draws

#: (source, target) in order of use; the deeper edges come before their fallback from Main.
EDGES = (("HH", "Main"), ("Main", "Spouse"), ("Main", "Child"), ("Main", "Parent"), ("Main", "Sibling"), ("Main", "Others"), ("Parent", "Grandparent"), ("Child", "Grandchild"), ("Main", "Grandparent"), ("Main", "Grandchild"))


def prefixed(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c not in keep})


def pool_pairs(households: DataFrame, persons: DataFrame, household_atts: Sequence[str], person_atts: Sequence[str], household: str = "hhid", with_counts: bool = True) -> dict[str, DataFrame]:
    """``Source-Target`` pools: attribute pairs of households and their persons, condensed.

    With ``with_counts`` the household edge also holds the numbers of relations.
    """
    numbers = relation_counts(persons, household)
    number_cols = [c for c in numbers.columns if c != household]
    sides = {r: prefixed(persons.where(F.col("relationship") == r).select(household, *person_atts), r, [household]) for r in RELATIONS}
    hh = prefixed(households.select(household, *household_atts), "HH", [household])
    out = {}
    for source, target in EDGES:
        left = (hh.join(numbers, household) if with_counts else hh) if source == "HH" else sides[source]
        pairs = left.join(sides[target], household)
        out[f"{source}-{target}"] = condense(pairs, [c for c in pairs.columns if c != household])
    return out


def filter_pairs(pairs: DataFrame, source_low: str, target_low: str, least_gap: int) -> DataFrame:
    """Pairs whose target's lower band end is at least ``least_gap`` under the source's (for ages), or at most equal (0, for incomes)."""
    return pairs.where(F.col(source_low).try_cast("int") - F.col(target_low).try_cast("int") >= least_gap)


def candidates(evidence: DataFrame, pairs: DataFrame, keys: Sequence[str], source_cols: Sequence[str], target_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates with the summed counts of all evidence rows of a household, households without any).

    Pairs are added up over their other columns first, such as numbers of
    relations: a household meets its target's combinations, not every row of the pool.
    """
    pairs = pairs.groupBy(*source_cols, *target_cols).agg(F.sum("count").alias("count"))
    c = evidence.join(pairs, list(source_cols)).groupBy(*keys, *target_cols).agg(F.sum("count").alias("count"))
    return c, evidence.select(*keys).distinct().join(c.select(*keys).distinct(), list(keys), "left_anti")


def household_relations(households: DataFrame, pairs: DataFrame, household: str, household_atts: Sequence[str], size: str, seed: object = 0, by: Sequence[str] = ()) -> DataFrame:
    """Households with numbers of relations that add up to their size, drawn from the pairs of their attributes.

    Only fitting numbers are candidates, which is the distribution of drawing
    until they fit. A household whose attributes allow none takes them from
    those of its size; without any it has one Main and else Others. Columns in
    ``by`` must match as well, always.
    """
    from ..functions.attributes import size_matches

    numbers = [f"n_{r}" for r in RELATIONS]
    cols = [*by, *[f"HH_{a}" for a in household_atts]]
    total = sum((F.col(n) for n in numbers), F.lit(0))
    ok = pairs.where(size_matches(F.col(f"HH_{size}"), total)).groupBy(*cols, *numbers).agg(F.sum("count").alias("count"))
    hh = households.withColumnsRenamed({a: f"HH_{a}" for a in household_atts})
    first = weighted_draws(hh, ok, cols, "count", numbers, [household], seed)
    rest = hh.join(first.select(household), household, "left_anti")
    by_size = ok.groupBy(*by, f"HH_{size}", *numbers).agg(F.sum("count").alias("count"))
    second = weighted_draws(rest, by_size, [*by, f"HH_{size}"], "count", numbers, [household], seed)
    bare = rest.join(second.select(household), household, "left_anti")
    n = F.coalesce(F.regexp_replace(f"HH_{size}", r"\+", "").try_cast("int"), F.lit(1))
    plain = bare.select("*", *[(F.lit(1) if r == "Main" else n - 1 if r == "Others" else F.lit(0)).cast("long").alias(f"n_{r}") for r in RELATIONS])
    keep = [household, *[c for c in hh.columns if c != household], *numbers]
    return first.select(*keep).unionByName(second.select(*keep)).unionByName(plain.select(*keep))


def sample_persons(households: DataFrame, pools: Mapping[str, DataFrame], household_atts: Sequence[str], person_atts: Sequence[str], household: str = "hhid", size: str = "hhsize", seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """(persons with their relationship, (household, relationship, n) that no pair could serve)."""
    return _sample(households, pools, household_atts, person_atts, household, size, seed, False)


def _sample(households: DataFrame, pools: Mapping[str, DataFrame], household_atts: Sequence[str], person_atts: Sequence[str], household: str, size: str, seed: object, again: bool, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``by``: columns of the households and of all pools that must match in every draw, such as the zone."""
    pools = {edge: cut(p) for edge, p in pools.items()}  # small, and read again and again
    numbers = cut(household_relations(households, pools["HH-Main"], household, household_atts, size, seed, by))
    source_cols = {"HH": [f"HH_{a}" for a in household_atts]}
    people: dict[str, DataFrame] = {}
    made: dict[str, DataFrame] = {"HH": numbers}
    options: dict[str, DataFrame] = {}
    for source, target in EDGES:
        pairs = pools.get(f"{source}-{target}")
        if pairs is None or source not in made:
            continue
        cols = source_cols.get(source, [f"{source}_{a}" for a in person_atts])
        target_cols = [f"{target}_{a}" for a in person_atts]
        want = numbers.select(household, *by, F.col(f"n_{target}").alias("__n")).where("__n > 0")
        if target in people:
            want = want.join(people[target].select(household).distinct(), household, "left_anti")
        if again and source in options:
            keyed_by = numbers.select(household, *by)
            known = [d.join(keyed_by, household) if by else d for d in (made[source], options[source])]
            new = redraw_parents(known[0], known[1], want, pairs, [*by, *cols], household, f"{seed}-{source}-{target}")[0]
            people[source] = made[source] = cut(new.drop(*by))
        evidence = made[source].select(household, *cols).join(want, household)
        found, _ = candidates(evidence, pairs, [household], [*by, *cols], target_cols)
        draws = draws_for(want, [household], "__n")
        got = weighted_draws(draws, found, [household], "count", target_cols, [household, "draw"], f"{seed}-{source}-{target}").select(household, *target_cols)
        got = cut(got)  # the next levels read it again and again
        people[target] = people[target].unionByName(got) if target in people else got
        made[target] = people[target]
        options[target] = options[target].unionByName(found) if target in options else found
    return _people(people, person_atts, numbers, household)


def sample_persons_bn(households: DataFrame, pools: Mapping[str, DataFrame], household_atts: Sequence[str], person_atts: Sequence[str], household: str = "hhid", size: str = "hhsize", seed: object = 0, pseudo: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """As ``sample_persons``, from one Bayesian network for each edge.

    An edge's network is learned from its pairs, by count: the target's
    attributes hang on the source's and on one another. Every person has a
    source person of the household, drawn by a keyed hash where there are
    several; numbers of relations fit the household's size beforehand.
    """
    pools = {edge: cut(p) for edge, p in pools.items()}  # small, and read again and again
    numbers = cut(household_relations(households, pools["HH-Main"], household, household_atts, size, seed))
    made, people = {"HH": numbers}, {}
    for source, target in EDGES:
        pairs = pools.get(f"{source}-{target}")
        if pairs is None or source not in made or pairs.isEmpty():
            continue
        cols = [f"HH_{a}" for a in household_atts] if source == "HH" else [f"{source}_{a}" for a in person_atts]
        goals = [f"{target}_{a}" for a in person_atts]
        pairs = cut(pairs.groupBy(*cols, *goals).agg(F.sum("count").alias("count")))
        net = learn_structure(pairs, [*cols, *goals], max_parents=2, weight="count")
        net = {a: net[a] if a in goals else () for a in net}  # what is given needs no parents
        cpds = {a: conditional(pairs, a, net[a], state_names(pairs, [a])[a], "count", pseudo) for a in goals}
        want = numbers.select(household, F.col(f"n_{target}").alias("__n")).where("__n > 0")
        if target in people:
            want = want.join(people[target].select(household).distinct(), household, "left_anti")
        draws = draws_for(want, [household], "__n").join(made[source].select(household, *cols), household)
        pick = W.partitionBy(household, "draw").orderBy(keyed(f"{seed}-{source}", household, "draw", *cols), *cols)
        draws = draws.withColumn("__k", F.row_number().over(pick)).where("__k = 1").drop("__k")
        got = sample(draws, {a: net[a] for a in goals} | {c: () for c in cols}, cpds, [household, "draw"], f"{seed}-{source}-{target}")
        got = cut(got.select(household, *goals))
        people[target] = people[target].unionByName(got) if target in people else got
        made[target] = people[target]
    return _people(people, person_atts, numbers, household)


def _people(people: Mapping[str, DataFrame], person_atts: Sequence[str], numbers: DataFrame, household: str) -> tuple[DataFrame, DataFrame]:
    """All relations' persons, and (household, relationship, n) of those that were wanted and are not there."""
    out, short = None, None
    for target, df in people.items():
        plain = df.select(household, *[F.col(f"{target}_{a}").alias(a) for a in person_atts], F.lit(target).alias("relationship"))
        out = plain if out is None else out.unionByName(plain)
        lost = numbers.select(household, F.lit(target).alias("relationship"), F.col(f"n_{target}").alias("n")).where("n > 0").join(df.select(household).distinct(), household, "left_anti")
        short = lost if short is None else short.unionByName(lost)
    return out, short


def run(households: DataFrame, pools: Mapping[str, DataFrame], household_atts: Sequence[str], person_atts: Sequence[str], household: str = "hhid", size: str = "hhsize", use_bn: bool = False, zone: str | None = None, zone_pools: Mapping[str, Mapping[str, DataFrame]] | None = None, retries: int = 0, seed: object = 0, backtrack: bool = False) -> tuple[DataFrame, DataFrame]:
    """Persons of all households by the way asked for: from pairs, from pairs with back-tracking (``retries`` of any number stand for it), or by networks; by zone where zones have pools.

    With ``zone_pools`` the households of a zone that has pools of its own take
    these, all others ``pools``. Pairs of all zones are drawn in one plan;
    networks are learned zone by zone.
    """

    def some(h: DataFrame, p: Mapping[str, DataFrame], seed: object) -> tuple[DataFrame, DataFrame]:
        if use_bn:
            return sample_persons_bn(h, p, household_atts, person_atts, household, size, seed)
        if backtrack or retries:
            return sample_with_backtracking(h, p, household_atts, person_atts, household, size, seed)
        return sample_persons(h, p, household_atts, person_atts, household, size, seed)

    if not zone_pools:
        return some(households, pools, seed)
    if not use_bn:
        # one plan for all zones: pools of all zones are one table with the zone's name, the rest has one of its own
        rest = "\x00"
        own = F.when(F.col(zone).cast("string").isin([str(z) for z in zone_pools]), F.col(zone).cast("string")).otherwise(F.lit(rest))
        merged = {}
        for edge in dict.fromkeys([*pools, *[e for p in zone_pools.values() for e in p]]):
            tables = [p[edge].withColumn("__zone", F.lit(str(z))) for z, p in [*zone_pools.items(), (rest, pools)] if edge in p]
            merged[edge] = reduce(lambda a, b: a.unionByName(b), tables)
        people, short = _sample(households.withColumn("__zone", own), merged, household_atts, person_atts, household, size, seed, backtrack or bool(retries), ["__zone"])
        return people, short
    parts = [some(households.where(F.col(zone) == z), p, f"{seed}-{z}") for z, p in zone_pools.items()]
    parts.append(some(households.where(~F.coalesce(F.col(zone).isin(list(zone_pools)), F.lit(False))), pools, seed))
    people, short = parts[0]
    for more, lost in parts[1:]:
        people, short = people.unionByName(more), short.unionByName(lost)
    return people, short


def redraw_parents(parents: DataFrame, found: DataFrame, wanted: DataFrame, pairs: DataFrame, cols: Sequence[str], household: str = "hhid", seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """(``parents`` that can serve, (household, tried, served) of the households drawn again).

    ``found`` are the parents' candidates (household, cols, count), ``wanted``
    the households that need a child from ``pairs`` by ``cols``. Where no parent
    of a wanting household has a pair, its parents are tried and found wrong:
    they leave the candidates, and others are drawn, by weight and without
    replacement, until one has a pair or none is left. Such draws in turn are a
    race of exponential times u ** (1 / count): the candidates in the order of
    their times, of which the first with a pair stays, further places going to
    those after it. A household without any candidate that serves keeps its
    parents. No round is repeated; a household's candidates meet in one window.
    """
    cols = list(cols)
    want = wanted.select(household).distinct()
    here = parents.join(want, household, "left_semi")
    ok = pairs.select(*cols).distinct().withColumn("__ok", F.lit(True))
    bad = here.join(ok, cols, "left").groupBy(household).agg(F.max(F.coalesce("__ok", F.lit(False))).alias("__any"), F.count(F.lit(1)).alias("__places")).where(~F.col("__any")).drop("__any")
    wrong = here.join(bad.select(household), household, "left_semi").select(household, *cols).distinct()
    left = found.join(bad, household).join(wrong, [household, *cols], "left_anti").join(ok, cols, "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    time = -F.log(F.greatest(uniform(f"{seed}-race", household, *cols), F.lit(1e-300))) / F.col("count")
    race = W.partitionBy(household).orderBy("__time", *cols)
    left = left.withColumn("__time", time).withColumn("__at", F.row_number().over(race))
    left = left.withColumn("__first", F.min(F.when(F.col("__ok"), F.col("__at"))).over(W.partitionBy(household)))
    new = left.where((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__first") + F.col("__places")))
    wrongs = wrong.groupBy(household).agg(F.count(F.lit(1)).alias("__wrong"))
    tried = left.groupBy(household).agg(F.min("__first").alias("__first"), F.count(F.lit(1)).alias("__all"))
    log = wrongs.join(tried, household, "left").select(household, (F.col("__wrong") + F.coalesce(F.col("__first") - 1, "__all", F.lit(0))).alias("tried"), F.col("__first").isNotNull().alias("served"))
    moved = new.select(household, *cols)
    out = parents.select(household, *cols).join(moved.select(household).distinct(), household, "left_anti").unionByName(moved)
    return out, log


def sample_with_backtracking(households: DataFrame, pools: Mapping[str, DataFrame], household_atts: Sequence[str], person_atts: Sequence[str], household: str = "hhid", size: str = "hhsize", seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """As ``sample_persons``, but where no pair serves a household its parents are drawn again among their untried candidates.

    Only the parent changes: persons drawn from it before stay, and a household's
    own attributes are never drawn again.
    """
    return _sample(households, pools, household_atts, person_atts, household, size, seed, True)


def arc_consistent(upper: DataFrame, lower: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Pairs of the upper edge whose target can be a source of the lower edge."""
    return upper.join(lower.select(*shared).distinct(), list(shared), "left_semi")


def number_persons(persons: DataFrame, household: str = "hhid") -> DataFrame:
    """A person number within each household, by relation and attributes."""
    order = [F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relationship")), *[c for c in persons.columns if c not in (household, "relationship")]]
    return persons.withColumn("person", F.row_number().over(W.partitionBy(household).orderBy(*order)))


def typed_households(pool: DataFrame, n: int, order: Sequence[str], size: str = "hhsize", weight: str = "count", seed: object = 0) -> DataFrame:
    """``n`` households with a type, whose types have the shares they have among the pool's possible households.

    The pool has numbers of relations (``n_Spouse``, ...) and a size: households
    whose members are not as many as the size says go first, then those whose
    type their size does not allow; the rest is drawn by weight within each type.
    """
    from ..functions.attributes import household_type, size_matches, type_allows_size
    from .sampling import balanced_types

    members = sum((F.col(f"n_{r}") for r in RELATIONS), F.lit(0))
    real = pool.where(size_matches(F.col(size), members)).withColumn("hh_type", household_type({r: F.col(f"n_{r}") for r in RELATIONS}))
    return balanced_types(real.where(type_allows_size(F.col("hh_type"), F.col(size))), "hh_type", n, weight, order, seed)
