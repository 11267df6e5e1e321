"""Inference in discrete networks with evidence on any attribute: exact factors, and Gibbs chains.

Forward sampling with evidence held moves only what lies below it. Here evidence
moves its parents as well: by variable elimination, whose factors are tables
(attributes, p) that are joined, multiplied and summed, and by Gibbs sweeps, in
which each attribute is drawn given its Markov blanket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..durable import cut
from .bayes import Network, conditional, sample, topological
from .ipf import joint_states
from .sampling import draws_for, uniform, weighted_draws

States = Mapping[str, Sequence[str]]


def complete(df: DataFrame, net: Network, states: States, weight: str | None = None, pseudo: float = 1.0) -> dict[str, DataFrame]:
    """(parents, child, p) over all combinations of states; parents that never occur have the prior alone, an even one."""
    out = {}
    for a, parents in net.items():
        grid = joint_states(df.sparkSession, {v: states[v] for v in [*parents, a]})
        known = conditional(df, a, list(parents), states[a], weight, pseudo)
        out[a] = grid.join(known, [*parents, a], "left").withColumn("p", F.coalesce("p", F.lit(1 / len(states[a]))))
    return out


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two factors that share an attribute, or one of which has none."""
    shared = [c for c in left.columns if c in right.columns and c != "p"]
    r = right.withColumnRenamed("p", "__q")
    joined = left.join(r, shared) if shared else left.join(F.broadcast(r))
    return joined.withColumn("p", F.col("p") * F.col("__q")).drop("__q")


def eliminate(factors: Sequence[DataFrame], hidden: Sequence[str], cards: Mapping[str, int]) -> list[DataFrame]:
    """Factors without the ``hidden`` attributes, summed out one by one, the one with the smallest product first."""
    factors, todo = list(factors), set(hidden)
    atts = lambda f: [c for c in f.columns if c != "p"]
    while todo:
        size = lambda v: math.prod(cards[c] for c in {c for f in factors if v in f.columns for c in atts(f)})
        v = min(sorted(todo), key=size)
        todo.remove(v)
        with_v = [f for f in factors if v in f.columns]
        factors = [f for f in factors if v not in f.columns]
        if not with_v:
            continue
        f = with_v[0]
        for g in with_v[1:]:
            f = product(f, g)
        factors.append(f.groupBy(*[c for c in atts(f) if c != v]).agg(F.sum("p").alias("p")))
    return factors


def ancestors(net: Network, of: Sequence[str]) -> set[str]:
    found, todo = set(), list(of)
    while todo:
        if (a := todo.pop()) not in found:
            found.add(a)
            todo += net[a]
    return found


def posterior(evidence: DataFrame, net: Network, cpds: Mapping[str, DataFrame], targets: Sequence[str], states: States) -> DataFrame:
    """(evidence attributes, targets, p): the targets' joint distribution for each combination of evidence.

    Only combinations that occur are carried along: they cut down the first
    factor that has their attributes. A combination of probability 0 gives no
    row; attributes that are no ancestors of evidence or targets play no part.
    """
    given = [c for c in evidence.columns if c in net]
    seen = evidence.select(*given).distinct()
    part = ancestors(net, [*given, *targets])
    factors = []
    for a in topological(net):
        if a in part:
            f = cpds[a].select(*net[a], a, "p")
            here = [c for c in given if c in f.columns]
            factors.append(f.join(seen.select(*here).distinct(), here, "left_semi") if here else f)
    cards = {a: len(states[a]) for a in part}
    rest = eliminate(factors, [a for a in part if a not in given and a not in targets], cards)
    # factors that meet in an attribute are multiplied first, so that none is joined without a key that need not be
    out, rest = rest[0], rest[1:]
    while rest:
        f = max(rest, key=lambda f: len(set(f.columns) & set(out.columns)))
        rest.remove(f)
        out = product(out, f)
    out = out.join(seen, given, "left_semi") if given else out
    total = out.groupBy(*given).agg(F.sum("p").alias("__t")) if given else None
    if total is None:
        return product(out, out.agg((1 / F.sum("p")).alias("p")))
    return out.join(total, given).where(F.col("__t") > 0).select(*given, *targets, (F.col("p") / F.col("__t")).alias("p"))


def sample_posterior(evidence: DataFrame, net: Network, cpds: Mapping[str, DataFrame], states: States, keys: Sequence[str], count: str, targets: Sequence[str], seed: object = 0) -> DataFrame:
    """``count`` draws of the targets for each evidence row, from their exact joint posterior."""
    given = [c for c in evidence.columns if c in net]
    p = cut(posterior(evidence, net, cpds, targets, states))
    draws = draws_for(evidence, [*dict.fromkeys([*keys, *given])], count)
    return weighted_draws(draws, p, given, "p", list(targets), [*keys, "draw"], seed).select(*keys, "draw", *targets)


def blanket(net: Network, a: str) -> list[str]:
    """The attributes whose tables have ``a``: itself and its children."""
    return [a, *[c for c in net if a in net[c]]]


def tables(cpds: Mapping[str, DataFrame], net: Network, states: States, most: int = 200_000) -> dict[str, list[float]]:
    """Each table as one list in the order of its parents' and its own states; of more than ``most`` entries it is none and raises."""
    out = {}
    for a in net:
        names = [*net[a], a]
        size = math.prod(len(states[v]) for v in names)
        if size > most:
            raise ValueError(f"the table of {a} has {size} entries")
        code = [{s: i for i, s in enumerate(states[v])} for v in names]
        flat = [0.0] * size
        for r in cpds[a].select(*names, "p").collect():
            i = 0
            for v, c in zip(names, code):
                i = i * len(c) + c[r[v]]
            flat[i] = r["p"]
        out[a] = flat
    return out


def gibbs(evidence: DataFrame, net: Network, cpds: Mapping[str, DataFrame], states: States, keys: Sequence[str], count: str, sweeps: int = 20, seed: object = 0, cut_every: int = 5) -> DataFrame:
    """(keys, draw, all attributes): the state of ``count`` chains for each evidence row after ``sweeps`` sweeps.

    A chain starts from even draws and holds its evidence. A sweep draws each
    other attribute in the network's order by the product of its own and its
    children's probabilities under the chain's states; tables are arrays in one
    broadcast row, so a sweep is a projection. Draws are keyed by the chain,
    sweep and attribute.
    """
    given = [c for c in evidence.columns if c in net]
    free = [a for a in topological(net) if a not in given]
    flat = tables(cpds, net, states)
    spark = evidence.sparkSession
    names = list(net)
    one = F.broadcast(spark.createDataFrame([tuple(flat[a] for a in names)], ", ".join(f"__t{i} array<double>" for i in range(len(names)))))
    d = draws_for(evidence, [*dict.fromkeys([*keys, *given])], count)
    code = lambda a: (F.array_position(F.array(*[F.lit(s) for s in states[a]]), F.col(a)) - 1).cast("int")
    d = d.select(*keys, "draw", *[code(a).alias(f"__{a}") for a in given])
    d = d.where(" AND ".join(["true", *[f"`__{a}` >= 0" for a in given]]))
    key = [*keys, "draw"]
    d = d.select("*", *[F.floor(uniform(f"{seed}-start-{a}", *key) * len(states[a])).cast("int").alias(f"__{a}") for a in free])

    def weight(a: str, s: Column) -> Column:
        out = F.lit(1.0)
        for t in blanket(net, a):
            i = F.lit(0)
            for v in [*net[t], t]:
                i = i * len(states[v]) + (s if v == a else F.col(f"__{v}"))
            out = out * F.get(F.col(f"__t{names.index(t)}"), i)
        return out

    for n in range(sweeps):
        d = d.join(one)
        for a in free:
            weights = F.array(*[weight(a, F.lit(s)) for s in range(len(states[a]))])
            d = d.withColumn("__w", weights)
            d = d.withColumn("__x", uniform(f"{seed}-{n}-{a}", *key) * F.aggregate("__w", F.lit(0.0), lambda t, x: t + x))
            pick = F.aggregate("__w", F.struct(F.lit(0.0).alias("run"), F.lit(-1).alias("at"), F.lit(0).alias("i")), lambda t, x: F.struct((t["run"] + x).alias("run"), F.when((t["at"] < 0) & (t["run"] + x > F.col("__x")), t["i"]).otherwise(t["at"]).alias("at"), (t["i"] + 1).alias("i")))["at"]
            d = d.withColumn(f"__{a}", F.when(pick < 0, F.lit(len(states[a]) - 1)).otherwise(pick)).drop("__w", "__x")
        d = d.drop(*[f"__t{i}" for i in range(len(names))])
        if (n + 1) % cut_every == 0:
            d = cut(d)
    return d.select(*key, *[F.get(F.array(*[F.lit(s) for s in states[a]]), F.col(f"__{a}")).alias(a) for a in net if a not in keys])


def likelihood_weighted(evidence: DataFrame, net: Network, cpds: Mapping[str, DataFrame], keys: Sequence[str], count: str, seed: object = 0) -> DataFrame:
    """Forward samples with the evidence held and ``weight``, the probability of the evidence under each sample's states."""
    given = [c for c in evidence.columns if c in net]
    d = sample(draws_for(evidence, [*dict.fromkeys([*keys, *given])], count), net, cpds, [*keys, "draw"], seed).withColumn("weight", F.lit(1.0))
    for a in given:
        p = cpds[a].select(*net[a], a, F.col("p").alias("__p"))
        d = d.join(p, [*net[a], a], "left").withColumn("weight", F.col("weight") * F.coalesce("__p", F.lit(0.0))).drop("__p")
    return d


