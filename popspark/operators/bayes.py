"""Discrete Bayesian networks over attribute tables.

Sufficient statistics are grouped counts; structure search runs on the driver
over scores that come from one pass over the table; sampling is a chain of
weighted draws.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import numbered
from .sampling import draws_for, uniform

Network = dict[str, tuple[str, ...]]  #: parents of each attribute


def counts(df: DataFrame, child: str, parents: Sequence[str], weight: str | None = None) -> DataFrame:
    """(parents, child, n): the statistics of one family."""
    return df.groupBy(*parents, child).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("n"))


def state_names(df: DataFrame, attributes: Sequence[str]) -> dict[str, list[str]]:
    got = df.agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in attributes]).collect()[0]
    return {a: list(got[a]) for a in attributes}


def independent_prior(marg: DataFrame, child: str, parents: Sequence[str], strength: float = 1.0) -> DataFrame:
    """(parents, child, prior): products of the marginal shares of (att, state, value), times ``strength``."""
    out = None
    for a in [*parents, child]:
        one = marg.where(F.col("att") == a)
        share = one.select(F.col("state").alias(a), (F.col("value") / F.sum("value").over(W.partitionBy())).alias(f"__{a}"))
        out = share if out is None else out.join(F.broadcast(share))
    product: Column = F.lit(strength)
    for a in [*parents, child]:
        product = product * F.col(f"__{a}")
    return out.select(*parents, child, product.alias("prior"))


def conditional(df: DataFrame, child: str, parents: Sequence[str], states: Sequence[str], weight: str | None = None, pseudo: float = 1.0, prior: DataFrame | None = None) -> DataFrame:
    """(parents, child, p): Dirichlet posterior means over the parent combinations that occur.

    ``pseudo`` is added to every cell; with ``prior`` its cells are added instead.
    """
    n = counts(df, child, parents, weight)
    rows = n.select(*parents).distinct() if parents else df.sparkSession.range(1).select()
    grid = rows.withColumn(child, F.explode(F.array(*[F.lit(s) for s in states])))
    g = grid.join(n, [*parents, child], "left")
    if prior is not None:
        g = g.join(prior, [*parents, child], "left")
    value = F.coalesce("n", F.lit(0.0)) + (F.coalesce("prior", F.lit(0.0)) if prior is not None else F.lit(pseudo))
    total = F.sum("__v").over(W.partitionBy(*parents))
    return g.withColumn("__v", value).select(*parents, child, F.when(total > 0, F.col("__v") / total).otherwise(1 / len(states)).alias("p"))


def bic(df: DataFrame, child: str, parents: Sequence[str], cards: Mapping[str, int], weight: str | None = None) -> DataFrame:
    """One row: the family's log-likelihood less half the parameters times log n (Schwarz, 1978)."""
    n = counts(df, child, parents, weight)
    total = F.sum("n").over(W.partitionBy(*parents))
    params = (cards[child] - 1) * math.prod(cards[p] for p in parents)
    ll = n.withColumn("__t", total).agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("__t"))).alias("ll"), F.sum("n").alias("all"))
    return ll.select((F.col("ll") - 0.5 * params * F.log("all")).alias("bic"))


def count_sums(df: DataFrame, attributes: Sequence[str], size: int, weight: str | None = None) -> DataFrame:
    """(atts, e, n, cells): for every subset of up to ``size`` attributes, the sum of c log c over its cells' counts c, their sum and number.

    A family's log-likelihood is e(child and parents) - e(parents), so this is
    all that any score needs. The table is read once: condensed to its distinct
    combinations, these grouped by all subsets at once, the cells summed up. A
    null is a state.
    """
    atts = list(attributes)
    subsets = [c for k in range(min(size, len(atts)) + 1) for c in combinations(atts, k)]
    c = (F.sum(weight) if weight else F.count(F.lit(1))).cast("double")
    cells = df.groupBy(*atts).agg(c.alias("__c")).groupingSets([[F.col(a) for a in s] for s in subsets], *[F.col(a) for a in atts])
    cells = cells.agg(F.sum("__c").alias("__c"), F.grouping_id().alias("__id"))
    # a bit of the id is set where an attribute is left out, the first attribute's being the highest
    names = F.filter(F.array(*[F.when(F.col("__id").bitwiseAND(1 << (len(atts) - 1 - i)) == 0, F.lit(a)) for i, a in enumerate(atts)]), lambda x: x.isNotNull())
    sums = cells.where("__c > 0").groupBy("__id").agg(F.sum(F.col("__c") * F.log("__c")).alias("e"), F.sum("__c").alias("n"), F.count(F.lit(1)).alias("cells"))
    return sums.select(names.alias("atts"), "e", "n", "cells")


class Scores:
    """BIC of any family from ``count_sums``, which has one row a subset of attributes."""

    def __init__(self, df: DataFrame, attributes: Sequence[str], max_parents: int, weight: str | None = None):
        rows = {tuple(sorted(r["atts"])): r for r in count_sums(df, attributes, max_parents + 1, weight).collect()}
        self.e = {k: r["e"] for k, r in rows.items()}
        self.cards = {k[0]: r["cells"] for k, r in rows.items() if len(k) == 1}
        self.n = max((r["n"] for r in rows.values()), default=0.0)

    def __call__(self, child: str, parents: Sequence[str]) -> float:
        params = (self.cards[child] - 1) * math.prod(self.cards[p] for p in parents)
        return self.e[tuple(sorted([child, *parents]))] - self.e[tuple(sorted(parents))] - 0.5 * params * math.log(self.n)


def family_scores(df: DataFrame, attributes: Sequence[str], max_parents: int, weight: str | None = None) -> DataFrame:
    """(child, parents, bic) of every family of up to ``max_parents`` parents."""
    atts, of = list(attributes), Scores(df, attributes, max_parents, weight)
    rows = [(c, ",".join(p), of(c, p)) for c in atts if c in of.cards for k in range(max_parents + 1) for p in combinations(sorted(set(atts) - {c}), k)]
    return df.sparkSession.createDataFrame(rows, "child string, parents string, bic double")


def learn_structure(df: DataFrame, attributes: Sequence[str], max_parents: int = 3, max_steps: int = 200, score: Callable[[str, tuple[str, ...]], float] | None = None, weight: str | None = None) -> Network:
    """Hill climbing by adding, deleting and reversing edges; equal gains go by name. ``weight``: a column of counts.

    The table is read once, whatever the number of steps and families.
    """
    atts = list(attributes)
    known: dict[tuple[str, tuple[str, ...]], float] = {}
    if score is None:
        score = Scores(df, atts, max_parents, weight)

    def of(child: str, parents: tuple[str, ...]) -> float:
        key = (child, tuple(sorted(parents)))
        if key not in known:
            known[key] = score(*key)
        return known[key]

    net: Network = {a: () for a in atts}

    def reaches(a: str, b: str, net: Network) -> bool:
        """Whether a is an ancestor of b."""
        todo, seen = [b], set()
        while todo:
            for p in net[todo.pop()]:
                if p == a:
                    return True
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return False

    for _ in range(max_steps):
        best, change = 1e-9, None
        for child in atts:
            for parent in atts:
                if parent == child:
                    continue
                now = net[child]
                if parent in now:
                    without = tuple(p for p in now if p != parent)
                    gain = of(child, without) - of(child, now)
                    if gain > best:
                        best, change = gain, {child: without}
                    less = {**net, child: without}
                    if len(net[parent]) < max_parents and not reaches(parent, child, less):
                        back = (*net[parent], child)
                        gain += of(parent, back) - of(parent, net[parent])
                        if gain > best:
                            best, change = gain, {child: without, parent: back}
                elif len(now) < max_parents and not reaches(child, parent, net):
                    gain = of(child, (*now, parent)) - of(child, now)
                    if gain > best:
                        best, change = gain, {child: (*now, parent)}
        if change is None:
            return net
        net = {**net, **change}
    return net


def topological(net: Network) -> list[str]:
    out: list[str] = []
    while len(out) < len(net):
        ready = sorted(a for a in net if a not in out and all(p in out for p in net[a]))
        if not ready:
            raise ValueError("the network has a cycle")
        out += ready
    return out


def learn_parameters(df: DataFrame, net: Network, weight: str | None = None, pseudo: float = 1.0) -> dict[str, DataFrame]:
    states = state_names(df, list(net))
    return {a: conditional(df, a, net[a], states[a], weight, pseudo) for a in net}


def extend(rows: DataFrame, cpd: DataFrame, child: str, parents: Sequence[str], keys: Sequence[str], seed: object) -> DataFrame:
    """``rows`` with a drawn state of ``child``; a parent combination without a distribution takes the mean one."""
    parents = list(parents)
    up = W.partitionBy(*parents).orderBy(child).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = cpd.withColumn("hi", F.sum("p").over(up)).groupBy(*parents).agg(F.array_sort(F.collect_list(F.struct("hi", F.col(child).alias("s")))).alias("__cdf"))
    mean = cpd.groupBy(child).agg(F.avg("p").alias("p")).withColumn("hi", F.sum("p").over(W.orderBy(child).rowsBetween(W.unboundedPreceding, W.currentRow))).agg(F.array_sort(F.collect_list(F.struct("hi", F.col(child).alias("s")))).alias("__mean"))
    r = rows.join(steps, parents, "left") if parents else rows.join(F.broadcast(steps))
    r = r.join(F.broadcast(mean))
    cdf = F.coalesce("__cdf", "__mean")
    u = uniform(f"{seed}-{child}", *keys)
    hit = F.filter(cdf, lambda x: x["hi"] > u)
    state = F.coalesce(F.get(hit, F.lit(0))["s"], F.element_at(cdf, -1)["s"])
    return r.withColumn(child, state).drop("__cdf", "__mean")


def sample(rows: DataFrame, net: Network, cpds: Mapping[str, DataFrame], keys: Sequence[str], seed: object = 0) -> DataFrame:
    """Forward sampling of every attribute that ``rows`` lacks; those that it has are held as evidence."""
    for a in topological(net):
        if a not in rows.columns:
            rows = extend(rows, cpds[a], a, net[a], keys, seed)
    return rows


def forward_pool(spark, n: int, net: Network, cpds: Mapping[str, DataFrame], seed: object = 0, id_col: str = "id") -> DataFrame:
    return sample(spark.range(n).withColumnRenamed("id", id_col), net, cpds, [id_col], seed)


def rejection_pool(spark, n: int, net: Network, cpds: Mapping[str, DataFrame], accept: Column, seed: int = 0, rounds: int = 20) -> DataFrame:
    """n forward samples that meet a condition, topped up by further rounds of numbered samples."""
    size, out, got = n, None, 0
    for r in range(rounds):
        ids = spark.range(r * (1 << 40), r * (1 << 40) + size)
        more = sample(ids, net, cpds, ["id"], seed).where(accept)
        out = more if out is None else out.unionByName(more)
        got = out.count()
        if got >= n:
            d, _ = numbered(out, ["id"], "__n")
            return d.where(F.col("__n") <= n).drop("__n")
        size = int((n - got) * max(1.5, size / max(1, got) * 1.2)) + 10
    raise ValueError(f"{got} of {n} samples met the condition after {rounds} rounds")


def sample_evidence(evidence: DataFrame, net: Network, cpds: Mapping[str, DataFrame], keys: Sequence[str], count: str, targets: Sequence[str], seed: object = 0) -> DataFrame:
    """``count`` samples for each evidence row with the evidence held."""
    atts = [c for c in evidence.columns if c in net]
    d = draws_for(evidence, [*dict.fromkeys([*keys, *atts])], count)
    return sample(d, net, cpds, [*keys, "draw"], seed).select(*keys, "draw", *targets)


def impute_zones(totals: DataFrame, syn: DataFrame, net: Network, cpds: Mapping[str, DataFrame], zone: str = "zone_id", seed: object = 0) -> DataFrame:
    """Samples for the zones that the population lacks, as many as their totals (zone, total)."""
    missing = totals.join(syn.select(zone).distinct(), zone, "left_anti")
    return sample(draws_for(missing, [zone], "total"), net, cpds, [zone, "draw"], seed).select(zone, *net)
