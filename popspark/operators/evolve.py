"""Search over populations: evolution by crossover and resampling, and a tabular learner."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..durable import cut
from .bayes import Network, extend, forward_pool, learn_parameters, sample, topological
from .condense import condense, marginals, shares
from .ordered import numbered
from .sampling import keyed, sample_exact, uniform, weighted_draws


def crossover(a: DataFrame, b: DataFrame, keys: Sequence[str], seed: object = 0) -> DataFrame:
    """Half of each population's rows, by keyed order of ``keys``."""
    return sample_exact(a, 0.5, keys, f"{seed}-a").unionByName(sample_exact(b, 0.5, keys, f"{seed}-b"))


def mutate(pop: DataFrame, net: Network, cpds: Mapping[str, DataFrame], keep: Sequence[str], keys: Sequence[str], seed: object = 0) -> DataFrame:
    """Every attribute but ``keep`` drawn anew with those held as evidence."""
    return sample(pop.select(*keys, *keep), net, cpds, keys, seed).select(*pop.columns)


def evolve(start: Sequence[DataFrame], score: Callable[[DataFrame], float], breed: Callable[[DataFrame, DataFrame, int], DataFrame], generations: int, keep: int, seed: int = 0) -> list[tuple[float, DataFrame]]:
    """The ``keep`` populations of lowest score after so many generations of pairs of the best."""
    rng = random.Random(seed)
    pool = sorted(((score(p), i, p) for i, p in enumerate(start)), key=lambda x: x[:2])[:keep]
    n = len(start)
    for g in range(generations):
        for _ in range(len(pool)):
            a, b = rng.choice(pool)[2], rng.choice(pool)[2]
            child = cut(breed(a, b, n))
            pool.append((score(child), n, child))
            n += 1
        pool = sorted(pool, key=lambda x: x[:2])[:keep]
    return [(s, p) for s, _, p in pool]


def train_policy(counts: Sequence[tuple[tuple[str, ...], int]], attributes: Sequence[str], episodes: int = 2000, rate: float = 0.1, discount: float = 0.6, explore: float = 0.8, seed: int = 0) -> dict[tuple[str, ...], dict[str, float]]:
    """Values of the next state after each prefix of states, by Q-learning over condensed combinations.

    A step is worth the length of the prefix times the number of records that have it.
    """
    rng = random.Random(seed)
    matches: dict[tuple[str, ...], int] = {}
    for combo, n in counts:
        for k in range(1, len(combo) + 1):
            matches[combo[:k]] = matches.get(combo[:k], 0) + n
    options: dict[int, list[str]] = {k: sorted({c[k] for c, _ in counts}) for k in range(len(attributes))}
    q: dict[tuple[str, ...], dict[str, float]] = {}
    for _ in range(episodes):
        prefix: tuple[str, ...] = ()
        for k in range(len(attributes)):
            values = q.setdefault(prefix, {s: 0.0 for s in options[k]})
            s = rng.choice(options[k]) if rng.random() < explore else max(values, key=lambda x: (values[x], x))
            nxt = (*prefix, s)
            ahead = max(q[nxt].values(), default=0.0) if nxt in q else 0.0
            values[s] += rate * (len(nxt) * matches.get(nxt, 0) + discount * ahead - values[s])
            prefix = nxt
    return q


def sample_policy(spark, n: int, q: Mapping[tuple[str, ...], Mapping[str, float]], attributes: Sequence[str], seed: object = 0) -> DataFrame:
    """n rows of states drawn in turn in proportion to their values."""
    rows = spark.range(n)
    for k, att in enumerate(attributes):
        table = [(*p, s, v) for p, values in q.items() if len(p) == k for s, v in values.items() if v > 0]
        before = list(attributes[:k])
        schema = ", ".join([*(f"`{a}` string" for a in before), f"`{att}` string", "w double"])
        rows = weighted_draws(rows, spark.createDataFrame(table, schema), before, "w", [att], ["id"], f"{seed}-{att}").drop("w")
    return rows


def categorical_generator(seed_rows: DataFrame, attributes: Sequence[str], n: int, seed: object = 0) -> DataFrame:
    """The interface of a generative model with the seed's joint distribution as the plain model."""
    return naive_synthesis(condense(seed_rows, attributes), n, attributes, seed)


def naive_synthesis(condensed: DataFrame, n: int, attributes: Sequence[str], seed: object = 0) -> DataFrame:
    """n rows drawn by count from a condensed table."""
    return weighted_draws(condensed.sparkSession.range(n), condensed, [], "count", list(attributes), ["id"], seed).select("id", *attributes)


def shuffled_head(df: DataFrame, rate: float, keys: Sequence[str], seed: object = 0) -> DataFrame:
    """The first floor(rate * n) rows of the table in keyed order."""
    d, n = numbered(df.withColumn("__o", keyed(seed, *keys)), ["__o", *keys], "__n")
    return d.where(F.col("__n") <= int(n * rate)).drop("__o", "__n")


def best_attributes(syn: DataFrame, census: DataFrame, attributes: Sequence[str], n: int) -> DataFrame:
    """(att, bits): the n attributes whose synthetic shares the census shares tell in the fewest bits; ties by name.

    The synthetic shares are the target, so that a state which the population
    lacks costs nothing; one that the census lacks makes the bits infinite.
    """
    return attribute_bits(syn.withColumn("__pop", F.lit(0)), census, attributes, "__pop").orderBy("bits", "att").limit(n).select("att", "bits")


def attribute_bits(pops: DataFrame, census: DataFrame, attributes: Sequence[str], pop: str = "pop") -> DataFrame:
    """(pop, att, bits) of many populations in one table, each against the same census rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in attributes])).alias("x")
    p = shares(pops.select(pop, cells).select(pop, "x.*"), ["state"], within=[pop, "att"]).withColumnRenamed("share", "p")
    q = shares(census.select(cells).select("x.*"), ["state"], within=["att"]).withColumnRenamed("share", "q")
    bits = F.when(F.col("q").isNull(), F.lit(float("inf"))).otherwise(-F.col("p") * F.log2("q"))
    return p.join(q, ["att", "state"], "left").groupBy(pop, "att").agg(F.sum(bits).alias("bits"))


def population_scores(pops: DataFrame, census: DataFrame, attributes: Sequence[str], pop: str = "pop") -> DataFrame:
    """(pop, score): root mean squared difference of each population's marginal counts from the census' (att, state, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).cast("string").alias("state")) for a in attributes])).alias("x")
    got = pops.select(pop, cells).groupBy(pop, "x.att", "x.state").agg(F.count(F.lit(1)).alias("n"))
    goals = census.agg(F.collect_list(F.struct("att", "state", F.col("value").alias("w"))).alias("__g"))  # one row: the marginals' states
    want = pops.select(pop).distinct().join(F.broadcast(goals)).select(pop, F.explode("__g").alias("g")).select(pop, "g.*")
    j = want.join(got, [pop, "att", "state"], "full")
    d = F.coalesce("n", F.lit(0)) - F.coalesce("w", F.lit(0))
    return j.groupBy(pop).agg(F.sqrt(F.avg(d * d)).alias("score"))


def best_solutions(scores: DataFrame, n: int, ties: Sequence[str] = ("pop",)) -> DataFrame:
    """The ``n`` rows of least score, ties by name."""
    return scores.orderBy("score", *ties).limit(n)


def chosen_parents(scores: DataFrame, pairs: int, seed: object = 0, pop: str = "pop") -> DataFrame:
    """(pair, a, b): two draws for each pair among the populations, by the softmax of minus their scores."""
    low = scores.agg(F.min("score").alias("__low"))
    w = scores.join(F.broadcast(low)).select(F.col(pop).alias("__p"), F.greatest(F.exp(F.col("__low") - F.col("score")), F.lit(1e-12)).alias("__w"))
    sides = scores.sparkSession.range(pairs).select(F.col("id").alias("pair"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    got = weighted_draws(sides, w, [], "__w", ["__p"], ["pair", "side"], seed)
    return got.groupBy("pair").agg(F.max(F.when(F.col("side") == "a", F.col("__p"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("__p"))).alias("b"))


def crossed(pops: DataFrame, parents: DataFrame, attributes: Sequence[str], rate: float = 0.4, seed: object = 0, pop: str = "pop", row: str = "row") -> DataFrame:
    """(pair, child, row, attributes): two children a pair, who swap the rows that a keyed number below ``rate`` picks.

    Rows are numbered alike in all populations, so that children keep their
    parents' size. One join of the populations with the pairs, by population.
    """
    atts = list(attributes)
    sides = parents.select("pair", F.explode(F.array(F.struct(F.col("a").alias("p"), F.lit(0).alias("side")), F.struct(F.col("b").alias("p"), F.lit(1).alias("side")))).alias("x")).select("pair", "x.*")
    j = pops.join(F.broadcast(sides), F.col(pop) == F.col("p"))  # two rows a pair
    swap = uniform(seed, "pair", row) < rate
    return j.select("pair", F.when(swap, 1 - F.col("side")).otherwise(F.col("side")).alias("child"), row, *atts)


def mutated(pops: DataFrame, census: DataFrame, net: Network, cpds: Mapping[str, DataFrame], keep: int = 3, rate: float = 0.25, seed: object = 0, pop: str = "pop", row: str = "row") -> DataFrame:
    """``pops`` with the rows below ``rate`` drawn anew but for each population's ``keep`` best attributes, which are evidence."""
    atts = [a for a in pops.columns if a in net]
    order = W.partitionBy(pop).orderBy("bits", "att")
    best = attribute_bits(pops, census, atts, pop).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= keep).groupBy(pop).agg(F.collect_list("att").alias("__keep"))
    d = pops.join(F.broadcast(best), pop).withColumn("__go", uniform(f"{seed}-go", pop, row) < rate)  # one row a population
    for a in topological(net):
        if a in atts:
            d = extend(d.withColumnRenamed(a, "__old"), cpds[a], a, net[a], [pop, row], seed)
            d = d.withColumn(a, F.when(F.col("__go") & ~F.array_contains("__keep", a), F.col(a)).otherwise(F.col("__old"))).drop("__old")
    return d.select(*pops.columns)


def evolve_table(pops: DataFrame, census: DataFrame, net: Network, cpds: Mapping[str, DataFrame], generations: int, keep: int, rate: float = 0.4, change: float = 0.25, keep_atts: int = 1, seed: object = 0, pop: str = "pop", row: str = "row") -> tuple[DataFrame, DataFrame]:
    """((pop, row, attributes) of the ``keep`` best populations, (generation, pop, score) of all that were scored).

    All populations are one table. A generation breeds ``keep`` pairs and a
    mutant of each parent, scores old and new in one job and keeps the best;
    populations are numbered in turn, ties in score going to the older.
    """
    atts = [a for a in pops.columns if a in net]
    goals = marginals(census.withColumn("__z", F.lit(0)), "__z", atts)
    now, log = cut(pops.select(F.col(pop).cast("long").alias(pop), row, *atts)), None
    top = now.agg(F.max(pop)).first()[0] or 0
    for g in range(generations + 1):
        scored = cut(population_scores(now, goals, atts, pop))
        entry = scored.select(F.lit(g).alias("generation"), pop, "score")
        log = entry if log is None else log.unionByName(entry)
        best = scored.orderBy("score", pop).limit(keep)
        now = now.join(F.broadcast(best.select(pop)), pop, "left_semi")
        if g == generations:
            break
        old = cut(now)
        pairs = cut(chosen_parents(best, keep, f"{seed}-{g}-pairs", pop))
        kids = crossed(old, pairs, atts, rate, f"{seed}-{g}-swap", pop, row).withColumn(pop, F.lit(top + 1) + 2 * F.col("pair") + F.col("child"))
        place = F.broadcast(best.select(pop, (F.row_number().over(W.orderBy("score", pop)) + F.lit(top + 2 * keep)).cast("long").alias("__new")))  # ``keep`` rows
        changed = mutated(old, census, net, cpds, keep_atts, change, f"{seed}-{g}-change", pop, row).join(place, pop).withColumn(pop, F.col("__new"))
        top += 3 * keep
        now = cut(old.unionByName(kids.select(*old.columns)).unionByName(changed.select(*old.columns)))
    return cut(now), log


def self_training(seed_rows: DataFrame, net: Network, score: Callable[[DataFrame], float], n: int, rounds: int, share: float = 0.5, seed: object = 0) -> tuple[float, DataFrame]:
    """The best of ``rounds`` samples, each from parameters that count the seed and a share of the best sample before.

    Counts of the sample are the Dirichlet prior's, so that what scored well
    pulls the next parameters its way.
    """
    atts, best, extra = list(net), None, None
    base = seed_rows.select(*atts).withColumn("__w", F.lit(1.0))
    for r in range(rounds):
        rows = base if extra is None else base.unionByName(extra)
        made = cut(forward_pool(seed_rows.sparkSession, n, net, learn_parameters(rows, net, "__w"), f"{seed}-{r}"))
        got = (score(made), r, made)
        best = got if best is None else min(best, got, key=lambda x: x[:2])
        extra = best[2].select(*atts).withColumn("__w", F.lit(float(share)))
    if best is None:
        raise ValueError("no rounds")
    return best[0], best[2]
