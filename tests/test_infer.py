"""Structure scores from one pass; posteriors and chains against sums over the joint distribution."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from popspark.operators import bayes, infer

NET = {"a": (), "b": ("a",), "c": ("a",), "d": ("b", "c")}
STATES = {"a": ["x", "y"], "b": ["0", "1", "2"], "c": ["u", "v"], "d": ["p", "q"]}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a = rng.choice("xxy")
        b = rng.choice("001" if a == "x" else "122")
        c = rng.choice("uv" if a == "x" else "vvv")
        rows.append((a, b, c, "p" if (b == "2") != (c == "u") and rng.random() < 0.9 else "q"))
    return spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(3).cache()


@pytest.fixture(scope="module")
def cpds(table):
    return infer.complete(table, NET, STATES)


@pytest.fixture(scope="module")
def joint(cpds):
    p = {v: {tuple(r[c] for c in [*NET[v], v]): r["p"] for r in f.collect()} for v, f in cpds.items()}
    out = {}
    for s in product(*STATES.values()):
        at, q = dict(zip(STATES, s)), 1.0
        for v in NET:
            q *= p[v][tuple(at[c] for c in [*NET[v], v])]
        out[s] = q
    return out


def given(joint, evidence, targets):
    names, out = list(STATES), {}
    for s, q in joint.items():
        at = dict(zip(names, s))
        if all(at[k] == v for k, v in evidence.items()):
            key = tuple(at[t] for t in targets)
            out[key] = out.get(key, 0.0) + q
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_tables_sum_to_one(cpds, joint):
    assert abs(sum(joint.values()) - 1) < 1e-9


@pytest.mark.parametrize("evidence,targets", [({"d": "p"}, ["a"]), ({"d": "q", "b": "2"}, ["a", "c"]), ({"a": "y"}, ["d"]), ({"c": "u"}, ["b", "d"])])
def test_posterior(spark, cpds, joint, evidence, targets):
    e = spark.createDataFrame([tuple(evidence.values())], ", ".join(f"{k} string" for k in evidence))
    got = {tuple(r[t] for t in targets): r["p"] for r in infer.posterior(e, NET, cpds, targets, STATES).collect()}
    want = given(joint, evidence, targets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_evidence(spark, cpds, joint):
    got = {r["d"]: r["p"] for r in infer.posterior(spark.range(1).select("id"), NET, cpds, ["d"], STATES).collect()}
    want = given(joint, {}, ["d"])
    assert all(abs(got[k[0]] - want[k]) < 1e-9 for k in want)


def test_evidence_below_moves_parents(spark, cpds, joint):
    """Exact draws, Gibbs chains and likelihood weights agree with the posterior of a parent given its child."""
    e = spark.createDataFrame([(1, "p", 4000), (2, "q", 4000)], "id long, d string, n int")
    exact = infer.sample_posterior(e, NET, cpds, STATES, ["id"], "n", ["a"])
    chains = infer.gibbs(e, NET, cpds, STATES, ["id"], "n", 30)
    weighted = infer.likelihood_weighted(e, NET, cpds, ["id"], "n").groupBy("id", "a").agg(F.sum("weight").alias("w"))
    for df, n, off in ((exact, F.lit(1.0), 0.03), (weighted, F.col("w"), 0.04), (chains, F.lit(1.0), 0.05)):
        sums = {(r["id"], r["a"]): r["s"] for r in df.groupBy("id", "a").agg(F.sum(n).alias("s")).collect()}
        for i, d in ((1, "p"), (2, "q")):
            total = sums[i, "x"] + sums.get((i, "y"), 0.0)
            assert abs(sums[i, "x"] / total - given(joint, {"d": d}, ["a"])[("x",)]) < off
    assert chains.where("(id = 1 AND d <> 'p') OR (id = 2 AND d <> 'q')").count() == 0


def test_gibbs_does_not_depend_on_layout(spark, cpds):
    e = spark.createDataFrame([(i, "p", 3) for i in range(40)], "id long, d string, n int")
    runs = [sorted(map(tuple, infer.gibbs(e.repartition(k), NET, cpds, STATES, ["id"], "n", 3).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 120


def test_scores_of_one_pass(spark, table):
    """The cube's scores are those of each family by itself, and its plan reads the table once."""
    atts, cards = list(STATES), {a: len(s) for a, s in bayes.state_names(table, list(STATES)).items()}
    of = bayes.Scores(table, atts, 2)
    for child, parents in (("a", ()), ("b", ("a",)), ("d", ("b", "c")), ("c", ("a", "d"))):
        assert of(child, parents) == pytest.approx(bayes.bic(table, child, list(parents), cards).collect()[0][0])
    weighted = table.groupBy(*atts).agg(F.count(F.lit(1)).alias("n"))
    assert bayes.Scores(weighted, atts, 2, "n")("d", ("b", "c")) == pytest.approx(of("d", ("b", "c")))
    path = spark.conf.get("spark.sql.warehouse.dir") + "/scores.parquet"
    table.write.mode("overwrite").parquet(path)
    plan = bayes.count_sums(spark.read.parquet(path), atts, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Union") == 0


def test_structure(table):
    net = bayes.learn_structure(table, list(STATES), 2)
    linked = {frozenset((c, p)) for c, ps in net.items() for p in ps}
    assert {frozenset("ab"), frozenset("bd"), frozenset("cd")} <= linked
    assert bayes.topological(net)
