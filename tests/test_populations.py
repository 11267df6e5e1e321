"""Adjustment runs, back-tracking, updating, evolution, maps and spread draws against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from popspark.operators import csp, evolve, infer, ipu, raking, saa, sampling as S, spatial


def marg(spark, cells):
    return spark.createDataFrame([("z", a, s, n) for a, s, n in cells], "zone_id string, att string, state string, value long")


def test_last_run_is_kept_whole(spark):
    """A pool with two combinations cannot fit both marginals; all ten agents are placed all the same."""
    pool = spark.createDataFrame([("a1", "b1", 1), ("a2", "b2", 1)], "a string, b string, count long")
    m = marg(spark, [("a", "a1", 7), ("a", "a2", 3), ("b", "b1", 3), ("b", "b2", 7)])
    for runs in (1, 2, 3):
        assert saa.run(m, pool, ["a", "b"], runs=runs, extra_removed=0.3).count() == 10


def test_extra_goes_before_the_trim(spark):
    """Half of the population goes at random; where what is left is under the census nothing else goes."""
    m = marg(spark, [("a", "x", 30), ("a", "y", 30), ("b", "u", 1), ("b", "v", 59)])
    syn = spark.createDataFrame([("z", "x" if i % 2 else "y", "u" if i < 40 else "v") for i in range(60)], "zone_id string, a string, b string")
    kept, left = saa.check_fit(syn, m, ["a", "b"], 0.5, exclude_atts=["b"])
    assert kept.count() == 30 and {r.att for r in left.collect()} == {"a"}
    kept, left = saa.check_fit(syn, m, ["a", "b"], 0.5)
    assert kept.where("b = 'u'").count() == 1 and left.where("value < 0").count() == 0
    assert left.groupBy("att").agg(F.sum("value").alias("v")).select("v").distinct().collect()[0][0] == 60 - kept.count()


def test_trim_takes_just_the_surplus(spark):
    """A population twice the census loses half; taking all that one combination can give would leave too few."""
    n = {("i1", "v1"): 2, ("i1", "v2"): 1, ("i2", "v1"): 1}
    m = marg(spark, [("a", "i1", 3), ("a", "i2", 1), ("b", "v1", 3), ("b", "v2", 1)])
    syn = spark.createDataFrame([("z", *k) for k, c in n.items() for _ in range(2 * c)], "zone_id string, a string, b string")
    assert {(r.a, r.b): r["count"] for r in saa.trimmed(syn, m, ["a", "b"]).collect()} == n


def test_orders():
    first = ["c", "a", "b", "d"]
    got = saa.orders(first, 40, ["b", "a"], 3, ["d"])
    assert got[0] == first and got[-1][:2] == ["b", "a"] and all(sorted(o) == sorted(first) for o in got)
    ends = sum(o[-1] == "d" for o in got[1:-1])
    assert 8 <= ends <= 30  # one coin for the list, besides what the shuffle does
    some = saa.orders(first, 4, ["b"], 1, adjustable=["a", "b", "c"])
    assert some[0] == first and all("d" not in o for o in some[1:]) and saa.orders(first, 1, ["b"])[0][0] == "b"


def test_first_order_is_of_all_marginals(spark):
    m = marg(spark, [("a", "1", 1), ("b", "1", 1), ("b", "2", 1), ("c", "1", 1), ("c", "2", 1), ("c", "3", 1)])
    assert saa.first_order(m) == ["c", "b", "a"]


def test_parents_are_drawn_again(spark):
    """One feasible parent among ten: every household ends served, with its tries counted, and who could serve stays."""
    found = [(h, f"p{k}", 1 + k) for h in range(60) for k in range(10)]
    parents = [(h, f"p{h % 10}") for h in range(60)]
    f, p = spark.createDataFrame(found, "hhid long, kind string, count long"), spark.createDataFrame(parents, "hhid long, kind string")
    pairs = spark.createDataFrame([("p4",)], "kind string")
    after, log = csp.redraw_parents(p, f, p, pairs, ["kind"])
    assert {r.hhid: r.kind for r in after.collect()} == {h: "p4" for h in range(60)}
    got = {r.hhid: (r.tried, r.served) for r in log.collect()}
    assert len(got) == 54 and all(1 <= n <= 9 and ok for n, ok in got.values()) and len({n for n, _ in got.values()}) > 3
    none, log = csp.redraw_parents(p, f, p, spark.createDataFrame([("p99",)], "kind string"), ["kind"])
    assert sorted(map(tuple, none.collect())) == sorted(parents) and {(r.tried, r.served) for r in log.collect()} == {(10, False)}


def test_pairs_are_added_up_before_households_meet_them(spark):
    """Pool rows that differ only in numbers of relations are one candidate, and are one before the join."""
    pairs = spark.createDataFrame([("a", t, n, 1 + n) for t in "xy" for n in range(50)], "s string, t string, n_Child long, count long")
    c, none = csp.candidates(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "hhid long, s string"), pairs, ["hhid"], ["s"], ["t"])
    assert {(r.hhid, r.t): r["count"] for r in c.collect()} == {(h, t): 1275 for h in (1, 2) for t in "xy"} and [r.hhid for r in none.collect()] == [3]
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Join")


def test_race_keeps_weights(spark):
    """Of two candidates that serve, the draws keep the shares of their counts."""
    found = [(h, k, n) for h in range(3000) for k, n in (("bad", 50), ("x", 3), ("y", 1))]
    p = spark.createDataFrame([(h, "bad") for h in range(3000)], "hhid long, kind string")
    after, _ = csp.redraw_parents(p, spark.createDataFrame(found, "hhid long, kind string, count long"), p, spark.createDataFrame([("x",), ("y",)], "kind string"), ["kind"])
    n = {r.kind: r["count"] for r in after.groupBy("kind").count().collect()}
    assert set(n) == {"x", "y"} and abs(n["x"] / 3000 - 0.75) < 0.04


def plain_ipu(inc, targets, passes):
    keys = sorted({(lv, a, s) for _, lv, a, s, _ in inc})
    homes = sorted({h for h, *_ in inc})
    freq = {(h, (lv, a, s)): f for h, lv, a, s, f in inc}
    out = {}
    for z in sorted({t[0] for t in targets}):
        goal = {(lv, a, s): v for zz, lv, a, s, v in targets if zz == z}
        per = {}
        for (lv, a, _), v in goal.items():
            if lv == "household":
                per[a] = per.get(a, 0) + v
        w = {h: sum(per.values()) / len(per) / len(homes) for h in homes}
        for _ in range(passes):
            for k in keys:
                total = sum(w[h] * freq.get((h, k), 0) for h in homes)
                if total > 0:
                    for h in homes:
                        if freq.get((h, k), 0):
                            w[h] *= max(goal.get(k, 0), 1e-9) / total
        out.update({(z, h): w[h] for h in homes})
    return out


def test_updating_is_the_plain_one(spark):
    rng = random.Random(4)
    inc = [(h, "household", "size", rng.choice("123"), 1) for h in range(30)] + [(h, "person", "sex", s, n) for h in range(30) for s, n in (("F", rng.randrange(3)), ("M", rng.randrange(3))) if n]
    targets = [(z, "household", "size", s, rng.randrange(20, 60)) for z in ("u", "v") for s in "123"] + [(z, "person", "sex", s, rng.randrange(40, 90)) for z in ("u", "v") for s in "FM"]
    i = spark.createDataFrame(inc, "hhid long, level string, att string, state string, freq long")
    t = spark.createDataFrame(targets, "zone_id string, level string, att string, state string, value long")
    got = {(r.zone_id, r.hhid): r.weight for r in ipu.run(i, t, iterations=4).collect()}
    want = plain_ipu(inc, targets, 4)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    far = ipu.run(i, t, iterations=60)
    fit = {r.zone_id: r.fit for r in far.select("zone_id", "fit").distinct().collect()}
    once = {r.zone_id: r.fit for r in ipu.run(i, t, iterations=1).select("zone_id", "fit").distinct().collect()}
    assert all(fit[z] <= once[z] + 1e-12 for z in fit)


def test_rates_get_better(spark):
    rng = random.Random(6)
    full = spark.createDataFrame([(i, rng.choice("aab"), rng.choice("xyz"), rng.choice("pq")) for i in range(1500)], "id long, a string, b string, c string")
    fitted = raking.fit_by_rate(full, ["a", "b", "c"], [0.05, 0.5, 1.0], ["id"], sweeps=8)
    e = {r.rate: (r.rmse, r.srmse) for r in raking.errors_by_rate(full, fitted, ["a", "b", "c"]).collect()}
    assert e[1.0][1] < 1e-6 and e[0.5][1] < e[0.05][1] and all(x < 3 for x, _ in e.values())


def test_evolution_in_one_table(spark):
    rng = random.Random(7)
    census = spark.createDataFrame([(rng.choice("aaab"), rng.choice("xy")) for _ in range(200)], "a string, b string")
    pops = spark.createDataFrame([(p, r, rng.choice("ab"), "x" if p else rng.choice("xy")) for p in range(4) for r in range(200)], "pop long, row long, a string, b string")
    net, states = {"a": (), "b": ("a",)}, {"a": ["a", "b"], "b": ["x", "y"]}
    cpds = infer.complete(census, net, states)
    best, log = evolve.evolve_table(pops, census, net, cpds, 3, 3)
    low = {}
    for r in log.collect():
        low[r.generation] = min(r.score, low.get(r.generation, 1e9))
    assert [g for g in sorted(low)] == [0, 1, 2, 3] and all(low[g + 1] <= low[g] + 1e-9 for g in range(3)) and low[3] < low[0]
    assert {r["count"] for r in best.groupBy("pop").count().collect()} == {200} and best.select("pop").distinct().count() == 3


def test_best_attributes_roles(spark):
    """A state that the population lacks costs nothing; one that the census lacks is infinite."""
    syn = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    census = spark.createDataFrame([("x", "p"), ("y", "p")], "a string, b string")
    got = [tuple(r) for r in evolve.best_attributes(syn, census, ["a", "b"], 2).collect()]
    assert got == [("a", 1.0), ("b", float("inf"))]


def plain_inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_points_in_polygons(spark):
    rng = random.Random(8)
    zones = [(z, [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(rng.randrange(3, 9))]) for z in range(25)] + [(90, [(0.0, 0.0), (1.0, 1.0)]), (91, [])]
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(400)] + [(900, None, 1.0), (901, 1.0, None), (902, 0.0, 0.0)]
    z = spark.createDataFrame(zones, "zone int, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame(points, "id int, x double, y double").repartition(3)
    got = spatial.points_in_zones(p, z, size=0.7)
    want = sorted((i, k) for i, x, y in points if x is not None and y is not None for k, ring in zones if len(ring) > 2 and plain_inside(x, y, ring))
    assert sorted((r.id, r.zone) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    walk = {r.id: r.zone for r in spatial.crosswalk(p, z, "id", "zone").collect()}
    assert walk[900] is None and len(walk) == 403


def test_squares_share_no_point(spark):
    z = spark.createDataFrame([(i, [(float(i), 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (float(i), 1.0)]) for i in range(4)], "zone int, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(k, k / 4, 0.5) for k in range(16)], "id int, x double, y double")
    assert sorted((r.id, r.zone) for r in spatial.points_in_zones(p, z).collect()) == [(k, k // 4) for k in range(16)]


def test_hot_stratum_spreads(spark):
    """A stratum with nine tenths of the pool lies in several partitions, and draws are those of the plain running sum."""
    pool = spark.createDataFrame([("hot" if i % 10 else f"s{i % 7}", i, 1 + i % 4) for i in range(4000)], "z string, k long, w int").repartition(5)
    cdf, _ = S.running_weights(pool, ["z"], "w", ["k"], True)
    assert cdf.where("z = 'hot'").count() == 3600
    parts = pool.repartitionByRange(4, "z", "k").withColumn("p", F.spark_partition_id()).where("z = 'hot'").select("p").distinct().count()
    assert parts >= 3
    draws = S.draws_for(pool.select("z").distinct().withColumn("n", F.lit(50)), ["z"], "n")
    run = lambda spread: sorted(map(tuple, S.weighted_draws(draws, pool, ["z"], "w", ["k"], ["z", "draw"], spread=spread).collect()))
    assert run(True) == run(False) and len(run(True)) == 50 * pool.select("z").distinct().count()


def test_zones_take_their_own_pools(spark):
    """Households of a zone with pools of its own have persons of these only, the others those of all."""
    hh = spark.createDataFrame([(i, f"z{i % 3}", "3") for i in range(30)], "hhid long, zone_id string, hhsize string")

    def pools(sex):
        n = [1, 1, 1, 0, 0, 0, 0, 0]
        names = [f"n_{r}" for r in csp.RELATIONS]
        counts = dict(zip(names, n)) if csp.RELATIONS[0] == "Main" else {f"n_{r}": int(r in ("Main", "Spouse", "Child")) for r in csp.RELATIONS}
        main = spark.createDataFrame([("3", *counts.values(), sex, 1)], "HH_hhsize string, " + ", ".join(f"{c} long" for c in counts) + ", Main_sex string, count long")
        pair = lambda r: spark.createDataFrame([(sex, sex, 1)], f"Main_sex string, {r}_sex string, count long")
        return {"HH-Main": main, "Main-Spouse": pair("Spouse"), "Main-Child": pair("Child")}

    for back in (False, True):
        people, short = csp.run(hh, pools("any"), ["hhsize"], ["sex"], zone="zone_id", zone_pools={"z0": pools("only0"), "z1": pools("only1")}, backtrack=back)
        got = people.join(hh, "hhid").groupBy("zone_id", "sex").count().collect()
        assert {(r.zone_id, r.sex): r["count"] for r in got} == {("z0", "only0"): 30, ("z1", "only1"): 30, ("z2", "any"): 30} and short.count() == 0
