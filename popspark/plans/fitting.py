"""Queries of the fitting operators: adjustment, structure and inference in networks, back-tracking, updating, raking."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import functions as F

from ..operators import bayes, condense as C, csp, infer, ipu, raking, relations as R, saa
from .catalog import HH, HH_ATTS, MARG, PM, PP, SYN, WITH, census_hh, households, persons, query, r6, sampled_hh
from .more import full_pool

# Adjustment

RICH = "syn AS (SELECT * REPLACE (CASE WHEN hhid % 3 = 0 THEN '9000+' ELSE hhinc END AS hhinc) FROM hh)"
DIFF = "d AS (SELECT zone_id, state, coalesce(m.n, 0) - coalesce(s.n, 0) AS diff FROM (SELECT zone_id, hhinc AS state, count(*) AS n FROM hh GROUP BY ALL) m FULL JOIN (SELECT zone_id, hhinc AS state, count(*) AS n FROM syn GROUP BY ALL) s USING (zone_id, state))"


@query(WITH(HH, RICH, DIFF) + "SELECT zone_id, CAST(2 * (SELECT count(DISTINCT hhinc) FROM hh) * sum(greatest(diff, 0)) AS DOUBLE) AS objective FROM d GROUP BY zone_id")
def adjustment_objective(spark, d):
    """Where every cell is open, a unit moved costs two changes in as many states as there are."""
    h = households(spark, d)
    syn = h.withColumn("hhinc", F.when(F.col("hhid") % 3 == 0, "9000+").otherwise(F.col("hhinc"))).select("zone_id", *HH_ATTS)
    cells = saa.feasible_cells(C.condense(syn, ["zone_id", "dwelltype", "hhinc"]), full_pool(h), ["dwelltype"], "hhinc")
    return saa.adjustment_objective(cells, saa.state_differences("hhinc", syn, census_hh(spark, d)), ["dwelltype"], "hhinc")


@query(WITH(HH, RICH) + "SELECT zone_id, dwelltype, count(*) AS n FROM hh GROUP BY ALL")
def adjusted_rows(spark, d):
    """A relative adjustment with a spread penalty keeps every row's sum."""
    h = households(spark, d)
    syn = h.withColumn("hhinc", F.when(F.col("hhid") % 3 == 0, "9000+").otherwise(F.col("hhinc"))).select("zone_id", *HH_ATTS)
    cells = saa.feasible_cells(C.condense(syn, ["zone_id", "dwelltype", "hhinc"]), C.condense(sampled_hh(spark, d), HH_ATTS), ["dwelltype"], "hhinc")
    got = saa.adjusted_counts(cells, saa.state_differences("hhinc", syn, census_hh(spark, d)), ["dwelltype"], "hhinc", deviation="relative", spread_penalty=0.0001)
    return got.groupBy("zone_id", "dwelltype").agg(F.sum("count").alias("n"))


@query(WITH(HH, MARG) + "SELECT zone_id, att, CAST(sum(value) AS BIGINT) AS placed, 0 AS over FROM marg GROUP BY ALL")
def saa_kept_and_left(spark, d):
    """What one run keeps is never over the census, and with what is left of it adds up to it."""
    m, pool = census_hh(spark, d), C.condense(sampled_hh(spark, d), HH_ATTS)
    syn = saa.initial_population("dwelltype", m, pool, HH_ATTS)
    syn = saa.adjust_attribute("hhinc", syn, m, pool, HH_ATTS, ["dwelltype"], keep_zero_cells=True)
    kept, left = saa.check_fit(syn, m, HH_ATTS, 0.3)
    both = left.select("zone_id", "att", "value", F.least("value", F.lit(0)).alias("under")).unionByName(C.marginals(kept, "zone_id", HH_ATTS).select("zone_id", "att", "value", F.lit(0).cast("long").alias("under")))
    return both.groupBy("zone_id", "att").agg(F.sum("value").cast("long").alias("placed"), (-F.sum("under")).cast("int").alias("over"))


# Networks


def _family(child: str, parents: tuple[str, ...]) -> str:
    of = f"PARTITION BY {', '.join(parents)}" if parents else ""
    size = " * ".join([f"(SELECT count(DISTINCT {child}) - 1 FROM hh)", *[f"(SELECT count(DISTINCT {p}) FROM hh)" for p in parents]])
    return f"SELECT '{child}' AS child, '{','.join(parents)}' AS parents, sum(n * ln(n / t)) - 0.5 * {size} * ln(sum(n)) AS bic FROM (SELECT n, sum(n) OVER ({of}) AS t FROM (SELECT count(*) AS n{''.join(', ' + p for p in parents)} FROM hh GROUP BY {', '.join([child, *parents])}))"


FAMILIES = [(c, p) for c in HH_ATTS for k in range(3) for p in combinations(sorted(set(HH_ATTS) - {c}), k)]
SCORES = "f AS (" + " UNION ALL ".join(_family(c, p) for c, p in FAMILIES) + ")"


def _acyclic(parents: dict[str, tuple[str, ...]]) -> bool:
    left = dict(parents)
    while ready := [a for a in left if not any(p in left for p in left[a])]:
        for a in ready:
            del left[a]
    return not left


DAGS = [net for net in (dict(zip(HH_ATTS, ps)) for ps in product(*[[p for c, p in FAMILIES if c == a] for a in HH_ATTS])) if _acyclic(net)]
TOTALS = " UNION ALL ".join("SELECT sum(bic) AS total FROM f WHERE " + " OR ".join(f"(child = '{c}' AND parents = '{','.join(p)}')" for c, p in net.items()) for net in DAGS)


@query(WITH(HH, SCORES) + "SELECT child, parents, round(bic, 4) AS bic FROM f")
def bn_family_scores(spark, d):
    return bayes.family_scores(households(spark, d), HH_ATTS, 2).withColumn("bic", F.round("bic", 4))


@query(WITH(HH, SCORES) + f"SELECT round(max(total), 3) AS score FROM ({TOTALS})")
def bn_network_score(spark, d):
    """The learned network of three attributes is a best one of all their 25."""
    h = households(spark, d)
    net, scores = bayes.learn_structure(h, HH_ATTS, 2), bayes.family_scores(h, HH_ATTS, 2)
    chosen = spark.createDataFrame([(c, ",".join(sorted(p))) for c, p in net.items()], "child string, parents string")
    return scores.join(F.broadcast(chosen), ["child", "parents"]).agg(F.round(F.sum("bic"), 3).alias("score"))


CHAIN = {"dwelltype": (), "hhinc": ("dwelltype",), "totalvehs": ("hhinc",)}


def _table(name: str, child: str, parent: str | None) -> str:
    n = f"SELECT {parent + ', ' if parent else ''}{child}, count(*) AS n FROM hh GROUP BY ALL"
    if not parent:
        return f"{name} AS (SELECT {child}, (n + 1.0::DOUBLE) / sum(n + 1.0::DOUBLE) OVER () AS p FROM ({n}))"
    return f"{name} AS (SELECT {parent}, {child}, (coalesce(n, 0) + 1.0::DOUBLE) / sum(coalesce(n, 0) + 1.0::DOUBLE) OVER (PARTITION BY {parent}) AS p FROM (SELECT * FROM (SELECT DISTINCT {parent} FROM hh), (SELECT DISTINCT {child} FROM hh)) LEFT JOIN ({n}) USING ({parent}, {child}))"


JOINT = [_table("t1", "dwelltype", None), _table("t2", "hhinc", "dwelltype"), _table("t3", "totalvehs", "hhinc"), "j AS (SELECT dwelltype, totalvehs, sum(t1.p * t2.p * t3.p) AS p FROM t1 JOIN t2 USING (dwelltype) JOIN t3 USING (hhinc) GROUP BY ALL)"]


def chain(spark, d):
    h = households(spark, d)
    states = bayes.state_names(h, list(CHAIN))
    return h, states, infer.complete(h, CHAIN, states)


@query(WITH(HH, *JOINT) + "SELECT totalvehs, dwelltype, round(p / sum(p) OVER (PARTITION BY totalvehs), 6) AS p FROM j")
def bn_posterior(spark, d):
    """Types of dwelling given the vehicles, two edges further down."""
    h, states, cpds = chain(spark, d)
    return infer.posterior(h.select("totalvehs"), CHAIN, cpds, ["dwelltype"], states).withColumn("p", r6("p"))


@query(WITH(HH) + "SELECT totalvehs, dwelltype, true AS close FROM (SELECT DISTINCT totalvehs FROM hh), (SELECT DISTINCT dwelltype FROM hh)")
def bn_gibbs_shares(spark, d):
    """Shares of 4000 chains a vehicle number are within 0.05 of the exact posterior."""
    h, states, cpds = chain(spark, d)
    e = h.select("totalvehs").distinct().withColumn("n", F.lit(4000))
    got = infer.gibbs(e, CHAIN, cpds, states, ["totalvehs"], "n", sweeps=10).groupBy("totalvehs", "dwelltype").agg((F.count(F.lit(1)) / 4000).alias("share"))
    want = infer.posterior(e, CHAIN, cpds, ["dwelltype"], states)
    return want.join(got, ["totalvehs", "dwelltype"], "left").select("totalvehs", "dwelltype", (F.abs(F.coalesce("share", F.lit(0.0)) - F.col("p")) < 0.05).alias("close"))


# Persons

ADULTS = "m AS (SELECT hh.hhid, dwelltype, sex, age // 10 AS decade, age FROM pm JOIN hh USING (hhid) WHERE relationship = 'Main'), k AS (SELECT DISTINCT m.sex, m.decade FROM m JOIN pm c ON c.hhid = m.hhid AND c.relationship = 'Child' WHERE m.age - c.age >= 60)"


@query(WITH(HH, PP, PM, ADULTS) + "SELECT hhid, dwelltype IN (SELECT o.dwelltype FROM m o JOIN k USING (sex, decade)) AS served FROM m WHERE (sex, decade) NOT IN (SELECT sex, decade FROM k)")
def csp_backtracked(spark, d):
    """Mains without a pair to a child 60 years younger are drawn again among those of their dwelling type: all are served where any could be."""
    p = R.first_is_main(persons(spark, d)).join(households(spark, d).select("hhid", "dwelltype"), "hhid")
    main = p.where("relationship = 'Main'").select("hhid", "dwelltype", F.col("sex").alias("Main_sex"), F.floor(F.col("age") / 10).alias("Main_decade"), F.col("age").alias("__age"))
    child = p.where("relationship = 'Child'").select("hhid", F.col("age").alias("__child"))
    pairs = main.join(child, "hhid").where(F.col("__age") - F.col("__child") >= 60).select("Main_sex", "Main_decade").distinct()
    options = C.condense(main, ["dwelltype", "Main_sex", "Main_decade"])
    found = main.select("hhid", "dwelltype").join(F.broadcast(options), "dwelltype").select("hhid", "Main_sex", "Main_decade", "count")
    parents = main.select("hhid", "Main_sex", "Main_decade")
    after, log = csp.redraw_parents(parents, found, parents, pairs, ["Main_sex", "Main_decade"])
    pairs = pairs.withColumn("ok", F.lit(True))
    can = after.join(pairs, ["Main_sex", "Main_decade"], "left").groupBy("hhid").agg(F.max(F.coalesce("ok", F.lit(False))).alias("served"))
    return log.select("hhid").join(can, "hhid")


# Updating and raking

CENSUS = "goal AS (SELECT zone_id, dwelltype AS state, CAST(count(*) AS DOUBLE) AS g FROM hh GROUP BY ALL UNION ALL SELECT zone_id, sex, CAST(count(*) AS DOUBLE) FROM pp JOIN hh USING (hhid) GROUP BY ALL)"
SURVEY = "q AS (SELECT hhid, count(*) FILTER (sex = 'F') AS f, count(*) FILTER (sex = 'M') AS m FROM pp WHERE hhid IN (SELECT hhid FROM syn) GROUP BY hhid), y AS (SELECT hhid, dwelltype, coalesce(f, 0) AS f, coalesce(m, 0) AS m FROM syn LEFT JOIN q USING (hhid))"


def _updates(passes: int) -> list[str]:
    ctes = ["w0 AS (SELECT zone_id, homes / (SELECT count(*) FROM y) AS w, y.* FROM (SELECT zone_id, CAST(count(*) AS DOUBLE) AS homes FROM hh GROUP BY zone_id), y)"]
    for i in range(passes):
        a, b, c, e = (f"w{3 * i + k}" for k in range(4))
        ctes.append(f"{b} AS (SELECT * REPLACE (w * greatest(coalesce((SELECT g FROM goal WHERE goal.zone_id = {a}.zone_id AND state = dwelltype), 0), 1e-9) / sum(w) OVER (PARTITION BY zone_id, dwelltype) AS w) FROM {a})")
        for x, y, s, n in ((b, c, "F", "f"), (c, e, "M", "m")):
            ctes.append(f"{y} AS (SELECT * REPLACE (CASE WHEN {n} > 0 THEN w * greatest(coalesce((SELECT g FROM goal WHERE goal.zone_id = {x}.zone_id AND state = '{s}'), 0), 1e-9) / sum(w * {n}) OVER (PARTITION BY zone_id) ELSE w END AS w) FROM {x})")
    return ctes


@query(WITH(HH, SYN, PP, CENSUS, SURVEY, *_updates(3)) + "SELECT zone_id, hhid, round(w, 4) AS weight FROM w9")
def ipu_passes(spark, d):
    """Three passes over half of the households for every zone's dwellings and persons, which they do not fit before."""
    h, s, p = households(spark, d), sampled_hh(spark, d), persons(spark, d)
    inc = ipu.incidence(s, p.join(s.select("hhid"), "hhid", "left_semi"), "hhid", ["dwelltype"], ["sex"])
    census = C.marginals(h, "zone_id", ["dwelltype"]).withColumn("level", F.lit("household"))
    people = C.marginals(p.join(h.select("hhid", "zone_id"), "hhid"), "zone_id", ["sex"]).withColumn("level", F.lit("person"))
    return ipu.run(inc, census.unionByName(people), iterations=3).select("zone_id", "hhid", F.round("weight", 4).alias("weight"))


CONTROLS = [
    {"att": "cars", "state": "some", "expression": "households.totalvehs != '9'", "control_field": "CARS_SOME", "seed_table": "households"},
    {"att": "cars", "state": "none", "expression": "households.totalvehs == '0'", "control_field": "CARS_NONE", "seed_table": "households"},
    {"att": "pay", "state": "low", "expression": "(households.hhinc == 'Negative income') | (households.hhinc == '1-999') | (households.hhinc == '1000-2999')", "control_field": "PAY_LOW", "seed_table": "households"},
    {"att": "pay", "state": "high", "expression": "(households.hhinc == '3000-5999') | (households.hhinc == '6000-8999') | (households.hhinc == '9000+')", "control_field": "PAY_HIGH", "seed_table": "households"},
    {"att": "sex", "state": "F", "expression": "persons.sex == 'F'", "control_field": "F", "seed_table": "persons"},
]
LOW = "('Negative income', '1-999', '1000-2999')"
HIGH = "('3000-5999', '6000-8999', '9000+')"
LABELS = f"CASE WHEN totalvehs = '0' THEN 'none' ELSE 'some' END AS cars, CASE WHEN hhinc IN {HIGH} THEN 'high' WHEN hhinc IN {LOW} THEN 'low' END AS pay"


def census_columns(spark, d):
    """A census with one column for each control."""
    cars, pay = F.col("totalvehs") == "0", lambda names: F.col("hhinc").isin(*names)
    low, high = ("Negative income", "1-999", "1000-2999"), ("3000-5999", "6000-8999", "9000+")
    return households(spark, d).groupBy("zone_id").agg(F.count_if(~cars).alias("CARS_SOME"), F.count_if(cars).alias("CARS_NONE"), F.count_if(pay(low)).alias("PAY_LOW"), F.count_if(pay(high)).alias("PAY_HIGH"), F.count_if(F.lit(False)).alias("F"))


def _sweeps(first: str, atts: list[str], sweeps: int, zone: str, goal: str) -> list[str]:
    """CTEs s0, s1, ... of fits to each attribute in turn."""
    ctes, n = [f"s0 AS ({first})"], 0
    for _ in range(sweeps):
        for a in atts:
            ctes.append(f"s{n + 1} AS (SELECT s.* REPLACE (s.w * coalesce(g.value, 0) / sum(s.w) OVER (PARTITION BY s.{zone}, s.{a}) AS w) FROM s{n} s LEFT JOIN {goal} g ON g.att = '{a}' AND g.state = s.{a} AND g.{zone} = s.{zone})")
            n += 1
    return ctes


LABELLED = f"lab AS (SELECT zone_id, {LABELS} FROM hh)"
LGOAL = "lgoal AS (SELECT zone_id, 'cars' AS att, cars AS state, CAST(count(*) AS DOUBLE) AS value FROM lab GROUP BY ALL UNION ALL SELECT zone_id, 'pay', pay, CAST(count(*) AS DOUBLE) FROM lab WHERE pay IS NOT NULL GROUP BY ALL)"


@query(WITH(HH, SYN, LABELLED, LGOAL, *_sweeps(f"SELECT zone_id, cars, pay, CAST(count(*) AS DOUBLE) AS w FROM (SELECT zone_id, {LABELS} FROM syn) WHERE pay IS NOT NULL GROUP BY ALL", ["cars", "pay"], 2, "zone_id", "lgoal")) + "SELECT zone_id, cars, pay, round(w, 5) AS weight FROM s4")
def ipf_controls(spark, d):
    got = raking.fit_controls(sampled_hh(spark, d), census_columns(spark, d), CONTROLS, sweeps=2)
    return got.select("zone_id", "cars", "pay", F.round("weight", 5).alias("weight"))


OVERLAP = [("CARS_NONE", "totalvehs == '0'"), ("PAY_HIGH", "(hhinc == '3000-5999') | (hhinc == '6000-8999') | (hhinc == '9000+')"), ("BOTH", "totalvehs == '0' & hhinc == '9000+'")]
ROAD = "r0 AS (SELECT zone_id, hhid, 1.0::DOUBLE AS w, totalvehs = '0' AS c0, hhinc IN {high} AS c1, totalvehs = '0' AND hhinc = '9000+' AS c2 FROM syn), goals AS (SELECT zone_id, count(*) FILTER (totalvehs = '0') AS g0, count(*) FILTER (hhinc IN {high}) AS g1, count(*) FILTER (totalvehs = '0' AND hhinc = '9000+') AS g2 FROM hh GROUP BY zone_id)".format(high=HIGH)
RAKED = [f"r{n + 1} AS (SELECT r.* REPLACE (CASE WHEN c{n % 3} THEN r.w * g{n % 3} / sum(CASE WHEN c{n % 3} THEN r.w END) OVER (PARTITION BY r.zone_id) ELSE r.w END AS w) FROM r{n} r JOIN goals USING (zone_id))" for n in range(6)]


@query(WITH(HH, SYN, ROAD, *RAKED) + "SELECT zone_id, hhid, round(w, 5) AS weight FROM r6")
def raked_controls(spark, d):
    """Two sweeps over controls that overlap."""
    wanted = [F.struct(F.lit(n).alias("control"), F.col(n).cast("double").alias("value")) for n, _ in OVERLAP]
    both = households(spark, d).groupBy("zone_id").agg(F.count_if((F.col("totalvehs") == "0") & (F.col("hhinc") == "9000+")).alias("BOTH"))
    goals = census_columns(spark, d).join(both, "zone_id").select("zone_id", F.explode(F.array(*wanted)).alias("c")).select("zone_id", "c.control", "c.value")
    rows = sampled_hh(spark, d).withColumn("weight", F.lit(1.0))
    return raking.rake(rows, OVERLAP, goals, sweeps=2).select("zone_id", "hhid", F.round("weight", 5).alias("weight"))


RATES = [k / 10 for k in range(1, 11)]
HEADS = [
    "rates AS (SELECT unnest(range(1, 11)) AS k)",
    "o AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || CAST(hhid AS VARCHAR)), hhid) AS rn FROM hh)",
    "cells AS (SELECT dwelltype, hhinc, totalvehs, CAST(count(*) AS DOUBLE) AS m FROM hh GROUP BY ALL)",
    "heads AS (SELECT k, dwelltype, hhinc, totalvehs, CAST(count(*) AS DOUBLE) AS n FROM o JOIN rates ON rn <= k * (SELECT count(*) FROM hh) // 10 GROUP BY ALL)",
    "rgoal AS (SELECT k, att, state, CAST(sum(value) AS DOUBLE) AS value FROM marg, rates GROUP BY ALL)",
]
BY_RATE = _sweeps("SELECT k, dwelltype, hhinc, totalvehs, coalesce(n, 1e-25) AS w FROM (SELECT * FROM cells, rates) LEFT JOIN heads USING (k, dwelltype, hhinc, totalvehs)", HH_ATTS, 2, "k", "rgoal")
ROUNDED = "e AS (SELECT k, dwelltype, hhinc, totalvehs, round_even(round(w, 6), 0) AS n FROM s6)"
RMSE = "SELECT k, sqrt(avg(pow(got - value, 2))) AS rmse FROM (" + " UNION ALL ".join(f"SELECT k, '{a}' AS att, {a} AS state, sum(n) AS got FROM e GROUP BY ALL" for a in HH_ATTS) + ") JOIN rgoal USING (k, att, state) GROUP BY k"


@query(WITH(HH, MARG, *HEADS, *BY_RATE, ROUNDED) + f"SELECT k / 10.0::DOUBLE AS rate, round(rmse, 4) AS rmse, round(srmse, 6) AS srmse FROM ({RMSE}) JOIN (SELECT k, sqrt(sum(pow(n / t - m / (SELECT count(*) FROM hh), 2)) * count(*)) AS srmse FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM e) JOIN cells USING (dwelltype, hhinc, totalvehs) GROUP BY k) USING (k)")
def ipf_by_rate(spark, d):
    h = households(spark, d)
    fitted = raking.fit_by_rate(h, HH_ATTS, RATES, ["hhid"], sweeps=2)
    return raking.errors_by_rate(h, fitted, HH_ATTS).select("rate", F.round("rmse", 4).alias("rmse"), F.round("srmse", 6).alias("srmse"))


