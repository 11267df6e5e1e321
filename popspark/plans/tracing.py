"""Queries over many populations at once, traces from the sinks, zones on a map, and draws from hot strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, evolve, sampling as S, spatial
from ..sources import files
from .catalog import HH, HH_ATTS, MARG, U, WITH, census_hh, households, query, r6, t

# Steps of a run, written to the sinks and read again

RUNS, STEPS = 15, 5
TRACED = [
    f"g AS (SELECT r, s FROM (SELECT unnest(range(0, {RUNS})) AS r), (SELECT unnest(range(0, {STEPS})) AS s))",
    "pops AS (SELECT r, s, hh.* FROM g JOIN hh ON (hhid + 5 * r + s) % 3 <> 0 UNION ALL SELECT g.r, g.s, hh.* FROM g JOIN hh ON hhid % 15 < g.r)",
    "cells AS (SELECT r, s, zone_id, att, state, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT r, s, zone_id, '{a}' AS att, {a} AS state FROM pops" for a in HH_ATTS) + ") GROUP BY ALL)",
    "err AS (SELECT r, s, zone_id, att, state, coalesce(n, 0) - coalesce(value, 0) AS d FROM cells FULL JOIN (SELECT * FROM g, marg) USING (r, s, zone_id, att, state))",
]


@query(WITH(HH, MARG, *TRACED) + "SELECT r AS run, s AS step, att, state, round(sqrt(sum(d * d) / (SELECT count(DISTINCT zone_id) FROM marg)), 6) AS rmse FROM err GROUP BY ALL")
def saa_step_trace(spark, d):
    """75 steps read from their folders: each step's population with what earlier runs kept."""
    h = households(spark, d).select("hhid", "zone_id", *HH_ATTS).repartition(spark.sparkContext.defaultParallelism, "hhid")  # each row becomes 50
    runs, steps = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (RUNS, STEPS))
    grid = h.withColumn("run", runs).withColumn("step", steps)
    where = files.artefact_folder(spark, "saa_step_trace")
    files.write_steps(grid.where((F.col("hhid") + 5 * F.col("run") + F.col("step")) % 3 != 0).drop("hhid"), f"{where}/steps")
    files.write_kept(h.withColumn("run", (F.col("hhid") % 15).cast("int")).drop("hhid"), f"{where}/kept")
    trace = analysis.saa_trace(spark.read.parquet(f"{where}/steps"), spark.read.parquet(f"{where}/kept"), census_hh(spark, d), HH_ATTS)
    return trace.select("run", "step", "att", "state", r6("rmse").alias("rmse"))


# Evolution

POPS = [
    "p AS (SELECT k AS pop, hhid AS row, dwelltype, hhinc, totalvehs FROM (SELECT unnest(range(0, 4)) AS k) JOIN hh ON true)",
    "q AS (SELECT pop, p.row, CASE WHEN pop = 0 THEN dwelltype ELSE CASE WHEN p.row % (pop + 2) = 0 THEN 'BUILDING' ELSE dwelltype END END AS dwelltype, hhinc, totalvehs FROM p)",
    f"kids AS (SELECT pair, CASE WHEN u < 0.4 THEN 1 - side ELSE side END AS child, k.row, dwelltype, hhinc, totalvehs FROM (SELECT pop // 2 AS pair, pop % 2 AS side, q.*, {U('0', chr(40) + 'CAST(pop // 2 AS VARCHAR) || chr(124) || CAST(q.row AS VARCHAR)' + chr(41))} AS u FROM q) k)",
    "n AS (SELECT pair, child, att, state, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT pair, child, '{a}' AS att, {a} AS state FROM kids" for a in HH_ATTS) + ") GROUP BY ALL)",
    "w AS (SELECT att, state, sum(value) AS w FROM marg GROUP BY ALL)",
    "e AS (SELECT pair, child, att, state, coalesce(n, 0) - coalesce(w, 0) AS d FROM n FULL JOIN (SELECT * FROM w, (SELECT DISTINCT pair, child FROM kids)) USING (pair, child, att, state))",
]


@query(WITH(HH, MARG, *POPS) + "SELECT pair, child, round(sqrt(avg(d * d)), 6) AS score FROM e GROUP BY ALL")
def crossed_scores(spark, d):
    """Children of two pairs of populations in one table, scored against the census in one job."""
    h = households(spark, d)
    pops = h.withColumn("pop", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("pop", F.col("hhid").alias("row"), *HH_ATTS)
    pops = pops.withColumn("dwelltype", F.when((F.col("pop") > 0) & (F.col("row") % (F.col("pop") + 2) == 0), "BUILDING").otherwise(F.col("dwelltype")))
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "pair int, a int, b int")
    kids = evolve.crossed(pops, pairs, HH_ATTS).withColumn("pop", F.struct("pair", "child"))
    goals = census_hh(spark, d).groupBy("att", "state").agg(F.sum("value").alias("value"))
    return evolve.population_scores(kids, goals, HH_ATTS).select("pop.pair", "pop.child", r6("score").alias("score"))


# Zones on a map

PLACES = "pt AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000) / 100.0::DOUBLE AS x, (c_custkey * 91 % 997) / 100.0::DOUBLE AS y FROM customer)"
RINGS = """rg AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 2.0::DOUBLE AS x0, (n_nationkey // 5) * 2.0::DOUBLE AS y0, n_nationkey % 3 * 0.3::DOUBLE AS s FROM nation),
ed AS (SELECT zone, unnest([x0, x0 + 2 + s, x0 + 2, x0 + 1, x0 - s]) AS ax, unnest([y0, y0 + 0.1, y0 + 2 + s, y0 + 1.2, y0 + 2]) AS ay, unnest([x0 + 2 + s, x0 + 2, x0 + 1, x0 - s, x0]) AS qx, unnest([y0 + 0.1, y0 + 2 + s, y0 + 1.2, y0 + 2, y0]) AS qy FROM rg)"""


def places(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k.alias("id"), (k * 37 % 1000 / 100.0).alias("x"), (k * 91 % 997 / 100.0).alias("y"))


def rings(spark, d):
    """An irregular pentagon for each nation, with a dent, some overlapping their neighbours."""
    n = F.col("n_nationkey")
    z = t(spark, d, "nation").select(n.cast("int").alias("zone"), ((n % 5).cast("double") * 2.0).alias("x0"), (F.floor(n / 5).cast("double") * 2.0).alias("y0"), ((n % 3).cast("double") * 0.3).alias("s"))
    x0, y0, s = F.col("x0"), F.col("y0"), F.col("s")
    corners = [(x0, y0), (x0 + 2 + s, y0 + 0.1), (x0 + 2, y0 + 2 + s), (x0 + 1, y0 + 1.2), (x0 - s, y0 + 2)]
    return z.select("zone", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]).alias("ring"))


@query(WITH(PLACES, RINGS) + "SELECT id, CAST(zone AS INTEGER) AS zone FROM pt, ed WHERE (ay > y) <> (qy > y) AND x < (qx - ax) * (y - ay) / (qy - ay) + ax GROUP BY id, zone HAVING count(*) % 2 = 1")
def points_in_zones(spark, d):
    return spatial.points_in_zones(places(spark, d), rings(spark, d)).select("id", "zone")


@query(WITH(HH) + "SELECT DISTINCT zone_id, CAST(count(*) FILTER (hhinc = '9000+') OVER (PARTITION BY zone_id) AS BIGINT) AS bar, CAST(coalesce(sum(CASE WHEN dwelltype = 'BUILDING' THEN hhid END) OVER (PARTITION BY zone_id), 0) AS BIGINT) AS heat FROM hh")
def zone_map_series(spark, d):
    h = households(spark, d)
    bars = h.where("hhinc = '9000+'").groupBy("zone_id").agg(F.count(F.lit(1)).alias("value"))
    return spatial.zone_series(h.select("zone_id").distinct(), bars, h.where("dwelltype = 'BUILDING'").withColumnRenamed("hhid", "value"))


# Draws


HOT = """pool AS (SELECT CASE WHEN zone_id < '3' THEN zone_id ELSE 'hot' END AS z, hhid, totalvehs, CASE WHEN totalvehs = '4+' THEN 4 ELSE CAST(totalvehs AS INTEGER) + 1 END AS w FROM hh),
c AS (SELECT *, sum(w) OVER (PARTITION BY z ORDER BY hhid) AS hi, sum(w) OVER (PARTITION BY z) AS total FROM pool)"""


@query(WITH(HH, HOT) + f"SELECT k AS draw, z, hhid FROM (SELECT k, z, {U('0', chr(40) + 'z || chr(124) || CAST(k AS VARCHAR)' + chr(41))} AS u FROM (SELECT CAST(unnest(range(1, 201)) AS INTEGER) AS k), (SELECT DISTINCT z FROM pool)) JOIN c USING (z) WHERE u * total >= hi - w AND u * total < hi")
def weighted_draw_hot(spark, d):
    """Draws from strata of which one has most of the pool, whose running sums lie in many partitions."""
    v = F.col("totalvehs")
    pool = households(spark, d).select(F.when(F.col("zone_id") < "3", F.col("zone_id")).otherwise("hot").alias("z"), "hhid", F.when(v == "4+", 4).otherwise(v.try_cast("int") + 1).alias("w"))
    draws = S.draws_for(pool.select("z").distinct().withColumn("n", F.lit(200)), ["z"], "n")
    return S.weighted_draws(draws, pool, ["z"], "w", ["hhid"], ["z", "draw"], spread=True).select("draw", "z", "hhid")


@query(WITH(HH) + "SELECT dwelltype, CAST(count(*) AS BIGINT) AS n FROM hh GROUP BY dwelltype")
def spread_totals(spark, d):
    """Running sums of a spread pool end, stratum by stratum, at its total."""
    cdf, _ = S.running_weights(households(spark, d).withColumn("one", F.lit(1)), ["dwelltype"], "one", ["hhid"], True)
    return cdf.groupBy("dwelltype").agg(F.max("hi").cast("long").alias("n"))


