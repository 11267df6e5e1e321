"""Sources and sinks as queries: a table written first, then read back; and tables over several runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import analysis, bayes, condense as C, csp, evolve, joins, metrics, relations as R, saa, sampling as S
from ..sources import files
from .catalog import BOTH, COUNTS, HH, HH_ATTS, JSD, MARG, PM, PP, RUNS, TYPE, WITH, census_hh, households, persons, query, r6, sampled_hh, t
from .more import full_pool
from .tracing import POPS


def folder(spark, name: str) -> str:
    return files.artefact_folder(spark, name)


def lines(rows: DataFrame, path: str) -> None:
    """(k, line) rows as one text file in the order of k: the form of small hand-made files, a line a zone."""
    rows.repartition(1).sortWithinPartitions("k").select("line").write.mode("overwrite").text(path)


@query("SELECT p_partkey, p_name, p_size, round(p_retailprice, 2) AS p_retailprice FROM part")
def csv_typed(spark, d):
    where = folder(spark, "csv_typed")
    files.write_csv(t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), where)
    return files.read_typed(spark, where, "p_partkey bigint, p_name string, p_size bigint, p_retailprice double").withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_strings(spark, d):
    where = folder(spark, "csv_strings")
    files.write_csv(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), where)
    return files.read_strings(spark, where)


CELLS = "a AS (SELECT DISTINCT zone_id FROM marg), s AS (SELECT DISTINCT att, state FROM marg)"


def two_headers(spark, d, where: str) -> None:
    """The census as a two-header file with a geography column: an attribute stands over its first state only."""
    long = census_hh(spark, d)
    states = [tuple(r) for r in long.select("att", "state").distinct().orderBy("att", "state").collect()]  # a census' columns
    wide = C.widen(long, ["zone_id"], states)
    atts = [a if i == 0 or states[i - 1][0] != a else "" for i, (a, _) in enumerate(states)]
    quoted = lambda x: f'"{x}"'
    head = [(0, ",".join(["zone_id", "sample_geog", *atts])), (1, ",".join(["", "", *[quoted(s) for _, s in states]]))]
    cells = [F.col(c).cast("string") for c in wide.columns if c != "zone_id"]
    body = wide.select((F.lit(2) + F.col("zone_id").cast("int")).alias("k"), F.concat_ws(",", "zone_id", F.concat(F.lit("g"), F.col("zone_id").cast("int") % 3), *cells).alias("line"))
    lines(spark.createDataFrame(head, "k int, line string").unionByName(body), where)


@query(WITH(HH, MARG, CELLS) + "SELECT a.zone_id, s.att, s.state, CAST(coalesce(value, 0) AS BIGINT) AS value FROM a CROSS JOIN s LEFT JOIN marg USING (zone_id, att, state)")
def two_header_marginals(spark, d):
    where = folder(spark, "two_header_marginals")
    two_headers(spark, d, where)
    return files.read_marginals(spark, where)


@query(WITH(HH) + "SELECT DISTINCT zone_id, 'g' || CAST(CAST(zone_id AS INTEGER) % 3 AS VARCHAR) AS sample_geog FROM hh")
def marginal_geography(spark, d):
    where = folder(spark, "marginal_geography")
    two_headers(spark, d, where)
    return files.read_marginals_with_geography(spark, where)[1]


@query(WITH(HH) + "SELECT zone_id AS zone, CAST(count(*) FILTER (totalvehs = '0') AS VARCHAR) AS cars_none, CAST(count(*) FILTER (totalvehs <> '0') AS VARCHAR) AS cars_some FROM hh GROUP BY zone_id")
def agency_export(spark, d):
    """Nine lines before the table, seven after it, and a total that goes."""
    where = folder(spark, "agency_export")
    none = F.col("totalvehs") == "0"
    rows = households(spark, d).groupBy("zone_id").agg(F.count_if(none).alias("a"), F.count_if(~none).alias("b"), F.count(F.lit(1)).alias("n"))
    body = rows.select((F.lit(100) + F.col("zone_id").cast("int")).alias("k"), F.concat_ws(",", "zone_id", "a", "b", "n").alias("line"))
    edge = spark.range(9).select(F.col("id").cast("int").alias("k"), F.lit("head, of a kind").alias("line")).unionByName(spark.range(7).select((F.col("id") + 10_000).cast("int").alias("k"), F.lit("foot").alias("line")))
    lines(body.unionByName(edge), where)
    return files.read_export(spark, where, ["zone", "none", "some", "Total"], prefix="cars_")


@query("SELECT CAST(c_custkey % 3 AS VARCHAR) AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_nationkey) AS BIGINT) AS zones FROM customer GROUP BY 1")
def found_runs(spark, d):
    """Files of folders below one another, found by their pattern."""
    where = folder(spark, "found_runs")
    c = t(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 3).cast("string").alias("part"))
    for deep, k in (("", 0), ("in/", 1), ("in/there/", 2)):
        files.write_csv(c.where(F.col("part") == str(k)), f"{where}/{deep}run_{k}")
    got = files.read_runs(spark, where, "part-*.csv")
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_nationkey").cast("long")).alias("zones"))


@query(WITH(HH) + "SELECT dwelltype, hhsize, CAST(count(*) AS BIGINT) AS n FROM hh GROUP BY ALL")
def stored_pools(spark, d):
    where = folder(spark, "stored_pools")
    files.write_pools({"HH-All": C.condense(households(spark, d), ["dwelltype", "hhsize"])}, where)
    return files.read_pools(spark, where, ["HH-All"])["HH-All"].select("dwelltype", "hhsize", F.col("count").alias("n"))


@query(WITH(HH, MARG) + "SELECT DISTINCT zone_id, 0 AS step, 'dwelltype' AS adjusted_att, CAST(sum(value) OVER (PARTITION BY zone_id) AS BIGINT) AS n FROM marg WHERE att = 'dwelltype'")
def step_sink(spark, d):
    """The first population of a run, written as a step and read by its partition."""
    where = folder(spark, "step_sink")
    m, pool = census_hh(spark, d), C.condense(sampled_hh(spark, d), HH_ATTS)
    where = f"{where}/{uuid.uuid4().hex}"  # steps are appended
    files.write_step(saa.initial_population("dwelltype", m, pool, HH_ATTS), where, 0, 0, "dwelltype")
    got = spark.read.parquet(where).where("run = 0 AND step = 0")
    return got.groupBy("zone_id", "step", "adjusted_att").agg(F.count(F.lit(1)).alias("n"))


# Tables over runs


def three_runs(spark, d) -> DataFrame:
    return joins.union_runs({f"run_{k}": S.bernoulli(households(spark, d), 0.5, ["hhid"], k) for k in range(3)})


G = """g AS (SELECT run, zone_id, att, state, count(*) AS value FROM (SELECT run, zone_id, 'dwelltype' AS att, dwelltype AS state FROM runs UNION ALL SELECT run, zone_id, 'hhinc', hhinc FROM runs UNION ALL SELECT run, zone_id, 'totalvehs', totalvehs FROM runs) GROUP BY ALL),
b AS (SELECT run, marg.* FROM marg CROSS JOIN (SELECT DISTINCT run FROM runs)),
e AS (SELECT run, att, state, sqrt(sum(pow(coalesce(b.value, 0) - coalesce(g.value, 0), 2)) / (SELECT count(DISTINCT zone_id) FROM marg)) AS rmse FROM b FULL JOIN g USING (run, zone_id, att, state) GROUP BY run, att, state),
l AS (SELECT run, att, state, sum(value) AS n FROM b GROUP BY ALL), q AS (SELECT run, att, state, sum(value) AS n FROM g GROUP BY ALL)"""
DIST = JSD.format(keys="run, att, ", part="PARTITION BY run, att", a="l", b="q", using="run, att, state", group="GROUP BY run, att").replace("round(sqrt", "(sqrt").replace(", 6) AS jsd", ") AS jsd")


@query(WITH(HH, MARG, RUNS, G) + f"""SELECT run, round(rmse, 6) AS rmse, round(jsd, 6) AS jsd, round(100.0 * (c.k - coalesce(m.k, 0)) / c.k, 6) AS missing_percent, CAST(rare AS BIGINT) AS rare FROM (SELECT run, avg(rmse) AS rmse FROM e GROUP BY run)
JOIN (SELECT run, avg(jsd) AS jsd FROM ({DIST}) GROUP BY run) USING (run) JOIN (SELECT run, count(*) FILTER (hhinc = 'Negative income') AS rare, count(DISTINCT dwelltype || '|' || hhinc || '|' || totalvehs) AS k FROM runs GROUP BY run) m USING (run), (SELECT count(DISTINCT dwelltype || '|' || hhinc || '|' || totalvehs) AS k FROM hh) c""")
def run_summaries(spark, d):
    s = metrics.run_summary(census_hh(spark, d), households(spark, d), three_runs(spark, d), "zone_id", HH_ATTS, ("hhinc", "Negative income"))
    return s.select("run", r6("rmse").alias("rmse"), r6("jsd").alias("jsd"), r6("missing_percent").alias("missing_percent"), "rare")


@query(WITH(HH, MARG, RUNS, G) + "SELECT att, state, " + ", ".join(f"round(max(rmse) FILTER (run = 'run_{k}'), 6) AS run_{k}" for k in range(3)) + " FROM e GROUP BY att, state")
def error_columns(spark, d):
    e = metrics.run_metrics(census_hh(spark, d), three_runs(spark, d), "zone_id", HH_ATTS)
    return analysis.error_columns(e, [f"run_{k}" for k in range(3)]).select("att", "state", *[r6(f"run_{k}").alias(f"run_{k}") for k in range(3)])


@query(WITH(HH) + "SELECT hhid, CASE WHEN row_number() OVER (ORDER BY md5('0|' || CAST(hhid AS VARCHAR)), hhid) <= floor((SELECT count(*) FROM hh) * 0.3 + 0.5) THEN 'a' ELSE 'b' END AS side FROM hh")
def split_sides(spark, d):
    a, b = S.split_exact(households(spark, d), 0.3, ["hhid"])
    return a.select("hhid", F.lit("a").alias("side")).unionByName(b.select("hhid", F.lit("b").alias("side")))


@query(WITH(HH, MARG, *POPS) + "SELECT pair, child, round(sqrt(avg(d * d)), 6) AS score FROM e GROUP BY ALL ORDER BY sqrt(avg(d * d)), pair, child LIMIT 2")
def best_solutions(spark, d):
    from .tracing import crossed_scores

    return evolve.best_solutions(crossed_scores(spark, d), 2, ["pair", "child"])


# What sampling must keep


@query(WITH(HH, MARG) + "SELECT zone_id, state, CAST(value AS BIGINT) AS n FROM marg WHERE att = 'hhinc'")
def pairwise_marginals(spark, d):
    """Where the pool has every combination, all surplus records find a state that lacks some."""
    h, m = households(spark, d), census_hh(spark, d)
    syn = h.withColumn("hhinc", F.when(F.col("hhid") % 3 == 0, "9000+").otherwise(F.col("hhinc"))).select("zone_id", *HH_ATTS)
    got = saa.pairwise_adjust("hhinc", syn, m, HH_ATTS, full_pool(h), ["dwelltype"])
    return got.groupBy("zone_id", F.col("hhinc").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH(HH) + "SELECT hhid, CASE WHEN hhsize = '8+' THEN 8 ELSE CAST(hhsize AS INTEGER) END AS n FROM hh")
def csp_complete(spark, d):
    """Persons that are drawn and those that no pair could serve add up to the household's size."""
    h = households(spark, d)
    pools = csp.pool_pairs(h, R.first_is_main(persons(spark, d)), ["dwelltype", "hhsize"], ["sex"])
    people, short = csp.run(h, pools, ["dwelltype", "hhsize"], ["sex"], backtrack=True)
    each = people.select("hhid", F.lit(1).cast("long").alias("n")).unionByName(short.select("hhid", "n"))
    n = each.groupBy("hhid").agg(F.sum("n").cast("int").alias("n"))
    return n.join(h.select("hhid", "hhsize"), "hhid").select("hhid", F.when(F.col("hhsize") == "8+", F.least("n", F.lit(8))).otherwise(F.col("n")).alias("n"))


REAL = f"""n AS (SELECT hhid, {COUNTS} FROM pm GROUP BY hhid), f AS (SELECT *, n_Parent + n_Grandparent + n_Grandchild + n_Sibling AS wide, n_Spouse + n_Child + n_Parent + n_Grandparent + n_Grandchild + n_Sibling AS fam, n_Main + n_Spouse + n_Child + n_Parent + n_Grandparent + n_Grandchild + n_Sibling + n_Others AS members FROM n JOIN hh USING (hhid)),
y AS (SELECT hhid, {TYPE} AS hh_type, hhsize FROM f WHERE CASE WHEN hhsize = '8+' THEN members >= 8 ELSE members = CAST(hhsize AS INTEGER) END),
k AS (SELECT hh_type, count(*) AS c FROM y WHERE CASE hh_type WHEN 'Single Person' THEN hhsize = '1' WHEN 'Couple with Child' THEN hhsize >= '3' ELSE hhsize >= '2' END GROUP BY hh_type),
v AS (SELECT hh_type, c / (SELECT sum(c) FROM k) * 300 AS v FROM k)"""


@query(WITH(HH, PP, PM, REAL) + "SELECT hh_type, CAST(floor(v) + CASE WHEN row_number() OVER (ORDER BY round(v - floor(v), 9) DESC, hh_type) <= round(sum(v) OVER ()) - sum(floor(v)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM v QUALIFY n > 0")
def typed_households(spark, d):
    """300 households of the surveyed kinds whose sizes fit their members and types, by type."""
    pools = csp.pool_pairs(households(spark, d), R.first_is_main(persons(spark, d)), ["dwelltype", "hhsize"], ["sex"])
    numbers = [f"n_{r}" for r in R.RELATIONS]
    pool = pools["HH-Main"].groupBy("HH_dwelltype", "HH_hhsize", *numbers).agg(F.sum("count").alias("count"))
    got = csp.typed_households(pool, 300, ["HH_dwelltype", "HH_hhsize", *numbers], "HH_hhsize")
    return got.groupBy("hh_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(unnest(range(1, 401)) AS BIGINT) AS n, true AS met")
def bn_rejection(spark, d):
    """400 samples of a network over the households, all of which meet the condition."""
    h = households(spark, d)
    net = {"dwelltype": (), "hhinc": ("dwelltype",), "totalvehs": ("hhinc",)}
    met = (F.col("dwelltype") == "BUILDING") & (F.col("totalvehs") != "0")
    got = bayes.rejection_pool(spark, 400, net, bayes.learn_parameters(h, net), met)
    return C.row_index(got, ["id"]).select(F.col("row_id").alias("n"), met.alias("met"))


@query(BOTH + "SELECT CAST(sum(diff) AS BIGINT) AS missing FROM d WHERE att = 'hhinc'")
def missing_agents(spark, d):
    """How many agents a sample lacks, from any attribute of the differences."""
    return saa.state_differences("hhinc", sampled_hh(spark, d).select("zone_id", *HH_ATTS), census_hh(spark, d)).agg(F.sum("diff").cast("long").alias("missing"))

