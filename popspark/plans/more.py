"""More of the operators as queries: those that sit under larger ones, and invariants of those that SQL cannot state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as A
from ..operators import analysis, bayes, census, condense as C, csp, evolve, ipf, ipu, joins, metrics, relations as R, saa, sampling as S
from ..sources import files
from .catalog import BOTH, HH, HH_ATTS, MARG, PM, PP, REC, SMARG, SYN, U, WITH, census_hh, households, persons, query, r6, records, sampled_hh, t

# Expressions


@query("SELECT o_orderkey AS persid, o_orderpriority AS label FROM orders WHERE o_orderpriority <> '5-LOW'")
def dropped_columns_and_nulls(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("persid"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("label"), F.lit(1).alias("x"))
    return o.drop("x", "not there").na.drop()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def all_as_strings(spark, d):
    return A.as_strings(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS row_id FROM part")
def surrogate_ids(spark, d):
    return C.row_index(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"]).select("p_partkey", "row_id")


@query("""SELECT c_custkey AS hhid, kind, size, CASE kind WHEN 'Single Person' THEN n = 1 WHEN 'Couple with Child' THEN n >= 3 ELSE n >= 2 END AS allowed FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Single Person' WHEN 1 THEN 'Couple with Child' ELSE 'Couple Only' END AS kind,
CASE WHEN c_custkey % 10 + 1 >= 8 THEN '8+' ELSE CAST(c_custkey % 10 + 1 AS VARCHAR) END AS size, least(c_custkey % 10 + 1, 8) AS n FROM customer)""")
def type_and_size(spark, d):
    k = F.col("hhid") % 3
    h = households(spark, d).withColumn("kind", F.when(k == 0, "Single Person").when(k == 1, "Couple with Child").otherwise("Couple Only"))
    return h.select("hhid", "kind", F.col("hhsize").alias("size"), A.type_allows_size(F.col("kind"), F.col("hhsize")).alias("allowed"))


@query(WITH(HH) + """SELECT hhid, CAST(hhsize IN ('3', '4', '8+') AS INTEGER) AS big, CAST(bal >= 1000.5 AND dwelltype <> 'BUILDING' OR totalvehs = '0' AS INTEGER) AS rich, CAST(bal < 0 AS INTEGER) AS debt FROM hh""")
def control_expressions(spark, d):
    controls = [("big", "households.bal > 0"), ("big", "households.hhsize == '3' | (households.hhsize == '4') | hhsize == \"8+\""), ("rich", "(households.bal >= 1000.5) & (households.dwelltype != 'BUILDING') | totalvehs == '0'"), ("debt", "bal < 0")]
    return A.apply_controls(households(spark, d), controls, "households").select("hhid", "big", "rich", "debt")


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber > 2 THEN l_tax END, 0) + l_discount + coalesce(CASE WHEN l_linenumber < 5 THEN l_tax END, 0), 6) AS total FROM lineitem")
def horizontal_sum(spark, d):
    x = t(spark, d, "lineitem").withColumns({"a": F.when(F.col("l_linenumber") > 2, F.col("l_tax")), "b": F.when(F.col("l_linenumber") < 5, F.col("l_tax"))})
    return x.select("l_orderkey", "l_linenumber", r6(C.row_sum("a", "l_discount", "b")).alias("total"))


@query(WITH(HH, MARG) + "SELECT zone_id, CAST(sum(value) + 55 AS BIGINT) AS total FROM marg WHERE att = 'totalvehs' GROUP BY zone_id")
def total_by_size(spark, d):
    return census.households_by_size(census_hh(spark, d), "totalvehs", 55)


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey, n_nationkey - n_regionkey AS rest FROM nation WHERE n_regionkey > 1")
def derived_integers(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")).alias("n_regionkey"))
    return census.derived(census.to_integers(n, ["n_regionkey"]), {"rest": F.col("n_nationkey") - F.col("n_regionkey")})


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 2")
def zones_of_a_list(spark, d):
    zones = t(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return census.zones_present(t(spark, d, "customer"), zones, "c_nationkey").select("c_custkey")


# Joins and order


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def pair_by_id(spark, d):
    return joins.pair_by_id(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")


@query(WITH(PP) + "SELECT persid, CASE WHEN income > 100000 THEN income END AS _weight FROM pp")
def attached_weights(spark, d):
    p = persons(spark, d)
    return R.attach_weights(p.select("persid"), p.where("income > 100000").select("persid", F.col("income").alias("_weight")), "persid")


@query(WITH(HH, PP) + "SELECT persid, hhid FROM pp WHERE hhid IN (SELECT hhid FROM hh WHERE hhsize = '3')")
def sub_population(spark, d):
    h = households(spark, d)
    return joins.sub_population(h, persons(spark, d), h.where("hhsize = '3'"))[1].select("persid", "hhid")


@query(WITH(HH) + "SELECT hhid FROM (SELECT hhid, row_number() OVER (ORDER BY md5('h|' || CAST(hhid AS VARCHAR)), hhid) AS n FROM hh) WHERE n <= (SELECT floor(count(*) * 0.3) FROM hh)")
def shuffled_head(spark, d):
    return evolve.shuffled_head(households(spark, d), 0.3, ["hhid"], "h").select("hhid")


SHARES = "(SELECT att, state, sum(value) AS n, sum(sum(value)) OVER (PARTITION BY att) AS m FROM {} GROUP BY att, state)"


@query(BOTH + f"SELECT a.att, round(-sum(a.n / a.m * log2(b.n / b.m)), 6) AS bits FROM {SHARES.format('smarg')} a JOIN {SHARES.format('marg')} b USING (att, state) GROUP BY a.att ORDER BY bits LIMIT 2")
def best_attributes(spark, d):
    return evolve.best_attributes(sampled_hh(spark, d), households(spark, d), HH_ATTS, 2).withColumn("bits", r6("bits"))


@query(WITH(HH, MARG) + "SELECT att, CAST(row_number() OVER (ORDER BY n DESC, att) AS INTEGER) AS place FROM (SELECT att, count(DISTINCT state) AS n FROM marg GROUP BY att)")
def attribute_order(spark, d):
    return spark.createDataFrame([(a, i) for i, a in enumerate(saa.first_order(census_hh(spark, d)), 1)], "att string, place int")


# Sampling


@query(WITH(HH) + "SELECT zone_id, hhid FROM (SELECT zone_id, hhid, CAST(zone_id AS INTEGER) AS want, row_number() OVER (PARTITION BY zone_id ORDER BY md5('5|' || CAST(hhid AS VARCHAR)), hhid) AS k FROM hh) WHERE k <= want")
def sampled_ids(spark, d):
    return S.sample_count(households(spark, d), ["zone_id"], F.col("zone_id").cast("int"), ["hhid"], 5).select("zone_id", "hhid")


@query(WITH(REC) + "SELECT l_returnflag, count(*) * 2 AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, qty, disc FROM rec) GROUP BY l_returnflag")
def inflated_weights(spark, d):
    r = records(spark, d).select("l_returnflag", "l_linestatus", "qty", "disc").distinct().withColumn("w", F.lit(2.7))
    return C.inflate_weights(r, "w").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(WITH(HH) + "SELECT zone_id, hhinc, count(*) AS n FROM (SELECT zone_id, hhinc, unnest(range(n)) FROM (SELECT zone_id, hhinc, CAST(floor(v) + CASE WHEN row_number() OVER (PARTITION BY zone_id ORDER BY round(v - floor(v), 9) DESC, hhinc) <= round(sum(v) OVER (PARTITION BY zone_id)) - sum(floor(v)) OVER (PARTITION BY zone_id) THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT zone_id, hhinc, count(*) * 0.37 AS v FROM hh GROUP BY ALL))) GROUP BY ALL")
def agents_of_a_joint(spark, d):
    v = households(spark, d).groupBy("zone_id", "hhinc").agg((F.count(F.lit(1)) * F.lit(0.37)).alias("v"))
    return S.agents_from_weights(v, "v", ["zone_id"], ["hhinc"]).groupBy("zone_id", "hhinc").agg(F.count(F.lit(1)).alias("n"))


@query(WITH(HH, REC) + f"""SELECT hhid, qty FROM (SELECT hhid, zone_id, {U('3', 'hhid')} AS u FROM hh) JOIN (SELECT zone_id, qty, sum(n) OVER (PARTITION BY zone_id ORDER BY qty) - n AS lo, sum(n) OVER (PARTITION BY zone_id ORDER BY qty) AS hi, sum(n) OVER (PARTITION BY zone_id) AS total
FROM (SELECT zone_id, qty, count(*) AS n FROM rec WHERE qty < '3' GROUP BY ALL)) USING (zone_id) WHERE u * total >= lo AND u * total < hi""")
def conditioned_draw(spark, d):
    pool = records(spark, d).groupBy("zone_id", "qty").agg(F.count(F.lit(1)).alias("n"))
    c = households(spark, d).select("hhid", "zone_id").join(pool, "zone_id")
    return S.conditioned_counts(c, "hhid", F.col("qty") < "3", "n", ["qty"], 3).select("hhid", "qty")


# Fitting: what must hold whatever the draws are


def full_pool(h):
    """Every combination of the states that occur, once."""
    states = bayes.state_names(h, HH_ATTS)
    return ipf.joint_states(h.sparkSession, states).withColumn("count", F.lit(1).cast("long"))


@query(WITH(HH, MARG) + "SELECT zone_id, att, state, value FROM marg WHERE att <> 'totalvehs'")
def saa_adjusted_marginals(spark, d):
    h, m = households(spark, d), census_hh(spark, d)
    pool = full_pool(h)
    syn = saa.adjust_attribute("hhinc", saa.initial_population("dwelltype", m, pool, HH_ATTS), m, pool, HH_ATTS, ["dwelltype"])
    return C.marginals(syn, "zone_id", ["dwelltype", "hhinc"])


@query(WITH(HH, MARG) + "SELECT zone_id, CAST(sum(value) AS DOUBLE) AS placed FROM marg WHERE att = 'hhinc' GROUP BY zone_id")
def saa_placed(spark, d):
    out = saa.run(census_hh(spark, d), C.condense(sampled_hh(spark, d), HH_ATTS), HH_ATTS, runs=2, extra_removed=0.3)
    return out.groupBy("zone_id").agg(F.count(F.lit(1)).cast("double").alias("placed"))


@query(WITH(HH, MARG) + "SELECT zone_id, dwelltype, hhinc, totalvehs, CAST(count(*) AS BIGINT) AS \"count\" FROM hh GROUP BY ALL")
def feasible_cells(spark, d):
    h = households(spark, d)
    counts = C.condense(h, ["zone_id", *HH_ATTS])
    cells = saa.feasible_cells(counts, C.condense(h, HH_ATTS), ["dwelltype", "hhinc"], "totalvehs")
    return cells.where("count > 0").select("zone_id", *HH_ATTS, "count")


TWICE = "twin AS (SELECT zone_id, dwelltype, hhinc, totalvehs, count(*) + count(*) FILTER (dwelltype = 'BUILDING') AS n FROM hh GROUP BY ALL), spare AS (SELECT zone_id, count(*) FILTER (dwelltype = 'BUILDING') AS extra FROM hh GROUP BY zone_id)"


@query(WITH(HH, TWICE) + "SELECT zone_id, 0 AS over, CAST(extra AS BIGINT) AS removed FROM spare")
def trimmed_surplus(spark, d):
    """A population in which one type of dwelling occurs twice loses just these, zone by zone, and is nowhere over the census."""
    h, m = households(spark, d), census_hh(spark, d)
    syn = h.unionByName(h.where("dwelltype = 'BUILDING'")).select("zone_id", *HH_ATTS)
    kept = C.inflate(saa.trimmed(syn, m, HH_ATTS)).select("zone_id", *HH_ATTS)
    over = C.differences(C.marginals(kept, "zone_id", HH_ATTS), m, ("zone_id", "att", "state")).groupBy("zone_id").agg(F.count_if(F.col("diff") > 0).cast("int").alias("over"))
    n = lambda df, name: df.groupBy("zone_id").agg(F.count(F.lit(1)).alias(name))
    lost = n(syn, "__a").join(n(kept, "__b"), "zone_id", "left").select("zone_id", (F.col("__a") - F.coalesce("__b", F.lit(0))).alias("removed"))
    return lost.join(over, "zone_id", "left").select("zone_id", F.coalesce("over", F.lit(0)).alias("over"), "removed")


@query(WITH(HH, SYN, MARG, SMARG) + "SELECT zone_id, att, state, coalesce(m.value, 0) - coalesce(s.value, 0) AS value FROM marg m FULL JOIN smarg s USING (zone_id, att, state)")
def marginals_left(spark, d):
    kept, left = saa.check_fit(sampled_hh(spark, d).select("zone_id", *HH_ATTS), census_hh(spark, d), HH_ATTS)
    return left.select("zone_id", "att", "state", "value")


@query(WITH(HH, MARG) + ", z AS (SELECT DISTINCT zone_id FROM marg), s AS (SELECT DISTINCT att, state FROM marg WHERE att <> 'hhinc') SELECT zone_id, att, state, round(greatest(coalesce(value, 0), 0.01), 1) AS value FROM z CROSS JOIN s LEFT JOIN marg USING (zone_id, att, state)")
def ipf_joint_marginals(spark, d):
    """Both marginals hold after the fit, the one that is swept first as well."""
    h = households(spark, d)
    states = {a: bayes.state_names(h, [a])[a] for a in ("dwelltype", "totalvehs")}
    w = ipf.fit_joint(spark, states, C.condense(sampled_hh(spark, d), list(states)), C.marginals(h, "zone_id", list(states)), max_sweeps=60, tolerance=1e-4)
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.col(a).alias("state")) for a in states])).alias("x")
    return w.select("zone_id", "weight", cells).groupBy("zone_id", "x.att", "x.state").agg(F.round(F.sum("weight"), 1).alias("value"))


@query(WITH(HH, PP, PM) + "SELECT hhid, 1 AS mains FROM hh WHERE (dwelltype, hhsize) IN (SELECT dwelltype, hhsize FROM hh JOIN pm USING (hhid))")
def csp_mains(spark, d):
    h = households(spark, d)
    pools = csp.pool_pairs(h, R.first_is_main(persons(spark, d)), ["dwelltype", "hhsize"], ["sex"])
    people, _ = csp.run(h, pools, ["dwelltype", "hhsize"], ["sex"])
    return people.groupBy("hhid").agg(F.count_if(F.col("relationship") == "Main").cast("int").alias("mains")).where("mains > 0")


@query(WITH(HH) + "SELECT hhid, CASE WHEN hhsize = '8+' THEN 8 ELSE CAST(hhsize AS INTEGER) END AS least, hhsize <> '8+' AS exact FROM hh")
def csp_bn_sizes(spark, d):
    h = households(spark, d)
    pools = csp.pool_pairs(h, R.first_is_main(persons(spark, d)), ["dwelltype", "hhsize"], ["sex"])
    people, _ = csp.run(h, pools, ["dwelltype", "hhsize"], ["sex"], use_bn=True)
    n = people.groupBy("hhid").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return h.select("hhid", "hhsize").join(n, "hhid").select("hhid", F.when(F.col("hhsize") == "8+", F.least("n", F.lit(8))).otherwise(F.col("n")).alias("least"), (F.col("hhsize") != "8+").alias("exact"))


@query(WITH(HH) + ", r AS (SELECT 0.1 * k AS rate FROM range(1, 11) g(k)), s AS (SELECT rate, hh.* FROM r JOIN hh ON CAST('0x' || substr(md5(CAST(rate AS VARCHAR) || '|' || CAST(hhid AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < CAST(rate AS DOUBLE)), " + MARG.replace("marg AS", "f AS", 1) + """,
g AS (SELECT rate, zone_id, dwelltype AS state, count(*) / CAST(rate AS DOUBLE) AS v FROM s GROUP BY rate, zone_id, dwelltype), b AS (SELECT rate, zone_id, state, value FROM f CROSS JOIN r WHERE att = 'dwelltype')
SELECT CAST(rate AS DOUBLE) AS rate, state, round(sqrt(sum(pow(coalesce(b.value, 0) - coalesce(g.v, 0), 2)) / (SELECT count(DISTINCT zone_id) FROM hh)), 4) AS rmse FROM b FULL JOIN g USING (rate, zone_id, state) GROUP BY rate, state""")
def rmse_by_rate(spark, d):
    out = metrics.rmse_over_rates(households(spark, d), "zone_id", ["dwelltype"], [k / 10 for k in range(1, 11)], ["hhid"], "rate")
    return out.select("rate", "state", F.round("rmse", 4).alias("rmse"))


@query(WITH(HH) + "SELECT att, state FROM (SELECT DISTINCT 'dwelltype' AS att, dwelltype AS state FROM hh UNION SELECT DISTINCT 'hhinc', hhinc FROM hh)")
def stored_states(spark, d):
    where = files.artefact_folder(spark, "stored_states")
    files.write_states(spark, bayes.state_names(households(spark, d), ["dwelltype", "hhinc"]), where)
    return spark.createDataFrame([(a, s) for a, every in files.read_states(spark, where).items() for s in every], "att string, state string")


# Analysis


@query(WITH(HH) + "SELECT DISTINCT hhinc, CASE WHEN hhinc LIKE '%Negative%' THEN -1 WHEN hhinc LIKE '%Nil%' THEN 0 ELSE CAST(regexp_extract(hhinc, '([0-9]+)', 1) AS INTEGER) END AS sort_key, CASE hhinc WHEN '1-999' THEN '$1-999' WHEN '1000-2999' THEN '$1,000-2,999' WHEN '3000-5999' THEN '$3,000-5,999' WHEN '6000-8999' THEN '$6,000-8,999' ELSE hhinc END AS label FROM hh")
def income_labels(spark, d):
    return households(spark, d).select("hhinc").distinct().select("hhinc", A.income_to_int(F.col("hhinc")).cast("int").alias("sort_key"), A.income_label(F.col("hhinc")).alias("label"))


RMSE_SQL = "SELECT att, state, sqrt(sum(diff * diff) / (SELECT count(DISTINCT zone_id) FROM d)) AS rmse FROM d GROUP BY ALL"


def attribute_errors(spark, d):
    return metrics.rmse(census_hh(spark, d), C.marginals(sampled_hh(spark, d), "zone_id", HH_ATTS)).withColumn("method", F.lit("a"))


@query(BOTH + f"SELECT 'a' AS method, state, round(rmse, 6) AS rmse, CASE WHEN state LIKE '%Negative%' THEN -1 WHEN state LIKE '%Nil%' THEN 0 ELSE CAST(regexp_extract(state, '([0-9]+)', 1) AS INTEGER) END AS band_low FROM ({RMSE_SQL}) WHERE att = 'hhinc'")
def income_errors(spark, d):
    return analysis.income_errors(attribute_errors(spark, d)).select("method", "state", r6("rmse").alias("rmse"), "band_low")


@query(BOTH + f"SELECT 'a' AS method, round(avg(rmse), 6) AS x, round(avg(rmse) * 2, 6) AS y FROM ({RMSE_SQL})")
def error_points(spark, d):
    e = attribute_errors(spark, d)
    p = analysis.error_points(e, e.select("method", "att", (F.col("rmse") * 2).alias("jsd")), ["method"])
    return p.select("method", r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT c_nationkey % 5 AS loop, CAST(sum(c_custkey) AS BIGINT) AS \"left\" FROM customer GROUP BY 1")
def convergence(spark, d):
    return analysis.convergence(t(spark, d, "customer").withColumn("loop", F.col("c_nationkey") % 5), "loop", "c_custkey")


@query(WITH(PP, PM) + "SELECT m.age AS main_age, c.age AS child_age, count(*) AS \"count\" FROM pm m JOIN pm c USING (hhid) WHERE m.relationship = 'Main' AND c.relationship = 'Child' AND m.age - c.age >= 15 GROUP BY ALL")
def filtered_pairs(spark, d):
    p = R.first_is_main(persons(spark, d))
    side = lambda r, name: p.where(F.col("relationship") == r).select("hhid", F.col("age").alias(name))
    pairs = C.condense(side("Main", "main_age").join(side("Child", "child_age"), "hhid"), ["main_age", "child_age"])
    return csp.filter_pairs(pairs, "main_age", "child_age", 15)


@query(WITH(HH) + "SELECT zone_id, count(*) AS n FROM hh WHERE zone_id < '2' GROUP BY zone_id")
def imputed_zones(spark, d):
    h = households(spark, d)
    net = {"dwelltype": (), "hhinc": ("dwelltype",), "totalvehs": ("hhinc",)}
    totals = h.groupBy("zone_id").agg(F.count(F.lit(1)).alias("total"))
    made = bayes.impute_zones(totals, h.where("zone_id >= '2'"), net, bayes.learn_parameters(h, net))
    return made.na.drop().groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


@query(WITH(HH, PP, PM) + "SELECT hhid, 1 AS mains FROM hh WHERE (dwelltype, hhsize) IN (SELECT dwelltype, hhsize FROM hh JOIN pm USING (hhid))")
def csp_retries_mains(spark, d):
    h = households(spark, d)
    pools = csp.pool_pairs(h, R.first_is_main(persons(spark, d)), ["dwelltype", "hhsize"], ["sex"])
    people, _ = csp.run(h, pools, ["dwelltype", "hhsize"], ["sex"], retries=1)
    return people.groupBy("hhid").agg(F.count_if(F.col("relationship") == "Main").cast("int").alias("mains")).where("mains > 0")


@query(WITH(HH, SYN) + "SELECT dwelltype, 3 * count(*) FILTER (totalvehs = '0') + count(*) AS n FROM syn GROUP BY dwelltype")
def ipu_own_sample(spark, d):
    """Weights of a sample fitted to counts that it does not have, three more for each household without vehicles."""
    s = sampled_hh(spark, d).withColumn("zone_id", F.lit("z"))
    p = persons(spark, d).join(s.select("hhid"), "hhid", "left_semi")
    inc = ipu.incidence(s, p, "hhid", ["dwelltype"], ["sex"]).where("level = 'household'")
    targets = s.groupBy("zone_id", F.lit("dwelltype").alias("att"), F.col("dwelltype").alias("state")).agg((3 * F.count_if(F.col("totalvehs") == "0") + F.count(F.lit(1))).alias("value")).withColumn("level", F.lit("household"))
    w = ipu.run(inc, targets, iterations=20).select("zone_id", "hhid", "weight")
    return w.join(s.select("hhid", "dwelltype"), "hhid").groupBy("dwelltype").agg(F.round(F.sum("weight")).cast("long").alias("n"))
