"""The operators as queries over the driver tables, with SQL that gives the same rows.

Zones are nations, households are customers, persons are orders and pool
records are line items; the census is the full table and a synthetic
population a keyed sample of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import attributes as A
from ..operators import analysis, bayes, census, condense as C, csp, evolve, ipf, ipu, joins, metrics, relations as R, saa, sampling as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BANDS = ["1-999", "1000-2999", "3000-5999", "6000-8999", "9000+"]
HH_ATTS = ["dwelltype", "hhinc", "totalvehs"]
RECORD_ATTS = ["l_returnflag", "l_linestatus", "qty", "disc"]
ROLE = {"1-URGENT": "Spouse", "2-HIGH": "Child", "3-MEDIUM": "Others", "4-NOT SPECIFIED": "Sibling", "5-LOW": "Grandchild"}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def households(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("hhid"), F.col("c_nationkey").cast("string").alias("zone_id"), F.col("c_mktsegment").alias("dwelltype"),
        A.band(F.floor("c_acctbal"), BANDS).alias("hhinc"), A.top_code((F.col("c_custkey") % 7).cast("int"), 4).alias("totalvehs"),
        A.household_size((F.col("c_custkey") % 10 + 1).cast("int")).alias("hhsize"), F.col("c_acctbal").alias("bal"),
    )


def persons(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("persid"), F.col("o_custkey").alias("hhid"), role.alias("relationship"), (F.col("o_orderkey") % 110).cast("int").alias("age"), F.when(F.col("o_orderkey") % 2 == 0, "M").otherwise("F").alias("sex"), F.col("o_totalprice").alias("income"))


def records(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem")
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("zone_id"))
    y = x.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).cast("string").alias("qty"), F.floor(F.round(F.col("l_discount") * 100) / 4).cast("string").alias("disc"))
    return y.join(s, F.col("l_suppkey") == F.col("s_suppkey"))


def census_hh(spark: SparkSession, d: str) -> DataFrame:
    return C.marginals(households(spark, d), "zone_id", HH_ATTS)


def sampled_hh(spark: SparkSession, d: str, rate: float = 0.5) -> DataFrame:
    return S.bernoulli(households(spark, d), rate, ["hhid"], "s")


HH = """hh AS (SELECT c_custkey AS hhid, CAST(c_nationkey AS VARCHAR) AS zone_id, c_mktsegment AS dwelltype, c_acctbal AS bal,
  CASE WHEN floor(c_acctbal) < 0 THEN 'Negative income' WHEN floor(c_acctbal) = 0 THEN 'Nil income' WHEN floor(c_acctbal) BETWEEN 1 AND 999 THEN '1-999'
  WHEN floor(c_acctbal) BETWEEN 1000 AND 2999 THEN '1000-2999' WHEN floor(c_acctbal) BETWEEN 3000 AND 5999 THEN '3000-5999' WHEN floor(c_acctbal) BETWEEN 6000 AND 8999 THEN '6000-8999' ELSE '9000+' END AS hhinc,
  CASE WHEN c_custkey % 7 < 4 THEN CAST(c_custkey % 7 AS VARCHAR) ELSE '4+' END AS totalvehs,
  CASE WHEN c_custkey % 10 + 1 >= 8 THEN '8+' ELSE CAST(c_custkey % 10 + 1 AS VARCHAR) END AS hhsize FROM customer)"""
PP = """pp AS (SELECT o_orderkey AS persid, o_custkey AS hhid, CASE o_orderpriority WHEN '1-URGENT' THEN 'Spouse' WHEN '2-HIGH' THEN 'Child' WHEN '3-MEDIUM' THEN 'Others'
  WHEN '4-NOT SPECIFIED' THEN 'Sibling' ELSE 'Grandchild' END AS relationship, CAST(o_orderkey % 110 AS INTEGER) AS age, CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, o_totalprice AS income FROM orders)"""
PM = "pm AS (SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY hhid ORDER BY persid) = 1 THEN 'Main' ELSE relationship END AS relationship) FROM pp)"
REC = """rec AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) AS qty,
  CAST(CAST(floor(round(l_discount * 100) / 4) AS BIGINT) AS VARCHAR) AS disc, CAST(s_nationkey AS VARCHAR) AS zone_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
MARG = """marg AS (SELECT zone_id, att, state, count(*) AS value FROM (SELECT zone_id, 'dwelltype' AS att, dwelltype AS state FROM hh UNION ALL SELECT zone_id, 'hhinc', hhinc FROM hh UNION ALL SELECT zone_id, 'totalvehs', totalvehs FROM hh) GROUP BY ALL)"""


def U(seed: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"


SYN = f"syn AS (SELECT * FROM hh WHERE {U('s', 'hhid')} < 0.5)"
SMARG = MARG.replace("marg AS", "smarg AS", 1).replace("FROM hh", "FROM syn")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def WITH(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Projection, filter and scalar expressions


@query(WITH(HH) + "SELECT hhid, hhinc, totalvehs, hhsize FROM hh")
def band_and_top_code(spark, d):
    return households(spark, d).select("hhid", "hhinc", "totalvehs", "hhsize")


@query("SELECT o_orderkey AS persid, CASE WHEN o_orderkey % 110 < 100 THEN CAST((o_orderkey % 110) // 10 * 10 AS VARCHAR) || '-' || CAST((o_orderkey % 110) // 10 * 10 + 9 AS VARCHAR) ELSE '100+' END AS age_group FROM orders")
def age_decade(spark, d):
    return persons(spark, d).select("persid", A.age_decade(F.col("age")).alias("age_group"))


@query("SELECT o_orderkey AS persid, CASE WHEN o_orderkey % 110 > 0 THEN '(' || CAST(((o_orderkey % 110) + 9) // 10 * 10 - 10 AS VARCHAR) || ', ' || CAST(((o_orderkey % 110) + 9) // 10 * 10 AS VARCHAR) || ']' END AS age_cut FROM orders")
def half_open_cut(spark, d):
    return persons(spark, d).select("persid", A.half_open_cut(F.col("age")).alias("age_cut"))


@query("SELECT c_custkey AS hhid, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS merged, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'Others' ELSE c_mktsegment END AS collapsed FROM customer")
def merge_category(spark, d):
    c = t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("hhid"), A.merge_states(F.col("c_mktsegment"), {"FURNITURE": "HOUSEHOLD"}).alias("merged"), A.collapse(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]).alias("collapsed"))


@query("""SELECT persid, CASE WHEN label LIKE '%Negative%' THEN -1 WHEN label LIKE '%Zero%' THEN 0 WHEN label LIKE '%Missing%' THEN -2 ELSE CAST(regexp_extract(label, '\\$([0-9]+)', 1) AS INTEGER) END AS income
FROM (SELECT o_orderkey AS persid, CASE o_orderkey % 5 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Zero' WHEN 2 THEN 'Missing/Refused' WHEN 3 THEN '$200-399 p.w.' ELSE '$2000+ p.w.' END AS label FROM orders)""")
def income_to_int(spark, d):
    k = F.col("o_orderkey") % 5
    label = F.when(k == 0, "Negative").when(k == 1, "Zero").when(k == 2, "Missing/Refused").when(k == 3, "$200-399 p.w.").otherwise("$2000+ p.w.")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("persid"), A.income_to_int(label).cast("int").alias("income"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber > 1 THEN l_tax END, 0) + coalesce(CASE WHEN l_linenumber < 6 THEN l_discount END, 0), 6) AS weight FROM lineitem")
def summed_weights(spark, d):
    x = t(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", r6(A.total_weight(F.when(F.col("l_linenumber") > 1, F.col("l_tax")), F.when(F.col("l_linenumber") < 6, F.col("l_discount")))).alias("weight"))


@query("SELECT n_nationkey, upper(n_name) AS name, regexp_replace(n_name || ' (old) x', '\\(.*\\)|\\s', '', 'g') AS clean, 'hhinc' AS att, CAST(n_regionkey AS VARCHAR) AS state, n_regionkey + 1 AS loop, n_regionkey * 5 + 3 AS step FROM nation")
def parsed_names(spark, d):
    n = t(spark, d, "nation")
    att, state = A.attribute_state(F.concat(F.lit("('hhinc', '"), F.col("n_regionkey").cast("string"), F.lit("')")))
    loop, step = A.step_numbers(F.concat(F.lit("run_"), F.col("n_regionkey").cast("string"), F.lit("_adjusted_2_x")))
    return n.select("n_nationkey", F.upper("n_name").alias("name"), A.strip_pattern(F.concat("n_name", F.lit(" (old) x"))).alias("clean"), att.alias("att"), state.alias("state"), loop.alias("loop"), step.alias("step"))


@query(WITH(PP, PM) + "SELECT persid, hhid, relationship FROM pm WHERE hhid NOT IN (SELECT hhid FROM pm WHERE income > 490000)")
def exclude_household_by_member(spark, d):
    p = R.first_is_main(persons(spark, d))
    return joins.households_without_member(p, F.col("income") > 490000).select("persid", "hhid", "relationship")


@query(WITH(HH, PP) + "SELECT hhid, hhsize, n AS members, CASE WHEN hhsize = '8+' THEN n >= 8 ELSE n = CAST(hhsize AS INTEGER) END AS matches FROM hh JOIN (SELECT hhid, count(*) AS n FROM pp GROUP BY hhid) USING (hhid)")
def hhsize_crosscheck(spark, d):
    n = persons(spark, d).groupBy("hhid").agg(F.count(F.lit(1)).alias("members"))
    return households(spark, d).join(n, "hhid").select("hhid", "hhsize", "members", A.size_matches(F.col("hhsize"), F.col("members")).alias("matches"))


@query("SELECT c_custkey AS hhid, c_mktsegment AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS code FROM customer WHERE c_custkey BETWEEN 10 AND 90 OR c_custkey BETWEEN 200 AND 300")
def dictionary_lookup(spark, d):
    c = t(spark, d, "customer").where(A.in_ranges(F.col("c_custkey"), [(10, 90), (200, 300)]))
    return A.lookup(c.select(F.col("c_custkey").alias("hhid"), F.col("c_mktsegment").alias("name")), "name", {"BUILDING": "B", "MACHINERY": "M"}, "code")


# Relationships


@query(WITH(PP, PM) + "SELECT hhid, persid, age, relationship FROM (SELECT *, row_number() OVER (PARTITION BY hhid ORDER BY income DESC, (relationship = 'Main') DESC, persid) AS k FROM pm) WHERE k = 1")
def top_earner(spark, d):
    return R.top_earner(R.first_is_main(persons(spark, d))).where("is_top").select("hhid", "persid", "age", "relationship")


@query(WITH(PP, PM) + """SELECT hhid, bool_or(coalesce((relationship IN ('Child', 'Parent') AND abs(age - m) < 15) OR (relationship IN ('Grandchild', 'Grandparent') AND abs(age - m) < 33), false)) AS implausible
FROM (SELECT *, max(CASE WHEN relationship = 'Main' THEN age END) OVER (PARTITION BY hhid) AS m FROM pm) GROUP BY hhid""")
def implausible_households(spark, d):
    return R.implausible(R.first_is_main(persons(spark, d)))


RELABEL = """, tp AS (SELECT *, row_number() OVER (PARTITION BY hhid ORDER BY income DESC, (relationship = 'Main') DESC, persid) = 1 AS is_top FROM pm),
w AS (SELECT *, max(CASE WHEN is_top THEN relationship END) OVER h AS t_rel, max(CASE WHEN is_top THEN age END) OVER h AS t_age, max(CASE WHEN is_top THEN sex END) OVER h AS t_sex, max(CASE WHEN relationship = 'Main' THEN age END) OVER h AS m_age FROM tp WINDOW h AS (PARTITION BY hhid)),
i AS (SELECT *, bool_or(coalesce((relationship IN ('Child', 'Parent') AND abs(age - m_age) < 15) OR (relationship IN ('Grandchild', 'Grandparent') AND abs(age - m_age) < 33), false)) OVER (PARTITION BY hhid) AS odd,
  relationship = 'Others' AND NOT is_top AND age > 16 AND t_age > 16 AND abs(age - t_age) <= 20 AND sex <> t_sex AS fits, relationship = 'Child' AND age - t_age >= 15 AS of_age FROM w),
s AS (SELECT *, fits AND row_number() OVER (PARTITION BY hhid ORDER BY fits DESC, persid) = 1 AS sp, coalesce(bool_or(of_age) OVER (PARTITION BY hhid ORDER BY persid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM i),
r AS (SELECT persid, hhid, age, CASE WHEN is_top THEN 'Main' WHEN odd OR t_rel = 'Main' THEN relationship
  WHEN t_rel = 'Spouse' THEN CASE relationship WHEN 'Main' THEN 'Spouse' WHEN 'Sibling' THEN 'Others' ELSE relationship END
  WHEN t_rel = 'Child' THEN CASE WHEN sp THEN 'Spouse' WHEN relationship IN ('Main', 'Spouse') THEN 'Parent' WHEN relationship = 'Child' THEN 'Sibling' WHEN relationship = 'Sibling' THEN 'Others' WHEN relationship = 'Grandchild' THEN CASE WHEN t_age - age >= 15 THEN 'Child' ELSE 'Others' END ELSE relationship END
  WHEN t_rel = 'Sibling' THEN CASE WHEN sp THEN 'Spouse' WHEN relationship = 'Main' THEN 'Sibling' WHEN relationship IN ('Spouse', 'Child', 'Grandchild') THEN 'Others' ELSE relationship END
  WHEN t_rel = 'Grandchild' THEN CASE WHEN sp THEN 'Spouse' WHEN relationship IN ('Main', 'Spouse') THEN 'Grandparent' WHEN relationship = 'Child' THEN CASE WHEN before THEN 'Others' WHEN of_age THEN 'Parent' ELSE 'Child' END WHEN relationship = 'Grandchild' THEN 'Sibling' ELSE relationship END
  ELSE 'Others' END AS relationship FROM s),
o AS (SELECT *, max(CASE WHEN relationship = 'Main' THEN age END) OVER (PARTITION BY hhid) AS m FROM r)
SELECT persid, hhid, relationship FROM o WHERE hhid NOT IN (SELECT hhid FROM o WHERE (relationship IN ('Child', 'Parent') AND abs(age - m) < 15) OR (relationship IN ('Grandchild', 'Grandparent') AND abs(age - m) < 33))"""


@query(WITH(PP, PM).rstrip() + RELABEL)
def relabel_relationships(spark, d):
    return R.process_relationships(persons(spark, d)).select("persid", "hhid", "relationship")


COUNTS = ", ".join(f"CAST(count(*) FILTER (relationship = '{r}') AS BIGINT) AS n_{r}" for r in R.RELATIONS)


@query(WITH(PP, PM) + f"SELECT hhid, {COUNTS} FROM pm GROUP BY hhid")
def relation_counts(spark, d):
    return R.relation_counts(R.first_is_main(persons(spark, d)))


TYPE = """CASE WHEN fam + n_Others = 0 THEN 'Single Person' WHEN fam = 0 THEN 'Group Household' WHEN wide + n_Others > 0 THEN 'Complicated Family'
WHEN n_Spouse > 0 AND n_Child > 0 THEN 'Couple with Child' WHEN n_Spouse > 0 THEN 'Couple Only' ELSE 'Single Parent' END"""


@query(WITH(PP, PM) + f"SELECT hhid, {TYPE} AS hh_type FROM (SELECT *, n_Parent + n_Grandparent + n_Grandchild + n_Sibling AS wide, n_Spouse + n_Child + n_Parent + n_Grandparent + n_Grandchild + n_Sibling AS fam FROM (SELECT hhid, {COUNTS} FROM pm GROUP BY hhid))")
def hh_type(spark, d):
    p = R.first_is_main(persons(spark, d))
    n = R.relation_counts(p)
    return n.select("hhid", A.household_type({r: F.col(f"n_{r}") for r in R.RELATIONS}).alias("hh_type"))


@query(WITH(PP, PM) + """SELECT hhid, CASE WHEN len(s) = 0 THEN 'Single Person' WHEN s = ['Others'] THEN 'Group Household' WHEN s = ['Child', 'Spouse'] THEN 'Couple with Child' WHEN s = ['Spouse'] THEN 'Couple Only'
WHEN s = ['Child'] THEN 'Single Parent' ELSE 'Complicated Family' END AS hh_type FROM (SELECT hhid, coalesce(list_sort(list(DISTINCT relationship) FILTER (relationship <> 'Main')), []) AS s FROM pm GROUP BY hhid)""")
def hh_type_set(spark, d):
    p = R.first_is_main(persons(spark, d))
    return p.groupBy("hhid").agg(A.household_type_of_set(F.collect_set("relationship")).alias("hh_type"))


@query(WITH(PP, PM) + """SELECT hhid, CASE WHEN sp = 0 THEN 'No spouse' WHEN ms <> ss AND abs(ma - sa) <= 20 THEN 'Typical spouse' ELSE 'Special spouse' END || CASE WHEN ch > 0 THEN ' with child' ELSE ' without child' END AS spouse_type
FROM (SELECT hhid, count(*) FILTER (relationship = 'Spouse') AS sp, count(*) FILTER (relationship = 'Child') AS ch, max(CASE WHEN relationship = 'Main' THEN sex END) AS ms, max(CASE WHEN relationship = 'Main' THEN age END) AS ma,
arg_min(sex, persid) FILTER (relationship = 'Spouse') AS ss, arg_min(age, persid) FILTER (relationship = 'Spouse') AS sa FROM pm GROUP BY hhid)""")
def spouse_type(spark, d):
    return R.spouse_type(R.first_is_main(persons(spark, d)))


# Joins


@query(WITH(HH, PP) + "SELECT persid, hhid, dwelltype, hhinc, age FROM pp JOIN hh USING (hhid)")
def hh_person_join(spark, d):
    return joins.persons_with_household(persons(spark, d), households(spark, d)).select("persid", "hhid", "dwelltype", "hhinc", "age")


@query(WITH(HH, PP, PM) + "SELECT hh.hhid, hh.hhinc, pm.age, pm.persid FROM hh JOIN pm ON hh.hhid = pm.hhid AND pm.relationship = 'Main'")
def hh_main_join(spark, d):
    m = R.first_is_main(persons(spark, d)).where("relationship = 'Main'").withColumn("hhinc", F.lit("clash"))
    return joins.household_with_main(households(spark, d), m).select("hhid", "hhinc", "age", "persid")


@query(WITH(PP, PM) + "SELECT s.persid, s.hhid, m.age AS age_main, s.age FROM (SELECT * FROM pm WHERE relationship = 'Main' AND age > 50) m RIGHT JOIN (SELECT * FROM pm WHERE relationship = 'Spouse') s ON m.hhid = s.hhid")
def right_join_relation(spark, d):
    p = R.first_is_main(persons(spark, d))
    return joins.main_with_relation(p.where("relationship = 'Main' AND age > 50").select("hhid", "age"), p.where("relationship = 'Spouse'")).select("persid", "hhid", "age_main", "age")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_missing_records(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    _, missing = joins.matched_and_missing(o, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])
    return missing.select(F.col("k").alias("o_orderkey"), "o_custkey")


@query("SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 GROUP BY 1")
def mutual_semi_filter(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    x = t(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "k")
    a, b = joins.mutual_semi(o, x, "k")
    return a.join(b, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(WITH(HH) + "SELECT hh.hhid, p.dwelltype AS matched FROM hh JOIN (SELECT DISTINCT zone_id, dwelltype FROM hh WHERE bal > 4000) p ON hh.zone_id = p.zone_id AND (hh.dwelltype = p.dwelltype OR hh.dwelltype IN ('MACHINERY') OR p.dwelltype IN ('MACHINERY'))")
def wildcard_candidates(spark, d):
    h = households(spark, d)
    pool = h.where("bal > 4000").select("zone_id", F.col("dwelltype").alias("matched")).distinct()
    wild = F.col("dwelltype").isin("MACHINERY") | F.col("matched").isin("MACHINERY")
    return h.join(pool, "zone_id").where((F.col("dwelltype") == F.col("matched")) | wild).select("hhid", "matched")


@query(WITH(HH) + """SELECT hhid, zone_id, dwelltype, "__p_att" FROM (SELECT hh.hhid, hh.zone_id, hh.dwelltype, p.dwelltype AS "__p_att", row_number() OVER (PARTITION BY hh.hhid ORDER BY md5('0|' || CAST(hh.hhid AS VARCHAR) || '|' || p.dwelltype), p.dwelltype) AS n
FROM hh JOIN (SELECT DISTINCT zone_id, dwelltype FROM hh WHERE bal > 4000) p ON hh.zone_id = p.zone_id AND (hh.dwelltype = p.dwelltype OR hh.dwelltype IN ('MACHINERY') OR p.dwelltype IN ('MACHINERY'))) WHERE n = 1""")
def wildcard_match(spark, d):
    h = households(spark, d)
    pool = h.where("bal > 4000").select("zone_id", "dwelltype").distinct()
    return joins.wildcard_match(h.select("hhid", "zone_id", "dwelltype"), pool, "dwelltype", ["zone_id"], ["MACHINERY"], ["hhid"])


@query("SELECT c_custkey AS hhid, n_name AS zone_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def crosswalk_lookup(spark, d):
    codes = t(spark, d, "nation").where("n_regionkey < 3")
    return joins.crosswalk(t(spark, d, "customer").select(F.col("c_custkey").alias("hhid"), "c_nationkey"), codes, "c_nationkey", "n_nationkey", "n_name", "zone_name").select("hhid", "zone_name")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_join(spark, d):
    return joins.natural_join(t(spark, d, "nation").withColumnRenamed("n_regionkey", "k"), t(spark, d, "region").withColumnRenamed("r_regionkey", "k")).select("n_nationkey", "n_name", "r_name")


@query(WITH(REC) + ", a AS (SELECT DISTINCT l_returnflag, l_linestatus, qty FROM rec WHERE disc = '1'), b AS (SELECT DISTINCT l_linestatus, qty, disc FROM rec WHERE disc <> '1' AND qty <> '3') SELECT l_returnflag, l_linestatus, qty FROM a WHERE (l_linestatus, qty) IN (SELECT l_linestatus, qty FROM b)")
def pool_semijoin_consistency(spark, d):
    r = records(spark, d)
    a = r.where("disc = '1'").select("l_returnflag", "l_linestatus", "qty").distinct()
    b = r.where("disc <> '1' AND qty <> '3'").select("l_linestatus", "qty", "disc").distinct()
    return joins.consistent_pools(a, b, ["l_linestatus", "qty"])[0].select("l_returnflag", "l_linestatus", "qty")


# Aggregation and set operations


@query(WITH(REC) + 'SELECT l_returnflag, l_linestatus, qty, disc, count(*) AS "count" FROM rec GROUP BY ALL')
def condense_lineitem(spark, d):
    return C.condense(records(spark, d), RECORD_ATTS)


@query(WITH(REC) + "SELECT l_returnflag, l_linestatus, qty, disc FROM rec")
def condense_inflate_roundtrip(spark, d):
    return C.inflate(C.condense(records(spark, d), RECORD_ATTS))


@query(WITH(HH, MARG) + "SELECT zone_id, att, state, value FROM marg")
def zone_marginals_long(spark, d):
    return census_hh(spark, d)


@query(WITH(HH) + "SELECT zone_id, " + ", ".join(f"CAST(count(*) FILTER (totalvehs = '{s}') AS BIGINT) AS \"totalvehs__{s}\"" for s in ("0", "1", "2", "3", "4+")) + " FROM hh GROUP BY zone_id")
def zone_marginals_wide(spark, d):
    m = C.marginals(households(spark, d), "zone_id", ["totalvehs"])
    return C.widen(m, ["zone_id"], [("totalvehs", s) for s in ("0", "1", "2", "3", "4+")])


@query(WITH(HH, MARG) + "SELECT zone_id, sum(value) / count(DISTINCT att) AS total FROM marg GROUP BY zone_id")
def census_total_hh(spark, d):
    return C.household_total(census_hh(spark, d).withColumnRenamed("value", "target"))


MATRIX = "SELECT dwelltype, hhinc, sum(n) FILTER (totalvehs = '0') AS \"0\", sum(n) FILTER (totalvehs = '1') AS \"1\", sum(n) FILTER (totalvehs = '4+') AS \"4+\" FROM (SELECT dwelltype, hhinc, totalvehs, CAST(count(*) AS BIGINT) AS n FROM hh GROUP BY ALL) GROUP BY ALL"


@query(WITH(HH) + f'SELECT dwelltype, hhinc, CAST("0" AS BIGINT) AS "0", CAST("1" AS BIGINT) AS "1", CAST("4+" AS BIGINT) AS "4+" FROM ({MATRIX})')
def ilp_matrix_pivot(spark, d):
    c = C.condense(households(spark, d), HH_ATTS)
    return C.count_matrix(c, ["dwelltype", "hhinc"], "totalvehs", ["0", "1", "4+"])


@query(WITH(HH) + "SELECT dwelltype, hhinc, totalvehs, count(*) AS \"count\" FROM hh WHERE totalvehs IN ('0', '1', '4+') GROUP BY ALL")
def ilp_matrix_unpivot(spark, d):
    return C.matrix_to_counts(ilp_matrix_pivot(spark, d), ["dwelltype", "hhinc"], "totalvehs", ["0", "1", "4+"])


@query(WITH(HH, SYN, MARG, SMARG) + "SELECT zone_id, att, state, coalesce(m.value, 0) - coalesce(s.value, 0) AS diff FROM marg m FULL JOIN smarg s USING (zone_id, att, state) WHERE att = 'hhinc'")
def state_diff(spark, d):
    return saa.state_differences("hhinc", sampled_hh(spark, d), census_hh(spark, d))


@query(WITH(HH) + "SELECT dwelltype, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM hh GROUP BY dwelltype")
def normalised_shares(spark, d):
    return C.shares(households(spark, d), ["dwelltype"]).withColumn("share", r6("share"))


@query(WITH(REC) + "SELECT qty, l_returnflag, round(sum(w) / sum(sum(w)) OVER (PARTITION BY qty), 6) AS share FROM (SELECT qty, l_returnflag, l_linenumber AS w FROM rec) GROUP BY qty, l_returnflag")
def weighted_shares(spark, d):
    return C.shares(records(spark, d), ["l_returnflag"], F.col("l_linenumber"), ["qty"]).withColumn("share", r6("share"))


@query(WITH(PP, PM) + "SELECT hhid, array_to_string(list(relationship ORDER BY persid), ',') AS roles FROM pm GROUP BY hhid")
def ordered_group_list(spark, d):
    return C.ordered_list(R.first_is_main(persons(spark, d)), "hhid", "persid", "relationship").select("hhid", F.array_join("values", ",").alias("roles"))


@query(WITH(PP) + "SELECT hhid, arg_min(persid, (age, persid)) AS persid, min(age) AS age FROM pp GROUP BY hhid")
def first_of_each_household(spark, d):
    return C.first_of_each(persons(spark, d).select("hhid", "persid", "age"), ["hhid"], ["age", "persid"])


@query(WITH(REC) + ", j AS (SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS w FROM rec GROUP BY ALL) SELECT att, state, CAST(sum(w) AS BIGINT) AS value FROM (SELECT 'l_returnflag' AS att, l_returnflag AS state, w FROM j UNION ALL SELECT 'l_linestatus', l_linestatus, w FROM j) GROUP BY ALL")
def marginals_from_joint(spark, d):
    j = records(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("w"))
    return C.weighted_marginals(j, ["l_returnflag", "l_linestatus"], "w")


@query(WITH(HH, MARG) + "SELECT att || '__' || state AS target, 'zone' AS geography, 'households' AS seed_table, 1000 AS importance, att, state, att || '__' || state AS control_field, 'households.' || att || ' == ''' || state || '''' AS expression, CAST(sum(value) AS BIGINT) AS \"count\" FROM marg GROUP BY att, state")
def control_table(spark, d):
    return C.control_table(households(spark, d), HH_ATTS)


@query(WITH(HH, SYN, MARG, SMARG) + ", z AS (SELECT DISTINCT zone_id FROM smarg), s AS (SELECT DISTINCT att, state FROM marg) SELECT zone_id, att, state, coalesce(value, 0) AS value FROM z CROSS JOIN s LEFT JOIN smarg USING (zone_id, att, state)")
def densified_marginals(spark, d):
    return C.densify(C.marginals(sampled_hh(spark, d), "zone_id", HH_ATTS), "zone_id", census_hh(spark, d))


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) // 100 AS BIGINT) AS chunk FROM part")
def row_chunks(spark, d):
    return C.chunks(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 100).select("p_partkey", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT p_partkey, round(greatest(lo, least(hi, p_retailprice)), 6) AS p_retailprice FROM part, (SELECT quantile_cont(p_retailprice, 0.02) AS lo, quantile_cont(p_retailprice, 0.98) AS hi FROM part)")
def percentile_clip(spark, d):
    return C.percentile_clip(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").withColumn("p_retailprice", r6("p_retailprice"))


@query("SELECT 'a' AS run, n_nationkey AS k FROM nation UNION ALL SELECT 'b', r_regionkey FROM region")
def union_of_runs(spark, d):
    return joins.union_runs({"a": t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "b": t(spark, d, "region").select(F.col("r_regionkey").alias("k"))}).select("run", "k")


@query(WITH(REC) + "(SELECT qty, disc FROM rec WHERE l_returnflag = 'A' EXCEPT SELECT qty, disc FROM rec WHERE l_returnflag = 'N' AND qty > '2')")
def combination_difference(spark, d):
    r = records(spark, d)
    return r.where("l_returnflag = 'A'").select("qty", "disc").subtract(r.where("l_returnflag = 'N' AND qty > '2'").select("qty", "disc"))


# Sampling and integerisation


LR = """SELECT zone_id, hhinc, CAST(floor(v) + CASE WHEN row_number() OVER (PARTITION BY zone_id ORDER BY round(v - floor(v), 9) DESC, hhinc) <= round(sum(v) OVER (PARTITION BY zone_id)) - sum(floor(v)) OVER (PARTITION BY zone_id) THEN 1 ELSE 0 END AS BIGINT) AS n
FROM (SELECT zone_id, hhinc, count(*) * 0.37 AS v FROM hh GROUP BY ALL)"""


@query(WITH(HH) + LR)
def largest_remainder_zone(spark, d):
    v = households(spark, d).groupBy("zone_id", "hhinc").agg((F.count(F.lit(1)) * F.lit(0.37)).alias("v"))
    return S.largest_remainder(v, "v", ["zone_id"], ["hhinc"]).select("zone_id", "hhinc", "n")


@query(WITH(HH) + """SELECT zone_id, hhinc, CAST(floor(v) + CASE WHEN row_number() OVER (PARTITION BY zone_id ORDER BY race DESC, zone_id, hhinc) <= round(sum(v) OVER (PARTITION BY zone_id)) - sum(floor(v)) OVER (PARTITION BY zone_id) THEN 1 ELSE 0 END AS BIGINT) AS n
FROM (SELECT *, CASE WHEN v - floor(v) > 0 THEN pow(greatest(CAST('0x' || substr(md5('0|' || zone_id || '|' || hhinc), 1, 8) AS BIGINT) / 4294967296.0, 1e-12), 1 / (v - floor(v))) ELSE -1 END AS race FROM (SELECT zone_id, hhinc, count(*) * CAST(0.37 AS DOUBLE) AS v FROM hh GROUP BY ALL))""")
def trs_update_zone(spark, d):
    v = households(spark, d).groupBy("zone_id", "hhinc").agg((F.count(F.lit(1)) * F.lit(0.37)).alias("v"))
    return S.truncate_replicate_sample(v, "v", ["zone_id"], ["zone_id", "hhinc"]).select("zone_id", "hhinc", "n")


@query(WITH(HH) + "SELECT hhid FROM hh ORDER BY md5('7|' || CAST(hhid AS VARCHAR)), hhid LIMIT (SELECT CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) FROM hh)")
def sample_exact_fraction(spark, d):
    return S.sample_exact(households(spark, d), 0.2, ["hhid"], 7).select("hhid")


@query(WITH(HH) + "SELECT zone_id, hhid FROM (SELECT zone_id, hhid, row_number() OVER (PARTITION BY zone_id ORDER BY md5('7|' || CAST(hhid AS VARCHAR)), hhid) AS k, count(*) OVER (PARTITION BY zone_id) AS n FROM hh) WHERE k <= round(n * 0.25)")
def stratified_sample(spark, d):
    return S.sample_exact(households(spark, d), 0.25, ["hhid"], 7, ["zone_id"]).select("zone_id", "hhid")


@query(WITH(HH, REC) + f"""SELECT hhid, qty FROM (SELECT hhid, {U('9', 'hhid')} AS u FROM hh) JOIN (SELECT qty, sum(n) OVER (ORDER BY qty) - n AS lo, sum(n) OVER (ORDER BY qty) AS hi, sum(n) OVER () AS total
FROM (SELECT qty, count(*) AS n FROM rec GROUP BY qty)) ON u * total >= lo AND u * total < hi""")
def weighted_draw(spark, d):
    pool = records(spark, d).groupBy("qty").agg(F.count(F.lit(1)).alias("n"))
    return S.weighted_draws(households(spark, d).select("hhid"), pool, [], "n", ["qty"], ["hhid"], 9).select("hhid", "qty")


@query(WITH(HH, REC) + f"""SELECT hhid, zone_id, qty FROM (SELECT hhid, zone_id, {U('9', 'hhid')} AS u FROM hh) JOIN (SELECT zone_id, qty, sum(n) OVER (PARTITION BY zone_id ORDER BY qty) - n AS lo, sum(n) OVER (PARTITION BY zone_id ORDER BY qty) AS hi,
sum(n) OVER (PARTITION BY zone_id) AS total FROM (SELECT zone_id, qty, count(*) AS n FROM rec GROUP BY ALL)) USING (zone_id) WHERE u * total >= lo AND u * total < hi""")
def weighted_draw_by_zone(spark, d):
    pool = records(spark, d).groupBy("zone_id", "qty").agg(F.count(F.lit(1)).alias("n"))
    return S.weighted_draws(households(spark, d).select("hhid", "zone_id"), pool, ["zone_id"], "n", ["qty"], ["hhid"], 9).select("hhid", "zone_id", "qty")


@query(WITH(REC) + f""", c AS (SELECT l_returnflag, l_linestatus, qty, disc, count(*) AS n FROM rec GROUP BY ALL), w AS (SELECT l_returnflag, sum(n) / (SELECT sum(n) FROM c) * 500 AS v FROM c GROUP BY l_returnflag),
k AS (SELECT l_returnflag, CAST(floor(v) + CASE WHEN row_number() OVER (ORDER BY round(v - floor(v), 9) DESC, l_returnflag) <= round(sum(v) OVER ()) - sum(floor(v)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS m FROM w),
t AS (SELECT l_returnflag, draw, CAST('0x' || substr(md5('0|' || l_returnflag || '|' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT l_returnflag, unnest(range(1, m + 1)) AS draw FROM k)),
p AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus, qty, disc) AS hi, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c)
SELECT l_returnflag, l_linestatus, qty, disc, CAST(draw AS INTEGER) AS draw FROM t JOIN p USING (l_returnflag) WHERE u * total >= hi - n AND u * total < hi""")
def balanced_type_sample(spark, d):
    c = C.condense(records(spark, d), RECORD_ATTS)
    return S.balanced_types(c, "l_returnflag", 500, "count", RECORD_ATTS).select(*RECORD_ATTS, "draw")


@query(WITH(HH, PP) + f""", c AS (SELECT relationship = 'Spouse' AS is_main, sex, CASE WHEN age < 100 THEN CAST(age // 10 * 10 AS VARCHAR) || '-' || CAST(age // 10 * 10 + 9 AS VARCHAR) ELSE '100+' END AS age, count(*) AS n FROM pp GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY is_main ORDER BY sex, age) AS hi, sum(n) OVER (PARTITION BY is_main) AS total FROM c),
t AS (SELECT hhid, draw, draw = 1 AS is_main, CAST('0x' || substr(md5('0|' || CAST(hhid AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM (SELECT hhid, unnest(range(1, CASE WHEN hhsize = '8+' THEN 8 + CAST(floor({U('0-size', 'hhid')} * 4) AS BIGINT) ELSE CAST(hhsize AS BIGINT) END + 1)) AS draw FROM hh))
SELECT hhid, CAST(draw AS INTEGER) AS draw, is_main, sex, age FROM t JOIN p USING (is_main) WHERE u * total >= hi - n AND u * total < hi""")
def filled_households(spark, d):
    pool = C.condense(persons(spark, d).select("sex", A.age_decade(F.col("age")).alias("age"), (F.col("relationship") == "Spouse").alias("is_main")), ["sex", "age", "is_main"])
    return S.fill_household(households(spark, d), "hhid", "hhsize", pool, "is_main", "count", ["sex", "age"]).select("hhid", "draw", "is_main", "sex", "age")


# Census preparation


@query(WITH(HH, MARG) + """, r AS (SELECT zone_id, CASE state WHEN 'HOUSEHOLD' THEN 'home' WHEN 'BUILDING' THEN 'home' WHEN 'AUTOMOBILE' THEN 'other' WHEN 'MACHINERY' THEN 'SHIFT' ELSE state END AS rule, CAST(value AS DOUBLE) AS value FROM marg WHERE att = 'dwelltype'),
s AS (SELECT zone_id, rule, value + (sum(CASE WHEN rule = 'SHIFT' THEN value ELSE 0 END) OVER (PARTITION BY zone_id)) / (sum(CASE WHEN rule = 'SHIFT' THEN 0 ELSE 1 END) OVER (PARTITION BY zone_id)) AS value, rule = 'SHIFT' AS gone FROM r)
SELECT zone_id, 'dwelltype' AS att, rule AS state, round(sum(value), 6) AS value FROM s WHERE NOT gone GROUP BY zone_id, rule""")
def remap_shift(spark, d):
    m = C.marginals(households(spark, d), "zone_id", ["dwelltype"])
    rules = spark.createDataFrame([("dwelltype", "HOUSEHOLD", "home"), ("dwelltype", "BUILDING", "home"), ("dwelltype", "AUTOMOBILE", "other"), ("dwelltype", "MACHINERY", "SHIFT")], "att string, state string, rule string")
    return census.remap_states(m, rules).withColumn("value", r6("value"))


@query(WITH(HH, MARG) + """, n AS (SELECT zone_id, att, state, CASE WHEN state = '3' THEN -2 ELSE value END AS value FROM marg WHERE att = 'totalvehs')
SELECT zone_id, att, state, CAST(greatest(value, 0) + CASE WHEN row_number() OVER (PARTITION BY zone_id, att ORDER BY value DESC, state) = 1 THEN sum(least(value, 0)) OVER (PARTITION BY zone_id, att) ELSE 0 END AS BIGINT) AS value FROM n""")
def repair_negative_cells(spark, d):
    m = C.marginals(households(spark, d), "zone_id", ["totalvehs"]).withColumn("value", F.when(F.col("state") == "3", F.lit(-2)).otherwise(F.col("value")))
    return census.repair_negative(m).withColumn("value", F.col("value").cast("long"))


@query(WITH(HH, MARG) + "SELECT zone_id, att, state, value, round(100 * value / sum(value) OVER (PARTITION BY zone_id, att), 6) AS percent FROM marg")
def percentages(spark, d):
    return census.percent_of_total(census_hh(spark, d)).withColumn("percent", r6("percent"))


# Fitting and synthesis

IPF_SEED = "SELECT dwelltype, totalvehs, CAST(count(*) AS DOUBLE) AS w FROM syn GROUP BY ALL"
IPF_START = f"w0 AS (SELECT z.zone_id, s.dwelltype, s.totalvehs, s.w FROM (SELECT DISTINCT zone_id FROM marg) z CROSS JOIN ({IPF_SEED}) s)"


def _sweep(k: int, prev: str) -> str:
    one = f"a{k} AS (SELECT p.zone_id, dwelltype, totalvehs, CASE WHEN sum(w) OVER (PARTITION BY p.zone_id, dwelltype) > 0 THEN w * coalesce(m.value, 0) / sum(w) OVER (PARTITION BY p.zone_id, dwelltype) ELSE 0 END AS w FROM {prev} p LEFT JOIN marg m ON m.zone_id = p.zone_id AND m.att = 'dwelltype' AND m.state = dwelltype)"
    two = f"b{k} AS (SELECT p.zone_id, dwelltype, totalvehs, CASE WHEN sum(w) OVER (PARTITION BY p.zone_id, totalvehs) > 0 THEN w * coalesce(m.value, 0) / sum(w) OVER (PARTITION BY p.zone_id, totalvehs) ELSE 0 END AS w FROM a{k} p LEFT JOIN marg m ON m.zone_id = p.zone_id AND m.att = 'totalvehs' AND m.state = totalvehs)"
    return f"{one},\n{two}"


@query(WITH(HH, SYN, MARG, IPF_START, _sweep(1, "w0"), _sweep(2, "b1")) + "SELECT zone_id, dwelltype, totalvehs, round(w, 6) AS weight FROM b2")
def ipf_zones(spark, d):
    seed = sampled_hh(spark, d).groupBy("dwelltype", "totalvehs").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return ipf.fit(seed, census_hh(spark, d), ["dwelltype", "totalvehs"], sweeps=2).withColumn("weight", r6("weight"))


@query()
def ipf_joint_converged(spark, d):
    h = households(spark, d)
    states = {a: bayes.state_names(h, [a])[a] for a in ("dwelltype", "totalvehs")}
    seed = C.condense(sampled_hh(spark, d), list(states))
    return ipf.fit_joint(spark, states, seed, C.marginals(h, "zone_id", list(states)), max_sweeps=50).withColumn("weight", F.round("weight", 3))


@query()
def ipu_weights(spark, d):
    h = households(spark, d)
    sample = sampled_hh(spark, d)
    p = persons(spark, d)
    inc = ipu.incidence(sample, p.join(sample.select("hhid"), "hhid", "left_semi"), "hhid", ["dwelltype"], ["sex"])
    hm = C.marginals(h, "zone_id", ["dwelltype"]).withColumn("level", F.lit("household"))
    pm = C.marginals(p.join(h.select("hhid", "zone_id"), "hhid"), "zone_id", ["sex"]).withColumn("level", F.lit("person"))
    return ipu.run(inc, hm.unionByName(pm), iterations=50).withColumn("weight", F.round("weight", 4)).select("zone_id", "hhid", "weight")


@query()
def saa_population(spark, d):
    h = households(spark, d)
    return C.condense(saa.run(census_hh(spark, d), C.condense(sampled_hh(spark, d), HH_ATTS), HH_ATTS, runs=2, extra_removed=0.0), ["zone_id", *HH_ATTS])


@query(WITH(HH, MARG) + "SELECT zone_id, att, state, value FROM marg WHERE att = 'dwelltype'")
def saa_initial_population(spark, d):
    pool = C.condense(households(spark, d), HH_ATTS)
    return C.marginals(saa.initial_population("dwelltype", census_hh(spark, d), pool, HH_ATTS), "zone_id", ["dwelltype"])


@query()
def removed_overfilled(spark, d):
    marg = C.marginals(sampled_hh(spark, d), "zone_id", HH_ATTS)
    return saa.trimmed(households(spark, d), marg, HH_ATTS)


@query()
def pairwise_adjusted(spark, d):
    h = households(spark, d)
    syn = h.withColumn("dwelltype", F.when(F.col("hhid") % 4 == 0, F.lit("HOUSEHOLD")).otherwise(F.col("dwelltype"))).select("zone_id", *HH_ATTS)
    out = saa.pairwise_adjust("dwelltype", syn, census_hh(spark, d), HH_ATTS, C.condense(h, HH_ATTS), ["hhinc"])
    return C.marginals(out, "zone_id", ["dwelltype"])


@query(WITH(REC) + "SELECT l_returnflag, l_linestatus, count(*) AS n FROM rec GROUP BY ALL")
def bn_counts(spark, d):
    return bayes.counts(records(spark, d), "l_linestatus", ["l_returnflag"]).withColumn("n", F.col("n").cast("long"))


@query(WITH(REC) + ", c AS (SELECT l_returnflag, qty, count(*) AS n FROM rec GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM rec) CROSS JOIN (SELECT DISTINCT qty FROM rec)) SELECT l_returnflag, qty, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY l_returnflag), 6) AS p FROM g LEFT JOIN c USING (l_returnflag, qty)")
def bn_cpd(spark, d):
    r = records(spark, d)
    return bayes.conditional(r, "qty", ["l_returnflag"], bayes.state_names(r, ["qty"])["qty"]).withColumn("p", r6("p"))


@query(WITH(REC) + ", c AS (SELECT l_returnflag, qty, count(*) AS n FROM rec GROUP BY ALL) SELECT round(sum(n * ln(n / t)) - 0.5 * (SELECT (count(DISTINCT qty) - 1) * count(DISTINCT l_returnflag) FROM rec) * ln(sum(n)), 4) AS bic FROM (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS t FROM c)")
def bn_bic_score(spark, d):
    r = records(spark, d)
    cards = {a: len(s) for a, s in bayes.state_names(r, ["qty", "l_returnflag"]).items()}
    return bayes.bic(r, "qty", ["l_returnflag"], cards).select(F.round("bic", 4).alias("bic"))


@query()
def bn_forward_pool(spark, d):
    h = households(spark, d)
    net = bayes.learn_structure(h, HH_ATTS, max_parents=2)
    return bayes.forward_pool(spark, 2000, net, bayes.learn_parameters(h, net))


def _cdf(name: str, parent: str, child: str) -> str:
    return f"""{name} AS (SELECT {parent}, {child}, sum(p) OVER (PARTITION BY {parent} ORDER BY {child}) AS hi FROM (SELECT {parent}, {child}, (coalesce(n, 0) + 1.0::DOUBLE) / sum(coalesce(n, 0) + 1.0::DOUBLE) OVER (PARTITION BY {parent}) AS p
  FROM (SELECT * FROM (SELECT DISTINCT {parent} FROM hh) CROSS JOIN (SELECT DISTINCT {child} FROM hh)) LEFT JOIN (SELECT {parent}, {child}, count(*) AS n FROM hh GROUP BY ALL) USING ({parent}, {child})))"""


def _drawn(name: str, rows: str, cdf: str, parent: str, child: str) -> str:
    u = f"CAST('0x' || substr(md5('0-{child}|' || zone_id || '|' || dwelltype || '|' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"
    return f"{name} AS (SELECT r.*, g.{child} FROM (SELECT *, {u} AS u_{child} FROM {rows}) r JOIN (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY {parent} ORDER BY {child}) AS lo, lead(hi) OVER (PARTITION BY {parent} ORDER BY {child}) IS NULL AS last FROM {cdf}) g ON r.{parent} = g.{parent} AND u_{child} >= lo AND (u_{child} < hi OR last))"


@query(WITH(HH, _cdf("c1", "dwelltype", "hhinc"), _cdf("c2", "hhinc", "totalvehs"), "e AS (SELECT zone_id, dwelltype, CAST(unnest(range(1, count(*) + 1)) AS INTEGER) AS draw FROM hh GROUP BY zone_id, dwelltype)", _drawn("d1", "e", "c1", "dwelltype", "hhinc"), _drawn("d2", "d1", "c2", "hhinc", "totalvehs")) + "SELECT zone_id, dwelltype, draw, hhinc, totalvehs FROM d2")
def bn_evidence_sample(spark, d):
    h = households(spark, d)
    net = {"dwelltype": (), "hhinc": ("dwelltype",), "totalvehs": ("hhinc",)}
    evidence = h.groupBy("zone_id", "dwelltype").agg(F.count(F.lit(1)).alias("n"))
    return bayes.sample_evidence(evidence, net, bayes.learn_parameters(h, net), ["zone_id", "dwelltype"], "n", ["hhinc", "totalvehs"])


PAIR = """SELECT m.hhid, m.sex AS a, s.sex AS b FROM pm m JOIN pm s ON m.hhid = s.hhid AND m.relationship = 'Main' AND s.relationship = 'Spouse'"""


@query(WITH(PP, PM) + f'SELECT a AS "Main_sex", b AS "Spouse_sex", count(*) AS "count" FROM ({PAIR}) GROUP BY ALL')
def pool_pairs_counts(spark, d):
    return csp.pool_pairs(households(spark, d), R.first_is_main(persons(spark, d)), ["dwelltype"], ["sex"])["Main-Spouse"]


@query(WITH(PP, PM) + f'SELECT hhid, b AS "Spouse_sex", CAST(sum(n) AS BIGINT) AS "count" FROM (SELECT hhid, sex AS a FROM pm WHERE relationship = \'Main\') JOIN (SELECT a, b, count(*) AS n FROM ({PAIR}) GROUP BY ALL) USING (a) GROUP BY ALL')
def csp_candidates(spark, d):
    p = R.first_is_main(persons(spark, d))
    pairs = csp.pool_pairs(households(spark, d), p, ["dwelltype"], ["sex"])["Main-Spouse"]
    ev = p.where("relationship = 'Main'").select("hhid", F.col("sex").alias("Main_sex"))
    return csp.candidates(ev, pairs, ["hhid"], ["Main_sex"], ["Spouse_sex"])[0]


@query()
def csp_persons(spark, d):
    h = households(spark, d)
    pools = csp.pool_pairs(h, R.first_is_main(persons(spark, d)), ["dwelltype", "hhsize"], ["sex"])
    people, _ = csp.sample_persons(h, pools, ["dwelltype", "hhsize"], ["sex"])
    return people


@query(WITH(HH) + f""", p AS (SELECT *, sum(n) OVER (ORDER BY dwelltype, hhinc, totalvehs) AS hi, sum(n) OVER () AS total FROM (SELECT dwelltype, hhinc, totalvehs, count(*) AS n FROM hh GROUP BY ALL))
SELECT id, dwelltype, hhinc, totalvehs FROM (SELECT id, {U('0', 'id')} AS u FROM range(1000) r(id)) JOIN p ON u * total >= hi - n AND u * total < hi""")
def naive_population(spark, d):
    return evolve.naive_synthesis(C.condense(households(spark, d), HH_ATTS), 1000, HH_ATTS)


# Metrics

D = "d AS (SELECT zone_id, att, state, coalesce(m.value, 0) - coalesce(s.value, 0) AS diff FROM marg m FULL JOIN smarg s USING (zone_id, att, state))"
BOTH = WITH(HH, SYN, MARG, SMARG, D)


@query(BOTH + "SELECT att, state, round(sqrt(sum(diff * diff) / (SELECT count(DISTINCT zone_id) FROM d)), 6) AS rmse FROM d GROUP BY ALL")
def rmse_attribute(spark, d):
    return metrics.rmse(census_hh(spark, d), C.marginals(sampled_hh(spark, d), "zone_id", HH_ATTS)).withColumn("rmse", r6("rmse"))


@query(BOTH + "SELECT zone_id, round(sqrt(sum(diff * diff) / (SELECT count(*) FROM (SELECT DISTINCT att, state FROM d))), 6) AS rmse FROM d GROUP BY ALL")
def rmse_zonal(spark, d):
    return metrics.rmse(census_hh(spark, d), C.marginals(sampled_hh(spark, d), "zone_id", HH_ATTS), "zonal").withColumn("rmse", r6("rmse"))


JSD = """SELECT {keys}round(sqrt(greatest((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)), 6) AS jsd FROM
(SELECT {keys}coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER ({part}) AS p, coalesce(b.n, 0) / sum(coalesce(b.n, 0)) OVER ({part}) AS q FROM {a} a FULL JOIN {b} b USING ({using})) {group}"""


@query(BOTH + ", a AS (SELECT att, state, sum(value) AS n FROM marg GROUP BY ALL), b AS (SELECT att, state, sum(value) AS n FROM smarg GROUP BY ALL) " + JSD.format(keys="att, ", part="PARTITION BY att", a="a", b="b", using="att, state", group="GROUP BY att"))
def jsd_by_attribute(spark, d):
    a, b = census_hh(spark, d), C.marginals(sampled_hh(spark, d), "zone_id", HH_ATTS)
    return metrics.jensen_shannon(a, b, "state", "value", ["att"]).withColumn("jsd", r6("jsd"))


@query(WITH(REC) + ", a AS (SELECT qty, disc, count(*) AS n FROM rec WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT qty, disc, count(*) AS n FROM rec WHERE l_returnflag = 'N' GROUP BY ALL) " + JSD.format(keys="qty, ", part="PARTITION BY qty", a="a", b="b", using="qty, disc", group="GROUP BY qty"))
def jsd_by_group(spark, d):
    r = records(spark, d).withColumn("one", F.lit(1))
    return metrics.jensen_shannon(r.where("l_returnflag = 'A'"), r.where("l_returnflag = 'N'"), "disc", "one", ["qty"]).withColumn("jsd", r6("jsd"))


JOINT = ", a AS (SELECT dwelltype, hhinc, totalvehs, count(*) / (SELECT count(*) FROM hh) AS p FROM hh GROUP BY ALL), b AS (SELECT dwelltype, hhinc, totalvehs, count(*) / (SELECT count(*) FROM syn) AS q FROM syn GROUP BY ALL) "


@query(WITH(HH, SYN) + JOINT + "SELECT round(sqrt(sum(pow(coalesce(p, 0) - coalesce(q, 0), 2)) * count(p)), 6) AS srmse FROM a FULL JOIN b USING (dwelltype, hhinc, totalvehs)")
def srmse_joint(spark, d):
    return metrics.srmse(households(spark, d), sampled_hh(spark, d), HH_ATTS).withColumn("srmse", r6("srmse"))


@query(WITH(HH, SYN) + JOINT + "SELECT round(sqrt(sum(pow(coalesce(p, 0) - coalesce(q, 0), 2)) * (SELECT count(DISTINCT dwelltype) * count(DISTINCT hhinc) * count(DISTINCT totalvehs) FROM hh)), 6) AS srmse FROM a FULL JOIN b USING (dwelltype, hhinc, totalvehs)")
def srmse_product(spark, d):
    return metrics.srmse_product(households(spark, d), sampled_hh(spark, d), HH_ATTS).withColumn("srmse", r6("srmse"))


@query(WITH(HH, SYN) + "SELECT round(100.0 * (SELECT count(*) FROM (SELECT DISTINCT dwelltype, hhinc, totalvehs, hhsize FROM hh EXCEPT SELECT DISTINCT dwelltype, hhinc, totalvehs, hhsize FROM syn)) / (SELECT count(*) FROM (SELECT DISTINCT dwelltype, hhinc, totalvehs, hhsize FROM hh)), 6) AS missing_percent")
def missing_combos(spark, d):
    return metrics.missing_combinations(households(spark, d), sampled_hh(spark, d), [*HH_ATTS, "hhsize"]).withColumn("missing_percent", r6("missing_percent"))


@query(WITH(HH, SYN) + ", a AS (SELECT DISTINCT dwelltype, hhinc, hhsize FROM hh), b AS (SELECT DISTINCT dwelltype, hhinc, hhsize FROM syn) SELECT (SELECT count(*) FROM a) AS pool, (SELECT count(*) FROM b) AS syn, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, round(100.0 * (SELECT count(*) FROM (FROM a INTERSECT FROM b)) / (SELECT count(*) FROM a), 6) AS coverage_percent")
def combo_coverage(spark, d):
    return metrics.combination_coverage(households(spark, d), sampled_hh(spark, d), ["dwelltype", "hhinc", "hhsize"]).withColumn("coverage_percent", r6("coverage_percent"))


@query(WITH(HH) + "SELECT zone_id, CAST(count(*) FILTER (hhinc = 'Negative income') AS BIGINT) AS value FROM hh GROUP BY zone_id")
def rare_state_by_zone(spark, d):
    return metrics.rare_state(census_hh(spark, d), "hhinc", "Negative income")


@query(WITH(HH) + "SELECT round(sqrt((pow(300.0 - count(*) FILTER (dwelltype = 'BUILDING'), 2) + pow(100.0 - count(*) FILTER (hhinc = 'Negative income'), 2)) / 2), 6) AS rmse FROM hh")
def control_rmse(spark, d):
    controls = [("dwelltype", "BUILDING", 300.0), ("hhinc", "Negative income", 100.0), ("totalvehs", "0", 1.0)]
    return metrics.control_rmse(households(spark, d), controls, ["totalvehs"]).withColumn("rmse", r6("rmse"))


@query(WITH(HH, SYN) + "SELECT round(-sum(p * log2(q)), 6) AS bits FROM (SELECT dwelltype, count(*) / (SELECT count(*) FROM hh) AS p FROM hh GROUP BY ALL) JOIN (SELECT dwelltype, count(*) / (SELECT count(*) FROM syn) AS q FROM syn GROUP BY ALL) USING (dwelltype)")
def cross_entropy(spark, d):
    one = F.lit(1).alias("w")
    return metrics.cross_entropy(households(spark, d).select("dwelltype", one), sampled_hh(spark, d).select("dwelltype", one), "dwelltype", "w").withColumn("bits", r6("bits"))


RUNS = "runs AS (" + " UNION ALL ".join(f"SELECT 'run_{k}' AS run, * FROM hh WHERE {U(str(k), 'hhid')} < 0.5" for k in range(3)) + ")"


@query(WITH(HH, MARG, RUNS) + """, g AS (SELECT run, zone_id, att, state, count(*) AS value FROM (SELECT run, zone_id, 'dwelltype' AS att, dwelltype AS state FROM runs UNION ALL SELECT run, zone_id, 'hhinc', hhinc FROM runs UNION ALL SELECT run, zone_id, 'totalvehs', totalvehs FROM runs) GROUP BY ALL),
b AS (SELECT run, marg.* FROM marg CROSS JOIN (SELECT DISTINCT run FROM runs))
SELECT run, att, state, round(sqrt(sum(pow(coalesce(b.value, 0) - coalesce(g.value, 0), 2)) / (SELECT count(DISTINCT zone_id) FROM marg)), 6) AS rmse FROM b FULL JOIN g USING (run, zone_id, att, state) GROUP BY run, att, state""")
def run_metrics(spark, d):
    runs = joins.union_runs({f"run_{k}": S.bernoulli(households(spark, d), 0.5, ["hhid"], k) for k in range(3)})
    return metrics.run_metrics(census_hh(spark, d), runs, "zone_id", HH_ATTS).withColumn("rmse", r6("rmse"))


# Analysis tables


@query("SELECT l_returnflag AS method, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def summary_mean_min_max(spark, d):
    s = analysis.metric_summary(t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "method"), ["method"], "l_linenumber", "l_extendedprice")
    return s.select("method", *[r6(c).alias(c) for c in ("mean", "min", "max")])


@query("SELECT CAST(k AS INTEGER) AS step, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM generate_series(1, 75) g(k) LEFT JOIN (SELECT (c_custkey % 9) * 5 + c_custkey % 5 + 1 AS s, c_acctbal AS v FROM customer) ON s = k GROUP BY k")
def step_trace_parse(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("run_"), (F.col("c_custkey") % 9).cast("string"), F.lit("_adjusted_"), (F.col("c_custkey") % 5).cast("string")).alias("name"), "c_acctbal")
    return analysis.step_trace(c, "name", "c_acctbal").select("step", *[r6(x).alias(x) for x in ("mean", "min", "max")])


@query("SELECT CAST(k % 4 + 1 AS INTEGER) AS loop, round(avg(v) FILTER (r = 'a'), 6) AS a, round(avg(v) FILTER (r = 'b'), 6) AS b FROM (SELECT c_custkey AS k, c_acctbal AS v, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS r FROM customer) GROUP BY k % 4")
def loop_table(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("run_"), (F.col("c_custkey") % 4).cast("string"), F.lit("_adjusted_0")).alias("name"), "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, "a").otherwise("b").alias("rerun"))
    x = analysis.loop_table(c, "name", "rerun", "c_acctbal", ["a", "b"])
    return x.select("loop", r6("a").alias("a"), r6("b").alias("b"))


@query(WITH(HH) + "SELECT dwelltype, totalvehs, round(count(*) / sum(count(*)) OVER (PARTITION BY dwelltype), 6) AS share FROM hh GROUP BY dwelltype, totalvehs")
def vehicles_by_type(spark, d):
    return analysis.shares_by(households(spark, d), ["dwelltype"], "totalvehs").withColumn("share", r6("share"))


@query("SELECT n_nationkey AS zone, CAST(count(c_custkey) AS BIGINT) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 500) ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def zone_survey_counts(spark, d):
    return analysis.zone_counts(t(spark, d, "customer").where("c_acctbal < 500").withColumnRenamed("c_nationkey", "zone"), t(spark, d, "nation").withColumnRenamed("n_nationkey", "zone"), "zone")
