"""Household relationships: the Main person, plausibility and relabelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The relations, and the age gaps in years that make a relation plausible.
RELATIONS = ("Main", "Spouse", "Child", "Grandchild", "Sibling", "Others", "Parent", "Grandparent")
PARENT_GAP, GRANDPARENT_GAP = 15, 33
SPOUSE_AGE, SPOUSE_GAP = 16, 20


def first_is_main(persons: DataFrame, household: str = "hhid", order: str = "persid") -> DataFrame:
    """The first person of each household, by an explicit order, becomes its Main."""
    n = F.row_number().over(W.partitionBy(household).orderBy(order))
    return persons.withColumn("relationship", F.when(n == 1, "Main").otherwise(F.col("relationship")))


def top_earner(persons: DataFrame, household: str = "hhid", order: str = "persid", income: str = "income") -> DataFrame:
    """``is_top``: the highest income; a tie goes to the Main person, then to the first."""
    w = W.partitionBy(household).orderBy(F.desc(income), F.desc(F.col("relationship") == "Main"), order)
    return persons.withColumn("is_top", F.row_number().over(w) == 1)


def implausible(persons: DataFrame, household: str = "hhid") -> DataFrame:
    """(household, implausible): a child, parent or one removed too near the Main person in age."""
    main_age = F.max(F.when(F.col("relationship") == "Main", F.col("age"))).over(W.partitionBy(household))
    gap = F.abs(F.col("age") - main_age)
    near = (F.col("relationship").isin("Child", "Parent") & (gap < PARENT_GAP)) | (F.col("relationship").isin("Grandchild", "Grandparent") & (gap < GRANDPARENT_GAP))
    return persons.select(household, F.coalesce(near, F.lit(False)).alias("n")).groupBy(household).agg(F.max("n").alias("implausible"))


def relabel(persons: DataFrame, household: str = "hhid", order: str = "persid", income: str = "income") -> DataFrame:
    """Relations seen from the household's top earner, who becomes Main.

    Windows give each person the top earner's former relation, age and sex; one
    ``when`` per former relation then says what everybody becomes. The first
    person by ``order`` who fits as Spouse becomes one. A Parent or Grandparent
    as top earner raises. Households that are implausible before are left as
    they are but for the top earner.
    """
    hh = W.partitionBy(household)
    p = top_earner(persons, household, order, income)
    for c in ("relationship", "age", "sex"):
        p = p.withColumn(f"__t_{c}", F.max(F.when(F.col("is_top"), F.col(c))).over(hh))
    p = p.join(implausible(persons, household), household)
    was, top, age, t_age = F.col("relationship"), F.col("__t_relationship"), F.col("age"), F.col("__t_age")
    fits = (was == "Others") & ~F.col("is_top") & (age > SPOUSE_AGE) & (t_age > SPOUSE_AGE) & (F.abs(age - t_age) <= SPOUSE_GAP) & (F.col("sex") != F.col("__t_sex"))
    p = p.withColumn("__spouse", F.coalesce(fits, F.lit(False)))
    p = p.withColumn("__spouse", F.col("__spouse") & (F.row_number().over(hh.orderBy(F.desc("__spouse"), order)) == 1))
    of_age = (was == "Child") & (age - t_age >= PARENT_GAP)
    p = p.withColumn("__parent", F.coalesce(of_age, F.lit(False)))
    p = p.withColumn("__before", F.coalesce(F.max(F.col("__parent").cast("int")).over(hh.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rest = F.when(F.col("__spouse"), "Spouse")
    new = (
        F.when(F.col("is_top"), "Main")
        .when(F.col("implausible") | (top == "Main"), was)
        .when(top == "Spouse", F.when(was == "Main", "Spouse").when(was == "Sibling", "Others").otherwise(was))
        .when(top == "Child", rest.when(was.isin("Main", "Spouse"), "Parent").when(was == "Child", "Sibling").when(was == "Sibling", "Others").when(was == "Grandchild", F.when(t_age - age >= PARENT_GAP, "Child").otherwise("Others")).otherwise(was))
        .when(top == "Sibling", rest.when(was == "Main", "Sibling").when(was.isin("Spouse", "Child", "Grandchild"), "Others").otherwise(was))
        .when(top == "Grandchild", rest.when(was.isin("Main", "Spouse"), "Grandparent").when(was == "Child", F.when(F.col("__before") == 1, "Others").when(F.col("__parent"), "Parent").otherwise("Child")).when(was == "Grandchild", "Sibling").otherwise(was))
        .when(top == "Others", "Others")
        .otherwise(F.raise_error(F.concat(F.lit("cannot see a household from its "), top)))
    )
    return p.withColumn("relationship", new).select(*persons.columns)


def process_relationships(persons: DataFrame, household: str = "hhid", order: str = "persid", income: str = "income") -> DataFrame:
    """Relabelled persons of the households that are plausible afterwards."""
    p = relabel(first_is_main(persons, household, order), household, order, income)
    return p.join(implausible(p, household).where("implausible").select(household), household, "left_anti")


def relation_counts(persons: DataFrame, household: str = "hhid", relations: Sequence[str] = RELATIONS) -> DataFrame:
    """``n_<relation>`` columns of each household, 0 where nobody has it."""
    got = persons.groupBy(household).agg(*[F.count_if(F.col("relationship") == r).alias(f"n_{r}") for r in relations])
    return got


def spouse_type(persons: DataFrame, household: str = "hhid", order: str = "persid") -> DataFrame:
    """No, Typical (another sex, gap of at most 20 years) or Special spouse, with or without a child.

    Of several spouses the first by ``order`` counts.
    """

    def first(relation: str, c: str) -> Column:
        return F.min_by(F.when(F.col("relationship") == relation, F.col(c)), F.when(F.col("relationship") == relation, F.col(order)))

    g = persons.groupBy(household).agg(*[first(r, c).alias(f"{r}_{c}") for r in ("Main", "Spouse") for c in ("age", "sex")], F.count_if(F.col("relationship") == "Spouse").alias("spouses"), F.count_if(F.col("relationship") == "Child").alias("children"))
    kind = F.when(F.col("spouses") == 0, "No spouse").when((F.col("Main_sex") != F.col("Spouse_sex")) & (F.abs(F.col("Main_age") - F.col("Spouse_age")) <= SPOUSE_GAP), "Typical spouse").otherwise("Special spouse")
    return g.select(household, F.concat(kind, F.when(F.col("children") > 0, " with child").otherwise(" without child")).alias("spouse_type"))


def attach_weights(df: DataFrame, weights: DataFrame, id_col: str, weight: str = "_weight") -> DataFrame:
    """Weights by id; ``persid_main`` comes before ``persid`` where a table has it."""
    key = "persid_main" if id_col == "persid" and "persid_main" in df.columns else id_col
    return df.join(weights.select(F.col(id_col).alias("__id"), weight), F.col(key) == F.col("__id"), "left").drop("__id")
