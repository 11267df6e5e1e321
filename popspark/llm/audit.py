"""What each of several filters removes under every order, from counts of failure patterns alone.

A document fails a set of filters; its pattern is that set as bits. Of a part's
pattern counts c[m], the removal polynomial

    f(x) = sum over m of c[m] * (1 - product over i in m of (1 - x_i))

is the multilinear extension of "documents removed by the filters with x_i = 1".
Its values at corners are the removals of prefixes of an order, so survivors,
removals, repeats and sole failures come from them; the Shapley value of filter
i is the integral of df/dx_i along the diagonal from 0 to 1, exact in rationals,
and times the number of orders a whole number.

Documents are counted by pattern in Spark; a part's polynomial has 2^filters
coefficients, whatever the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quality import let

SPACES = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column, min_words: int = 200, min_distinct: int = 50, max_upper: int = 2, symbols: str = "[#$%&*|]") -> list[tuple[str, Column]]:
    """Filters A to D with their failure conditions: few words, repeated words, capitals, symbols."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    few = let(sizes, lambda s: F.struct((s["n"] < min_words).alias("few"), (100 * s["d"] < min_distinct * s["n"]).alias("same")))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [("A", few["few"]), ("B", few["same"]), ("C", 100 * upper.cast("long") > max_upper * F.length(text).cast("long")), ("D", text.rlike(symbols))]


def failure_patterns(docs: DataFrame, labels: DataFrame, filters: list[Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; the bit after the last filter's is a copy's.

    A copy is a text that a smaller id has too, in whatever part. Copies are told
    by the digest of the text: rows are first counted by digest, part, pattern,
    labels and id, then by all but the id with the smallest id's count beside, so
    that a text of many copies is a few rows when its parts meet.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(filters)), F.lit(0))
    d = d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("h"), mask.alias("mask"))
    # a null id has no label and a key of its own text, so that null ids spread
    d = d.withColumns({"key": F.coalesce("id", F.xxhash64("h")), "none": F.col("id").isNull()})
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key"), F.lit(False).alias("none"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    d = d.join(marks, ["key", "none"], "left")
    marked = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = d.groupBy("h", "part", "mask", *marked, "id").agg(F.count(F.lit(1)).alias("n"))
    cell = rows.groupBy("h", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.id").over(W.partitionBy("h"))
    own = F.coalesce(F.when(F.col("least.id") == first, F.col("least.n")), F.lit(0)) + F.col("no_id")
    cell = cell.withColumn("own", own)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    cell = cell.select("part", "good", "toxic", both.alias("c")).select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cell.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good"), some("toxic"))


class Removal:
    """The removal polynomial of pattern counts: its coefficients by sets of variables, as bits."""

    def __init__(self, counts: dict[int, int], n: int):
        self.n, sets = n, range(1, 1 << n)
        self.coefficients = {t: (-1) ** (t.bit_count() + 1) * sum(c for m, c in counts.items() if m & t == t) for t in sets}

    def at(self, corner: int) -> int:
        """Documents removed by the filters in ``corner``."""
        return sum(a for t, a in self.coefficients.items() if t & corner == t)

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the derivative by x_i at (t, ..., t): t^(k-1) integrates to 1/k."""
        return sum((Fraction(a, t.bit_count()) for t, a in self.coefficients.items() if t >> i & 1), Fraction(0))


def orders(part: str, patterns: Iterable, names: str) -> Iterator[tuple]:
    """Rows of all orders and steps of one part, from its (mask, n, good, toxic)."""
    n, rows = len(names), [tuple(p) for p in patterns]
    everything = sum(r[1] for r in rows)
    of_all, of_good, of_toxic = (Removal({r[0]: r[k] for r in rows}, n) for k in (1, 2, 3))
    at, good, toxic = ([f.at(s) for s in range(1 << n)] for f in (of_all, of_good, of_toxic))
    scaled = [of_all.shapley(i) * math.factorial(n) for i in range(n)]
    full = (1 << n) - 1
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = at[after] - at[before]
            yield (part, "".join(names[j] for j in order), step, everything - at[after], removed, at[1 << i] - removed, at[full] - at[full ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(scaled[i]))
            before = after


def filter_audit(docs: DataFrame, labels: DataFrame, filters: list[tuple[str, Column]] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: survivors, removals, repeats, sole failures, labels lost, Shapley values.

    ``filters`` are (letter, failure condition over a column ``text``), the last
    filter, ``copies``, fails texts that a smaller id has. A null text is empty
    and a null part the empty string. A null id is neither smaller nor larger
    than another, so its text is no copy, and has no label; rows that share the
    smallest id of a text are all its first. A document is good or toxic if any
    row of ``labels`` (id, quality, toxic) says so. An empty table gives no
    rows; columns not named are not read.
    """
    filters = text_filters(F.col("text")) if filters is None else filters
    names = "".join(k for k, _ in filters) + copies
    patterns = failure_patterns(docs, labels, [c for _, c in filters], id_col, text_col, part_col)
    parts = patterns.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("patterns"))

    def audit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, found in zip(frame["part"], frame["patterns"]):
                yield pd.DataFrame(orders(part, [(r["mask"], r["n"], r["good"], r["toxic"]) for r in found], names), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return parts.mapInPandas(audit, SCHEMA)
