"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations.

Every text is a sequence of lines with a word, and every line a suffix of it.
Prefix doubling sorts the suffixes of all texts at once: a line's rank is its
place among all lines' hashes; the rank by 2**(k+1) lines is the place of the
pair of ranks by 2**k lines, of the suffix itself and of the one 2**k lines
on. Each step is a grouping of pairs and a running sum of their counts, split
by ranges. A suffix whose first 2**k lines occur once leaves the order there: it
shares no longer run with anyone.

Suffixes with a common prefix of L lines are an interval of that order; two
overlapping ranks by the largest power of two up to L lines name it. For each
line, the shortest run that starts with it and the shortest that ends with it
and has at least ``min_words`` words are looked up: the union of those whose
interval holds an earlier suffix is the union of all maximal repeated runs of
at least ``min_words`` words. Of each run, all copies but the first (smallest
id, then first line) go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import free
from .durable import durable, partitions
from .quality import let

WORD = r"[^\x20\x09-\x0D]+"
#: A suffix's text and line.
AT = ("k", "d", "pos")


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(k, d, pos, line, w, before) of the lines with a word of texts (k, d, t): place, hash, words, words before it in the text."""
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    d = docs.where(F.octet_length("t") >= 2 * min_words - 1).select("k", "d", F.posexplode(F.filter(lines, lambda s: s["w"] > 0)).alias("pos", "s")).select(*AT, "s.line", "s.w")
    # rows alike in id and text come together and count once
    d = d.repartition(partitions(docs.sparkSession), "k", "d").dropDuplicates(list(AT))
    own = W.partitionBy("k", "d").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return d.withColumn("before", F.sum("w").over(own) - F.col("w"))


def placed(groups: DataFrame, key: str, shift: int, *within: str) -> DataFrame:
    """``groups`` with ``start``: the sum of n over the groups alike in ``within`` whose key is smaller.

    Running sums are two-level, over ranges of the key (its bits from ``shift``
    on) and inside each, so that no ``within`` is a single task's.
    """
    g = groups.withColumn("range", F.shiftright(key, shift))
    totals = g.groupBy(*within, "range").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy(*within).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*[F.col(c).alias(f"{c}_t") for c in (*within, "range")], F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n").over(W.partitionBy(*within, "range").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    g = g.withColumn("inside", inside).join(totals, [F.col(c) == F.col(f"{c}_t") for c in (*within, "range")])
    return g.select(*groups.columns, (F.col("base") + F.col("inside")).alias("start"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """``lines`` that occur again, with rank."""
    again = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = placed(again, "line", 52).select(F.col("line").alias("line_r"), F.col("start").alias("rank"))
    return lines.join(again, F.col("line") == F.col("line_r")).drop("line_r")


def doubled(ranks: DataFrame, k: int) -> DataFrame:
    """(k, d, pos, rank) by 2**(k+1) lines from those by 2**k, for the suffixes that share these with another."""
    ahead = F.max("rank").over(W.partitionBy("k", "d").orderBy("pos").rangeBetween(1 << k, 1 << k))
    pairs = ranks.select(*AT, F.col("rank").alias("r1"), ahead.alias("r2")).where("r2 IS NOT NULL")
    again = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = placed(again, "r2", 20, "r1").select(F.col("r1").alias("p1"), F.col("r2").alias("p2"), (F.col("r1") + F.col("start")).alias("rank"))
    return pairs.join(again, (F.col("r1") == F.col("p1")) & (F.col("r2") == F.col("p2"))).select(*AT, "rank")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(k, d, first, last, level) of the shortest runs of min_words words that start or end with a line; no line between may be missing."""
    own = W.partitionBy("k", "d")
    ahead = own.orderBy("before").rangeBetween(0, min_words - 1)
    behind = own.orderBy("after").rangeBetween(-(min_words - 1), 0)
    r = lines.withColumn("after", F.col("before") + F.col("w"))
    run = lambda first, last, words, n: F.when((words >= min_words) & (n == last - first + 1), F.struct(first.alias("first"), last.alias("last")))
    pos, before, after = F.col("pos"), F.col("before"), F.col("after")
    starts = run(pos, F.max("pos").over(ahead), F.max("after").over(ahead) - before, F.count(F.lit(1)).over(ahead))
    ends = run(F.min("pos").over(behind), pos, after - F.min("before").over(behind), F.count(F.lit(1)).over(behind))
    r = r.select("k", "d", F.array(starts, ends).alias("both")).select("k", "d", F.explode("both").alias("r")).where("r IS NOT NULL").select("k", "d", "r.*").distinct()
    return r.withColumn("level", F.length(F.bin((F.col("last") - F.col("first") + 1).cast("long"))) - 1)


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(k, d, first, last) of the runs whose lines also run earlier, of texts (k, d, t)."""
    ranks = durable(first_ranks(durable(lines_of(docs, min_words))))
    runs = durable(shortest_runs(ranks, min_words))
    top = runs.agg(F.max("level")).collect()[0][0]
    levels = [ranks.select(*AT, "rank")]
    for k in range(top or 0):
        levels.append(durable(doubled(levels[-1], k)))
    every = None
    for k, table in enumerate(levels):
        part = table.select(*AT, "rank", F.lit(k).alias("level"))
        every = part if every is None else every.unionByName(part)
    places = [every.select(*[F.col(c).alias(f"{c}{i}") for c in (*AT, "rank", "level")]) for i in (1, 2)]
    on = lambda i, pos: F.col("k").eqNullSafe(F.col(f"k{i}")) & (F.col("d") == F.col(f"d{i}")) & (F.col("level") == F.col(f"level{i}")) & (pos == F.col(f"pos{i}"))
    second = F.col("last") + 1 - F.call_function("shiftleft", F.lit(1), F.col("level"))
    named = runs.join(places[0], on(1, F.col("first"))).join(places[1], on(2, second))
    size = F.col("last") - F.col("first") + 1
    named = durable(named.select("k", "d", "first", "last", F.struct(size.alias("size"), F.col("rank1").alias("a"), F.col("rank2").alias("b")).alias("name")))
    kept = named.groupBy("name").agg(F.min(F.struct("k", "d", "first")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("name").alias("name1"), "kept")
    return named.join(kept, F.col("name") == F.col("name1")).where(F.struct("k", "d", "first") > F.col("kept")).select("k", "d", "first", "last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` without the later copies of repeated line runs, with n_lines and n_removed.

    Lines are split at \\n and compared whole. Lines without a word belong to no
    run and stay. Overlapping runs count, judged on the input; runs of fewer
    words than ``min_words`` stay. A null text stays null and an empty one empty
    (n_removed 0); a text that loses all its lines with a word keeps what is
    left, maybe an empty text. Of texts that share an id, a null id too, the one
    with the smaller hash counts as earlier; a null id is the smallest. Rows
    alike in id and text are no copies of one another. An empty table gives no
    rows. Other columns pass through unchanged; columns of the input that are
    called n_lines or n_removed, in any case, are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, text_hash, gone_col, got_col = free(docs.columns, 4)
    t = docs.select(F.col(id_col).alias("k"), F.xxhash64(text_col).alias("d"), F.col(text_col).alias("t"))
    gone = repeated_runs(t, min_words).groupBy("k", "d").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    places = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    gone = durable(gone.select(F.col("k").alias(key), F.col("d").alias(text_hash), places.alias(gone_col)))
    j = docs.select(*keep).join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text_hash)), "left")
    lines = F.split(F.col(text_col), "\n", -1)

    def cut(a: Column) -> Column:
        places = F.filter(F.transform(a, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
        lost = let(places, lambda p: F.transform(gone_col, lambda g: F.get(p, g)))
        left = F.array_except(F.sequence(F.lit(0), F.size(a) - 1), lost)
        return F.struct(F.array_join(F.transform(left, lambda i: F.get(a, i)), "\n").alias("t"), F.size(a).alias("n"), F.size(gone_col).alias("r"))

    got = F.when(F.col(gone_col).isNotNull(), let(lines, cut)).otherwise(F.struct(F.col(text_col).alias("t"), (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).alias("n"), F.lit(0).alias("r")))
    j = j.select(*keep, got.alias(got_col))
    return j.select(*[F.col(f"{got_col}.t").alias(c) if c == text_col else F.col(c) for c in keep], F.coalesce(f"{got_col}.n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(f"{got_col}.r", F.lit(0)).cast("long").alias("n_removed"))
