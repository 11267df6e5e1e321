"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Each source's documents are shuffled by a keyed digest and queued, twice over.
An entry's virtual finish time is the cumulative size of its source up to and
with it, divided by the source's target, so that all sources reach time 1
together; the second copy of a document has a time of its own. An entry that
begins before time 1 and ends after it is queued word by word. All entries of
all sources are put in one order of finish times, by ranges of the time, and a
running total of their words against the total budget decides alone what is
taken: it runs out near time 1, wherever the entries then are. A document's
place in that order, in words, is ``mix_start``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .columns import free
from .durable import durable, partitions

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take the weights in turn. ``share``
    of all sizes is dealt by weight; a target stops at ``cap`` times its
    source's size and what is over is dealt again by weight. That is one level
    ``x`` with target = min(cap * size, weight * x); it comes from a running sum
    over sources by cap * size / weight, with one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    per = per.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("top") / F.col("w"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    done = up.rowsBetween(W.unboundedPreceding, -1)
    rest = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_rows = W.partitionBy()
    per = per.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("top").over(done), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"]
    return per.select("source", "source_size", F.when(level.isNull(), F.col("top")).otherwise(F.least("top", F.col("w") * level)).alias("target"))


def entries(queue: DataFrame, cap: float) -> DataFrame:
    """(queue, copy, piece, w, finish) of documents that have words: an entry for each copy, one for each word where time 1 falls into it."""
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1)), lambda p: F.struct(p.alias("copy"), (F.col("end") + p * F.col("source_size")).alias("upto"))))
    q = queue.where((F.col("size") > 0) & (F.col("target") > 0)).select("*", copies.alias("c"))
    begin = F.col("c.upto") - F.col("size")
    split = (begin < F.col("target")) & (F.col("c.upto") > F.col("target"))
    piece = lambda n, w, upto: F.struct(n.alias("piece"), w.cast("long").alias("w"), (upto / F.col("target")).alias("finish"))
    pieces = F.when(split, F.transform(F.sequence(F.lit(1).cast("long"), F.col("size")), lambda j: piece(j, F.lit(1), begin + j))).otherwise(F.array(piece(F.lit(0).cast("long"), F.col("size"), F.col("c.upto"))))
    return q.select(*queue.columns, F.col("c.copy").alias("copy"), F.explode(pieces).alias("p")).select(*queue.columns, "copy", "p.*")


def taken_words(queue: DataFrame, budget: DataFrame, cap: float, ranges: int) -> DataFrame:
    """(source, end, taken, mix_start) of the documents that the budget reaches, in the order (finish, source, o, k, size, copy, piece).

    Ranges of the virtual time are about equal shares of the words: a running
    sum over the ranges' totals and one inside each range give an entry's place.
    Ranges that begin after the budget are not looked into.
    """
    e = entries(queue, cap).withColumn("r", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)).cast("int"))
    totals = e.groupBy("r").agg(F.sum("w").alias("words"))
    before = F.coalesce(F.sum("words").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = totals.select(F.col("r").alias("r2"), before.alias("start")).crossJoin(F.broadcast(budget)).where("start < budget")  # a row a range at most
    inside = W.partitionBy("r").orderBy("finish", "source", "o", "k", "size", "copy", "piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.join(F.broadcast(reached), F.col("r") == F.col("r2")).withColumn("place", F.col("start") + F.sum("w").over(inside) - F.col("w"))
    e = e.withColumn("got", F.least("w", F.col("budget") - F.col("place"))).where("got > 0")
    return e.groupBy(F.col("source").alias("s4"), F.col("end").alias("e4")).agg(F.sum("got").alias("taken"), F.min("place").alias("mix_start"))


def _queued(docs: DataFrame, seed: str, share: float, cap: float, weights: tuple[int, ...], buckets: int | None) -> DataFrame:
    """(k, source, more columns, size) rows queued, cut and placed."""
    buckets = buckets or max(4096, 8 * partitions(docs.sparkSession))
    more = [c for c in docs.columns if c not in ("k", "source", "size")]
    d = docs.withColumn("o", F.md5(F.concat_ws(":", F.lit(seed), F.col("k").cast("string"))))
    d = d.withColumn("b", (F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("int"))
    sums = d.groupBy("source", "b").agg(F.sum("size").alias("size"))
    before = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s2"), F.col("b").alias("b2"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    targets = source_targets(sums, share, cap, weights).withColumnRenamed("source", "s3")
    starts = starts.join(targets, F.col("s2").eqNullSafe(F.col("s3"))).drop("s3")
    inside = W.partitionBy("source", "b").orderBy("o", "k", "size", *more).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("run", F.sum("size").over(inside))
    d = d.join(starts, (F.col("b") == F.col("b2")) & F.col("source").eqNullSafe(F.col("s2")))
    end = F.col("base") + F.col("run")
    finish = F.when(F.col("target") > 0, end / F.col("target"))
    queue = durable(d.select("k", "source", *more, "size", "source_size", "target", "o", end.alias("end"), finish.alias("finish")))
    # the targets add up to this, in whole numbers: only sources that stop at the cap leave something over
    budget = targets.agg(F.floor(F.lit(float(min(share, cap))) * F.sum("source_size")).cast("long").alias("budget"))
    got = taken_words(queue.drop("finish"), budget, cap, buckets)
    # of a source's documents with words, each ends at a place of its own
    same = F.col("source").eqNullSafe(F.col("s4")) & (F.col("end") == F.col("e4")) & (F.col("size") > 0)
    return queue.join(got, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("s4", "e4", "end")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), buckets: int | None = None) -> DataFrame:
    """Every document with size, source_size, target, taken, virtual finish time and place in the mix.

    ``size`` is the number of words (null text: 0); ``taken`` the words that the
    mix takes of the document, repeats counted; at most ``cap`` times its size.
    Documents of size 0, or of a source without words, have taken 0. Ties in
    the shuffle go by id, then size; rows alike in both may swap places, which
    leaves the rows the same. Null ids and sources are values like others; an
    empty table gives no rows. Only the three named columns are read.

    Running sums are two-level: totals of hash buckets (``buckets``, by default
    eight for each shuffle partition and 4096 at least), then sums inside one, so
    that a source with most of the rows is no single task. All sources' totals
    meet in one task: they are a row each.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).alias("k"), F.col(source_col).alias("source"), size.alias("size"))
    q = _queued(d, seed, share, cap, weights, buckets)
    return q.select(F.col("k").alias(id_col), "source", "size", "source_size", "target", "taken", F.col("finish").alias("finish_time"), "mix_start")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with size, target, taken, finish_time and mix_start.

    Each row has the words that the mix takes of its own text: rows that share
    an id are told apart by text and source, null ids too. Of rows alike in
    these, one stays for all, with their words together and the first one's
    place. Texts without a word and texts after the cut are not among the rows;
    an empty table gives none. Columns of the input with one of the new names
    are replaced, all others pass through.
    """
    new = ["size", "target", "taken", "finish_time", "mix_start"]
    keep = [c for c in docs.columns if c.lower() not in new]
    key, hashed, source, again = free(docs.columns, 4)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).alias("k"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("d"), size.alias("size"))
    q = _queued(d, seed, share, cap, weights, buckets).where("taken > 0")
    q = q.groupBy(F.col("k").alias(key), F.col("d").alias(hashed), F.col("source").alias(source)).agg(
        F.max("size").alias("size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.min("finish").alias("finish_time"), F.min("mix_start").alias("mix_start"), F.count(F.lit(1)).alias(again)
    )
    q = durable(q)
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(hashed)) & F.col(source_col).eqNullSafe(F.col(source))
    out = docs.select(*keep).join(q, on)
    if not q.where(F.col(again) > 1).isEmpty():
        out = out.where(F.col(again) == 1).unionByName(out.where(F.col(again) > 1).dropDuplicates([id_col, text_col, source_col]))
    return out.select(*keep, *new)
