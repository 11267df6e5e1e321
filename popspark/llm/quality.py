"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame operations.

A sketch of a measure counts how many texts have which value, in millionths and
to ``DIGITS`` binary digits, so that a quantile is right to one part in 64 and
sketches merge by adding their counts, exactly and in any order: reruns and
other partitionings give the same fences. A sketch has some thousand bins at
most. Per language and source it gives each measure's quartiles, which junk in
a quarter of the texts does not reach; a text falls out where a measure lies
beyond the fences around those of its group. The sketches of a group with few
rows give way to those of its language, merged from the groups' own, and those
to the merged sketches of all. The base rules stand beside that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .durable import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Values are counted in millionths.
UNIT = 1_000_000
#: Binary digits of a value that a sketch keeps.
DIGITS = 7
#: Measure: least distance of a fence above and below the quartiles, in millionths (None: no fence there).
MEASURES: dict[str, tuple[int | None, int | None]] = {
    "symbol_share": (100_000, None),
    "dup_line_share": (300_000, None),
    "repeat_share": (250_000, None),
    "mean_word": (4_000_000, 2_000_000),
}
#: Measures that are a part of the whole: a fence is 1 at most.
PARTS = ("dup_line_share", "repeat_share")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the array.

    A window's 64-bit hash, less as many bits as a place takes, is packed with
    its place into one long: a primitive sort then brings windows together that
    may be equal. The full hashes of the places so found are compared after.
    """

    def windows(h: Column) -> Column:
        n, win = F.size(h), h
        for k in range(1, width):
            win = F.zip_with(win, F.slice(h, F.lit(k + 1), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
        return F.slice(win, F.lit(1), F.greatest(n - (width - 1), F.lit(0)))

    def covered(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        packed = F.sort_array(F.transform(w, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        key = lambda x: F.call_function("shiftright", x, bits)
        maybe = let(packed, lambda s: F.filter(s, lambda x, i: (key(x) == key(F.get(s, i - 1))) | (key(x) == key(F.get(s, i + 1)))))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        at = F.sort_array(F.transform(maybe, lambda x: let(x.bitwiseAND(low).cast("int"), lambda p: F.struct(F.get(w, p).alias("h"), p.alias("p")))))
        twice = let(at, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["p"] + k for k in range(width)])))))

    return let(let(F.transform(words, lambda x: F.xxhash64(x)), windows), covered)


def text_measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    d = docs.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), t.alias("t"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    d = d.select(
        "k", "lang", "source",
        counts.alias("c"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
    )
    return d.select("k", "lang", "source", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("c.r").cast("long").alias("n_repeat_words"), F.col("l.lines").cast("long").alias("n_lines"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of the texts with a word: a sketch is the rows of one group and measure."""
    short = lambda v: let(F.greatest(F.length(F.bin(v)) - DIGITS, F.lit(0)), lambda cut: F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), short(F.col(m)).alias("bin")) for m in MEASURES]))
    return measured.where("n_words > 0").select("lang", "source", cells.alias("c")).groupBy("lang", "source", "c.measure", "c.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, measure, n, low, high) of sketches: the smallest bins that a quarter and three quarters of the texts reach."""
    of = W.partitionBy(*group, "measure")
    s = sketch.withColumns({"upto": F.sum("n").over(of.orderBy("bin")), "every": F.sum("n").over(of)})
    edge = lambda part: F.min(F.when(4 * F.col("upto") >= part * F.col("every"), F.col("bin")))
    return s.groupBy(*group, "measure").agg(F.max("every").alias("n"), edge(1).alias("low"), edge(3).alias("high"))


def fences(measured: DataFrame, spread: int, min_group: int) -> DataFrame:
    """Per (lang, source): lower and upper fence of each measure, in millionths."""
    own = durable(sketches(measured))
    by_lang = own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    q = quartiles(own, "lang", "source")
    for name, other, on in (("l", quartiles(by_lang, "lang"), ["measure", "lang"]), ("a", F.broadcast(quartiles(of_all)), ["measure"])):
        other = other.select(*[F.col(c).alias(f"{c}_{name}") for c in (*on, "n", "low", "high")])
        q = q.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_{name}")) for c in on])
    level = lambda c: F.when(F.col("n") >= min_group, F.col(c)).when(F.col("n_l") >= min_group, F.col(f"{c}_l")).otherwise(F.col(f"{c}_a"))
    q = q.select("lang", "source", "measure", level("low").alias("low"), level("high").alias("high"))

    def edge(m: str, least: int | None, sign: int) -> Column:
        if least is None:
            return F.lit(None).cast("long")
        fence = F.col("high" if sign > 0 else "low") + sign * F.greatest(spread * (F.col("high") - F.col("low")), F.lit(least).cast("long"))
        return F.max(F.when(F.col("measure") == m, F.least(fence, F.lit(UNIT).cast("long")) if m in PARTS else fence))

    limits = [edge(m, least, sign).alias(f"{m}_{end}") for m, pair in MEASURES.items() for least, sign, end in zip(pair, (1, -1), ("hi", "lo"))]
    return q.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(*limits)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat: int = 50, spread: int = 3, min_group: int = 100, broadcast_rows: int = 20_000) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every whole text.

    A null or empty text has no words, fails the base rules and is not kept.
    Null languages and sources are groups of their own; repeated rows and ids
    give a row each; an empty table gives no rows; other columns are not read.
    """
    m = durable(text_measures(docs, id_col, text_col, lang_col, source_col))
    words, lines = F.greatest(F.col("n_words"), F.lit(1).cast("long")), F.greatest(F.col("n_lines"), F.lit(1).cast("long"))
    share = lambda part, whole: F.call_function("div", F.col(part) * UNIT, whole)
    m = m.withColumns({"symbol_share": share("n_symbols", words), "dup_line_share": share("n_dup_lines", lines), "repeat_share": share("n_repeat_words", words), "mean_word": share("word_chars", words)})
    limits = durable(fences(m, spread, min_group))
    if limits.count() <= broadcast_rows:
        limits = F.broadcast(limits)
    j = m.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    inside = F.lit(True)
    for x, (up, down) in MEASURES.items():
        if up is not None:
            inside = inside & F.coalesce(F.col(x) <= F.col(f"{x}_hi"), F.lit(True))
        if down is not None:
            inside = inside & F.coalesce(F.col(x) >= F.col(f"{x}_lo"), F.lit(True))
    return j.select(F.col("k").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))
