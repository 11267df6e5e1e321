"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. Each partition has a
threshold of its own, h hits, and sketches each of its items of n shingles, of
which t must be found, by the n - t + h smallest hashes: a text with t of the
item's shingles, however long it is, has h of these at least. The partitions
are looked up apart, with every shingle of a whole text; a text of its own
sketch would not show a short item. Pairs with h hits are verified by exact
containment of the item's shingle set. An item with fewer words than a shingle
is one shingle of its own length, in a partition for that length.

Items of up to ``block_words`` words and ``block_bytes`` bytes, both counted
first, are broadcast and searched in one pass over the texts without a shuffle.
Larger benchmarks are searched by joins, whatever their size: texts are read
once for their shingles that a bitmap of the items' shingles lets through (of
2**27 bits at most, the only thing broadcast), these meet the sketches by hash,
and candidates are counted against whole sets. Sketches take the shingles of
the fewest items first there, since any order keeps the guarantee and a phrase
of many items would pair all of them with every text that has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .arrays import U64, Words, pieces, shingles, sorted_sets
from .columns import free
from .durable import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of an item's rows in a join by item or shingle, so that those which many texts have are met in as many tasks.
SALTS = 16
#: The bitmap of the items' shingles has at most this binary logarithm of bits (16 MB).
MOST_BITS = 27


class Partition:
    """Sketches of the items of one size class, and how many hits a text needs."""

    def __init__(self, width: int, items: list[int], sets: list[np.ndarray], needs: list[int]):
        self.width = width
        self.hits = max(1, min(needs) // 4)
        sketches = [s[: len(s) - t + self.hits] for s, t in zip(sets, needs)]
        keys, of = np.concatenate(sketches), np.repeat(np.array(items), [len(s) for s in sketches])
        order = np.lexsort((of, keys))
        self.keys, self.items = keys[order], of[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U64(44)).astype(np.int64)] = True

    def candidates(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(text, item) rows, by text, that share enough of the sketch."""
        maybe = np.flatnonzero(self.seen[(values >> U64(44)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.keys, values[maybe], side=s) for s in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = np.searchsorted(bounds, np.repeat(maybe, n), side="right") - 1
        hit = np.unique(text * len(self.keys) + at)  # a shingle counts once in a text
        text, item = hit // len(self.keys), self.items[hit % len(self.keys)]
        pairs, count = np.unique(np.stack([text, item], 1), axis=0, return_counts=True)
        return pairs[count >= self.hits]


class ItemIndex:
    """One block of items, by size partition."""

    def __init__(self, texts: list[str | None], width: int, threshold: str):
        part = Fraction(threshold)
        self.sets: list[np.ndarray] = []
        classes: dict[tuple[int, int], list[int]] = {}
        for _, _, data, offsets in pieces(pa.array(texts, pa.string())):
            words = Words(data, offsets)
            sizes = np.diff(words.bounds)
            by_width = {w: list(sorted_sets(*shingles(words, w))) for w in {min(width, int(n)) for n in sizes if n}}
            for i, n in enumerate(sizes):
                s = by_width[min(width, int(n))][i] if n else np.zeros(0, U64)
                if len(s):
                    classes.setdefault((min(width, int(n)), len(s).bit_length()), []).append(len(self.sets))
                self.sets.append(s)
        self.needs = [-(-len(s) * part.numerator // part.denominator) for s in self.sets]
        self.parts = [Partition(w, ids, [self.sets[i] for i in ids], [self.needs[i] for i in ids]) for (w, _), ids in sorted(classes.items())]

    def matches(self, column: pa.Array) -> tuple[list[int], list[int], list[int]]:
        """(row, item number, shared shingles) of all contained items."""
        rows: list[int] = []
        items: list[int] = []
        shared: list[int] = []
        for first, _, data, offsets in pieces(column):
            words, width = Words(data, offsets), None
            for part in self.parts:
                if part.width != width:
                    width = part.width
                    values, bounds = shingles(words, width)
                last, own = -1, None
                for t, i in part.candidates(values, bounds):
                    if t != last:
                        last, own = t, np.unique(values[bounds[t] : bounds[t + 1]])
                    s = self.sets[i]
                    place = np.searchsorted(own, s)
                    place[place == len(own)] = 0
                    found = int((own[place] == s).sum())
                    if found >= self.needs[i]:
                        rows.append(first + int(t))
                        items.append(int(i))
                        shared.append(found)
        return rows, items, shared


def worded(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, t, n): the items that have words, and how many."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    return benchmark.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), words.alias("n")).where("n > 0")


def one_block(items: DataFrame, block_words: int, block_bytes: int) -> tuple[list, list[str]] | None:
    """Ids and texts of all items, or None where they are more than a block."""
    n, size = items.agg(F.sum("n"), F.sum(F.octet_length("t"))).collect()[0]
    if (n or 0) > block_words or (size or 0) > block_bytes:
        return None
    rows = items.select("k", "t").collect()
    return [r["k"] for r in rows], [r["t"] for r in rows]


def text_key(column: str):
    """Sixteen bytes that stand for a text; null for a null text."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def item_sets(items: DataFrame, width: int, threshold: str) -> DataFrame:
    """(i, width, n, need, hits, sketch, h): a row for each distinct shingle of items (i, t).

    ``n`` is the set's size, ``need`` of which must be found; ``hits`` of any
    ``sketch`` of its shingles are found then. Sizes of one binary length have
    the same ``hits``.
    """
    part = Fraction(threshold)
    need = lambda n: -(-n * part.numerator // part.denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, data, offsets in pieces(b.column(1)):
                words = Words(data, offsets)
                counts = np.diff(words.bounds)
                for w in {min(width, int(c)) for c in counts if c}:
                    for at, s in enumerate(sorted_sets(*shingles(words, w))):
                        if min(width, int(counts[at])) != w:
                            continue
                        n = len(s)
                        hits = max(1, need(1 << (n.bit_length() - 1)) // 4)
                        same = [pa.array(np.full(n, x)) for x in (w, n, need(n), hits, n - need(n) + hits)]
                        key = b.column(0).take(pa.array(np.full(n, first + at)))
                        yield pa.RecordBatch.from_arrays([key, *same, pa.array(s.view(np.int64))], ["i", "width", "n", "need", "hits", "sketch", "h"])

    return items.mapInArrow(run, "i binary, width long, n long, need long, hits long, sketch long, h long")


def bitmap(sets: DataFrame) -> tuple[int, np.ndarray]:
    """(binary logarithm of its bits, bytes): marks the leading bits of all shingles of the items."""
    log = min(MOST_BITS, max(10, math.ceil(math.log2(8 * max(1, sets.count())))))
    bit = F.shiftrightunsigned("h", 64 - log)
    marks = sets.select(F.shiftrightunsigned(bit, 6).alias("at"), bit.bitwiseAND(63).cast("int").alias("bit")).groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[marks["at"].to_numpy()] = marks["bits"].to_numpy()
    return log, out.view(np.uint8)


def text_shingles(texts: DataFrame, widths: Sequence[int], log: int, marks: np.ndarray) -> DataFrame:
    """(m, h): the distinct shingles of texts (m, t) that the bitmap lets through; copies of a text count once."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for b in batches:
            for first, end, data, offsets in pieces(b.column(1)):
                words = Words(data, offsets)
                found, of = [], []
                for w in widths:
                    values, bounds = shingles(words, w)
                    bit = (values >> U64(64 - log)).astype(np.int64)
                    at = np.flatnonzero(marks[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    found.append(values[at])
                    of.append(np.searchsorted(bounds, at, side="right") - 1)
                h, row = np.concatenate(found), np.concatenate(of)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                if len(h):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row[new])), pa.array(h[new].view(np.int64))], ["m", "h"])

    return texts.mapInArrow(run, "m binary, h long").distinct()


def contained_sets(texts: DataFrame, items: DataFrame, width: int, threshold: str) -> DataFrame:
    """(m, i, n_shared, n_item) of texts (m, t) and items (i, t) of any number, by joins."""
    sets = durable(item_sets(items.distinct(), width, threshold))
    rare = W.partitionBy("i").orderBy(F.floor(F.log2("f")), "h")
    rows = sets.join(sets.groupBy("h").agg(F.count(F.lit(1)).alias("f")), "h")
    sketches = rows.withColumn("at", F.row_number().over(rare)).where("at <= sketch").select("i", "hits", "h")
    widths = [r[0] for r in sets.select("width").distinct().collect()]
    seen = durable(text_shingles(texts, widths, *bitmap(sets)))
    salt = F.pmod(F.xxhash64("m"), F.lit(SALTS))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    met = seen.withColumn("salt", salt).join(sketches.withColumn("salt", every), ["h", "salt"])
    pairs = met.groupBy("m", "i", "hits").agg(F.count(F.lit(1)).alias("c")).where("c >= hits").select("m", "i", salt.alias("salt"))
    whole = pairs.join(sets.select("i", "n", "need", "h").withColumn("salt", every), ["i", "salt"]).join(seen, ["m", "h"])
    return whole.groupBy("m", "i", "n", "need").agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared >= need").select("m", "i", "n_shared", F.col("n").alias("n_item"))


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: str = "0.75", block_words: int = 2_000_000, block_bytes: int = 1 << 25) -> DataFrame:
    """(id, item id, n_shared, n_item, containment): the items that whole texts contain.

    An item counts as contained when at least ``threshold`` of its distinct
    lower-case ``width``-word shingles are in the text; one of fewer words when
    its words follow one another in the text. Null, empty or wordless items and
    texts match nothing. Repeated items and texts give a row each; no rows come from
    an empty table on either side. Only the named columns are read. The rows are
    the same beyond ``block_words`` words or ``block_bytes`` bytes of items,
    where joins take the broadcast's place.
    """
    d = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind, item_kind = d.schema["k"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = worded(benchmark, item_col, item_text_col)
    block = one_block(items, block_words, block_bytes)
    if block is None:
        d, named = d.withColumn("m", text_key("t")), items.withColumn("i", text_key("t"))
        found = durable(contained_sets(d.select("m", "t"), named.select("i", "t"), width, threshold))
        out = d.select("k", "m").join(found, "m").join(named.select("i", F.col("k").alias("item")), "i")
        out = out.select("k", F.col("item").alias("i"), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast((block[0], ItemIndex(block[1], width, threshold)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for b in batches:
                rows, items, found = index.matches(b.column(1))
                if rows:
                    sizes = [len(index.sets[i]) for i in items]
                    names = pa.array([ids[i] for i in items])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), names, pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x / n for x, n in zip(found, sizes)])], ["k", "i", "n_shared", "n_item", "containment"])

        out = d.mapInArrow(run, f"k {kind}, i {item_kind}, n_shared long, n_item long, containment double")
    return out.withColumnsRenamed({"k": id_col, "i": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: str = "0.75", block_words: int = 2_000_000, block_bytes: int = 1 << 25) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all their columns.

    Containment is that of ``contained_items``. A row is judged by its own text,
    so that rows that share an id go or stay apart; null, empty and wordless
    texts stay; repeated rows all go or all stay; an empty table on either side
    changes nothing. Columns pass through whatever their names are.
    """
    items = worded(benchmark, item_col, item_text_col)
    block = one_block(items, block_words, block_bytes)
    if block is None:
        own = text_key(text_col)
        (m,) = free(docs.columns, 1)
        found = contained_sets(docs.select(own.alias("m"), F.col(text_col).alias("t")), items.select(text_key("t").alias("i"), "t"), width, threshold)
        gone = durable(found.select(F.col("m").alias(m)).distinct())
        return docs.withColumn(m, own).join(gone, m, "left_anti").select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(block[1], width, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[shared.value.matches(b.column(at))[0]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
