"""Removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash over ``ANCHOR`` bytes sets triggers: of the hashes inside a
window of ``LENGTH`` bytes the smallest is the window's trigger. Windows that
follow one another with one trigger make a phrase, so a trigger, and with it
the grouping, depends on the window's own bytes alone, and every window is in
one phrase. The parse of the corpus is its sequence of phrase hashes. Phrases
that occur again in full are settled on the parse: all windows of a later copy
are repeats, and copies that one map task sees are settled there, so that a run
of one byte, which has a phrase for each of its windows, brings no key more than
a row from each task. What is left is the dictionary of distinct phrases; of these only
the ones whose trigger string occurs in another phrase can share a window. They
meet by trigger, in parts of the dictionary of about a megabyte, each of whole
triggers; the suffix array of such a part, by prefix doubling up to ``LENGTH``
bytes, gives the first of equal windows in corpus order. No window runs over a phrase's end, so the parse is compared
phrase by phrase and needs no suffix array of its own.

Triggers and phrases are compared by 64-bit hashes. A trigger whose distinct
phrases are many (``hot``) sends its windows one by one, by hash and combined
in the map task, so that no task holds all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, _TABLE, mix, pieces, powers
from .blobs import SCHEMA, bucket_count, by_bucket, packed, unpacked
from .durable import durable, partitions

#: Bytes of a trigger string.
ANCHOR = 32
_CHUNK = 1 << 20
_LOW = U64(_CHUNK - 1)
_FLUSH = 1 << 21
#: Bytes of a part of the dictionary that is sorted at once; the phrases of one trigger stay together.
_PART = 1 << 20


class Phrases:
    """Phrases of a run of texts of fewer than 2**20 bytes, or of a part of one text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n = len(data)
        p, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_TABLE[False][data] * p[:-1], out=self.sums[1:])
        empty = np.zeros(0, np.int64)
        self.text = self.at = self.count = self.owner = empty
        if n < length:
            return
        starts = np.arange(n - ANCHOR + 1)
        self.keys = self.span(starts, starts + ANCHOR)
        low = (self.keys & ~_LOW) | starts.astype(U64)
        span, width = length - ANCHOR + 1, 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        owner = (low & _LOW).astype(np.int64)
        size = np.diff(offsets)
        inside = np.repeat(np.where(size >= length, 1, 0), size).astype(bool)
        left = np.repeat(offsets[1:], size)[: len(owner)] - np.arange(len(owner))
        inside = inside[: len(owner)] & (left >= length)
        at = np.flatnonzero(inside)
        if not len(at):
            return
        own = owner[at]
        new = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(new)
        self.at, self.owner = at[first], own[first]
        self.count = np.diff(np.append(first, len(at)))
        self.text = np.searchsorted(offsets, self.at, side="right") - 1

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _parts(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[Phrases, np.ndarray, int]]:
    """(phrases, bytes, place of the part in its text); a long text in overlapping parts."""
    if len(data) < _CHUNK:
        yield Phrases(data, offsets, length), data, 0
        return
    step = _CHUNK - length
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        for at in range(0, max(1, len(text) - length + 1), step):
            part = text[at : at + step + length - 1]
            p = Phrases(part, np.array([0, len(part)]), length)
            p.text = p.text + i
            yield p, part, at


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _parse(docs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """The parse, by trigger: (trigger, phrase hash, text, start, windows); kind 1: (text, start, windows) of later copies inside one task, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                key, content, text, start, count = (np.concatenate(c) for c in zip(*held))
                held.clear()
                firsts, later = _first_copies(key, content, text, start)
                key = mix(key[firsts])  # a trigger is the least of many hashes, and lies near 0
                yield from packed(key, [key.astype(np.uint32), *(x[firsts] for x in (content, text, start, count))], n_buckets)
                text, start, count = _runs(text[later], start[later], count[later])
                yield from packed(mix(text.view(U64)), [text, start, count], n_buckets, 1)

        n = 0
        for b in batches:
            ids = _ids(b.column(0))
            for first, _, data, offsets in pieces(b.column(1), _CHUNK - 1):
                for p, _, at in _parts(data, offsets, length):
                    if not len(p.at):
                        continue
                    content = mix(p.span(p.at, p.at + p.count + length - 1) + (p.owner - p.at).astype(U64) * U64(0xD6E8FEB86659FD93) + p.count.astype(U64))
                    start = (p.at - (offsets[p.text] if not at and len(data) < _CHUNK else 0) + at).astype(np.uint32)
                    held.append([p.keys[p.owner], content, ids[first + p.text], start, p.count.astype(np.uint8)])
                    n += len(p.at)
                if n >= _FLUSH:
                    yield from flush()
                    n = 0
        yield from flush()

    return docs.mapInArrow(run, SCHEMA)


def _first_copies(key: np.ndarray, content: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their phrase, and the later ones; rows that share their place count once."""
    both = mix(key + content * U64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    both = both[order]
    same = both[1:] == both[:-1]
    copied = np.append(False, same) | np.append(same, False)
    alone, order = order[~copied], order[copied]
    order = order[np.lexsort((start[order], text[order], content[order], key[order]))]
    if not len(order):
        return alone, order
    k, c, t, s = (x[order] for x in (key, content, text, start))
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    again = ~new & np.append(False, (t[1:] == t[:-1]) & (s[1:] == s[:-1]))
    return np.append(alone, order[new]), order[~new & ~again]


def _runs(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows) by text, with windows that follow one another, or meet, made one run."""
    if not len(text):
        return text.astype(np.int64), start.astype(np.uint32), count.astype(np.uint32)
    order = np.lexsort((start, text))
    text, start = text[order], start[order].astype(np.int64)
    end = start + count[order]
    # one row of places, text after text, in which no run reaches the next text
    begins = np.append(True, text[1:] != text[:-1])
    longest = int(end.max()) + 1
    reach = np.maximum.accumulate(end + (np.cumsum(begins) - 1) * longest) - (np.cumsum(begins) - 1) * longest
    first = np.flatnonzero(begins | np.append(True, start[1:] > reach[:-1]))
    last = np.append(first[1:], len(text)) - 1
    return text[first], start[first].astype(np.uint32), (reach[last] - start[first]).astype(np.uint32)


_ENTRY = [np.uint32, U64, np.int64, np.uint32, np.uint8]


def _passed(blobs: list[bytes], bucket: int, kind: int) -> Iterator[pa.RecordBatch]:
    for blob in blobs:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "blob"])


def _settle(kinds: dict[int, list[bytes]], bucket: int, n_buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    """By text: (text, start, windows, what): 0 repeats, 1 to compare by trigger, 2 to compare by window; kind 1 as it comes."""
    yield from _passed(kinds.get(1, []), bucket, 1)
    key, content, text, start, count = unpacked(kinds.get(0, []), _ENTRY)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.append(False, same) | np.append(same, False) if len(key) else np.zeros(0, bool)
    order, key = order[twice], key[twice]
    content, text, start, count = content[order], text[order], start[order], count[order]
    order = np.lexsort((start, text, content, key))
    key, content, text, start, count = (x[order] for x in (key, content, text, start, count))
    if not len(key):
        return
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key | np.append(True, content[1:] != content[:-1])
    group = np.cumsum(new_key) - 1
    kinds_of = np.bincount(group, new)[group]
    what = np.where(~new, 0, np.where(kinds_of > hot, 2, 1)).astype(np.uint8)
    again = ~new & (text == np.roll(text, 1)) & (start == np.roll(start, 1))  # rows that share their id
    keep = (~new & ~again) | (kinds_of > 1) & new
    yield from packed(mix(text[keep].view(U64)), [text[keep], start[keep], count[keep], what[keep]], n_buckets)


def _by_text(kinds: dict[int, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
    """(k, repeats, compare): packed (start, windows) and (start, what) of each text."""
    text, start, count, what = unpacked(kinds.get(0, []), [np.int64, np.uint32, np.uint8, np.uint8])
    copies = unpacked(kinds.get(1, []), [np.int64, np.uint32, np.uint32])
    text, start, count = (np.concatenate(x) for x in zip((text, start, count.astype(np.uint32)), copies))
    what = np.append(what, np.zeros(len(copies[0]), np.uint8))
    order = np.lexsort((start, text))
    text, start, count, what = (x[order] for x in (text, start, count, what))
    firsts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
    out: list[tuple] = []
    for i, j in zip(firsts, np.append(firsts[1:], len(text)) if len(firsts) else []):
        w = what[i:j]
        spans, ask = w == 0, w > 0
        out.append((int(text[i]), start[i:j][spans].tobytes() + count[i:j][spans].tobytes() or None, start[i:j][ask].tobytes() + w[ask].tobytes() or None))
    if out:
        k, a, b = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["k", "repeats", "compare"])


def _contexts(texts: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Kind 0: phrases with their bytes, by trigger; kind 1: windows, by hash; kind 2: windows known as repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                key, text, start, count = (np.concatenate(c) for c in list(zip(*held))[:4])
                raw = [r for h in held for r in h[4]]
                bucket = ((mix(key) >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                blobs = []
                for i, j in zip(first, np.append(first[1:], len(order))):
                    o = order[i:j]
                    blobs.append(np.uint32(len(o)).tobytes() + key[o].tobytes() + text[o].tobytes() + start[o].tobytes() + count[o].tobytes() + b"".join(raw[x] for x in o))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([0] * len(found), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
                held.clear()
            if windows:
                w, text, start = (np.concatenate(c) for c in zip(*windows))
                windows.clear()
                w, text, start, new = _first_of_equal(w, text, start)
                yield from packed(w[new], [w[new], text[new], start[new]], n_buckets, 1)
                yield from packed(mix(text[~new].view(U64)), [text[~new], start[~new], np.ones((~new).sum(), np.uint32)], n_buckets, 2)

        n = 0
        for b in batches:
            ids = _ids(b.column(0))
            asked = b.column(2).to_pylist()
            for first, _, data, offsets in pieces(b.column(1), _CHUNK - 1):
                for p, part, at in _parts(data, offsets, length):
                    base = offsets[p.text] if not at and len(data) < _CHUNK else np.zeros(len(p.text), np.int64)
                    for t in np.unique(p.text):
                        blob = asked[first + t]
                        m = len(blob) // 5
                        starts, what = np.frombuffer(blob, np.uint32, m), np.frombuffer(blob, np.uint8, m, 4 * m)
                        mine = np.flatnonzero(p.text == t) if len(offsets) > 2 else np.arange(len(p.text))
                        own = (p.at[mine] - base[mine] + at).astype(np.uint32)
                        place = np.searchsorted(starts, own)
                        place[place == m] = 0
                        hit = starts[place] == own
                        for code in (1, 2):
                            sel = mine[hit & (what[place] == code)]
                            if not len(sel):
                                continue
                            begin = (p.at[sel] - base[sel] + at).astype(np.uint32)
                            doc = np.full(len(sel), ids[first + t])
                            if code == 1:
                                raw = [part[i : i + c + length - 1].tobytes() for i, c in zip(p.at[sel], p.count[sel])]
                                held.append((p.keys[p.owner[sel]], doc, begin, p.count[sel].astype(np.uint8), raw))
                                n += int(p.count[sel].sum()) + length * len(sel)
                            else:
                                c = p.count[sel]
                                off = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                                pos = np.repeat(p.at[sel], c) + off
                                windows.append([p.span(pos, pos + length), np.repeat(doc, c), np.repeat(begin, c) + off.astype(np.uint32)])
                                n += 20 * len(pos)
                if n >= 4 * _FLUSH:
                    yield from flush()
                    n = 0
        yield from flush()

    return texts.mapInArrow(run, SCHEMA)


def _first_of_equal(w: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows by hash, then place; whether each is the first of its hash (rows that share a place are alike)."""
    order = np.lexsort((start, text, w))
    w, text, start = w[order], text[order], start[order]
    new = np.append(True, w[1:] != w[:-1])[: len(w)]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    new |= (text == text[first][group]) & (start == start[first][group])
    return w, text, start, new


def suffix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Places, in lexical order, of the strings of ``length`` bytes that begin at each byte; equal strings share one.

    Prefix doubling: the rank by 2 * w bytes is that of the pair of ranks by w
    bytes, of the place itself and of the one w bytes on; the last step overlaps.
    """
    r, width = raw.astype(np.int64), 1
    while width < length and len(r):
        step = min(width, length - width)
        n = max(0, len(r) - step)
        pair = r[:n] << 32
        pair |= r[step : step + n]
        order = np.argsort(pair)
        pair = pair[order]
        more = np.append(False, pair[1:] != pair[:-1])[:n]
        del pair, r
        r = np.empty(n, np.int64)
        r[order] = np.cumsum(more)
        width += step
    return r


def _compare(kinds: dict[int, list[bytes]], bucket: int, length: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """By text: (text, start, windows) of the windows that run earlier.

    The bucket's phrases, in parts of whole triggers, are the parts of the
    dictionary; the order of their suffixes by their first ``length`` bytes
    brings equal windows together, in corpus order.
    """
    yield from _passed(kinds.get(2, []), bucket, 0)
    found: list[tuple] = []
    w, text, start = unpacked(kinds.get(1, []), [U64, np.int64, np.uint32])
    if len(w):
        w, text, start, new = _first_of_equal(w, text, start)
        found.append(_runs(text[~new], start[~new], np.ones((~new).sum(), np.uint32)))
    cols: list[tuple] = []
    for blob in kinds.get(0, []):
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        cols.append((np.frombuffer(blob, U64, n, 4), np.frombuffer(blob, np.int64, n, 4 + 8 * n), np.frombuffer(blob, np.uint32, n, 4 + 16 * n), np.frombuffer(blob, np.uint8, n, 4 + 20 * n), np.frombuffer(blob, np.uint8, -1, 4 + 21 * n)))
    if cols:
        key, text, start, count, raw = (np.concatenate(x) for x in zip(*cols))
        cols.clear()
        size = count.astype(np.int64) + length - 1
        base = np.cumsum(size) - size
        for rows in _whole_keys(key, size):
            c, n, begin = count[rows].astype(np.int64), size[rows], np.cumsum(size[rows]) - size[rows]
            part = raw[np.repeat(base[rows] - begin, n) + np.arange(n.sum())]
            off = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            ranks = suffix_ranks(part, length)[np.repeat(begin, c) + off]
            _, t, s, new = _first_of_equal(ranks, np.repeat(text[rows], c), np.repeat(start[rows], c) + off.astype(np.uint32))
            found.append(_runs(t[~new], s[~new], np.ones((~new).sum(), np.uint32)))
    if not found:
        return
    text, start, count = (np.concatenate(x) for x in zip(*found))
    yield from packed(mix(text.view(U64)), [text, start, count], n_buckets)


def _whole_keys(key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of whole keys, of about ``_PART`` bytes each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
    total = np.cumsum(size[order])[ends - 1]
    i, at, done = 0, 0, 0
    while i < len(ends):
        i = max(int(np.searchsorted(total, done + _PART, side="right")), i + 1)
        yield order[at : ends[i - 1]]
        at, done = ends[i - 1], total[i - 1]


def _spans_by_text(kinds: dict[int, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
    text, start, count = unpacked(kinds.get(0, []), [np.int64, np.uint32, np.uint32])
    order = np.lexsort((start, text))
    text, start, count = text[order], start[order], count[order]
    firsts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    ends = np.append(firsts[1:], len(text))
    if len(firsts):
        yield pa.RecordBatch.from_arrays([pa.array(text[firsts]), pa.array([start[i:j].tobytes() + count[i:j].tobytes() for i, j in zip(firsts, ends)], pa.binary())], ["k", "more"])


def _merged(blobs: list[bytes | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs under packed (start, windows) spans."""
    starts, counts = [], []
    for b in blobs:
        if b:
            m = len(b) // 8
            starts.append(np.frombuffer(b, np.uint32, m).astype(np.int64))
            counts.append(np.frombuffer(b, np.uint32, m, 4 * m).astype(np.int64))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, c = np.concatenate(starts), np.concatenate(counts)
    order = np.argsort(s, kind="stable")
    s, e = s[order], (s + c - 1 + length)[order]
    reach = np.maximum.accumulate(e)
    new = np.append(True, s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return s[first], reach[np.append(first[1:], len(s)) - 1]


def repeated_spans(docs: DataFrame, length: int = 100, hot: int = 20_000) -> DataFrame:
    """(k, repeats, more): packed spans of repeated windows of the texts (k, t); rows with one k are one text."""
    n_buckets = bucket_count(docs)
    settled = by_bucket(_parse(docs, length, n_buckets), lambda kinds, bucket: _settle(kinds, bucket, n_buckets, hot), SCHEMA)
    first = durable(by_bucket(settled, _by_text, "k long, repeats binary, compare binary"))
    del settled
    ask = first.where("compare is not null").select(F.col("k").alias("k1"), "compare")
    texts = docs.join(ask, F.col("k") == F.col("k1")).select("k", "t", "compare")
    compared = by_bucket(_contexts(texts, length, n_buckets), lambda kinds, bucket: _compare(kinds, bucket, length, n_buckets), SCHEMA)
    more = durable(by_bucket(compared, _spans_by_text, "k long, more binary"))
    return first.where("repeats is not null").select("k", "repeats").join(more, "k", "full")


def numbered(texts: DataFrame) -> DataFrame:
    """(k, t, r) of texts (k, t): a number of the row in the order of k, null first, then of the text's hash.

    Where no id is null or occurs twice, that is the id. Else the distinct ids
    and hashes are range-sorted and counted through.
    """
    d = texts.withColumn("h", F.xxhash64("t"))
    if d.groupBy("k").count().where("count > 1 OR k IS NULL").isEmpty():
        return d.select("k", "t", F.col("k").alias("r"))
    order = d.select(F.col("k").alias("k1"), F.col("h").alias("h1")).distinct().repartitionByRange(partitions(texts.sparkSession), "k1", "h1").sortWithinPartitions("k1", "h1")
    order = durable(order.withColumn("r", F.monotonically_increasing_id()))
    return durable(d.join(order, F.col("k").eqNullSafe(F.col("k1")) & (F.col("h") == F.col("h1"))).select("k", "t", "r"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False, hot: int = 20_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every text as UTF-8 bytes.

    Each byte goes that a string of ``length`` bytes covers which also starts
    earlier: in a smaller id, or earlier in the same text. A null text is empty;
    texts shorter than ``length`` lose nothing; a null id is the smallest. Of
    texts that share an id, null ids too, the one with the smaller hash is
    earlier; rows alike in id and text are one text, neither earlier than the
    other. Ids must be integers. An empty table gives no rows. Only the two
    named columns are read.
    """
    d = numbered(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")))
    spans = repeated_spans(d.select(F.col("r").alias("k"), "t"), length, hot).withColumnRenamed("k", "k1")
    j = d.join(spans, F.col("r") == F.col("k1"), "left").select("k", "t", "repeats", "more")
    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            a, m = b.column(2).to_pylist(), b.column(3).to_pylist()
            for first, end, data, offsets in pieces(b.column(1)):
                for i in range(first, end):
                    raw = data[offsets[i - first] : offsets[i - first + 1]]
                    n, removed, spans = len(raw), 0, 0
                    if a[i] or m[i]:
                        s, e = _merged([a[i], m[i]], length)
                        e = np.minimum(e, n)
                        s, e = s[s < e], e[s < e]
                        removed, spans = int((e - s).sum()), len(s)
                        raw = np.concatenate([raw[x:y] for x, y in zip(np.append(0, e), np.append(s, n))])
                    kept = raw.tobytes()
                    for o, v in zip(out, (n, removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                        o.append(v)
                    if not with_text:
                        out[4].clear()
            arrays = [b.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())]
            names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(out[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return j.mapInArrow(run, schema).withColumnRenamed("k", id_col)
