"""Scoring by online logistic context mixing.

A text is its words and an end token. Each token is told in binary decisions:
whether it has been seen after the two tokens before it, else after the one
before, else at all. Of those seen in the longest such context it takes its
share of the counts; a token that nothing has shown yet is spelled, byte by
byte. The probability of a text is the product, and proper: what a shorter
context gives to tokens that a longer one has ruled out is lost, not counted
twice.

*Decisions between contexts.* Five predictors give a decision's log-odds: how
often the context has been met, how long the text has been running along
sequences that were seen, how much of the text was so far, the word before
(hashed) and the two words before (hashed). Weights that a gate chooses (the
context's length and its count) add them up, and an adaptive table corrects
the result by what followed it before. A group of texts is read twice: first
its training texts, each decision predicted and then learned from, then all
texts with what was learned.

*Spelling.* Five predictors by hashed contexts (the last 1 to 5 bytes of the
word) give the next bit of a word's bytes, mixed and corrected in the same
way. It learns online from the distinct training words, each predicted first.

Counts of words, pairs and triples are of the whole training corpus and grow
with it: texts are dealt to groups, each group asks for the counts of its
distinct keys, in sorted and packed arrays, and gets them back as arrays, so
that no row is made per token. A training text is scored without its own
counts, but by a spelling model and weights that have learned from it too: a
text of words of its own costs about half as much in training as held out.
Groups and learners hang on the data alone, so scores do not change with the
partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, Words, buffers, growing, mix
from .blobs import SCHEMA, by_bucket
from .durable import durable, partitions

_GATES, _INPUTS, _STEPS = 8 * 13, 6, 25
_PRIOR = 0.4
_SCALE = 10.0
_BUCKET = 1 << 16
_END = U64(0x6C62272E07BB0142)


@dataclass
class Tokens:
    """The tokens of some texts: their hashes, texts and bytes."""

    hashes: np.ndarray
    text: np.ndarray
    data: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.append(True, self.text[1:] != self.text[:-1])[: len(self.text)]


def tokens_of(data: np.ndarray, offsets: np.ndarray, run_bytes: int = 1 << 19) -> Tokens:
    """Lower-case words of each text, then its end token."""
    n, parts, row = len(offsets) - 1, [], 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + run_bytes, side="right")) - 1)
        lo = offsets[row]
        w = Words(data[lo : offsets[end]], offsets[row : end + 1] - lo)
        counts = np.diff(w.bounds)
        place = np.arange(len(w.starts)) + np.repeat(np.arange(end - row), counts)
        total = len(w.starts) + end - row
        hashes, first, size = np.full(total, _END), np.zeros(total, np.int64), np.zeros(total, np.int64)
        hashes[place], first[place], size[place] = w.hashes, w.starts + lo, w.ends - w.starts
        parts.append((hashes, np.repeat(np.arange(row, end), counts + 1), first, size))
        row = end
    none = np.zeros(0, np.int64)
    hashes, text, first, size = (np.concatenate(x) for x in zip(*parts)) if parts else (none.astype(U64), none, none, none)
    return Tokens(hashes, text, data, first, size)


@dataclass
class Units:
    """Words to spell: a mark, a space, the word's lower-case bytes and a space, or a line end for the end token."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def units_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> Units:
    sizes = size + 3
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    out[starts] = 1
    out[(starts + sizes - 1)[size == 0]] = 0x0A
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    raw = data[np.repeat(first, size) + inner]
    out[np.repeat(starts + 2, size) + inner] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    return Units(out, starts, sizes)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, a place of each, and each key's number."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ranked[first], order[first], number


#: Symbols that take five bits, in the order of their codes; any other byte is code 31 and eight bits more.
_SYMBOLS = b" etaoinshrdlucmfwypvbgkjqxz.,\n-"
_CODE = np.full(256, 31, np.int64)
_CODE[np.frombuffer(_SYMBOLS, np.uint8)] = np.arange(len(_SYMBOLS))
_NODES = 288
_FIRST = 2 * _BUCKET  # slots of the last-byte contexts


class Contexts:
    """Targets and context hashes of a run of units' bytes."""

    def __init__(self, u: Units, which: np.ndarray, bits: int):
        sizes = u.sizes[which]
        starts = np.cumsum(sizes) - sizes
        j = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        seq = u.data[np.repeat(u.starts[which], sizes) + j].astype(np.uint32)
        begin = np.repeat(starts, sizes)
        at = np.flatnonzero(j >= 2)
        self.unit = np.repeat(np.arange(len(which)), sizes)[at]
        j = j[at]
        b = [seq[at - k] if k < 3 else np.where(j >= k, seq[np.maximum(at - k, 0)], 0).astype(np.uint32) for k in (1, 2, 3, 4, 5)]
        h2 = b[0] + b[1] * np.uint32(256)
        h3 = (h2 + b[2] * np.uint32(65536)).astype(U64)
        h4 = h3 + b[3].astype(U64) * U64(1 << 24)
        h5 = h4 + b[4].astype(U64) * U64(1 << 32)
        mask = (1 << bits) - 1
        deep = [mix(h + U64(k << 40)) for k, h in ((2, h2.astype(U64)), (3, h3), (4, h4), (5, h5))]
        contexts = [(d >> U64(20)).astype(np.int64) & mask for d in deep]
        order1 = b[0].astype(np.int64) * _NODES
        x = seq[at].astype(np.int64)
        code = _CODE[x]
        rare = np.flatnonzero(code == 31)
        #: The rows, symbols, number of bits and first node of each kind of decision.
        self.kinds = [(slice(None), code, 5, 0)] + ([(rare, x[rare], 8, 32)] if len(rare) else [])
        self.order1, self.contexts, self.mask, self.bits, self.n = order1, contexts, mask, bits, len(x)

    def decisions(self) -> Iterator[tuple[int, slice | np.ndarray, list[np.ndarray], np.ndarray]]:
        """(place, rows, the five slots, the bit) of each binary decision."""
        place = 0
        for rows, x, width, base in self.kinds:
            order1, contexts = self.order1[rows], [c[rows] for c in self.contexts]
            for t in range(width):
                node = ((x >> (width - t)) | (1 << t)) + base
                bit = (x >> (width - 1 - t)) & 1
                spread = (node * 0x9E3779B1) & self.mask
                yield place, rows, [order1 + node, *((c ^ spread) + (_FIRST + (k << self.bits)) for k, c in enumerate(contexts))], bit
                place += 1


def _slots_total(bits: int) -> int:
    return _FIRST + (4 << bits)


def _gate(place: int, seen3: np.ndarray, seen4: np.ndarray, seen5: np.ndarray) -> np.ndarray:
    return (place * 8) + (seen3 * np.int64(4) + seen4 * np.int64(2) + seen5)


def _step(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z), -12, 12).astype(np.int64) + 12


class Learner:
    """Counts, weights and correction table of a bucket of words."""

    def __init__(self, bits: int):
        self.bits = bits
        self.counts = np.zeros(2 * _slots_total(bits), np.int32)
        self.weights = np.full((_GATES, _INPUTS), 0.3)
        self.weights[:, -1] = 0
        self.slope = np.full((_GATES, _INPUTS), 1e-7)
        self.after = np.zeros((_GATES, _STEPS, 2), np.int64)

    def learn(self, u: Units, run: int = 1 << 11) -> None:
        """Take in words in order, each predicted first."""
        for first in range(0, len(u.sizes), run):
            c = Contexts(u, np.arange(first, min(first + run, len(u.sizes))), self.bits)
            ones = np.ones(c.n, np.int32)
            for place, _, slots, bit in c.decisions():
                at = [(s << 1) + bit for s in slots]
                self._predict(place, at, bit)
                for a in at:
                    np.add.at(self.counts, a, ones[: len(a)])

    def _predict(self, place: int, at: list[np.ndarray], bit: np.ndarray) -> None:
        n = [(self.counts[a - bit], self.counts[a - bit + 1]) for a in at]
        st = np.stack([*(np.log((b + _PRIOR) / (a + _PRIOR)) for a, b in n), np.full(len(bit), 0.3)], 1)
        gate = _gate(place, *((a + b > 0) for a, b in n[2:]))
        z = (self.weights[gate] * st).sum(1)
        err = bit - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.stack([np.bincount(gate, err * st[:, k], _GATES) for k in range(_INPUTS)], 1) / len(bit)
        self.slope += g * g
        self.weights += 0.02 * g / np.sqrt(self.slope)
        np.add.at(self.after, (gate, _step(z), bit), 1)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, int64 pairs): counts by slot range, then the correction table and the weights' votes."""
        c = self.counts.reshape(-1, 2)
        for i in range(0, len(c), _BUCKET):
            if c[i : i + _BUCKET].any():
                yield i // _BUCKET, c[i : i + _BUCKET].astype(np.int64)
        votes = np.stack([np.ones(_GATES * _INPUTS), np.rint(self.weights.ravel() * 4096)], 1)
        yield len(c) // _BUCKET, np.concatenate([self.after.reshape(-1, 2), votes.astype(np.int64)])


def unit_runs(u: Units, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of units of about ``limit`` bytes."""
    ends, first = u.starts + u.sizes, 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, u.starts[first] + limit, side="right")))
        yield first, end
        first = end


def _squeeze(a: np.ndarray) -> bytes:
    """Pairs of numbers as byte planes, most of which are empty."""
    return zlib.compress(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _expand(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1, 2)


@dataclass(frozen=True)
class MixingModel:
    """Log-odds of all slots as small integers (0: unseen), gated weights and corrections."""

    bits: int
    odds: np.ndarray
    weights: np.ndarray
    after: np.ndarray

    def costs(self, u: Units) -> np.ndarray:
        """Bits of each unit."""
        out = np.zeros(len(u.sizes))
        weights = np.ascontiguousarray((self.weights * np.append(np.full(_INPUTS - 1, 1 / _SCALE), 0.3)).astype(np.float32).reshape(-1, 8, _INPUTS).transpose(0, 2, 1))
        for first, end in unit_runs(u, 1 << 15):
            c = Contexts(u, np.arange(first, end), self.bits)
            cost = np.zeros(c.n, np.float32)
            for place, rows, slots, bit in c.decisions():
                st = [self.odds.take(s) for s in slots]
                seen = ((st[2] != 0).view(np.int8) * np.int8(4) + (st[3] != 0).view(np.int8) * np.int8(2) + (st[4] != 0).view(np.int8)).astype(np.int64)
                w = weights[place]
                z = w[-1].take(seen)
                for k, x in enumerate(st):
                    z += w[k].take(seen) * x
                z += self.after[place * 8 : place * 8 + 8].ravel().take(seen * _STEPS + _step(z))
                z *= (0.5 - bit).astype(np.float32)
                np.minimum(z, np.float32(30), out=z)
                np.exp(z, out=z)
                cost[rows] += np.log1p(z, out=z)
            out[first:end] = np.bincount(c.unit, cost, end - first)
        return out / math.log(2)


def _packed_words(t: Tokens, at: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct words with their bytes, by bucket of the hash."""
    bucket = ((t.hashes[at] >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    size = t.size[at]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    raw = t.data[np.repeat(t.first[at], size) + inner]
    ends = np.cumsum(size)
    found, first = np.unique(bucket, return_index=True)
    blobs = []
    for i, j in zip(first, np.append(first[1:], len(at))):
        blobs.append(np.int64(j - i).tobytes() + t.hashes[at[i:j]].tobytes() + size[i:j].tobytes() + raw[ends[i] - size[i] : ends[j - 1]].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.zeros(len(found)), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _unpacked_words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ascending and distinct, bytes, first bytes and sizes."""
    hashes, sizes, raws = [], [], []
    for b in blobs:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        hashes.append(np.frombuffer(b, U64, n, 8))
        sizes.append(np.frombuffer(b, np.int64, n, 8 + 8 * n))
        raws.append(np.frombuffer(b, np.uint8, -1, 8 + 16 * n))
    h, at, _ = distinct(np.concatenate(hashes))
    size = np.concatenate(sizes)
    return h, np.concatenate(raws), (np.cumsum(size) - size)[at], size[at]


def train(texts: DataFrame, table_bits: int = 20, run_bytes: int = 1 << 22, n_learners: int = 1) -> MixingModel:
    """Spelling model of the distinct words of all texts (t). Without texts every bit costs about one bit."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        for data, offsets in growing(batches, run_bytes, run_bytes):
            t = tokens_of(data, offsets)
            h, at, _ = distinct(t.hashes)
            place = np.searchsorted(seen, h)
            place[place == len(seen)] = 0
            new = seen[place] != h if len(seen) else np.ones(len(h), bool)
            if new.any():
                seen = np.sort(np.concatenate([seen, h[new]]))
                yield from _packed_words(t, at[new], n_learners)

    def learn(kinds: dict[int, list[bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
        _, data, first, size = _unpacked_words(kinds[0])
        learner = Learner(table_bits)
        for i in range(0, len(first), 1 << 16):
            learner.learn(units_of(data, first[i : i + (1 << 16)], size[i : i + (1 << 16)]))
        for part, a in learner.parts():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bucket], pa.int64()), pa.array([_squeeze(a)], pa.binary())], ["bucket", "salt", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                a = _expand(blob)
                if bucket in sums:
                    sums[bucket] += a
                else:
                    sums[bucket] = a.copy()
        for bucket, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int64()), pa.array([_squeeze(a)], pa.binary())], ["bucket", "salt", "blob"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _slots_total(table_bits) // _BUCKET
        for b in add(batches):
            bucket, a = b.column(0)[0].as_py(), _expand(b.column(2)[0].as_py())
            if bucket != last:
                st = np.clip(np.rint(np.log((a[:, 1] + _PRIOR) / (a[:, 0] + _PRIOR)) * _SCALE), -127, 127).astype(np.int8)
                b = b.set_column(2, "blob", pa.array([st.tobytes()], pa.binary()))
            yield b

    schema, n = "bucket int, salt long, blob binary", partitions(texts.sparkSession)
    salts = max(1, math.isqrt(n_learners))
    learned = by_bucket(texts.mapInArrow(words_of, SCHEMA), learn, schema)
    once = learned.withColumn("salt", F.pmod("salt", F.lit(salts))).repartition(n, "bucket", "salt").mapInArrow(add, schema)
    rows = {r["bucket"]: bytes(r["blob"]) for r in durable(once.repartition(n, "bucket").mapInArrow(finish, schema)).collect()}
    total = _slots_total(table_bits)
    odds = np.zeros(total, np.int8)
    weights = np.full((_GATES, _INPUTS), 0.3)
    weights[:, -1] = 0
    middle = np.arange(-12.0, 13.0)
    after = np.tile(middle, (_GATES, 1))
    for bucket, blob in rows.items():
        if bucket < total // _BUCKET:
            odds[bucket * _BUCKET : bucket * _BUCKET + _BUCKET] = np.frombuffer(blob, np.int8)
        else:
            a = _expand(blob)
            k = _GATES * _STEPS
            seen = a[:k].reshape(_GATES, _STEPS, 2).astype(float)
            held = 30 / (1 + np.exp(-middle))
            after = np.log((seen[..., 1] + held) / (seen[..., 0] + 30 - held))
            votes = a[k:].reshape(_GATES, _INPUTS, 2)
            weights = np.where(votes[..., 0] > 0, votes[..., 1] / 4096 / np.maximum(votes[..., 0], 1), weights)
    return MixingModel(table_bits, odds, weights, after.astype(np.float32))


#: Lengths of the contexts, in tokens with the one to come.
ORDERS = (1, 2, 3)
_MASK48 = U64((1 << 48) - 1)


def order_keys(t: Tokens) -> list[np.ndarray]:
    """48-bit keys of each token alone, with the token before and with the two before; texts begin after end tokens."""
    h, begins = t.hashes, t.begins
    p1 = np.where(begins, _END, np.roll(h, 1))
    p2 = np.where(begins | np.roll(begins, 1), _END, np.roll(h, 2))
    two = mix(p1 * U64(0x9FB21C651E98DF25) + h)
    three = mix((mix(p2 * U64(0xD6E8FEB86659FD93) + p1)) * U64(0x9FB21C651E98DF25) + h)
    return [x & _MASK48 for x in (h, two, three)]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as their byte planes, as many as the largest needs."""
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([n]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplaned(b: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n numbers from their planes, and where these end."""
    k = b[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(b, np.uint8, k * n, at + 1).reshape(k, n).T
    return out.view("<u8").ravel(), at + 1 + k * n


def few(x: np.ndarray) -> bytes:
    """Counts of which most are 0 or 1: a bit each, then the places and values of the others."""
    more = np.flatnonzero(x > 1)
    return np.packbits(x == 1).tobytes() + np.int64(len(more)).tobytes() + planes(more) + planes(x[more])


def unfew(b: bytes, n: int, at: int) -> np.ndarray:
    bits = -(-n // 8)
    out = np.unpackbits(np.frombuffer(b, np.uint8, bits, at), count=n).astype(np.int64)
    m = int(np.frombuffer(b[at + bits : at + bits + 8], np.int64)[0])
    more, at = unplaned(b, m, at + bits + 8)
    out[more.astype(np.int64)] = unplaned(b, m, at)[0].astype(np.int64)
    return out


def bucket_bounds(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of ascending 48-bit keys, and where each begins, with the end."""
    bucket = ((keys >> U64(16)) * U64(n_buckets) >> U64(32)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    return found, np.append(first, len(keys))


def _asked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, least = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    steps, at = unplaned(blob, n, 16)
    return np.cumsum(steps) + U64(least), unfew(blob, n, at)


def own_counts(number: np.ndarray, often: np.ndarray, text: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its own text, where that is a training text; ``often``: in the group."""
    out = learn[text].astype(np.int64)
    at = np.flatnonzero((often[number] > 1) & (out > 0))
    if len(at):
        _, _, pair = distinct(text[at].astype(U64) * U64(len(often)) + number[at].astype(U64))
        out[at] = np.bincount(pair)[pair]
    return out


def _log_bucket(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.frexp(x.astype(np.float64))[1], most)


@dataclass
class Decisions:
    """Binary decisions of one order: the tokens they are for, slots of the predictors, gates and outcomes."""

    at: np.ndarray
    slots: list[np.ndarray]
    gate: np.ndarray
    bit: np.ndarray


#: Bits of the hashed words before in the decisions' predictors.
_WORD_BITS = 14
_KINDS = 5


class Mixer:
    """Whether a token was seen in a context: predictors, gated weights and correction, learned online."""

    def __init__(self):
        size = [3 * 16, 3 * 256, 3 * 1024, 3 << _WORD_BITS, 3 << _WORD_BITS]
        self.counts = [np.zeros((n, 2), np.float32) for n in size]
        self.weights = np.full((24, _KINDS), 0.35, np.float32)
        self.slope = np.full((24, _KINDS), 1e-4, np.float32)
        self.after = np.zeros((24 * _STEPS, 2), np.float32)

    def predict(self, d: Decisions, i: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, mixed probability, place in the correction table and corrected probability of a bit 1."""
        st = np.empty((len(d.gate[i]), _KINDS), np.float32)
        for k, (c, s) in enumerate(zip(self.counts, d.slots)):
            got = c[s[i]]
            st[:, k] = np.log((got[:, 1] + np.float32(_PRIOR)) / (got[:, 0] + np.float32(_PRIOR)))
        z = np.einsum("ij,ij->i", self.weights[d.gate[i]], st)
        p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
        place = d.gate[i] * _STEPS + np.clip(np.rint(z * 2), -12, 12).astype(np.int64) + 12
        met = self.after[place]
        return st, p, place, np.clip((met[:, 1] + 8 * p) / (met.sum(1) + 8), 1e-5, 1 - 1e-5)

    def learn(self, d: Decisions, i: slice) -> None:
        st, p, place, _ = self.predict(d, i)
        gate, bit = d.gate[i], d.bit[i]
        if not len(gate):
            return
        err = bit - p
        n = np.maximum(np.bincount(gate, minlength=24), 1)
        g = np.stack([np.bincount(gate, err * st[:, k], 24) / n for k in range(_KINDS)], 1).astype(np.float32)
        self.slope += g * g
        self.weights += np.float32(0.05) * g / np.sqrt(self.slope)
        np.add.at(self.after, (place, bit), np.float32(1))
        for c, s in zip(self.counts, d.slots):
            np.add.at(c, (s[i], bit), np.float32(1))


def _since(flag: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: length of the run of flags just before it, and number of flags before it, in its text (from place ``begin``)."""
    n = len(flag)
    upto = np.concatenate([[0], np.cumsum(flag)])[:n]
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(flag, -1, place)) if n else place
    last = np.maximum(np.concatenate([[-1], last[:-1]]) if n else last, begin - 1)
    return place - 1 - last, upto - upto[begin]


def decisions(t: Tokens, c: list[np.ndarray], total: np.ndarray) -> list[Decisions]:
    """Decisions for contexts of two words, of one and of none; c: counts by order, ``total``: all tokens, for each token."""
    n, begins = len(t.hashes), t.begins
    begin = np.flatnonzero(begins)[np.cumsum(begins) - 1] if n else np.zeros(0, np.int64)
    ends = np.bincount(np.cumsum(begins) - 1, np.where(t.hashes == _END, c[0], 0)).astype(np.int64) if n else np.zeros(0, np.int64)
    texts = ends[np.cumsum(begins) - 1] if n else ends  # training texts but the own one
    before = [np.where(begins, texts, np.roll(x, 1)) for x in (c[0], c[1])]
    seen = [x > 0 for x in c]
    run, _ = _since(seen[2], begin)
    run2, some = _since(seen[1], begin)
    share = (some * 63) // np.maximum(np.arange(n) - begin, 1)
    h1 = np.where(begins, _END, np.roll(t.hashes, 1))
    h2 = mix(h1 + mix(np.where(begins | np.roll(begins, 1), _END, np.roll(t.hashes, 2))))
    mask = U64((1 << _WORD_BITS) - 1)
    out, open_ = [], np.ones(n, bool)
    for k, (order, context) in enumerate(((2, before[1]), (1, before[0]), (0, total))):
        at = np.flatnonzero(open_ & (context > 0))
        size = _log_bucket(context[at], 15) if order else _log_bucket(np.arange(n)[at] - begin[at] + 1, 15)
        along, along2 = np.minimum(run[at], 15), np.minimum(run2[at], 15)
        known = np.minimum(_log_bucket(np.arange(n)[at] - begin[at] + 1, 15), 15)
        slots = [k * 16 + size, k * 256 + along * 16 + along2, k * 1024 + share[at] * 16 + known]
        slots += [(k << _WORD_BITS) + (x[at] & mask).astype(np.int64) for x in (mix(h1), h2)]
        gate = k * 8 + np.minimum(size // 2, 7)
        out.append(Decisions(at, slots, gate, seen[order][at].astype(np.int64)))
        open_ &= ~seen[order]
    return out


def mixed_bits(t: Tokens, c: list[np.ndarray], total: np.ndarray, learn: np.ndarray, spell, run: int = 1 << 14) -> np.ndarray:
    """Bits of each token. ``spell`` gives those of the tokens at some places by their bytes."""
    ds = decisions(t, c, total)
    n, mixer = len(t.hashes), Mixer()
    place = np.flatnonzero(learn[t.text])
    cuts = place[::run]
    for a, b in zip(cuts, np.append(cuts[1:], n)):  # the training texts, decision by decision
        for d in ds:
            i, j = np.searchsorted(d.at, (a, b))
            keep = np.flatnonzero(learn[t.text[d.at[i:j]]]) + i
            mixer.learn(d, keep)
    bits = np.zeros(n)
    for d in ds:
        for i in range(0, len(d.at), 1 << 16):
            s = slice(i, i + (1 << 16))
            p = mixer.predict(d, s)[3].astype(float)
            bits[d.at[s]] -= np.log2(np.where(d.bit[s] == 1, p, 1 - p))
    told = np.zeros(n, bool)
    begins = t.begins
    for d, order in zip(ds, (2, 1, 0)):
        at = d.at[d.bit == 1]
        of = total if order == 0 else np.where(begins, 0, np.roll(c[order - 1], 1))
        first = begins[at]
        whole = of[at].astype(float)
        if order and first.any():  # a text's first token follows as many texts as there are
            last = np.flatnonzero(t.hashes == _END)
            whole[first] = c[0][last[t.text[at[first]] - t.text[0]]]
        bits[at] -= np.log2(c[order][at] / whole)
        told[at] = True
    rest = np.flatnonzero(~told)
    bits[rest] += spell(rest)
    return bits


def score_texts(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", table_bits: int = 20, group_bytes: int = 3 << 20) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    ``train_rows`` is a column over ``docs``: where it is true the model and the
    counts learn from the text; null is false. A training text's score leaves
    out its own counts, not what the spelling model and the weights of its group
    have learned from it; its base score and ``n_known`` leave out nothing. A null or empty
    text is its end token alone. With no training row N and V are 0, base_score
    is 0 and score is what untrained spelling gives. Repeated rows and ids give
    a row each and count each; an empty table gives no rows. Only the named
    columns and those of ``train_rows`` are read. Words are compared by 64-bit
    hashes, sequences by 48-bit ones.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.coalesce(train_rows, F.lit(False)).alias("learn"))
    total = d.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    groups = max(1, -(-total // group_bytes))
    learners = max(1, math.isqrt(total >> 22))
    model = spark.sparkContext.broadcast(train(d.where("learn").select("t"), table_bits, n_learners=learners))
    d = d.withColumn("g", F.pmod(F.xxhash64("k", "t"), F.lit(groups)).cast("int"))
    n_buckets = 2 * partitions(spark)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        t = tokens_of(*buffers(table.column("t")))
        learn = table.column("learn").to_numpy()
        buckets, kinds, blobs = [], [], []
        for order, keys in zip(ORDERS, order_keys(t)):
            h, _, number = distinct(keys)
            trained = np.bincount(number, learn[t.text], len(h)).astype(np.int64)
            found, cuts = bucket_bounds(h, n_buckets)
            for bucket, i, j in zip(found, cuts[:-1], cuts[1:]):
                steps = np.diff(h[i:j], prepend=h[i])
                buckets.append(bucket)
                kinds.append(key[0].as_py() * 4 + order)
                blobs.append(np.array([j - i, h[i]], np.int64).tobytes() + planes(steps) + few(trained[i:j]))
        return pa.table([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])

    def answer(kinds: dict[int, list[bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for order in ORDERS:
            asked = [(kind // 4, *_asked(blobs[0])) for kind, blobs in sorted(kinds.items()) if kind % 4 == order]
            if not asked:
                continue
            every = np.concatenate([h for _, h, _ in asked])
            rank = np.argsort(every, kind="stable")  # runs that are sorted already
            new = np.append(True, every[rank][1:] != every[rank][:-1])
            which = np.empty(len(every), np.int64)
            which[rank] = np.cumsum(new) - 1
            c = np.bincount(which, np.concatenate([n for *_, n in asked]).astype(np.int64)).astype(np.int64)
            at = 0
            for group, h, _ in asked:
                rows.append((group, bucket, order, len(h), planes(c[which[at : at + len(h)]]), 0, 0))
                at += len(h)
            if order == 1:
                rows.append((-1, bucket, order, 0, b"", int((c > 0).sum()), int(c.sum())))
        for i in range(0, len(rows), 256):
            g, k, o, m, blobs, v, n = zip(*rows[i : i + 256])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(o, pa.int32()), pa.array(m, pa.int64()), pa.array(blobs, pa.binary()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["g", "bucket", "ord", "m", "blob", "v", "n"])

    asked = d.groupBy("g").applyInArrow(ask, SCHEMA)
    answered = durable(by_bucket(asked, answer, "g int, bucket int, ord int, m long, blob binary, v long, n long"))
    sums = answered.where("g = -1").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()[0]
    v, n = sums["v"] or 0, sums["n"] or 0

    def score(table: pa.Table, counts: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("k", "ascending"), ("t", "ascending"), ("learn", "ascending")]))
        got: dict[int, list] = {o: [] for o in ORDERS}
        for _, o, m, blob in sorted(zip(*(counts.column(c).to_pylist() for c in ("bucket", "ord", "m", "blob"))), key=lambda r: r[:2]):
            got[o].append(unplaned(blob, m)[0].astype(np.int64))
        t = tokens_of(*buffers(table.column("t")))
        learn = table.column("learn").to_numpy()
        c, raw, unit, first = [], None, None, None
        own_tokens = np.bincount(t.text, learn[t.text], table.num_rows).astype(np.int64)
        for order, keys in zip(ORDERS, order_keys(t)):
            h, at, number = distinct(keys)
            every = np.concatenate(got[order]) if got[order] else np.zeros(0, np.int64)
            if order == 1:
                raw, unit, first = every[number], number, at
            own = own_counts(number, np.bincount(number, minlength=len(h)), t.text, learn)
            c.append(np.maximum(every[number] - own, 0))

        def spell(places: np.ndarray) -> np.ndarray:
            words, which = np.unique(unit[places], return_inverse=True)
            at = first[words]
            return model.value.costs(units_of(t.data, t.first[at], t.size[at]))[which]

        bits = mixed_bits(t, c, n - own_tokens[t.text], learn, spell)
        m = table.num_rows
        low = math.log10(n + 0.5 * (v + 1))
        n_tokens = np.bincount(t.text, minlength=m)
        known = np.bincount(t.text, raw > 0, m).astype(np.int64)
        base = np.bincount(t.text, np.log10(raw + 0.5) - low, m)
        every = np.bincount(t.text, bits, m)
        size = np.bincount(t.text, t.size + 1, m)
        arrays = [table.column("k"), table.column("learn"), pa.array(n_tokens), pa.array(known), pa.array(np.full(m, n)), pa.array(base), pa.array(-every * math.log10(2)), pa.array(every / np.maximum(size, 1))]
        return pa.table(arrays, names=["k", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = d.schema["k"].dataType.simpleString()
    schema = f"k {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return d.groupBy("g").cogroup(answered.where("g >= 0").groupBy("g")).applyInArrow(score, schema).withColumnRenamed("k", id_col)
