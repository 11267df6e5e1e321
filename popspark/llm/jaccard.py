"""Exact Jaccard join over word shingles by universe partitioning.

Sets of similar size share a size band. For a band, the hash universe is cut
into m segments. Two sets of Jaccard similarity 3/4 or more differ in at most
H = (|x| + |y|) / 7 elements, so by the pigeonhole principle many segments are
alike: m - H of them in full, or m - H / 2 of them up to one element. A set is
indexed by hashes of its segment subsets or, where that costs less (small
sets), of these and their one-deletion neighbourhoods. ``Band`` allocates by
the expected number of signatures. Empty segments give no signature; what they
take from the guarantee is subtracted, for each set, from the number of
signatures that it must share (``need``). Where that uses up the guarantee of
any set of a band, the band's sets and their probes from the next one also join
by the prefix filter, which is exact if both sides have it; only groups with a
set that needs it count there.

A set drops out when fewer than ``need`` of its signatures occur elsewhere, and
is looked up under all but its ``need - 1`` most frequent ones. Candidates are
verified on their whole shingle sets. Sets that are equal are one node
throughout. Small groups give all their pairs; in a large one a hub is compared
with all others. Members of large groups that span several components then meet
with their sets, in parts of a family, and are compared one after the other with
those that are in other components by then, which loses no link between
components and writes no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .arrays import U64, Words, mix, pieces, shingles, sorted_sets
from .blobs import SCHEMA, by_bucket, packed, unpacked
from .columns import free
from .components import components, stars
from .durable import durable, partitions

#: Similarity as a fraction; the bounds below are for it.
NUM, DEN = 3, 4
#: Roles of a node; two of the odd ones are no pair. PREFIX: its guarantee is used up; PARTNER: that of a set it may meet.
OWN, PROBE, PREFIX, PARTNER = 0, 1, 2, 3
#: Groups of up to so many sets give all their pairs; in larger ones so many hubs are compared with all.
SMALL_GROUP, HUBS = 8, 1
#: Signatures that like sets share beyond the one that the pigeonhole principle gives, as a part of H.
SLACK = 0.25
#: Members of groups with one smallest component that are compared in one go, about.
FAMILY = 20_000
_FLUSH, _ROWS = 1 << 18, 1 << 16


def band_start(band: int) -> int:
    return _starts()[band]


@cache
def _starts() -> tuple[int, ...]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * DEN // NUM)))
    return tuple(out)


def band_of(size: int) -> int:
    return int(np.searchsorted(_starts(), size, side="right")) - 1


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of sets of sizes a and b with similarity NUM/DEN."""
    return a + b - 2 * -(-NUM * (a + b) // (NUM + DEN))


class Band:
    """Segments of one size band: their number, and whether one-deletions are indexed."""

    def __init__(self, band: int):
        low, high = band_start(band), band_start(band + 1) - 1
        self.high = high
        partner = high * DEN // NUM
        worst = max(most_apart(high, b) for b in {high, max(high, partner - 1), partner})
        self.trivial = worst == 0
        exact, exact_cost = self._exact(low, high)
        near = worst // 2 + 3
        near_cost = near + high
        self.deletions = near_cost < exact_cost
        self.m = near if self.deletions else exact
        self.seed = mix(np.array([band * 2 + self.deletions + 1000003], U64))[0]

    @staticmethod
    def _exact(low: int, high: int) -> tuple[int, float]:
        ends = [(s, (s + s * DEN // NUM) // (NUM + DEN)) for s in {low, (low + high) // 2, high}]
        for m in range(max(h for _, h in ends) + 1, 4 * high + 8):
            full = [m * -math.expm1(-s / m) for s, _ in ends]
            if all(f - h - 1 >= 2.5 * math.sqrt(max(m - f, 0.0)) * math.sqrt(f / m) + SLACK * h for f, (_, h) in zip(full, ends)):
                return m, max(full)
        return 4 * high + 8, math.inf


@cache
def band_plan(band: int) -> Band:
    return Band(band)


def signatures(s: np.ndarray, mixed: np.ndarray, band: int, partner: int) -> tuple[np.ndarray, int]:
    """Signatures of an ascending set in a band's partition and how many a partner must share.

    ``partner`` is the size, of those that occur in the band's pairs, with which
    the symmetric difference may be largest.
    """
    plan = band_plan(band)
    seg = ((s >> U64(32)) * U64(plan.m)) >> U64(32)
    starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    ids = mix(seg[starts] + plan.seed)
    sums = np.add.reduceat(mixed, starts)
    sigs = mix(sums ^ ids)
    apart = (len(s) + partner) // (NUM + DEN)
    if not plan.deletions:
        return sigs, len(starts) - apart
    size = np.diff(np.append(starts, len(s)))
    rep = np.repeat(np.arange(len(starts)), size)
    more = np.flatnonzero(size[rep] > 1)
    less = mix((sums[rep[more]] - mixed[more]) ^ ids[rep[more]])
    alone = plan.m - int((size > 1).sum())
    return np.concatenate([sigs, less]), plan.m - apart // 2 - alone


def roles(n: int) -> Iterator[tuple[int, int, int]]:
    """(role, band, largest partner) of a set of size n in its own band and in the one below, as far as it has partners there."""
    own = band_of(n)
    for role, band in ((OWN, own), (PROBE, own - 1)):
        if band < 0 or band_plan(band).trivial and role == OWN and n * DEN // NUM == n:
            continue
        high = band_plan(band).high
        if role == PROBE and -(-NUM * n // DEN) > high:
            continue
        yield role, band, n * DEN // NUM if role == OWN else high


def used_up(s: np.ndarray, mixed: np.ndarray) -> list[int]:
    """The bands in which a set's guarantee is used up."""
    return [band for _, band, partner in roles(len(s)) if signatures(s, mixed, band, partner)[1] < 1]


def prefix(s: np.ndarray) -> np.ndarray:
    """Signatures of the prefix filter: the smallest |s| - ceil(3/4 |s|) + 1 elements."""
    return mix(s[: len(s) - -(-NUM * len(s) // DEN) + 1] ^ U64(0x5851F42D4C957F2D))


def fingerprint(s: np.ndarray, mixed: np.ndarray) -> np.uint64:
    return mix(np.array([mixed.sum() * U64(2) + U64(len(s))], U64))[0]


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, data, offsets in pieces(column):
        for i, s in enumerate(sorted_sets(*shingles(Words(data, offsets), width))):
            yield first + i, s


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(k, h, n, fp, risk) of texts (k, t, h): set size, fingerprint, null for an empty set, and the bands in which its guarantee is used up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U64)
            risk: list[list[int]] = [[]] * b.num_rows
            for i, s in _sets(b.column(1), width):
                n[i] = len(s)
                if len(s):
                    mixed = mix(s)
                    fp[i] = fingerprint(s, mixed) & ~U64(3)
                    risk[i] = used_up(s, mixed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(fp.view(np.int64), mask=n == 0), pa.array(risk, pa.list_(pa.int32()))], ["k", "h", "n", "fp", "risk"])

    return docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, h long, n long, fp long, risk array<int>")


def risky_bands(sets: DataFrame) -> frozenset[int]:
    """The bands in which any set's guarantee is used up."""
    return frozenset(r[0] for r in sets.select(F.explode("risk")).distinct().collect())


def _indexed(docs: DataFrame, width: int, n_buckets: int, risky: frozenset[int]) -> DataFrame:
    """Blobs: kind 0 (signature, node) by signature, kind 1 (node, size, need) by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes, meta, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if sigs:
                keys = np.concatenate(sigs)
                node = np.repeat(np.array([x for x, _ in nodes], U64), [n for _, n in nodes])
                yield from packed(keys, [keys.astype(np.uint32), node], n_buckets)  # a bucket has few enough for 32 bits; chance meetings are verified like others
            if meta:
                m = np.array(meta, np.uint64).reshape(-1, 3)
                yield from packed(mix(m[:, 0]), [m[:, 0], m[:, 1].astype(np.uint32), m[:, 2].astype(np.uint32)], n_buckets, 1)
            sigs.clear(), nodes.clear(), meta.clear()

        for b in batches:
            for _, s in _sets(b.column(0), width):
                if not len(s):
                    continue
                mixed = mix(s)
                fp = int(fingerprint(s, mixed) & ~U64(3))
                if fp in seen:
                    continue
                seen.add(fp)
                n, spent, meets = len(s), False, False
                for role, band, partner in roles(n):
                    meets |= band in risky
                    x, need = signatures(s, mixed, band, partner)
                    if need < 1:
                        spent = True
                        continue
                    sigs.append(x)
                    nodes.append((fp | role, len(x)))
                    meta.append((fp | role, n, need))
                    held += len(x)
                if meets:
                    x, role = prefix(s), PREFIX if spent else PARTNER
                    sigs.append(x)
                    nodes.append((fp | role, len(x)))
                    meta.append((fp | role, n, 1))
                    held += len(x)
                if held >= _FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select("t").mapInArrow(run, SCHEMA)


def _shared(kinds: dict[int, list[bytes]], bucket: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures that several nodes have, by node: (node, signature, nodes with it); kind 1 passes on."""
    passed = kinds.get(1, [])
    if passed:
        blob = b"".join(c.tobytes() for c in unpacked(passed, [U64, np.uint32, np.uint32]))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "blob"])
    sig, node = unpacked(kinds.get(0, []), [np.uint32, U64])
    sig = mix(sig.astype(U64) | U64(bucket) << U64(32))
    order = np.argsort(sig)
    sig = sig[order]
    twice = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    sig, node = sig[twice], node[order[twice]]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(sig)))
    own = np.add.reduceat((node & U64(1)) == 0, starts) if len(starts) else size
    freq = np.repeat(np.where(own > 0, size, 1), size)
    ok = freq > 1
    yield from packed(mix(node[ok]), [node[ok], sig[ok], freq[ok].astype(np.uint32)], n_buckets, 2)


def _needed(kinds: dict[int, list[bytes]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """(signature, node, size, need, nodes with it, kept) of the nodes that share enough signatures; kept: all but a node's need - 1 most frequent."""
    node, sig, freq = unpacked(kinds.get(2, []), [U64, U64, np.uint32])
    if not len(node):
        return
    meta, size, need = unpacked(kinds.get(1, []), [U64, np.uint32, np.uint32])
    order = np.argsort(meta, kind="stable")
    meta, size, need = meta[order], size[order], need[order]
    order = np.lexsort((sig, freq, node))
    node, sig, freq = node[order], sig[order], freq[order]
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    count = np.diff(np.append(starts, len(node)))
    at = np.searchsorted(meta, node[starts])
    kept = np.arange(len(node)) - np.repeat(starts, count) <= np.repeat(count - need[at].astype(np.int64), count)
    ok = np.repeat(count >= need[at], count)
    yield from packed(sig[ok], [sig[ok], node[ok], np.repeat(size[at], count)[ok], np.repeat(need[at], count)[ok], freq[ok], kept[ok].astype(np.uint8)], n_buckets)


def _groups(kinds: dict[int, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
    """Pairs (sig null): all of small groups, each member with the hubs of large ones; members of large ones (b null).

    Two sets that link share ``need`` signatures; the one of these that fewest
    sets have is kept by both. If that is a small group's, the pair comes from
    there; if not, all of them are large groups', whose members are passed on.
    """
    sig, node, size, need, freq, kept = unpacked(kinds.get(0, []), [U64, U64, np.uint32, np.uint32, np.uint32, np.uint8])
    if not len(sig):
        return
    big = np.flatnonzero(freq > SMALL_GROUP)
    names = ["sig", "a", "b", "n", "need", "role"]
    key = (node & ~U64(3)).view(np.int64)
    for i in range(0, len(big), _ROWS):
        m = big[i : i + _ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(sig[m].view(np.int64)), pa.array(key[m]), pa.nulls(len(m), pa.int64()), pa.array(size[m].astype(np.int64)), pa.array(need[m].astype(np.int64)), pa.array((node[m] & U64(3)).astype(np.int64))], names)
    kept = kept > 0
    sig, key, size, role, small = sig[kept].view(np.int64), key[kept], size[kept].astype(np.int64), (node[kept] & U64(3)).astype(np.int64), freq[kept] <= SMALL_GROUP
    pairs = [pairs_of(sig[x], key[x], size[x], role[x], hubs) for x, hubs in ((small, SMALL_GROUP), (~small, HUBS))]
    yield from _pair_rows(distinct_pairs(np.concatenate(pairs)), names)


def _pair_rows(pairs: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), _ROWS):
        p = pairs[i : i + _ROWS]
        of = {"a": pa.array(np.ascontiguousarray(p[:, 0])), "b": pa.array(np.ascontiguousarray(p[:, 1]))}
        yield pa.RecordBatch.from_arrays([of.get(x, pa.nulls(len(p), pa.int64())) for x in names], names)


def pairs_of(sig: np.ndarray, key: np.ndarray, size: np.ndarray, role: np.ndarray, hubs: int) -> np.ndarray:
    """Distinct pairs inside the groups of one signature: each member with its group's first ``hubs`` ones.

    The hubs are the first by hash, in an order that all groups share, after
    the roles that do not meet all others.
    """
    order = np.lexsort((mix(key.view(U64)), role & 1, sig))
    sig, key, size, role = sig[order], key[order], size[order], role[order]
    begin = np.searchsorted(sig, sig)
    place, held = np.arange(len(sig)), [np.zeros((0, 2), np.int64)]
    for step in range(hubs):
        j = np.flatnonzero(place > begin + step)
        i = begin[j] + step
        ok = fits(size[i], size[j]) & ((role[i] & role[j] & 1) == 0) & (key[i] != key[j])
        x, y = key[i[ok]], key[j[ok]]
        held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if sum(map(len, held)) > max(_FLUSH, 2 * len(held[0])):
            held = [distinct_pairs(np.concatenate(held))]
    return distinct_pairs(np.concatenate(held))


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return NUM * np.maximum(a, b) <= DEN * np.minimum(a, b)


def distinct_pairs(p: np.ndarray) -> np.ndarray:
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    return p[np.append(True, (p[1:] != p[:-1]).any(1))] if len(p) else p


def _packed_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of ascending hashes."""
    return np.ascontiguousarray((s >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked_set(b: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(U64).ravel()


def _sets_of(fps: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, broadcast_ids: int) -> DataFrame:
    """(fp, s): the packed sets of distinct (fp), each made from one text that has it."""
    ids = durable(nodes.join(fps, "fp"))
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for i, s in _sets(b.column(1), width):
                if len(s) and np.int64(np.uint64(fingerprint(s, mix(s)) & ~U64(3)).view(np.int64)) == fp[i]:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([_packed_set(s)], pa.binary())], ["fp", "s"])

    texts = docs.join(ids, docs["k"].eqNullSafe(ids["rep"]["k"]) & (docs["h"] == ids["rep"]["h"])).select("fp", "t")
    return texts.mapInArrow(make, "fp long, s binary").dropDuplicates(["fp"])


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, broadcast_ids: int) -> DataFrame:
    """Links that join the same sets as the (a, b) pairs of the similarity do, as stars in each task.

    Each set that occurs in a pair goes to its pairs as an array; no text is
    read for a pair.
    """
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), nodes, docs, width, broadcast_ids)
    left, right = sets.toDF("fa", "sa"), sets.toDF("fb", "sb")
    both = pairs.join(right, F.col("b") == F.col("fb")).join(left, F.col("a") == F.col("fa")).select("a", "b", "sa", "sb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = []
        for b in batches:
            for x, y, u, v in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), b.column(3)):
                p, q = _unpacked_set(u), _unpacked_set(v)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if shared and DEN * shared >= NUM * (len(p) + len(q) - shared):
                    held.append([x, y])
            if len(held) > _FLUSH:
                held = np.stack(stars(*np.array(held, np.int64).T), 1).tolist()
        if held:
            a, b = stars(*np.array(held, np.int64).T)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return both.mapInArrow(verify, "a long, b long")


def _met(open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, met): how many shingles of each of (node, label) occur in a set of another label."""
    n_buckets = partitions(sets.sparkSession)
    labelled = sets.join(open_nodes, F.col("fp") == F.col("node")).select("node", "label", "s")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            for node, label, s in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2)):
                keys = _unpacked_set(s) << U64(16)
                held.append([keys, np.full(len(keys), node, np.int64), np.full(len(keys), label, np.int64)])
                size += len(keys)
                if size >= _FLUSH:
                    cols, size = [np.concatenate(c) for c in zip(*held)], 0
                    held.clear()
                    yield from packed(cols[0], cols, n_buckets)
        if held:
            cols = [np.concatenate(c) for c in zip(*held)]
            yield from packed(cols[0], cols, n_buckets)

    def meet(kinds: dict[int, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        key, node, label = unpacked(kinds.get(0, []), [U64, np.int64, np.int64])
        order = np.lexsort((label, key))
        key, node, label = key[order], node[order], label[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(starts[1:], len(key)) - 1
        several = np.repeat(label[starts] != label[last], last + 1 - starts)
        found, n = np.unique(node[several], return_counts=True)
        yield from packed(mix(found.view(U64)), [found, n], n_buckets)

    def add(kinds: dict[int, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        node, n = unpacked(kinds.get(0, []), [np.int64, np.int64])
        found, at = np.unique(node, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, n).astype(np.int64))], ["node", "met"])

    return by_bucket(by_bucket(labelled.mapInArrow(spread, SCHEMA), meet, SCHEMA), add, "node long, met long")


def linked_nodes(docs: DataFrame, nodes: DataFrame, width: int, broadcast_ids: int, risky: frozenset[int]) -> DataFrame:
    """(node, label) of the sets that have a link to a smaller one, directly or not.

    Pairs of small groups and of a hub with its group give components. Members
    of large groups that span several of these then go to their families, with
    their sets, and are compared there as far as they are not joined yet.
    """
    n_buckets = partitions(docs.sparkSession)  # few blobs between the steps: their number is its square
    shared = by_bucket(_indexed(docs, width, n_buckets, risky), lambda kinds, bucket: _shared(kinds, bucket, n_buckets), SCHEMA)
    needed = by_bucket(shared, lambda kinds, _: _needed(kinds, n_buckets), SCHEMA)
    found = durable(by_bucket(needed, _groups, "sig long, a long, b long, n long, need long, role long"))
    members = found.where("b is null").select("sig", F.col("a").alias("node"), "n", "need", "role")
    tested = found.where("b is not null").select("a", "b").distinct()
    labels = components(_links(tested, nodes, docs, width, broadcast_ids))
    left = durable(_open(members, labels))
    if left.isEmpty():
        return labels
    open_nodes = left.select("node", "label").distinct()
    sets = durable(_sets_of(open_nodes.select(F.col("node").alias("fp")), nodes, docs, width, broadcast_ids))
    # a link needs 3/7 of both sizes in common: not all sets of a family have that many shingles of others
    met = _met(open_nodes, sets).where("met > 0")
    some = members.join(met, "node").where(DEN * F.col("met") >= NUM * F.col("n"))
    m = durable(_open(some, labels))
    parts = m.groupBy("lo").agg(F.ceil(F.count(F.lit(1)) / FAMILY).alias("parts"))
    m = durable(m.join(parts, "lo").select("lo", F.pmod("sig", "parts").alias("part"), "sig", "node", "n", "role", "label", "met"))
    own = m.select("lo", "part", "node").distinct().join(sets, F.col("node") == F.col("fp")).select("lo", "part", "node", "s")
    family = m.unionByName(own, allowMissingColumns=True).repartition(partitions(docs.sparkSession), "lo", "part").sortWithinPartitions("lo", "part")
    known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
    return components(family.select("lo", "part", "sig", "node", "n", "role", "label", "met", "s").mapInArrow(_family_links, "a long, b long").unionByName(known))


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components inside the parts of families, as they are needed to join them.

    Rows of a part come together: members of its groups (s null), and each set
    once (sig null).
    """
    at, rows, sets = None, [], {}

    def done() -> Iterator[pa.RecordBatch]:
        if rows:
            links = compared(np.concatenate(rows, axis=1), sets)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k])) for k in (0, 1)], ["a", "b"])

    for b in batches:
        lo, part = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (part[1:] != part[:-1]))) if len(lo) else []
        for i, j in zip(cuts, np.append(cuts[1:], len(lo)) if len(cuts) else []):
            if (lo[i], part[i]) != at:
                yield from done()
                at, rows, sets = (lo[i], part[i]), [], {}
            piece = b.slice(i, j - i)
            has = piece.column(8).is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(has):
                sets[piece.column(3)[int(k)].as_py()] = _unpacked_set(piece.column(8)[int(k)])
            member = pa.array(~has)
            rows.append(np.stack([c.filter(member).to_numpy(zero_copy_only=False).astype(np.int64) for c in piece.columns[2:8]]))
    yield from done()


def compared(rows: np.ndarray, sets: dict[int, np.ndarray]) -> np.ndarray:
    """(smaller, larger) links of members (sig, node, size, role, label, met), one for each two components that they join.

    A member meets those of its groups that are in other components by then,
    later in order, of a fitting size and with enough shingles that others have.
    """
    sig, node = rows[0], rows[1]
    order = np.argsort(sig, kind="stable")
    nodes, first, of = np.unique(node, return_index=True, return_inverse=True)
    size, role, label, met = (rows[k][first] for k in (2, 3, 4, 5))
    # the roles that meet all others may differ between a node's groups: odd ones count only where all are
    role = np.ones(len(nodes), np.int64)
    np.minimum.at(role, of, rows[3] & 1)
    starts = np.flatnonzero(np.append(True, sig[order][1:] != sig[order][:-1]))
    ends = np.append(starts[1:], len(sig))
    group = np.empty(len(sig), np.int64)
    group[order] = np.repeat(np.arange(len(starts)), ends - starts)
    members = of[order]
    by_node = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[by_node], np.arange(len(nodes) + 1))
    own = [sets[x] for x in nodes.tolist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    _, ids = np.unique(np.concatenate(own), return_inverse=True)
    inside = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    joined, out = label.copy(), []
    later = np.zeros(len(nodes), bool)
    for x in range(len(nodes)):
        later[:] = False
        for g in group[by_node[bounds[x] : bounds[x + 1]]]:
            later[members[starts[g] : ends[g]]] = True
        later[: x + 1] = False
        y = np.flatnonzero(later & (joined != joined[x]))
        y = y[fits(size[y], size[x]) & ((role[y] & role[x]) == 0) & ((NUM + DEN) * np.minimum(met[y], met[x]) >= NUM * (size[y] + size[x]))]
        if not len(y):
            continue
        inside[ids[offsets[x] : offsets[x + 1]]] = True
        n = offsets[y + 1] - offsets[y]
        begin = np.cumsum(n) - n
        shared = np.add.reduceat(inside[ids[np.arange(n.sum()) - np.repeat(begin - offsets[y], n)]].astype(np.int64), begin)
        inside[ids[offsets[x] : offsets[x + 1]]] = False
        for z in y[DEN * shared >= NUM * (n + len(own[x]) - shared)]:
            if joined[z] != joined[x]:
                out.append((min(nodes[x], nodes[z]), max(nodes[x], nodes[z])))
                joined[joined == joined[z]] = joined[x]
    return np.array(out, np.int64).reshape(-1, 2)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component so far, of the large groups that span several, as few as will do.

    Every pair in small groups has been compared, so a link between components
    that is not known yet shares ``need`` signatures of these groups: a member
    with fewer drops out, one with more keeps all but its need - 1 most frequent.
    """
    m = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = m.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("sig", "size", "lo")
    own = W.partitionBy("node", "role")
    m = m.join(mixed, "sig").withColumn("have", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("size", "sig")))
    return m.where("rank <= have - need + 1")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, broadcast_ids: int = 500_000) -> DataFrame:
    """(id, n_shingles, component_id) of every text.

    A text with fewer than ``width`` words is its whole sequence as one shingle;
    a null, empty or wordless text has an empty set, links with nothing and is
    its own component. Copies of a set are one component. Rows that share an id
    but not the text, null ids too, are told apart by their texts; a null id is
    no component's smallest unless all are null. An empty table gives no rows.
    Shingles are compared by 64-bit hashes. Only the two named columns are read.
    """
    c = _components(docs, id_col, text_col, width, broadcast_ids)
    return c.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, broadcast_ids: int) -> DataFrame:
    """(k, h, n, component, keep) of every row: id, hash of the text, set size, the component's smallest id and its (id, hash); null for an empty set."""
    d = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    sets = durable(shingle_sets(d, width))
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h"))
    nodes = sets.where("fp is not null").groupBy("fp").agg(first.alias("rep"))
    labels = linked_nodes(d, nodes, width, broadcast_ids, risky_bands(sets))
    classes = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = classes.groupBy("label").agg(F.min("rep").alias("keep"))
    of = durable(classes.join(least, "label").select(F.col("fp").alias("fp1"), "keep"))
    return sets.join(of, F.col("fp") == F.col("fp1"), "left").select("k", "h", "n", F.col("keep.k").alias("component"), "keep")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, broadcast_ids: int = 500_000) -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest id, with all its columns.

    Rows are told apart by id and text, so that one whose id occurs elsewhere
    goes only where its own text is a near duplicate; of several texts of the
    component under its smallest id one stays, and of rows alike in id and text
    one. Null ids come last. Rows without a word stay, all of them.
    """
    c = durable(_components(docs, id_col, text_col, width, broadcast_ids))
    names = free(docs.columns, 2)
    keys = [F.col("k").alias(names[0]), F.col("h").alias(names[1])]
    same = lambda: F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    words = c.where("n > 0")
    gone = words.where(~(F.col("k").eqNullSafe(F.col("keep.k")) & (F.col("h") == F.col("keep.h")))).select(*keys).distinct()
    kept = docs.join(gone, same(), "left_anti")
    again = durable(words.where(F.col("k").eqNullSafe(F.col("keep.k")) & (F.col("h") == F.col("keep.h"))).groupBy(*keys).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return kept
    return kept.join(again, same(), "left_anti").unionByName(kept.join(again, same(), "left_semi").dropDuplicates([id_col, text_col]))
