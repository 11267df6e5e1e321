"""Product codes of vectors: a codebook for each part position, fitted by Yinyang Lloyd rounds over integers.

The entries of a codebook are put into groups once. Of each vector's part the
state holds the entry it has and one lower bound a group: no other entry of the
group is nearer than that. In a round the bounds fall by the group's largest
drift; the distance to the own entry is computed, and only groups whose bound
is not above it are scanned. Bounds are floats rounded down; every distance that
decides is an exact integer, ties going to the lower index, so that codes are
those of plain Lloyd rounds.

Vectors travel in blocks (one row for up to a thousand) with their state. A
round is one pass that writes the blocks anew into the shared folder and, one
row a task, the sums and counts of each entry; these are added in Spark and come
to the driver as one number per component of a codebook, whatever the input is.
The state of a round goes when the next is written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .durable import durable, shared_dir, small_batches

#: Integers up to here in size are exact in floats, sums of squares included, up to this many times.
EXACT = 2**53
#: Sums are added in Spark by digits of so many bits, so that none overflows.
LIMB = 30
LONG = 2**63 - 1


def finite(vector: Column, scale: int) -> Column:
    """Whether a vector is there with all its components, which stay finite when scaled."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def exact(*arrays: np.ndarray) -> bool:
    """Whether squared distances between these integers are exact in float64."""
    if any(a.dtype == object for a in arrays):
        return False
    top = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 4.0 * max(arrays[0].shape[-1], 1) * top * top < EXACT


def as_integers(x: np.ndarray) -> np.ndarray:
    """Whole floats as Python integers."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and of ``c``."""
    if x.dtype == object:
        return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]


def root_below(d: np.ndarray) -> np.ndarray:
    """Float32 roots that are not above the true ones."""
    r = np.minimum(np.sqrt(d.astype(np.float64)) * (1 - 1e-12), float(np.finfo(np.float32).max))
    return np.maximum(np.nextafter(r.astype(np.float32), np.float32(0)), np.float32(0))


def entry_groups(codebook: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry, by a few Lloyd rounds over the entries."""
    c = codebook.astype(np.float64)
    middle = c[np.linspace(0, len(c) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        of = ((c[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                middle[g] = c[of == g].mean(0)
    return of


def assign(x: np.ndarray, c: np.ndarray, groups: np.ndarray, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances computed) of the parts ``x`` under the codebook ``c``.

    ``at`` is each part's last entry, ``low`` its lower bound for every group, less the drift.
    """
    if not exact(x, c):
        x, c = as_integers(x), as_integers(c)
    own = ((x - c[at]) ** 2).sum(1)
    best, now, low, work = own.copy(), at.copy(), low.copy(), len(x)
    scans = []
    for g in range(low.shape[1]):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(low[:, g] <= np.nextafter(np.sqrt(best.astype(np.float64)), np.inf)) if len(members) else members
        if not len(rows):
            continue
        d = squares(x[rows], c[members])
        work += d.size
        first = d.argmin(1) if d.dtype != object else np.array([min(range(len(members)), key=r.__getitem__) for r in d])
        near = d[np.arange(len(rows)), first]
        rest = d.copy()
        rest[np.arange(len(rows)), first] = np.inf if d.dtype != object else (LONG << 300)
        second = rest.min(1)
        scans.append((g, rows, members[first], near, second))
        better = (near < best[rows]) | ((near == best[rows]) & (members[first] < now[rows]))
        best[rows[better]], now[rows[better]] = near[better], members[first][better]
    left = groups[at]
    moved = np.flatnonzero(now != at)
    low[moved, left[moved]] = np.minimum(low[moved, left[moved]], root_below(own[moved]))
    for g, rows, first, near, second in scans:
        low[rows, g] = root_below(np.where(first == now[rows], second, near))
    return now, best, low, work


def compact(x: np.ndarray) -> bytes:
    """Whole floats in the smallest type that holds them, its letter first."""
    top = np.abs(x).max() if x.size else 0
    kind = "h" if top < 2**15 else "i" if top < 2**31 else "d"
    return kind.encode() + x.astype(kind).tobytes()


def expand(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, chr(blob[0]), offset=1).astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))


class Fit:
    """Codebooks between rounds: integers by part, entry and position; groups of entries; what each group has drifted at most."""

    def __init__(self, seeds: list[list[int]], parts: int):
        self.parts, self.width = parts, len(seeds[0]) // parts if seeds else 0
        self.books = [[s[p * self.width : (p + 1) * self.width] for s in seeds] for p in range(parts)]
        n = max(1, len(seeds) // 4)
        self.groups = [entry_groups(self.book(p), n) for p in range(parts)] if seeds else []
        self.drift = np.zeros((parts, n), np.float64)

    def book(self, p: int) -> np.ndarray:
        return np.array(self.books[p], dtype=np.float64)

    def moved(self, sums: dict[int, int]) -> Fit:
        """The fit after a round whose sums, then count, lie at ((part * entries) + entry) * (width + 1)."""
        out = object.__new__(Fit)
        out.__dict__ |= self.__dict__
        out.books, out.drift = [], np.zeros_like(self.drift)
        k, w = len(self.books[0]), self.width
        for p, old in enumerate(self.books):
            new = []
            for e in range(k):
                base = (p * k + e) * (w + 1)
                n = sums.get(base + w, 0)
                new.append([sums.get(base + j, 0) // n for j in range(w)] if n else old[e])
                gone = sum((a - b) ** 2 for a, b in zip(new[e], old[e])) ** 0.5
                g = self.groups[p][e]
                out.drift[p, g] = max(out.drift[p, g], gone * (1 + 1e-9))
            out.books.append(new)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def coded(self, x: np.ndarray, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, int]:
        """All parts of the vectors ``x`` assigned: entries, squared distances by part, bounds, work."""
        now, d, bounds, work = np.empty_like(at), [], np.empty_like(low), 0
        for p in range(self.parts):
            fallen = np.maximum(low[:, p] * (1 - 1e-6) - self.drift[p], 0)
            now[:, p], far, bounds[:, p], w = assign(x[:, p * self.width : (p + 1) * self.width], self.book(p), self.groups[p], at[:, p], fallen.astype(np.float32))
            d.append(far)
            work += w
        return now, d, bounds, work


def add_sums(into: dict[int, int], fit: Fit, x: np.ndarray, at: np.ndarray) -> None:
    whole = x.astype(np.int64) if np.abs(x).max(initial=0) < 2**40 else as_integers(x)
    k, w = len(fit.books[0]), fit.width
    for p in range(fit.parts):
        for e in np.unique(at[:, p]):
            rows = whole[at[:, p] == e, p * w : (p + 1) * w]
            base = (p * k + int(e)) * (w + 1)
            for j, v in enumerate([*rows.sum(axis=0), len(rows)]):
                into[base + j] = into.get(base + j, 0) + int(v)


def limbs(sums: dict[int, int]) -> list[dict]:
    out = []
    for key, v in sums.items():
        sign, v, i = (-1 if v < 0 else 1), abs(v), 0
        while v:
            out.append({"key": key, "limb": i, "value": sign * (v & (2**LIMB - 1))})
            v, i = v >> LIMB, i + 1
    return out


class Rounds:
    """Tables of one fit in the shared folder; each goes when the next is there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        at = f"{self.folder}/{self.n}"
        df.write.parquet(at)
        if self.n:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n - 1}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(at)


def seeds(kept: DataFrame, parts: int, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, nulls last, of the length that the first one has."""
    fits = kept.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    first = lambda d: [list(r.x) for r in d.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    found = first(fits)
    if any(len(v) != len(found[0]) for v in found):
        found = first(fits.where(F.size("x") == len(found[0])))
    return found


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Fit]:
    """((id, label, code, error, label_error) of every kept vector, the fit with its codebooks).

    A vector that is null or holds a null or non-finite component (as it is or
    scaled) is dropped. Of equal ids, the smaller vector seeds a codebook first;
    null ids come last; repeated rows count as often as they come. Fewer vectors
    than ``entries`` make shorter codebooks. A vector that has another length
    than the first seed's, or one that does not fall into ``parts``, takes no
    part in the fit: its code and error are null. An error beyond a long is
    null. Labels that are null are one label. An empty table gives no rows and
    empty codebooks. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    types = {c: vectors.schema[n].dataType.simpleString() for c, n in (("id", id_col), ("label", label_col))}
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")).where(finite(F.col("x"), scale))
    fit = Fit([[int(np.floor(float(v) * scale)) for v in s] for s in seeds(kept, parts, entries)], parts)
    if not fit.groups:
        none = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none.withColumn("label_error", F.lit(None).cast("long")), fit
    dim, n_groups = fit.width * parts, fit.drift.shape[1]
    schema = f"ids array<{types['id']}>, labels array<{types['label']}>, odd binary, x binary, at binary, low binary, sums array<struct<key:int,limb:int,value:bigint>>"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            ids, labels, x = b.columns
            sizes = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            odd = sizes != dim
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.zeros((len(sizes), dim))
            whole[~odd] = np.floor(flat[np.repeat(~odd, sizes)].reshape(-1, dim) * scale)
            n = len(sizes)
            yield ids, labels, odd, whole, np.zeros((n, parts), np.uint8), np.zeros((n, parts, n_groups), np.float32)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i, (odd, x, at, low) in enumerate(zip(*(b.column(k).to_pylist() for k in ("odd", "x", "at", "low")))):
                if x is not None:
                    n = len(odd)
                    yield b.column("ids")[i].values, b.column("labels")[i].values, np.frombuffer(odd, bool), expand(x, dim), np.frombuffer(at, np.uint8).reshape(n, parts), np.frombuffer(low, np.float32).reshape(n, parts, n_groups)

    def step(source, fit: Fit):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, int] = {}
            for ids, labels, odd, x, at, low in source(batches):
                at, _, low, _ = fit.coded(x, at, low)
                add_sums(sums, fit, x[~odd], at[~odd])
                one = [pa.array([v]) for v in (odd.tobytes(), compact(x), at.tobytes(), low.tobytes())]
                listed = [pa.ListArray.from_arrays([0, len(v)], v) for v in (ids, labels)]
                yield pa.RecordBatch.from_arrays([*listed, *one, pa.nulls(1, SUMS)], NAMES)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(ID)), pa.nulls(1, pa.list_(LABEL)), *[pa.nulls(1, pa.binary())] * 4, pa.array([limbs(sums)], SUMS)], NAMES)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    ID, LABEL = (to_arrow_type(vectors.schema[c].dataType) for c in (id_col, label_col))
    SUMS = pa.list_(pa.struct([("key", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
    NAMES = ["ids", "labels", "odd", "x", "at", "low", "sums"]
    tables, state = Rounds(spark), None
    for _ in range(rounds):
        state = tables.put(kept.mapInArrow(step(blocks, fit), schema) if state is None else state.mapInArrow(step(stored, fit), schema))
        found = state.where("sums IS NOT NULL").select(F.explode("sums").alias("s")).groupBy("s.key", "s.limb").agg(F.sum("s.value").alias("v")).collect()
        sums: dict[int, int] = {}
        for r in found:
            sums[r.key] = sums.get(r.key, 0) + (r.v << LIMB * r.limb)
        fit = fit.moved(sums)

    source, last = blocks if state is None else stored, fit

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, odd, x, at, low in source(batches):
            at, d, _, _ = last.coded(x, at, low)
            errors = [sum(int(far[i]) for far in d) for i in range(len(odd))]
            codes = pa.array([None if o else a.tobytes().hex() for o, a in zip(odd, at)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array([None if o or e > LONG else e for o, e in zip(odd, errors)], pa.int64())], ["id", "label", "code", "error"])

    coded = durable((kept if state is None else state.drop("sums")).mapInArrow(finish, f"id {types['id']}, label {types['label']}, code string, error bigint"))
    return with_label_errors(coded), fit


def with_label_errors(coded: DataFrame, heavy: int = 1000) -> DataFrame:
    """``coded`` with the sum of its label's errors.

    Labels with at least one row in ``heavy`` are at most ``heavy`` many: they
    are broadcast. The others, none of them large, are joined by a shuffle.
    """
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    per = durable(coded.groupBy(F.col("label").alias("of")).agg(F.when(total <= LONG, total.cast("long")).alias("label_error"), F.count(F.lit(1)).alias("n")))
    rows = per.agg(F.sum("n")).first()[0] or 0
    large = F.broadcast(per.where(F.col("n") * heavy >= rows).select("of", "label_error"))
    small = per.where(F.col("n") * heavy < rows).select("of", "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    out = coded.join(large, same).drop("of")
    if not small.isEmpty():
        out = out.unionByName(coded.join(large, same, "left_anti").join(small, same).drop("of"))
    return out
