"""Exchange of packed arrays: few wide rows instead of one row per entry.

A map task packs its entries by bucket into binary rows (bucket, kind, blob); a
repartition by bucket brings all blobs of a bucket to one task, which reads
them as arrays. Buckets are many per partition, so their sizes even out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import split_buckets
from .durable import partitions

SCHEMA = "bucket int, kind int, blob binary"


def bucket_count(df: DataFrame) -> int:
    """Four buckets for each shuffle partition."""
    return 4 * partitions(df.sparkSession)


def packed(keys: np.ndarray, columns: list[np.ndarray], n_buckets: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of one blob per bucket that the keys (well-mixed 64-bit) fall into."""
    if not len(keys):
        return
    order, found, bounds = split_buckets(keys, n_buckets)
    columns = [c[order] for c in columns]
    blobs = [b"".join(c[bounds[i] : bounds[i + 1]].tobytes() for c in columns) for i in range(len(found))]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), kind), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def unpacked(blobs: list[bytes], types: list) -> list[np.ndarray]:
    """The columns that ``packed`` was given, over all blobs."""
    width = sum(np.dtype(t).itemsize for t in types)
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for b in blobs:
        n, at = len(b) // width, 0
        for out, t in zip(parts, types):
            out.append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types)]


def by_bucket(blobs: DataFrame, reduce: Callable[[dict[int, list[bytes]], int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``reduce`` over each bucket's blobs by kind, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != at and held:
                    yield from reduce(held, at)
                    held = {}
                at = bucket
                held.setdefault(kind, []).append(blob)
        if held:
            yield from reduce(held, at)

    return blobs.repartition(partitions(blobs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
