"""Connected components of a link table, without the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .durable import durable

#: Links that a task gathers before it reduces them to stars.
_HELD = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, node) of every node that the links join to a smaller one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        px, py = up[x], up[y]
        if (px == py).all():
            break
        np.minimum.at(up, np.maximum(px, py), np.minimum(px, py))
        while (up != (next_up := up[up])).any():
            up = next_up
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[moved]], nodes[moved]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (a, b) as stars; a row with a = b says that the input still moved."""
    held: list[np.ndarray] = []
    size, moved, least = 0, False, _HELD
    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        link = a != b
        moved |= not link.all()
        held.append(np.stack([a[link], b[link]]))
        size += int(link.sum())
        if size > least:
            held = [np.stack(stars(*np.concatenate(held, axis=1)))]
            size = held[0].shape[1]
            least = max(_HELD, 2 * size)
    if moved:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64())], ["a", "b"])
    if size:
        a, b = stars(*np.concatenate(held, axis=1))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of the nodes of (a, b) links that are not their component's smallest; the label is that one.

    Tasks first reduce their links to stars around the smallest node they know,
    so that a node has at most one link a task. Each round then takes a node's
    smallest neighbour for its parent, links its other neighbours to that one,
    and gives every node its parent's parent; it ends when nothing moves. The
    number of rounds grows with the logarithm of the longest chain. A round is
    one grouping and one join.
    """
    edges = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").mapInArrow(_local, "a long, b long"))
    for _ in range(rounds):
        near = edges.where("a < b").groupBy("b").agg(F.min("a").alias("p"), F.collect_set("a").alias("near"))
        up = near.select(F.col("b").alias("c"), F.col("p").alias("top"))
        jumped = near.join(up, F.col("p") == F.col("c"), "left").select("b", "p", "near", "top")
        link = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
        others = F.transform(F.filter("near", lambda x: x != F.col("p")), lambda x: link(F.col("p"), x))
        own = F.array(link(F.coalesce("top", "p"), F.col("b")))
        still = F.when((F.size("near") > 1) | F.col("top").isNotNull(), F.array(link(F.lit(0).cast("long"), F.lit(0).cast("long")))).otherwise(F.array())
        edges = durable(jumped.select(F.inline(F.concat(own, others, still))).mapInArrow(_local, "a long, b long"))
        if edges.where("a = b").isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    raise RuntimeError(f"components: no end after {rounds} rounds")
