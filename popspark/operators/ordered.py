"""Global order without a single task: range partitions, their totals, and sums inside each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..durable import cut


def running_total(df: DataFrame, order: Sequence[str], value: Column, out: str) -> tuple[DataFrame, float]:
    """``df`` with the sum of ``value`` up to and with each row in the order of ``order``, and the whole sum.

    Rows are range-partitioned and kept; the driver holds one number a
    partition. Ties should not matter to the caller or be in ``order``.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = cut(df.withColumn(out, value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    totals = sorted((r["__part"], r["s"]) for r in d.groupBy("__part").agg(F.sum(out).alias("s")).collect())
    kind = "double" if d.schema[out].dataType.simpleString() == "double" else "long"
    base, bases = 0.0 if kind == "double" else 0, []
    for part, s in totals:
        bases.append((part, base))
        base += s or 0
    known = F.broadcast(spark.createDataFrame(bases, f"__part int, __base {kind}"))  # one row a partition
    upto = F.sum(out).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn(out, upto).join(known, "__part").withColumn(out, F.col(out) + F.col("__base")).drop("__part", "__base"), base


def numbered(df: DataFrame, order: Sequence[str], out: str) -> tuple[DataFrame, int]:
    """``df`` with row numbers from 1 in the order of ``order``, and the number of rows."""
    return running_total(df, order, F.lit(1).cast("long"), out)
