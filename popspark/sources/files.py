"""CSV with one or two header rows, statistical exports, run files and sinks."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_typed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; nothing is inferred."""
    return spark.read.csv(path, header=True, inferSchema=False)


def _head(spark: SparkSession, path: str, lines: int) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(lines).collect()]


def read_marginals(spark: SparkSession, path: str, zone: str = "zone_id", drop: Sequence[str] = ("sample_geog",)) -> DataFrame:
    """Two-header CSV (attribute, then state) as long (zone, att, state, value). Absent columns to drop are fine."""
    wide, cells = _marginals(spark, path, zone)
    pairs = [(c, a, s) for c, a, s in cells if a not in drop]
    long = wide.select(zone, F.explode(F.array(*[F.struct(F.lit(a).alias("att"), F.lit(s).alias("state"), F.col(c).try_cast("long").alias("value")) for c, a, s in pairs])).alias("x"))
    return long.select(zone, "x.*")


def _marginals(spark: SparkSession, path: str, zone: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    atts, states = (next(csv.reader(io.StringIO(line))) for line in _head(spark, path, 2))
    atts = [a.strip() for a in atts]
    for i, a in enumerate(atts):  # a repeated attribute may stand only over its first state
        if not a or a.startswith("Unnamed"):
            atts[i] = atts[i - 1] if i else a
    names = [f"c{i}" for i in range(len(atts))]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    zone_col = names[atts.index(zone)]
    body = rows.where(~F.col(zone_col).eqNullSafe(zone) & F.col(zone_col).rlike(r"\d|\w") & (F.col(zone_col) != states[atts.index(zone)]))
    wide = body.withColumnRenamed(zone_col, zone)
    return wide, [(n, a, s.strip()) for n, a, s in zip(names, atts, states) if n != zone_col]


def read_marginals_with_geography(spark: SparkSession, path: str, zone: str = "zone_id", geography: str = "sample_geog") -> tuple[DataFrame, DataFrame]:
    """(long marginals, (zone, geography) of every zone)."""
    wide, cells = _marginals(spark, path, zone)
    col = next(c for c, a, _ in cells if a == geography)
    return read_marginals(spark, path, zone, (geography,)), wide.select(zone, F.col(col).alias(geography))


def read_export(spark: SparkSession, path: str, columns: Sequence[str], skip_head: int = 9, skip_foot: int = 7, prefix: str = "") -> DataFrame:
    """A statistical agency's CSV export: lines before and after the table go, so does the ``Total`` column.

    Files are read whole, one file a row: an export is one table of a zone level.
    """
    files = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n").alias("l"))
    n = F.size("l")
    lines = files.select(F.explode(F.slice("l", F.lit(skip_head + 1), F.greatest(n - skip_head - skip_foot, F.lit(0)))).alias("line")).where(F.length(F.trim("line")) > 0)
    got = lines.select(F.from_csv("line", ", ".join(f"`{c}` string" for c in columns)).alias("r")).select("r.*").drop("Total")
    return got.withColumnsRenamed({c: f"{prefix}{c}" for c in got.columns[1:]}) if prefix else got


def read_runs(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All matching files below a folder, with the run's name from the path."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).csv(folder, header=True)
    return df.withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)\.\w+$", 1))


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """The first path of that name below a folder, or None."""
    try:
        got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder).select("path").orderBy("path").limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return got[0][0] if got else None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_step(df: DataFrame, path: str, run: int, step: int, att: str) -> None:
    """One adjusted population below ``path``, partitioned by run and step."""
    df.withColumns({"run": F.lit(run), "step": F.lit(step), "adjusted_att": F.lit(att)}).write.mode("append").partitionBy("run", "step").parquet(path)


def write_marginals(long: DataFrame, path: str, zone: str = "zone_id") -> None:
    """Long marginals as a table with a column ``att__state`` for each cell."""
    from ..operators.condense import widen

    states = [(r["att"], r["state"]) for r in long.select("att", "state").distinct().orderBy("att", "state").collect()]
    write_csv(widen(long, [zone], states), path)


def resolved(base: str, path: str) -> str:
    """A path of a run file: relative ones start at the file's own folder."""
    return path if "://" in path or path.startswith("/") else str(PurePosixPath(base).parent / path)


def artefact_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name which driver and executors share: below the checkpoint folder, else, on one machine, the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/artefacts/{name}"


def write_steps(df: DataFrame, path: str, run: str = "run", step: str = "step") -> None:
    """Adjusted populations of many runs and steps, a folder each.

    A task has a writer open for each of its folders, up to a thousand, so that
    its rows are not sorted by folder, and none is held.
    """
    writers, spark = "spark.sql.maxConcurrentOutputFileWriters", df.sparkSession
    before = spark.conf.get(writers)
    spark.conf.set(writers, "1000")
    try:
        df.write.mode("overwrite").partitionBy(run, step).parquet(path)
    finally:
        spark.conf.set(writers, before)


def write_kept(df: DataFrame, path: str, run: str = "run") -> None:
    """What each run keeps, a folder a run."""
    df.write.mode("overwrite").partitionBy(run).parquet(path)


def write_states(spark: SparkSession, states: dict[str, list[str]], path: str) -> None:
    """States of each attribute in their order, as a table."""
    rows = [(a, i, s) for a, every in states.items() for i, s in enumerate(every)]
    spark.createDataFrame(rows, "att string, place int, state string").coalesce(1).write.mode("overwrite").parquet(path)


def read_states(spark: SparkSession, path: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in spark.read.parquet(path).orderBy("att", "place").collect():
        out.setdefault(r["att"], []).append(r["state"])
    return out


def write_pools(pools: dict[str, DataFrame], path: str) -> None:
    """Pools of pairs, a table for each edge."""
    for edge, df in pools.items():
        df.write.mode("overwrite").parquet(f"{path}/{edge}")


def read_pools(spark: SparkSession, path: str, edges: list[str]) -> dict[str, DataFrame]:
    return {edge: spark.read.parquet(f"{path}/{edge}") for edge in edges}
