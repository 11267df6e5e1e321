"""Runs from a YAML file: methods by name, reruns and their times."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bayes, evolve, ipf, ipu, saa
from ..operators.condense import condense
from ..operators.sampling import agents_from_weights
from ..sources.files import read_marginals, read_strings, resolved, write_csv, write_step

Method = Callable[[SparkSession, dict, int], dict[str, DataFrame]]


def _tables(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame, list[str]]:
    atts = list(cfg["considered_atts"])
    return read_marginals(spark, cfg["hh_marg_file"], cfg["zone_field"]), condense(read_strings(spark, cfg["hh_sample_file"]).select(*atts), atts), atts


def run_saa(spark: SparkSession, cfg: dict, rerun: int) -> dict[str, DataFrame]:
    marg, pool, atts = _tables(spark, cfg)
    where = f"{cfg['output_name']}/steps_{rerun}"
    keep = (lambda r, s, a, df: write_step(df, where, r, s, a)) if cfg.get("output_each_step") else None
    return {cfg["hh_syn_name"]: saa.run(marg, pool, atts, cfg.get("ordered_to_adjust_atts"), cfg.get("last_adjustment_order") or (), cfg.get("max_run_time", 15), cfg.get("extra_rm_frac", 0.3), cfg["zone_field"], cfg.get("include_zero_cell_values", True), cfg.get("randomly_add_last") or (), cfg.get("seed", 0) + rerun, keep)}


def run_ipf(spark: SparkSession, cfg: dict, rerun: int) -> dict[str, DataFrame]:
    marg, pool, atts = _tables(spark, cfg)
    zone = cfg["zone_field"]
    w = ipf.fit(pool.withColumn("weight", F.col("count").cast("double")).drop("count"), marg, atts, zone)
    return {cfg["hh_syn_name"]: agents_from_weights(w, "weight", [zone], atts)}


def run_ipu(spark: SparkSession, cfg: dict, rerun: int) -> dict[str, DataFrame]:
    zone, key = cfg["zone_field"], cfg.get("household_id", "serialno")
    hh, pp = read_strings(spark, cfg["hh_sample_file"]), read_strings(spark, cfg["p_sample_file"])
    hm, pm = read_marginals(spark, cfg["hh_marg_file"], zone), read_marginals(spark, cfg["p_marg_file"], zone)
    atts = lambda m: [r[0] for r in m.select("att").distinct().orderBy("att").collect()]
    inc = ipu.incidence(hh, pp, key, atts(hm), atts(pm))
    targets = hm.withColumn("level", F.lit("household")).unionByName(pm.withColumn("level", F.lit("person")))
    w = ipu.run(inc, targets, key, zone)
    n = ipu.synthesise(w, key, zone)
    homes = n.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("hh_id", F.concat_ws("-", zone, key, "copy"))
    stats = w.groupBy(zone).agg(F.max("fit").alias("fit"), F.max("iterations").alias("iterations"))
    return {cfg["hh_syn_name"]: homes.join(hh, key).drop("n", "copy"), cfg["pp_syn_name"]: homes.select(zone, key, "hh_id").join(pp, key), cfg["stats_name"]: stats}


def run_bn(spark: SparkSession, cfg: dict, rerun: int) -> dict[str, DataFrame]:
    marg, _, atts = _tables(spark, cfg)
    zone = cfg["zone_field"]
    seed = read_strings(spark, cfg["hh_sample_file"]).select(*atts)
    net = bayes.learn_structure(seed, atts)
    totals = marg.groupBy(zone).agg((F.sum("value") / F.countDistinct("att")).alias("total"))
    return {cfg["hh_syn_name"]: bayes.sample_evidence(totals, net, bayes.learn_parameters(seed, net), [zone], "total", atts, cfg.get("seed", 0) + rerun)}


def run_naive(spark: SparkSession, cfg: dict, rerun: int) -> dict[str, DataFrame]:
    marg, pool, atts = _tables(spark, cfg)
    n = marg.agg((F.sum("value") / F.countDistinct("att")).cast("long")).collect()[0][0]
    return {cfg["hh_syn_name"]: evolve.naive_synthesis(pool, n, atts, cfg.get("seed", 0) + rerun)}


def run_wgan(spark: SparkSession, cfg: dict, rerun: int) -> dict[str, DataFrame]:
    raise NotImplementedError("method wgan: no neural network library is at hand; see popspark.operators.evolve.categorical_generator")


METHODS: dict[str, Method] = {"saa": run_saa, "ipf": run_ipf, "ipu": run_ipu, "bn": run_bn, "naive": run_naive, "wgan": run_wgan}


def load(path: str) -> dict:
    """Runs by name; paths are resolved against the file's folder."""
    runs = yaml.safe_load(Path(path).read_text())
    for cfg in runs.values():
        for k in ("hh_marg_file", "p_marg_file", "hh_sample_file", "p_sample_file", "hh_seed_data", "output_name"):
            if cfg.get(k):
                cfg[k] = resolved(path, cfg[k])
    return runs


def synthesize(spark: SparkSession, path: str, method: str | None = None) -> list[tuple[str, str, int, float]]:
    """Run every run of a file (of one method, if named), write its tables and times, and return the times."""
    times = []
    for name, cfg in load(path).items():
        kind = cfg["method"]
        if method and kind != method:
            continue
        if kind not in METHODS:
            raise ValueError(f"unknown method {kind}")
        for rerun in range(cfg.get("reruns", 1)):
            began = time.time()
            for table, df in METHODS[kind](spark, cfg, rerun).items():
                write_csv(df, f"{cfg['output_name']}/{rerun}/{table}")
            times.append((kind, name, rerun, time.time() - began))
    if times:
        out = str(Path(path).parent / "run_times")
        spark.createDataFrame(times, "method string, run_name string, rerun int, time_seconds double").coalesce(1).write.mode("append").csv(out, header=True)
    return times


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Synthesise populations from a run file.")
    p.add_argument("runs")
    p.add_argument("--method", choices=sorted(METHODS))
    a = p.parse_args(argv)
    for kind, name, rerun, seconds in synthesize(SparkSession.builder.appName("popspark").getOrCreate(), a.runs, a.method):
        print(f"{name} ({kind}), rerun {rerun}: {seconds:.1f} s")


if __name__ == "__main__":
    main()
