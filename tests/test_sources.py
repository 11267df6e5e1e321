import pytest
from pyspark.sql import functions as F

from popspark.plans import runner
from popspark.sources import files


@pytest.fixture
def marg_file(tmp_path):
    p = tmp_path / "marg.csv"
    p.write_text("zone_id,sample_geog,size,size,kind,kind\n,,1,2+,a,b\n10,7,3,5,4,4\n11,8,2,0,1,1\n")
    return str(p)


def test_two_header_rows(spark, marg_file):
    got = {(r.zone_id, r.att, r.state): r.value for r in files.read_marginals(spark, marg_file).collect()}
    assert got == {("10", "size", "1"): 3, ("10", "size", "2+"): 5, ("10", "kind", "a"): 4, ("10", "kind", "b"): 4, ("11", "size", "1"): 2, ("11", "size", "2+"): 0, ("11", "kind", "a"): 1, ("11", "kind", "b"): 1}
    long, geo = files.read_marginals_with_geography(spark, marg_file)
    assert long.count() == 8 and {(r.zone_id, r.sample_geog) for r in geo.collect()} == {("10", "7"), ("11", "8")}


def test_export_lines(spark, tmp_path):
    p = tmp_path / "export.csv"
    p.write_text("\n".join(["head"] * 9 + ["z1,1,2,3", "z2,4,5,9"] + ["foot"] * 7))
    got = files.read_export(spark, str(p), ["zone", "a", "b", "Total"], prefix="t_")
    assert got.columns == ["zone", "t_a", "t_b"] and got.count() == 2


def test_find_and_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("one", "two"):
        (tmp_path / "in" / f"{n}.csv").write_text("a\n1\n")
    assert {r.run for r in files.read_runs(spark, str(tmp_path)).collect()} == {"one", "two"}
    assert files.find_file(spark, str(tmp_path), "two.csv").endswith("in/two.csv")
    assert files.find_file(spark, str(tmp_path), "none.csv") is None


def test_strings_typed_and_sinks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n01,2\n")
    assert files.read_strings(spark, str(p)).collect()[0].a == "01"
    assert files.read_typed(spark, str(p), "a int, b int").collect()[0].a == 1
    long = spark.createDataFrame([("z", "s", "x", 2)], "zone_id string, att string, state string, value long")
    files.write_marginals(long, str(tmp_path / "wide"))
    assert files.read_strings(spark, str(tmp_path / "wide")).columns == ["zone_id", "s__x"]
    files.write_step(long, str(tmp_path / "steps"), 0, 1, "s")
    assert spark.read.parquet(str(tmp_path / "steps")).where("run = 0 AND step = 1").count() == 1


def test_run_file(spark, tmp_path, marg_file):
    (tmp_path / "sample.csv").write_text("serialno,size,kind\n1,1,a\n2,2+,b\n3,1,b\n4,2+,a\n")
    base = "hh_marg_file: marg.csv, hh_sample_file: sample.csv, zone_field: zone_id, considered_atts: [size, kind], hh_syn_name: hh, max_run_time: 2, extra_rm_frac: 0.0"
    (tmp_path / "runs.yml").write_text("".join(f"{m}_run: {{method: {m}, output_name: out_{m}, {base}}}\n" for m in ("saa", "ipf", "bn", "naive")))
    times = runner.synthesize(spark, str(tmp_path / "runs.yml"))
    assert [x[0] for x in times] == ["saa", "ipf", "bn", "naive"] and all(x[3] > 0 for x in times)
    for m in ("saa", "ipf", "bn", "naive"):
        assert files.read_strings(spark, str(tmp_path / f"out_{m}" / "0" / "hh")).count() == 10, m
    assert files.read_strings(spark, str(tmp_path / "run_times")).count() == 4


def test_unknown_and_absent_methods(spark, tmp_path):
    (tmp_path / "runs.yml").write_text("x: {method: odd, output_name: o}\n")
    with pytest.raises(ValueError):
        runner.synthesize(spark, str(tmp_path / "runs.yml"))
    (tmp_path / "runs.yml").write_text("x: {method: wgan, output_name: o}\n")
    with pytest.raises(NotImplementedError):
        runner.synthesize(spark, str(tmp_path / "runs.yml"))
