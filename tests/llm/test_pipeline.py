"""The stages in a row, and each against its plain version on the smallest tables."""

import random

import pytest

import corpus_pipeline as pipeline
from popspark.llm import queries

from . import brute
from .data import words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        after = out.collect()
        kept = {r.doc_id for r in after}
        assert kept <= {k for k, _ in before}
        if name != "mixing":
            assert out.columns == columns
            docs = spark.createDataFrame(after, out.schema)
        if name == "line_dedup":
            want = [(k, x) for (k, t), (_, x) in zip(before, brute.dedup_lines(before)) if x == t or brute.WORD.search(x or "")]
            assert sorted((r.doc_id, r.text) for r in after) == sorted(want)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "jaccard_join":
            assert kept == {k for k, _, c in brute.jaccard_components(before) if k == c}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept == {k for k, _ in before} - {k for k, *_ in brute.contained(before, items)}


EDGES = "doc_id long, text string, lang string, source string, n_chars long, __0 int, __1 int, k int, d long, score double, target string, n_lines int, N_Removed int"


def edge_rows():
    rng = random.Random(51)
    a, b, c = ("\n".join(" ".join(words(rng, 20)) for _ in range(4)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, None), (7, ""), (7, None), (8, " \n "), (9, "one"), (9, "one"), (10, " ".join(words(rng, 30_000)))]
    return [(k, t, None if k is None else "en", None if k == 9 else "s", None if t is None else len(t), 1, 2, 3, 4, 0.9, "x", 5, 6) for k, t in rows]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_at_the_edges(spark, sf, name, stage):
    """Nulls, empty and long texts, shared ids, repeated rows and clashing names: every row is judged by its own text."""
    rows = edge_rows()
    docs = spark.createDataFrame(rows, EDGES).repartition(3)
    got = stage(spark, docs, sf)
    assert got.columns[:11] == docs.columns[:11] or name == "mixing"
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    before = sorted(((r[0], r[1]) for r in rows), key=repr)
    if name in ("toxicity", "decontamination"):
        assert texts == before
    elif name == "line_dedup":
        want = [(k, x) for (k, t), (_, x) in zip(before, brute.dedup_lines(before)) if x == t or brute.WORD.search(x or "")]
        assert texts == sorted(want, key=repr)
    elif name == "jaccard_join":
        a, b, c = rows[0][1], rows[2][1], rows[4][1]
        assert texts == sorted([(1, a), (5, b), (None, c), (None, None), (7, ""), (7, None), (8, " \n "), (9, "one"), rows[12][:2]], key=repr)
    else:
        assert set(texts) <= {r for r in before if brute.WORD.search(r[1] or "")} and len(texts) == len(set(texts))
        assert all(0 < r.taken <= 2 * len(brute.WORD.findall(r.text)) * texts.count((r.doc_id, r.text)) * 2 for r in got.collect())
    if name != "mixing":
        assert {(r.n_lines, r.N_Removed) for r in stage(spark, docs, sf).collect()} == {(5, 6)}
    assert stage(spark, docs.limit(0), sf).collect() == []


def test_names():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for i in range(1, 14) for n in queries.QUERIES if n.startswith(f"op{i}_")]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
