"""Toxicity classifier with a counterfactual regulariser.

A logistic model over words and word beginnings. For labelled texts that
mention an identity term, the term is swapped for each other term of its set
and the squared change of the score's log-odds is penalised, so that the
mention of a group alone moves no score. In a linear model a swap changes the
log-odds by the difference of the two terms' weights, whatever the rest of the
sentence is; so the sum over all swapped sentences is that squared difference
times the number of texts with the term, and no swapped sentence has to be
written out. Each term counts one mention more than it has, which ties terms
that no labelled text has to the others of their set. It is fitted on a bounded sample of the labelled
rows, ``per_class`` of each label by hash order, weighted back to the share
that the labels have; ``n_features`` bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import NON_LETTERS, U64, Words, pieces

#: Word beginnings, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6, 8)
#: Terms that may stand for one another, by kind and language.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "trans"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) pairs of a piece, in several parts, with repeats."""
    w = Words(data, offsets, True, NON_LETTERS)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
    yield of, w.hashes
    size = w.ends - w.starts
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        yield of[at], w.span_hash(w.starts[at], w.starts[at] + n)


def term_features(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return np.unique(np.concatenate([f for _, f in _features(data, np.array([0, len(data)]))]))


@dataclass(frozen=True)
class ToxicityModel:
    """Ascending feature hashes with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number) pairs of a piece."""
        n, found = len(self.features), []
        seen = np.zeros(1 << 16, bool)
        seen[(self.features >> U64(48)).astype(np.int64)] = True
        for of, f in _features(data, offsets) if n else ():
            maybe = np.flatnonzero(seen[(f >> U64(48)).astype(np.int64)])
            at = np.searchsorted(self.features, f[maybe])
            at[at == n] = 0
            ok = self.features[at] == f[maybe]
            found.append(of[maybe[ok]].astype(np.int64) * n + at[ok])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(n, 1), pairs % max(n, 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for first, end, data, offsets in pieces(column):
            text, feature = self.hits(data, offsets)
            z = self.bias + np.bincount(text, self.weights[feature], end - first)
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(t, y) of the sampled labelled texts, and the labelled rows by class."""
    y = F.max(F.col(label_col).cast("int"))
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col)).where(F.col("k").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("k").agg(y.alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for c in totals:
        part = known.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return None, totals
    chosen = {r["k"]: r["y"] for r in ids.collect()}
    rows = docs.sparkSession.createDataFrame([(k, v) for k, v in chosen.items()], ids.schema)
    d = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    # an id with several texts gives one, the first by hash
    one = d.join(F.broadcast(rows), "k").groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    return one.select("t", "y"), totals


def _select(texts: DataFrame, n_features: int, min_texts: int) -> np.ndarray:
    """The features whose share of texts differs most surely between the classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, offsets in pieces(b.column(0)):
                parts = list(_features(data, offsets))
                of, f = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((of, f))
                of, f = of[order], f[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (of[1:] != of[:-1])
                of, f = of[new], f[new]
                if not len(f):
                    continue
                starts = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                ones = np.add.reduceat(y[first:end][of], starts)
                every = np.diff(np.append(starts, len(f)))
                yield pa.RecordBatch.from_arrays([pa.array(f[starts].view(np.int64)), pa.array(ones, pa.int64()), pa.array(every - ones, pa.int64())], ["f", "n1", "n0"])

    n = texts.groupBy().agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).collect()[0]
    p, q = float(n["p"] or 0) + 1, float(n["q"] or 0) + 1
    c = texts.mapInArrow(count, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= min_texts)
    z = F.abs(F.log((F.col("n1") + 0.5) / p) - F.log((F.col("n0") + 0.5) / q)) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    top = [r["f"] for r in c.select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(n_features).collect()]
    return np.array(top, np.int64).view(U64)


def _descend(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, float]], n: int, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic fit by Nesterov steps: log loss + ridge + squared score changes of the swaps."""
    w, b = np.zeros(n), 0.0
    total = weight.sum()
    steep = np.full(n, max(1.0, float(np.bincount(rows, minlength=len(y)).mean() + 1)) / 4)
    bias_rate = 1 / steep[0] if n else 1.0
    for a, c, share in pairs:  # row sums of the penalty's curvature bound each weight's step
        for at in (a, c):
            steep[at] += 2 * share * (len(a) + len(c))
    rate = 1 / steep
    vw, vb = w.copy(), b
    for step in range(steps):
        z = vb + np.bincount(rows, vw[cols], len(y))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        gw = np.bincount(cols, r[rows], n) + ridge * vw
        for a, c, share in pairs:
            change = vw[a].sum() - vw[c].sum()
            gw[a] += 2 * share * change
            gw[c] -= 2 * share * change
        nw, nb = vw - rate * gw, vb - bias_rate * r.sum()
        pull = step / (step + 3)
        vw, vb, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, n_features: int = 4096, min_texts: int = 3, swap_penalty: float = 5.0, ridge: float = 2e-5, steps: int = 400, identity_sets: tuple[tuple[str, ...], ...] = IDENTITY_SETS) -> ToxicityModel:
    """Model from the rows of ``labels`` with label 0 or 1.

    Null labels and ids are no examples; of several labels of one id the higher
    counts, of several texts the first by hash. Without labelled texts, or with one class only, the model gives the
    share of the label (0.0 without any) everywhere.
    """
    texts, totals = _sample(docs, labels, id_col, text_col, label_col, per_class)
    nothing = np.zeros(0, U64)
    n = sum(totals.values())
    if texts is None or len(totals) < 2:
        share = totals.get(1, 0) / n if n else 0.0
        return ToxicityModel(nothing, np.zeros(0), 40.0 if share == 1 else -40.0)
    terms = {t: term_features(t) for group in identity_sets for t in group}
    features = np.unique(np.concatenate([_select(texts, n_features, min_texts), *terms.values()]))
    blank = ToxicityModel(features, np.zeros(len(features)), 0.0)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, end, data, offsets in pieces(b.column(0)):
                text, feature = blank.hits(data, offsets)
                cuts = np.searchsorted(text, np.arange(end - first + 1))
                out += [feature[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(end - first)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], ["y", "f"])

    got = texts.mapInArrow(rows_of, "y int, f binary").collect()
    if not got:
        return ToxicityModel(nothing, np.zeros(0), float(np.log((totals[1] + 0.5) / (totals[0] + 0.5))))
    got = sorted((r["y"], bytes(r["f"])) for r in got)  # one order, whatever the tasks' order was
    y = np.array([r[0] for r in got], float)
    sets = [np.frombuffer(r[1], np.int32) for r in got]
    rows, cols = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    share = {c: totals[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    at = {t: np.searchsorted(features, f) for t, f in terms.items()}
    have = np.bincount(cols, minlength=len(features))
    pairs = []
    for group in identity_sets:
        mentions = {t: 1.0 + float(have[at[t]].min()) for t in group}
        for a in group:
            others = [c for c in group if c != a]
            pairs += [(np.setdiff1d(at[a], at[c]), np.setdiff1d(at[c], at[a]), swap_penalty * mentions[a] / len(sets) / len(others)) for c in others]
    w, b = _descend(rows, cols, y, weight, pairs, len(features), ridge, steps)
    return ToxicityModel(features, w, float(b))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a null text scores as an empty one.

    Empty tables give no rows, repeated rows a row each; a column that is called
    ``out_col`` is replaced, all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.drop(out_col)
    at = d.columns.index(text_col)
    names = [*d.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column(at)), pa.float64())], names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return d.mapInArrow(run, StructType([*d.schema.fields, StructField(out_col, DoubleType())]))
