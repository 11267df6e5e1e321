"""Each operator against its plain version, with nulls, empty tables, ties, repeats and clashing columns."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from popspark.llm import decontamination, html, toxicity
from popspark.llm.jaccard import SMALL_GROUP, Band, band_of, band_start, jaccard_components, one_of_each_component
from popspark.llm.lines import dedup_lines
from popspark.llm.lm import score_texts
from popspark.llm.mixing import mix_sources, source_targets
from popspark.llm.quality import quality_rules
from popspark.llm.substrings import remove_repeats
from popspark.llm.tokens import token_counts

from . import brute
from .data import frame, words


def keyed(rows):
    return sorted(map(tuple, rows), key=repr)


# 1


def test_lm_base_and_score(docs, rows):
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()
    want = brute.base_scores(rows, lambda k: k is not None and not brute.fold(k, 1))
    assert keyed((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == keyed((k, a, b, n, round(s, 6)) for (k, _), (a, b, n, s) in zip(rows, want))
    assert all(r.score < 0 and r.score == r.score for r in got)


def test_lm_learns(spark):
    import random

    rng = random.Random(1)
    make = lambda: " ".join(rng.choice(["the", "of", "thing", "bling", "string"]) + rng.choice(["", "er", "ing"]) for _ in range(300))
    d = frame(spark, [(i, make()) for i in range(40)] + [(100, "".join(rng.choice("qxzjkvw ") for _ in range(1500)))])
    got = {r.doc_id: r.bits_per_byte for r in score_texts(d, F.col("doc_id") < 30).collect()}
    assert max(got[i] for i in range(30, 40)) < 1.5 and got[100] > 2 * got[35]


def test_lm_without_training_or_rows(docs, empty, rows):
    got = score_texts(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and all(r.base_score == 0 and r.train_tokens == 0 and r.score < 0 for r in got)
    assert score_texts(empty, F.lit(True)).collect() == []


def plain_counts(texts, learn):
    """Counts of each token, pair and triple in the training texts but the own one, and of their tokens."""
    seqs = [["\n", "\n", *brute.low_words(t), "\n"] for t in texts]
    grams = [[[tuple(s[i - n + 1 : i + 1]) for i in range(2, len(s))] for s in seqs] for n in (1, 2, 3)]
    counts = [Counter(g for row, yes in zip(of, learn) if yes for g in row) for of in grams]
    own = [[Counter(row) if yes else Counter() for row, yes in zip(of, learn)] for of in grams]
    total = sum(counts[0].values())
    c = [[counts[n][g] - own[n][i][g] for i, row in enumerate(grams[n]) for g in row] for n in range(3)]
    return c, [total - sum(own[0][i].values()) for i, row in enumerate(grams[0]) for _ in row]


def test_lm_mixes_plain_counts(spark):
    """Scores are those of the mixer over counts made in plain Python, whatever the partitions are."""
    import numpy as np
    import pyarrow as pa
    import random

    from popspark.llm import lm
    from popspark.llm.arrays import buffers

    rng = random.Random(8)
    base = words(rng, 60)
    texts = sorted({" ".join(words(rng, rng.randrange(1, 30))) for _ in range(25)} | {" ".join(base), " ".join(base[:40] + ["other"] + base[41:]), ""})
    rows = list(enumerate(texts))
    learn = [k % 4 != 1 for k, _ in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{r.doc_id: r.score for r in score_texts(d.repartition(n), F.col("doc_id") % 4 != 1).collect()} for n in (1, 6)]
    assert runs[0] == pytest.approx(runs[1], abs=1e-9)
    c, total = plain_counts(texts, learn)
    t = lm.tokens_of(*buffers(pa.array(texts)))
    model = lm.train(d.where("doc_id % 4 != 1").select(F.col("text").alias("t")))
    spell = lambda at: model.costs(lm.units_of(t.data, t.first[at], t.size[at]))
    bits = lm.mixed_bits(t, [np.array(x) for x in c], np.array(total), np.array(learn), spell)
    want = -np.bincount(t.text, bits) * np.log10(2)
    assert [runs[0][k] for k, _ in rows] == pytest.approx(list(want), abs=1e-6)


def test_lm_packing():
    import numpy as np

    from popspark.llm import lm

    rng = np.random.default_rng(6)
    for n in (1, 7, 8, 9, 1000):
        for top in (1, 2, 3, 10**12):
            x = rng.integers(0, top, n)
            assert (lm.unfew(b"abc" + lm.few(x), n, 3) == x).all()
            y = x.astype(np.uint64)
            assert (lm.unplaned(lm.planes(y), n)[0] == y).all()


def test_lm_is_a_probability():
    """What the decisions and shares give to all tokens that may come next sums to 1 at most."""
    import numpy as np

    from popspark.llm import lm

    rng = np.random.default_rng(5)
    n, mixer = 400, lm.Mixer()
    h = rng.integers(1, 9, n).astype(np.uint64)
    h[49::50] = lm._END
    t = lm.Tokens(h, np.repeat(np.arange(n // 50), 50), np.zeros(0, np.uint8), np.zeros(n, np.int64), np.ones(n, np.int64))
    c = [rng.integers(0, 3, n) * 2, rng.integers(0, 2, n), rng.integers(0, 2, n)]
    for d in lm.decisions(t, c, np.full(n, 100)):
        mixer.learn(d, np.arange(len(d.at)))
        p = mixer.predict(d, slice(None))[3]
        assert ((p > 0) & (p < 1)).all()


def order2_bits(train, test):
    """Bits a byte of an adaptive order-2 byte model, trained on some texts."""
    import math

    seen, total = Counter(), Counter()

    def walk(text):
        b = b"  " + text.lower().encode() + b"\n"
        return [(b[i - 2 : i], b[i]) for i in range(2, len(b))]

    for t in train:
        for ctx, x in walk(t):
            seen[ctx, x] += 1
            total[ctx] += 1
    cost = n = 0
    for t in test:
        for ctx, x in walk(t):
            cost -= math.log2((seen[ctx, x] + 0.02) / (total[ctx] + 0.02 * 256))
            n += 1
    return cost / n


def test_lm_beats_order_2_and_knows_order(spark):
    """On held-out documents fewer bits a byte than an order-2 model; words in their order cost less than shuffled; a text that was seen least."""
    import random

    rng = random.Random(12)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    held = [(k, t) for k, t in docs if brute.fold(k, 1)]
    train = [t for k, t in docs if not brute.fold(k, 1)]
    known = next(t for t in train if 200 < len(t.split()) < 400)
    mixed = known.split()
    rng.shuffle(mixed)
    more = [(10**6, known), (10**6 + 1, " ".join(mixed))]
    d = spark.createDataFrame(docs + more, "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(d, (F.crc32(F.col("doc_id").cast("string")) % 5 != 1) & (F.col("doc_id") < 10**6)).collect()}
    size = lambda t: len(t.encode()) + 1
    bits = sum(got[k].bits_per_byte * size(t) for k, t in held) / sum(size(t) for _, t in held)
    base = order2_bits(train, [t for _, t in held])
    print("bits a byte:", bits, "order 2:", base)
    assert bits < base
    assert got[10**6].bits_per_byte < 0.2 * got[10**6 + 1].bits_per_byte


def test_lm_long_tokens_cost_their_bytes(spark):
    """Texts of one token of 1 to 20 KB, in hex and without spaces in another script, cost bits by their length."""
    import random

    rng = random.Random(6)
    long = "".join(rng.choice("0123456789abcdef") for _ in range(20_000))
    rows = [(i, " ".join(words(rng, 60))) for i in range(30)] + [(100, long), (101, long[:10_000]), (102, long[:1_000]), (103, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6_000)))]
    got = {r.doc_id: r for r in score_texts(frame(spark, rows), F.col("doc_id") < 30).collect()}
    assert all(got[k].bits_per_byte > 1 for k in (100, 101, 102, 103))
    assert got[100].score < 1.8 * got[101].score < 10 * got[102].score


# 2


def test_jaccard_components(docs, rows):
    assert keyed(jaccard_components(docs).collect()) == keyed(brute.jaccard_components(rows))


def test_jaccard_large_group_and_chain(spark):
    """A chain of near copies, each near the next only, longer than a small group, and texts of all small sizes."""
    import random

    rng = random.Random(3)
    w = words(rng, 400)
    rows = [(i, " ".join(w[6 * i : 6 * i + 100])) for i in range(3 * SMALL_GROUP)]
    rows += [(100 + i, " ".join(words(rng, 1))) for i in range(5)]
    for n in range(5, 40):
        base = words(rng, n)
        for e in range(3):
            edit = list(base)
            if e:
                edit[rng.randrange(n)] = f"edit{e}"
            rows.append((1000 + 10 * n + e, " ".join(edit + words(rng, rng.randrange(2)))))
    d = frame(spark, rows).repartition(5)
    assert keyed(jaccard_components(d).collect()) == keyed(brute.jaccard_components(rows))


def test_jaccard_short_pairs(spark):
    """Pairs of short texts of which no third text bridges: some with a used-up guarantee, their partners without."""
    import random

    rng = random.Random(11)
    rows = []
    for n in range(5, 31):
        for _ in range(12):
            w = [f"{rng.randrange(10**9):x}" for _ in range(n + 2)]
            rows += [(len(rows), " ".join(w[:n])), (len(rows) + 1, " ".join(w[: n + 1 + rng.randrange(2)]))]
    assert keyed(jaccard_components(frame(spark, rows).repartition(5)).collect()) == keyed(brute.jaccard_components(rows))


def test_bands_cover_partners():
    for size in range(1, 3000):
        assert band_start(band_of(size)) <= size < band_start(band_of(size) + 1)
        assert band_of(size * 4 // 3) - band_of(size) <= 1
    for b in range(band_of(2000)):
        assert Band(b).m >= 1


def test_one_of_each(docs, rows):
    got = one_of_each_component(docs)
    want = brute.jaccard_components(rows)
    least = {k for k, _, c in want if k == c and k is not None}
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: 1 for k in least} | {None: 2})
    assert got.columns == docs.columns


def test_one_of_each_tells_rows_apart(spark):
    """Unique texts under a shared or null id stay; one row of each component does."""
    import random

    rng = random.Random(21)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (None, None), (None, None), (7, ""), (7, "")]
    got = [(r.doc_id, r.text) for r in one_of_each_component(frame(spark, rows).repartition(3)).collect()]
    assert keyed(got) == keyed([(1, a), (5, b), (None, c), (None, None), (None, None), (7, ""), (7, "")])


def test_jaccard_null_ids_link(spark):
    """A text that only null ids have joins two others that are too far apart by themselves."""
    import random

    rng = random.Random(22)
    w = words(rng, 130)
    texts = [(3, " ".join(w[:110])), (None, " ".join(w[9:119])), (9, " ".join(w[18:128]))]
    want = brute.jaccard_components(texts)
    assert len({c for *_, c in want}) == 1 and len({c for *_, c in brute.jaccard_components([texts[0], texts[2]])}) == 2
    assert keyed(jaccard_components(frame(spark, texts + [(None, None), texts[1]])).collect()) == keyed(brute.jaccard_components(texts + [(None, None), texts[1]]))


def test_jaccard_family_of_near_misses(spark):
    """A large family around the similarity: some links, many pairs just under it, more members than a small group."""
    import random

    rng = random.Random(24)
    base = words(rng, 70)
    rows = []
    for i in range(12 * SMALL_GROUP):
        w = list(base)
        for j in rng.sample(range(70), rng.randrange(0, 6)):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    want = brute.jaccard_components(rows)
    assert 3 < len({c for *_, c in want}) < len(rows)
    assert keyed(jaccard_components(frame(spark, rows).repartition(5)).collect()) == keyed(want)


def test_components_of_chains_and_stars(spark):
    import random

    from popspark.llm.components import components

    rng = random.Random(23)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(1300)]
    links = [(i, i + 1) for i in range(300)] + [(400, 400 + i) for i in range(1, 500)] + [(900 + i, 900 + rng.randrange(i)) for i in range(1, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame([(names[a], names[b]) for a, b in links], "a long, b long").repartition(7)).collect()}
    want = {x: min(part) for part in (names[:301], names[400:900], names[900:1200]) for x in part}
    assert got == {x: y for x, y in want.items() if x != y}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_jaccard_empty(empty):
    assert jaccard_components(empty).collect() == []


# 3


def labelled(n):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = words(rng, 40) + (["women"] if bad and i % 8 == 0 or i % 9 == 0 else [])
        if bad:
            w[rng.randrange(40)] = rng.choice(["scumbag.", "idiotic", "Vileperson"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled(400)
    d = frame(spark, rows)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score(d.select("doc_id", "text"), model).collect()}
    right = sum((got[k] >= 0.5) == bool(v) for k, v in labels if k >= 300)
    assert right >= 95 and all(0 <= s <= 1 for s in got.values())


def test_swap_penalty_flattens_mentions(spark):
    rows, labels = labelled(400)
    d, y = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = frame(spark, [(1, "the women spoke"), (2, "the men spoke")])

    def gap(penalty):
        s = [r.score for r in toxicity.score(probe, toxicity.fit(d, y, swap_penalty=penalty)).orderBy("doc_id").collect()]
        return abs(s[0] - s[1])

    assert gap(50.0) < gap(0.0) / 4


def test_swap_penalty_spares_neutral_mentions(spark):
    """With the penalty fewer harmless texts fall for naming a group that toxic ones often name."""
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        w = words(rng, 12) + (["muslims"] if rng.random() < (0.9 if bad else 0.05) else []) + (["scumbag"] if bad and rng.random() < 0.7 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, y = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = frame(spark, [(i, " ".join(words(rng, 12) + ["muslims"])) for i in range(60)])

    def flagged(penalty):
        return toxicity.score(neutral, toxicity.fit(d, y, swap_penalty=penalty)).where("score >= 0.5").count()

    assert flagged(5.0) < flagged(0.0) / 2


def test_toxicity_edges(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs.select("doc_id", "text", "score"), model).collect()
    assert len(got) == len(rows) and all(r.score < 0.5 for r in got)
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert all(r.score > 0.5 for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
    assert toxicity.score(empty, model).collect() == []


# 4


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(spark, rows, hot):
    some = rows + [(None, "ab" * 200)]
    got = remove_repeats(frame(spark, some).repartition(3), hot=hot).collect()
    assert keyed(map(tuple, got)) == keyed(brute.remove_repeats(some))


def shared_ids(rng):
    """Texts under one id or none, some of them copies, each beside one that nobody repeats."""
    a, b, c, d, e = ("\n".join(" ".join(words(rng, 9)) for _ in range(8)) for _ in range(5))
    return [(1, a), (5, a), (5, b), (5, b), (5, c), (None, c), (None, d), (None, d), (None, None), (7, e), (9, a + "\n" + b + "\n" + d)]


def test_substrings_shared_ids(spark):
    import random

    rows = shared_ids(random.Random(31))
    got = [tuple(r) for r in remove_repeats(frame(spark, rows).repartition(3)).collect()]
    want = brute.remove_repeats(rows)
    assert keyed(got) == keyed(want) and sum(r[2] == 0 for r in want) >= 7


def test_suffix_ranks():
    import numpy as np

    from popspark.llm.substrings import suffix_ranks

    rng = np.random.default_rng(4)
    for length in (1, 2, 5, 8, 13):
        raw = rng.integers(97, 99, 300).astype(np.uint8)
        strings = [raw[i : i + length].tobytes() for i in range(300 - length + 1)]
        order = sorted(set(strings))
        assert [order.index(x) for x in strings] == suffix_ranks(raw, length).tolist() or length == 1
    assert len(suffix_ranks(np.zeros(3, np.uint8), 5)) == 0


def test_substrings_long_text(spark):
    import random

    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, long[1_048_000:1_049_500]), (2, long), (3, long[:300] + "!" + long[-250:])]
    assert keyed(map(tuple, remove_repeats(frame(spark, rows)).collect())) == keyed(brute.remove_repeats(rows))


def test_substrings_runs_bring_few_rows(spark):
    """A run of one byte has a phrase for each window; its key gets a row or so from each task, and the copies come as runs."""
    from popspark.llm import substrings

    rows = [(i, "a" * 5000) for i in range(40)]
    d = frame(spark, rows).repartition(2)
    parsed = substrings._parse(d.selectExpr("doc_id AS k", "text AS t"), 100, 8)
    sizes = {r.kind: r.n for r in parsed.groupBy("kind").agg(F.sum(F.length("blob")).alias("n")).collect()}
    assert sizes[0] < 2000 and sizes[1] < 40 * 16 * 3
    assert keyed(map(tuple, remove_repeats(d).collect())) == keyed(brute.remove_repeats(rows))


def test_substrings_buckets_are_even(spark):
    """Triggers are least hashes; they fall into all buckets alike all the same."""
    import random

    from popspark.llm import substrings

    rng = random.Random(12)
    d = frame(spark, [(i, "".join(rng.choice("abcdefgh ") for _ in range(4000))) for i in range(100)])
    n = [r.n for r in substrings._parse(d.selectExpr("doc_id AS k", "text AS t"), 100, 16).groupBy("bucket").agg(F.sum(F.length("blob")).alias("n")).collect()]
    assert len(n) == 16 and max(n) < 2 * min(n)


def test_substrings_dictionary_in_parts(monkeypatch):
    """Parts hold whole triggers and are no larger than their bound, but for one trigger."""
    import numpy as np

    from popspark.llm import substrings

    monkeypatch.setattr(substrings, "_PART", 1000)
    key, size = np.array([3, 1, 3, 2, 9, 9, 1, 5], np.uint64), np.array([400, 300, 400, 300, 700, 700, 100, 1])
    parts = list(substrings._whole_keys(key, size))
    assert sorted(np.concatenate(parts).tolist()) == list(range(8))
    assert [sorted(set(key[p].tolist())) for p in parts] == [[1, 2], [3, 5], [9]]


def test_substrings_kept_text_and_repeats(spark, empty):
    d = frame(spark, [(1, "x" * 150), (1, "x" * 150), (2, None)])
    got = remove_repeats(d, with_text=True).collect()
    assert [bytes(r.kept) for r in got if r.doc_id == 1] == [b"x" * 0 + b"x"] * 2 or all(r.n_removed > 0 for r in got if r.doc_id == 1)
    assert remove_repeats(empty).collect() == []


# 5


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy</div>{main}
<form><input value=q>Find</form><div id="comments"><p>first!</p></div><footer>&copy; site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", "z") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, k int, u string, host string, low string")


def test_main_text(spark):
    got = html.main_text(pages(spark, [
        ("http://a.b/1", PAGE.format(main="<article><h1>Head</h1><p>One &amp; two<br>three <b>four</b><p>Five <script>var x='</p>'</script>six<aside>no</aside></article>")),
        ("http://a.b/2", PAGE.format(main="<p>plain\n  text</p><ul><li>a<li>b</ul>")),
        (None, None), ("", ""), ("x", "no tags at all"), ("x", "<p>unclosed <b>bold"), ("x", "<!-- only a comment"),
    ])).orderBy("page_id").collect()
    assert [r.text for r in got] == ["Head\n\nOne & two three four\n\nFive six", "plain text\n\na\n\nb", "", "", "no tags at all", "unclosed bold", ""]
    assert all(r.n_chars == len(r.text) for r in got)


def test_repeated_branches_go(spark):
    rows = [("http://a.b/%d" % i, f'<body><div class="top">Same on every page</div><div class="body"><p>Text number {i} of its own</p></div></body>') for i in range(20)]
    rows.append(("http://c.d/1", rows[0][1]))
    got = html.main_text(pages(spark, rows)).orderBy("page_id").collect()
    assert [r.text for r in got[:20]] == [f"Text number {i} of its own" for i in range(20)]
    assert got[20].text == "Same on every page\n\nText number 0 of its own"


def test_repeated_branches_go_inside_article(spark):
    """Repeated parts of the article go with all below them; what differs stays, as does a host's only text."""
    page = '<body><article><div class="pitch"><div>Our app<p>Get it now</p></div></div><h1>Title {i}</h1><p>Text {i}</p>{more}</article></body>'
    rows = [("http://a.b/%d" % i, page.format(i=i, more="<ul><li>a</ul>" if i % 2 else "")) for i in range(20)]
    rows += [("http://c.d/", page.format(i=1, more=""))] * 20
    got = [r.text for r in html.main_text(pages(spark, rows)).orderBy("page_id").collect()]
    assert [t.split("\n\n")[:2] for t in got[:20]] == [[f"Title {i}", f"Text {i}"] for i in range(20)]
    assert set(got[20:]) == {"Our app\n\nGet it now\n\nTitle 1\n\nText 1"}


def test_composite_importance():
    tree = {" >": (0.0, 10, 1), "/div >": (0.0, 10, 1), "/div/p": (0.1, 10, 2), "/div/b": (0.9, 10, 9), "/ul >": (0.0, 10, 1), "/ul/li": (0.0, 10, 1), "/ol >": (0.9, 10, 9), "/ol/li": (0.0, 10, 1)}
    assert html.noisy(tree, 0.2) == ["/div/p >", "/ol/li >", "/ul >"]


def test_roles_are_names(spark):
    """Words in other attributes' values are no names, and parts of names are no roles inside an article."""
    got = html.main_text(pages(spark, [
        ("http://a.b/1", PAGE.format(main='<article style="overflow: hidden" class="post"><div class="post-header"><h1>Head</h1></div><p title="a hidden gem">One <a class="search-term">two</a> three</p><section id="related-work">Four</section><div class="share-buttons">no</div><div id="comments">no</div><p hidden>no</p><p aria-hidden="true">no</p><p class=hidden>no</p></article>')),
        ("http://a.b/2", PAGE.format(main="<div style='overflow: hidden' data-x=\"class='ad'\"><p class='overflow-hidden'>plain</p><p class='ad-box'>no</p></div>")),
    ])).orderBy("page_id").collect()
    assert [r.text for r in got] == ["Head\n\nOne two three\n\nFour", "plain"]


def test_names_of_comments_notices_and_article_parts(spark):
    """Reader comments and notices inside an article go; unmarked parts whose names only begin alike stay."""
    gone = ["comment", "comment-list", "user-comments", "post-comment", "replies", "notice", "cookie-notice", "banner"]
    kept = ["search-results", "side-effects", "post-header", "tags-explained", "related-work", "share-of-votes"]
    rows = [("http://a.b/%d" % i, f"<body><article><p>Story {i}</p><div class='{c}'><p>not that</p></div></article></body>") for i, c in enumerate(gone)]
    rows += [("http://c.d/%d" % i, f"<body><div class='{c}'><p>Story {i}</p></div><div class='search-box'>no</div><div id='tags'>no</div><div class='site-header'>no</div><div class='social-share'>no</div><div class='skip-to-content'>no</div></body>") for i, c in enumerate(kept)]
    got = [r.text for r in html.main_text(pages(spark, rows)).orderBy("page_id").collect()]
    assert got == [f"Story {i}" for i in range(len(gone))] + [f"Story {i}" for i in range(len(kept))]


def test_pages_empty(spark):
    assert html.main_text(pages(spark, [])).collect() == []


# 6


def test_quality_counts(docs, rows):
    got = quality_rules(docs).collect()
    want = []
    for k, t in rows:
        c = brute.quality_counts(t)
        want.append((k, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert keyed(tuple(r)[:7] for r in got) == keyed(want)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_outlier_falls(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 80))) for i in range(300)] + [(999, " ".join(x + "###$$$" for x in words(rng, 80)))]
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()}
    assert not got[999] and sum(got.values()) == 300


@pytest.mark.parametrize("every", [20, 10])
def test_quality_common_junk_falls(spark, every):
    """Symbol junk in 5 and 10 percent of every language and source, more than the outer quantiles stand."""
    import random

    rng = random.Random(14)
    junk = lambda i: (i // 12) % every == 0
    rows = [(i, " ".join(x + "%%%&&***"[: 3 + j % 5] if junk(i) else x for j, x in enumerate(words(rng, 80)))) for i in range(2400)]
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()}
    assert got == {i: not junk(i) for i, _ in rows}


def test_quality_long_text_and_reruns(spark, docs):
    """Many distinct words repeat nothing, however few bits are left beside a place; verdicts do not hang on the partitions."""
    n = 300_000
    text = " ".join(f"{i:x}" for i in range(n))
    got = quality_rules(frame(spark, [(1, text), (2, text + " 1 2 3")])).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {1: 0, 2: 6}
    runs = [keyed(map(tuple, quality_rules(docs.repartition(p), min_group=2).collect())) for p in (1, 5, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_quality_fences(spark):
    """Quartiles of the sketches against plain ones, to one part in 64."""
    import random

    from popspark.llm.quality import UNIT, quartiles, sketches

    rng = random.Random(15)
    rows = [(i % 3, i % 2, 1, *(int(UNIT * rng.expovariate(1) ** 3) for _ in range(4))) for i in range(900)]
    d = spark.createDataFrame(rows, "lang int, source int, n_words int, symbol_share long, dup_line_share long, repeat_share long, mean_word long")
    got = {(r.lang, r.measure): (r.n, r.low, r.high) for r in quartiles(sketches(d), "lang").collect()}
    for lang in range(3):
        v = sorted(r[3] for r in rows if r[0] == lang)
        n, low, high = got[lang, "symbol_share"]
        assert n == 300 and low <= v[74] < low * 65 / 64 + 1 and high <= v[224] < high * 65 / 64 + 1


def test_quality_empty(empty):
    assert quality_rules(empty).collect() == []


# 7


def test_mixing(docs, rows):
    got = mix_sources(docs).collect()
    sizes, source = defaultdict(int), {}
    for k, t in rows:
        s = None if k is None else f"s{k % 4}"
        sizes[s] += len(brute.WORD.findall(t or ""))
    goal = brute.targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal) and len(got) == len(rows)
    again = mix_sources(docs.repartition(7)).collect()
    assert keyed(map(tuple, got)) == keyed(map(tuple, again))


def sizes_of(docs):
    return [len(brute.WORD.findall(r.text or "")) for r in docs.collect()]


def test_mix_cut_decides(spark, monkeypatch):
    """Without the cut every document is taken whole and twice; with it a source comes within a word of its target."""
    from popspark.llm import mixing

    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40 if i % 50 else 900)), f"s{i % 3}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mix_sources(d).collect()
    per, goal = defaultdict(int), {r.source: r.target for r in got}
    for r in got:
        per[r.source] += r.taken
    assert all(abs(per[s] - goal[s]) <= 1.5 for s in goal) and sum(per.values()) == int(1.5 * sum(len(t.split()) for _, t, _ in rows))
    assert any(r.taken == 0 for r in got) and any(0 < r.taken < r.size for r in got) and any(r.taken == 2 * r.size for r in got)
    plain = mixing.taken_words
    monkeypatch.setattr(mixing, "taken_words", lambda q, b, cap, n: plain(q, b.withColumn("budget", F.lit(1 << 40)), cap, n))
    assert all(r.taken == 2 * r.size for r in mix_sources(d).collect())


def test_mix_order(docs):
    """Places in the mix are the running sums of the words taken by finish time, up to the budget."""
    got = [r for r in mix_sources(docs, buckets=7).collect() if r.taken]
    upto = 0
    assert [r.finish_time for r in sorted(got, key=lambda r: r.mix_start)] == sorted(r.finish_time for r in got)
    assert [(r.doc_id, r.mix_start, r.taken) for r in sorted(got, key=repr)] == [(r.doc_id, r.mix_start, r.taken) for r in sorted((r for r in mix_sources(docs).collect() if r.taken), key=repr)]
    entry = lambda r: [(p * r.source_size + r.finish_time * r.target, r) for p in (0, 1)]
    words = [(e - r.size + j + 1 if e - r.size < r.target < e - 1e-6 else e, r) for x in got for e, r in entry(x) for j in range(r.size)]
    for r in got:
        first = min((e - r.size + 1 if e - r.size < r.target < e - 1e-6 else e) / r.target for e, _ in entry(r))
        assert r.mix_start <= sum(1 for e, o in words if e / o.target <= first + 1e-9)
        upto += r.taken
    assert abs(upto - int(1.5 * sum(sizes_of(docs)))) <= 0


def test_targets_capped(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in source_targets(d).collect()}
    want = brute.targets({"a": 10, "b": 1000, None: 5, "c": 0})
    assert got == pytest.approx(want)


def test_mixing_empty(empty):
    assert mix_sources(empty).collect() == []


# 8


def test_contained_items(spark, docs, rows):
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(brute.low_words(texts[10])[20:60])), (2, "one two three four"), (3, None), (4, "never seen words in any text here"), (1, " ".join(brute.low_words(texts[5])[3:40]).upper()), (5, "")]
    bench = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, k int")
    long = " ".join(words(__import__("random").Random(41), 300))
    rows = rows + [(900, long)]
    docs = docs.unionByName(frame(spark, [(900, long)]))
    items += [(6, " ".join(brute.low_words(long)[100:104])), (7, " ".join(brute.low_words(long)[100:106])), (8, brute.low_words(long)[7])]
    bench = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, k int")
    assert {(900, 6), (900, 7), (900, 8)} <= {x[:2] for x in brute.contained(rows, items)}
    for block in (2_000_000, 30):
        got = decontamination.contained_items(docs, bench, block_words=block).collect()
        assert keyed(tuple(r)[:4] for r in got) == keyed(brute.contained(rows, items))
    hit = {k for k, *_ in brute.contained(rows, items)}
    for block in (2_000_000, 30):
        clean = decontamination.decontaminate(docs, bench, block_words=block)
        assert Counter(r.doc_id for r in clean.collect()) == Counter(k for k, _ in rows if k not in hit or k is None) and clean.columns == docs.columns


def test_contained_items_by_joins(spark):
    """Beyond a block: items near the threshold, a phrase of all items, repeated items and copies of texts; nothing but joins by key."""
    rng = __import__("random").Random(8)
    phrase = words(rng, 9)
    texts, items = [], [(100, "word"), (101, "two words"), (102, None), (103, " ")]
    for n in range(40):
        item = phrase + words(rng, rng.choice([3, 20, 60, 300]))
        items.append((n, " ".join(item)))
        keep = rng.choice([0.4, 0.7, 0.75, 0.8, 1.0])
        part = item[: max(1, int(keep * len(item)))]
        texts.append((n, " ".join(words(rng, 50) + part + words(rng, rng.choice([0, 2000])))))
    items += [(200, items[10][1]), (10, items[10][1])]
    texts += [(300, texts[3][1]), (3, texts[3][1]), (None, texts[5][1]), (301, " ".join(t for _, t in items[4:])), (302, "Two WORDS and a word"), (303, None), (304, "")]
    docs = frame(spark, texts).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = keyed(brute.contained(texts, items))
    small, joined = (decontamination.contained_items(docs, bench, **how) for how in ({}, {"block_bytes": 100}))
    assert keyed(tuple(r)[:4] for r in small.collect()) == want == keyed(tuple(r)[:4] for r in joined.collect())
    assert small.dtypes == joined.dtypes
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_decontaminate_by_joins_edges(spark, docs, empty):
    some = spark.createDataFrame([(1, "a b c d e f"), (2, "g h")], "item_id long, text string")
    assert decontamination.decontaminate(empty, some, block_words=1).collect() == []
    assert decontamination.contained_items(empty, some, block_words=1).collect() == []
    odd = spark.createDataFrame([(1, "x a b c d e f", 7, 8), (2, None, 7, 8), (3, "g i h", 7, None)], "doc_id long, text string, __0 int, `a.b` int")
    kept = decontamination.decontaminate(odd, some, block_words=1)
    assert kept.columns == odd.columns and sorted(tuple(r) for r in kept.collect()) == [(2, None, 7, 8), (3, "g i h", 7, None)]


def test_containment_edges(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(docs, bench).collect() == []
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contained_items(empty, some).collect() == []


# 9


@pytest.mark.parametrize("least", [50, 14, 3])
def test_lines(spark, rows, least):
    got = dedup_lines(frame(spark, rows).repartition(3), min_words=least)
    assert keyed((r.doc_id, r.text) for r in got.collect()) == keyed(brute.dedup_lines(rows, least))
    assert set(got.columns) >= {"n_lines", "n_removed", "label"}


def test_lines_shared_ids(spark):
    import random

    rows = shared_ids(random.Random(32))
    got = [(r.doc_id, r.text) for r in dedup_lines(frame(spark, rows).repartition(3), min_words=20).collect()]
    assert keyed(got) == keyed(brute.dedup_lines(rows, 20))


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_few_kinds(spark, seed):
    """Many repeats of all lengths, overlapping and inside one text."""
    import random

    rng = random.Random(seed)
    kinds = [" ".join(words(rng, rng.randrange(1, 4))) for _ in range(4)]
    rows = [(i % 25, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 30)))) for i in range(30)]
    got = [(r.doc_id, r.text) for r in dedup_lines(frame(spark, rows).repartition(3), min_words=5 + 8 * seed).collect()]
    assert keyed(got) == keyed(brute.dedup_lines(rows, 5 + 8 * seed))


def test_lines_edges(spark, empty):
    d = frame(spark, [(1, "a b\na b\na b"), (1, "a b\na b\na b"), (2, None), (3, "")]).withColumn("n_lines", F.lit("old"))
    got = {(r.doc_id, r.text, r.n_removed) for r in dedup_lines(d, min_words=2).collect()}
    assert got == {(1, "a b", 2), (2, None, 0), (3, "", 0)}
    assert dedup_lines(empty).collect() == []


# 10


@pytest.fixture(scope="module")
def spec():
    public = pytest.importorskip("public_tokenizers")
    return Path(public.path("byte_bpe_50k.json")).read_text()


def test_tokens(spark, docs, rows, spec, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    more = [(500, "a<|endoftext|>b <|endoftext|>"), (501, "你好 ٣٤ \U0001f600 don't  we’ll\r\n\t x՘y \x1c\x85z"), (502, "  lead   and trail  \n\n"), (503, "w" * 3000)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = token_counts(d, spec, limit=50).collect()
    want = []
    for k, x in [*rows, *more]:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((k, len((x or "").encode()), n, n > 50))
    assert keyed(map(tuple, got)) == keyed(want)
    assert keyed(map(tuple, token_counts(d, spec, limit=50, table_size=3, cache_size=5, batch_bytes=100).collect())) == keyed(want)
    assert token_counts(empty, spec).collect() == []


def test_token_sample_is_bounded(spark, spec):
    """Null and repeated ids, and repeated rows, do not make the sample larger."""
    from popspark.llm import tokens

    rows = [(None, f"word{i} text") for i in range(3000)] + [(7, "same row")] * 3000 + [(i, f"other{i}") for i in range(50)]
    d = spark.createDataFrame(rows, "k long, t string")
    assert len(tokens.frequent_pretokens(d, spec, "k", "t", 100, 10_000)) <= 2 * 100


def test_lines_replace_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 41, 42)], "doc_id long, text string, N_Lines int, n_removed int")
    assert dedup_lines(d).columns == ["doc_id", "text", "n_lines", "n_removed"]
