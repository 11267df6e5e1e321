"""Plain versions of the operators, over lists of (id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low_words(text):
    return WORD.findall((text or "").translate(_LOW))


def shingle_set(text, width=5):
    w = low_words(text)
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(rows):
    """(id, size, component) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [(k, len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def contained(rows, items):
    out = []
    for k, t in rows:
        for i, x in items:
            width = min(5, len(low_words(x)))
            s = shingle_set(x, width)
            n = len(s & shingle_set(t, width)) if len(low_words(t)) >= width > 0 else 0
            if s and 100 * n >= 75 * len(s):
                out.append((k, i, n, len(s)))
    return out


def text_hash(t):
    """Spark's xxhash64 of a text."""
    n = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def in_order(rows):
    """Distinct rows by id, null first, then by the text's hash."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))


def remove_repeats(rows, length=100):
    """(id, bytes, removed, spans, sha256) of each row; rows alike are one text."""
    seen, out = set(), {}
    for k, t in in_order(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k, t] = (k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[r] for r in rows]


def dedup_lines(rows, min_words=50):
    """(id, text) of each row: every run of lines of min_words words that also runs earlier goes; rows alike are one text."""
    order = in_order(rows)
    seqs = {}
    for r in order:
        lines = (r[1] or "").split("\n")
        seqs[r] = [(i, x, len(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)]
    first, runs = set(), []
    for r in order:
        s = seqs[r]
        for i in range(len(s)):
            n = 0
            for j in range(i, len(s)):
                n += s[j][2]
                if n >= min_words:
                    key = tuple(x[1] for x in s[i : j + 1])
                    if key in first:
                        runs.append((r, i, j))
                    else:
                        first.add(key)
    gone = defaultdict(set)
    for r, i, j in runs:
        gone[r].update(s[0] for s in seqs[r][i : j + 1])
    return [(k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t])) for k, t in rows]


def quality_counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """{source: target} by dealing again until nobody is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = set(names), share * sum(sizes.values()), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        s = min(full, key=lambda s: cap * sizes[s] / w[s])
        out[s] = cap * sizes[s]
        left -= out[s]
        open_.remove(s)
    return out


def base_scores(rows, trained):
    c = Counter()
    toks = [low_words(t) + ["\n"] for _, t in rows]
    for (k, _), w in zip(rows, toks):
        if trained(k):
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for w in toks]


def fold(k, rest):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == rest


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label_error) and the codebooks by plain Lloyd rounds; rows are (id, vector, label)."""
    kept = [(k, [math.floor(float(v) * scale) for v in x], y, x) for k, x, y in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    usable = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    dim = len(usable[0][1]) if usable else 0
    fit, w = [r for r in usable if len(r[1]) == dim], dim // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in fit[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        got = [[near(r[1], p) for p in range(parts)] for r in fit]
        for p in range(parts):
            for e in range(len(books[p])):
                of = [cut(r[1], p) for r, at in zip(fit, got) if at[p] == e]
                if of:
                    books[p][e] = [sum(c) // len(of) for c in zip(*of)]
    out = []
    for k, x, y, _ in kept:
        if dim and len(x) == dim:
            at = [near(x, p) for p in range(parts)]
            out.append((k, "".join(f"{e:02x}" for e in at), sum(far(cut(x, p), books[p][e]) for p, e in enumerate(at)), y))
        else:
            out.append((k, None, None, y))
    per = defaultdict(int)
    for _, _, d, y in out:
        per[y] += d or 0
    seen = {y for _, _, d, y in out if d is not None}
    return [(k, c, d, per[y] if y in seen else None) for k, c, d, y in out], hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def audit(rows, labels):
    """All orders applied one by one; rows are (id, text, source), labels (id, quality, toxic)."""
    from itertools import permutations

    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good, toxic = ({k for k, *y in labels if k is not None and y[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for k, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and least[t] < k}
        parts[s or ""].append((k, {f for f in fails if fails[f]}))
    out = []
    for part, docs in parts.items():
        total, mine = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                lost = [k for k, x in left if f in x]
                left = [(k, x) for k, x in left if f not in x]
                every = sum(f in x for _, x in docs)
                total[f] += len(lost)
                mine.append((f, [part, "".join(order), step, len(left), len(lost), every - len(lost), sum(x == {f} for _, x in docs), sum(k in good for k in lost), sum(k in toxic for k in lost)]))
        out += [(*r, total[f]) for f, r in mine]
    return out


def pii_matches(t):
    """kind: [(start, end, text, valid)] of the leftmost matches of the plain patterns; card runs of other lengths are no matches."""
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits(x))))) % 10 == 0

    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True, lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: True, lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19, luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: True, lambda x: 10 <= len(digits(x)) <= 15),
    }
    return {k: [(m.start(), m.end(), m.group(), ok(m.group())) for m in re.finditer(p, t) if counts(m.group())] for k, (p, counts, ok) in plain.items()}


def personal_data(rows, disclosure=0.75, support=3):
    """(id, counts by kind, digest of the base spans, all spans) of (id, text) rows."""
    import regex

    term = regex.compile(r"\p{L}{3,}")
    found = []  # per row: (start, kind, end, entity, before, after) with terms as (t, s, e)
    for _, t in rows:
        t, mine = t or "", []
        for k, ms in pii_matches(t).items():
            edges = [0, *[m[1] for m in ms]], [*[m[0] for m in ms], len(t)]
            for i, (s, e, v, ok) in enumerate(ms):
                if not ok:
                    continue
                lo, hi = max(edges[0][i], s - 80), min(edges[1][i + 1], e + 80)
                before = [(m.group().lower(), m.start() + lo, m.end() + lo) for m in term.finditer(t[lo:s]) if lo == edges[0][i] or m.start() > 0][-5:]
                after = [(m.group().lower(), m.start() + e, m.end() + e) for m in term.finditer(t[e:hi]) if hi == edges[1][i + 1] or m.end() < 80][:5]
                entity = v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)
                mine.append((s, list(plain_kinds).index(k), e, f"{k}:{entity}", before, after))
        found.append(sorted(mine))
    cls = lambda w: w[:3] + "*"
    n, n_c, n_t, n_ct, sides = len(rows), Counter(), Counter(), Counter(), (defaultdict(set), defaultdict(set))
    for (_, t), mine in zip(rows, found):
        w = {m.group().lower() for m in term.finditer(t or "")}
        n_t.update(w | {cls(x) for x in w})
        n_c.update({c for _, _, _, c, _, _ in mine})
        pairs = {(c, x) for _, _, _, c, a, b in mine for y, _, _ in a + b for x in (y, cls(y))}
        n_ct.update(pairs)
        for _, _, _, c, a, b in mine:
            for y, _, _ in a + b:
                for x in (y, cls(y)):
                    sides[0][c, x].add(tuple(z[0] for z in a))
                    sides[1][c, x].add(tuple(z[0] for z in b))
    shows = {p for p in n_ct if min(n_c[p[0]], n_ct[p], len(sides[0][p]), len(sides[1][p])) >= support and n_c[p[0]] < n and math.log2(n * n_ct[p] / n_c[p[0]] / n_t[p[1]]) >= disclosure * math.log2(n / n_c[p[0]]) - 1e-9}
    out = []
    for (key, t), mine in zip(rows, found):
        base = [(s, k, e) for s, k, e, *_ in mine]
        more = {}
        for _, _, _, c, a, b in mine:
            for y, s, e in a + b:
                if (c, y) in shows:
                    more[s, e] = max(more.get((s, e), 4), 5 if (c, cls(y)) in shows else 4)
        spans = sorted(base + [(s, k, e) for (s, e), k in more.items()])
        text = lambda xs: ",".join(f"{(*plain_kinds, 'general', 'term')[k]}:{s}:{e}" for s, k, e in xs)
        out.append((key, *[sum(k == i for _, k, _ in base) for i in range(4)], hashlib.sha256(text(base).encode()).hexdigest(), text(spans)))
    return out


plain_kinds = ("email", "ip", "card", "phone")
