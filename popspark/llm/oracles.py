"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _sets(name: str, key: str, table: str) -> str:
    """A table (id, s) of each text's distinct shingles of five words, or of its whole short sequence."""
    return f"""{name} AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {key} AS id, {_WORDS} AS w FROM {table})))"""


OP2 = "WITH RECURSIVE " + _sets("d","doc_id","documents") + """,
n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.id = x JOIN n v ON v.id = y WHERE 100 * k >= 75 * (u.n + v.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM e) UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = doc_id"""

OP8 = f"""WITH b AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT id, k, s FROM (SELECT id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT DISTINCT id, k, s FROM (SELECT doc_id AS id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
n AS (SELECT id, count(*) AS n FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item, count(*) / any_value(n.n) AS containment FROM d JOIN i USING (k, s) JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 4 * count(*) >= 3 * any_value(n.n)"""

OP7 = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS o FROM documents),
s AS (SELECT source, sum(size) AS source_size, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
q AS (SELECT *, 2.0 * source_size AS top, 2.0 * source_size / w AS ratio FROM s),
v AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(coalesce(least(top, w * (SELECT arg_min(level, ratio) FROM v WHERE level < ratio)), top) AS DOUBLE) AS target FROM v),
c AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT c.*, p, p * source_size + run - size AS begin FROM c, (SELECT unnest([0, 1]) AS p) WHERE size > 0 AND target > 0),
i AS (SELECT *, 0 AS j, size AS w, (begin + size) / target AS f FROM e WHERE NOT (begin < target AND begin + size > target)
  UNION ALL SELECT *, 1 AS w, (begin + j) / target AS f FROM (SELECT *, unnest(range(1, size + 1)) AS j FROM e WHERE begin < target AND begin + size > target)),
g AS (SELECT *, sum(w) OVER (ORDER BY f, source NULLS FIRST, o, doc_id, size, p, j ROWS UNBOUNDED PRECEDING) - w AS place FROM i),
b AS (SELECT *, least(w, (SELECT floor(1.5 * sum(size)) FROM d) - place) AS got FROM g),
y AS (SELECT source, run, CAST(sum(got) AS BIGINT) AS taken, CAST(min(place) AS BIGINT) AS mix_start FROM b WHERE got > 0 GROUP BY ALL)
SELECT doc_id, c.source, size, source_size, round(target, 6) AS target, CASE WHEN size > 0 THEN coalesce(y.taken, 0) ELSE 0 END AS taken, round(CASE WHEN target > 0 THEN c.run / target END, 9) AS finish_time, CASE WHEN size > 0 THEN y.mix_start END AS mix_start
FROM c LEFT JOIN y ON c.source IS NOT DISTINCT FROM y.source AND c.run = y.run"""

_BIN = "(v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0)"

OP6 = r"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))) WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_symbols * 1000000 // greatest(n_words, 1) AS symbol_share, n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_line_share, n_repeat_words * 1000000 // greatest(n_words, 1) AS repeat_share, word_chars * 1000000 // greatest(n_words, 1) AS mean_word FROM c),
u AS (SELECT lang, source, measure, BIN AS bin FROM (SELECT lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'mean_word']) AS measure, unnest([symbol_share, dup_line_share, repeat_share, mean_word]) AS v FROM m WHERE n_words > 0)),
g AS (SELECT 1 AS level, lang, source, measure, bin FROM u UNION ALL SELECT 2, lang, NULL, measure, bin FROM u UNION ALL SELECT 3, NULL, NULL, measure, bin FROM u),
s AS (SELECT level, lang, source, measure, bin, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS every FROM s),
q AS (SELECT level, lang, source, measure, max(every) AS n, min(bin) FILTER (4 * upto >= every) AS low, min(bin) FILTER (4 * upto >= 3 * every) AS high FROM k GROUP BY ALL),
f AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.n >= 100 THEN a.low WHEN b.n >= 100 THEN b.low ELSE c.low END AS low, CASE WHEN a.n >= 100 THEN a.high WHEN b.n >= 100 THEN b.high ELSE c.high END AS high
  FROM q a JOIN q b ON b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN q c ON c.level = 3 AND a.measure = c.measure WHERE a.level = 1),
e AS (SELECT lang, source, max(high + greatest(3 * (high - low), 100000)) FILTER (measure = 'symbol_share') AS symbols, least(max(high + greatest(3 * (high - low), 300000)) FILTER (measure = 'dup_line_share'), 1000000) AS lines,
  least(max(high + greatest(3 * (high - low), 250000)) FILTER (measure = 'repeat_share'), 1000000) AS repeats, max(high + greatest(3 * (high - low), 4000000)) FILTER (measure = 'mean_word') AS long, max(low - greatest(3 * (high - low), 2000000)) FILTER (measure = 'mean_word') AS short FROM f GROUP BY ALL)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(symbol_share <= symbols, true) AND coalesce(dup_line_share <= lines, true) AND coalesce(repeat_share <= repeats, true) AND coalesce(mean_word <= long, true) AND coalesce(mean_word >= short, true) AS kept
FROM m LEFT JOIN e ON m.lang IS NOT DISTINCT FROM e.lang AND m.source IS NOT DISTINCT FROM e.source""".replace("BIN AS bin", _BIN + " AS bin")

OP9 = r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT doc_id, i, a[i] AS line, len(regexp_extract_all(a[i], '[^\x20\x09-\x0D]+')) AS w FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM x WHERE w > 0),
b AS (SELECT *, upto - w AS before FROM p),
g AS (SELECT doc_id, list(line ORDER BY pos) AS lines FROM b GROUP BY doc_id),
r AS (SELECT s.doc_id, s.pos AS a, e.pos AS z FROM b s JOIN b e ON s.doc_id = e.doc_id AND e.before < s.before + 50 AND e.upto >= s.before + 50
  UNION SELECT s.doc_id, s.pos, e.pos FROM b e JOIN b s ON s.doc_id = e.doc_id AND s.before <= e.upto - 50 AND s.upto > e.upto - 50),
n AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY array_to_string(lines[a:z], chr(10)) ORDER BY doc_id, a) AS copy FROM r JOIN g USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(a, z + 1)) AS pos FROM n WHERE copy > 1) JOIN p USING (doc_id, pos)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS m FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN m > 0 THEN coalesce(t, '') ELSE text END AS text, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_removed FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

def _codes(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds, one CTE for each assignment and each codebook."""
    near = lambda c: f"SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {c} c USING (p, j) GROUP BY ALL) GROUP BY ALL"
    ctes = [
        "k AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i - 1) // {width} AS p, (i - 1) % {width} AS j, CAST(floor(CAST(embedding[i] AS DOUBLE) * 4096) AS BIGINT) AS v FROM (SELECT r, embedding, unnest(range(1, {parts * width + 1})) AS i FROM k))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, v FROM x WHERE r <= {entries})",
    ]
    for n in range(rounds):
        ctes.append(f"a{n} AS MATERIALIZED ({near(f'c{n}')})")
        ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, c.j, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT p, e, j, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN a{n} USING (r, p) GROUP BY ALL) m USING (p, e, j))")
    ctes.append(f"z AS ({near(f'c{rounds}')})")
    ctes.append("o AS (SELECT r, string_agg(lpad(format('{:x}', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY r)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256 FROM k JOIN o USING (r)"


OP11 = _codes()

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true", "lower(v)"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "true", "len(list_filter(string_split(v, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST('0' || right(ltrim(y, '0'), 3) AS INT) > 255)) = 0", "v"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19", f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INT), 1) AS INT) ELSE 2 * CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INT), 1) AS INT) - CASE WHEN CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0", _DIGITS),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "true", f"length({_DIGITS}) BETWEEN 10 AND 15", _DIGITS),
}


def _personal() -> str:
    """Values by the plain patterns, places by what lies between the matches; counts, shares and spans of the terms."""
    ctes = ["t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents)"]
    for k, (name, (pattern, counts, ok, entity)) in enumerate(_PII.items()):
        ctes.append(f"m{k} AS (SELECT r, x, i, m[i] AS v, g[i] AS gap FROM (SELECT r, x, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, x, regexp_extract_all(x, '{pattern}') AS m, string_split_regex(x, '{pattern}') AS g FROM t)))")
        ctes.append(f"p{k} AS (SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i) AS e FROM m{k})")
        ctes.append(f"c{k} AS (SELECT r, x, v, e - length(v) AS s, e, coalesce(lag(e) OVER w, 0) AS pe, coalesce(lead(e - length(v)) OVER w, length(x)) AS ns FROM p{k} WHERE {counts} WINDOW w AS (PARTITION BY r ORDER BY i))")
        ctes.append(f"v{k} AS (SELECT r, x, {k} AS k, '{name}:' || {entity} AS c, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(pe AS BIGINT) AS pe, CAST(ns AS BIGINT) AS ns FROM c{k} WHERE {ok})")
    ctes.append("f AS MATERIALIZED (SELECT *, row_number() OVER () AS id, substr(x, greatest(pe, s - 80) + 1, s - greatest(pe, s - 80)) AS a, substr(x, e + 1, least(ns, e + 80) - e) AS b FROM (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(4)) + "))")
    for side, origin, cut, near in (("a", "greatest(pe, s - 80)", "s - pe > 80 AND ts = 0", "DESC"), ("b", "e", "ns - e > 80 AND te = 80", "ASC")):
        ctes.append(rf"w{side} AS (SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY id ORDER BY i) AS te FROM (SELECT * EXCLUDE (m, g), m[i] AS v, g[i] AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, r, c, s, e, pe, ns, regexp_extract_all({side}, '\p{{L}}{{3,}}') AS m, string_split_regex({side}, '\p{{L}}{{3,}}') AS g FROM f))))")
        ctes.append(f"x{side} AS (SELECT id, r, c, lower(v) AS t, {origin} + ts AS ws, {origin} + te AS we, i FROM (SELECT *, te - length(v) AS ts FROM w{side}) WHERE NOT ({cut}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i {near}) <= 5)")
        ctes.append(f"d{side} AS (SELECT id, string_agg(t, ' ' ORDER BY i) AS d FROM x{side} GROUP BY id)")
    ctes += [
        "q AS MATERIALIZED (SELECT y.*, coalesce(da.d, '') AS da, coalesce(db.d, '') AS db FROM (SELECT * FROM xa UNION ALL SELECT * FROM xb) y LEFT JOIN da USING (id) LEFT JOIN db USING (id))",
        "z AS (SELECT r, c, unnest([t, left(t, 3) || '*']) AS t, da, db FROM q)",
        "nc AS (SELECT c, count(DISTINCT r) AS n_c FROM f GROUP BY c)",
        "pr AS MATERIALIZED (SELECT c, t, count(DISTINCT r) AS n_ct FROM z GROUP BY ALL HAVING count(DISTINCT r) >= 3 AND count(DISTINCT da) >= 3 AND count(DISTINCT db) >= 3)",
        r"tw AS (SELECT r, unnest(list_distinct(list_transform(regexp_extract_all(x, '\p{L}{3,}'), lambda y: lower(y)))) AS t FROM t)",
        "nt AS (SELECT t, count(*) AS n_t FROM (SELECT DISTINCT r, t FROM (SELECT r, t FROM tw UNION ALL SELECT r, left(t, 3) || '*' FROM tw)) WHERE t IN (SELECT t FROM pr) GROUP BY t)",
        "sh AS MATERIALIZED (SELECT c, t FROM pr JOIN nc USING (c) JOIN nt USING (t), (SELECT count(*) AS n FROM t) WHERE n_c >= 3 AND n > n_c AND log2(n * n_ct / n_c / n_t) >= 0.75 * log2(n / n_c) - 1e-9)",
        "mo AS (SELECT r, CAST(ws AS BIGINT) AS s, max(CASE WHEN (c, left(t, 3) || '*') IN (SELECT c, t FROM sh) THEN 5 ELSE 4 END) AS k, CAST(we AS BIGINT) AS e FROM q WHERE (c, t) IN (SELECT c, t FROM sh) GROUP BY r, ws, we)",
        "sp AS (SELECT r, s, k, e FROM f UNION ALL SELECT r, s, k, e FROM mo)",
        "st AS (SELECT r, " + ", ".join(f"count(*) FILTER (k = {k}) AS n_{n}" for k, n in enumerate(_PII)) + ", string_agg(n[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 4) AS base, string_agg(n[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM sp, (SELECT ['email', 'ip', 'card', 'phone', 'general', 'term'] AS n) GROUP BY r)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, " + ", ".join(f"CAST(coalesce(n_{n}, 0) AS BIGINT) AS n_{n}" for n in _PII) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN st USING (r)"


OP12 = _personal()

OP13 = r"""WITH t AS (SELECT coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS copy, coalesce(q, 0) AS q, coalesce(b, 0) AS b
  FROM documents LEFT JOIN (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS q, max(CAST(coalesce(toxic = 1, false) AS INT)) AS b FROM labels GROUP BY doc_id) USING (doc_id)),
m AS (SELECT part, q, b, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' END, CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' END, CASE WHEN copy THEN 'E' END) AS f FROM t),
g AS (SELECT part, f, count(*) AS n, sum(q) AS q, sum(b) AS b FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, i, substr(o, i, 1) AS c, substr(o, 1, i - 1) AS prior FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
j AS (SELECT part, o, i, c, n, q, b, contains(f, c) AS fails, len(list_intersect(string_split(f, ''), string_split(prior, ''))) > 0 AND f <> '' AS gone, f = c AS sole FROM g, s),
r AS (SELECT part, o, i, c, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN q ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN b ELSE 0 END) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, o AS filter_order, CAST(i AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r"""

ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": OP2, "op6_quality_rules": OP6, "op7_mix_sources": OP7, "op8_decontamination": OP8, "op9_line_dedup": OP9, "op11_vector_codes": OP11, "op12_personal_data": OP12, "op13_filter_audit": OP13}
