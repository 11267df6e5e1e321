"""Personal data in texts, and terms that give it away, in DataFrame operations.

Four kinds of values are found by pattern: mail and network addresses, card and
phone numbers. Each different value is a protected entity. A term is a run of
three or more letters, among the five nearest on either side of a value and
within 80 code points of it, in lower case. Over all rows of the corpus, n_c
hold the entity c, n_t the term t anywhere and n_ct the term near the entity;
how much t reveals of c is their pointwise mutual information

    PMI(c; t) = log2(n * n_ct / (n_c * n_t)),

and all there is to reveal is IC(c) = log2(n / n_c). A term that reveals at
least ``disclosure`` of it, on the evidence of ``support`` rows and as many
different contexts before and after the value (copies of a passage are one
piece of evidence), is taken out where it stands near that value: generalised
to its class, the words that begin with the same three letters, if the class
stays under the threshold, else removed.

The patterns are those of the kinds in a form that runs through a text once:
their repeats are possessive and they start only where a run starts; card
numbers of other than 14 to 19 digits do not match at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .columns import free
from .durable import durable
from .quality import let

#: In the order of the list of kinds; the last two are the method's.
KINDS = ("email", "ip", "card", "phone", "general", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)"
TERM = r"\p{L}{3,}"
REACH, NEAREST, CLASS = 80, 5, 3


def running(values: Column) -> Column:
    """Running sums of an array: of blocks of about its length's root, then inside them."""
    total = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)

    def summed(v: Column, width: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, width).cast("int")), lambda j: total(F.slice(v, j * width + 1, width)))
        before = let(starts, lambda s: F.transform(s, lambda _, j: total(F.slice(s, F.lit(1), j))))
        return let(before, lambda b: F.transform(v, lambda x, i: F.get(b, F.call_function("div", i, width).cast("int")) + total(F.slice(v, i - i % width + 1, i % width + 1))))

    return F.when(F.size(values) > 0, summed(values, F.ceil(F.sqrt(F.size(values))).cast("int"))).otherwise(values)


def placed(m: Column, gaps: Column) -> Column:
    """Array of (s, e, value, before, after) of the matches ``m`` and the texts between them: places in code points, ends exclusive."""
    ends = let(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i))), running)
    one = lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("s"), F.get(e, i).alias("e"), x.alias("value"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))
    return let(ends, one)


def matches(text: Column, pattern: str) -> Column:
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def digit(i: Column) -> Column:
        d = number.substr(F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


#: Kind: pattern, what its texts hold at least, the check of a match, the entity that a match names.
FINDERS: dict[str, tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (EMAIL, "@", lambda v: F.lit(True), F.lower),
    "ip": (IP, ".", lambda v: v.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"), lambda v: v),
    "card": (CARD, "", lambda v: let(digits(v), luhn), digits),
    "phone": (PHONE, "+", lambda v: F.length(digits(v)).between(10, 15), digits),
}


def terms(side: Column, at: Column, before: bool) -> Column:
    """The nearest terms (t, s, e) in the text on one side of a value that begins or ends ``at``; a term that the reach cuts is none."""
    near = F.right(side, F.lit(REACH)) if before else F.left(side, F.lit(REACH))
    cut = F.length(side) > REACH
    whole = lambda m: F.filter(m, lambda x: ~(cut & ((x["s"] == 0) if before else (x["e"] == REACH))))
    nearest = lambda m: F.slice(m, F.greatest(F.size(m) - NEAREST + 1, F.lit(1)), F.lit(NEAREST)) if before else F.slice(m, 1, NEAREST)
    origin = at - F.least(F.length(side), F.lit(REACH)) if before else at
    placed = lambda m: F.transform(m, lambda x: F.struct(F.lower(x["value"]).alias("t"), (x["s"] + origin).alias("s"), (x["e"] + origin).alias("e")))
    return let(let(matches(near, TERM), whole), lambda m: placed(nearest(m)))


def with_values(texts: DataFrame) -> DataFrame:
    """(id, text) with ``found``: the values of each text by start and kind, as ``VALUES``, their sides as digests of their terms.

    One step a projection, so that each is computed once and resolved by itself.
    """
    there = {name: (F.contains("text", F.lit(sign)) if sign else F.col("text").rlike("[0-9]")) & F.col("text").rlike(pattern) for name, (pattern, sign, *_) in FINDERS.items()}
    passing = lambda k: lambda x: FINDERS[k][2](x["value"])
    d = texts.select("id", "text", *[F.when(there[k], F.regexp_extract_all("text", F.lit(f[0]), F.lit(0))).alias(f"m_{k}") for k, f in FINDERS.items()])
    d = d.select("id", "text", *[F.when(F.col(f"m_{k}").isNotNull(), F.struct(F.col(f"m_{k}").alias("m"), F.split("text", f[0], -1).alias("gaps"))).alias(f"m_{k}") for k, f in FINDERS.items()])
    d = d.select("id", "text", *[placed(F.col(f"m_{k}.m"), F.col(f"m_{k}.gaps")).alias(k) for k in FINDERS])
    d = d.select("id", "text", *[F.filter(k, passing(k)).alias(k) for k in FINDERS])

    def sides(k: int, name: str) -> Column:
        entity = FINDERS[name][3]
        return F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.concat(F.lit(f"{name}:"), entity(x["value"])).alias("entity"), terms(x["before"], x["s"], True).alias("a"), terms(x["after"], x["e"], False).alias("b")))

    def shown(x: Column) -> Column:
        digest = lambda side: F.xxhash64(F.transform(x[side], lambda w: w["t"]))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["entity"].alias("entity"), digest("a").alias("before"), digest("b").alias("after"), F.concat(x["a"], x["b"]).alias("terms"))

    d = d.select("id", "text", *[sides(k, name).alias(name) for k, name in enumerate(FINDERS)])
    return d.select("id", "text", F.sort_array(F.concat(*[F.coalesce(F.transform(name, shown), F.array().cast(VALUES)) for name in FINDERS])).alias("found"))


VALUES = "array<struct<s:int,k:int,e:int,entity:string,before:bigint,after:bigint,terms:array<struct<t:string,s:int,e:int>>>>"


def class_of(term: Column) -> Column:
    """The class that a term is generalised to; a star is in no term."""
    return F.concat(F.left(term, F.lit(CLASS)), F.lit("*"))


def with_classes(found: Column) -> Column:
    return F.array_distinct(F.concat(found, F.transform(found, class_of)))


def disclosing(base: DataFrame, texts: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(entity, t, k): the terms that reveal an entity, with the kind of what happens to them.

    ``base`` has the values of each row, ``texts`` the rows' texts. A row counts once for a pair.
    """
    holding = base.where(F.size("found") > 0)
    n = base.count()
    per_entity = holding.select(F.explode(F.array_distinct(F.transform("found", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") >= support)
    # pairs as strings, which are told apart by hash; neither side has a space
    near = lambda x: F.transform(with_classes(F.transform(x["terms"], lambda w: w["t"])), lambda t: F.concat(x["entity"], F.lit(" "), t))
    together = holding.select(F.explode(F.array_distinct(F.flatten(F.transform("found", near)))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    together = together.select(F.substring_index("p", " ", 1).alias("entity"), F.substring_index("p", " ", -1).alias("t"), "n_ct")
    sides = holding.select(F.explode("found").alias("x")).select("x.entity", F.explode(with_classes(F.transform("x.terms", lambda w: w["t"]))).alias("t"), "x.before", "x.after")
    varied = [sides.select("entity", "t", c).distinct().groupBy("entity", "t").agg(F.count(F.lit(1)).alias("v")).where(F.col("v") >= support).select("entity", "t") for c in ("before", "after")]
    pairs = durable(together.join(per_entity, "entity").join(varied[0], ["entity", "t"]).join(varied[1], ["entity", "t"]))
    if pairs.isEmpty():  # nothing to weigh: no word is counted
        return pairs.select("entity", "t", F.lit(0).alias("k"))
    per_term = texts.select(F.explode(with_classes(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    pmi = F.log2(F.lit(float(n)) * F.col("n_ct") / F.col("n_c") / F.col("n_t"))
    content = F.log2(F.lit(float(n)) / F.col("n_c"))
    revealing = durable(pairs.join(per_term, "t").where((content > 0) & (pmi >= disclosure * content - 1e-9)).select("entity", "t"))
    classes = revealing.where(F.col("t").endswith("*")).select("entity", F.col("t").alias("class"), F.lit(True).alias("too"))
    words = revealing.where(~F.col("t").endswith("*")).withColumn("class", class_of(F.col("t")))
    kind = F.when(F.col("too"), KINDS.index("term")).otherwise(KINDS.index("general"))
    return durable(words.join(classes, ["entity", "class"], "left").select("entity", "t", kind.alias("k")))


def listed(spans: Column) -> Column:
    """kind:start:end of (s, k, e) structs, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def found_spans(docs: DataFrame, id_col: str, text_col: str, disclosure: float, support: int) -> DataFrame:
    """(id, h, found, base, spans) of each row: values, and arrays of (s, k, e) without and with the terms that give them away."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = durable(with_values(text).select("id", F.when(F.size("found") > 0, F.unhex(F.sha2("text", 256))).alias("h"), "found"))
    revealing = disclosing(base, text, disclosure, support)
    plain = F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = base.withColumn("base", plain)
    none = base.where(F.size("found") == 0).withColumn("spans", F.col("base"))
    # spans depend on the text alone: copies are one text here
    near = base.where(F.size("found") > 0).select("h", F.explode("found").alias("x")).select("h", "x.entity", F.explode("x.terms").alias("w")).select("h", "entity", "w.t", "w.s", "w.e").distinct()
    # a term that gives away two values may be removed for one and generalised for the other: removal wins
    more = near.join(revealing, ["entity", "t"]).groupBy("h", "s", "e").agg(F.max("k").alias("k")).groupBy("h").agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))
    some = base.where(F.size("found") > 0).join(more, "h", "left")
    some = some.withColumn("spans", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))))).drop("more")
    return none.unionByName(some)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.75, support: int = 3) -> DataFrame:
    """Per row: its id, the number of values of each kind, the digest of their places, and all spans.

    A null or empty text has no spans. Rows that share an id or have none are
    told apart by their texts; repeated rows have the same spans and count as
    rows in the corpus. An empty table gives no rows; other columns are not read.
    """
    d = found_spans(docs, id_col, text_col, disclosure, support)
    of = lambda k: lambda x: x["k"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(FINDERS)]
    return d.select(F.col("id").alias(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.75, support: int = 3) -> DataFrame:
    """``docs`` with each span's text replaced: a value by its kind in angle brackets, a term by its class or by nothing.

    Of spans that overlap, the first by start, then kind, decides and the others
    that begin inside it are part of it. Rows and columns stay as they are
    otherwise; a null text stays null. The time of a row grows with its spans
    times its length.
    """
    h, spans = free(docs.columns, 2)
    found = found_spans(docs, id_col, text_col, disclosure, support).where(F.size("spans") > 0).select(F.col("h").alias(h), F.col("spans").alias(spans)).dropDuplicates([h])
    text = F.col(text_col)
    pick = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("of")),
        lambda a, x: F.when(x["s"] >= a["to"], F.struct(x["e"].alias("to"), F.array_append(a["of"], x).alias("of"))).otherwise(a),
    )["of"]
    cut = lambda a, b: text.substr(a + 1, b - a)
    tag = lambda x: F.when(x["k"] < len(FINDERS), F.concat(F.lit("<"), F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), F.lit(">"))).when(x["k"] == KINDS.index("general"), class_of(F.lower(cut(x["s"], x["e"])))).otherwise(F.lit(""))
    rebuilt = let(pick, lambda p: F.concat(F.array_join(F.transform(p, lambda x, i: F.concat(cut(F.coalesce(F.get(p, i - 1)["e"], F.lit(0)), x["s"]), tag(x))), ""), cut(F.element_at(p, -1)["e"], F.length(text))))
    out = docs.withColumn(h, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))).join(found, h, "left")
    return out.withColumn(text_col, F.when(F.size(spans) > 0, rebuilt).otherwise(text)).select(*docs.columns)
