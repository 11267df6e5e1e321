"""Survey attributes as states: banding, top codes, merges and classifiers.

All are native column expressions; unparsable input falls to the documented
state or raises, never to a silent null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


# The state names "Negative income", "Nil income", "Others", "4+", "8+", "100+", the household types
# and the codes -1 (negative) and -2 (missing) of incomes.


def total_weight(*parts: Column) -> Column:
    """Sum of weights, a null counting as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])


def top_code(value: Column, limit: int) -> Column:
    """Integers under ``limit`` as text, the rest (null too) as ``<limit>+``."""
    return F.when(value < limit, value.cast("string")).otherwise(f"{limit}+")


def household_size(size: Column, limit: int = 8) -> Column:
    """``8+`` from ``limit`` on; null stays null."""
    return F.when(size >= limit, f"{limit}+").otherwise(size.cast("string"))


def band(value: Column, bands: Iterable[str], negative: str = "Negative income", nil: str = "Nil income") -> Column:
    """The label ``a-b`` (both ends included) or ``a+`` / ``a more`` that holds a number.

    Negative and zero have labels of their own; a value in no band keeps its text.
    """
    out = F.when(value < 0, negative).when(value == 0, nil)
    for label in bands:
        if label in (negative, nil):
            continue
        if "more" in label or label.endswith("+"):
            low = label.replace("more", "").strip().rstrip("+").strip()
            out = out.when(value >= float(low.replace(",", "")), f"{low}+")
        else:
            low, _, high = label.partition("-")
            out = out.when(value.between(float(low), float(high)), label)
    return out.otherwise(value.cast("string"))


def merge_states(state: Column, merged: Mapping[str, str]) -> Column:
    out = None
    for old, new in merged.items():
        out = (F if out is None else out).when(state == old, new)
    return state if out is None else out.otherwise(state)


def collapse(state: Column, chosen: Iterable[str], label: str = "Others") -> Column:
    return F.when(state.isin(list(chosen)), label).otherwise(state)


def age_decade(age: Column, width: int = 10, limit: int = 100) -> Column:
    """``20-29`` and so on; ``100+`` for older, null or fractional ages."""
    low = (F.floor(age / width) * width).cast("int")
    whole = (age >= 0) & (age < limit) & (age == F.floor(age))
    return F.when(whole, F.concat(low.cast("string"), F.lit("-"), (low + (width - 1)).cast("string"))).otherwise(f"{limit}+")


def half_open_cut(value: Column, width: int = 10, top: int = 120) -> Column:
    """The interval ``(lo, hi]`` that holds a number in (0, top], else null."""
    high = (F.ceil(value / width) * width).cast("int")
    label = F.concat(F.lit("("), (high - width).cast("string"), F.lit(", "), high.cast("string"), F.lit("]"))
    return F.when((value > 0) & (value <= top), label)


def income_to_int(income: Column) -> Column:
    """Lower end of an income label: Negative -1, Missing -2, Zero or Nil 0, ``$a-b`` a, ``$a+`` a.

    Anything else raises.
    """
    low = F.regexp_replace(F.regexp_extract(income, r"\$?([\d,]+)", 1), ",", "")
    return (
        F.when(income.contains("Negative"), -1)
        .when(income.contains("Missing"), -2)
        .when(income.contains("Zero") | income.contains("Nil"), 0)
        .when(low != "", low.try_cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown income: "), F.coalesce(income, F.lit("null")))).cast("int"))
    )


def income_label(income: Column) -> Column:
    """``$1,000-1,249`` for ``1000-1249``; other labels stay."""
    ends = F.split(income, "-")
    pretty = F.concat(F.lit("$"), F.format_number(ends[0].try_cast("int"), 0), F.lit("-"), F.format_number(ends[1].try_cast("int"), 0))
    return F.when(income.rlike(r"^\d+-\d+$"), pretty).otherwise(income)


def strip_pattern(value: Column, pattern: str = r"\(.*\)|\s") -> Column:
    return F.regexp_replace(value, pattern, "")


def attribute_state(label: Column) -> tuple[Column, Column]:
    """The two names in a label such as ``('att', 'state')``."""
    return F.regexp_extract(label, r"^\('([^']*)'", 1), F.regexp_extract(label, r",\s*'([^']*)'\)$", 1)


def step_numbers(label: Column, per_loop: int = 5) -> tuple[Column, Column]:
    """(loop from 1, step from 1) of names with ``run_<r>_adjusted_<a>``."""
    run = F.regexp_extract(label, r"run_(\d+)_adjusted_(\d+)", 1).try_cast("int")
    att = F.regexp_extract(label, r"run_(\d+)_adjusted_(\d+)", 2).try_cast("int")
    return run + 1, run * per_loop + att + 1


def size_matches(label: Column, members: Column, limit: int = 8) -> Column:
    """Whether a size state stands for a number of members; ``8+`` is eight or more."""
    return F.when(label == f"{limit}+", members >= limit).otherwise(members == label.try_cast("int"))


def type_allows_size(hh_type: Column, size: Column) -> Column:
    """Single Person has one member, Couple with Child three at least, other types two."""
    n = F.regexp_replace(size, r"\+", "").try_cast("int")
    return F.when(hh_type == "Single Person", n == 1).when(hh_type == "Couple with Child", n >= 3).otherwise(n >= 2)


def household_type(counts: Mapping[str, Column]) -> Column:
    """Type of a household by its numbers of relations (Spouse, Child, Others and the extended family)."""
    zero = F.lit(0)
    n = {r: F.coalesce(counts[r], zero) if r in counts else zero for r in ("Spouse", "Child", "Others", "Parent", "Grandparent", "Grandchild", "Sibling")}
    wider = n["Parent"] + n["Grandparent"] + n["Grandchild"] + n["Sibling"]
    family = n["Spouse"] + n["Child"] + wider
    return (
        F.when(family + n["Others"] == 0, "Single Person")
        .when(family == 0, "Group Household")
        .when((wider + n["Others"] > 0), "Complicated Family")
        .when((n["Spouse"] > 0) & (n["Child"] > 0), "Couple with Child")
        .when(n["Spouse"] > 0, "Couple Only")
        .otherwise("Single Parent")
    )


def household_type_of_set(relations: Column) -> Column:
    """The same types from the sorted set of relations; raises where nobody is Main."""
    rest = F.array_sort(F.array_remove(relations, "Main"))
    of = lambda *x: rest == F.array(*[F.lit(v) for v in sorted(x)])
    named = (
        F.when(F.size(rest) == 0, "Single Person")
        .when(of("Others"), "Group Household")
        .when(of("Child", "Spouse"), "Couple with Child")
        .when(of("Spouse"), "Couple Only")
        .when(of("Child"), "Single Parent")
        .otherwise("Complicated Family")
    )
    return F.when(F.array_contains(relations, "Main"), named).otherwise(F.raise_error(F.lit("a household without a Main person")))


def lookup(df: DataFrame, column: str, pairs: Mapping[str, str], out: str) -> DataFrame:
    """``column`` mapped by a dictionary; what it lacks becomes null."""
    if not pairs:
        return df.withColumn(out, F.lit(None).cast("string"))
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(out, F.element_at(m, F.col(column)))


def as_strings(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def control_predicate(att: str, state: str) -> Column:
    """A control row's condition, built from its names; expressions are never evaluated."""
    return F.col(att).cast("string") == state


_CONTROL_TERM = re.compile(r"""\s*\(?\s*(?:(\w+)\s*\.\s*)?(\w+)\s*(==|!=|<=|>=|<|>)\s*(?:'([^']*)'|"([^"]*)"|(-?\d+(?:\.\d+)?))\s*\)?\s*""")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def control_expression(text: str, table: str | None = None) -> Column:
    """The condition of a control row's expression, such as ``(households.hhsize >= 3) & (households.type == 'x')``.

    Terms compare a column, which may follow a table's name, with a number or a
    quoted state; they join by ``&``, which binds first, and ``|``. Anything
    else raises: nothing is evaluated. With ``table`` other tables' columns raise.
    """

    def term(part: str) -> Column:
        m = _CONTROL_TERM.fullmatch(part)
        if not m:
            raise ValueError(f"no control term: {part!r}")
        if table and m[1] and m[1] != table:
            raise ValueError(f"a column of {m[1]} in a control of {table}")
        quoted = m[4] if m[4] is not None else m[5]
        return _COMPARE[m[3]](F.col(m[2]).cast("string"), F.lit(quoted)) if quoted is not None else _COMPARE[m[3]](F.col(m[2]).try_cast("double"), F.lit(float(m[6])))

    anyone = [reduce(lambda a, b: a & b, [term(x) for x in part.split("&")]) for part in text.split("|")]
    return F.coalesce(reduce(lambda a, b: a | b, anyone), F.lit(False))


def apply_controls(df: DataFrame, controls: Iterable[tuple[str, str]], table: str | None = None) -> DataFrame:
    """A 0/1 column for each (name, expression); of several with one name the last counts."""
    return df.withColumns({name: control_expression(text, table).cast("int") for name, text in dict(controls).items()})


def in_ranges(value: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [value.between(lo, hi) for lo, hi in ranges], F.lit(False))
