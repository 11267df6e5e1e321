"""Column names that clash with none of a table's own."""

from __future__ import annotations


def free(taken: list[str], n: int) -> list[str]:
    low = {c.lower() for c in taken}
    return [x for x in (f"__{i}" for i in range(len(taken) + n)) if x not in low][:n]
