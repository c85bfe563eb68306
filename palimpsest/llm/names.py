"""Names for columns of this package's own beside those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to be unlike all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
