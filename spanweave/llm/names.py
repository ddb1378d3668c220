"""Column names that an input does not use."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(name: str, taken: Iterable[str]) -> str:
    """``__name``, with as many more underscores as make it new; Spark takes no notice of case."""
    used, found = {t.lower() for t in taken}, f"__{name}"
    while found.lower() in used:
        found += "_"
    return found
