"""Columns of the caller whose names an operator needs for itself."""

from __future__ import annotations


def hidden(names: list[str], used: tuple[str, ...] = ()) -> dict[str, str]:
    """Other names, free ones, for the columns that begin with ``__`` or are among ``used``."""
    prefix = "own"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return {c: f"{prefix}{n}" for n, c in enumerate(names) if c.startswith("__") or c in used}
