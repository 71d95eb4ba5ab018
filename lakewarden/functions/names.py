"""Identifiers and suggestions."""

from __future__ import annotations

import re
from collections.abc import Iterable

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
MAX_LENGTH = 63


def quote(name: str) -> str:
    """A checked identifier in backticks."""
    if not IDENTIFIER.fullmatch(name) or len(name) > MAX_LENGTH:
        raise ValueError(f"not an identifier: {name!r}")
    return f"`{name}`"


def distance(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours that are edited once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def suggest(name: str, known: Iterable[str], hidden: Iterable[str] = (), top: int = 3) -> list[str]:
    """The known names nearest to name, by distance and then name; hidden ones never."""
    n, veil = len(name), {h.lower() for h in hidden}
    most = 1 if n <= 2 else 2 if n <= 5 else min(4, -(-n // 3))
    ranked = sorted((distance(name.lower(), k.lower()), k) for k in set(known) if k.lower() not in veil)
    return [k for d, k in ranked if d <= most][:top]
