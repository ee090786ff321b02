"""Spans found in texts: what the secret scan and the personal-data scan share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

#: (start, end, kind), code points, end exclusive.
Span = tuple[int, int, str]


def joined(spans: Iterable[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
