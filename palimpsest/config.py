"""Settings of the reconciliation engine."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

# The strings that mark a masked span.
MARKERS = (
    "[REDACTED]",
    "[Redacted]",
    "[REDACTED TEXT]",
    "[REDACTED PER]",
    "[Sender information redacted]",
    "[b(6)]",
    "[b(7)(c)]",
    "[b(7)(e)]",
    "XXXXXXXXX",
    "■■■■■■■",
    "(redacted)",
    "*** REDACTED ***",
    "<REDACTED>",
)


@dataclass(frozen=True)
class Settings:
    markers: tuple[str, ...] = MARKERS
    shingle_words: int = 8
    permutations: int = 128
    bands: int = 25
    rows_per_band: int = 5
    min_overlap_chars: int = 200
    plain_overlap_chars: int = 500
    header_matches: int = 2
    header_limit: int = 1000
    anchor_length: int = 50
    group_cap: int = 500
    split_above: int = 2000
    min_words_per_page: int = 50
    open_groups: bool = True

    def get(self, path: str, default: Any = None) -> Any:
        """A setting by dotted name; only the last part counts."""
        return getattr(self, path.rsplit(".", 1)[-1], default)

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """Settings from nested dictionaries (as read from YAML); unknown names are ignored."""
        flat: dict[str, Any] = {}

        def walk(d: dict[str, Any]) -> None:
            for k, v in d.items():
                walk(v) if isinstance(v, dict) else flat.__setitem__(k, v)

        walk(values)
        known = {f.name for f in fields(cls)}
        flat = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known}
        return replace(cls(), **flat)


DEFAULTS = Settings()
