"""Column names: a change of metadata, made on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame


def snake_case(name: str) -> str:
    """ASCII lower-case words joined by single underscores; ``col`` when nothing is left."""
    ascii_name = unicodedata.normalize("NFKD", name.strip()).encode("ascii", "ignore").decode()
    return "_".join(re.findall(r"[a-z0-9]+", ascii_name.lower())) or "col"


def plan_names(names: Iterable[str]) -> list[str]:
    """New name per column; a name already taken gets ``_2``, ``_3`` …"""
    taken: set[str] = set()
    out = []
    for name in names:
        stem = snake_case(name)
        new, k = stem, 1
        while new in taken:
            k += 1
            new = f"{stem}_{k}"
        taken.add(new)
        out.append(new)
    return out


def normalise_names(df: DataFrame, keep: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns but those in ``keep``; the map holds only those that changed.

    Columns are renamed by place, so names equal but for their case are no trouble.
    """
    keep = set(keep)
    new = iter(plan_names(c for c in df.columns if c not in keep))
    names = [c if c in keep else next(new) for c in df.columns]
    return df.toDF(*names), {a: b for a, b in zip(df.columns, names) if a != b}
