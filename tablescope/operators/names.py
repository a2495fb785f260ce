"""Column name normalisation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tablescope.plans.columns import local_rows

# Fixed value: the characters that become an underscore.
_TO_UNDERSCORE = re.compile(r"[ \-./\\()\[\]]")


def normalized_names(names: list[str]) -> list[str]:
    """Lower-case names of letters, digits and single underscores, made unique with ``_1``, ``_2``, ...

    A suffixed name that is itself taken moves on to the next number, so the result never holds a name twice.
    """
    base = [re.sub("_+", "_", _TO_UNDERSCORE.sub("_", n.strip().lower())).strip("_") for n in names]
    used: set[str] = set()
    repeats: dict[str, int] = {}
    result = []
    for name in base:
        unique = name
        while unique in used:
            repeats[name] = repeats.get(name, 0) + 1
            unique = f"{name}_{repeats[name]}"
        used.add(unique)
        result.append(unique)
    return result


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def name_map(df: DataFrame) -> DataFrame:
    """``(original, normalized, position)``, one row per column."""
    rows = [(o, n, i) for i, (o, n) in enumerate(zip(df.columns, normalized_names(df.columns)))]
    return local_rows(df.sparkSession, rows, "original string, normalized string, position int")
