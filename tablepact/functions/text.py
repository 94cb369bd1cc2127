"""Naming and display text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = re.compile("[^A-Za-z0-9]+")


def snake_case(name: str) -> str:
    """Words split at anything but ASCII letters and digits, lowered, joined by ``_``.

    camelCase is one word. A leading digit gets ``_`` in front.
    """
    joined = "_".join(word.lower() for word in SEPARATORS.split(name) if word)
    return "_" + joined if joined[:1].isdigit() else joined


def shortened(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, longer ones ending in ``...``; ``-`` if empty."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("-"))
        .when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("...")))
        .otherwise(text)
    )
