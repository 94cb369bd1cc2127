"""Column references by path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(path: Iterable[str]) -> str:
    """A path as a Spark column reference; each name is quoted, so dots and backticks are safe."""
    return ".".join("`" + name.replace("`", "``") + "`" for name in path)


def column(path: Iterable[str]) -> Column:
    return F.col(quoted(path))


def find_field(struct: T.StructType, name: str) -> T.StructField | None:
    """The field of that name: exact spelling first, else the only one that differs by case."""
    exact = [f for f in struct.fields if f.name == name]
    if exact:
        return exact[0]
    loose = [f for f in struct.fields if f.name.lower() == name.lower()]
    return loose[0] if len(loose) == 1 else None
