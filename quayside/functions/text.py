"""Paths and indents of the product hierarchy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path separator, longest path kept, and indent per level.
PATH_SEPARATOR = " -> "
PATH_LIMIT = 4000
INDENT = "  "


def start_path(code: Column, limit: int | None = PATH_LIMIT) -> Column:
    """Path of a first component, cut at ``limit`` characters; compared by bytes, as reports sort."""
    code = F.collate(code, "UTF8_BINARY")
    return code if limit is None else F.left(code, F.lit(limit))


def extend_path(path: Column, code: Column, limit: int | None = PATH_LIMIT) -> Column:
    code = F.collate(code, "UTF8_BINARY")
    return start_path(F.concat(path, F.lit(PATH_SEPARATOR), code), limit)


def indent(level: Column, code: Column) -> Column:
    return F.concat(F.repeat(F.lit(INDENT), level - 1), code)
