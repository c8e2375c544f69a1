"""Helpers the text operators share: stored tables, byte views of texts, blocks of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import stored

__all__ = [
    "BLOCK_BYTES", "LOWER", "blocks", "free_name", "id_remainder", "kept", "stored", "table", "texts_of", "without_rows",
]

BLOCK_BYTES = 4 << 20
SENT_ROWS = 1 << 18
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a NULL id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def kept(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks, until it works on something else (see ``blocks``)."""
    own = sys.__dict__.setdefault("_quayside_kept", {})
    if name not in own:
        own[name] = make()
    return own[name]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES, keep: bool = False):
    """Slices of the batches with about ``limit`` bytes of text, so memory does not follow batch size.

    What the worker has kept from tasks of another kind is let go, unless ``keep`` says that it is of use here.
    """
    if not keep:
        sys.__dict__.pop("_quayside_kept", None)
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for row, length in enumerate(lengths):
            if row > start and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores in front where a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_rows(documents: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Documents less the rows ``dropped`` names by ``keys`` (NULL equals NULL).

    ``dropped`` has, by key, ``_all``: whether every row goes; otherwise one of them stays. A short
    list, no more than ``SENT_ROWS``, is sent to all tasks; a longer one is joined.
    """
    dropped = stored(dropped, "dropped")
    few = dropped.count() <= SENT_ROWS
    repeated = not dropped.where("NOT _all").isEmpty()
    own = {name: free_name(documents.columns, f"dropped_{name}") for name in (*keys, "_all")}
    marks, every = dropped.withColumnsRenamed(own), F.col(own["_all"])
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(own[key]))
    marked = documents.join(F.broadcast(marks) if few else marks, same, "left")
    rows = marked.where(every.isNull()).select(*documents.columns)
    if repeated:
        rows = rows.unionByName(marked.where(~every).select(*documents.columns).dropDuplicates(keys))
    return rows
