"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut where a rolling hash of its last 32 bytes says so, each chunk gets an
identifier, and two texts are equal when their ordered lists of identifiers (recipes) are equal.
Only recipes are grouped and joined, so a long document moves once at most: its chunks are
compared byte by byte when identifiers are verified. Identifiers are accepted only if no two
different chunks share one; otherwise the work is repeated with longer ones.

Defined results: a NULL text counts as empty; an empty text has the empty recipe and equals other
empty texts; of equal texts the smallest id stays, a NULL id only where there is no other; of
repeated rows exactly one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import blocks, free_name, stored, table, texts_of, without_rows

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 1024, 12, 16384
DIGEST_BYTES = (16, 32, 64)
HELD_BYTES = 32 << 20
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalised(text: bytes) -> bytes:
    """Every run of ASCII white space replaced by one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _gears() -> np.ndarray:
    """One pseudo-random 32-bit number per byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEARS = _gears()


def cut_points(buffer: bytes) -> np.ndarray:
    """Positions after which a chunk may end: the rolling hash of 32 bytes has zero top bits."""
    h = GEARS[np.frombuffer(buffer, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_bounds(size: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes, given its possible cuts in order."""
    ends, start, i = [], 0, 0
    while size - start > MIN_CHUNK:
        i += int(np.searchsorted(cuts[i:], start + MIN_CHUNK))
        end = int(cuts[i]) if i < len(cuts) else size
        start = min(end, start + MAX_CHUNK, size)
        ends.append(start)
    if start < size:
        ends.append(size)
    return ends


def _chunked(texts: list[bytes | None]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Normalised text and chunks of each text, with one pass of the rolling hash over all."""
    clean = [normalised(text or b"") for text in texts]
    cuts = cut_points(b"".join(clean)) if any(clean) else np.zeros(0, np.int64)
    base = 0
    for text in clean:
        low, high = np.searchsorted(cuts, (base, base + len(text)))
        ends = chunk_bounds(len(text), cuts[low:high] - base)
        yield text, [text[a:b] for a, b in zip([0, *ends], ends)]
        base += len(text)


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(documents: DataFrame, size: int, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, row_id, text_sha256 and recipe of every row."""

    def run(batches):
        for block in blocks(batches, "text"):
            shas, lists = [], []
            for text, chunks in _chunked(texts_of(block.column("text"))):
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append(b"".join(_digest(chunk, size) for chunk in chunks))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("row_id"), pa.array(shas, pa.string()),
                 pa.array(lists, pa.binary())],
                ["doc_id", "row_id", "text_sha256", "recipe"],
            )

    rows = documents.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row_id bigint, text_sha256 string, recipe binary")


def chunks(documents: DataFrame, size: int, text_column="text") -> DataFrame:
    """identifier and bytes of the chunks, each once per stretch of a task."""

    def run(batches):
        held, weight = {}, 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held.values()), pa.binary()), pa.array(list(held), pa.binary())],
                ["identifier", "chunk"],
            )

        for block in blocks(batches, "text"):
            for _, pieces in _chunked(texts_of(block.column("text"))):
                for piece in pieces:
                    if piece not in held:
                        held[piece] = _digest(piece, size)
                        weight += len(piece)
            if weight > HELD_BYTES:
                yield out()
                held, weight = {}, 0
        if held:
            yield out()

    rows = documents.select(F.col(text_column).alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "identifier binary, chunk binary")


def shared_identifiers(chunk_rows: DataFrame) -> DataFrame:
    """Identifiers that two different chunks bear, found by comparing the chunks themselves."""
    distinct = chunk_rows.repartition("identifier").distinct()
    return distinct.groupBy("identifier").count().where("count > 1")


def exact_duplicates(
    documents: DataFrame, id_column="doc_id", text_column="text", digests=DIGEST_BYTES
) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256."""
    for size in digests:
        if shared_identifiers(chunks(documents, size, text_column)).isEmpty():
            break
    else:
        raise ValueError("different chunks share an identifier at every length")
    rows = stored(recipes(documents, size, id_column, text_column), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    # Stored, so that both sides of the join are plain shuffles and a hot recipe can be split.
    groups = stored(groups.where("group_size > 1").select("recipe", "group_size", "first"), "groups")
    alone = F.col("group_size").isNull()
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row_id") == F.col("first.row_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Documents with one row of each text, all columns as they are."""
    found = exact_duplicates(documents, id_column, text_column)
    sha = free_name(documents.columns, "text_sha256")
    dropped = found.groupBy(F.col("doc_id").alias(id_column), F.col("text_sha256").alias(sha)).agg(
        (~F.bool_or("kept")).alias("_all"), F.count_if(~F.col("kept")).alias("_dropped")
    ).where("_dropped > 0").drop("_dropped")
    columns = documents.columns

    def run(batches):
        for block in blocks(batches, text_column):
            shas = [hashlib.sha256(normalised(text or b"")).hexdigest() for text in texts_of(block.column(text_column))]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(shas, pa.string())], [*columns, sha])

    schema = T.StructType([*documents.schema.fields, T.StructField(sha, T.StringType())])
    return without_rows(documents.mapInArrow(run, schema), dropped, [id_column, sha]).drop(sha)


def op7_exact_dedup(spark, folder: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return exact_duplicates(table(spark, folder, "documents"))


OP7_SQL = """
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
