"""Shards of near equal bytes by a k-d tree over the documents' metadata.

Every node is split along its widest dimension at the weighted median (or, for an odd number of
leaves, at their share) until a leaf has the target bytes. The median is found for all nodes of a
level at once by narrowing histograms: each pass adds up bytes by cell, and only the cell the
median falls into is looked at again. Rows with the same coordinate are ordered by a hash of the
row, so a source with a third of all rows is split like any other. What reaches the driver is at
most 1,024 cells per node. Only Spark's own functions are used.

Defined results: a NULL text has no bytes; NULL metadata lies below all values; rows that repeat
in every column stay together; with fewer rows than shards some shards stay empty; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stored, table

SHARDS = 16
CELLS = 1024
TOLERANCE = 0.0005
SLOT_CELL_ROWS = 1024
TIE_BITS = 52


class Cut(NamedTuple):
    """Rows of a node with (coordinate, tie) below (value, tie) go left."""

    dimension: str
    value: float
    tie: float


def _coordinate(documents: DataFrame, name: str) -> Column:
    """Numbers as they are; texts by a checksum, which keeps equal ones together."""
    kind = documents.schema[name].dataType.simpleString()
    number = F.crc32(F.col(name).cast("binary")) if kind == "string" else F.col(name)
    return F.coalesce(F.nanvl(number.cast("double"), F.lit(-1.0)), F.lit(-1.0))


def points(documents: DataFrame, dimensions: Iterable[str], id_column="doc_id", text_column="text") -> DataFrame:
    """Id, size, checksum, coordinates and tie-breaker of every row, without its text."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    own = documents.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[_coordinate(documents, name).alias(f"at_{i}") for i, name in enumerate(dimensions)],
    )
    tie = F.pmod(F.xxhash64(*own.columns), F.lit(1 << TIE_BITS)).cast("double")
    return own.withColumn("tie", tie)


def _tree(cuts: dict[int, Cut], values: dict[int, Column], other: Column, node: int = 1) -> Column:
    """The value of the leaf a row falls into; node n has the children 2n and 2n + 1."""
    if node not in cuts:
        return values.get(node, other)
    cut = cuts[node]
    at = F.col(cut.dimension)
    right = (at > cut.value) | ((at == cut.value) & (F.col("tie") >= cut.tie))
    below = [_tree(cuts, values, other, child) for child in (2 * node, 2 * node + 1)]
    return F.when(right, below[1]).otherwise(below[0])


class _Search:
    """Narrowing of the place where a node's rows reach the wanted bytes."""

    def __init__(self, dimension: str, low: float, high: float, wanted: float, total: int):
        self.dimension, self.wanted, self.slack = dimension, wanted, TOLERANCE * total
        self.value, self.low, self.high, self.before = None, low, high, 0
        self.cut: Cut | None = None

    @property
    def axis(self) -> Column:
        return F.col("tie") if self.value is not None else F.col(self.dimension)

    def inside(self) -> Column:
        within = self.axis.between(self.low, self.high)
        return within if self.value is None else within & (F.col(self.dimension) == self.value)

    def cell(self) -> Column:
        width = (self.high - self.low) or 1.0
        return F.least(F.floor((self.axis - self.low) / width * CELLS), F.lit(CELLS - 1)).cast("int")

    def narrow(self, cells: list) -> None:
        for cell in sorted(cells, key=lambda c: c["cell"]):
            if self.before + cell["size"] < self.wanted:
                self.before += cell["size"]
                continue
            low, high = cell["low"], cell["high"]
            if cell["size"] > self.slack and low < high:
                self.low, self.high = low, high
            elif cell["size"] > self.slack and self.value is None and cell["rows"] > 1:
                self.value, self.low, self.high = low, 0.0, float(1 << TIE_BITS)
            else:
                left = self.wanted - self.before <= cell["size"] / 2
                if self.value is None:
                    self.cut = Cut(self.dimension, low if left else high, -1.0 if left else float(1 << 53))
                else:
                    self.cut = Cut(self.dimension, self.value, low if left else high + 1)
            return
        self.cut = Cut(self.dimension, float("inf"), 0.0)


def _searched(rows: DataFrame, cuts: dict[int, Cut], searches: dict[int, _Search]) -> dict[int, Cut]:
    while open_ := {n: s for n, s in searches.items() if s.cut is None}:
        found = (
            rows.where(_tree(cuts, {n: s.inside() for n, s in open_.items()}, F.lit(False)))
            .select(_tree(cuts, {n: F.struct(F.lit(n).alias("node"), s.cell().alias("cell"), s.axis.alias("axis"))
                                 for n, s in open_.items()}, F.lit(None)).alias("at"), "size")
            .groupBy("at.node", "at.cell")
            .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"),
                 F.min("at.axis").alias("low"), F.max("at.axis").alias("high"))
            .collect()
        )
        for number, search in open_.items():
            search.narrow([c for c in found if c["node"] == number])
    return {n: s.cut for n, s in searches.items()}


def kd_tree(rows: DataFrame, dimensions: int, shards: int) -> Column:
    """Number of the leaf of each row of :func:`points`, as an expression."""
    axes = [f"at_{i}" for i in range(dimensions)]
    ends = [f for a in axes for f in (F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"))]
    cuts: dict[int, Cut] = {}
    leaves, whole = {1: (0, shards)}, None
    while split := {n: x for n, x in leaves.items() if x[1] > 1}:
        node = _tree(cuts, {n: F.lit(n) for n in split}, F.lit(0))
        stats = {r["node"]: r for r in rows.groupBy(node.alias("node")).agg(F.sum("size").alias("size"), *ends).collect()}
        whole = whole or stats.get(1)
        searches = {}
        for number in split.keys() & stats.keys():
            found, count = stats[number], split[number][1]

            def width(axis, found=found):
                return (found[f"max_{axis}"] - found[f"min_{axis}"]) / ((whole[f"max_{axis}"] - whole[f"min_{axis}"]) or 1)

            axis = max(axes, key=width)
            searches[number] = _Search(axis, found[f"min_{axis}"], found[f"max_{axis}"],
                                       found["size"] * (count // 2) / count, found["size"])
        cuts |= _searched(rows, dict(cuts), searches)
        for n, (first, count) in split.items():
            del leaves[n]
            if n in cuts:
                leaves[2 * n] = (first, count // 2)
                leaves[2 * n + 1] = (first + count // 2, count - count // 2)
    return _tree(cuts, {n: F.lit(first) for n, (first, _) in leaves.items()}, F.lit(0))


def with_slots(rows: DataFrame) -> DataFrame:
    """Rows numbered from 0 within their shard, in pieces of bounded size.

    A shard is cut by the row's hash into cells; rows are numbered per cell, and the counts of the
    cells before are added.
    """
    cells = max(1, -(-rows.count() // SLOT_CELL_ROWS))
    rows = rows.withColumn("cell", F.floor(F.col("tie") / (1 << TIE_BITS) * cells))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "cell").orderBy("tie", "doc_id")
    numbered = rows.withColumn("number", F.row_number().over(own) - 1)
    return numbered.join(counts, ["shard", "cell"]).withColumn(
        "slot", (F.col("before") + F.col("number")).cast("bigint")
    )


def kd_shards(
    documents: DataFrame, dimensions=("n_chars", "lang", "source"), shards: int | None = None,
    target_bytes: int | None = None, id_column="doc_id", text_column="text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Give the number of shards, or the bytes a shard should have.
    """
    rows = stored(points(documents, dimensions, id_column, text_column), "points")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = rows.withColumn("shard", kd_tree(rows, len(dimensions), shards))
    return with_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def op8_sharding(spark, folder: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return kd_shards(table(spark, folder, "documents"), shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
