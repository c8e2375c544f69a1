"""Rank and running total per key, with hot keys spread over many tasks.

A window over ``PARTITION BY key`` puts all rows of a key into one task. Here a hot key is cut
into cells by its first order columns, a cell that is still too large by the next ones, and
what is left by the bits of the unique row id. The window then runs per (key, cell), and each
cell adds the count and sum of the cells before it, which come from partial aggregates of the
hot keys only.

Bounds, whatever the skew: a cell holds at most the limit of the hot keys or, cut to the end,
2**20 rows, because row ids are unique. The cells of one parent number at most the distinct
values of their order columns (calendar days) times the distinct ``row_id >> 40``, or 2**20.
Cells follow from the values in a row alone, so a task that is run again on another executor
gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.skew import HotKeys, flag_hot
from quayside.session import stored

LOW_BITS = 20
HIGH_BITS = 40
NULL_CELL = "null"  # cells of rows without a key start so, all others do not

Levels = tuple[tuple[str, ...], ...]


def ordered_scan(
    rows: DataFrame,
    key: str,
    order: Levels,
    row_id: str,
    amount: str,
    rank: str,
    before: str,
    per_key: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add the row number within ``key`` and the sum of ``amount`` over the rows before.

    ``order`` lists the order columns (numbers, dates or timestamps, NULLs first) in groups, coarse
    to fine; the unique integer ``row_id`` comes last. ``per_key`` is left-joined on the same
    shuffle. ``before`` is NULL on the first row. Its type is the same with and without ``hot``:
    decimals get 38 digits, doubles stay, integers become bigint. Rows with a NULL key are one group.
    """
    columns = [name for level in order for name in level]
    kind = _total_type(rows.schema[amount].dataType)
    given = [*rows.columns, *([c for c in per_key.columns if c != key] if per_key is not None else [])]
    if hot is None:
        if per_key is not None:
            rows = rows.join(per_key, key, "left").select(*given)
        return _scan(rows, [key], columns, row_id, amount, rank, before, kind)

    levels, days = _levels(rows, order)
    rows = flag_hot(rows, hot, key, F.lit(True).alias("_hot")).withColumns({
        **days,
        "_high": F.shiftright(row_id, HIGH_BITS),
        "_low": F.shiftright(row_id, LOW_BITS),
    })
    # The hot rows' few columns are written once; every level of cells is made from there.
    narrow = stored(rows.where("_hot").select(key, *_flat(levels), F.col(amount).alias("_amount")), "hot-rows")
    offsets, large = _cells(narrow, key, levels, hot.limit)
    rows = _with_cell(rows, key, levels, large)
    plain = _plain_key(rows, key)
    if per_key is not None:
        # Joined together, so that one shuffle by (key, cell) serves join and window.
        own = _plain_key(per_key.where(F.col(key).isNotNull()), key)
        whole = own.join(F.broadcast(hot.keys.select(key)), key, "left_anti").withColumn("_cell", F.lit(""))
        of_hot = own.join(F.broadcast(hot.keys.select(key)), key, "left_semi").drop(key)
        of_hot = of_hot.withColumnRenamed("_key", "_own")
        found = (offsets["_key"] == of_hot["_own"]) & ~F.startswith(offsets["_cell"], F.lit(NULL_CELL))
        of_cells = offsets.join(F.broadcast(of_hot), found, "left").drop("_own")
        offsets = whole.drop(key).unionByName(of_cells, allowMissingColumns=True)
    # Named here rather than left to the window: rows that arrive partitioned by the key alone
    # would satisfy it and keep a hot key in one task.
    rows = plain.repartition("_key", "_cell").join(offsets, ["_key", "_cell"], "left")
    scanned = _scan(rows, ["_key", "_cell"], columns, row_id, amount, rank, before, kind)
    return scanned.withColumns({
        rank: F.col(rank) + F.coalesce("_rows_before", F.lit(0)),
        before: _plus(F.col("_amount_before"), F.col(before)).cast(kind),
    }).select(*given, rank, before)


def _total_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    return "double" if isinstance(kind, T.FractionalType) else "bigint"


def _levels(rows: DataFrame, order: Levels) -> tuple[list[tuple[str, ...]], dict[str, Column]]:
    """Levels of cells: a timestamp by its day first, then whole; the bits of the row id last."""
    levels, days = [], {}
    for level in order:
        names: list[str] = []
        for name in level:
            if isinstance(rows.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
                days[f"_day_{name}"] = F.to_date(name)
                levels.append((*names, f"_day_{name}"))
                names = []
            names.append(name)
        levels.append(tuple(names))
    levels[-1] = (*levels[-1], "_high")
    return [*levels, ("_low",)], days


def _plain_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``_key``: the key, or for NULL a value that joins; cells tell the two apart."""
    kind = rows.schema[key].dataType
    nothing = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return rows.withColumn("_key", F.coalesce(key, nothing))


def _scan(rows, partition, order, row_id, amount, rank, before, kind) -> DataFrame:
    window = Window.partitionBy(*partition).orderBy(*order, row_id)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*",
        F.row_number().over(window).cast("bigint").alias(rank),
        F.sum(amount).over(earlier).cast(kind).alias(before),
    )


def _cells(rows, key, levels, limit) -> tuple[DataFrame, list[DataFrame]]:
    """Rows and amount ahead of each cell, and for each level the cells cut further.

    No more than rows/limit cells can be too large, so their lists are as bounded as that of
    the hot keys and broadcast like it.
    """
    finished, large = [], []
    parents = None
    for depth, level in enumerate(levels, start=1):
        outer, group = [key, *_flat(levels[:depth - 1])], [key, *_flat(levels[:depth])]
        cells = rows.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_rows"), F.sum("_amount").alias("_amount")
        )
        window = Window.partitionBy(*outer).orderBy(*level)
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select(
            *group,
            "_rows",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.sum("_amount").over(earlier).alias("_amount_before"),
        )
        if parents is not None:
            cells = _add_parents(cells, parents, outer)
        last = depth == len(levels)
        done = cells if last else cells.where(F.col("_rows") <= limit)
        name = _cell_name(key, group[1:]).alias("_cell")
        finished.append(_plain_key(done, key).select("_key", name, "_rows_before", "_amount_before"))
        if not last:
            parents = cells.where(F.col("_rows") > limit).drop("_rows")
            large.append(parents.select(*group))
            rows = _null_safe(rows, large[-1], group, "left_semi")
    return reduce(DataFrame.unionByName, finished), large


def _with_cell(rows, key, levels, large) -> DataFrame:
    """Rows with the name of their cell; empty for the keys that are not hot."""
    name = _cell_name(key, _flat(levels))
    for depth in range(len(large), 0, -1):
        group = [key, *_flat(levels[:depth])]
        flag = f"_large_{depth}"
        rows = _null_safe(rows, large[depth - 1].withColumn(flag, F.lit(True)), group, "left")
        name = F.when(F.col(flag).isNull(), _cell_name(key, group[1:])).otherwise(name)
    name = F.when(F.col("_hot"), name).when(F.col(key).isNull(), NULL_CELL).otherwise("")
    flags = [f"_large_{depth}" for depth in range(1, len(large) + 1)]
    return rows.withColumn("_cell", name).drop("_hot", *flags)


def _cell_name(key: str, columns: list[str]) -> Column:
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in columns]
    return F.concat_ws("|", F.when(F.col(key).isNull(), NULL_CELL).otherwise("cell"), *parts)


def _add_parents(cells: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    parents = parents.withColumnsRenamed(
        {"_rows_before": "_parent_rows", "_amount_before": "_parent_amount"}
    )
    return (
        _null_safe(cells, parents, on, "inner")
        .withColumns({
            "_rows_before": F.col("_parent_rows") + F.col("_rows_before"),
            "_amount_before": _plus(F.col("_parent_amount"), F.col("_amount_before")),
        })
        .select(cells.columns)
    )


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a bounded right side in which NULL matches NULL."""
    right = right.withColumnsRenamed({name: f"_right_{name}" for name in on})
    same = reduce(
        lambda a, b: a & b, [left[name].eqNullSafe(right[f"_right_{name}"]) for name in on]
    )
    return left.join(F.broadcast(right), same, how).drop(*[f"_right_{name}" for name in on])


def _plus(left: Column, right: Column) -> Column:
    """Sum of two totals where NULL means no rows."""
    return F.coalesce(left + right, left, right)


def _flat(levels) -> list[str]:
    return [name for level in levels for name in level]
