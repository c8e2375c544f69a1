"""Multi-level bill of materials.

The walks run one level per Spark job. Each level is written to the shared scratch folder and
the next one starts from there, so lineage stays one level long, a lost executor costs no
earlier level, and only the columns the next join needs are read back.

Codes compress so well that the size of a file says little about the memory its rows take, and Spark's size
check would collect millions of them on the driver. Joins here say what they want: rows counted to be
few are broadcast (:func:`sized`), all others are merged.

``roots`` is one product code, or a DataFrame with a column ``root_code``: the results then have
that column too, and all roots share one walk. Edges that serve several walks are stored once with
:func:`stored_edges`.

The explosion ends at a depth, as its report does. The walks that add up (requirements, lead time,
where-used) have no limit unless one is given, and raise an error where a cycle would never end.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import text
from quayside.session import PACKED, scratch_folder, shuffles_freed, sized, stored
from quayside.sources.tables import BomTables

MAX_DEPTH = 20
CYCLE_CHECK = 12  # levels after which an unlimited walk looks for cycles
FIRST_LEVELS = 6  # of a recursive explosion, before its products are walked on from, each once
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
ROUNDS = 64  # doubling beyond this many rounds would need paths of 2**64 products


class StoredEdges(NamedTuple):
    """Edges in the shared folder; the caller removes ``folder`` when done with them."""

    rows: DataFrame
    folder: str


Edges = DataFrame | StoredEdges
Step = Callable[[DataFrame, DataFrame], DataFrame]


def bom_edges(tables: BomTables) -> DataFrame:
    """One row per line of an active production structure: parent code to part number."""
    active = tables.structures.where((F.col("structure_type") == 0) & (F.col("is_active") == 1))
    return (
        active.join(tables.products.hint("merge"), "product_id")
        .join(tables.components.hint("merge"), "structure_id")
        .select(
            F.col("product_code").alias("parent_code"),
            F.col("part_number").alias("component_code"),
            "description", "component_type",
            F.col("quantity_required").alias("quantity"),
        )
    )


def _store(rows: DataFrame, path: str) -> int:
    """Write rows and return their number, counted on the way."""
    seen = Observation()
    with shuffles_freed(rows.sparkSession):
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", PACKED).parquet(path)
    return seen.get["rows"]


def stored_edges(edges: DataFrame) -> StoredEdges:
    """Edges written once, for any number of walks."""
    folder = scratch_folder(edges.sparkSession, "bom-edges")
    _store(edges, folder)
    return StoredEdges(edges.sparkSession.read.schema(edges.schema).parquet(folder), folder)


def _rows(edges: Edges) -> DataFrame:
    return edges.rows if isinstance(edges, StoredEdges) else edges


def root_products(edges: Edges) -> DataFrame:
    """``root_code`` of the products that are no component of another."""
    rows = _rows(edges)
    parents = rows.select(F.col("parent_code").alias("root_code")).distinct()
    return parents.join(rows.hint("merge"), parents["root_code"] == rows["component_code"], "left_anti")


def _first_edges(edges: DataFrame, roots: str | DataFrame) -> DataFrame:
    if isinstance(roots, str):
        return edges.where(F.col("parent_code") == roots).withColumn("root_code", F.lit(roots))
    codes = roots.select("root_code").distinct().hint("merge")
    return edges.join(codes, edges["parent_code"] == codes["root_code"])


def _of_roots(rows: DataFrame, roots: str | DataFrame) -> DataFrame:
    return rows.drop("root_code") if isinstance(roots, str) else rows


def _walk(
    edges: Edges, start: Callable[[DataFrame], DataFrame], step: Step, max_depth: int | None
) -> DataFrame:
    """Levels of a walk, with their ``level``, until one is empty or ``max_depth`` is reached."""
    if max_depth is not None and max_depth < 1:
        raise ValueError(f"max_depth must be at least 1, not {max_depth}")
    spark = _rows(edges).sparkSession
    edges = edges.rows if isinstance(edges, StoredEdges) else stored(edges, "bom-edges")
    folder = scratch_folder(spark, "bom-levels")
    rows = start(edges)
    schema = rows.schema
    level = 1
    while True:
        path = f"{folder}/level={level}"
        count = _store(rows, path)
        if count == 0 or level == max_depth:
            break
        frontier = sized(spark.read.schema(schema).parquet(path), count)
        if max_depth is None and level == CYCLE_CHECK:
            _refuse_cycles(frontier, edges)
        rows = step(frontier, edges)
        level += 1
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("level", T.IntegerType())])).parquet(folder)


def _reached(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """``product_code`` of all components at the frontier and below, each once."""
    spark = edges.sparkSession
    folder = scratch_folder(spark, "bom-reached")
    found = frontier.select(F.col("component_code").alias("product_code")).distinct()
    schema, level = found.schema, 0
    while count := _store(found, f"{folder}/level={level}"):
        found = sized(spark.read.schema(schema).parquet(f"{folder}/level={level}"), count)
        below = found.join(edges, found["product_code"] == edges["parent_code"]).select(
            F.col("component_code").alias("product_code"))
        found = below.distinct().join(spark.read.schema(schema).parquet(folder).hint("merge"), "product_code", "left_anti")
        level += 1
    return spark.read.schema(schema).parquet(folder)


def _refuse_cycles(frontier: DataFrame, edges: DataFrame) -> None:
    """Error if what the walk has reached leads into a cycle; a deep hierarchy is none.

    Only products below the frontier are looked at, however large the rest of the hierarchy is.
    """
    reached = _reached(frontier, edges)
    own = edges.join(reached.hint("merge"), edges["parent_code"] == reached["product_code"], "left_semi")
    first = endless_products(own).first()
    if first is not None:
        raise ValueError(f"the hierarchy has a cycle below {first[0]}; see endless_products, or give max_depth")


def _next_edges(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges below the frontier; its columns come with the prefix ``above_``.

    A frontier counted to be small is broadcast; otherwise the sides are merged, and Spark splits skewed
    partitions of either side.
    """
    above = frontier.toDF(*[f"above_{name}" for name in frontier.columns])
    return above.join(edges, above["above_component_code"] == edges["parent_code"]).withColumnRenamed(
        "above_root_code", "root_code"
    )


def _factor(quantity: Column) -> Column:
    """Quantities multiply as doubles: no digits are cut on the way down."""
    return quantity.cast("double")


def explode_bom(
    edges: Edges,
    roots: str | DataFrame,
    max_depth: int | None = MAX_DEPTH,
    extended: bool = False,
    path_parts: bool = False,
    path_limit: int | None = text.PATH_LIMIT,
) -> DataFrame:
    """All components below the roots, one row per path, down to ``max_depth`` levels.

    A shared component appears once per path that leads to it. ``extended`` adds the quantity
    needed for one root, multiplied down the path. ``path_parts`` adds the path as an array,
    which sorts siblings before children whatever characters the codes hold. ``path_limit`` cuts
    the path; None keeps it whole.
    """
    line = ["root_code", "parent_code", "component_code", "description", "component_type", "quantity"]

    def start(edges):
        extra = []
        if extended:
            extra.append(_factor(F.col("quantity")).alias("extended_quantity"))
        if path_parts:
            extra.append(F.array("component_code").alias("path_parts"))
        path = text.start_path(F.col("component_code"), path_limit).alias("path")
        return _first_edges(edges, roots).select(*line, path, *extra)

    def step(frontier, edges):
        needed = ("root_code", "component_code", "path", "extended_quantity", "path_parts")
        below = _next_edges(frontier.select(*[c for c in frontier.columns if c in needed]), edges)
        extra = []
        if extended:
            quantity = F.col("above_extended_quantity") * _factor(F.col("quantity"))
            extra.append(quantity.alias("extended_quantity"))
        if path_parts:
            parts = F.array_append("above_path_parts", F.col("component_code"))
            extra.append(parts.alias("path_parts"))
        path = text.extend_path(F.col("above_path"), F.col("component_code"), path_limit).alias("path")
        return below.select(*line, path, *extra)

    return _of_roots(_walk(edges, start, step, max_depth), roots)


def _recursive_walk(edges: DataFrame, starts: str | DataFrame, depth: int) -> DataFrame:
    """Paths below the starts as one recursive query, stored; a DataFrame of starts (``code``) gives theirs as ``top_code``.

    Spark fails such a query beyond ``spark.sql.cteRecursionRowLimit`` rows, a guard against walks without end; the
    depth ends this one, so the limit is lifted while the rows are written to the shared folder.
    """
    spark = edges.sparkSession
    one = isinstance(starts, str)
    first = "WHERE first.parent_code = :root" if one else "JOIN {starts} AS start ON first.parent_code = start.code"
    top, kept = ("", "") if one else ("start.code AS top_code, ", "walk.top_code, ")
    walk = spark.sql(
        f"""
        WITH RECURSIVE walk MAX RECURSION LEVEL {depth + 1} AS (
            SELECT {top}first.*, left(first.component_code, {text.PATH_LIMIT}) AS path, 1 AS level
            FROM {{edges}} AS first {first}
            UNION ALL
            SELECT /*+ MERGE(edge) */ {kept}edge.*,
                   left(concat(walk.path, :separator, edge.component_code), {text.PATH_LIMIT}),
                   walk.level + 1
            FROM walk JOIN {{edges}} AS edge ON edge.parent_code = walk.component_code
            WHERE walk.level < :depth
        )
        SELECT * FROM walk
        """,
        args={"separator": text.PATH_SEPARATOR, "depth": depth, **({"root": starts} if one else {})},
        edges=edges, **({} if one else {"starts": starts}),
    )
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, -1)
    try:
        return stored(walk, "bom-recursive")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def explode_bom_recursive(edges: Edges, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """:func:`explode_bom` by recursive queries: quicker on small hierarchies.

    The edges are stored first, so that their joins are not repeated per level. Spark keeps the rows of all levels of
    a recursive query as shuffle files until its end, and most rows are in the last levels. So one query walks the first
    ``FIRST_LEVELS``, and where they do not end the hierarchy, a second one walks on from each product found there, once
    however many paths lead to it; its paths are put behind those paths as the result is read.
    """
    if max_depth < 1:
        raise ValueError(f"max_depth must be at least 1, not {max_depth}")
    rows = (edges if isinstance(edges, StoredEdges) else stored_edges(edges)).rows
    depth = min(int(max_depth), FIRST_LEVELS)
    above = _recursive_walk(rows, root, depth)
    last = above.where(F.col("level") == depth)
    if depth == max_depth or last.isEmpty():
        return above
    starts = stored(last.select(F.col("component_code").alias("code")).distinct(), "bom-starts")
    below = _recursive_walk(rows, starts.hint("merge"), int(max_depth) - depth)
    ends = last.select(F.col("component_code").alias("top_code"), F.col("path").alias("top_path"))
    path = F.concat("top_path", F.lit(text.PATH_SEPARATOR), "path")
    further = below.join(ends.hint("merge"), "top_code").select(
        *rows.columns, F.left(path, F.lit(text.PATH_LIMIT)).alias("path"), (F.col("level") + depth).alias("level"))
    return above.unionByName(further)


def of_type(components: DataFrame, component_type: str) -> DataFrame:
    """Components of one type, chosen after the walk so that their parents still lead to them."""
    return components.where(F.col("component_type") == component_type)


def path_totals(
    edges: DataFrame, roots: str | DataFrame, join: dict[str, Callable[[Column, Column], Column]], add: dict[str, Column],
) -> DataFrame:
    """Values of all paths from each root to each component, added up, in rounds that double their length.

    ``edges`` have parent_code, component_code and the values; ``join`` gives a value of two paths in a row from
    the values of both, ``add`` the value of paths with the same ends, as an aggregate. After ``k`` rounds all
    paths of up to 2**k lines are in. The pairs of products that are 2**k lines apart are kept
    beside the result: for hierarchies with very many of them and few roots a walk by levels is better.
    """
    keys, values = ["parent_code", "component_code"], list(join)

    def added(rows):
        return rows.groupBy(*keys).agg(*[add[value].alias(value) for value in values])

    def joined(first, second):
        left = first.select(F.col("parent_code"), F.col("component_code").alias("middle"),
                            *[F.col(value).alias(f"first_{value}") for value in values])
        right = second.withColumnRenamed("parent_code", "middle").hint("merge")
        return left.join(right, "middle").select(
            *keys, *[join[value](F.col(f"first_{value}"), F.col(value)).alias(value) for value in values])

    spark = edges.sparkSession
    steps = stored(added(edges.select(*keys, *values)), "steps")
    if isinstance(roots, str):
        total = steps.where(F.col("parent_code") == roots)
    else:
        codes = roots.select(F.col("root_code").alias("parent_code")).distinct()
        total = steps.join(codes.hint("merge"), "parent_code", "left_semi")
    total = stored(total.select(*keys, *values), "totals")
    products = None
    for number in range(ROUNDS):
        path = scratch_folder(spark, "longer")
        longer = joined(total, steps)
        if _store(longer, path) == 0:
            return total.withColumnRenamed("parent_code", "root_code")
        if products is None:
            products = edges.select("parent_code").distinct().count()
        if 2**number > products:
            break
        total = stored(added(total.unionByName(spark.read.schema(longer.schema).parquet(path))), "totals")
        steps = stored(added(joined(steps, steps)), "steps")
    raise ValueError("the hierarchy has a cycle below the roots; see cycles")


def material_requirements(
    edges: Edges, roots: str | DataFrame, max_depth: int | None = None, doubling: bool = False
) -> DataFrame:
    """Total quantity per component for one of each root, over all paths, and the number of paths.

    Paths that meet in a component are added up at every level, so a level has at most one row
    per root and component however many paths there are. ``doubling`` takes rounds of
    :func:`path_totals` in place of levels, which deep hierarchies need fewer of.
    """
    if doubling:
        if max_depth is not None:
            raise ValueError("max_depth ends a walk by levels; doubling takes whole paths")
        steps = _rows(edges).select(
            "parent_code", "component_code", _factor(F.col("quantity")).alias("quantity"), F.lit(1).cast("bigint").alias("paths"))
        times = {"quantity": operator.mul, "paths": operator.mul}
        sums = {"quantity": F.sum("quantity"), "paths": F.sum("paths")}
        return _of_roots(path_totals(steps, roots, times, sums), roots)

    def totals(rows):
        return rows.groupBy("root_code", "component_code").agg(
            F.sum("quantity").alias("quantity"), F.sum("paths").alias("paths")
        )

    def start(edges):
        return totals(_first_edges(edges, roots).select(
            "root_code", "component_code", _factor(F.col("quantity")).alias("quantity"),
            F.lit(1).cast("bigint").alias("paths"),
        ))

    def step(frontier, edges):
        return totals(_next_edges(frontier, edges).select(
            "root_code", "component_code",
            (F.col("above_quantity") * _factor(F.col("quantity"))).alias("quantity"),
            F.col("above_paths").alias("paths"),
        ))

    return _of_roots(totals(_walk(edges, start, step, max_depth)), roots)


def cost_rollup(requirements: DataFrame, costs: DataFrame) -> DataFrame:
    """Unit and extended cost of each required component; ``costs`` has one row per code.

    A component without a cost stays, with NULL for both.
    """
    return requirements.join(costs.hint("merge"), "component_code", "left").withColumn(
        "extended_cost", F.col("quantity") * F.col("unit_cost")
    )


def total_cost(costed: DataFrame) -> DataFrame:
    """Cost of all components per root, and how many of them have no cost in it."""
    by = [c for c in ("root_code",) if c in costed.columns]
    return costed.groupBy(*by).agg(
        F.coalesce(F.sum("extended_cost"), F.lit(0.0)).alias("total_cost"),
        F.count_if(F.col("unit_cost").isNull()).alias("unpriced"),
    )


def where_used(edges: Edges, component: str | DataFrame, max_depth: int | None = None) -> DataFrame:
    """All products above ``component``, one row per path upwards.

    ``used_in`` is the product that uses the last one on the path, ``quantity`` how many
    of that it takes. A DataFrame of components (``root_code``) gives that column, too;
    :func:`quayside.operators.hierarchy.change_impact` gives one row per pair, not per path.
    """
    upwards = _rows(edges).select(
        F.col("component_code").alias("parent_code"),
        F.col("parent_code").alias("component_code"),
        "description", "component_type", "quantity",
    )
    used = explode_bom(upwards, component, max_depth)
    return used.select(
        *[c for c in ("root_code",) if c in used.columns], "level", F.col("component_code").alias("used_in"), F.col("parent_code").alias("uses"),
        "quantity", "path",
    )


def lead_time(
    edges: Edges, roots: str | DataFrame, lead_days: DataFrame, max_depth: int | None = None,
    default_days: int = 0, doubling: bool = False,
) -> DataFrame:
    """Longest sum of lead days from the root down to each component, over all paths.

    ``lead_days`` has one row per ``component_code``; a component it does not list, or lists
    without days, takes ``default_days`` and has ``listed`` false. Only the longest path into a
    component is followed on from each level. ``doubling`` is that of :func:`material_requirements`.
    """
    days = F.coalesce(F.col("lead_days").cast("bigint"), F.lit(default_days).cast("bigint"))
    timed = _rows(edges).join(lead_days.hint("merge"), "component_code", "left").select(
        "parent_code", "component_code", days.alias("days"),
        F.col("lead_days").isNotNull().alias("listed"),
    )

    if doubling:
        if max_depth is not None:
            raise ValueError("max_depth ends a walk by levels; doubling takes whole paths")
        in_a_row = {"days": operator.add, "listed": lambda _, listed: listed}
        totals = path_totals(timed, roots, in_a_row, {"days": F.max("days"), "listed": F.bool_and("listed")})
        return _of_roots(totals.withColumnRenamed("days", "longest_days"), roots)

    def longest(rows):
        return rows.groupBy("root_code", "component_code").agg(
            F.max("days").alias("days"), F.bool_and("listed").alias("listed")
        )

    def start(edges):
        return longest(_first_edges(edges, roots))

    def step(frontier, edges):
        days = F.col("above_days") + F.col("days")
        below = _next_edges(frontier, edges)
        return longest(below.select("root_code", "component_code", days.alias("days"), "listed"))

    reached = _walk(timed, start, step, max_depth)
    return _of_roots(longest(reached).withColumnRenamed("days", "longest_days"), roots)


def longest_lead_time(lead_times: DataFrame) -> DataFrame:
    """Lead days of the slowest component per root, and how many components are not listed."""
    by = [c for c in ("root_code",) if c in lead_times.columns]
    return lead_times.groupBy(*by).agg(
        F.max("longest_days").alias("longest_days"), F.count_if(~F.col("listed")).alias("unlisted")
    )


def endless_products(edges: Edges) -> DataFrame:
    """Products whose explosion never ends: on a cycle or above one.

    Products all of whose components end are set aside, round by round, until none is left to
    set aside. The rounds are at most one more than the levels of the deepest finite branch.
    """
    lines = stored(_rows(edges).select("parent_code", "component_code"), "bom-lines")
    spark = lines.sparkSession
    left = lines.select(F.col("parent_code").alias("product_code")).distinct()
    schema = left.schema
    before = None
    while True:
        path = scratch_folder(spark, "bom-open")
        count = _store(left, path)
        left = spark.read.schema(schema).parquet(path)
        if count in (0, before):
            return left
        before = count
        left = sized(left, count)
        still = lines.join(left, lines["component_code"] == left["product_code"], "left_semi")
        left = still.select(F.col("parent_code").alias("product_code")).distinct()
