from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quayside import session
from quayside.functions import text
from quayside.operators import bom
from quayside.plans import reports
from quayside.sources.tables import BomTables

EDGE = "parent_code string, component_code string, description string, component_type string, quantity double"


def edges(table, *pairs):
    return table(EDGE, *[(a, b, f"{b}!", "made", float(q)) for a, b, q in pairs])


@pytest.fixture
def tree(table):
    """The worked example: four components below one product, plus what must be ignored."""
    products = table(
        "product_id long, product_code string",
        (1, "ROOT"), (2, "COMP-001"), (3, "COMP-002"), (4, "OTHER"),
    )
    structures = table(
        "structure_id long, product_id long, structure_type int, is_active int",
        (10, 1, 0, 1), (20, 2, 0, 1), (30, 3, 0, 1), (40, 4, 0, 1), (11, 1, 0, 0), (12, 1, 1, 1),
    )
    components = table(
        "structure_id long, part_number string, description string, component_type string,"
        " quantity_required double",
        (10, "COMP-001", "Main Assembly", "made", 1.0),
        (20, "COMP-002", "Sub-assembly A", "made", 2.0),
        (20, "COMP-004", "Sub-assembly B", "made", 1.0),
        (30, "COMP-003", "Part X", "bought", 4.0),
        (40, "COMP-009", "Elsewhere", "bought", 1.0),
        (11, "OLD", "inactive", "bought", 1.0),
        (12, "DRAFT", "other type", "bought", 1.0),
    )
    return BomTables(products, structures, components)


def test_report_of_worked_example(tree):
    rows = [tuple(r) for r in reports.bom_report(tree, "ROOT").collect()]
    assert rows == [
        (1, "COMP-001", "Main Assembly", 1.0, "COMP-001"),
        (2, "  COMP-002", "Sub-assembly A", 2.0, "COMP-001 -> COMP-002"),
        (3, "    COMP-003", "Part X", 4.0, "COMP-001 -> COMP-002 -> COMP-003"),
        (2, "  COMP-004", "Sub-assembly B", 1.0, "COMP-001 -> COMP-004"),
    ]
    assert reports.bom_report(tree, "ROOT").columns == ["Level", "Component", "Description", "Qty", "FullPath"]


@pytest.mark.parametrize("walk", [bom.explode_bom, bom.explode_bom_recursive])
def test_shared_component_once_per_path(table, walk):
    graph = edges(table, ("R", "A", 2), ("R", "B", 3), ("A", "S", 5), ("B", "S", 7), ("S", "T", 1))
    rows = walk(graph, "R").select("level", "parent_code", "component_code", "path").collect()
    assert sorted(map(tuple, rows)) == [
        (1, "R", "A", "A"), (1, "R", "B", "B"),
        (2, "A", "S", "A -> S"), (2, "B", "S", "B -> S"),
        (3, "S", "T", "A -> S -> T"), (3, "S", "T", "B -> S -> T"),
    ]


@pytest.mark.parametrize("walk", [bom.explode_bom, bom.explode_bom_recursive])
def test_cycle_ends_at_depth(table, walk):
    graph = edges(table, ("A", "B", 1), ("B", "A", 1))
    rows = walk(graph, "A").collect()
    assert sorted(r.level for r in rows) == list(range(1, 21))
    assert max(r.level for r in walk(graph, "A", max_depth=3).collect()) == 3


@pytest.mark.parametrize("walk", [bom.explode_bom, bom.explode_bom_recursive])
def test_path_is_cut_and_unknown_root_is_empty(table, walk):
    long = "X" * 3000
    graph = edges(table, ("R", long, 1), (long, long + "2", 1))
    lengths = sorted(len(r.path) for r in walk(graph, "R").collect())
    assert lengths == [3000, text.PATH_LIMIT]
    assert walk(graph, "NONE").count() == 0


def test_whole_paths_and_their_order(tree, table):
    long = "X" * 3000
    graph = edges(table, ("R", long, 1), (long, long + "2", 1))
    assert max(len(r.path) for r in bom.explode_bom(graph, "R", path_limit=None).collect()) == 6005
    assert [r["Level"] for r in reports.bom_report(tree, "ROOT", path_limit=None).collect()] == [1, 2, 3, 2]


def test_repeated_lines_stay_apart(table):
    graph = edges(table, ("R", "A", 1), ("R", "A", 2), ("A", "B", 1))
    assert bom.explode_bom(graph, "R").count() == 4


def test_array_path_sorts_children_behind_their_parent(table):
    graph = edges(table, ("R", "A", 1), ("R", "A !", 1), ("A", "C", 1))
    rows = bom.explode_bom(graph, "R", path_parts=True)
    by_text = [r.path for r in rows.orderBy("path").collect()]
    by_parts = [r.path for r in rows.orderBy("path_parts").collect()]
    assert by_text == ["A", "A !", "A -> C"]
    assert by_parts == ["A", "A -> C", "A !"]


def test_requirements_equal_path_totals(table):
    graph = edges(table, ("R", "A", 2), ("R", "B", 3), ("A", "S", 5), ("B", "S", 7), ("S", "T", 0.5), ("R", "T", 1))
    paths = bom.explode_bom(graph, "R", extended=True)
    by_path = paths.groupBy("component_code").agg(
        F.sum("extended_quantity").alias("quantity"), F.count(F.lit(1)).alias("paths")
    )
    total = bom.material_requirements(graph, "R")
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, by_path.collect()))
    needed = {r.component_code: float(r.quantity) for r in total.collect()}
    assert needed == {"A": 2, "B": 3, "S": 31, "T": 16.5}


def test_cost_rollup_and_type_filter(table):
    graph = edges(table, ("R", "A", 2), ("A", "B", 3))
    costs = table("component_code string, unit_cost double", ("A", 1.5), ("B", 0.25))
    rows = bom.cost_rollup(bom.material_requirements(graph, "R"), costs).collect()
    assert {r.component_code: float(r.extended_cost) for r in rows} == {"A": 3.0, "B": 1.5}
    assert bom.of_type(bom.explode_bom(graph, "R"), "bought").count() == 0


def test_where_used(table):
    graph = edges(table, ("R", "A", 2), ("R", "B", 3), ("A", "S", 5), ("B", "S", 7))
    rows = bom.where_used(graph, "S").collect()
    assert sorted((r.level, r.used_in, r.uses, r.quantity, r.path) for r in rows) == [
        (1, "A", "S", 5.0, "A"), (1, "B", "S", 7.0, "B"),
        (2, "R", "A", 2.0, "A -> R"), (2, "R", "B", 3.0, "B -> R"),
    ]


def test_lead_time_follows_the_longest_path(table):
    graph = edges(table, ("R", "A", 1), ("R", "B", 1), ("A", "S", 1), ("B", "S", 1), ("R", "S", 1))
    days = table("component_code string, lead_days int", ("A", 2), ("B", 9), ("S", 1))
    rows = bom.lead_time(graph, "R", days).collect()
    assert {r.component_code: r.longest_days for r in rows} == {"A": 2, "B": 9, "S": 10}


def test_component_without_lead_time_or_cost_stays(table):
    graph = edges(table, ("R", "A", 1), ("A", "B", 2), ("B", "C", 1))
    times = bom.lead_time(graph, "R", table("component_code string, lead_days int", ("B", 4), ("C", None)))
    assert sorted(map(tuple, times.collect())) == [("A", 0, False), ("B", 4, True), ("C", 4, False)]
    assert tuple(bom.longest_lead_time(times).first()) == (4, 2)
    costed = bom.cost_rollup(bom.material_requirements(graph, "R"), table("component_code string, unit_cost double", ("B", 3.0)))
    assert sorted((r.component_code, r.extended_cost) for r in costed.collect()) == [("A", None), ("B", 6.0), ("C", None)]
    assert tuple(bom.total_cost(costed).first()) == (6.0, 2)


def test_totals_have_no_depth_limit_and_no_rounding(table):
    graph = edges(table, *[(f"N{i}", f"N{i + 1}", 0.01) for i in range(25)])
    needed = {r.component_code: r.quantity for r in bom.material_requirements(graph, "N0").collect()}
    assert len(needed) == 25 and needed["N4"] == pytest.approx(1e-8)
    assert bom.where_used(graph, "N25").count() == 25
    assert bom.material_requirements(graph, "N0", max_depth=3).count() == 3
    assert bom.explode_bom(graph, "N0").count() == 20


def test_cycles_and_bad_depths_are_refused(table):
    graph = edges(table, ("R", "A", 1), ("A", "B", 1), ("B", "A", 1))
    for walk in (lambda: bom.material_requirements(graph, "R"), lambda: bom.where_used(graph, "A")):
        with pytest.raises(ValueError, match="cycle"):
            walk()
    for walk in (bom.explode_bom, bom.explode_bom_recursive):
        with pytest.raises(ValueError, match="max_depth"):
            walk(graph, "R", max_depth=0)


def test_many_roots_in_one_walk(table):
    graph = edges(table, ("R", "A", 2), ("Q", "A", 3), ("A", "B", 5))
    stored = bom.stored_edges(graph)
    roots = bom.root_products(stored)
    assert {r.root_code for r in roots.collect()} == {"R", "Q"}
    rows = bom.material_requirements(stored, roots).collect()
    assert {(r.root_code, r.component_code): r.quantity for r in rows} == {
        ("R", "A"): 2, ("R", "B"): 10, ("Q", "A"): 3, ("Q", "B"): 15}
    for root in ("R", "Q"):
        one = bom.explode_bom(stored, root).select("component_code", "path", "level").collect()
        every = bom.explode_bom(stored, roots).where(F.col("root_code") == root).select("component_code", "path", "level").collect()
        assert sorted(one) == sorted(every)


def test_endless_products(table):
    graph = edges(
        table, ("TOP", "A", 1), ("A", "B", 1), ("B", "A", 1), ("B", "X", 1), ("P", "Q", 1), ("Q", "X", 1)
    )
    assert {r.product_code for r in bom.endless_products(graph).collect()} == {"TOP", "A", "B"}
    assert bom.endless_products(edges(table, ("P", "Q", 1), ("Q", "X", 1))).count() == 0


def test_recursive_walk_is_whole_beyond_the_row_limit_of_the_session(spark, table):
    edges = table(
        "parent_code string, component_code string, description string, component_type string, quantity double",
        *[("A", f"B{i}", "", "", 1.0) for i in range(9)], *[(f"B{i}", "C", "", "", 1.0) for i in range(9)],
    )
    spark.conf.set(bom.ROW_LIMIT, 5)
    try:
        rows = bom.explode_bom_recursive(edges, "A")
        assert spark.conf.get(bom.ROW_LIMIT) == "5"
        assert rows.count() == bom.explode_bom(edges, "A").count() == 18
    finally:
        spark.conf.unset(bom.ROW_LIMIT)


def test_recursive_walk_goes_on_once_from_a_product_of_many_paths(spark, table):
    """Two lines from each product to the next: 2**9 paths to the last, of which the queries themselves hold few."""
    lines = [(f"P{i}", f"P{i + 1}", f"d{n}", "T", float(n + 1)) for i in range(9) for n in range(2)]
    edges = table(EDGE, *lines)
    with session.scratch_scope(spark) as folder:
        found = sorted(map(tuple, bom.explode_bom_recursive(edges, "P0").select(*edges.columns, "path", "level").collect()))
        held = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(
            *map(str, Path(folder.removeprefix("file:")).glob("bom-recursive-*"))).count()
        assert found == sorted(map(tuple, bom.explode_bom(edges, "P0").select(*edges.columns, "path", "level").collect()))
    assert len(found) == sum(2**n for n in range(1, 10)) and held < len(found) / 4
