"""Whole-hierarchy operators against plain Python over random structures."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quayside.operators import bom, changes, hierarchy, planning

EDGE = "parent_code string, component_code string, description string, component_type string, quantity double"


def edges(table, *pairs):
    return table(EDGE, *[(a, b, f"{b}!", "made", float(q)) for a, b, q in pairs])


def structure(seed, size=14, lines=30):
    """Lines from lower to higher numbers, some of them repeated."""
    rng = random.Random(seed)
    out = []
    for _ in range(lines):
        a, b = sorted(rng.sample(range(size), 2))
        out.append((f"N{a:02}", f"N{b:02}", rng.choice([0.5, 1, 2, 3])))
    return out


def longest_distance(lines):
    codes = {c for a, b, _ in lines for c in (a, b)}
    level = dict.fromkeys(codes, 0)
    for _ in codes:
        for a, b, _ in lines:
            level[b] = max(level[b], level[a] + 1)
    return level


def paths(lines):
    """(first, last, product of quantities, lines on it) of every path."""
    out, ahead = [], [(a, b, q, 1) for a, b, q in lines]
    while ahead:
        out += ahead
        ahead = [(a, d, q * p, n + 1) for a, b, q, n in ahead for c, d, p in lines if c == b]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_totals_and_costs(table, seed):
    lines = structure(seed)
    graph = bom.stored_edges(edges(table, *lines))
    codes = {r.product_code: r.low_level_code for r in hierarchy.low_level_codes(graph).collect()}
    assert codes == longest_distance(lines)
    upwards = {r.product_code: r.low_level_code for r in hierarchy.low_level_codes(graph, upwards=True).collect()}
    assert upwards == longest_distance([(b, a, q) for a, b, q in lines])

    every = paths(lines)
    roots = bom.root_products(graph)
    tops = {r.root_code for r in roots.collect()}
    wanted = defaultdict(lambda: [0, 0])
    for a, b, q, _ in every:
        if a in tops:
            wanted[a, b][0] += q
            wanted[a, b][1] += 1
    for doubling in (False, True):
        got = bom.material_requirements(graph, roots, doubling=doubling).collect()
        assert {(r.root_code, r.component_code): [r.quantity, r.paths] for r in got} == wanted
    one = bom.material_requirements(graph, min(tops), doubling=True)
    assert one.columns == ["component_code", "quantity", "paths"]
    assert {r.component_code: r.paths for r in one.collect()} == {b: n for (a, b), (_, n) in wanted.items() if a == min(tops)}

    own = {c: float(i) if i % 4 else None for i, c in enumerate(sorted(codes))}
    costs = table("component_code string, unit_cost double", *own.items(), ("ELSEWHERE", 1.0))
    got = {r.product_code: r for r in planning.standard_costs(graph, costs).collect()}
    assert set(got) == set(codes)
    for code, row in got.items():
        below = [(b, q) for a, b, q, _ in every if a == code]
        assert row.unit_cost == own[code]
        assert row.material_cost == pytest.approx(sum(q * (own[b] or 0) for b, q in below))
        assert row.standard_cost == pytest.approx(row.material_cost + (own[code] or 0))
        assert row.unpriced == sum(own[b] is None for b, _ in below) + (own[code] is None)


def test_doubled_lead_times(table):
    lines = structure(5)
    graph = bom.stored_edges(edges(table, *lines))
    days = table("component_code string, lead_days int", *[(f"N{i:02}", i % 5) for i in range(14) if i % 6], ("N06", None))
    roots = bom.root_products(graph)
    rows = [sorted(map(tuple, bom.lead_time(graph, roots, days, doubling=d).collect())) for d in (False, True)]
    assert rows[0] == rows[1] and rows[0]


def test_doubling_takes_few_rounds_and_refuses_cycles(table, monkeypatch):
    rounds = []
    real = bom.scratch_folder
    monkeypatch.setattr(bom, "scratch_folder", lambda spark, purpose: rounds.append(purpose) or real(spark, purpose))
    graph = edges(table, *[(f"C{i}", f"C{i + 1}", 1) for i in range(40)])
    assert bom.material_requirements(graph, "C0", doubling=True).count() == 40
    assert rounds.count("longer") == 7
    ring = edges(table, ("R", "A", 1), ("A", "B", 1), ("B", "A", 1))
    for walk in (lambda: bom.material_requirements(ring, "R", doubling=True), lambda: hierarchy.low_level_codes(ring)):
        with pytest.raises(ValueError, match="cycle"):
            walk()
    beside = edges(table, ("R", "X", 2), ("A", "B", 1), ("B", "A", 1))  # a cycle that R does not reach
    assert [r.quantity for r in bom.material_requirements(beside, "R", doubling=True).collect()] == [2]
    with pytest.raises(ValueError, match="max_depth"):
        bom.material_requirements(graph, "C0", 3, doubling=True)


def test_cycle_check_looks_below_the_frontier_only(table):
    """A walk goes on beside a cycle elsewhere; one that leads into a cycle late is refused."""
    chain = [(f"C{i}", f"C{i + 1}", 1) for i in range(30)]
    assert bom.material_requirements(edges(table, *chain, ("A", "B", 1), ("B", "A", 1)), "C0").count() == 30
    with pytest.raises(ValueError, match="cycle"):
        bom.material_requirements(edges(table, *chain, ("C30", "C25", 1)), "C0")


def test_impact_is_one_row_per_pair(table):
    lines = structure(3)
    graph = bom.stored_edges(edges(table, *lines))
    components = table("root_code string", ("N09",), ("N05",), ("N05",), ("NONE",), (None,))
    got = hierarchy.change_impact(graph, components).collect()
    fewest = {}
    for a, b, _, n in paths(lines):
        if b in ("N05", "N09"):
            fewest[b, a] = min(n, fewest.get((b, a), n))
    inner = {b for _, b, _ in lines}
    assert {(r.root_code, r.product_code): (r.level, r.is_top) for r in got} == {
        key: (n, key[1] not in inner) for key, n in fewest.items()}
    assert len(got) == len(fewest)
    ring = edges(table, ("A", "B", 1), ("B", "A", 1), ("T", "A", 1))
    got = hierarchy.change_impact(ring, table("root_code string", ("A",)))
    assert {(r.product_code, r.level) for r in got.collect()} == {("B", 1), ("T", 1), ("A", 2)}


def test_where_used_tells_components_apart(table):
    graph = edges(table, ("R", "A", 2), ("A", "S", 5), ("R", "T", 1))
    rows = bom.where_used(graph, table("root_code string", ("S",), ("T",))).collect()
    assert sorted((r.root_code, r.level, r.used_in) for r in rows) == [("S", 1, "A"), ("S", 2, "R"), ("T", 1, "R")]


def test_cycles_by_name(table):
    """Two rings that share a product, a ring behind another, one of itself, a tail on either side."""
    graph = edges(
        table, ("IN", "A", 1), ("A", "B", 1), ("B", "A", 1), ("B", "C", 1), ("C", "D", 1), ("D", "B", 1),
        ("D", "X", 1), ("X", "Y", 1), ("Y", "Z", 1), ("Z", "X", 1), ("Y", "OUT", 1), ("S", "S", 1), ("B", "B", 1),
        (None, "A", 1), ("A", None, 1))
    found = {r.product_code: r.cycle_code for r in hierarchy.cycles(graph).collect()}
    assert found == {"A": "A", "B": "A", "C": "A", "D": "A", "X": "X", "Y": "X", "Z": "X", "S": "S"}
    assert hierarchy.cycles(edges(table, ("A", "B", 1), ("B", "C", 1))).count() == 0
    assert hierarchy.cycles(edges(table)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_random_lines(table, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(32)}
    reach = set(pairs)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
        if more == reach:
            break
        reach = more
    wanted = {}
    for a in range(25):
        group = [b for b in range(25) if (a, b) in reach and (b, a) in reach]
        if group:
            wanted[f"{a:02}"] = f"{min(group):02}"
    got = hierarchy.cycles(edges(table, *[(f"{a:02}", f"{b:02}", 1) for a, b in pairs])).collect()
    assert {r.product_code: r.cycle_code for r in got} == wanted and len(got) == len(wanted)


# --- net requirements -----------------------------------------------------------------


def netted(lines, demand, stock, receipts, days, lots):
    """Item by item in the order of the levels, period by period."""
    level = longest_distance(lines)
    gross, got, out = defaultdict(Counter), defaultdict(Counter), {}
    for item, when, quantity in demand:
        gross[item][when] += quantity
        level.setdefault(item, 0)
    for item, when, quantity in receipts:
        got[item][when] += quantity
        level.setdefault(item, 0)
    for item in sorted(level, key=level.get):
        on_hand = stock.get(item, 0)
        for when in sorted({*gross[item], *got[item]}):
            on_hand += got[item][when] - gross[item][when]
            planned, lot = max(0, -on_hand), lots.get(item)
            if lot and planned:
                planned = math.ceil(planned / lot) * lot
            on_hand += planned
            if gross[item][when]:
                out[item, when] = (level[item], gross[item][when], planned)
            for a, b, q in lines:
                if a == item and planned:
                    gross[b][when - timedelta(days.get(item) or 0)] += planned * q
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_netting(table, seed):
    rng, start = random.Random(seed), date(2024, 3, 28)
    lines = [(a, b, math.ceil(q)) for a, b, q in structure(seed, 10, 18)]
    items = [f"N{i:02}" for i in range(10)] + ["ALONE"]

    def moves(count):
        return [(rng.choice(items), start + timedelta(rng.randrange(12)), rng.randrange(1, 40)) for _ in range(count)]

    demand, receipts = moves(25), moves(6) + [("STOCKED", start, 5)]
    stock = {item: rng.randrange(-5, 60) for item in items if rng.random() < 0.7}
    days = {item: rng.choice([0, 1, 4, None]) for item in items}
    lots = {item: rng.choice([0, 7, 10]) for item in items if rng.random() < 0.5} if seed != 2 else {}
    graph = edges(table, *lines)
    move = "item_code string, due_date date, quantity double"
    rows = planning.net_requirements(
        graph, table(move, *[(a, b, float(c)) for a, b, c in demand], (None, start, 1.0), ("N01", None, 1.0)),
        table("item_code string, current_stock double", *[(k, float(v)) for k, v in stock.items()], ("OTHER", 9.0)),
        table(move, *[(a, b, float(c)) for a, b, c in receipts]),
        table("component_code string, lead_days int", *days.items()),
        table("item_code string, lot_size int", *lots.items()) if lots else None,
    ).collect()
    wanted = netted(lines, demand, stock, receipts, days, lots)
    assert {(r.item_code, r.period): (r.low_level_code, r.gross_quantity, r.planned_quantity) for r in rows} == wanted
    assert len(rows) == len(wanted)
    for r in rows:
        assert r.net_quantity + r.stock_used == r.gross_quantity and r.net_quantity >= 0
    if not lots:
        assert all(r.net_quantity == r.planned_quantity for r in rows)


def test_netting_by_month_and_empty(table):
    graph = edges(table, ("R", "A", 2))
    demand = table("item_code string, due_date date, quantity double", ("R", date(2024, 5, 3), 1.0), ("R", date(2024, 5, 20), 2.0))
    none = table("item_code string, current_stock double")
    days = table("component_code string, lead_days int", ("R", 10))
    rows = planning.net_requirements(graph, demand, none, lead_days=days, grain="month").collect()
    assert {(r.item_code, r.period, r.net_quantity) for r in rows} == {
        ("R", date(2024, 5, 1), 3.0), ("A", date(2024, 4, 1), 6.0)}
    assert planning.net_requirements(graph, demand.limit(0), none).count() == 0
    assert planning.net_requirements(edges(table), demand.limit(0), none).count() == 0
    assert planning.net_requirements(edges(table), demand, none).count() == 2
    with pytest.raises(ValueError):
        planning.net_requirements(graph, demand, none, grain="year")
    ring = edges(table, ("R", "A", 1), ("A", "B", 1), ("B", "A", 1))
    with pytest.raises(ValueError, match="cycle"):
        planning.net_requirements(ring, demand, none)


def test_one_join_with_the_lines_per_level(table, spark, monkeypatch):
    """Each level reads its own share of lines: as many hand-overs as levels but the last."""
    handed = []
    real = hierarchy.by_levels

    def counted(lines, seeds, codes, settle, hand_on):
        return real(lines, seeds, codes, settle, lambda rows: handed.append(1) or hand_on(rows))

    monkeypatch.setattr(planning, "by_levels", counted)
    graph = edges(table, ("R", "A", 2), ("R", "B", 1), ("A", "C", 1), ("B", "C", 1), ("R", "C", 1))
    demand = table("item_code string, due_date date, quantity double", ("R", date(2024, 5, 3), 1.0))
    rows = planning.net_requirements(graph, demand, table("item_code string, current_stock double")).collect()
    assert len(handed) == 2 and {r.item_code: r.gross_quantity for r in rows} == {"R": 1, "A": 2, "B": 1, "C": 4}


# --- versions -------------------------------------------------------------------------


def test_changes_of_lines(table):
    before = table(EDGE, ("R", "A", "a", "made", 1.0), ("R", "A", "a", "made", 1.0), ("R", "B", "b", None, 2.0),
                   ("R", "C", "c", "made", 3.0), (None, "D", "d", "made", 1.0), ("R", None, "e", "made", None), ("S", "A", "a", "made", 1.0))
    after = table(EDGE, ("R", "A", "a", "made", 1.0), ("R", "B", "b", "made", 2.0), ("R", "C", "c", "made", 3.0),
                  (None, "D", "d", "made", 1.0), ("R", None, "e", "made", 4.0), ("S", "A", "a", "made", 1.0),
                  ("S", "B", "b", "made", 5.0), ("S", "B", "b", "made", 5.0))
    rows = changes.structure_changes(before, after).collect()
    assert Counter((r.change, r.parent_code, r.component_code, r.quantity_before, r.quantity_after) for r in rows) == Counter([
        ("removed", "R", "A", 1.0, None), ("changed", "R", "B", 2.0, 2.0), ("changed", "R", None, None, 4.0),
        ("added", "S", "B", None, 5.0), ("added", "S", "B", None, 5.0)])
    assert changes.structure_changes(before, before).count() == 0
    assert {r.change for r in changes.structure_changes(before, before.limit(0)).collect()} == {"removed"}


def test_touched_products(table):
    before = edges(table, ("TOP", "R", 1), ("R", "A", 1), ("OLD", "R", 1), ("X", "Y", 1))
    after = edges(table, ("TOP", "R", 1), ("R", "A", 2), ("NEW", "R", 1), ("X", "Y", 1))
    rows = changes.touched_products(changes.structure_changes(before, after), before, after).collect()
    assert {(r.changed_code, r.product_code, r.level, r.is_top) for r in rows} == {
        ("R", "R", 0, False), ("R", "TOP", 1, True), ("R", "OLD", 1, True), ("R", "NEW", 1, True),
        ("OLD", "OLD", 0, True), ("NEW", "NEW", 0, True)}
    assert changes.touched_products(changes.structure_changes(before, before), before, before).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_of_random_versions(table, seed):
    rng = random.Random(seed)

    def version():
        return [("P" + rng.choice("ab"), "C" + rng.choice("abc"), rng.choice("xy"), "made", float(rng.randrange(3))) for _ in range(40)]

    old, new = version(), version()
    rows = changes.structure_changes(table(EDGE, *old), table(EDGE, *new)).collect()
    gone, come = Counter(old) - Counter(new), Counter(new) - Counter(old)
    assert Counter((r.parent_code, r.component_code, r.description_before, "made", r.quantity_before)
                   for r in rows if r.change != "added") == gone
    assert Counter((r.parent_code, r.component_code, r.description_after, "made", r.quantity_after)
                   for r in rows if r.change != "removed") == come
    lines = Counter(k[:2] for k in gone.elements()), Counter(k[:2] for k in come.elements())
    assert Counter((r.parent_code, r.component_code) for r in rows if r.change == "changed") == lines[0] & lines[1]


def test_intermediate_tables_go_with_their_scope(table, spark, tmp_path):
    from pathlib import Path

    from quayside.session import scratch_scope

    graph = edges(table, ("R", "A", 2), ("A", "B", 3))
    with scratch_scope(spark) as folder:
        bom.material_requirements(graph, "R").write.parquet(str(tmp_path / "kept"))
        with scratch_scope(spark) as inner:
            hierarchy.low_level_codes(graph).collect()
            assert inner.startswith(folder) and any(Path(inner).iterdir())
        assert not Path(inner).exists() and any(Path(folder).iterdir())
    assert not Path(folder).exists()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2
    with pytest.raises(ValueError), scratch_scope(spark) as folder:
        bom.explode_bom(graph, "R", max_depth=0)
    assert not Path(folder).exists()


def test_shuffles_of_levels_are_gone(spark, table):
    """They added up over all levels, as nothing told Spark that they were not needed any more."""
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    graph = edges(table, *[(f"N{i}", f"N{i + 1}", 1) for i in range(6)])
    demand = table("item_code string, due_date date, quantity double", ("N0", date(2024, 3, 1), 2.0))
    stock = table("item_code string, current_stock double", ("N3", 1.0))
    before = tracker.shuffleStatuses().size()
    rows = planning.net_requirements(graph, demand, stock)
    assert tracker.shuffleStatuses().size() <= before + 8
    assert {(r.item_code, r.net_quantity) for r in rows.collect()} == {
        (f"N{i}", 2.0 if i < 3 else 1.0) for i in range(7)}
