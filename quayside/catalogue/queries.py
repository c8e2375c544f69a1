"""The registered queries: each job and operator over the whole of the given tables.

Integers are widened and money is rounded at the end, so that results compare exactly with
those of another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators import allocation, bom, changes, forecast, hierarchy, planning, quality
from quayside.operators.skew import hot_keys
from quayside.plans import reports
from quayside.session import scratch_folder, stored
from quayside.sources import fixtures, layout

Query = Callable[[SparkSession, str], DataFrame]

SPLIT_ROWS = 30  # so few that the test data has items to split and items to leave whole
WHERE_USED = "P0000199"
COMPONENT_TYPE = "ECONOMY"


def _comparable(rows: DataFrame, *money: str, digits: int = 4) -> DataFrame:
    columns = []
    for field in rows.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        if field.name in money:
            column = F.round(column, digits)
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Position of each row as the report has it, with its sort keys; partitions are in order, and so are their rows.

    There is one count per partition of the sort, so these are broadcast and the rows stay where they are.
    """
    placed = rows.select(*[F.col(f"`{key}`") for key in keys]).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(2**33 - 1)
    placed = stored(placed.withColumns({"_part": part, "_place": place}).drop("_id"), "ordered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return _comparable(placed.join(F.broadcast(counts), "_part").select(
        (F.col("_before") + F.col("_place") + 1).alias("position"), *[F.col(f"`{key}`") for key in keys]))


# --- allocation -----------------------------------------------------------------------


def _stock(tables):
    return allocation.stock_levels(tables.movements, tables.items)


def _allocated(tables):
    return allocation.waterfall_allocate(
        allocation.open_lines(tables), _stock(tables), allocation.hot_items(tables)
    )


def nominal_dedupe(spark, folder):
    return _comparable(allocation.dedupe_accounts(fixtures.allocation(spark, folder).accounts))


def stock_levels(spark, folder):
    return _stock(fixtures.allocation(spark, folder))


_OPEN_COLUMNS = [
    "line_id", "line_number", "document_no", "customer_document_no", "customer_code",
    "customer_name", "item_code", "item_description", "quantity", "despatched_quantity",
    "invoiced_quantity", "due_quantity", "allocated_quantity", "total_stock", "unit_price",
    "line_value", "currency", "currency_id", "base_rate", "exchange_rate", "document_date",
    "requested_date", "promised_date", "source_document_no", "line_type", "document_type",
    "document_status", "account_number", "account_name",
]


def _hot(tables, split):
    return allocation.hot_items(tables, SPLIT_ROWS) if split else allocation.hot_items(tables)


def outstanding_lines(spark, folder, remap_duplicates=False, split=False):
    tables = fixtures.allocation(spark, folder)
    lines = allocation.open_lines(tables, remap_duplicates)
    stocked = allocation.with_stock(lines, _stock(tables), _hot(tables, split))
    return _comparable(stocked.select(_OPEN_COLUMNS))


def outstanding_lines_split(spark, folder):
    return outstanding_lines(spark, folder, split=True)


def outstanding_lines_remapped(spark, folder):
    return outstanding_lines(spark, folder, remap_duplicates=True)


def priority_rank(spark, folder):
    tables = fixtures.allocation(spark, folder)
    ranked = allocation.priority_rank(allocation.open_lines(tables), allocation.hot_items(tables))
    return ranked.select("line_id", "item_code", "priority_rank")


def running_demand(spark, folder, split=False):
    tables = fixtures.allocation(spark, folder)
    lines = allocation.open_lines(tables)
    ranked = allocation.running_demand(lines, _hot(tables, split))
    return ranked.select("line_id", "item_code", "priority_rank", "used_before")


def running_demand_split(spark, folder):
    return running_demand(spark, folder, split=True)


def waterfall_allocation(spark, folder, split=False):
    tables = fixtures.allocation(spark, folder)
    lines = allocation.open_lines(tables)
    return allocation.waterfall_allocate(lines, _stock(tables), _hot(tables, split)).select(
        "line_id", "item_code", "priority_rank", "due_quantity", "total_stock", "used_before",
        "remaining_before", "proposed",
    )


def waterfall_allocation_split(spark, folder):
    return waterfall_allocation(spark, folder, split=True)


def waterfall_null_items(spark, folder):
    """Lines whose item code ends in 0 or 5 lose it: one group without stock, cut like any hot item."""
    tables = fixtures.allocation(spark, folder)
    lines = allocation.open_lines(tables).withColumn(
        "item_code", F.when(~F.right("item_code", F.lit(1)).isin("0", "5"), F.col("item_code"))
    )
    hot = hot_keys(lines, "item_code", SPLIT_ROWS)
    return allocation.waterfall_allocate(lines, _stock(tables), hot).select(
        "line_id", "item_code", "priority_rank", "used_before", "total_stock", "proposed"
    )


def allocation_status(spark, folder):
    rows = allocation.allocation_status(_allocated(fixtures.allocation(spark, folder)))
    return rows.select("line_id", "stock_after", "current_status", "proposed_status")


def _every_line(tables):
    """Lines of any type, status and document type, so that every label occurs."""
    return tables.lines.join(tables.line_view, "line_id").join(tables.headers, "order_id")


def despatch_status(spark, folder):
    lines = _every_line(fixtures.allocation(spark, folder))
    label = allocation.labels.despatch_status(F.col("despatched_quantity"), F.col("quantity"))
    return lines.select("line_id", label.alias("despatch_status"))


def code_labels(spark, folder):
    return allocation.code_labels(_every_line(fixtures.allocation(spark, folder))).select(
        "line_id", "line_type_label", "order_status_label", "document_type_label"
    )


def fx_transaction(spark, folder):
    lines = allocation.open_lines(fixtures.allocation(spark, folder))
    money = ["unit_price_gbp", "order_value_gbp", "due_value_gbp", "despatched_value_gbp"]
    return _comparable(
        allocation.value_at_document_rate(lines).select("line_id", *money), *money
    )


def fx_system(spark, folder):
    tables = fixtures.allocation(spark, folder)
    money = ["unit_price_system", "line_value_system"]
    valued = allocation.value_at_system_rate(
        allocation.open_lines(tables), tables.system_currency
    )
    return _comparable(valued.select("line_id", *money), *money)


def allocation_report(spark, folder):
    return _comparable(
        reports.allocation_report(fixtures.allocation(spark, folder)),
        "Unit Price (GBP)", "Total Order Value (GBP)", "Outstanding Value (GBP)",
        "Despatched Value (GBP)", "Unit Price (System FX Rate)", "Net Value (System FX Rate)",
    )


def allocation_order(spark, folder):
    rows = reports.allocation_report(fixtures.allocation(spark, folder))
    return _numbered(rows, "Item Code", "Allocation Priority Rank")


# --- forecast -------------------------------------------------------------------------


def _dated(tables):
    return forecast.with_period_date(forecast.forecast_base(tables, fixtures.FROM_DATE))


def forecast_base(spark, folder):
    tables = fixtures.forecast(spark, folder)
    return _comparable(forecast.forecast_base(tables, fixtures.FROM_DATE))


def forecast_period_dates(spark, folder):
    return _comparable(_dated(fixtures.forecast(spark, folder)).select(
        "forecast_item_id", "frequency", "start_date", "period_sequence", "period_date"
    ))


def _normalised(tables, grain="period"):
    return forecast.normalise_forecast(_dated(tables), fixtures.AS_OF, grain=grain)


def forecast_normalised(spark, folder):
    return _comparable(_normalised(fixtures.forecast(spark, folder)))


def forecast_normalised_month(spark, folder):
    return _comparable(_normalised(fixtures.forecast(spark, folder), "month"))


def forecast_normalised_spread(spark, folder):
    return _comparable(_normalised(fixtures.forecast(spark, folder), "spread"))


def forecast_gap_spread(spark, folder):
    tables = fixtures.forecast(spark, folder)
    rows = reports.forecast_gap_rows(tables, fixtures.FROM_DATE, fixtures.AS_OF, grain="spread")
    return _comparable(rows, "unit_price_gbp", "unfulfilled_value_gbp")


def forecast_order(spark, folder):
    rows = reports.forecast_report(fixtures.forecast(spark, folder), fixtures.FROM_DATE, fixtures.AS_OF)
    return _numbered(rows, "Year", "Month Number", "Forecast Reference", "Customer Code", "Product Code")


def ordered_quantities(spark, folder):
    tables = fixtures.forecast(spark, folder)
    return _comparable(forecast.ordered_quantities(tables, fixtures.FROM_DATE))


def forecast_gap_laid_out(spark, folder):
    """The gap from tables written by month and bucket."""
    path = scratch_folder(spark, "layout")
    prefix = path.rsplit("/", 1)[-1].replace("-", "_")
    tables = fixtures.forecast(spark, folder)
    layout.write_forecast_tables(tables, prefix, layout.buckets_for(tables, least=4), path)
    tables = layout.read_forecast_tables(spark, prefix, fixtures.FROM_DATE)
    rows = reports.forecast_gap_rows(tables, fixtures.FROM_DATE, fixtures.AS_OF)
    return _comparable(rows, "unit_price_gbp", "unfulfilled_value_gbp")


def fx_forecast(spark, folder):
    tables = fixtures.forecast(spark, folder)
    rows = forecast.priced_forecast(_normalised(tables), tables).select(
        "customer_code", "product_id", "frequency", "period_date", "forecast_reference",
        "unit_price", "currency", "unit_price_gbp",
    )
    return _comparable(rows.distinct(), "unit_price_gbp")


def _gap(spark, folder):
    tables = fixtures.forecast(spark, folder)
    return reports.forecast_gap_rows(tables, fixtures.FROM_DATE, fixtures.AS_OF)


def forecast_gap(spark, folder):
    return _comparable(_gap(spark, folder), "unit_price_gbp", "unfulfilled_value_gbp")


def forecast_report(spark, folder):
    tables = fixtures.forecast(spark, folder)
    return _comparable(
        reports.forecast_report(tables, fixtures.FROM_DATE, fixtures.AS_OF),
        "Unit Price (GBP)", "Unfulfilled Value (GBP)",
    )


def _months(spark, folder):
    tables = fixtures.forecast(spark, folder)
    return reports.month_gap_rows(tables, fixtures.FROM_DATE, fixtures.AS_OF)


def customers_behind(spark, folder):
    rows = forecast.customers_behind(_months(spark, folder))
    return _comparable(rows, "unfulfilled_value_gbp")


def pipeline_by_month(spark, folder):
    rows = forecast.pipeline_by_month(_months(spark, folder))
    return _comparable(rows, "forecast_value_gbp", "unfulfilled_value_gbp")


def over_ordered(spark, folder):
    return _comparable(forecast.over_ordered(_months(spark, folder)))


# --- product hierarchy ----------------------------------------------------------------


def _edges(spark, folder):
    return bom.bom_edges(fixtures.bom(spark, folder))


_EXPLOSION_COLUMNS = [
    "level", "parent_code", "component_code", "description", "component_type", "quantity", "path",
]


def bom_explosion(spark, folder):
    rows = bom.explode_bom(_edges(spark, folder), fixtures.BOM_ROOT)
    return _comparable(rows.select(_EXPLOSION_COLUMNS))


def bom_explosion_recursive(spark, folder):
    rows = bom.explode_bom_recursive(_edges(spark, folder), fixtures.BOM_ROOT)
    return _comparable(rows.select(_EXPLOSION_COLUMNS))


def bom_indented(spark, folder):
    return _comparable(reports.bom_report(fixtures.bom(spark, folder), fixtures.BOM_ROOT))


def bom_by_type(spark, folder):
    return bom.of_type(bom_explosion(spark, folder), COMPONENT_TYPE)


def bom_extended_quantity(spark, folder):
    rows = bom.explode_bom(_edges(spark, folder), fixtures.BOM_ROOT, extended=True)
    return _comparable(rows.select("level", "component_code", "path", "extended_quantity"))


def bom_material_requirements(spark, folder):
    return _comparable(bom.material_requirements(_edges(spark, folder), fixtures.BOM_ROOT))


def bom_cost_rollup(spark, folder):
    needed = bom.material_requirements(_edges(spark, folder), fixtures.BOM_ROOT)
    rows = bom.cost_rollup(needed, fixtures.part_costs(spark, folder))
    return _comparable(rows, "extended_cost")


def bom_where_used(spark, folder):
    return _comparable(bom.where_used(_edges(spark, folder), WHERE_USED))


def bom_lead_time(spark, folder):
    days = fixtures.part_lead_days(spark, folder)
    return bom.lead_time(_edges(spark, folder), fixtures.BOM_ROOT, days)


def _chains(spark, folder):
    edges = bom.stored_edges(fixtures.chain_edges(spark, folder))
    return edges, bom.root_products(edges)


def bom_chain_requirements(spark, folder):
    return bom.material_requirements(*_chains(spark, folder), doubling=True)


def bom_chain_cost(spark, folder):
    needed = bom.material_requirements(*_chains(spark, folder), doubling=True)
    rows = bom.total_cost(bom.cost_rollup(needed, fixtures.part_costs(spark, folder)))
    return _comparable(rows, "total_cost")


def bom_chain_lead_time(spark, folder):
    days = fixtures.part_lead_days(spark, folder)
    return bom.longest_lead_time(bom.lead_time(*_chains(spark, folder), days, doubling=True))


def bom_requirements_doubled(spark, folder):
    """Requirements of every product that is no component, over all paths."""
    edges = bom.stored_edges(_edges(spark, folder))
    return _comparable(bom.material_requirements(edges, bom.root_products(edges), doubling=True))


def bom_order(spark, folder):
    return _numbered(reports.bom_report(fixtures.bom(spark, folder), fixtures.BOM_ROOT), "FullPath", "Component")


def bom_deep_explosion(spark, folder):
    """Chains twice as deep as the explosion goes, all at once."""
    rows = bom.explode_bom(*_chains(spark, folder))
    return _comparable(rows.select("root_code", "level", "parent_code", "component_code", "quantity", "path"))


def bom_long_paths(spark, folder):
    """Paths that pass the limit of their length."""
    edges = bom.stored_edges(fixtures.long_chain_edges(spark, folder))
    rows = bom.explode_bom(edges, bom.root_products(edges))
    return _comparable(rows.select("root_code", "level", "component_code", "path"))


def low_level_codes(spark, folder):
    return _comparable(hierarchy.low_level_codes(_edges(spark, folder)))


def _demand(tables):
    return allocation.open_lines(tables).select(
        "item_code", F.col("promised_date").alias("due_date"), F.col("due_quantity").alias("quantity"))


def net_requirements(spark, folder):
    """Open order lines and all components they need, net of stock, by day."""
    tables = fixtures.allocation(spark, folder)
    return _comparable(planning.net_requirements(
        _edges(spark, folder), _demand(tables), _stock(tables), lead_days=fixtures.part_lead_days(spark, folder)))


def net_requirements_weekly(spark, folder):
    """By week, with expected receipts, planned in lots."""
    tables = fixtures.allocation(spark, folder)
    return _comparable(planning.net_requirements(
        _edges(spark, folder), _demand(tables), _stock(tables), fixtures.receipts(spark, folder),
        fixtures.part_lead_days(spark, folder), fixtures.part_lots(spark, folder), grain="week"))


def standard_costs(spark, folder):
    rows = planning.standard_costs(_edges(spark, folder), fixtures.part_costs(spark, folder))
    return _comparable(rows, "material_cost", "standard_cost", digits=2)


def change_impact(spark, folder):
    """What contains each component of the whole hierarchy."""
    edges = bom.stored_edges(_edges(spark, folder))
    components = edges.rows.select(F.col("component_code").alias("root_code")).distinct()
    return _comparable(hierarchy.change_impact(edges, components))


def bom_where_used_many(spark, folder):
    """Paths upwards from every lowest component."""
    edges = bom.stored_edges(_edges(spark, folder))
    parents = edges.rows.select(F.col("parent_code").alias("root_code")).distinct()
    lowest = edges.rows.select(F.col("component_code").alias("root_code")).distinct().join(parents.hint("merge"), "root_code", "left_anti")
    return _comparable(bom.where_used(edges, lowest))


def _versions(spark, folder):
    before = _edges(spark, folder)
    return before, fixtures.changed_edges(spark, folder, before)


def structure_changes(spark, folder):
    return changes.structure_changes(*_versions(spark, folder))


def touched_products(spark, folder):
    before, after = _versions(spark, folder)
    return _comparable(changes.touched_products(changes.structure_changes(before, after), before, after))


def bom_cycles(spark, folder):
    return hierarchy.cycles(fixtures.ring_edges(spark, folder))


def endless_products(spark, folder):
    return bom.endless_products(fixtures.ring_edges(spark, folder))


def _references(spark, folder):
    tables = fixtures.bom(spark, folder), fixtures.allocation(spark, folder), fixtures.forecast(spark, folder)
    return quality.references(*fixtures.thinned(*tables))


def missing_references(spark, folder):
    return quality.missing_references(_references(spark, folder))


def reference_checks(spark, folder):
    return quality.reference_checks(_references(spark, folder))


def input_quality(spark, folder):
    return quality.input_quality(
        fixtures.bom(spark, folder),
        fixtures.allocation(spark, folder),
        fixtures.forecast(spark, folder),
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        nominal_dedupe, stock_levels, outstanding_lines, outstanding_lines_remapped,
        outstanding_lines_split,
        priority_rank, running_demand, running_demand_split, waterfall_allocation,
        waterfall_allocation_split, waterfall_null_items, allocation_status, despatch_status, code_labels,
        fx_transaction, fx_system, allocation_report, forecast_base, forecast_period_dates,
        forecast_normalised, forecast_normalised_month, ordered_quantities, fx_forecast,
        forecast_gap, forecast_report, customers_behind, pipeline_by_month, over_ordered,
        bom_explosion, bom_explosion_recursive, bom_indented, bom_by_type,
        bom_extended_quantity, bom_material_requirements, bom_cost_rollup, bom_where_used,
        bom_lead_time, bom_chain_requirements, bom_chain_cost, bom_chain_lead_time, input_quality,
        allocation_order, forecast_order, forecast_normalised_spread, forecast_gap_spread, forecast_gap_laid_out,
        bom_requirements_doubled, bom_order, bom_deep_explosion, bom_long_paths, bom_where_used_many,
        low_level_codes, net_requirements, net_requirements_weekly, standard_costs, change_impact,
        structure_changes, touched_products, bom_cycles, endless_products, missing_references, reference_checks,
    )
}
