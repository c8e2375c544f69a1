"""The three reports from end to end, with the column labels their readers know."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import text
from quayside.operators import allocation, bom, forecast
from quayside.operators.skew import HOT_ROWS
from quayside.sources.tables import AllocationTables, BomTables, ForecastTables

# Report labels, in report order, by column.
BOM_LABELS = {
    "level": "Level",
    "component": "Component",
    "description": "Description",
    "quantity": "Qty",
    "path": "FullPath",
}

# Report labels, in report order, by column.
ALLOCATION_LABELS = {
    "document_no": "Sales Order",
    "line_number": "Line",
    "customer_document_no": "Customer PO",
    "customer_code": "Customer Code",
    "customer_name": "Customer Name",
    "item_code": "Item Code",
    "item_description": "Description",
    "quantity": "Ordered Qty",
    "despatched_quantity": "Despatched Qty",
    "due_quantity": "Outstanding Qty",
    "allocated_quantity": "Already Allocated",
    "total_stock": "Total Stock Available",
    "proposed": "Proposed Allocation",
    "stock_after": "Stock After Allocation",
    "current_status": "Current Status",
    "proposed_status": "Proposed Status",
    "unit_price": "Unit Price (Local Currency)",
    "line_value": "Net Value (Local Currency)",
    "currency": "Currency",
    "exchange_rate": "Exchange Rate",
    "unit_price_gbp": "Unit Price (GBP)",
    "order_value_gbp": "Total Order Value (GBP)",
    "due_value_gbp": "Outstanding Value (GBP)",
    "despatched_value_gbp": "Despatched Value (GBP)",
    "unit_price_system": "Unit Price (System FX Rate)",
    "line_value_system": "Net Value (System FX Rate)",
    "document_date": "Order Date",
    "requested_date": "Requested Delivery",
    "promised_date": "Promised Delivery",
    "source_document_no": "Source Quote/Invoice",
    "despatch_status": "Despatch Status",
    "account_number": "Nominal Code",
    "account_name": "Account Name",
    "line_type_label": "Line Type",
    "order_status_label": "Order Status",
    "document_type_label": "Document Type",
    "priority_rank": "Allocation Priority Rank",
}

# Report labels, in report order, by column.
FORECAST_LABELS = {
    "forecast_reference": "Forecast Reference",
    "product_code": "Product Code",
    "period_date": "Period Date",
    "frequency": "Forecast Frequency",
    "customer_code": "Customer Code",
    "year": "Year",
    "month": "Month Number",
    "month_name": "Month Name",
    "forecast_quantity": "Forecast Quantity",
    "ordered_quantity": "Actual Order Quantity",
    "unfulfilled_quantity": "Unfulfilled Quantity",
    "unit_price": "Unit Price (Local Currency)",
    "currency": "Currency",
    "unit_price_gbp": "Unit Price (GBP)",
    "unfulfilled_value_gbp": "Unfulfilled Value (GBP)",
}


def display_columns(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The labelled columns only, renamed for display."""
    return rows.select(*[F.col(name).alias(label) for name, label in labels.items()])


def _sorted(rows: DataFrame, ordered: bool, *keys: str | Column) -> DataFrame:
    return rows.orderBy(*keys) if ordered else rows


def bom_report(
    tables: BomTables, root: str, max_depth: int | None = bom.MAX_DEPTH, ordered: bool = True,
    path_limit: int | None = text.PATH_LIMIT,
) -> DataFrame:
    """Indented explosion of one product, parents ahead of their components.

    Paths that agree as far as they are kept are told apart by the whole path.
    """
    rows = bom.explode_bom(bom.bom_edges(tables), root, max_depth, path_parts=True, path_limit=path_limit)
    component = text.indent(F.col("level"), F.col("component_code"))
    rows = _sorted(rows.withColumn("component", component), ordered, "path", "path_parts")
    return display_columns(rows, BOM_LABELS)


def allocation_report(
    tables: AllocationTables,
    remap_duplicates: bool = False,
    hot_rows: int = HOT_ROWS,
    ordered: bool = True,
) -> DataFrame:
    """Proposed allocation of every open order line, with labels and GBP values.

    ``ordered=False`` saves the final sort where the report is written rather than shown.
    """
    rows = allocation.waterfall_allocate(
        allocation.open_lines(tables, remap_duplicates),
        allocation.stock_levels(tables.movements, tables.items),
        allocation.hot_items(tables, hot_rows),
    )
    rows = allocation.code_labels(allocation.allocation_status(rows))
    rows = allocation.value_at_document_rate(rows)
    rows = allocation.value_at_system_rate(rows, tables.system_currency)
    return display_columns(_sorted(rows, ordered, "item_code", "priority_rank"), ALLOCATION_LABELS)


def forecast_gap_rows(
    tables: ForecastTables,
    from_date: date | str,
    as_of: datetime | str | Column | None = None,
    days: int = 60,
    grain: str = "period",
) -> DataFrame:
    """Forecast gap in engine columns, from the source tables."""
    dated = forecast.with_period_date(forecast.forecast_base(tables, from_date))
    normalised = forecast.normalise_forecast(dated, as_of, days, grain, by="customer_id")
    ordered = forecast.ordered_quantities(tables, from_date)
    return forecast.forecast_gap(normalised, ordered, tables)


def month_gap_rows(
    tables: ForecastTables,
    from_date: date | str,
    as_of: datetime | str | Column | None = None,
    days: int = 60,
) -> DataFrame:
    """Forecast gap per customer, product and month, from the source tables."""
    dated = forecast.with_period_date(forecast.forecast_base(tables, from_date))
    normalised = forecast.normalise_forecast(dated, as_of, days, by="customer_id")
    return forecast.month_gap(normalised, forecast.ordered_quantities(tables, from_date), tables)


def forecast_report(
    tables: ForecastTables,
    from_date: date | str,
    as_of: datetime | str | Column | None = None,
    days: int = 60,
    grain: str = "period",
    ordered: bool = True,
) -> DataFrame:
    """Forecast against orders, by year, month, forecast, customer and product."""
    rows = forecast_gap_rows(tables, from_date, as_of, days, grain)
    keys = ["year", "month", "forecast_reference", "customer_code", "product_code"]
    return display_columns(_sorted(rows, ordered, *keys), FORECAST_LABELS)
