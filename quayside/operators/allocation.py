"""Priority-ranked allocation of stock to open order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import currency, labels
from quayside.operators.scan import ordered_scan
from quayside.operators.skew import HOT_ROWS, HotKeys, hot_keys, spread_join
from quayside.sources.tables import AllocationTables

# Lines that already hold stock come last, then promised date, document date and line id. The
# unique line id makes the order total, so reruns agree.
PRIORITY = (("already_allocated", "promised_date"), ("document_date",))


def dedupe_accounts(accounts: DataFrame, remap_duplicates: bool = False) -> DataFrame:
    """One account id per (number, name): the lowest.

    Order lines that point to a higher id of the same account then find no account. With
    ``remap_duplicates`` every id is kept and finds the account it belongs to.
    """
    if remap_duplicates:
        return accounts.select("account_id", "account_number", "account_name")
    return accounts.groupBy("account_number", "account_name").agg(
        F.min("account_id").alias("account_id")
    )


def stock_levels(movements: DataFrame, items: DataFrame) -> DataFrame:
    """Opening stock less issues per item code.

    Movements are added up per item before the join, so an item with very many movements
    reaches it as one row.
    """
    per_item = movements.groupBy("item_id").agg(
        F.sum("opening_stock").alias("opening"), F.sum("stock_issued").alias("issued")
    )
    return (
        per_item.join(items, "item_id")
        .groupBy("item_code")
        .agg((F.sum("opening") - F.sum("issued")).alias("current_stock"))
    )


def open_lines(tables: AllocationTables, remap_duplicates: bool = False) -> DataFrame:
    """Stock-item lines of live sales orders with something left to despatch.

    The filters run before the joins, and customer and currency are joined to the headers,
    which are fewer than the lines.
    """
    headers = (
        tables.headers.where((F.col("document_status") == 0) & (F.col("document_type") == 0))
        .join(tables.currencies, "currency_id")
        .join(tables.customers, "customer_id")
    )
    due = F.col("line_quantity") - F.col("despatched_quantity")
    lines = tables.lines.where((F.col("line_type") == 0) & (due > 0)).select(
        "line_id", "order_id", "line_number", "despatched_quantity", "invoiced_quantity",
        "allocated_quantity", "line_type", "nominal_id", due.alias("due_quantity"),
    )
    accounts = dedupe_accounts(tables.accounts, remap_duplicates).withColumnRenamed(
        "account_id", "nominal_id"
    )
    return (
        lines.join(headers, "order_id")
        .join(tables.line_view, "line_id")
        .join(accounts, "nominal_id", "left")
        .withColumn("already_allocated", F.when(F.col("allocated_quantity") > 0, 1).otherwise(0))
    )


def with_stock(lines: DataFrame, stock: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Lines with the stock of their item, 0 where it has none."""
    return _stock_or_zero(spread_join(lines, stock, "item_code", "line_id", hot))


def _stock_or_zero(lines: DataFrame) -> DataFrame:
    stock = F.coalesce("current_stock", F.lit(0)).alias("total_stock")
    return lines.select(*[c for c in lines.columns if c != "current_stock"], stock)


def _ranked(lines: DataFrame, per_item: DataFrame | None, hot: HotKeys | None) -> DataFrame:
    return ordered_scan(
        lines, key="item_code", order=PRIORITY, row_id="line_id", amount="due_quantity",
        rank="priority_rank", before="used_before", per_key=per_item, hot=hot,
    )


def priority_rank(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Rank of each line within its item, 1 being served first."""
    return _ranked(lines, None, hot).drop("used_before")


def running_demand(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Rank, and quantity due on the lines of the item that rank higher (NULL on the first)."""
    return _ranked(lines, None, hot)


def hot_items(tables: AllocationTables, hot_rows: int = HOT_ROWS) -> HotKeys | None:
    """Items with very many lines, counted on one column of the line view.

    Closed lines count too, which can only split more items than needed.
    """
    return hot_keys(tables.line_view, "item_code", hot_rows)


def waterfall_allocate(
    lines: DataFrame, stock: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Serve the lines of each item in rank order until its stock runs out.

    The quantity due must be positive, as :func:`open_lines` leaves it: the share of a line is
    then what remains, kept between nothing and the quantity due. ``remaining_before`` turns
    negative once earlier lines asked for more than there is.
    """
    ranked = _stock_or_zero(_ranked(lines, stock, hot))
    remaining = F.col("total_stock") - F.coalesce("used_before", F.lit(0))
    return ranked.withColumn("remaining_before", remaining).withColumn(
        "proposed",
        F.greatest(F.least("due_quantity", "remaining_before"), F.lit(0)),
    )


def allocation_status(lines: DataFrame) -> DataFrame:
    """Allocation labels before and after, and the despatch label."""
    return lines.withColumns({
        "stock_after": F.col("remaining_before") - F.col("proposed"),
        "current_status": labels.current_status(
            F.col("allocated_quantity"), F.col("despatched_quantity"), F.col("quantity")
        ),
        "proposed_status": labels.proposed_status(
            F.col("allocated_quantity"), F.col("proposed"), F.col("despatched_quantity"),
            F.col("quantity"),
        ),
        "despatch_status": labels.despatch_status(
            F.col("despatched_quantity"), F.col("quantity")
        ),
    })


def code_labels(lines: DataFrame) -> DataFrame:
    """Labels of the line type, order status and document type codes."""
    return lines.withColumns({
        "line_type_label": labels.line_type_label(F.col("line_type")),
        "order_status_label": labels.order_status_label(F.col("document_status")),
        "document_type_label": labels.document_type_label(F.col("document_type")),
    })


def value_at_document_rate(lines: DataFrame) -> DataFrame:
    """GBP unit price at the order's rate, and the value ordered, due and despatched."""
    priced = lines.withColumn(
        "unit_price_gbp", currency.at_document_rate(F.col("unit_price"), F.col("exchange_rate"))
    )
    return priced.withColumns({
        "order_value_gbp": F.col("unit_price_gbp") * F.col("quantity"),
        "due_value_gbp": F.col("unit_price_gbp") * F.col("due_quantity"),
        "despatched_value_gbp": F.col("unit_price_gbp") * F.col("despatched_quantity"),
    })


def value_at_system_rate(lines: DataFrame, system_currency: DataFrame) -> DataFrame:
    """GBP unit price and line value at the system rate."""
    rate = currency.gbp_rate(system_currency)

    def convert(amount):
        return currency.at_system_rate(
            F.col(amount), F.col("currency_id"), F.col("base_rate"), rate
        )

    return lines.withColumns({
        "unit_price_system": convert("unit_price"),
        "line_value_system": convert("line_value"),
    })
