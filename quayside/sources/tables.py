"""Input bundles of the three jobs; every field is a DataFrame with snake_case columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


class BomTables(NamedTuple):
    products: DataFrame
    structures: DataFrame
    components: DataFrame


class AllocationTables(NamedTuple):
    accounts: DataFrame
    items: DataFrame
    movements: DataFrame
    lines: DataFrame
    headers: DataFrame
    customers: DataFrame
    line_view: DataFrame
    currencies: DataFrame
    system_currency: DataFrame


class ForecastTables(NamedTuple):
    headers: DataFrame
    frequencies: DataFrame
    items: DataFrame
    quantities: DataFrame
    periods: DataFrame
    orders: DataFrame
    order_lines: DataFrame
    order_line_view: DataFrame
    customers: DataFrame
    products: DataFrame
    prices: DataFrame
    currencies: DataFrame
