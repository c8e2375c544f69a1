"""Checks of the inputs the jobs rely on; each gives the number of offending rows or keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.currency import GBP
from quayside.functions.dates import FREQUENCY_STEPS
from quayside.operators.bom import bom_edges, endless_products
from quayside.session import stored
from quayside.sources.tables import AllocationTables, BomTables, ForecastTables


class Reference(NamedTuple):
    """Key columns by which an inner join finds its partner, and the partner's own."""

    check_name: str
    keys: Sequence[str]
    other: DataFrame
    other_keys: Sequence[str]


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def unmatched(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing from the other table."""
    return rows.join(other.select(key), key, "left_anti")


def gbp_rows(rates: DataFrame) -> DataFrame:
    """The GBP rows of a rate table; there must be exactly one."""
    return rates.where(F.col("currency_id") == GBP)


def zero_rates(currencies: DataFrame) -> DataFrame:
    return currencies.where(F.coalesce("base_rate", F.lit(0)) == 0)


def unknown_frequencies(frequencies: DataFrame) -> DataFrame:
    known = F.col("frequency").isin(*FREQUENCY_STEPS)
    return frequencies.where(~F.coalesce(known, F.lit(False)))


def input_quality(
    bom: BomTables, allocation: AllocationTables, forecast: ForecastTables
) -> DataFrame:
    """One row per check with the number of findings; 0 is clean but for ``gbp_rows`` (1)."""
    checks = {
        "repeated_product_codes": repeated_keys(bom.products, "product_code"),
        "endless_products": endless_products(bom_edges(bom)),
        "repeated_accounts": repeated_keys(
            allocation.accounts, "account_number", "account_name"
        ),
        "repeated_line_ids": repeated_keys(allocation.lines, "line_id"),
        "lines_without_account": unmatched(
            allocation.lines.withColumnRenamed("nominal_id", "account_id"),
            allocation.accounts, "account_id",
        ),
        "items_without_movement": unmatched(allocation.items, allocation.movements.hint("merge"), "item_id"),
        "zero_document_rates": allocation.headers.where(F.col("exchange_rate") == 0),
        "gbp_rows": gbp_rows(allocation.system_currency),
        "zero_base_rates": zero_rates(allocation.currencies),
        "unknown_frequencies": unknown_frequencies(forecast.frequencies),
        "repeated_price_bands": repeated_keys(forecast.prices, "product_id", "price_band_id"),
    }
    return reduce(
        DataFrame.unionByName,
        [
            rows.agg(F.count(F.lit(1)).alias("findings")).select(
                F.lit(name).alias("check_name"), "findings"
            )
            for name, rows in checks.items()
        ],
    )


def references(bom: BomTables, allocation: AllocationTables, forecast: ForecastTables) -> list[tuple[DataFrame, list[Reference]]]:
    """All inner joins of the three jobs, by the table whose rows they drop where no partner is found."""
    priced = forecast.prices.where(F.col("unit_price") != 0)
    wanted_prices = forecast.items.select("forecast_id", "product_id").join(
        forecast.headers.select("forecast_id", "customer_id"), "forecast_id"
    ).join(forecast.customers.select("customer_id", "price_band_id"), "customer_id")
    return [
        (bom.structures, [Reference("structure_product", ["product_id"], bom.products, ["product_id"])]),
        (bom.components, [Reference("component_structure", ["structure_id"], bom.structures, ["structure_id"])]),
        (allocation.movements, [Reference("movement_item", ["item_id"], allocation.items, ["item_id"])]),
        (allocation.lines, [
            Reference("line_order", ["order_id"], allocation.headers, ["order_id"]),
            Reference("line_details", ["line_id"], allocation.line_view, ["line_id"]),
        ]),
        (allocation.headers, [
            Reference("order_customer", ["customer_id"], allocation.customers, ["customer_id"]),
            Reference("order_currency", ["currency_id"], allocation.currencies, ["currency_id"]),
        ]),
        (forecast.headers, [
            Reference("forecast_frequency", ["frequency_id"], forecast.frequencies, ["frequency_id"]),
            Reference("forecast_customer", ["customer_id"], forecast.customers, ["customer_id"]),
        ]),
        (forecast.items, [
            Reference("item_forecast", ["forecast_id"], forecast.headers, ["forecast_id"]),
            Reference("item_product", ["product_id"], forecast.products, ["product_id"]),
        ]),
        (forecast.quantities, [
            Reference("quantity_item", ["forecast_item_id"], forecast.items, ["forecast_item_id"]),
            Reference("quantity_period", ["period_id"], forecast.periods, ["period_id"]),
        ]),
        (wanted_prices, [Reference("item_price", ["product_id", "price_band_id"], priced, ["product_id", "price_band_id"])]),
        (forecast.order_lines, [
            Reference("order_line_order", ["order_id"], forecast.orders, ["order_id"]),
            Reference("order_line_details", ["order_id", "line_number"], forecast.order_line_view, ["order_id", "line_number"]),
        ]),
        (forecast.orders, [Reference("sales_order_customer", ["customer_id"], forecast.customers, ["customer_id"])]),
        (forecast.customers, [Reference("customer_currency", ["currency_id"], forecast.currencies, ["currency_id"])]),
    ]


class _Keys:
    """Keys of all checks in the same columns: the check's place, whole numbers as such, others as an array of text.

    A check whose keys are whole numbers on both sides has them in ``_0``, ``_1``, ...; the rest are compared as
    text, and as an array, so that parts can't run together. What a check does not use is filled, so that
    NULL always means a NULL in its key.
    """

    def __init__(self, tables: Sequence[tuple[DataFrame, Sequence[Reference]]]):
        kinds: dict[str, set[int]] = {}
        for rows, refs in tables:
            for r in refs:
                own, other = [rows.schema[k].dataType for k in r.keys], [r.other.schema[k].dataType for k in r.other_keys]
                whole = all(isinstance(kind, T.IntegralType) for kind in (*own, *other))
                kinds.setdefault(r.check_name, set()).add(len(r.keys) if whole else 0)
        self.names = list(kinds)
        self.parts = {name: kind.pop() if len(kind) == 1 else 0 for name, kind in kinds.items()}
        self.numbers = [f"_{i}" for i in range(max(self.parts.values(), default=0))]
        self.texts = ["_text"] if 0 in self.parts.values() else []
        self.columns = ["_check", *self.numbers, *self.texts]

    def of(self, checks: Sequence[tuple[str, Sequence[str]]]) -> Column:
        """One row per check."""
        return F.inline(F.array(*[self._one(name, keys) for name, keys in checks]))

    def _one(self, name: str, keys: Sequence[str]) -> Column:
        whole = [F.col(key).cast("bigint") for key in keys[:self.parts[name]]]
        numbers = [*whole, *[F.lit(0).cast("bigint")] * (len(self.numbers) - len(whole))]
        text = F.array(*[F.col(key).cast("string") for key in keys[len(whole):]]).cast("array<string>")
        columns = [F.lit(self.names.index(name)), *numbers, *([text] if self.texts else [])]
        return F.struct(*[column.alias(alias) for column, alias in zip(columns, self.columns)])

    def complete(self) -> Column:
        """Whether no part of the key is NULL."""
        texts = [~F.exists(text, lambda part: part.isNull()) for text in self.texts]
        return reduce(Column.__and__, [F.col(number).isNotNull() for number in self.numbers] + texts)

    def shown(self) -> list[Column]:
        """``check_name`` and ``key`` as text."""
        whole = [F.coalesce(F.col(number).cast("string"), F.lit("?")) for number in self.numbers]
        key = F.array_join("_text", "/", "?") if self.texts else F.lit(None).cast("string")
        for parts in {*self.parts.values()} - {0}:
            own = [i for i, name in enumerate(self.names) if self.parts[name] == parts]
            key = F.when(F.col("_check").isin(own), F.concat_ws("/", *whole[:parts])).otherwise(key)
        return [F.array(*map(F.lit, self.names))[F.col("_check")].alias("check_name"), key.alias("key")]


def missing_references(tables: Sequence[tuple[DataFrame, Sequence[Reference]]]) -> DataFrame:
    """Keys without a partner, as check_name, key (parts joined by /, NULL as ?) and the number of rows an inner join drops.

    Every table is read once for all its keys, and rows are counted per key before the shuffle, so that
    a frequent key is one row; the distinct keys of all checks meet their partners in a single anti join. A key with a
    NULL has no partner.
    """
    keys = _Keys(tables)
    used = [rows.select(keys.of([(r.check_name, r.keys) for r in refs])) for rows, refs in tables]
    used = reduce(DataFrame.unionByName, used).groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("rows"))
    known = [r.other.select(keys.of([(r.check_name, r.other_keys)])) for _, refs in tables for r in refs]
    known = reduce(DataFrame.unionByName, known).where(keys.complete()).distinct()
    return used.join(known.hint("merge"), keys.columns, "left_anti").select(*keys.shown(), "rows")


def reference_checks(tables: Sequence[tuple[DataFrame, Sequence[Reference]]]) -> DataFrame:
    """Per check, the keys without a partner and the rows that have them; 0 where all is well."""
    found = stored(missing_references(tables), "missing").groupBy("check_name").agg(
        F.count(F.lit(1)).alias("missing_keys"), F.sum("rows").alias("dropped_rows"))
    names = [(r.check_name,) for _, refs in tables for r in refs]
    checks = found.sparkSession.createDataFrame(names, "check_name string")
    return checks.join(found, "check_name", "left").select(
        "check_name", F.coalesce("missing_keys", F.lit(0)).alias("missing_keys"),
        F.coalesce("dropped_rows", F.lit(0)).alias("dropped_rows"))
