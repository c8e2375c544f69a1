"""Read ERP extracts and give them the column names and types the operators use."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.sources.tables import AllocationTables, BomTables, ForecastTables

# Kinds that keep the type of the extract, so that no digit and no time of day is lost.
NUMBER = "number"
MOMENT = "moment"


class Extract(NamedTuple):
    """One ERP table: its name there, and (name there, name here, type) per column."""

    source: str
    columns: tuple[tuple[str, str, str], ...]


# Table and column names of the ERP extracts.
BOM_EXTRACTS = {
    "products": Extract("ProductMaster", (
        ("ProductID", "product_id", "bigint"),
        ("ProductCode", "product_code", "string"),
    )),
    "structures": Extract("ProductStructure", (
        ("StructureID", "structure_id", "bigint"),
        ("ProductID", "product_id", "bigint"),
        ("StructureType", "structure_type", "int"),
        ("IsActive", "is_active", "int"),
    )),
    "components": Extract("ComponentDetails", (
        ("StructureID", "structure_id", "bigint"),
        ("PartNumber", "part_number", "string"),
        ("Description", "description", "string"),
        ("ComponentType", "component_type", "string"),
        ("QuantityRequired", "quantity_required", NUMBER),
    )),
}

# Table and column names of the ERP extracts.
ALLOCATION_EXTRACTS = {
    "accounts": Extract("NLNominalAccount", (
        ("NLNominalAccountID", "account_id", "bigint"),
        ("AccountNumber", "account_number", "string"),
        ("AccountName", "account_name", "string"),
    )),
    "items": Extract("StockItem", (
        ("ItemID", "item_id", "bigint"),
        ("Code", "item_code", "string"),
    )),
    "movements": Extract("MovementBalance", (
        ("ItemID", "item_id", "bigint"),
        ("OpeningStockLevel", "opening_stock", NUMBER),
        ("StockLevelIssued", "stock_issued", NUMBER),
    )),
    "lines": Extract("SOPOrderLine", (
        ("SOPOrderLineID", "line_id", "bigint"),
        ("SOPOrderReturnID", "order_id", "bigint"),
        ("PrintSequenceNumber", "line_number", "int"),
        ("LineQuantity", "line_quantity", NUMBER),
        ("DespatchReceiptQuantity", "despatched_quantity", NUMBER),
        ("InvoiceCreditQuantity", "invoiced_quantity", NUMBER),
        ("AllocatedQuantity", "allocated_quantity", NUMBER),
        ("LineTypeID", "line_type", "int"),
        ("NominalSpecificationID", "nominal_id", "bigint"),
    )),
    "headers": Extract("SOPOrderReturn", (
        ("SOPOrderReturnID", "order_id", "bigint"),
        ("CustomerID", "customer_id", "bigint"),
        ("CurrencyID", "currency_id", "bigint"),
        ("DocumentNo", "document_no", "string"),
        ("CustomerDocumentNo", "customer_document_no", "string"),
        ("SourceDocumentNo", "source_document_no", "string"),
        ("ExchangeRate", "exchange_rate", NUMBER),
        ("DocumentDate", "document_date", MOMENT),
        ("RequestedDeliveryDate", "requested_date", MOMENT),
        ("PromisedDeliveryDate", "promised_date", MOMENT),
        ("DocumentTypeID", "document_type", "int"),
        ("DocumentStatusId", "document_status", "int"),
    )),
    "customers": Extract("SLCustomerAccount", (
        ("SLCustomerAccountID", "customer_id", "bigint"),
        ("CustomerAccountNumber", "customer_code", "string"),
        ("CustomerAccountName", "customer_name", "string"),
    )),
    "line_view": Extract("SOPOrderLineView", (
        ("SOPOrderLineID", "line_id", "bigint"),
        ("ItemCode", "item_code", "string"),
        ("ItemDescription", "item_description", "string"),
        ("LineQuantity", "quantity", NUMBER),
        ("UnitSellingPrice", "unit_price", NUMBER),
        ("LineTotalValue", "line_value", NUMBER),
    )),
    "currencies": Extract("Currency", (
        ("CurrencyID", "currency_id", "bigint"),
        ("Symbol", "currency", "string"),
        ("OneUnitBaseEquals", "base_rate", NUMBER),
    )),
    "system_currency": Extract("SystemCurrency", (
        ("CurrencyID", "currency_id", "bigint"),
        ("OneEuroEquals", "gbp_rate", NUMBER),
    )),
}

# Table and column names of the ERP extracts.
FORECAST_EXTRACTS = {
    "headers": Extract("SalesForecastHeader", (
        ("ForecastID", "forecast_id", "bigint"),
        ("CustomerID", "customer_id", "bigint"),
        ("FrequencyID", "frequency_id", "bigint"),
        ("ForecastReference", "forecast_reference", "string"),
        ("StartDate", "start_date", MOMENT),
    )),
    "frequencies": Extract("SalesForecastFrequency", (
        ("FrequencyID", "frequency_id", "bigint"),
        ("FrequencyType", "frequency", "string"),
    )),
    "items": Extract("SalesForecastItem", (
        ("ForecastItemID", "forecast_item_id", "bigint"),
        ("ForecastID", "forecast_id", "bigint"),
        ("ProductID", "product_id", "bigint"),
    )),
    "quantities": Extract("SalesForecastQuantity", (
        ("ForecastItemID", "forecast_item_id", "bigint"),
        ("PeriodID", "period_id", "bigint"),
        ("Quantity", "quantity", NUMBER),
    )),
    "periods": Extract("SalesForecastPeriod", (
        ("PeriodID", "period_id", "bigint"),
        ("PeriodSequence", "period_sequence", "int"),
    )),
    "orders": Extract("SalesOrder", (
        ("OrderID", "order_id", "bigint"),
        ("CustomerID", "customer_id", "bigint"),
        ("OrderNumber", "order_number", "string"),
        ("DocumentType", "document_type", "int"),
        ("DocumentStatus", "document_status", "int"),
    )),
    "order_lines": Extract("SalesOrderLine", (
        ("OrderID", "order_id", "bigint"),
        ("LineNumber", "line_number", "bigint"),
        ("PromisedDeliveryDate", "promised_date", MOMENT),
    )),
    "order_line_view": Extract("SalesOrderLineView", (
        ("OrderID", "order_id", "bigint"),
        ("LineNumber", "line_number", "bigint"),
        ("ProductCode", "product_code", "string"),
        ("OrderQuantity", "order_quantity", NUMBER),
    )),
    "customers": Extract("CustomerAccount", (
        ("CustomerID", "customer_id", "bigint"),
        ("PriceBandID", "price_band_id", "bigint"),
        ("CurrencyID", "currency_id", "bigint"),
        ("CustomerAccountNumber", "customer_code", "string"),
    )),
    "products": Extract("Product", (
        ("ProductID", "product_id", "bigint"),
        ("ProductCode", "product_code", "string"),
    )),
    "prices": Extract("ProductPrice", (
        ("ProductID", "product_id", "bigint"),
        ("PriceBandID", "price_band_id", "bigint"),
        ("UnitPrice", "unit_price", NUMBER),
    )),
    "currencies": Extract("SystemCurrency", (
        ("CurrencyID", "currency_id", "bigint"),
        ("CurrencySymbol", "currency", "string"),
        ("ExchangeRateToBase", "base_rate", NUMBER),
        ("GBPExchangeRate", "gbp_rate", NUMBER),
    )),
}


def _typed(column: Column, kind: str, given: T.DataType) -> Column:
    if kind == NUMBER:
        return column if isinstance(given, T.NumericType) else column.cast("double")
    if kind == MOMENT:
        return column if isinstance(given, T.DatetimeType) else column.cast("timestamp_ntz")
    return column.cast(kind)


def conform(df: DataFrame, extract: Extract, collation: str | None = None) -> DataFrame:
    """Pick, rename and cast the columns of one extract.

    Numbers and dates stay as they are; written as text they become doubles and timestamps
    without zone.

    ``collation`` (such as ``UTF8_LCASE_RTRIM``) makes every later comparison of its
    strings follow that collation; the default is binary.
    """
    columns = []
    for source, name, kind in extract.columns:
        column = _typed(F.col(source), kind, df.select(source).schema[0].dataType)
        if collation and kind == "string":
            column = F.collate(column, collation)
        columns.append(column.alias(name))
    return df.select(*columns)


def _load(bundle, extracts, read, collation):
    return bundle(**{
        field: conform(read(extract.source), extract, collation)
        for field, extract in extracts.items()
    })


def parquet_reader(spark: SparkSession, folder: str):
    """Reader of ``<folder>/<table>`` Parquet extracts."""
    return lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}")


def catalog_reader(spark: SparkSession, database: str | None = None):
    """Reader of catalog tables or temp views named like the ERP tables."""
    prefix = f"{database}." if database else ""
    return lambda table: spark.table(prefix + table)


def bom_tables(read, collation: str | None = None) -> BomTables:
    return _load(BomTables, BOM_EXTRACTS, read, collation)


def allocation_tables(read, collation: str | None = None) -> AllocationTables:
    return _load(AllocationTables, ALLOCATION_EXTRACTS, read, collation)


def forecast_tables(read, collation: str | None = None) -> ForecastTables:
    return _load(ForecastTables, FORECAST_EXTRACTS, read, collation)
