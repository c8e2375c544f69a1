import datetime as dt
from decimal import Decimal

import pytest

from quayside import session
from quayside.operators import bom
from quayside.plans import reports
from quayside.sources import erp

DAY = dt.date(2024, 5, 1)
D = Decimal



@pytest.fixture
def order_book(table):
    frames = {
        "NLNominalAccount": table("NLNominalAccountID int, AccountNumber string, AccountName string, Extra int",
                                  (1, "4000", "Sales", 0), (2, "4000", "Sales", 0)),
        "StockItem": table("ItemID int, Code string", (5, "X")),
        "MovementBalance": table("ItemID int, OpeningStockLevel double, StockLevelIssued double", (5, 100.0, 0.0)),
        "SOPOrderLine": table(
            "SOPOrderLineID int, SOPOrderReturnID int, PrintSequenceNumber int, LineQuantity double,"
            " DespatchReceiptQuantity double, InvoiceCreditQuantity double, AllocatedQuantity double,"
            " LineTypeID int, NominalSpecificationID int",
            (1, 1, 1, 60.0, 0.0, 0.0, 0.0, 0, 1), (2, 1, 2, 50.0, 0.0, 0.0, None, 0, 2),
            (3, 1, 3, 30.5, 0.5, 0.0, 1.0, 0, None), (4, 1, 4, 9.0, 0.0, 0.0, 0.0, 3, 1), (5, 1, 5, 9.0, 9.0, 0.0, 0.0, 0, 1)),
        "SOPOrderReturn": table(
            "SOPOrderReturnID int, CustomerID int, CurrencyID int, DocumentNo string, CustomerDocumentNo string,"
            " SourceDocumentNo string, ExchangeRate double, DocumentDate date, RequestedDeliveryDate date,"
            " PromisedDeliveryDate date, DocumentTypeID int, DocumentStatusId int",
            (1, 8, 2, "SO1", "PO1", "QU1", 1.25, DAY, DAY, DAY, 0, 0)),
        "SLCustomerAccount": table("SLCustomerAccountID int, CustomerAccountNumber string, CustomerAccountName string", (8, "C8", "Eight")),
        "SOPOrderLineView": table(
            "SOPOrderLineID int, ItemCode string, ItemDescription string, LineQuantity double,"
            " UnitSellingPrice double, LineTotalValue double",
            *[(n, "X", "Thing", q, 2.5, 2.5 * q) for n, q in ((1, 60.0), (2, 50.0), (3, 30.5), (4, 9.0), (5, 9.0))]),
        "Currency": table("CurrencyID int, Symbol string, OneUnitBaseEquals double", (2, "EUR", 1.0)),
        "SystemCurrency": table("CurrencyID int, OneEuroEquals double", (1, 0.8)),
    }
    return erp.allocation_tables(frames.__getitem__)


def test_allocation_report_from_extracts(order_book):
    report = reports.allocation_report(order_book)
    assert len(report.columns) == 37
    rows = report.collect()
    assert [
        (r["Line"], r["Proposed Allocation"], r["Stock After Allocation"], r["Nominal Code"],
         r["Allocation Priority Rank"], r["Current Status"], r["Proposed Status"], r["Despatch Status"])
        for r in rows
    ] == [
        (1, D(60), D(40), "4000", 1, "Not Allocated", "Would be Fully Allocated", "Not Despatched"),
        (2, D(40), D(0), None, 2, "Not Allocated", "Would Remain Unallocated", "Not Despatched"),
        (3, D(0), D(-10), None, 3, "Partially Allocated", "Would be Partially Allocated", "Not Despatched"),
    ]
    assert [r["Unit Price (GBP)"] for r in rows] == [D(2)] * 3
    assert [r["Unit Price (System FX Rate)"] for r in rows] == [D(2)] * 3
    assert [r["Outstanding Value (GBP)"] for r in rows] == [D(120), D(100), D(60)]
    remapped = reports.allocation_report(order_book, remap_duplicates=True).collect()
    assert [r["Nominal Code"] for r in remapped] == ["4000", "4000", None]


def test_split_report_equals_whole_report(order_book):
    whole = reports.allocation_report(order_book)
    assert reports.allocation_report(order_book, hot_rows=1).collect() == whole.collect()


@pytest.mark.parametrize("collation, found", [(None, 0), ("UTF8_LCASE_RTRIM", 2)])
def test_collation_of_codes(spark, table, collation, found):
    table("ProductID int, ProductCode string", (1, "root"), (2, "Part-A ")).createOrReplaceTempView("ProductMaster")
    table("StructureID int, ProductID int, StructureType int, IsActive int", (1, 1, 0, 1), (2, 2, 0, 1)).createOrReplaceTempView("ProductStructure")
    table("StructureID int, PartNumber string, Description string, ComponentType string, QuantityRequired double",
          (1, "part-a", "A", "made", 1.0), (2, "part-b", "B", "made", 1.0)).createOrReplaceTempView("ComponentDetails")
    tables = erp.bom_tables(erp.catalog_reader(spark), collation)
    assert bom.explode_bom(bom.bom_edges(tables), "ROOT").count() == found


def test_parquet_extracts(spark, table, tmp_path):
    frames = {
        "ProductMaster": table("ProductID int, ProductCode string", (1, "R")),
        "ProductStructure": table("StructureID int, ProductID int, StructureType int, IsActive int", (1, 1, 0, 1)),
        "ComponentDetails": table("StructureID int, PartNumber string, Description string, ComponentType string, QuantityRequired double", (1, "A", "A", "made", 2.5)),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
    tables = erp.bom_tables(erp.parquet_reader(spark, str(tmp_path)))
    row = reports.bom_report(tables, "R").first()
    assert (row["Component"], row["Qty"]) == ("A", D("2.5"))


class Session:
    """Stands in for a session with given settings."""

    def __init__(self, master, folder=None, legacy=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder, self.legacy = master, folder, legacy
        self.applicationId = f"{master}-{folder}-{legacy}"

    def get(self, key, default):
        return (self.folder or default) if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.legacy


def test_scratch_folder_is_the_one_the_cluster_names():
    path = session.scratch_folder(Session("yarn", "hdfs://x/shared/"), "levels")
    assert path.startswith("hdfs://x/shared/levels-")
    assert session.scratch_folder(Session("yarn", None, "hdfs://y"), "levels").startswith("hdfs://y/levels-")
    with pytest.raises(ValueError):
        session.scratch_folder(Session("yarn"), "levels")
    assert session.scratch_folder(Session("local[2]"), "levels")


def test_reader_keeps_small_quantities_and_times(table):
    at = dt.datetime(2024, 5, 1, 13, 45)
    lines = table("OrderID int, LineNumber int, PromisedDeliveryDate timestamp_ntz", (1, 1, at))
    rows = erp.conform(lines, erp.FORECAST_EXTRACTS["order_lines"])
    assert rows.first().promised_date == at
    quantities = table("ForecastItemID int, PeriodID int, Quantity double", (1, 1, 0.000004), (1, 2, 0.0))
    kept = erp.conform(quantities, erp.FORECAST_EXTRACTS["quantities"]).where("quantity > 0")
    assert [r.quantity for r in kept.collect()] == [0.000004]
    exact = table("ForecastItemID int, PeriodID int, Quantity decimal(30,12)", (1, 1, D("0.000000000004")))
    assert erp.conform(exact, erp.FORECAST_EXTRACTS["quantities"]).first().quantity == D("0.000000000004")
    text = table("ForecastItemID int, PeriodID int, Quantity string", (1, 1, "2.5"))
    assert erp.conform(text, erp.FORECAST_EXTRACTS["quantities"]).first().quantity == 2.5
