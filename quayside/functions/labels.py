"""Codes and quantities to report labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code lists of the order tables.
LINE_TYPES = {0: "Stock Item", 1: "Free Text", 2: "Additional Charge", 3: "Comment Line"}
ORDER_STATUSES = {0: "Live", 1: "On Hold", 2: "Completed", 3: "Dispute", 4: "Cancelled"}
DOCUMENT_TYPES = {0: "Sales Order", 1: "Sales Return"}
UNKNOWN = "Unknown"


def _label(code: Column, names: dict[int, str]) -> Column:
    lookup = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return F.try_element_at(lookup, code.cast("int"))


def line_type_label(code: Column) -> Column:
    return F.coalesce(_label(code, LINE_TYPES), F.lit(UNKNOWN))


def order_status_label(code: Column) -> Column:
    return F.coalesce(_label(code, ORDER_STATUSES), F.lit(UNKNOWN))


def document_type_label(code: Column) -> Column:
    """Unlike the other two code lists, an unlisted type has no label (NULL)."""
    return _label(code, DOCUMENT_TYPES)


def current_status(allocated: Column, despatched: Column, ordered: Column) -> Column:
    """Status before allocation; only an exact match counts as full."""
    served = allocated + despatched
    return (
        F.when(served == ordered, "Fully Allocated")
        .when(served > 0, "Partially Allocated")
        .otherwise("Not Allocated")
    )


def proposed_status(allocated: Column, proposed: Column, despatched: Column, ordered: Column) -> Column:
    """Status after allocation; here more than ordered counts as full too."""
    served = allocated + proposed + despatched
    return (
        F.when(served >= ordered, "Would be Fully Allocated")
        .when(served > 0, "Would be Partially Allocated")
        .otherwise("Would Remain Unallocated")
    )


def despatch_status(despatched: Column, ordered: Column) -> Column:
    """Less than one whole unit counts as nothing despatched."""
    return (
        F.when(despatched == ordered, "Fully Despatched")
        .when(despatched < 1, "Not Despatched")
        .otherwise("Partially Despatched")
    )
