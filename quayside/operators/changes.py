"""What differs between two versions of the product structures, and which products that touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.bom import Edges, _rows, stored_edges
from quayside.operators.hierarchy import change_impact
from quayside.session import stored

ENDS = ("parent_code", "component_code")
DETAILS = ("description", "component_type", "quantity")


def structure_changes(before: Edges, after: Edges) -> DataFrame:
    """Lines added, removed or changed, with their details before and after.

    Lines are compared as they stand, repeated ones by number and NULL as a value: equal lines of both
    versions cancel out by a sum, without a join. Of what is left, lines with the same parent and component are
    paired in the order of their details as ``changed``; the rest is ``added`` or ``removed``.
    """
    line = [*ENDS, *DETAILS]
    marked = _rows(before).select(*line, F.lit(-1).alias("side")).unionByName(
        _rows(after).select(*line, F.lit(1).alias("side")))
    left = marked.groupBy(*line).agg(F.sum("side").alias("copies")).where("copies <> 0")
    place = F.row_number().over(Window.partitionBy(*ENDS, F.col("copies") > 0).orderBy(*DETAILS, "copy"))
    copies = left.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("copies")))).withColumn("place", place)
    copies = stored(copies.select(*line, "place", (F.col("copies") > 0).alias("new")), "changes")

    def side(new, suffix):
        names = {name: f"{name}_{suffix}" for name in (*line, "place")}
        return copies.where(F.col("new") == F.lit(new)).select(*[F.col(name).alias(own) for name, own in names.items()])

    same = reduce(lambda a, b: a & b, [F.col(f"{name}_before").eqNullSafe(F.col(f"{name}_after")) for name in (*ENDS, "place")])
    pairs = side(False, "before").join(side(True, "after"), same, "full")
    change = (F.when(F.col("place_before").isNull(), "added").when(F.col("place_after").isNull(), "removed").otherwise("changed"))
    return pairs.select(
        change.alias("change"), *[F.coalesce(f"{name}_before", f"{name}_after").alias(name) for name in ENDS],
        *[f"{name}_{suffix}" for name in DETAILS for suffix in ("before", "after")])


def touched_products(changes: DataFrame, before: Edges, after: Edges) -> DataFrame:
    """Products whose structure changed, and all that contain them in either version, once per changed one.

    Columns changed_code, product_code, ``level`` (0 for the changed product itself) and ``is_top``.
    """
    both = stored_edges(_rows(before).select(*ENDS).unionByName(_rows(after).select(*ENDS)).distinct())
    changed = stored(changes.where(F.col("parent_code").isNotNull()).select(F.col("parent_code").alias("root_code")).distinct(), "changed")
    above = change_impact(both, changed)
    inner = both.rows.select(F.col("component_code").alias("root_code")).distinct().withColumn("inner", F.lit(True))
    itself = changed.join(inner.hint("merge"), "root_code", "left").select(
        "root_code", F.col("root_code").alias("product_code"), F.lit(0).alias("level"), F.col("inner").isNull().alias("is_top"))
    # A product on a cycle contains itself; that adds nothing to its own row.
    above = above.where(F.col("root_code") != F.col("product_code"))
    return above.unionByName(itself).withColumnRenamed("root_code", "changed_code")
