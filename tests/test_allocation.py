import datetime as dt
from decimal import Decimal
from random import Random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quayside.functions import currency, labels
from quayside.operators import allocation
from quayside.operators.skew import HotKeys, hot_keys, spread_join

LINE = (
    "line_id long, item_code string, already_allocated int, promised_date date,"
    " document_date date, due_quantity double"
)
DAY = dt.date(2024, 10, 25)


def day(offset):
    return None if offset is None else DAY + dt.timedelta(days=offset)


def test_earliest_promise_ranks_first(table):
    lines = table(LINE, *[(i, "X", 0, day(o), DAY, 1.0) for i, o in ((1, 2), (2, 0), (3, 1))])
    ranks = {r.line_id: r.priority_rank for r in allocation.priority_rank(lines).collect()}
    assert ranks == {2: 1, 3: 2, 1: 3}


def test_allocated_lines_last_unknown_dates_first_and_ties_by_line(table):
    lines = table(
        LINE,
        (1, "X", 1, day(-5), DAY, 1.0), (5, "X", 0, day(1), DAY, 1.0),
        (4, "X", 0, day(1), DAY, 1.0), (3, "X", 0, None, DAY, 1.0), (2, "X", 0, day(1), day(-1), 1.0),
    )
    ranks = [r.line_id for r in allocation.priority_rank(lines).orderBy("priority_rank").collect()]
    assert ranks == [3, 2, 4, 5, 1]


def test_waterfall_of_worked_example(table):
    lines = table(LINE, *[(i, "X", 0, day(i), DAY, float(q)) for i, q in ((1, 60), (2, 50), (3, 30))])
    stock = table("item_code string, current_stock double", ("X", 100.0))
    rows = allocation.waterfall_allocate(lines, stock).orderBy("line_id").collect()
    assert [r.proposed for r in rows] == [60, 40, 0]
    assert [r.used_before for r in rows] == [None, 60, 110]
    assert [r.remaining_before for r in rows] == [100, 40, -10]


def test_missing_and_negative_stock_serve_nothing(table):
    lines = table(LINE, (1, "X", 0, DAY, DAY, 5.0), (2, "Y", 0, DAY, DAY, 5.0))
    stock = table("item_code string, current_stock double", ("X", -3.0))
    rows = allocation.waterfall_allocate(lines, stock).orderBy("line_id").collect()
    assert [(r.total_stock, r.proposed) for r in rows] == [(-3.0, 0.0), (0.0, 0.0)]


def expected(lines, stock):
    """Serve the lines one by one."""
    result = {}
    for item in {line[1] for line in lines}:
        left, used, rank = stock.get(item, 0.0), None, 0
        key = lambda l: (l[2], l[3] or dt.date.min, l[4] or dt.date.min, l[0])
        for line in sorted((line for line in lines if line[1] == item), key=key):
            rank += 1
            share = max(0.0, min(line[5], left))
            result[line[0]] = (rank, used, share)
            used, left = (used or 0.0) + line[5], left - line[5]
    return result


def random_lines(items, spacing):
    """Lines of many items with few different dates, so that ties are common."""
    random = Random(spacing)
    drawn = [
        (
            f"I{item}", random.choice([0, 0, 1]), day(random.choice([None, 0, 1, 2])),
            day(random.choice([None, 0, 1])), float(random.randint(1, 9)),
        )
        for item in range(items)
        for _ in range(random.randint(1, 40))
    ]
    random.shuffle(drawn)
    return [(n * spacing, *line) for n, line in enumerate(drawn)]


@pytest.mark.parametrize("spacing", [1, 2**19, 2**39])
def test_whole_and_split_items_agree_with_serving_one_by_one(table, spacing):
    lines = random_lines(60, spacing)
    stocks = {f"I{item}": float(item * 3 - 5) for item in range(55)}
    want = expected(lines, stocks)
    frame = table(LINE, *lines)
    stock = table("item_code string, current_stock double", *stocks.items())
    split = table("item_code string, _parts long", *[(f"I{item}", 2) for item in range(0, 60, 2)])
    for hot in (None, HotKeys(split, 1), HotKeys(split, 6), HotKeys(split, 1000)):
        rows = allocation.waterfall_allocate(frame, stock, hot).collect()
        got = {r.line_id: (r.priority_rank, r.used_before, r.proposed) for r in rows}
        assert len(rows) == len(lines)
        assert got == want


def test_item_gets_what_there_is_and_no_line_more_than_due(table):
    stocks = {f"I{item}": float(item * 3 - 5) for item in range(40)}
    stock = table("item_code string, current_stock double", *stocks.items())
    rows = allocation.waterfall_allocate(table(LINE, *random_lines(40, 1)), stock)
    assert rows.where((F.col("proposed") < 0) | (F.col("proposed") > F.col("due_quantity"))).count() == 0
    totals = rows.groupBy("item_code").agg(
        F.sum("proposed").alias("proposed"), F.sum("due_quantity").alias("due"),
        F.first("total_stock").alias("stock"), F.count(F.lit(1)).alias("lines"),
        F.collect_set("priority_rank").alias("ranks"),
    )
    for row in totals.collect():
        assert row.proposed == min(max(row.stock, 0), row.due)
        assert sorted(row.ranks) == list(range(1, row.lines + 1))


def test_hot_keys_and_spread_join(spark, table):
    rows = spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), F.col("id"))).alias("key")
    )
    assert hot_keys(rows, "key") is None
    assert hot_keys(rows, "key", 100) is None
    hot = hot_keys(rows, "key", 30)
    assert [tuple(r) for r in hot.keys.collect()] == [("HOT", 4)]
    right = table("key string, value int", ("HOT", 1), ("HOT", 2), ("K1", 3), ("NONE", 4))
    spread = spread_join(rows, right, "key", "id", hot)
    plain = rows.join(right, "key", "left")
    assert sorted(map(str, spread.select("id", "key", "value").collect())) == sorted(
        map(str, plain.select("id", "key", "value").collect())
    )


def test_hot_window_runs_per_cell(spark, without_adaptive):
    lines = spark.range(1000).select(
        F.col("id").alias("line_id"), F.lit("X").alias("item_code"), F.lit(0).alias("already_allocated"),
        F.date_add(F.lit(DAY), (F.col("id") % 20).cast("int")).alias("promised_date"),
        F.lit(DAY).alias("document_date"), F.lit(1.0).alias("due_quantity"),
    )
    hot = hot_keys(lines, "item_code", 100)
    ranked = allocation.running_demand(lines.repartition("item_code"), hot)
    per_task = ranked.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 1000
    assert ranked.agg(F.max("priority_rank")).first()[0] == 1000
    assert ranked.where(F.col("priority_rank") != F.coalesce("used_before", F.lit(0)) + 1).count() == 0


def test_accounts_keep_lowest_id(table):
    accounts = table(
        "account_id long, account_number string, account_name string",
        (7, "4000", "Sales"), (3, "4000", "Sales"), (9, "4000", "Other"),
    )
    assert sorted(r.account_id for r in allocation.dedupe_accounts(accounts).collect()) == [3, 9]
    assert allocation.dedupe_accounts(accounts, remap_duplicates=True).count() == 3


def test_stock_adds_up_and_unknown_stays_null(table):
    movements = table(
        "item_id long, opening_stock double, stock_issued double",
        (1, 10.0, 4.0), (1, 5.0, None), (2, 8.0, None), (3, 1.0, 1.0),
    )
    items = table("item_id long, item_code string", (1, "A"), (2, "B"))
    rows = allocation.stock_levels(movements, items).collect()
    assert {r.item_code: r.current_stock for r in rows} == {"A": 11.0, "B": None}


def evaluate(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(value):
    return F.lit(value)


@pytest.mark.parametrize("allocated, despatched, proposed, now, then", [
    (4.0, 6.0, 0.0, "Fully Allocated", "Would be Fully Allocated"),
    (6.0, 6.0, 0.0, "Partially Allocated", "Would be Fully Allocated"),
    (0.0, 1.0, 2.0, "Partially Allocated", "Would be Partially Allocated"),
    (0.0, 0.0, 0.0, "Not Allocated", "Would Remain Unallocated"),
    (None, 5.0, 5.0, "Not Allocated", "Would Remain Unallocated"),
])
def test_status(spark, allocated, despatched, proposed, now, then):
    a = lit(allocated).cast("double")
    row = evaluate(
        spark, labels.current_status(a, lit(despatched), lit(10.0)),
        labels.proposed_status(a, lit(proposed), lit(despatched), lit(10.0)),
    )
    assert row == (now, then)


@pytest.mark.parametrize("despatched, label", [
    (10.0, "Fully Despatched"), (0.0, "Not Despatched"), (0.5, "Not Despatched"),
    (1.0, "Partially Despatched"), (12.0, "Partially Despatched"),
])
def test_despatch(spark, despatched, label):
    assert evaluate(spark, labels.despatch_status(lit(despatched), lit(10.0))) == (label,)


def test_code_labels(spark):
    names = [labels.line_type_label(lit(c)) for c in (0, 1, 2, 3, 4)]
    assert evaluate(spark, *names) == (
        "Stock Item", "Free Text", "Additional Charge", "Comment Line", "Unknown")
    names = [labels.order_status_label(lit(c)) for c in (0, 1, 2, 3, 4, 5)]
    assert evaluate(spark, *names) == (
        "Live", "On Hold", "Completed", "Dispute", "Cancelled", "Unknown")
    null = F.lit(None).cast("int")
    names = [labels.document_type_label(c) for c in (lit(0), lit(1), lit(2), null)]
    assert evaluate(spark, *names, labels.line_type_label(null)) == (
        "Sales Order", "Sales Return", None, None, "Unknown")


def test_conversions_differ_for_euro(spark):
    rate = lit(0.8)
    system = [currency.at_system_rate(lit(10.0), lit(c), lit(b), rate) for c, b in ((1, 9.0), (2, 4.0), (3, 4.0), (3, 0.0))]
    assert evaluate(spark, *system) == (10.0, 8.0, 2.0, None)
    forecast = [
        currency.at_forecast_rate(lit(p), lit(c), lit(b), rate)
        for p, c, b in ((10.0, 1, 9.0), (10.0, 2, 4.0), (10.0, 3, 0.0), (0.0, 3, 4.0))
    ]
    assert evaluate(spark, *forecast) == (10.0, 2.0, None, 0.0)


def test_zero_document_rate_is_an_error(spark):
    with pytest.raises(PySparkException, match="DIVIDE_BY_ZERO"):
        evaluate(spark, currency.at_document_rate(lit(1.0), F.col("id").cast("double")))


def test_gbp_rate_must_be_single(spark, table):
    schema = "currency_id long, gbp_rate double"
    assert evaluate(spark, currency.gbp_rate(table(schema, (1, 0.85), (2, 9.0)))) == (0.85,)
    assert evaluate(spark, currency.gbp_rate(table(schema, (2, 9.0)))) == (None,)
    with pytest.raises(Exception, match="TOO_MANY_ROWS"):
        evaluate(spark, currency.gbp_rate(table(schema, (1, 0.85), (1, 0.86))))


def test_decimals_stay_exact(table):
    lines = table(LINE.replace("double", "decimal(18,5)"), *[
        (i, "X", 0, day(i), DAY, Decimal("0.10000")) for i in range(3)
    ])
    stock = table("item_code string, current_stock decimal(28,5)", ("X", Decimal("0.25")))
    rows = allocation.waterfall_allocate(lines, stock).orderBy("line_id").collect()
    assert [r.proposed for r in rows] == [Decimal("0.1"), Decimal("0.1"), Decimal("0.05")]


@pytest.mark.parametrize("kind, total", [("decimal(18,5)", "decimal(38,5)"), ("double", "double"), ("bigint", "bigint")])
def test_types_do_not_depend_on_the_split(spark, kind, total):
    lines = spark.range(300).select(
        F.col("id").alias("line_id"), F.concat(F.lit("I"), F.col("id") % 2).alias("item_code"),
        F.lit(0).alias("already_allocated"), F.lit(DAY).alias("promised_date"), F.lit(DAY).alias("document_date"),
        F.lit(2).cast(kind).alias("due_quantity"),
    )
    whole = allocation.running_demand(lines)
    split = allocation.running_demand(lines, hot_keys(lines, "item_code", 50))
    assert split.dtypes == whole.dtypes
    assert dict(whole.dtypes)["used_before"] == total
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_lines_without_item_are_one_group_cut_like_any_other(spark, without_adaptive):
    at = F.timestamp_add("MINUTE", (F.col("id") * 7).cast("int"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))
    lines = spark.range(1000).select(
        F.col("id").alias("line_id"), F.when(F.col("id") % 10 == 0, "").alias("item_code"),
        F.lit(0).alias("already_allocated"), at.alias("promised_date"), F.lit(DAY).alias("document_date"),
        F.lit(1.0).alias("due_quantity"),
    )
    hot = hot_keys(lines, "item_code", 90)
    assert hot.keys.count() == 2
    stock = spark.createDataFrame([("", 5.0), (None, 9.0)], "item_code string, current_stock double")
    whole = allocation.waterfall_allocate(lines, stock)
    split = allocation.waterfall_allocate(lines, stock, hot)
    assert split.dtypes == whole.dtypes
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    per_task = split.where("item_code IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1
    joined = allocation.with_stock(lines, stock, hot).where("item_code IS NULL")
    assert joined.where("total_stock <> 0").count() == 0
    assert len(joined.groupBy(F.spark_partition_id()).count().collect()) > 1
