"""Job inputs derived from the order, part and customer tables of the test data.

The rules are those of FIXTURES.md part B. The bundles hold unevaluated DataFrames and are
defined once per session and folder, as views would be. A real installation reads its own extracts with
:mod:`quayside.sources.erp` instead, where line and item ids are given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators.scan import ordered_scan
from quayside.operators.skew import hot_keys
from quayside.sources.tables import AllocationTables, BomTables, ForecastTables

# Root product, report moment and earliest date used with these inputs.
BOM_ROOT = "P0000000"
AS_OF = "1999-06-15 12:00:00"
FROM_DATE = "1996-01-01"

# Symbol, base rate and document rate by region key.
CURRENCIES = {
    0: ("GBP", 0.85, 1.0),
    1: ("EUR", 1.0, 1.17),
    2: ("USD", 1.25, 1.25),
    3: ("SEK", 12.5, 13.1),
    4: ("XXX", 0.0, 4.6),
}
GBP_RATE = 0.85
FREQUENCIES = {1: "Weekly", 2: "Monthly", 3: "Daily", 4: "Quarterly", 5: "Yearly"}
PERIODS = 6
CHAIN = 40
ITEM_ID_STEP = 10_000_000_000
LINE_ID_STEP = 10_000_000


# Columns of the test tables, declared so that no job has to look them up.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
}


def reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _code(key: str) -> Column:
    """Product code: at least seven digits, never cut."""
    digits = F.col(key).cast("string")
    return F.concat(F.lit("P"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), "0"))


def _by_region(position: int, region: str) -> Column:
    lookup = F.create_map(*[
        F.lit(part) for key, values in CURRENCIES.items() for part in (key, values[position])
    ])
    return lookup[F.col(region)]


def _mod(key: str, divisor: int) -> Column:
    return F.col(key) % divisor


@cache
def bom(spark: SparkSession, folder: str) -> BomTables:
    """Each part has an active structure and an inactive one; part p is made of 3p+1 to 3p+4."""
    part = reader(spark, folder)("part")
    products = part.select(
        F.col("p_partkey").alias("product_id"), _code("p_partkey").alias("product_code")
    )
    versions = part.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    versions = versions.withColumn("structure_id", F.col("p_partkey") * 2 + F.col("version"))
    active = F.col("version") == 0
    structures = versions.select(
        "structure_id",
        F.col("p_partkey").alias("product_id"),
        F.when(active | (_mod("p_partkey", 2) != 0), 0).otherwise(1).alias("structure_type"),
        F.when(active | (_mod("p_partkey", 2) == 0), 1).otherwise(0).alias("is_active"),
    )
    position = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("position")
    child = part.select(
        F.col("p_partkey").alias("child_key"), "p_name", "p_type",
        _code("p_partkey").alias("part_number"),
    )
    components = (
        versions.select("*", position)
        .withColumn("child_key", F.col("p_partkey") * 3 + F.col("position"))
        .join(child.hint("merge"), "child_key")
        .select(
            "structure_id",
            "part_number",
            F.col("p_name").alias("description"),
            F.col("p_type").alias("component_type"),
            F.when(active, 1 + (F.col("p_partkey") + F.col("position")) % 5)
            .otherwise(99)
            .cast("double")
            .alias("quantity_required"),
        )
    )
    return BomTables(products, structures, components)


def _lines(read) -> DataFrame:
    """Order lines with a unique id; the line number alone repeats within an order.

    The last three of the columns that tell the lines of an order apart are packed into one
    number, which lets the scan split an order with very many lines.
    """
    lineitem = read("lineitem")
    tail = (
        F.col("l_suppkey") * 10_000_000
        + F.unix_date(F.col("l_shipdate").cast("date")) * 100
        + F.col("l_quantity").cast("bigint")
    )
    positions = ordered_scan(
        lineitem.withColumn("_tail", tail), key="l_orderkey",
        order=(("l_linenumber",), ("l_partkey",)), row_id="_tail", amount="l_quantity",
        rank="_position", before="_before", hot=hot_keys(lineitem, "l_orderkey"),
    )
    return positions.withColumns({
        "line_id": F.col("l_orderkey") * LINE_ID_STEP + F.col("_position"),
        "item_code": _code("l_partkey"),
    })


def _customer_regions(read) -> DataFrame:
    nation = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return read("customer").join(nation, "c_nationkey")


def _document(read) -> DataFrame:
    """Header columns both the allocation and the forecast job use."""
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", 0)
        .when(F.col("o_orderstatus") == "P", 1)
        .otherwise(2 + key % 3)
    )
    number = F.concat(F.when(key % 50 == 0, "#T").otherwise("SO"), key.cast("string"))
    return read("orders").select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        number.alias("document_no"),
        status.cast("int").alias("document_status"),
        F.when(key % 10 == 0, 1).otherwise(0).alias("document_type"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


@cache
def allocation(spark: SparkSession, folder: str) -> AllocationTables:
    read = reader(spark, folder)
    account_id = F.col("n_nationkey").cast("bigint")
    accounts = read("nation").select(
        F.explode(F.array(account_id, account_id + 1000)).alias("account_id"),
        (4000 + F.col("n_nationkey")).cast("string").alias("account_number"),
        F.col("n_name").alias("account_name"),
    )
    part = read("part")
    items = part.select(F.col("p_partkey").alias("item_id"), _code("p_partkey").alias("item_code"))

    moved = part.where(_mod("p_partkey", 17) != 0)
    issued = F.when(_mod("p_partkey", 13) == 0, 4 * F.col("p_size") + 50).otherwise(F.col("p_size"))
    movements = moved.select(
        F.col("p_partkey").alias("item_id"),
        (4 * F.col("p_size")).cast("double").alias("opening_stock"),
        issued.cast("double").alias("stock_issued"),
    ).unionByName(
        moved.where(_mod("p_partkey", 3) == 0).select(
            F.col("p_partkey").alias("item_id"),
            F.lit(20.0).alias("opening_stock"),
            F.lit(0.0).alias("stock_issued"),
        )
    )

    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    line_type = (
        F.when(number == 7, 3)
        .when(number == 6, 1)
        .when((number == 5) & (_mod("l_suppkey", 2) == 0), 2)
        .when((number == 5) & (_mod("l_suppkey", 5) == 0), 9)
        .otherwise(0)
    )
    despatched = (
        F.when((F.col("l_linestatus") == "F") & (number % 2 == 0), quantity)
        .when(number % 3 == 0, F.floor(quantity / 2))
        .otherwise(0)
    )
    allocated = (
        F.when((number == 1) & (_mod("l_partkey", 7) == 0), None)
        .when(F.col("l_returnflag") == "A", F.floor(quantity / 4))
        .when((F.col("l_returnflag") == "R") & (_mod("l_partkey", 5) == 0), quantity)
        .otherwise(0)
    )
    nominal = _mod("l_suppkey", 25) + F.when(number == 2, 1000).when(number == 4, 5000).otherwise(0)
    keyed = _lines(read)
    lines = keyed.select(
        "line_id",
        F.col("l_orderkey").alias("order_id"),
        number.alias("line_number"),
        quantity.alias("line_quantity"),
        despatched.cast("double").alias("despatched_quantity"),
        despatched.cast("double").alias("invoiced_quantity"),
        allocated.cast("double").alias("allocated_quantity"),
        line_type.alias("line_type"),
        nominal.cast("bigint").alias("nominal_id"),
    )
    names = part.select(
        F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_retailprice").alias("unit_price")
    )
    line_view = keyed.join(names, "l_partkey").select(
        "line_id",
        "item_code",
        F.col("p_name").alias("item_description"),
        quantity.alias("quantity"),
        "unit_price",
        F.col("l_extendedprice").alias("line_value"),
    )

    regions = _customer_regions(read).select(F.col("c_custkey").alias("customer_id"), "n_regionkey")
    month = F.trunc("order_date", "month")
    order = F.col("order_id")
    headers = (
        _document(read)
        .join(regions, "customer_id")
        .select(
            "order_id", "customer_id",
            (F.col("n_regionkey") + 1).cast("bigint").alias("currency_id"),
            "document_no",
            F.concat(F.lit("PO"), order.cast("string")).alias("customer_document_no"),
            F.concat(F.lit("QU"), order.cast("string")).alias("source_document_no"),
            _by_region(2, "n_regionkey").alias("exchange_rate"),
            month.alias("document_date"),
            F.col("order_date").alias("requested_date"),
            F.date_add(month, (15 * (order % 3)).cast("int")).alias("promised_date"),
            "document_type", "document_status",
        )
    )
    customers = read("customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("CUST"), F.col("c_custkey").cast("string")).alias("customer_code"),
        F.col("c_name").alias("customer_name"),
    )
    rates = _currencies(read)
    return AllocationTables(
        accounts=accounts, items=items, movements=movements, lines=lines, headers=headers,
        customers=customers, line_view=line_view,
        currencies=rates.drop("gbp_rate"),
        system_currency=rates.where(F.col("currency_id") == 1).select("currency_id", "gbp_rate"),
    )


def _currencies(read) -> DataFrame:
    return read("region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("currency_id"),
        _by_region(0, "r_regionkey").alias("currency"),
        _by_region(1, "r_regionkey").alias("base_rate"),
        F.when(F.col("r_regionkey") == 0, F.lit(GBP_RATE)).alias("gbp_rate"),
    )


@cache
def forecast(spark: SparkSession, folder: str) -> ForecastTables:
    """Every order also stands for a forecast of the parts on it, and of some others.

    Ids hold as long as part keys stay below 10**9 and order keys below 9 * 10**8.
    """
    read = reader(spark, folder)
    part = read("part")
    part_count = part.agg(F.count(F.lit(1)).alias("n")).scalar()

    documents = _document(read)
    forecast_lines = read("lineitem")
    starts = forecast_lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_shipdate").cast("date").alias("start_date")
    )
    order = F.col("order_id")
    headers = (
        documents.join(starts, "order_id")
        .select(
            order.alias("forecast_id"),
            "customer_id",
            (order % 5 + 1).alias("frequency_id"),
            F.concat(F.lit("FC-"), order.cast("string")).alias("forecast_reference"),
            "start_date",
        )
    )
    frequencies = read("region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("frequency_id")
    ).withColumn(
        "frequency",
        F.create_map(*[F.lit(x) for pair in FREQUENCIES.items() for x in pair])[
            F.col("frequency_id").cast("int")
        ],
    )

    key, product = F.col("l_orderkey"), F.col("l_partkey")
    variant = F.explode(
        F.filter(
            F.array(
                F.lit(0),
                F.when((key + product) % 5 == 0, 1),
                F.when((key + product) % 4 == 0, 2),
            ),
            lambda v: v.isNotNull(),
        )
    )
    # Spread as the headers join it; a number keeps adaptive execution from merging partitions, which are small
    # here, but whose rows become a dozen each further on.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = (
        forecast_lines.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()
        .select("*", variant.alias("variant"))
        .select(
            (key * ITEM_ID_STEP + product * 10 + F.col("variant")).alias("forecast_item_id"),
            key.alias("forecast_id"),
            F.when(F.col("variant") == 2, (product + 1) % part_count)
            .otherwise(product)
            .alias("product_id"),
        )
    )
    period = F.sequence(F.lit(1), F.lit(PERIODS))
    periods = read("region").where(F.col("r_regionkey") == 0).select(
        F.explode(period).alias("period_sequence")
    ).select(F.col("period_sequence").cast("bigint").alias("period_id"), "period_sequence")
    quantities = items.select("forecast_item_id", F.explode(period).alias("period")).select(
        "forecast_item_id",
        F.col("period").cast("bigint").alias("period_id"),
        ((F.col("forecast_item_id") + F.col("period")) % 40).cast("double").alias("quantity"),
    )

    orders = documents.select(
        "order_id", "customer_id", F.col("document_no").alias("order_number"),
        "document_type", "document_status",
    )
    keyed = _lines(read)
    order_lines = keyed.select(
        key.alias("order_id"),
        F.col("line_id").alias("line_number"),
        F.col("l_shipdate").cast("date").alias("promised_date"),
    )
    order_line_view = keyed.select(
        key.alias("order_id"),
        F.col("line_id").alias("line_number"),
        F.col("item_code").alias("product_code"),
        F.col("l_quantity").alias("order_quantity"),
    )
    customers = _customer_regions(read).select(
        F.col("c_custkey").alias("customer_id"),
        _mod("c_custkey", 5).alias("price_band_id"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("currency_id"),
        F.concat(F.lit("CUST"), F.col("c_custkey").cast("string")).alias("customer_code"),
    )
    products = part.select(
        F.col("p_partkey").alias("product_id"), _code("p_partkey").alias("product_code")
    )
    return ForecastTables(
        headers=headers, frequencies=frequencies, items=items, quantities=quantities,
        periods=periods, orders=orders, order_lines=order_lines,
        order_line_view=order_line_view, customers=customers, products=products,
        prices=_prices(part), currencies=_currencies(read),
    )


def _prices(part: DataFrame) -> DataFrame:
    """Five bands per part with gaps, zero prices and some bands listed twice."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint") * (100 - F.col("band"))
    priced = F.when(_mod("p_partkey", 19) != 0, F.floor((cents + 50) / 100) / 100)
    twice = (
        (F.col("band") == 0) & (_mod("p_partkey", 11) == 0) & (_mod("p_partkey", 19) != 0)
    )
    return (
        part.select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("band"))
        .where((F.col("p_partkey") + F.col("band")) % 23 != 0)
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("band").cast("bigint").alias("price_band_id"),
            F.coalesce(priced, F.lit(0.0)).alias("unit_price"),
            F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
        )
        .drop("col")
    )


def part_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Retail prices stand in for costs; every eleventh part has none."""
    return reader(spark, folder)("part").where(_mod("p_partkey", 11) != 0).select(
        _code("p_partkey").alias("component_code"), F.col("p_retailprice").alias("unit_cost")
    )


def part_lead_days(spark: SparkSession, folder: str) -> DataFrame:
    """The test data has no lead times; the part size stands in, and every seventh part has none."""
    return reader(spark, folder)("part").where(_mod("p_partkey", 7) != 0).select(
        _code("p_partkey").alias("component_code"), F.col("p_size").alias("lead_days")
    )


def part_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Lots of 1 to 25; every third part has none."""
    return reader(spark, folder)("part").where(_mod("p_partkey", 3) != 0).select(
        _code("p_partkey").alias("item_code"), (_mod("p_partkey", 25) + 1).alias("lot_size"))


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Returned goods stand in for expected receipts."""
    return reader(spark, folder)("lineitem").where(F.col("l_returnflag") == "R").select(
        _code("l_partkey").alias("item_code"), F.col("l_shipdate").cast("date").alias("due_date"),
        F.col("l_quantity").alias("quantity"))


def chain_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of forty parts, each made of half or one and a half of the next."""
    part = reader(spark, folder)("part")
    below = part.select(
        (F.col("p_partkey") - 1).alias("above_key"), _code("p_partkey").alias("component_code"),
        F.col("p_name").alias("description"), F.col("p_type").alias("component_type"),
    ).where((F.col("above_key") + 1) % CHAIN != 0)
    return part.join(below.hint("merge"), F.col("p_partkey") == F.col("above_key")).select(
        _code("p_partkey").alias("parent_code"), "component_code", "description", "component_type",
        F.when(_mod("p_partkey", 2) == 0, 0.5).otherwise(1.5).alias("quantity"),
    )


def _key(code: str) -> Column:
    return F.substring(code, 2, 30).cast("bigint")


def changed_edges(spark: SparkSession, folder: str, edges: DataFrame) -> DataFrame:
    """A later version of the structures: lines left out, doubled, with other quantities, and new ones."""
    turn = _key("parent_code") + _key("component_code")
    quantity = F.when(turn % 7 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))
    copies = F.when(turn % 11 == 0, 2).when(turn % 9 == 0, 0).otherwise(1)
    kept = edges.withColumn("copies", copies).where("copies > 0").withColumn("quantity", quantity).select(
        *edges.columns, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")
    part = reader(spark, folder)("part")
    below = part.select(
        (F.col("p_partkey") - 1).alias("above_key"), _code("p_partkey").alias("component_code"),
        F.col("p_name").alias("description"), F.col("p_type").alias("component_type"),
    ).where(_mod("above_key", 13) == 0)
    new = part.join(below.hint("merge"), F.col("p_partkey") == F.col("above_key")).select(
        _code("p_partkey").alias("parent_code"), "component_code", "description", "component_type", F.lit(2.0).alias("quantity"))
    return kept.select(*new.columns).unionByName(new)


def ring_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The chains, some of them closed: from the end back to seven parts above, or to themselves."""
    ends = reader(spark, folder)("part").where(_mod("p_partkey", CHAIN) == CHAIN - 1).withColumn(
        "chain", F.floor(F.col("p_partkey") / CHAIN))
    back = F.when(_mod("chain", 3) == 0, F.col("p_partkey") - 7).when(_mod("chain", 3) == 1, F.col("p_partkey"))
    closing = ends.withColumn("back", back).where("back IS NOT NULL").select(
        _code("p_partkey").alias("parent_code"), _code("back").alias("component_code"))
    return chain_edges(spark, folder).select("parent_code", "component_code").unionByName(closing)


def long_chain_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The chains with codes of 250 characters, so that paths pass their limit before the depth does."""
    return chain_edges(spark, folder).withColumns({
        name: F.rpad(name, 250, "-") for name in ("parent_code", "component_code")})


def thinned(
    bom: BomTables, allocation: AllocationTables, forecast: ForecastTables
) -> tuple[BomTables, AllocationTables, ForecastTables]:
    """The inputs with some referenced rows gone, as extracts taken at different times have them."""
    def without(rows, key, divisor, rest):
        return rows.where(_mod(key, divisor) != rest)

    return (
        bom._replace(products=without(bom.products, "product_id", 41, 3), structures=without(bom.structures, "structure_id", 37, 5)),
        allocation._replace(
            items=without(allocation.items, "item_id", 43, 1), headers=without(allocation.headers, "order_id", 29, 2),
            customers=without(allocation.customers, "customer_id", 31, 4), line_view=without(allocation.line_view, "line_id", 23, 6)),
        forecast._replace(
            headers=without(forecast.headers, "forecast_id", 29, 2), periods=without(forecast.periods, "period_id", 6, 5),
            orders=without(forecast.orders, "order_id", 53, 7), customers=without(forecast.customers, "customer_id", 31, 4),
            order_line_view=without(forecast.order_line_view, "line_number", 23, 6),
            currencies=without(forecast.currencies, "currency_id", 5, 4)),
    )
