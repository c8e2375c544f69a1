from quayside.operators import quality


def test_checks_find_what_is_wrong(table):
    rates = table("currency_id long, base_rate double", (1, 0.8), (1, 0.9), (2, 0.0), (3, None))
    assert quality.gbp_rows(rates).count() == 2
    assert quality.zero_rates(rates).count() == 2
    assert [tuple(r) for r in quality.repeated_keys(rates, "currency_id").collect()] == [(1, 2)]
    frequencies = table("frequency_id long, frequency string", (1, "Weekly"), (2, "Yearly"), (3, None))
    assert sorted(r.frequency_id for r in quality.unknown_frequencies(frequencies).collect()) == [2, 3]
    lines = table("line_id long, account_id long", (1, 1), (2, 9), (3, None))
    accounts = table("account_id long, account_name string", (1, "a"))
    assert quality.unmatched(lines, accounts, "account_id").count() == 2


def test_keys_without_a_partner(table):
    lines = table("order_id long, line_number int, item string", (1, 1, "a"), (1, 2, "b"), (9, 1, "a"), (9, 2, None), (None, 1, "a"))
    orders = table("id int", (1,), (2,), (None,))
    views = table("order_id string, number long", ("1", 1), ("1", 1), ("9", None), ("11", 2))
    tables = [(lines, [quality.Reference("order", ["order_id"], orders, ["id"]),
                       quality.Reference("view", ["order_id", "line_number"], views, ["order_id", "number"])]),
              (orders, [quality.Reference("self", ["id"], orders, ["id"])])]
    found = {(r.check_name, r.key): r.rows for r in quality.missing_references(tables).collect()}
    assert found == {("order", "9"): 2, ("order", "?"): 1, ("view", "1/2"): 1, ("view", "9/1"): 1, ("view", "9/2"): 1,
                     ("view", "?/1"): 1, ("self", "?"): 1}
    summary = {r.check_name: (r.missing_keys, r.dropped_rows) for r in quality.reference_checks(tables).collect()}
    assert summary == {"order": (2, 3), "view": (4, 4), "self": (1, 1)}
    whole = [(orders.where("id = 1"), [quality.Reference("self", ["id"], orders, ["id"])])]
    assert [tuple(r) for r in quality.reference_checks(whole).collect()] == [("self", 0, 0)]
    assert quality.missing_references([(lines.limit(0), tables[0][1])]).count() == 0


def test_whole_numbers_are_compared_as_such(table):
    lines = table("order_id long, line_number int", (1, 1), (1, 12), (11, 2), (None, 0), (0, None))
    views = table("id int, number long", (1, 1), (None, 0), (0, None), (0, 0), (11, 2))
    tables = [(lines, [quality.Reference("view", ["order_id", "line_number"], views, ["id", "number"]),
                       quality.Reference("order", ["order_id"], views, ["id"])])]
    rows = quality.missing_references(tables)
    assert {(r.check_name, r.key): r.rows for r in rows.collect()} == {
        ("view", "1/12"): 1, ("view", "?/0"): 1, ("view", "0/?"): 1, ("order", "?"): 1}
    assert " as string)" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]


def test_checks_of_one_name_and_other_kinds_share_their_partners(table):
    first = table("id long, code string", (1, "a"), (2, "b/c"))
    second = table("id string, code string", ("1", "a"), ("02", None))
    tables = [(first, [quality.Reference("same", ["id"], first.where("id = 1"), ["id"]),
                       quality.Reference("codes", ["code"], second, ["code"])]),
              (second, [quality.Reference("same", ["id"], first.where("id = 1"), ["id"])])]
    assert {(r.check_name, r.key): r.rows for r in quality.missing_references(tables).collect()} == {
        ("same", "2"): 1, ("same", "02"): 1, ("codes", "b/c"): 1}
