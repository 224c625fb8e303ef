from quillon.operators.raw_records import Rule, clean_records, record_errors, typed

RULES = [Rule("s", 3, "unit_price", "decimal"), Rule("s", 4, "discount", "decimal", required=False, at_most=1.0), Rule("t", 4, "qty", "integer", above=0.0)]


def check(spark, lines, feed="s"):
    raw = spark.createDataFrame([(i, feed, x, "clash") for i, x in enumerate(lines)], "line_id long, feed string, line string, value string")
    errors = record_errors(raw, RULES, {"s": 5, "t": 5})
    got = {r["line_id"]: r["reason"] for r in errors.collect()}
    return [got.get(i) for i in range(len(lines))], raw, errors


def test_quoting(spark):
    lines = ['1,a,"b, c",1,0', '1,a,"b ""c""",1,', '1,a,b"c,1,0', '1,a,"b"c,1,0', '1,a, "b",1,0', '1,a,"b,1,0', '1,a,"""",1,0', '"1","a","b","1","0"', '1,a,"x\ny",1,0', '1,a,"b" ,1,0', '"']
    assert check(spark, lines)[0] == [None, None, "quoting", "quoting", "quoting", "quoting", None, None, None, "quoting", "quoting"]


def test_columns_and_order_of_reasons(spark):
    lines = ["", ",,,,", "1,a,b,1", "1,a,b,1,0,", "1;a;b;1;0", None, 'x,"y']
    assert check(spark, lines)[0] == ["columns", "value", "columns", "columns", "columns", "columns", "quoting"]


def test_values(spark):
    price = {"1": None, ".5": None, "5.": None, ".": "value", "": "value", " 2 ": None, "\t2": None, "-1": "value", "+1": "value", "1e3": "value", "٣": "value", "1.2.3": "value", "NaN": "value", "9" * 400: None}
    assert check(spark, [f"1,a,b,{p}," for p in price])[0] == list(price.values())
    discount = {"": None, " ": None, "1": None, "1.0": None, "1.01": "value", "0.5": None, "x": "value"}
    assert check(spark, [f"1,a,b,1,{d}" for d in discount])[0] == list(discount.values())
    qty = {"1": None, "0": "value", "00": "value", "007": None, "9223372036854775807": None, "9223372036854775808": "value", " 5 ": None, "５": "value", "": "value", "-1": "value", "0" * 30 + "1": None}
    assert check(spark, [f"t,s,b,1,{q}" for q in qty], "t")[0] == list(qty.values())


def test_clean_records_with_types(spark):
    _, raw, errors = check(spark, ['1,n,"a ""q"", b", 2.5 ,', "x,,c,1,0.5", "bad"])
    rows = typed(clean_records(raw, errors), "s", [("id", "bigint"), ("region", "string"), ("product", "string"), ("price", "double"), ("discount", "double")]).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[3]) == [(None, None, "c", 1.0, 0.5), (1, "n", 'a "q", b', 2.5, None)]


def test_long_repeated_empty_and_unknown(spark):
    quotes = '1,a,"' + '""' * 100_000 + '",1,0'
    assert check(spark, [quotes, "1,a," + "z" * 300_000 + ",1,0"])[0] == [None, None]
    assert check(spark, [])[0] == []
    assert check(spark, ["a,b", 'a"b'], "other")[0] == [None, "quoting"]
    raw = spark.createDataFrame([(1, "s", "bad"), (1, "s", '"'), (None, None, None)], "line_id long, feed string, line string")
    assert [tuple(r)[:2] for r in record_errors(raw, RULES, {"s": 5}).collect()] == [(1, "quoting")]
