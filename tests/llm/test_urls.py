import datetime as dt

from millrace.llm import queries, url_filter


def at(d: int) -> dt.datetime:
    return dt.datetime(2024, 1, d)


ENTRIES = [
    ("example.com", "spam", at(5), "add"), ("example.com", "spam", at(10), "remove"), ("a.example.com", "ads", at(1), "add"),
    ("b.org/x", "sect", at(1), "add"), ("b.org/x", "sect", at(1), "add"), ("tie.net", "t", at(3), "add"), ("tie.net", "t", at(3), "remove"),
    (None, "n", at(1), "add"), ("late.net", None, at(2), "add"), ("example.com", "spam", at(20), "add"),
]
CAPTURES = [
    (1, "https://a.example.com/p?q=1", at(6)), (2, "http://EXAMPLE.com.:80/", at(5)), (3, "http://example.com", at(10)), (4, "https://user:pw@b.org/x/y#f", at(2)),
    (5, "https://b.org/xy", at(2)), (6, None, at(2)), (7, "not a url", at(2)), (8, "https://tie.net/", at(4)), (9, "https://late.net", None), (10, "https://late.net", at(2)),
    (11, "https://notexample.com", at(6)), (1, "https://a.example.com/p?q=1", at(6)),
]


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "id long, url string, fetched_at timestamp").selectExpr("*", "'x' as host", "1 as category")
    return url_filter.evaluate(c, spark.createDataFrame(entries, "key string, category string, at timestamp, action string"))


def test_as_of(spark):
    got = {r["id"]: r for r in run(spark, CAPTURES, ENTRIES).collect()}
    assert got[1]["categories"] == ["ads", "spam"] and got[1]["n_rules"] == 2 and got[1]["active_since"] == at(5)
    assert got[2]["blocked"] and got[2]["host"] == "example.com"
    assert not got[3]["blocked"]
    assert got[4]["categories"] == ["sect"] and got[4]["n_rules"] == 1
    assert not any(got[i]["blocked"] for i in (5, 6, 7, 8, 9, 11))
    assert got[10]["categories"] == [""]
    assert run(spark, CAPTURES, ENTRIES).count() == len(CAPTURES)


def test_empty(spark):
    assert run(spark, [], ENTRIES).count() == 0
    assert run(spark, CAPTURES, []).filter("blocked").count() == 0


def test_native(spark):
    plan = queries.op4_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
