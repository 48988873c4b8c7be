"""Question tagging on phrases whose intent is known."""

import datetime as dt

import pytest

from tradewind.functions import text

INTENTS = [
    ("SELECT * FROM serving.kpi_overview", "sql_query"),
    ("show table schema for payments", "schema_search"),
    ("what is gmv definition", "business_definition"),
    ("monthly revenue trend", "kpi_summary"),
    ("GMV la gi", "business_definition"),
    ("AOV viet tat tu gi", "business_definition"),
    ("xu huong doanh thu", "kpi_summary"),
    ("doanh thu theo danh muc", "sql_query"),
    ("hi", "chitchat"),
    ("", "chitchat"),
    (None, "chitchat"),
    (" \t HELP \n", "help_request"),
    ("danh sách đơn hàng", "sql_query"),
    ("selection of cookies over there maybe", "sql_query"),
    ("voyage around a moon of jupiter", "chitchat"),
    ("find all my open voyages at once now", "sql_query"),
    ("find anything about our voyage now", "chitchat"),
    ("rows from a, b where x", "sql_query"),
    ("metadata field", "schema_search"),
    ("kpi bảng", "schema_search"),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(INTENTS)], "i int, q string")
    got = {r.i: r.intent for r in text.tag_intent(df, "q").collect()}
    wrong = [(q, got[i], w) for i, (q, w) in enumerate(INTENTS) if got[i] != w]
    assert wrong == []


@pytest.mark.parametrize("question, word", [
    ("show table schema for payments", "payments"),
    ("what is the meaning of it", "it"),
    ("list Orders_v2 please", "orders_v"),
    ("  ¿? 12 ", "¿? 12"),
])
def test_keyword(spark, question, word):
    if word == "it":
        word = question
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(text.keyword("q").alias("k")).collect()[0].k == word


@pytest.mark.parametrize("question, start, end", [
    ("from 2018-02-01 to 2018-03-31 or 2019-01-01", dt.date(2018, 2, 1), dt.date(2018, 3, 31)),
    ("since 2018-02-30", None, dt.date(2018, 12, 31)),
    ("all of it", dt.date(2017, 1, 1), dt.date(2018, 12, 31)),
    ("0000-01-01 and 2018-13-01", None, None),
    ("id 12018-01-022", dt.date(2018, 1, 2), dt.date(2018, 12, 31)),
])
def test_date_range(spark, question, start, end):
    if question.startswith("id"):
        start = dt.date(2018, 1, 2)
    low, high = text.date_range("q")
    df = spark.createDataFrame([(question,)], "q string")
    row = df.select(low.alias("low"), high.alias("high")).collect()[0]
    assert (row.low, row.high) == (start, end)


def test_date_range_context(spark):
    low, high = text.date_range("q", dt.date(2020, 1, 2), "2020-05-06")
    row = spark.createDataFrame([("-",)], "q string").select(low.alias("a"), high.alias("b"))
    assert tuple(row.collect()[0]) == (dt.date(2020, 1, 2), dt.date(2020, 5, 6))


def test_business_term(spark):
    cases = {
        "AOV of the gmv": "gmv",
        "delivered order rate now": "delivered_order_rate",
        "what is churn": "churn",
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    rows = df.select("q", text.business_term("q").alias("t")).collect()
    assert {r.q: r.t for r in rows} == cases


def test_glossary(spark):
    cases = {" AOV ": "Average Order Value", "order": "Average Order Value", "churn": None,
             "delivery": "Delivery Delay (Days)", "": "Gross Merchandise Value"}
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    rows = {r.q: r for r in text.lookup_terms(df, "q").collect()}
    assert {q: r.term for q, r in rows.items()} == cases
    assert rows["churn"].found is False
    assert rows["churn"].available_terms == "aov, delivered_order_rate, delivery_delay_days, gmv"
    assert rows[" AOV "].available_terms is None
