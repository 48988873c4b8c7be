"""Models on small hand-made rows: the cases real data rarely shows."""

import datetime as dt
from decimal import Decimal as D

import pytest

from pyspark.sql.functions import lit

from tradewind.functions.columns import mean2, stable_id, typed
from tradewind.operators import ranking
from tradewind.plans import kpis, marts, staging

ORDER_COLUMNS = [
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


def text_frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


@pytest.fixture(scope="module")
def staged(spark):
    rows = [
        # early, on the day, late
        ("o1", "c1", "delivered", "2018-01-31 23:59:59", "", "", "2018-02-07 08:00:00", "2018-02-10 00:00:00"),
        ("o2", "c2", " delivered ", "2018-02-01 00:00:00", "", "", "2018-02-10 23:00:00", "2018-02-10 00:00:00"),
        ("o3", "c1", "delivered", "2018-02-05 10:00:00", "", "", "2018-02-14 01:00:00", "2018-02-10 00:00:00"),
        # delivered without a time; a time without the status; no items; unknown customer
        ("o4", "c2", "delivered", "2018-02-06 10:00:00", "", "", "", "2018-02-10 00:00:00"),
        ("o5", "c9", "shipped", "2018-02-07 10:00:00", "", "", "2018-02-20 00:00:00", "2018-02-10 00:00:00"),
    ]
    items = [
        ("o1", "1", "p1", "s1", "2018-02-01 00:00:00", "10.00", "1.50"),
        ("o1", "2", "p2", "s1", "2018-02-01 00:00:00", "20.005", "2.50"),
        ("o2", "1", "p3", "s1", "", "5.00", ""),
        ("o3", "1", "p9", "s1", "", "0.01", "0.00"),
        ("o4", "1", "p1", "s1", "", "7.00", "1.00"),
    ]
    payments = [
        ("o1", "1", "card", "2", "30.00"),
        ("o1", "2", "voucher", "1", "4.01"),
        ("o2", "1", "card", "1", "5.00"),
        ("o3", "1", "card", "1", "0.01"),
        ("o4", "1", "boleto", "1", "8.00"),
    ]
    customers = [
        (" c1 ", "u1", "01001", "  Sao Paulo", "sp "),
        ("c2", "u1", "", "RIO", "rj"),
    ]
    products = [
        ("p1", " artes ", "10", "20", "1", "100", "1", "2", ""),
        ("p2", "sem_nome", "", "", "", "", "", "", ""),
        ("p3", "", "3", "4", "5", "6.126", "7", "8", "9"),
    ]
    translation = [("artes", " art "), ("moda", "fashion")]
    item_columns = [
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
        "freight_value",
    ]
    payment_columns = [
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value",
    ]
    customer_columns = [
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
        "customer_state",
    ]
    product_columns = [
        "product_id", "product_category_name", "product_name_lenght",
        "product_description_lenght", "product_photos_qty", "product_weight_g",
        "product_length_cm", "product_height_cm", "product_width_cm",
    ]
    names = ["product_category_name", "product_category_name_english"]
    return {
        "orders": staging.stg_orders(text_frame(spark, ORDER_COLUMNS, rows)),
        "items": staging.stg_order_items(text_frame(spark, item_columns, items)),
        "payments": staging.stg_order_payments(text_frame(spark, payment_columns, payments)),
        "customers": staging.stg_customers(text_frame(spark, customer_columns, customers)),
        "products": staging.stg_products(
            text_frame(spark, product_columns, products),
            staging.stg_translation(text_frame(spark, names, translation)),
        ),
    }


@pytest.fixture(scope="module")
def orders(staged):
    return marts.fct_orders(
        staged["orders"], staged["customers"], staged["items"], staged["payments"]
    )


@pytest.fixture(scope="module")
def items(staged):
    return marts.fct_order_items(staged["items"], marts.dim_products(staged["products"]))


def by_key(df, key):
    return {row[key]: row for row in df.collect()}


def test_customers_are_cleaned(staged):
    rows = by_key(staged["customers"], "customer_id")
    assert rows["c1"].customer_city == "sao paulo"
    assert rows["c1"].customer_state == "SP"
    assert rows["c1"].customer_zip_code_prefix == 1001
    assert rows["c2"].customer_zip_code_prefix is None


def test_categories_without_translation_are_unknown(staged):
    rows = by_key(staged["products"], "product_id")
    assert rows["p1"].product_category_name_en == "art"
    assert rows["p2"].product_category_name_en == "unknown"
    assert rows["p3"].product_category_name == ""
    assert rows["p3"].product_category_name_en == "unknown"
    assert rows["p3"].product_weight_g == D("6.13")
    assert rows["p1"].product_width_cm is None


def test_details_do_not_multiply(orders):
    rows = by_key(orders, "order_id")
    assert rows["o1"].item_count == 2
    assert rows["o1"].item_total == D("30.01")
    assert rows["o1"].freight_total == D("4.00")
    assert rows["o1"].payment_total == D("34.01")
    assert rows["o1"].order_month == dt.date(2018, 1, 1)


def test_order_without_items(orders):
    row = by_key(orders, "order_id")["o5"]
    assert row.item_count is None
    assert (row.item_total, row.freight_total, row.payment_total) == (D("0.00"),) * 3
    assert row.customer_unique_id is None
    assert row.is_delivered is True


def test_delivery_delays(orders):
    rows = by_key(marts.fct_delivery(orders), "order_id")
    assert set(rows) == {"o1", "o2", "o3", "o4"}
    assert [rows[o].delivery_delay_days for o in ("o1", "o2", "o3", "o4")] == [-3, 0, 4, None]
    assert [rows[o].is_late_delivery for o in ("o1", "o2", "o3", "o4")] == [0, 0, 1, 0]


def test_monthly_delivery(orders):
    rows = by_key(marts.delivery_monthly(marts.fct_delivery(orders)), "order_month")
    february = rows[dt.date(2018, 2, 1)]
    assert february.avg_delivery_delay_days == D("2.00")
    assert february.late_delivery_rate == D("0.3333")


def test_items_keep_lines_without_product(items):
    rows = {(r.order_id, r.order_item_id): r for r in items.collect()}
    assert rows["o3", 1].category_name_en is None
    assert rows["o1", 2].gross_item_value == D("22.51")
    assert rows["o2", 1].gross_item_value is None


def test_sales_by_category(items):
    rows = by_key(marts.sales_by_category(items), "category_name_en")
    assert rows["art"].total_orders == 2
    assert rows["art"].total_revenue == D("17.00")
    assert rows["unknown"].total_orders == 3
    # (20.01 + 5.00 + 0.01) / 3
    assert rows["unknown"].avg_item_value == D("8.34")


def test_overview_both_ways(orders):
    one = marts.kpi_overview(orders).collect()
    two = marts.kpi_overview(orders, marts.fct_delivery(orders)).collect()
    assert one == two
    assert one[0].total_orders == 5
    assert one[0].delivered_orders == 4
    assert one[0].delivered_order_rate == D("0.8000")
    assert one[0].gmv == D("47.02")
    assert one[0].avg_order_value == D("9.40")
    assert one[0].avg_delivery_delay_days == D("0.33")


def test_overview_counts_copies_as_the_join_does(orders):
    copies = orders.unionByName(orders.where("order_id IN ('o1', 'o3', 'o5')"))
    copies = copies.unionByName(orders.where("order_id = 'o2'").withColumn("order_id", lit(None)))
    delivery = marts.fct_delivery(copies)
    joined = copies.join(delivery.select("order_id", "delivery_delay_days"), "order_id", "left")
    wanted = joined.selectExpr(
        "count(*) AS total_orders",
        "count_if(is_delivered) AS delivered_orders",
        "sum(payment_total) AS gmv",
        "round(sum(delivery_delay_days) / count(delivery_delay_days), 2) AS delay",
        "round(sum(payment_total) / count(payment_total), 2) AS value",
    ).collect()[0]
    row = marts.kpi_overview(copies, delivery).collect()[0]
    assert (row.total_orders, row.delivered_orders) == (13, 12)
    assert (wanted.total_orders, wanted.delivered_orders) == (13, 12)
    assert row.gmv == wanted.gmv and row.avg_order_value == wanted.value
    assert float(row.avg_delivery_delay_days) == wanted.delay
    assert str(row.delivered_order_rate) == "0.9231"


def test_empty_input(orders):
    none = orders.where("1 = 0")
    row = marts.kpi_overview(none).collect()
    assert len(row) == 1 and row[0].total_orders == 0 and row[0].gmv is None
    assert marts.kpi_overview(none, marts.fct_delivery(none)).collect() == row
    assert marts.kpi_monthly(none).count() == 0


def test_averages_round_once_and_away_from_zero(spark):
    cases = spark.sql(
        "SELECT * FROM VALUES ('a', 0.01BD), ('a', 0.00BD), ('b', -0.01BD), ('b', 0.00BD), "
        "('c', 1.00BD), ('c', 1.01BD) AS t(k, v)"
    )
    rows = {r.k: r.m for r in cases.groupBy("k").agg(mean2("v").alias("m")).collect()}
    assert rows == {"a": D("0.01"), "b": D("-0.01"), "c": D("1.01")}


def test_malformed_cell_fails_the_job(spark):
    bad = spark.createDataFrame([("12x",)], "n string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(typed("n", "int")).collect()
    assert bad.select(typed("n", "int", strict=False).alias("n")).collect()[0].n is None


def test_stable_id(spark):
    row = spark.createDataFrame([("glossary::gmv",)], "t string").select(stable_id("t").alias("i"))
    import hashlib

    assert row.collect()[0].i == int(hashlib.md5(b"glossary::gmv").hexdigest()[:15], 16)


def test_top_categories_limits(items):
    categories = marts.sales_by_category(items)
    assert kpis.top_categories(categories, 1).collect()[0].category_name_en == "unknown"
    with pytest.raises(ValueError):
        kpis.top_categories(categories, 0)


def test_latest_months_and_range(orders):
    monthly = marts.kpi_monthly(orders)
    assert [r.month.month for r in kpis.latest_months(monthly, 3).collect()] == [1, 2]
    assert [r.month.month for r in kpis.latest_months(monthly, 1).collect()] == [2]
    assert kpis.monthly_sales(monthly, "2018-01-15").count() == 1
    assert kpis.monthly_sales(monthly, None, "2018-01-01").count() == 1
    assert kpis.monthly_sales(monthly).count() == 2


def test_order_filter_equals_month_filter(orders):
    for low, high in [("2018-01-15", None), (None, "2018-01-31"), ("2018-02-01", "2018-02-01"),
                      ("2017-12-31", "2018-12-31"), (None, None)]:
        pushed = marts.kpi_monthly(kpis.orders_of_months(orders, low, high))
        wanted = kpis.monthly_sales(marts.kpi_monthly(orders), low, high)
        assert sorted(pushed.collect()) == sorted(wanted.collect())


def test_measures(staged, orders):
    paid = staged["payments"].join(
        orders.select("order_id", "order_status", "customer_unique_id"), "order_id", "left"
    )
    row = kpis.kpi(paid, "gmv", "orders", "customers", "aov", "aov_delivered").collect()[0]
    assert (row.gmv, row.orders, row.customers) == (D("47.02"), 4, 1)
    assert row.aov == row.aov_delivered == D("11.76")
    with pytest.raises(ValueError):
        kpis.kpi(paid, "profit")


def test_newest_puts_missing_times_first(spark):
    rows = spark.createDataFrame([(1, "2018"), (2, None), (3, "2019")], "id int, t string")
    assert [r.id for r in ranking.newest(rows, "t", 2, "id").collect()] == [2, 3]


def test_row_cap(spark):
    result = ranking.bounded_result(spark.range(20_000), 9_000, "all")
    assert result.row_count == 9_000 and result.columns == ["id"] and result.text == "all"
    assert result.warnings == ["only the first 9000 rows are shown"]
    assert ranking.bounded_result(spark.range(600)).row_count == 500
    assert ranking.bounded_result(spark.range(500)).warnings == []
    with pytest.raises(ValueError):
        ranking.bounded(spark.range(1), 0)


def test_conversation_context(spark):
    turns = [("a", i, "user" if i % 2 else "", f" turn {i} ") for i in range(9)]
    turns += [("b", 0, "user", "  "), ("b", 1, "assistant", "x" * 400)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    rows = by_key(ranking.conversation_context(df), "conv_id")
    assert rows["a"].context == "USER: turn 3\nUSER: turn 5\nUSER: turn 7"
    assert rows["b"].context == "ASSISTANT: " + "x" * 400
    cut = by_key(ranking.conversation_context(df, width=300), "conv_id")
    assert cut["b"].context == "ASSISTANT: " + "x" * 300
