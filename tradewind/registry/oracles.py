"""The registered queries as SQL for an independent engine, written from the definitions.

Averages are divided as whole numbers so that they round half away from zero exactly.
"""

from __future__ import annotations

from tradewind.functions import wordlists as words
from tradewind.registry.inputs import QUESTIONS, question_vectors

MONEY = "DECIMAL(14,2)"
TOTAL = "DECIMAL(24,2)"


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def half_up(numerator: str, denominator: str, places: int, kind: str) -> str:
    """numerator / denominator rounded to ``places``; both are whole-number expressions and
    the result is NULL over zero."""
    n = f"(CAST({numerator} AS HUGEINT) * {10 ** places})"
    d = f"CAST({denominator} AS HUGEINT)"
    whole = f"(sign({n}) * ((2 * abs({n}) + {d}) // (2 * nullif({d}, 0))))"
    unit = f"CAST({10 ** -places:.{places}f} AS DECIMAL({places + 1},{places}))"
    return f"CAST(CAST({whole} AS DECIMAL(30,0)) * {unit} AS {kind})"


def cents(c: str) -> str:
    return f"CAST({c} * 100 AS HUGEINT)"


def mean_money(c: str) -> str:
    """Average of a two-place decimal, to two places."""
    n = f"CAST(sum({cents(c)}) AS HUGEINT)"
    d = f"CAST(count({c}) AS HUGEINT)"
    whole = f"(sign({n}) * ((2 * abs({n}) + {d}) // (2 * nullif({d}, 0))))"
    return f"CAST(CAST({whole} AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS {MONEY})"


ORDERS = """
o AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id,
        CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
            ELSE 'processing' END AS order_status,
        o_orderdate AS order_purchase_ts,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS order_approved_ts,
        CASE WHEN (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW')
                OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
            THEN o_orderdate + to_days(CAST(trunc(o_totalprice * 100) % 91 AS INTEGER)) END
            AS order_delivered_customer_ts,
        o_orderdate + INTERVAL 45 DAYS AS order_estimated_delivery_ts
    FROM orders
),
i AS (
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
        l_suppkey AS seller_id, l_shipdate AS shipping_limit_ts,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
        CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
            AS DECIMAL(12,2)) AS freight_value
    FROM lineitem
),
pay AS (
    SELECT order_id, payment_sequential,
        CASE WHEN payment_sequential = 1 THEN o_orderpriority ELSE 'voucher' END AS payment_type,
        CAST((order_id + payment_sequential) % 12 + 1 AS INTEGER) AS payment_installments,
        CAST(CAST(CASE WHEN payment_sequential < n THEN cents // n
            ELSE cents - cents // n * (n - 1) END AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2))
            AS DECIMAL(12,2)) AS payment_value
    FROM (SELECT o_orderkey AS order_id, o_orderpriority, o_orderkey % 3 + 1 AS n,
            CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents,
            CAST(unnest(range(1, o_orderkey % 3 + 2)) AS INTEGER) AS payment_sequential
        FROM orders) AS parts
),
fo AS (
    SELECT o.order_id, o.customer_id, c.c_name AS customer_unique_id, o.order_status,
        o.order_purchase_ts, CAST(o.order_purchase_ts AS DATE) AS order_purchase_date,
        CAST(date_trunc('month', o.order_purchase_ts) AS DATE) AS order_month,
        o.order_approved_ts, o.order_delivered_customer_ts AS order_delivered_carrier_ts,
        o.order_delivered_customer_ts, o.order_estimated_delivery_ts,
        o.order_delivered_customer_ts IS NOT NULL AS is_delivered,
        it.item_count,
        CAST(coalesce(it.item_total, 0) AS DECIMAL(14,2)) AS item_total,
        CAST(coalesce(it.freight_total, 0) AS DECIMAL(14,2)) AS freight_total,
        CAST(coalesce(pt.payment_total, 0) AS DECIMAL(14,2)) AS payment_total
    FROM o
    LEFT JOIN customer c ON o.customer_id = c.c_custkey
    LEFT JOIN (SELECT order_id, count(*) AS item_count, sum(price) AS item_total,
            sum(freight_value) AS freight_total FROM i GROUP BY order_id) it
        ON o.order_id = it.order_id
    LEFT JOIN (SELECT order_id, sum(payment_value) AS payment_total FROM pay
            GROUP BY order_id) pt ON o.order_id = pt.order_id
),
fd AS (
    SELECT order_id, order_month, order_purchase_date,
        CAST(order_estimated_delivery_ts AS DATE) AS estimated_delivery_date,
        CAST(order_delivered_customer_ts AS DATE) AS delivered_customer_date,
        CAST(date_diff('day', CAST(order_estimated_delivery_ts AS DATE),
            CAST(order_delivered_customer_ts AS DATE)) AS INTEGER) AS delivery_delay_days,
        CASE WHEN CAST(order_delivered_customer_ts AS DATE)
            > CAST(order_estimated_delivery_ts AS DATE) THEN 1 ELSE 0 END AS is_late_delivery
    FROM fo WHERE order_status = 'delivered'
)"""

PRODUCTS = """
p AS (
    SELECT p_partkey AS product_id, p_type AS product_category_name,
        CASE WHEN p_type <> 'LARGE' THEN lower(p_type) ELSE 'unknown' END
            AS product_category_name_en,
        p_name, p_brand, p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS weight
    FROM part
)"""

ITEMS = PRODUCTS + """,
fi AS (
    SELECT i.order_id, i.order_item_id, i.product_id,
        p.product_category_name_en AS category_name_en, i.seller_id, i.shipping_limit_ts,
        i.price, i.freight_value, CAST(i.price + i.freight_value AS DECIMAL(13,2))
            AS gross_item_value
    FROM i LEFT JOIN p ON i.product_id = p.product_id
)"""

CATEGORIES = f"""
cat AS (
    SELECT coalesce(category_name_en, 'unknown') AS category_name_en,
        count(DISTINCT order_id) AS total_orders, CAST(sum(price) AS {TOTAL}) AS total_revenue,
        {mean_money('price')} AS avg_item_value
    FROM fi GROUP BY 1
)"""

MONTHLY = f"""
km AS (
    SELECT order_month AS month, count(*) AS total_orders,
        count(*) FILTER (WHERE is_delivered) AS delivered_orders,
        CAST(sum(payment_total) AS {TOTAL}) AS gmv,
        {mean_money('payment_total')} AS avg_order_value
    FROM fo GROUP BY 1
)"""

DELIVERY_MONTHLY = f"""
dm AS (
    SELECT order_month,
        {half_up('sum(delivery_delay_days)', 'count(delivery_delay_days)', 2, MONEY)}
            AS avg_delivery_delay_days,
        {half_up('sum(is_late_delivery)', 'count(*)', 4, 'DECIMAL(9,4)')}
            AS late_delivery_rate
    FROM fd GROUP BY 1
)"""

OVERVIEW = f"""
ov AS (
    SELECT count(*) AS total_orders, count(*) FILTER (WHERE is_delivered) AS delivered_orders,
        {half_up('count(*) FILTER (WHERE is_delivered)', 'count(*)', 4, 'DECIMAL(9,4)')}
            AS delivered_order_rate,
        CAST(sum(payment_total) AS {TOTAL}) AS gmv,
        {mean_money('payment_total')} AS avg_order_value,
        {half_up('sum(fd.delivery_delay_days)', 'count(fd.delivery_delay_days)', 2, MONEY)}
            AS avg_delivery_delay_days
    FROM fo LEFT JOIN fd ON fo.order_id = fd.order_id
)"""

PLACES = """
place AS (
    SELECT n_nationkey AS zip, lower(n_name) AS city, upper(r_name) AS state
    FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def query(*parts_and_select: str) -> str:
    *parts, select = parts_and_select
    return f"WITH {','.join(parts)}\n{select}"


def marts() -> dict[str, str]:
    month_columns = "month, total_orders, delivered_orders, gmv, avg_order_value"
    category_columns = "category_name_en, total_orders, total_revenue, avg_item_value"
    all_categories = (ORDERS, ITEMS, CATEGORIES)
    distinct_orders = "count(DISTINCT pay.order_id)"
    paid = "sum(CAST(pay.payment_value * 100 AS HUGEINT))"
    delivered_orders = "count(DISTINCT CASE WHEN order_status = 'delivered' THEN fo.order_id END)"

    def order_value(count: str) -> str:
        whole = f"((2 * {paid} + {count}) // (2 * nullif({count}, 0)))"
        return (
            f"CAST(CAST({whole} AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS {MONEY})"
        )

    return {
        "fct_orders": query(ORDERS, "SELECT * FROM fo"),
        "fct_order_items": query(ORDERS, ITEMS, "SELECT * FROM fi"),
        "fct_order_items_lookup": query(
            ORDERS, ITEMS,
            "SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_ts, price, "
            "freight_value, category_name_en AS product_category_name_en FROM fi",
        ),
        "fct_delivery": query(ORDERS, "SELECT * FROM fd"),
        "fct_payments": query(ORDERS, "SELECT * FROM pay"),
        "sales_by_category": query(*all_categories, "SELECT * FROM cat"),
        "kpi_monthly_sales": query(ORDERS, MONTHLY, "SELECT * FROM km ORDER BY month"),
        "delivery_monthly": query(ORDERS, DELIVERY_MONTHLY, "SELECT * FROM dm"),
        "kpi_overview": query(ORDERS, OVERVIEW, "SELECT * FROM ov"),
        "kpi_overview_two_facts": query(ORDERS, OVERVIEW, "SELECT * FROM ov"),
        "dim_customers": query(PLACES, """
            SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
                c_nationkey AS customer_zip_code_prefix, city AS customer_city,
                state AS customer_state
            FROM customer LEFT JOIN place ON c_nationkey = zip"""),
        "dim_sellers": query(PLACES, """
            SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix,
                city AS seller_city, state AS seller_state
            FROM supplier LEFT JOIN place ON s_nationkey = zip"""),
        "recent_orders": query(ORDERS, """
            SELECT order_id, customer_id, order_status, order_purchase_ts, payment_total FROM fo
            ORDER BY order_purchase_ts DESC NULLS FIRST, order_id LIMIT 100"""),
        "top_categories": query(*all_categories, f"""
            SELECT {category_columns} FROM cat
            ORDER BY total_revenue DESC, category_name_en LIMIT 20"""),
        "dashboard_categories": query(*all_categories, f"""
            SELECT {category_columns} FROM cat
            ORDER BY total_revenue DESC, category_name_en LIMIT 3"""),
        "dashboard": query(*all_categories, MONTHLY, OVERVIEW, """
            SELECT 'overview' AS section, 'all' AS label, total_orders, gmv AS revenue FROM ov
            UNION ALL SELECT 'series', CAST(month AS VARCHAR), total_orders, gmv FROM km
                WHERE month BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
            UNION ALL SELECT * FROM (SELECT 'category', category_name_en, total_orders,
                total_revenue FROM cat ORDER BY total_revenue DESC, category_name_en LIMIT 4)"""),
        "bound_query": query(ORDERS, """
            SELECT order_id, payment_total FROM fo WHERE payment_total > 150000.00
                AND order_status = 'delivered' ORDER BY order_id LIMIT 200"""),
        "latest_quarter": query(ORDERS, MONTHLY, f"""
            SELECT {month_columns} FROM km
            WHERE month >= (SELECT max(month) FROM km) - INTERVAL 2 MONTHS ORDER BY month"""),
        "kpi_range": query(ORDERS, MONTHLY, f"""
            SELECT {month_columns} FROM km
            WHERE month BETWEEN DATE '1997-01-15' AND DATE '1998-06-30' ORDER BY month"""),
        "kpi_summary": query(ORDERS, MONTHLY, OVERVIEW, """
            SELECT ov.*, (SELECT count(*) FROM km
                WHERE month BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS series_row_count
            FROM ov"""),
        "delivery_series": query(
            ORDERS, DELIVERY_MONTHLY, "SELECT * FROM dm ORDER BY order_month"
        ),
        "overview": query(ORDERS, OVERVIEW, """
            SELECT total_orders, delivered_orders, delivered_order_rate, gmv, avg_order_value
            FROM ov"""),
        "kpi_measures": query(ORDERS, f"""
            SELECT payment_type, CAST(sum(pay.payment_value) AS {TOTAL}) AS gmv,
                {distinct_orders} AS orders,
                count(DISTINCT customer_unique_id) AS customers,
                {order_value(distinct_orders)} AS aov,
                {order_value(delivered_orders)} AS aov_delivered
            FROM pay LEFT JOIN fo ON pay.order_id = fo.order_id GROUP BY payment_type"""),
        "last_months": query(ORDERS, MONTHLY, f"""
            SELECT {month_columns} FROM km
            ORDER BY month DESC LIMIT 12"""),
    }


def staging() -> dict[str, str]:
    orders = """
        SELECT coalesce(CAST(order_id AS VARCHAR), '') AS order_id,
            coalesce(CAST(customer_id AS VARCHAR), '') AS customer_id,
            order_status, order_purchase_ts, order_approved_ts,
            order_delivered_customer_ts AS order_delivered_carrier_ts,
            order_delivered_customer_ts, order_estimated_delivery_ts
        FROM o"""
    reviews = """
            SELECT 'r' || d.doc_id AS review_id, CAST(d.doc_id AS VARCHAR) AS order_id,
                CAST(quality + 4 AS INTEGER) AS review_score,
                nullif(CASE WHEN lang <> 'en' THEN lang END, '') AS review_comment_title,
                nullif(text, '') AS review_comment_message,
                TIMESTAMP '2018-01-02 03:04:05' AS review_creation_ts,
                CASE WHEN toxic = 1 THEN TIMESTAMP '2018-02-03 00:00:00' END AS review_answer_ts
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    products = """
        SELECT CAST(product_id AS VARCHAR) AS product_id, product_category_name,
            product_category_name_en, CAST(length(p_name) AS INTEGER) AS product_name_length,
            CASE WHEN p_size <> 1 THEN CAST(length(p_brand) AS INTEGER) END
                AS product_description_length,
            CAST(p_size AS INTEGER) AS product_photos_qty, weight AS product_weight_g,
            CAST(p_size AS DECIMAL(12,2)) AS product_length_cm,
            CAST(p_size AS DECIMAL(12,2)) AS product_height_cm,
            CASE WHEN p_size <> 2 THEN CAST(p_size AS DECIMAL(12,2)) END AS product_width_cm
        FROM p"""
    return {
        "stg_orders": query(ORDERS, orders),
        "csv_roundtrip": query(ORDERS, orders),
        "csv_reviews": reviews,
        "land_csv": """
            SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey,
                CAST(l_linenumber AS VARCHAR) AS l_linenumber,
                coalesce(CAST(l_partkey AS VARCHAR), '') AS l_partkey, l_returnflag,
                'line ' || chr(10) || l_linestatus AS status, '' AS nothing
            FROM lineitem""",
        "stg_order_items": query(ORDERS, """
            SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(order_item_id AS INTEGER) AS
                order_item_id, CAST(product_id AS VARCHAR) AS product_id,
                CAST(seller_id AS VARCHAR) AS seller_id, shipping_limit_ts,
                CASE WHEN order_item_id <> 7 THEN price END AS price, freight_value
            FROM i"""),
        "stg_order_payments": query(ORDERS, """
            SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, payment_type,
                nullif(payment_installments, 7) AS payment_installments, payment_value
            FROM pay"""),
        "stg_order_reviews": reviews,
        "stg_customers": query(PLACES, """
            SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id,
                CAST(nullif(c_nationkey, 0) AS INTEGER) AS customer_zip_code_prefix,
                city AS customer_city, state AS customer_state
            FROM customer LEFT JOIN place ON c_nationkey = zip"""),
        "stg_sellers": query(PLACES, """
            SELECT CAST(s_suppkey AS VARCHAR) AS seller_id,
                CAST(nullif(s_nationkey, 0) AS INTEGER) AS seller_zip_code_prefix,
                city AS seller_city, state AS seller_state
            FROM supplier LEFT JOIN place ON s_nationkey = zip"""),
        "stg_geolocation": query(PLACES, """
            SELECT CAST(c_nationkey AS INTEGER) AS geolocation_zip_code_prefix,
                c_acctbal AS geolocation_lat,
                CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS geolocation_lng,
                city AS geolocation_city, state AS geolocation_state
            FROM customer LEFT JOIN place ON c_nationkey = zip"""),
        "stg_product_category_translation": """
            SELECT DISTINCT p_type AS product_category_name,
                lower(p_type) AS product_category_name_english
            FROM part WHERE p_type <> 'LARGE'""",
        "stg_products": query(PRODUCTS, products),
        "dim_products": query(PRODUCTS, products),
        "lenient_casts": """
            SELECT o_orderpriority AS priority,
                CAST(sum(CAST(split_part(o_orderpriority, '-', 1) AS INTEGER)) AS BIGINT)
                    AS number_sum,
                CAST(CASE o_orderpriority WHEN '5-LOW' THEN count(*) FILTER (
                    WHERE o_orderstatus <> 'P') ELSE 0 END AS BIGINT) AS castable,
                count(*) FILTER (WHERE o_orderstatus <> 'P') AS not_blank
            FROM orders GROUP BY 1""",
    }


def checks() -> dict[str, str]:
    def nulls(name: str, table: str, column: str) -> str:
        return (
            f"SELECT 'not_null_{name}_{column}' AS check_name, "
            f"count(*) FILTER (WHERE {table} IS NULL) AS failures FROM "
        )

    def unique(name: str, column: str, table: str, key: str) -> str:
        return (
            f"SELECT 'unique_{name}_{column}' AS check_name, count(*) AS failures FROM "
            f"(SELECT {key} FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} "
            "HAVING count(*) > 1) AS d"
        )

    def orphans(name: str, column: str, child: str, key: str, to: str, parent: str, pk: str) -> str:
        return (
            f"SELECT 'relationship_{name}_{column}_to_{to}' AS check_name, count(*) AS failures "
            f"FROM {child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {pk} FROM {parent})"
        )

    rules = [
        nulls("stg_customers", "c_custkey", "customer_id") + "customer",
        unique("stg_customers", "customer_id", "customer", "c_custkey"),
        nulls("stg_customers", "c_name", "customer_unique_id") + "customer",
        nulls("stg_orders", "o_orderkey", "order_id") + "orders",
        unique("stg_orders", "order_id", "orders", "o_orderkey"),
        nulls("stg_orders", "o_custkey", "customer_id") + "orders",
        orphans("stg_orders", "customer_id", "orders", "o_custkey", "stg_customers",
                "customer", "c_custkey"),
        nulls("stg_order_items", "l_orderkey", "order_id") + "lineitem",
        unique("stg_order_items", "order_id", "lineitem", "l_orderkey"),
        orphans("stg_order_items", "order_id", "lineitem", "l_orderkey", "stg_orders",
                "orders", "o_orderkey"),
        orphans("stg_order_items", "product_id", "lineitem", "l_partkey", "stg_products",
                "part", "p_partkey"),
        orphans("stg_order_items", "seller_id", "lineitem", "l_suppkey", "stg_sellers",
                "supplier", "s_suppkey"),
        nulls("stg_products", "p_partkey", "product_id") + "part",
        unique("stg_products", "product_id", "part", "p_partkey"),
        nulls("stg_sellers", "s_suppkey", "seller_id") + "supplier",
        unique("stg_sellers", "seller_id", "supplier", "s_suppkey"),
        nulls("stg_order_payments", "o_orderkey", "order_id") + "orders",
        orphans("stg_order_payments", "order_id", "orders", "o_orderkey", "stg_orders",
                "orders", "o_orderkey"),
        "SELECT 'recency' AS check_name, CAST(CASE WHEN max(o_orderdate) < "
        "TIMESTAMP '2018-08-01' THEN 1 ELSE 0 END AS BIGINT) AS failures FROM orders",
    ]
    report = "\nUNION ALL ".join(rules)
    return {
        "dq_not_null": """
            SELECT * FROM (SELECT o_orderkey,
                    CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS o_custkey
                FROM orders) AS k
            WHERE o_custkey IS NULL""",
        "dq_unique": """
            SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_returnflag <> 'N'
            GROUP BY 1 HAVING count(*) > 1""",
        "dq_relationships": query(ORDERS, """
            SELECT l_orderkey AS order_id, count(*) AS n_rows FROM lineitem
            WHERE l_returnflag <> 'N' AND l_orderkey NOT IN
                (SELECT order_id FROM o WHERE order_delivered_customer_ts IS NOT NULL)
            GROUP BY 1"""),
        "dq_row_parity": """
            SELECT * FROM (
                SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS raw_count,
                    (SELECT count(*) FROM orders) AS stg_count
                UNION ALL SELECT 'delivered', (SELECT count(*) FROM orders),
                    (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
                UNION ALL SELECT 'order_items', (SELECT count(*) FROM lineitem),
                    (SELECT count(*) FROM lineitem)
                UNION ALL SELECT 'events', (SELECT count(*) FROM events),
                    (SELECT count(*) FROM events WHERE value > 10)
            ) AS c WHERE raw_count <> stg_count""",
        "dq_recency": """
            SELECT * FROM (SELECT max(o_orderdate) AS max_ts FROM orders) AS m
            WHERE max_ts < TIMESTAMP '2018-08-01'""",
        "dq_report": f"""
            SELECT check_name, failures,
                CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status
            FROM ({report}) AS r""",
    }


def trend(metric: str, time: str) -> tuple[str, str]:
    """Trend summary of a relation pt(t, v)."""
    extremes = """
f AS (SELECT * FROM pt ORDER BY t, v LIMIT 1),
l AS (SELECT * FROM pt ORDER BY t DESC, v DESC LIMIT 1),
hi AS (SELECT * FROM pt ORDER BY v DESC, t LIMIT 1),
lo AS (SELECT * FROM pt ORDER BY v, t LIMIT 1)"""
    return extremes, f"""
        SELECT CASE WHEN l.v > f.v THEN 'up' WHEN l.v < f.v THEN 'down' ELSE 'flat' END AS trend,
            '{metric}' AS metric, '{time}' AS time_axis,
            f.t AS first_t, f.v AS first_value, l.t AS last_t, l.v AS last_value,
            hi.t AS peak_t, hi.v AS peak_value, lo.t AS trough_t, lo.v AS trough_value,
            round(l.v - f.v, 2) AS delta,
            round((l.v - f.v) / nullif(f.v, 0) * 100, 2) AS pct_change,
            (SELECT count(*) FROM pt) AS n_points
        FROM f, l, hi, lo"""


def summaries() -> dict[str, str]:
    names = ["l_quantity", "l_extendedprice", "l_discount", "net", "text", "constant"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    pair_rows = "\nUNION ALL ".join(
        f"""SELECT {i} AS pair, '{a}' AS x, '{b}' AS y,
            covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS r, count(*) AS n
        FROM (SELECT {a} AS x, {b} AS y FROM t
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS q"""
        for i, (a, b) in enumerate(pairs)
    )
    measures = ["total_orders", "delivered_orders", "gmv", "avg_order_value"]
    monthly_pairs = "\nUNION ALL ".join(
        f"""SELECT '{a}' AS x, '{b}' AS y, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r
        FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM km) AS q"""
        for i, a in enumerate(measures) for b in measures[i + 1 :]
    )
    profile = [
        ("o_orderkey", "count(o_orderkey)", "count(o_orderkey)"),
        ("priority_number", "count(*)", "count(*)"),
        ("price_text", "count(*) FILTER (WHERE o_orderstatus <> 'P')",
         "count(*) FILTER (WHERE o_orderstatus <> 'P')"),
        ("mixed", "count(*)", "count(*) FILTER (WHERE o_orderstatus <> 'F')"),
        ("o_orderdate", "count(o_orderdate)", "0"),
    ]
    profile_rows = "\nUNION ALL ".join(
        f"SELECT '{name}' AS column_name, {i} AS position, CAST({filled} AS BIGINT) AS non_empty, "
        f"CAST({numbers} AS BIGINT) AS castable FROM orders"
        for i, (name, filled, numbers) in enumerate(profile, start=1)
    )
    return {
        "trend_summary": query(
            ORDERS, MONTHLY,
            "\npt AS (SELECT CAST(month AS VARCHAR) AS t, CAST(gmv AS DOUBLE) AS v FROM km)",
            *trend("gmv", "month"),
        ),
        "trend_events": query(
            "\npt AS (SELECT CAST(ts AS VARCHAR) AS t, value AS v FROM events)",
            *trend("value", "date"),
        ),
        "drill_down": query(ORDERS, f"""
            SELECT 'order_month' AS dimension, 'gmv' AS metric,
                CAST(order_month AS VARCHAR) AS "group", CAST(sum(payment_total) AS {TOTAL}) AS sum,
                count(*) AS count, {mean_money('payment_total')} AS avg,
                (SELECT count(DISTINCT order_month) FROM fo) AS total_groups
            FROM fo GROUP BY order_month ORDER BY sum(payment_total) DESC, 3 LIMIT 15"""),
        "drill_down_counts": """
            SELECT 'event_type' AS dimension, CAST(NULL AS VARCHAR) AS metric,
                event_type AS "group", CAST(0 AS DOUBLE) AS sum, count(*) AS count,
                CAST(0 AS DOUBLE) AS avg,
                (SELECT count(DISTINCT event_type) FROM events) AS total_groups
            FROM events GROUP BY event_type""",
        "summaries": query(ORDERS, MONTHLY, f"""
            SELECT 'drill_down' AS summary, CAST(month AS VARCHAR) AS name,
                CAST(gmv AS DOUBLE) AS value
            FROM (SELECT * FROM km ORDER BY gmv DESC, month LIMIT 15) AS d
            UNION ALL SELECT 'correlation', x || ' ' || y, round(r, 4) FROM ({monthly_pairs}) AS c
            UNION ALL SELECT 'time_series', CASE WHEN l > f THEN 'up' WHEN l < f THEN 'down'
                ELSE 'flat' END, round((l - f) / f * 100, 2)
            FROM (SELECT CAST(arg_min(gmv, month) AS DOUBLE) AS f,
                CAST(arg_max(gmv, month) AS DOUBLE) AS l FROM km) AS t"""),
        "correlations": f"""
            WITH t AS (
                SELECT l_quantity, l_extendedprice, l_discount,
                    l_extendedprice * (1 - l_discount) AS net,
                    CASE WHEN l_linenumber <> 3 THEN l_quantity END AS text,
                    CAST(5 AS DOUBLE) AS constant
                FROM lineitem
            )
            SELECT x, y, round(r, 4) AS pearson, n FROM ({pair_rows}) AS c
            WHERE r IS NOT NULL AND n >= 3 ORDER BY abs(round(r, 4)) DESC, pair LIMIT 8""",
        "numeric_profile": f"""
            SELECT *, {half_up('castable', 'non_empty', 4, 'DECIMAL(9,4)')} AS share,
                coalesce(castable >= 0.6 * non_empty AND non_empty > 0, false) AS is_numeric
            FROM ({profile_rows}) AS p""",
        "chart_series": query(ORDERS, MONTHLY, """
            SELECT CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS position,
                CAST(month AS VARCHAR) AS x, CAST(gmv AS DOUBLE) AS y, 'line' AS chart_type,
                'gmv' AS value_column, 'month' AS label_column, 'gmv theo month' AS title, (SELECT count(*) FROM km) AS total_points
            FROM km ORDER BY month"""),
        "figure_block": query(ORDERS, MONTHLY, """
            SELECT CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS position,
                CAST(month AS VARCHAR) AS x, CAST(gmv AS DOUBLE) AS y, 'bar' AS chart_type,
                'gmv' AS value_column, 'month' AS label_column, 'gmv trend' AS title, (SELECT count(*) FROM km) AS total_points
            FROM km ORDER BY month"""),
        "chart_top": query(ORDERS, ITEMS, CATEGORIES, """
            SELECT CAST(row_number() OVER (ORDER BY total_revenue DESC) AS INTEGER) AS position,
                category_name_en AS x, CAST(total_revenue AS DOUBLE) AS y, 'bar' AS chart_type,
                'total_revenue' AS value_column, 'category_name_en' AS label_column,
                'total_revenue theo category_name_en' AS title, (SELECT count(*) FROM cat) AS total_points
            FROM cat ORDER BY total_revenue DESC LIMIT 15"""),
    }


def contains_any(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text_literal(p)})" for p in phrases) + ")"


def count_hits(column: str, phrases: list[str]) -> str:
    terms = [f"CAST(contains({column}, {text_literal(p)}) AS INTEGER)" for p in phrases]
    return "(" + " + ".join(terms) + ")"


def intent(source: str, columns: str) -> str:
    """Intent per row of a relation with a ``body`` column."""
    analytics = f"""CASE
        WHEN {contains_any('q', words.ANALYTICS_SCHEMA_WORDS)} THEN 'schema_search'
        WHEN {contains_any('q', words.ANALYTICS_DEFINITION_WORDS)} THEN 'business_definition'
        WHEN {contains_any('q', words.ANALYTICS_CATEGORY_WORDS)} THEN 'sql_query'
        WHEN {contains_any('q', words.ANALYTICS_KPI_WORDS)} THEN 'kpi_summary'
        ELSE 'sql_query' END"""
    return f"""
        WITH n AS (
            SELECT {columns}, trim(regexp_replace(lower(body), '\\s+', ' ', 'g')) AS q
            FROM {source}
        ), s AS (
            SELECT *, {count_hits('q', words.SCHEMA_WORDS)} AS s1,
                {count_hits('q', words.DEFINITION_WORDS)} AS s2,
                {count_hits('q', words.KPI_WORDS)} AS s3,
                {count_hits('q', words.QUERY_WORDS)} AS s4,
                {count_hits("(' ' || q || ' ')", words.QUERY_CLAUSES)} AS clauses
            FROM n
        )
        SELECT {columns}, CASE
            WHEN q IS NULL OR q = '' THEN 'chitchat'
            WHEN regexp_matches(q, '^(select|with)\\b') OR clauses >= 2 THEN 'sql_query'
            WHEN {contains_any('q', words.HELP_WORDS)} THEN 'help_request'
            WHEN {contains_any('q', words.ANALYTICS_WORDS)} THEN {analytics}
            WHEN s1 > 0 AND s1 >= greatest(s2, s3, s4) THEN 'schema_search'
            WHEN s2 > 0 AND s2 >= greatest(s3, s4) THEN 'business_definition'
            WHEN s3 > 0 AND s3 >= s4 THEN 'kpi_summary'
            WHEN s4 > 0 THEN 'sql_query'
            WHEN {contains_any('q', words.SMALL_TALK_WORDS)} THEN 'chitchat'
            WHEN len(string_split(q, ' ')) <= 4 THEN 'chitchat'
            WHEN regexp_matches(q, '^(show|list|find|get|give|tell|display)\\b') THEN 'sql_query'
            ELSE 'chitchat' END AS intent
        FROM s"""


def asked() -> str:
    """The question per event."""
    wordings = ", ".join(text_literal(q) for q in QUESTIONS)
    return f"""(
        SELECT event_id, concat_ws(' ',
            ([{wordings}])[CAST(event_id % {len(QUESTIONS)} AS INTEGER) + 1],
            CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d') END,
            CASE WHEN value > 10 THEN '2016-02-30 ' || event_type END) AS body
        FROM events) AS e"""


def last_keyword(column: str) -> str:
    stop = ", ".join(text_literal(w) for w in words.KEYWORD_STOP_WORDS)
    return (
        f"list_filter(regexp_extract_all(lower({column}), '[a-zA-Z_]+'), "
        f"lambda w: length(w) >= 3 AND w NOT IN ({stop}))[-1]"
    )


def stripped(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def keyword(column: str) -> str:
    return f"coalesce({last_keyword(column)}, {stripped(column)})"


def business_term(column: str) -> str:
    named = " ".join(
        f"WHEN {contains_any(f'lower({column})', [key, term.lower()])} THEN '{key}'"
        for key, term, *_ in words.GLOSSARY
    )
    return (
        f"coalesce(CASE {named} END, {last_keyword(column)}, {stripped(f'lower({column})')})"
    )


def text_queries() -> dict[str, str]:
    entries = ", ".join(
        f"({rank}, {', '.join(text_literal(v) for v in entry)})"
        for rank, entry in enumerate(words.GLOSSARY)
    )
    known = text_literal(", ".join(sorted(entry[0] for entry in words.GLOSSARY)))
    return {
        "conversation_context": r"""
            WITH last AS (
                SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank
                FROM conversations
            )
            SELECT conv_id, count(*) AS n_turns,
                string_agg(upper(role) || ': ' || said, chr(10) ORDER BY turn)
                    AS context
            FROM last WHERE rank <= 6 AND length(role) > 0 AND length(said) > 0
            GROUP BY conv_id""",
        "intent_tags": intent(
            "(SELECT conv_id, turn, text AS body FROM conversations) AS c", "conv_id, turn"
        ),
        "intent_questions": intent(asked(), "event_id"),
        "keywords": f"SELECT conv_id, turn, {keyword('text')} AS keyword FROM conversations",
        "business_terms": f"""
            SELECT event_id, {business_term('body')} AS term, {keyword('body')} AS keyword
            FROM {asked()}""",
        "date_ranges": f"""
            SELECT event_id, TRY_CAST(coalesce(d[1], '{words.DEFAULT_START}') AS DATE)
                    AS start_date,
                TRY_CAST(coalesce(d[2], '{words.DEFAULT_END}') AS DATE) AS end_date
            FROM (SELECT event_id,
                    regexp_extract_all(body, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS d
                FROM {asked()}) AS x""",
        "glossary_lookup": f"""
            WITH g(rank, key, term, definition, formula, source_table) AS (VALUES {entries}),
            a AS (SELECT event_id, {business_term('body')} AS asked FROM {asked()}),
            hit AS (
                SELECT event_id, min(CASE WHEN key = trim(lower(asked)) THEN rank
                    ELSE rank + 100 END) AS best
                FROM a JOIN g ON contains(key, trim(lower(asked)))
                    OR contains(lower(term), trim(lower(asked)))
                GROUP BY event_id
            )
            SELECT a.event_id, a.asked, hit.best IS NOT NULL AS found, g.term, g.definition,
                g.formula, g.source_table,
                CASE WHEN hit.best IS NULL THEN {known} END AS available_terms
            FROM a LEFT JOIN hit ON a.event_id = hit.event_id
            LEFT JOIN g ON g.rank = hit.best % 100""",
        "stable_ids": """
            SELECT doc_id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS id
            FROM documents""",
    }


INVENTORY = """
inv AS (
    SELECT lower(p_type) AS table_schema,
        replace(p_brand, '#', '_') || '_' || CAST(p_partkey // 50 AS VARCHAR) AS table_name,
        replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS column_name,
        p_partkey AS ordinal_position,
        CASE WHEN p_size < 10 THEN 'integer' ELSE 'text' END AS data_type
    FROM part
)"""


def catalog() -> dict[str, str]:
    return {
        "schema_search": query(INVENTORY, """
            SELECT table_schema, table_name, column_name, data_type FROM inv
            WHERE table_schema IN ('economy', 'promo', 'small')
                AND (table_name ILIKE '%RED_%' OR column_name ILIKE '%RED_%')
            ORDER BY table_schema, table_name, ordinal_position"""),
        "table_documents": query(INVENTORY, """
            SELECT CAST('0x' || substr(md5(table_schema || '.' || table_name), 1, 15) AS BIGINT)
                    AS id,
                table_schema || '.' || table_name AS fully_qualified,
                string_agg(column_name, ',' ORDER BY ordinal_position) AS columns,
                CAST(count(*) AS INTEGER) AS n_types,
                'Table: ' || table_schema || '.' || table_name || chr(10) || 'Columns:' || chr(10)
                    || string_agg('- ' || column_name || ' (' || data_type || ')', chr(10)
                        ORDER BY ordinal_position) AS document
            FROM inv GROUP BY table_schema, table_name"""),
    }


def vector_queries() -> dict[str, str]:
    asked_vectors = ", ".join(
        f"({text_literal(question)}, [{', '.join(repr(float(x)) for x in vector)}]::DOUBLE[])"
        for question, vector in question_vectors().items()
    )
    scored = f"""
        qv(query_id, v) AS (VALUES {asked_vectors}),
        scored AS (
            SELECT query_id, vec_id AS id, label,
                round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6) AS score
            FROM embeddings, qv
        ),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)
                AS INTEGER) AS rank FROM scored
        )"""
    return {
        "vector_topk": query(
            scored, "SELECT query_id, score, id, label, rank FROM ranked WHERE rank <= 5"
        ),
        "vector_topk_filtered": query(scored, """
            SELECT * FROM (
                SELECT query_id, score, id, label, CAST(row_number() OVER (
                    PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
                FROM scored WHERE label = 3 AND score >= 0.1) AS r
            WHERE rank <= 3"""),
        "context_pack": query(scored, """
            SELECT query_id, string_agg('[score=' || printf('%.3f', score) || ']' || chr(10)
                || 'label ' || label, chr(10) || chr(10) ORDER BY rank) AS context
            FROM ranked WHERE rank <= 4 GROUP BY query_id"""),
        "vector_upsert": """
            SELECT vec_id AS id, CAST(label + CASE WHEN label < 3 THEN 100 ELSE 0 END AS INTEGER)
                    AS label, CASE WHEN label < 3 THEN 2 ELSE 0 END AS version,
                round(CAST(embedding[1] AS DOUBLE), 6) AS first
            FROM embeddings
            UNION ALL
            SELECT vec_id + 1000000000, CAST(label AS INTEGER), 2,
                round(CAST(embedding[1] AS DOUBLE), 6)
            FROM embeddings WHERE label < 3""",
        "vector_topk_bulk": """
            SELECT query_id, score, id, label, rank FROM (
                SELECT query_id, score, id, label, CAST(row_number() OVER (
                    PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
                FROM (
                    SELECT q.vec_id AS query_id, e.vec_id AS id, e.label,
                        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
                            CAST(e.embedding AS DOUBLE[])), 6) AS score
                    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0
                ) AS s) AS r
            WHERE rank <= 5""",
        "embed_documents": r"""
            WITH token AS (
                SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t
                FROM documents
            ), place AS (
                SELECT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) % 64
                    AS INTEGER) AS p, count(*) AS n FROM token GROUP BY ALL
            ), long AS (
                SELECT doc_id, sqrt(sum(n * n)) AS length FROM place GROUP BY doc_id
            ), spot AS (SELECT doc_id, unnest(range(0, 64)) AS p FROM documents)
            SELECT s.doc_id, string_agg(printf('%.4f', round(coalesce(n / length, 0), 4)), ','
                ORDER BY s.p) AS weights
            FROM spot s LEFT JOIN place USING (doc_id, p) LEFT JOIN long USING (doc_id)
            GROUP BY s.doc_id""",
        "index_size": "SELECT count(*) AS n_vectors FROM embeddings",
    }


def ledger() -> dict[str, str]:
    return {
        "load_ledger": """
            WITH e AS (
                SELECT user_id AS run_id, ts, event_type,
                    CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'success'
                        WHEN 'error' THEN 'failed' END AS status,
                    CAST(value AS DECIMAL(12,2)) AS duration_seconds,
                    CASE WHEN event_type = 'error' THEN props END AS error_message
                FROM events WHERE event_type IN ('signup', 'purchase', 'error')
            ), r AS (
                SELECT *, min(CASE WHEN status = 'running' THEN ts END)
                        OVER (PARTITION BY run_id) AS started_at,
                    row_number() OVER (PARTITION BY run_id
                        ORDER BY ts DESC, status = 'running', status DESC) AS nth
                FROM e
            )
            SELECT run_id, started_at, CASE WHEN status <> 'running' THEN ts END AS finished_at,
                status, duration_seconds, error_message
            FROM r WHERE nth = 1""",
    }


def oracle_sql() -> dict[str, str]:
    return {
        **marts(),
        **staging(),
        **checks(),
        **summaries(),
        **text_queries(),
        **catalog(),
        **vector_queries(),
        **ledger(),
    }
