"""Registered queries: (spark, folder of parquet tables) to DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import text
from tradewind.functions.columns import stable_id, typed
from tradewind.operators import analytics, catalog, quality, ranking, vectors
from tradewind.operators.joins import lookup
from tradewind.plans import kpis, marts
from tradewind.plans.staging import MODELS, stage, stg_orders
from tradewind.plans.warehouse import Warehouse
from tradewind.registry.inputs import QUESTIONS, question_vectors
from tradewind.session import shared_folder
from tradewind.sources import landing
from tradewind.sources.ledger import latest_runs
from tradewind.sources.raw import read_raw
from tradewind.sources.specs import SOURCES
from tradewind.sources.tables import run_query

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def register(function: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(Warehouse(spark, folder))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    REGISTERED[function.__name__] = run
    return function


def named(name: str, function: Callable[[Warehouse], DataFrame]) -> None:
    function.__name__ = name
    register(function)


# Facts and KPIs

for _name in (
    "fct_orders", "fct_order_items", "fct_delivery", "sales_by_category", "delivery_monthly",
    "kpi_overview",
):
    named(_name, lambda w, _name=_name: getattr(w, _name))


@register
def kpi_monthly_sales(w: Warehouse) -> DataFrame:
    return w.kpi_monthly.orderBy("month")


@register
def kpi_overview_two_facts(w: Warehouse) -> DataFrame:
    return marts.kpi_overview(w.order_totals, w.fct_delivery)


@register
def fct_order_items_lookup(w: Warehouse) -> DataFrame:
    """The look-up alone, to be run with a dimension too large to broadcast as well."""
    category = w.products.select("product_id", "product_category_name_en")
    return lookup(w.items, category, "product_id")


@register
def fct_payments(w: Warehouse) -> DataFrame:
    return marts.fct_payments(w.payments)


@register
def dim_customers(w: Warehouse) -> DataFrame:
    return marts.dim_customers(w.placed_customers)


@register
def dim_sellers(w: Warehouse) -> DataFrame:
    return marts.dim_sellers(w.placed_sellers)


@register
def dim_products(w: Warehouse) -> DataFrame:
    return marts.dim_products(w.staged("stg_products"))


# Staging

for _name in MODELS:
    named(_name, lambda w, _name=_name: w.staged(_name))


@register
def csv_roundtrip(w: Warehouse) -> DataFrame:
    """Orders written as a source file to the shared folder, loaded and staged."""
    folder = shared_folder(w.spark, "csv")
    spec = next(s for s in SOURCES if s.table == "orders")
    writer = w.raw_orders.write.option("header", True).option("emptyValue", "")
    for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(side, False)
    writer.csv(spec.path(folder))
    return stg_orders(read_raw(w.spark, spec, folder))


@register
def csv_reviews(w: Warehouse) -> DataFrame:
    """Reviews, whose cells hold commas, quotes and line ends, as a source file and back."""
    folder = shared_folder(w.spark, "csv")
    spec = next(s for s in SOURCES if s.table == "order_reviews")
    writer = w.raw_order_reviews.write.option("header", True).option("emptyValue", "")
    for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(side, False)
    writer.option("escape", '"').csv(spec.path(folder))
    return stage("stg_order_reviews", lambda _: read_raw(w.spark, spec, folder))


@register
def land_csv(w: Warehouse) -> DataFrame:
    """Every order line as an uploaded file, landed as text."""
    path = f"{shared_folder(w.spark, 'upload')}/lines.csv"
    lines = w.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
        F.concat(F.lit("line \n"), "l_linestatus").alias("status"), F.lit("").alias("nothing"),
    )
    writer = lines.write.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return w.spark.table(landing.land_csv(w.spark, path, datetime.now(timezone.utc)).table)


@register
def lenient_casts(w: Warehouse) -> DataFrame:
    """Quarantine form of the typed cast: malformed cells become NULL, and are counted."""
    cells = w.table("orders").select(
        F.col("o_orderpriority").alias("priority"),
        F.split("o_orderpriority", "-")[0].alias("number"),
        F.when(F.col("o_orderstatus") == "P", "")
        .when(F.col("o_orderpriority") == "5-LOW", "5")
        .otherwise(F.col("o_orderpriority"))
        .alias("bad"),
    )
    return cells.groupBy("priority").agg(
        F.sum(typed("number", "int", strict=False)).alias("number_sum"),
        F.count(typed("bad", "int", strict=False)).alias("castable"),
        F.count_if(F.col("bad") != "").alias("not_blank"),
    )


# Business queries


@register
def recent_orders(w: Warehouse) -> DataFrame:
    return kpis.recent_orders(w.order_totals)


@register
def top_categories(w: Warehouse) -> DataFrame:
    return kpis.top_categories(w.sales_by_category, 20)


@register
def dashboard_categories(w: Warehouse) -> DataFrame:
    return kpis.top_categories(w.sales_by_category, 3)


@register
def dashboard(w: Warehouse) -> DataFrame:
    """Overview, two years of months and the four best categories in one list."""
    summary = kpis.kpi_summary(w.kpi_overview, w.kpi_monthly, "1996-01-01", "1997-12-31")
    board = kpis.Dashboard(summary, kpis.top_categories(w.sales_by_category, 4))

    def section(name: str, df: DataFrame, label, revenue: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"), label.cast("string").alias("label"), "total_orders",
            F.col(revenue).alias("revenue"),
        )

    return quality.union_all([
        section("overview", board.summary.overview, F.lit("all"), "gmv"),
        section("series", board.summary.series, F.col("month"), "gmv"),
        section("category", board.top_categories, F.col("category_name_en"), "total_revenue"),
    ])


@register
def bound_query(w: Warehouse) -> DataFrame:
    """Query text with bound values over a given table, cut on the outside."""
    w.order_totals.createOrReplaceTempView("bound_orders")
    found = run_query(
        w.spark,
        "SELECT order_id, payment_total FROM bound_orders "
        "WHERE payment_total > :low AND order_status = :status ORDER BY order_id",
        low=150_000,
        status="delivered",
    )
    return ranking.bounded(found, 200)


@register
def summaries(w: Warehouse) -> DataFrame:
    """Drill-down, correlation and trend of the monthly KPIs as (summary, name, value)."""
    found = analytics.summaries(w.kpi_monthly)
    shown = {
        "drill_down": (F.col("group"), F.col("sum")),
        "correlation": (F.concat_ws(" ", "x", "y"), F.col("pearson")),
        "time_series": (F.col("trend"), F.col("pct_change")),
    }
    return quality.union_all([
        found[kind].select(
            F.lit(kind).alias("summary"), name.alias("name"), value.cast("double").alias("value")
        )
        for kind, (name, value) in shown.items()
    ])


@register
def latest_quarter(w: Warehouse) -> DataFrame:
    return kpis.latest_months(w.kpi_monthly, 3)


@register
def kpi_range(w: Warehouse) -> DataFrame:
    """Months from mid January on, so January itself is left out."""
    low, high = "1997-01-15", "1998-06-30"
    orders = kpis.orders_of_months(w.orders, low, high)
    totals = marts.order_totals(orders, w.items, w.payments)
    return kpis.monthly_sales(marts.kpi_monthly(totals), low, high)


@register
def kpi_summary(w: Warehouse) -> DataFrame:
    """Overview of all time next to the length of the asked series."""
    summary = kpis.kpi_summary(w.kpi_overview, w.kpi_monthly, "1996-01-01", "1996-12-31")
    months = summary.series_row_count.scalar()
    return summary.overview.withColumn("series_row_count", months)


@register
def delivery_series(w: Warehouse) -> DataFrame:
    return kpis.delivery_series(w.delivery_monthly)


@register
def overview(w: Warehouse) -> DataFrame:
    return kpis.overview(w.kpi_overview)


@register
def kpi_measures(w: Warehouse) -> DataFrame:
    """GMV, orders, customers and both order values per payment type."""
    order_columns = w.orders.select("order_id", "customer_id", "order_status")
    person = w.customers.select("customer_id", "customer_unique_id")
    paid = w.payments.join(lookup(order_columns, person, "customer_id"), "order_id", "left")
    return kpis.kpi(
        paid, "gmv", "orders", "customers", "aov", "aov_delivered", by=["payment_type"]
    )


@register
def last_months(w: Warehouse) -> DataFrame:
    return ranking.last_periods(w.kpi_monthly, "month", 12)


# Data checks. Keys of some kinds of rows are blanked so that there are failures to find.


@register
def dq_not_null(w: Warehouse) -> DataFrame:
    known = F.col("o_orderpriority") != "5-LOW"
    orders = w.table("orders").select(
        "o_orderkey", F.when(known, F.col("o_custkey")).alias("o_custkey")
    )
    return quality.not_null(orders, "o_custkey")


@register
def dq_unique(w: Warehouse) -> DataFrame:
    known = F.col("l_returnflag") != "N"
    lines = w.table("lineitem").select(F.when(known, F.col("l_orderkey")).alias("l_orderkey"))
    return quality.unique(lines, "l_orderkey")


@register
def dq_relationships(w: Warehouse) -> DataFrame:
    """Lines whose order is among those without a delivery time."""
    delivered = w.orders.where(F.col("order_delivered_customer_ts").isNotNull())
    known = F.col("l_returnflag") != "N"
    lines = w.table("lineitem").select(F.when(known, F.col("l_orderkey")).alias("order_id"))
    return quality.relationship(lines, "order_id", delivered, "order_id")


@register
def dq_row_parity(w: Warehouse) -> DataFrame:
    pairs = {
        "orders": (w.table("orders"), w.orders),
        "delivered": (w.table("orders"), w.fct_delivery),
        "order_items": (w.table("lineitem"), w.fct_order_items),
        "events": (w.table("events"), w.table("events").where("value > 10")),
    }
    return quality.row_parity(pairs)


@register
def dq_recency(w: Warehouse) -> DataFrame:
    return quality.recency(w.orders, "order_purchase_ts", "2018-08-01")


@register
def dq_report(w: Warehouse) -> DataFrame:
    tables = {
        "stg_customers": w.placed_customers,
        "stg_orders": w.orders,
        "stg_order_items": w.items,
        "stg_products": w.products,
        "stg_sellers": w.placed_sellers,
        "stg_order_payments": w.payments,
    }
    checks = [
        c
        for c in quality.STAGING_CHECKS
        if c.table in tables and (c.parent is None or c.parent in tables)
    ]
    checks.append(quality.Check("unique", "stg_order_items", "order_id"))
    stale = quality.recency(w.orders, "order_purchase_ts", "2018-08-01")
    return quality.run_checks(tables, checks, {"recency": stale})


# Summaries of a result


@register
def trend_summary(w: Warehouse) -> DataFrame:
    return analytics.trend(w.kpi_monthly)


@register
def trend_events(w: Warehouse) -> DataFrame:
    """Over single events: time by time, no sum before."""
    events = w.table("events").select(F.col("ts").cast("string").alias("date"), "value")
    return analytics.trend(events, metric="value")


@register
def drill_down(w: Warehouse) -> DataFrame:
    """Order totals by month, fifteen months kept."""
    return analytics.drill_down(
        w.order_totals.select("order_month", F.col("payment_total").alias("gmv"))
    )


@register
def drill_down_counts(w: Warehouse) -> DataFrame:
    return analytics.drill_down(w.table("events").select("event_type"))


@register
def correlations(w: Warehouse) -> DataFrame:
    """Numbers, a constant, numbers as text and plain text."""
    return analytics.correlations(
        w.table("lineitem").select(
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
            F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("string")).alias("text"),
            F.lit(5).alias("constant"),
            "l_returnflag",
        )
    )


@register
def numeric_profile(w: Warehouse) -> DataFrame:
    return analytics.profile_numeric(
        w.table("orders").select(
            "o_orderkey",
            F.split("o_orderpriority", "-")[0].alias("priority_number"),
            F.when(F.col("o_orderstatus") == "P", "").otherwise(
                F.col("o_totalprice").cast("string")
            ).alias("price_text"),
            F.when(F.col("o_orderstatus") == "F", "F").otherwise("7").alias("mixed"),
            "o_orderdate",
        )
    )


@register
def chart_series(w: Warehouse) -> DataFrame:
    monthly = w.kpi_monthly
    return analytics.series(monthly, "xu huong doanh thu", order_by=["month"])


@register
def chart_top(w: Warehouse) -> DataFrame:
    categories = w.sales_by_category
    return analytics.series(categories, "top categories", order_by=["category_name_en"])


@register
def figure_block(w: Warehouse) -> DataFrame:
    return analytics.figure(w.kpi_monthly, order_by=["month"])


# Text


@register
def conversation_context(w: Warehouse) -> DataFrame:
    return ranking.conversation_context(w.table("conversations"))


@register
def intent_tags(w: Warehouse) -> DataFrame:
    tagged = text.tag_intent(w.table("conversations"), "text")
    return tagged.select("conv_id", "turn", "intent")


def questions(w: Warehouse) -> DataFrame:
    """One question per event: its number picks the wording, its value and day fill it in."""
    wording = F.array(*[F.lit(q) for q in QUESTIONS])
    pick = F.pmod(F.col("event_id"), F.lit(len(QUESTIONS))).cast("int") + 1
    day = F.date_format("ts", "yyyy-MM-dd")
    return w.table("events").select(
        "event_id",
        F.concat_ws(
            " ",
            F.element_at(wording, pick),
            F.when(F.col("event_type") == "view", day),
            F.when(F.col("value") > 10, F.concat(F.lit("2016-02-30 "), F.col("event_type"))),
        ).alias("question"),
    )


@register
def intent_questions(w: Warehouse) -> DataFrame:
    return text.tag_intent(questions(w), "question").select("event_id", "intent")


@register
def keywords(w: Warehouse) -> DataFrame:
    return w.table("conversations").select(
        "conv_id", "turn", text.keyword("text").alias("keyword")
    )


@register
def business_terms(w: Warehouse) -> DataFrame:
    return questions(w).select(
        "event_id",
        text.business_term("question").alias("term"),
        text.keyword("question").alias("keyword"),
    )


@register
def date_ranges(w: Warehouse) -> DataFrame:
    start, end = text.date_range("question")
    return questions(w).select("event_id", start.alias("start_date"), end.alias("end_date"))


@register
def glossary_lookup(w: Warehouse) -> DataFrame:
    asked = questions(w).select("event_id", text.business_term("question").alias("asked"))
    return text.lookup_terms(asked, "asked")


@register
def stable_ids(w: Warehouse) -> DataFrame:
    return w.table("documents").select("doc_id", stable_id("text").alias("id"))


# Catalog. Parts stand for columns, fifty to a table, to have an inventory that grows.


def inventory(w: Warehouse) -> DataFrame:
    number = F.col("p_partkey")
    return w.table("part").select(
        F.lower("p_type").alias("table_schema"),
        F.concat_ws(
            "_", F.regexp_replace("p_brand", "#", "_"), F.floor(number / 50).cast("string")
        ).alias("table_name"),
        F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), number.cast("string")).alias(
            "column_name"
        ),
        number.cast("int").alias("ordinal_position"),
        F.when(F.col("p_size") < 10, "integer").otherwise("text").alias("data_type"),
        F.lit(True).alias("is_nullable"),
    )


@register
def schema_search(w: Warehouse) -> DataFrame:
    return catalog.search_schema(inventory(w), "RED_", ["economy", "promo", "small"])


@register
def table_documents(w: Warehouse) -> DataFrame:
    documents = catalog.table_documents(inventory(w))
    return documents.select(
        "id",
        "fully_qualified",
        F.array_join("columns", ",").alias("columns"),
        F.size("column_types").alias("n_types"),
        "document",
    )


# Vectors. The questions come as text and are embedded when the query is built.


def embeddings(w: Warehouse) -> DataFrame:
    return w.table("embeddings").withColumnRenamed("vec_id", "id")


@register
def vector_topk(w: Warehouse) -> DataFrame:
    return vectors.vector_topk(embeddings(w), question_vectors(), 5, payload=["label"])


@register
def vector_topk_filtered(w: Warehouse) -> DataFrame:
    return vectors.vector_topk(
        embeddings(w), question_vectors(), 3, where={"label": 3}, min_score=0.1, payload=["label"]
    )


@register
def context_pack(w: Warehouse) -> DataFrame:
    label = F.concat(F.lit("label "), F.col("label").cast("string")).alias("document")
    corpus = embeddings(w).select("id", "embedding", label)
    hits = vectors.vector_topk(corpus, question_vectors(), 4, payload=["document"])
    return vectors.pack_context(hits)


@register
def vector_upsert(w: Warehouse) -> DataFrame:
    """The vectors of low labels replaced and as many new ones added, each sent twice."""
    base = embeddings(w).withColumn("version", F.lit(0))
    low = base.where(F.col("label") < 3)
    moved = low.select((F.col("id") + 1_000_000_000).alias("id"), "embedding", "label")
    sent = low.select("id", "embedding", (F.col("label") + 100).alias("label"))
    sent = sent.unionByName(moved)
    delta = sent.withColumn("version", F.lit(2)).unionByName(
        sent.withColumn("label", F.lit(-1)).withColumn("version", F.lit(1))
    )
    stored = vectors.upsert_vectors(base, delta, dim=64, version="version")
    return stored.select(
        "id", "label", "version", F.round(F.col("embedding")[0].cast("double"), 6).alias("first")
    )


@register
def vector_topk_bulk(w: Warehouse) -> DataFrame:
    """Every fiftieth vector as a question to all vectors."""
    asked = w.table("embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return vectors.vector_topk(embeddings(w), asked, 5, payload=["label"])


@register
def index_size(w: Warehouse) -> DataFrame:
    embeddings(w).createOrReplaceTempView("embedding_collection")
    return vectors.index_size(w.spark, "embedding_collection")


@register
def embed_documents(w: Warehouse) -> DataFrame:
    """Whole documents to vectors, with every weight."""
    vector = vectors.embed_words(w.table("documents"), ["doc_id"], "text", 64)
    weights = F.transform("embedding", lambda x: F.format_string("%.4f", F.round(x, 4)))
    return vector.select("doc_id", F.array_join(weights, ",").alias("weights"))


# Load ledger


@register
def load_ledger(w: Warehouse) -> DataFrame:
    """State of runs from their events: users as runs, sign-up starts, purchase and error
    finish."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "running")
        .when(kind == "purchase", "success")
        .when(kind == "error", "failed")
    )
    events = w.table("events").select(
        F.col("user_id").alias("run_id"),
        F.col("ts").alias("event_ts"),
        status.alias("status"),
        F.col("value").cast("decimal(12,2)").alias("duration_seconds"),
        F.when(kind == "error", F.col("props")).alias("error_message"),
    )
    return latest_runs(events)
