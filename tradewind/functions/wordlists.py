"""Word lists, glossary entries and preferred column names.

They decide results, so they hold exactly the phrases users of the platform know.
"""

SCHEMA_WORDS = ["schema", "column", "table", "field", "metadata"]

DEFINITION_WORDS = ["definition", "define", "meaning", "what is", "dinh nghia", "định nghĩa"]

KPI_WORDS = [
    "kpi", "gmv", "aov", "revenue", "summary", "trend", "monthly", "doanh thu",
    "xu huong", "xu hướng", "thang", "tháng", "quy", "quý",
]

QUERY_WORDS = [
    "sql", "query", "select", "from", "where", "group by", "order by", "limit", "join",
    "truy van", "truy vấn", "danh sach", "danh sách", "đơn hàng", "don hang",
    "sản phẩm", "san pham", "doanh thu",
]

QUERY_CLAUSES = [
    " select ", " from ", " where ", " group by ", " order by ", " limit ", " join ",
]

# Patterns: how a question that is query text, or asks for rows, begins.
QUERY_START = r"(?U)^(select|with)\b"
ASKING_START = r"(?U)^(show|list|find|get|give|tell|display)\b"

HELP_WORDS = [
    "help", "what can you do", "làm được gì", "ban lam duoc gi", "capabilities", "commands",
]

SMALL_TALK_WORDS = [
    "hi", "hello", "hey", "how are you", "good morning", "good afternoon", "good evening",
    "thanks", "thank you",
]

ANALYTICS_WORDS = [
    "order", "orders", "revenue", "sales", "gmv", "aov", "kpi", "truy van", "truy vấn",
    "don hang", "đơn hàng", "san pham", "sản phẩm", "doanh thu", "danh muc", "danh mục",
    "bao cao", "báo cáo", "thang", "tháng", "quy", "quý", "gan nhat", "gần nhất",
]

ANALYTICS_SCHEMA_WORDS = ["schema", "column", "table", "metadata", "cột", "bảng"]

ANALYTICS_DEFINITION_WORDS = [
    "definition", "define", "dinh nghia", "định nghĩa", "meaning", "la gi", "là gì",
    "nghia la", "nghĩa là", "viet tat", "viết tắt", "what is", "what does",
]

ANALYTICS_CATEGORY_WORDS = ["danh muc", "danh mục", "category", "categories"]

ANALYTICS_KPI_WORDS = ["kpi", "doanh thu", "gmv", "aov", "trend", "xu huong", "xu hướng"]

KEYWORD_STOP_WORDS = [
    "show", "list", "find", "what", "is", "the", "schema", "table", "column", "for", "of",
    "me", "please", "definition", "meaning",
]

CORRELATION_HINTS = [
    "tương quan", "tuong quan", "correlation", "liên hệ", "lien he", "quan hệ", "quan he",
    "ảnh hưởng", "anh huong",
]

DRILL_HINTS = [
    "drill", "phân tích sâu", "phan tich sau", "phân tách", "phan tach", "theo nhóm",
    "theo nhom", "by group", "top", "ranking", "xếp hạng", "xep hang",
]

LINE_HINTS = [
    "trend", "xu hướng", "xu huong", "theo tháng", "theo thang", "theo quý", "theo quy",
    "monthly", "weekly", "daily", "over time", "diễn biến", "dien bien", "tăng giảm",
    "tang giam",
]

BAR_HINTS = [
    "top", "so sánh", "so sanh", "cao nhất", "cao nhat", "thấp nhất", "thap nhat", "ranking",
    "xếp hạng", "xep hang", "theo danh mục", "theo danh muc", "theo loại", "theo loai",
    "by category",
]

TOP_HINTS = ["top", "cao nhất", "cao nhat"]

TREND_TIMES = ["month", "order_month", "date"]
TREND_METRICS = ["gmv", "total_orders", "avg_order_value", "total_revenue"]
DRILL_DIMENSIONS = ["category_name_en", "month", "order_month", "seller_id", "customer_state"]
DRILL_METRICS = ["gmv", "total_revenue", "total_orders", "avg_order_value"]
CHART_LABELS = ["month", "order_month", "date", "category_name_en", "table_name", "column_name"]
CHART_VALUES = [
    "gmv", "total_revenue", "avg_order_value", "total_orders", "delivered_orders",
    "late_delivery_rate", "avg_delivery_delay_days",
]
FIGURE_LABELS = ["month", "date", "order_month", "category_name_en", "table_name", "column_name"]
FIGURE_VALUES = ["gmv", "total_revenue", "total_orders", "delivered_orders", "avg_order_value"]

DEFAULT_START = "2017-01-01"
DEFAULT_END = "2018-12-31"

# key, term, definition, formula, source table
GLOSSARY = [
    (
        "gmv",
        "Gross Merchandise Value",
        "Total paid order value before cancellations and refunds in the selected window.",
        "SUM(payment_value)",
        "marts.fct_payments",
    ),
    (
        "aov",
        "Average Order Value",
        "Average payment value per delivered order.",
        "SUM(payment_value) / COUNT(DISTINCT delivered_order_id)",
        "serving.kpi_overview",
    ),
    (
        "delivery_delay_days",
        "Delivery Delay (Days)",
        "Average number of days between delivered date and estimated date.",
        "AVG(delivery_delay_days)",
        "marts.fct_delivery_performance",
    ),
    (
        "delivered_order_rate",
        "Delivered Order Rate",
        "Share of delivered orders over all created orders.",
        "COUNT(delivered_orders) / COUNT(total_orders)",
        "serving.kpi_overview",
    ),
]
