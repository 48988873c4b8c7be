"""Parameters shared by the registered queries and their SQL: question wordings."""

from __future__ import annotations

from tradewind.operators.vectors import HashingProvider

QUESTIONS = [
    "SELECT * FROM serving.kpi_overview",
    "show table schema for payments",
    "what is gmv definition",
    "monthly revenue trend",
    "GMV la gi",
    "AOV viet tat tu gi",
    "xu huong doanh thu",
    "doanh thu theo danh muc",
    "hi",
    "help",
    "  Tell me   something about the weather today please ",
    "give numbers",
    "describe everything that happened during our long voyage",
    "list rows where price is high limit 5",
    "average order value by region",
    "delivery delay (days) per state",
    "định nghĩa GMV",
    "summary",
]


def question_vectors(dim: int = 64) -> dict[str, list[float]]:
    """Three of the wordings as vectors of the offline provider."""
    asked = QUESTIONS[1:4]
    rows = HashingProvider(dim).embed(asked)
    return {question: row.tolist() for question, row in zip(asked, rows, strict=True)}
