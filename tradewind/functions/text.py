"""Bulk tagging of question text: intent, keyword, date range, glossary term.

Every function returns one Column of built-in expressions, so a table of any number of
questions is tagged in the scan stage, without a shuffle and without Python workers.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import wordlists as words
from tradewind.functions.columns import col

# White space as question text is split on; the four separators are not in Java's class.
SPACE = r"[\s\x1c-\x1f]"


def normalize(c: Column | str) -> Column:
    """Lower case, ends stripped, each run of white space one space."""
    folded = F.regexp_replace(F.lower(col(c)), f"(?U){SPACE}+", " ")
    return F.trim(folded)


def strip_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def phrase_list(phrases: list[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases])


def mentions(text: Column, phrases: list[str]) -> Column:
    """True where the text holds any of the phrases: one pattern, compiled once."""
    return text.rlike("|".join(f"\\Q{phrase}\\E" for phrase in phrases))


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text holds."""
    return F.size(F.filter(phrase_list(phrases), lambda p: F.contains(text, p)))


def intent_of(question: Column) -> Column:
    """Intent of an already normalized question (see :func:`tag_intent`)."""
    padded = F.concat(F.lit(" "), question, F.lit(" "))
    # Two clauses are only counted where there is one.
    clauses = mentions(padded, words.QUERY_CLAUSES) & (hits(padded, words.QUERY_CLAUSES) >= 2)
    is_query = question.rlike(words.QUERY_START) | clauses

    analytics = (
        F.when(mentions(question, words.ANALYTICS_SCHEMA_WORDS), "schema_search")
        .when(mentions(question, words.ANALYTICS_DEFINITION_WORDS), "business_definition")
        .when(mentions(question, words.ANALYTICS_CATEGORY_WORDS), "sql_query")
        .when(mentions(question, words.ANALYTICS_KPI_WORDS), "kpi_summary")
        .otherwise("sql_query")
    )

    # The best score wins; of equal scores the earlier intent, hence the falling rank. It is
    # only asked for where some phrase was found.
    scored = [
        ("schema_search", words.SCHEMA_WORDS),
        ("business_definition", words.DEFINITION_WORDS),
        ("kpi_summary", words.KPI_WORDS),
        ("sql_query", words.QUERY_WORDS),
    ]
    best = F.greatest(*[
        F.struct(
            hits(question, phrases).alias("score"),
            F.lit(-rank).alias("rank"),
            F.lit(intent).alias("intent"),
        )
        for rank, (intent, phrases) in enumerate(scored)
    ])

    any_scored = sorted({phrase for _, phrases in scored for phrase in phrases})
    return (
        F.when(question.isNull() | (question == ""), "chitchat")
        .when(is_query, "sql_query")
        .when(mentions(question, words.HELP_WORDS), "help_request")
        .when(mentions(question, words.ANALYTICS_WORDS), analytics)
        .when(mentions(question, any_scored), best["intent"])
        .when(mentions(question, words.SMALL_TALK_WORDS), "chitchat")
        .when(F.size(F.split(question, " ")) <= 4, "chitchat")
        .when(question.rlike(words.ASKING_START), "sql_query")
        .otherwise("chitchat")
    )


def tag_intent(df: DataFrame, text: str, name: str = "intent") -> DataFrame:
    """Add the intent of the whole text. The normalized text is a column of its own so that
    it is computed once per row, not once per phrase."""
    question = "_question"
    return (
        df.withColumn(question, normalize(text))
        .withColumn(name, intent_of(F.col(question)))
        .drop(question)
    )


def _last_keyword(lowered: Column) -> Column:
    tokens = F.regexp_extract_all(lowered, F.lit("[a-zA-Z_]+"), F.lit(0))
    kept = F.filter(
        tokens, lambda t: (F.length(t) >= 3) & ~t.isin(words.KEYWORD_STOP_WORDS)
    )
    return F.try_element_at(kept, F.lit(-1))


def keyword(c: Column | str) -> Column:
    """Last word of three letters or more that is no stop word, else the stripped text."""
    return F.coalesce(_last_keyword(F.lower(col(c))), strip_space(c))


def business_term(c: Column | str, glossary: list[tuple] | None = None) -> Column:
    """Key of the first glossary entry named in the text, else its last keyword."""
    lowered = F.lower(col(c))
    entries = words.GLOSSARY if glossary is None else glossary
    named = F.coalesce(*[
        F.when(mentions(lowered, [key, term.lower()]), key) for key, term, *_ in entries
    ])
    return F.coalesce(named, _last_keyword(lowered), strip_space(lowered))


def glossary_key(c: Column | str, glossary: list[tuple] | None = None) -> Column:
    """Key of the entry whose key equals the input, else of the first whose key or name
    contains it, else NULL."""
    wanted = strip_space(F.lower(col(c)))
    entries = words.GLOSSARY if glossary is None else glossary
    exact = [F.when(wanted == key, key) for key, *_ in entries]
    partial = [
        F.when(F.contains(F.lit(key), wanted) | F.contains(F.lit(term.lower()), wanted), key)
        for key, term, *_ in entries
    ]
    return F.coalesce(*exact, *partial)


def lookup_terms(df: DataFrame, c: str, glossary: list[tuple] | None = None) -> DataFrame:
    """Add found, term, definition, formula, source_table and, where nothing was found, the
    terms there are. The glossary is a list in the program, so it travels as literals."""
    entries = words.GLOSSARY if glossary is None else glossary
    key = "_key"
    fields = ["term", "definition", "formula", "source_table"]

    def entry_field(position: int) -> Column:
        return F.coalesce(*[
            F.when(F.col(key) == entry[0], entry[position]) for entry in entries
        ])

    known = ", ".join(sorted(entry[0] for entry in entries))
    return (
        df.withColumn(key, glossary_key(c, glossary))
        .withColumn("found", F.col(key).isNotNull())
        .withColumns({name: entry_field(i + 1) for i, name in enumerate(fields)})
        .withColumn("available_terms", F.when(F.col(key).isNull(), known))
        .drop(key)
    )


def date_range(
    c: Column | str,
    start: date | str | None = None,
    end: date | str | None = None,
) -> tuple[Column, Column]:
    """First two ISO dates written in the text; a missing one is taken from the context
    bounds, an impossible one is NULL."""
    found = F.regexp_extract_all(col(c), F.lit(r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"), F.lit(0))

    def bound(position: int, default: date | str) -> Column:
        written = F.coalesce(F.try_element_at(found, F.lit(position)), F.lit(str(default)))
        # Year 0000 does not exist in the calendar of the platform.
        valid = written.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~written.startswith("0000")
        return F.when(valid, written.try_cast("date"))

    return bound(1, start or words.DEFAULT_START), bound(2, end or words.DEFAULT_END)
