"""Licence notices in texts by ordered signature rules, in built-in functions only."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.license_rules import BASE, SURE, gates, rules
from tradewind.llm.stored import stored

# What separates words: ASCII that is neither a digit nor a lower-case letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE = "array<struct<rule:int,keyword:string,pattern:string>>"


def squeezed(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one space between them."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, SEPARATORS, " "))


def _signatures() -> list[dict]:
    """Patterns over words that have a space of their own on each side. The counted phrases come
    first, as rules that nothing suppresses."""
    phrases = [(phrase, phrase) for phrase, _ in BASE]
    told = [*phrases, *((rule.keyword, rule.pattern) for rule in rules())]
    return [
        {"rule": i, "keyword": keyword, "pattern": f" (?:{pattern.replace(' ', '  ')}) "}
        for i, (keyword, pattern) in enumerate(told)
    ]


def _rule_table(spark) -> DataFrame:
    """(rule, priority, label, sure, counted) of every rule: some hundred rows."""
    rows = [(i, -1, label, SURE[-1], True) for i, (_, label) in enumerate(BASE)]
    rows += [(len(BASE) + i, r.priority, r.label, SURE[r.priority], False) for i, r in enumerate(rules())]
    return spark.createDataFrame(rows, "rule int, priority int, label string, sure double, counted boolean")


def _n_words(spaced: Column) -> Column:
    """Words of a string in which each has a space on both sides."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" ")))) / 2).cast("int")


def _matches(words: Column, keywords: Column) -> Column:
    """Of every rule that has one of the keywords and matches: the words of each match, and the words
    before the first, between them and after the last."""
    spaced = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    table = F.from_json(F.lit(json.dumps(_signatures())), _RULE)
    asked = F.filter(table, lambda r: F.array_contains(keywords, r["keyword"]))
    found = F.transform(
        asked,
        lambda r: F.struct(
            r["rule"].alias("rule"),
            F.transform(F.regexp_extract_all(spaced, r["pattern"], F.lit(0)), _n_words).alias("spots"),
            F.transform(F.split(spaced, r["pattern"], -1), _n_words).alias("gaps"),
        ),
    )
    return F.filter(found, lambda m: F.size(m["spots"]) > 0)


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, n_words, matches) per row of ``docs``, written; the only pass over the texts.

    Which keywords a text holds decides which patterns are tried on it, and which stems it holds, for
    which keywords it is searched."""
    told = [{"stem": stem, "keywords": keywords} for stem, keywords in gates().items()]
    table = F.from_json(F.lit(json.dumps(told)), "array<struct<stem:string,keywords:array<string>>>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        squeezed(F.col(text_column)).alias("words"),
    )
    gaps = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" ")))
    opened = F.filter(table, lambda gate: F.contains(F.col("words"), gate["stem"]))
    held = F.flatten(
        F.transform(opened, lambda gate: F.filter(gate["keywords"], lambda k: F.contains(F.col("words"), k)))
    )
    gated = rows.withColumn("held", held)
    none = F.array().cast("array<struct<rule:int,spots:array<int>,gaps:array<int>>>")
    return stored(
        gated.select(
            "row",
            "id",
            F.when(F.col("words") == "", 0).otherwise(gaps + 1).cast("bigint").alias("n_words"),
            F.when(F.size("held") > 0, _matches(F.col("words"), F.col("held"))).otherwise(none).alias("matches"),
        ),
        "license-scan",
    )


def detections(scan: DataFrame) -> DataFrame:
    """(row, id, rule, priority, label, sure, counted, start, end, kept): every match, its words from
    ``start`` to before ``end``, and whether it counts.

    A match inside one of another rule with the same or a stronger priority is suppressed; of two
    over the same words the stronger stays, then the earlier rule. In the order by start, then the
    longest first, what may contain a match comes before it, so per priority the furthest end so far
    decides. Matches of the counted phrases always stay."""
    by_rule = Window.partitionBy("row", "rule").orderBy("nth")
    each = (
        scan.where(F.size("matches") > 0)
        .repartition("row")
        .select("row", "id", F.explode("matches").alias("m"))
        .select(
            "row",
            "id",
            F.col("m.rule").alias("rule"),
            F.posexplode(F.arrays_zip(F.col("m.spots").alias("spots"), F.slice("m.gaps", F.lit(1), F.size("m.spots")).alias("gaps"))).alias("nth", "at"),
        )
        .withColumn("end", F.sum(F.col("at.spots") + F.col("at.gaps")).over(by_rule))
        .withColumn("start", F.col("end") - F.col("at.spots"))
    )
    told = each.join(F.broadcast(_rule_table(scan.sparkSession)), "rule")
    before = (
        Window.partitionBy("row")
        .orderBy("start", F.desc("end"), "priority", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.lit(False)
    for p in range(len(SURE)):
        reach = F.max(F.when(F.col("priority") == p, F.col("end"))).over(before)
        inside = inside | ((F.col("priority") >= p) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    return told.select(
        "row", "id", "rule", "priority", "label", "sure", "counted", "start", "end",
        (F.col("counted") | ~inside).alias("kept"),
    )


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column, n_words, n_base (places of the counted phrases),
    first_word and last_word (their smallest and largest start in words from 0, or null), base_labels,
    labels (with those of the matches that are kept; both sorted and joined by commas) and score, how
    sure the strongest of them is (0 without any).

    A null or empty text has no words and no labels. Rows that share an id, or have none, are rows
    each. Other columns are ignored whatever their names. Texts are read whole and not shuffled."""
    scan = scanned(docs, id_column, text_column)
    found = detections(scan)
    start = F.when(F.col("counted"), F.col("start"))
    label_of = F.when(F.col("counted"), F.col("label"))
    told = found.where("kept").groupBy("row").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(label_of)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("sure").alias("score"),
    )
    return scan.select("row", "id", "n_words").join(told, "row", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rules_sql() -> str:
    told = [(label, -1, SURE[-1], True) for _, label in BASE]
    told += [(r.label, r.priority, SURE[r.priority], False) for r in rules()]
    rows = [
        f"({s['rule']}, '{s['keyword']}', '{s['pattern']}', '{label}', {priority}, {sure}, {counted})"
        for s, (label, priority, sure, counted) in zip(_signatures(), told, strict=True)
    ]
    return ",\n        ".join(rows)


OP12_SQL = rf"""
WITH rules(rule, keyword, pattern, label, priority, sure, counted) AS (
    VALUES {_rules_sql()}
), words AS (
    SELECT row_number() OVER () AS id, doc_id, trim(regexp_replace(
        translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{SEPARATORS}', ' ', 'g')) AS words
    FROM documents
), matched AS (
    SELECT id, rule, label, priority, sure::DOUBLE AS sure, counted,
        regexp_extract_all(spaced, pattern) AS spots, regexp_split_to_array(spaced, pattern) AS gaps
    FROM (SELECT id, words, ' ' || replace(words, ' ', '  ') || ' ' AS spaced FROM words)
    JOIN rules ON contains(words, keyword)
), placed AS (
    SELECT * EXCLUDE (spots, gaps), unnest(list_transform(range(1, len(spots) + 1), lambda i: {{
        'start': len(regexp_replace(array_to_string(gaps[1:i], '') || array_to_string(spots[1:i - 1], ''), '[^ ]', '', 'g')) // 2,
        'size': len(regexp_replace(spots[i], '[^ ]', '', 'g')) // 2}})) AS spot
    FROM matched
), spans AS (
    SELECT * EXCLUDE spot, spot.start AS start, spot.start + spot.size AS stop FROM placed
), kept AS (
    SELECT * FROM spans d WHERE counted OR NOT EXISTS (
        SELECT 1 FROM spans e WHERE e.id = d.id AND NOT e.counted AND e.start <= d.start AND e.stop >= d.stop
            AND (e.priority < d.priority OR e.priority = d.priority AND (e.stop - e.start > d.stop - d.start
                OR e.stop - e.start = d.stop - d.start AND e.rule < d.rule)))
), told AS (
    SELECT id, count(*) FILTER (WHERE counted) AS n_base, min(start) FILTER (WHERE counted) AS first_word,
        max(start) FILTER (WHERE counted) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE counted) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score
    FROM kept GROUP BY id
)
SELECT doc_id, CASE WHEN words = '' THEN 0 ELSE len(words) - len(replace(words, ' ', '')) + 1 END::BIGINT AS n_words,
    coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words LEFT JOIN told USING (id)
"""
