"""Text helpers against plain loops on random strings, odd white space and scripts included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tradewind.functions import text
from tradewind.functions.columns import as_number, clean_text
from tradewind.functions.wordlists import KEYWORD_STOP_WORDS
from tradewind.operators import ranking

PIECES = [
    " ", "  ", "\t", "\n", " ", " ", "　", "\x1c", "\x85", "​", "a", "Z", "É", "ß",
    "İ", "đ", "ơ", "2018-01-02", "2018-13-02", "show", "gmv", "is", "ab", "_x_", "7", "-", "١", "😀",
]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(11)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(800)]


@pytest.fixture(scope="module")
def frame(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "i int, t string").repartition(4)


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_normalize(frame, strings):
    wanted = [re.sub(r"\s+", " ", s.strip().lower()) for s in strings]
    assert values(frame, text.normalize("t")) == wanted


def test_strip_space(frame, strings):
    assert values(frame, text.strip_space("t")) == [s.strip() for s in strings]


def test_trim_takes_spaces_only(frame, strings):
    assert values(frame, clean_text("t")) == [s.strip(" ") for s in strings]


def test_keyword(frame, strings):
    def loop(s):
        for word in reversed(re.findall(r"[a-zA-Z_]+", s.lower())):
            if len(word) >= 3 and word not in KEYWORD_STOP_WORDS:
                return word
        return s.strip()

    assert values(frame, text.keyword("t")) == [loop(s) for s in strings]


def test_dates(frame, strings):
    import datetime as dt

    def parse(value):
        try:
            return dt.date.fromisoformat(value)
        except ValueError:
            return None

    low, high = text.date_range("t")
    found = [re.findall(r"\d{4}-\d{2}-\d{2}", s) for s in strings]
    assert values(frame, low) == [parse(f[0] if f else "2017-01-01") for f in found]
    assert values(frame, high) == [parse(f[1] if len(f) > 1 else "2018-12-31") for f in found]


def test_numbers_in_text(spark):
    cells = ["1", " 2.5 ", "-3e2", "+.5", "5.", "", " ", "1d", "2f", "0x1p3", "1-2", "e5", "--1", "x", ".",
             "\t7\n", "1 2", "1e400"]

    def parse(value):
        try:
            return float(value)
        except ValueError:
            return None

    df = spark.createDataFrame(list(enumerate(cells)), "i int, t string")
    assert values(df, as_number("t", "string")) == [parse(c) for c in cells]


def test_conversation_context(spark, strings):
    rng = random.Random(13)
    turns = []
    for conversation in range(40):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", ""])
            turns.append((conversation, turn, role, rng.choice(strings) * rng.choice([1, 40])))
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    wanted = {}
    for conversation in range(40):
        own = sorted(t[1:] for t in turns if t[0] == conversation)[-6:]
        lines = [
            f"{role.upper()}: {said.strip()}" for _, role, said in own
            if role and said.strip()
        ]
        if lines:
            wanted[conversation] = "\n".join(lines)
    got = {r.conv_id: r.context for r in ranking.conversation_context(df.repartition(5)).collect()}
    assert got == wanted


def test_intent_is_stable_over_partitions(frame):
    one = text.tag_intent(frame.coalesce(1), "t").groupBy("intent").count()
    many = text.tag_intent(frame, "t").groupBy("intent").count()
    assert sorted(one.collect()) == sorted(many.collect())
    assert frame.select(F.count("*")).collect()[0][0] == 800
