"""Licence rules: gates that lose nothing, suppression, counted phrases, against plain Python."""

import random
import re

import pytest

try:
    from re import _parser as sre
except ImportError:
    import sre_parse as sre
from pyspark.sql import functions as F

from tradewind.llm.license_rules import BASE, SURE, gates, rules
from tradewind.llm.license_scan import detections, license_scan, scanned

RULES = rules()


def example(pattern, rng):
    """A text that the pattern matches."""

    def of(tree):
        out = []
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(arg))
            elif name == "NOT_LITERAL":
                out.append("q")
            elif name == "IN":
                kinds = [(str(o), a) for o, a in arg]
                if kinds[0][0] == "NEGATE":
                    out.append("q")
                    continue
                kind, a = rng.choice(kinds)
                out.append(chr(a) if kind == "LITERAL" else chr(rng.randint(*a)))
            elif name == "BRANCH":
                out.append(of(rng.choice(arg[1])))
            elif name == "SUBPATTERN":
                out.append(of(arg[-1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out.extend(of(inner) for _ in range(rng.randint(low, min(int(high), low + 3))))
            else:
                raise AssertionError(name)
        return "".join(out)

    return of(sre.parse(pattern))


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def scan_in_python(text):
    """All rules on the text without gates; suppression by looking at all pairs."""
    words = words_of(text)
    spaced = "".join(f" {w} " for w in words)
    before = {0: 0}
    for i, c in enumerate(spaced):
        before[i + 1] = before[i] + (c == " ")
    found = []
    for i, rule in enumerate(RULES):
        for m in re.finditer(f" (?:{rule.pattern.replace(' ', '  ')}) ", spaced):
            found.append((before[m.start()] // 2, before[m.end()] // 2, rule.priority, i))
    kept = [d for d in found if not any(
        e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))
        for e in found)]
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(RULES[d[3]].label for d in kept)})
    sure = [SURE[d[2]] for d in kept] + [SURE[-1]] * bool(places)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), max(sure, default=0.0))


def test_there_are_hundreds_of_rules_and_their_keywords_are_in_every_match():
    assert len(RULES) > 300 and len(set(RULES)) == len(RULES)
    assert [r.priority for r in RULES] == sorted(r.priority for r in RULES)
    rng = random.Random(3)
    for rule in RULES:
        for _ in range(20):
            text = example(rule.pattern, rng)
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text, (rule, text)


def test_gates_open_for_every_match():
    stem_of = {k: stem for stem, keywords in gates().items() for k in keywords}
    rng = random.Random(4)
    for rule in RULES:
        assert all(stem_of[rule.keyword] in example(rule.pattern, rng) for _ in range(20)), rule
    assert all(stem_of[phrase] in phrase for phrase, _ in BASE) and len(stem_of) > 2 * len(gates())


TEXTS = [
    None, "", " \n", "plain prose without any notice, mit der Zeit", "MIT License", "the MIT-licence; apache license, VERSION 2.0",
    "GNU Lesser General Public License version 2.1 or later", "CC BY CC BY-SA 4.0 cc by", "All rights\nreserved. ALL RIGHTS RESERVED",
    "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the Apache License, Version 2.0", "Copyright (c) 2024 someone",
    "general public license general public license", "ÀLL rights reserved allrights reserved", "all rights all rights reserved",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products",
    "creative commons attribution non-commercial share alike 4.0 international license", "word " * 5000 + "mit license",
]


def test_scan_is_that_of_all_rules_without_gates(spark):
    rng = random.Random(8)
    texts = list(TEXTS)
    for i in range(250):
        bits = [example(rng.choice(RULES).pattern, rng) for _ in range(rng.randrange(1, 5))] + [rng.choice(["x", "cc by", "of", "license"])] * rng.randrange(3)
        rng.shuffle(bits)
        texts.append(rng.choice([" ", ", ", "\n", " and "]).join(bits).upper() if i % 3 == 0 else " ".join(bits))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, label string, row string")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(docs.repartition(4)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == scan_in_python(text), text


def test_contained_matches_of_weaker_or_equal_rules_go(spark):
    docs = spark.createDataFrame([(1, "released under the GNU Lesser General Public License version 3, see license terms and conditions")], "doc_id long, text string")
    found = detections(scanned(docs)).collect()
    kept = {r.label for r in found if r.kept and not r.counted}
    assert kept == {"lgpl-3.0", "license-reference"}
    assert any(r.label == "gpl" and not r.counted and not r.kept for r in found)
    row = license_scan(docs).first()
    assert row.base_labels == "gpl" and row.labels == "gpl,lgpl-3.0,license-reference" and row.score == 0.95


def test_rows_with_one_id_or_none_are_rows_each(spark):
    docs = spark.createDataFrame([(1, "mit license")] * 3 + [(None, "cc by")] * 2, "doc_id long, text string")
    rows = license_scan(docs).collect()
    assert sorted((str(r.doc_id), r.labels) for r in rows) == [("1", "mit")] * 3 + [("None", "cc-by")] * 2


@pytest.mark.parametrize("times", [20_000])
def test_a_text_with_very_many_matches(spark, times):
    docs = spark.createDataFrame([(1, "all rights reserved. " * times)], "doc_id long, text string")
    row = license_scan(docs).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (3 * times, times, 0, 3 * times - 3)


def test_plan_has_no_python(spark, folder):
    plan = license_scan(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None
