"""Passages, similarity, decontamination against plain loops; toxicity on held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tradewind.llm import toxicity
from tradewind.llm.components import components
from tradewind.llm.decontaminate import find_passages
from tradewind.llm.ngram_join import choose_bands, near_groups, similar_pairs
from tradewind.llm.substring_dedup import remove_repeats

SPACE = " \t\n\x0b\x0c\r"


def corpus(n=120, seed=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "你"]
    shared = [[rng.choice(words) for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for passage in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = passage[rng.randrange(0, 10) :]
        rows.append((i * 3 % n, rng.choice(SPACE).join(text)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (None, rows[5][1]), (504, rows[5][1])]
    return rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("gather,bits", [(50, 27), (1_000_000, 12)])
def test_repeats_against_loops(spark, gather, bits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first = {}
    for i, text in rows:
        words, key = split(text), 1 << 62 if i is None else i
        for a in range(len(words) - 12):
            window = tuple(words[a : a + 13])
            first[window] = min(first.get(window, key), key)
    wanted = []
    for i, text in rows:
        words, key = split(text), 1 << 62 if i is None else i
        gone = set()
        for a in range(len(words) - 12):
            if first[tuple(words[a : a + 13])] < key:
                gone.update(range(a, a + 13))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        wanted.append((str(i), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = remove_repeats(docs, gather=gather, bits=bits).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(wanted)


def test_rows_with_one_id_take_nothing_from_each_other(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text + " more"), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(1, 20, 0), (1, 21, 0), (2, 20, 20)]


def grams(text, n=5):
    words = split(text)
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.mark.parametrize("block", [4, 256])
def test_links_against_loops(spark, block):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(i % 6):
            text[rng.randrange(150)] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, t) for i, t in corpus(40)[:40] if i is not None]
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "a b"), (904, "a  b")]
    sets = {i: grams(t) for i, t in rows}
    links = {
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }
    group = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in near_groups(docs, block=block).collect()}
    assert {i: r.class_id for i, r in got.items()} == group
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in pair for pair in links) for i in sets}
    different = {(a, b) for a, b in links if sets[a] != sets[b]}
    firsts = {i: r.copy_id for i, r in got.items()}
    pairs = {(r.a, r.b) for r in similar_pairs(docs, block=block).collect()}
    assert pairs == {tuple(sorted((firsts[a], firsts[b]))) for a, b in different}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = choose_bands(threshold, recall, 200)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 200
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.999999, 4)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 1001), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 5000: 1000}


@pytest.mark.parametrize("chars", [40, 10_000])
def test_passages_against_loops(spark, chars):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma9", "é", "x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 16)))) for i in range(12)]
    items += [(20, None), (None, "alpha x alpha")]
    docs = [(i, rng.choice([" ", ", ", "--"]).join(rng.choice(words) for _ in range(rng.randrange(0, 400)))) for i in range(60)]
    docs += [(90, None), (91, "")]
    found = find_passages(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        chars=chars,
    )
    got = {r.doc_id: r for r in found.collect()}

    def normal(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    for i, text in docs:
        have = normal(text)
        hit, names = set(), set()
        for name, item in items:
            asked = normal(item)
            size = min(10, len(asked))
            windows = {tuple(asked[a : a + size]) for a in range(len(asked) - size + 1)} if asked else set()
            for a in range(len(have) - size + 1):
                if tuple(have[a : a + size]) in windows:
                    hit.update(range(a, a + size))
                    names.add("" if name is None else str(name))
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == (len(have), len(hit), sorted(names))
        shown = [w for s in r.spans for w in normal(text[s.start : s.end])]
        assert shown == [have[k] for k in sorted(hit)]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "ing", "tion", "an", "re", "st", "ha", "ou"]
    insults = ["idiot", "moron", "stupid", "worthless"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80))]
        if i % 4 == 0:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(w + (". " if rng.random() < 0.1 else "") for w in words))
        labels.append(i % 4 == 0)
    return texts, np.array(labels)


def test_machine_on_held_out_texts_and_disguises():
    model = toxicity.fit(*toxic_corpus(500, 1))
    texts, labels = toxic_corpus(300, 2)
    predicted = model.scores(pa.array(texts, pa.large_string())) >= toxicity.PREDICTED
    assert (predicted == labels).mean() > 0.98
    disguised = ["the on er st-upid ha", "ing re mo.ron on the", "you worth*less the on", "the on er ha ing re"]
    scores = model.scores(pa.array(disguised, pa.large_string()))
    assert min(scores[:3]) > scores[3]
    assert model.scores(pa.array(["", "  "], pa.large_string())).max() < toxicity.PREDICTED


def test_one_class_scores_nothing():
    model = toxicity.fit(["a b", "c d"], np.array([False, False]))
    assert model.scores(pa.array(["idiot"], pa.large_string())).max() < 0.01


def test_scores_of_a_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    changed = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source")
    plain = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert plain == {r.doc_id: r.score for r in toxicity.score(changed.repartition(7), model).collect()}
    assert all(0 <= s <= 1 for s in plain.values())
    rows = docs.select("doc_id", toxicity.held_out("doc_id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_change_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = labels.where(~toxicity.held_out("doc_id"))
    one, two = toxicity.fit_on(docs, labels), toxicity.fit_on(docs, kept)
    assert (one.weights == two.weights).all() and one.shift == two.shift
