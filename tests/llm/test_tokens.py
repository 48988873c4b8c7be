"""Token shards, counts, and the pipeline against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tradewind.llm import token_counts, token_shards, tokens
from tradewind.llm.decontaminate import find_passages
from tradewind.llm.mixing import mix
from tradewind.llm.ngram_join import near_groups
from tradewind.llm.stored import stored
from tradewind.llm.toxicity import PREDICTED, fit_on, score
from tradewind.llm.words import blocks


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    letters = " \n\t\x0b\x1f\x85\xa0 aB'sé你1!."
    docs = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(2000)]
    docs += ["", " ", "word " * 3000, "x" * 20_000]
    encoder = tokens.Encoder(token_shards.VOCABULARY)
    texts = pa.array(docs, pa.large_string())
    for _ in range(2):
        for low, high, buf, bounds in blocks(texts, 3000):
            ids, at = encoder.encode(buf, bounds)
            for k in range(low, high):
                assert ids[at[k - low] : at[k - low + 1]].tolist() == encoder.encoding.encode_ordinary(docs[k])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    slots = token_shards.permuted(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        assert (slots != token_shards.permuted(np.arange(n), n, key=7)).any()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.5


def test_shards_hold_every_id_once(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "of", "él", "x1"]) for _ in range(rng.randrange(0, 300)))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, "no id"), (7, "again the same id"), (7, "again the same id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    shards = token_shards.write_shards(df, str(tmp_path), length=16, per_shard=100)
    rows = token_shards.read_shards(shards, read=7).orderBy("slot").collect()
    encoding = tokens.load(token_shards.VOCABULARY)
    wanted = Counter()
    for i, text in docs:
        ids = encoding.encode_ordinary(text or "")
        ids = [*ids, encoding.n_vocab] if ids else []
        for part in range(0, len(ids), 16):
            wanted[i, part // 16, tuple(ids[part : part + 16])] += 1
    got = Counter((r.doc_id, r.part, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in rows)
    assert got == wanted
    assert [r.slot for r in rows] == list(range(sum(wanted.values())))
    stride = token_shards.HEAD + 32
    assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * stride for r in rows)
    later = token_shards.read_shards(shards, from_slot=133, read=7).orderBy("slot").collect()
    assert [(r.slot, r.ids) for r in later] == [(r.slot, r.ids) for r in rows[133:]]


def test_order_does_not_depend_on_the_splits(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = token_shards.materialised(docs).select("slot", "doc_id", "part", "ids_crc32").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        second = token_shards.materialised(spark.read.parquet(f"{folder}/documents.parquet"))
        second = second.select("slot", "doc_id", "part", "ids_crc32").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(first) == sorted(second)


def totals_of(state, versions):
    out = defaultdict(lambda: [0, 0, 0])
    for version in versions:
        encoding = tokens.load(version)
        for source, lang, text in state.values():
            sums = out[source, lang, version]
            sums[0] += 1
            sums[1] += len(encoding.encode_ordinary(text or ""))
            sums[2] += len(text or "")
    return dict(out)


def test_rollup_keeps_up_with_changes(spark, tmp_path):
    versions = (token_counts.VERSIONS[0],)
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"), versions)
    schema = "id long, source string, lang string, kind string, text string"
    state = {}

    def commit(batch, rows):
        rollup.commit(batch, spark.createDataFrame(rows, schema))

    def shown():
        return {(r.source, r.lang, r.version): [r.documents, r.tokens, r.chars] for r in rollup.totals().collect()}

    first = [(i, f"s{i % 2}", "en", "put", f"text number {i}") for i in range(20)]
    first += [(50, None, None, "put", None), (None, "s0", "en", "put", "no id"), (3, "s1", "en", "put", "text number 3")]
    commit(1, first)
    state |= {r[0]: (r[1], r[2], r[4]) for r in first if r[0] is not None}
    assert shown() == totals_of(state, versions)
    second = [(1, None, None, "delete", None), (2, "s9", "de", "put", "ein neuer Text"), (777, "x", "x", "delete", None)]
    for _ in range(2):
        commit(2, second)
    del state[1]
    state[2] = ("s9", "de", "ein neuer Text")
    assert shown() == totals_of(state, versions)
    commit(3, [(1, "s1", "en", "put", "back again")])
    state[1] = ("s1", "en", "back again")
    commit(2, second)  # delivered late once more
    assert shown() == totals_of(state, versions)
    with pytest.raises(ValueError):
        commit(0, second)


def test_totals_of_the_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    low = {r.doc_id for r in labels if r.quality == 0}
    state = {
        r.doc_id: (r.source, r.lang, re.sub("[ \t\n\x0b\f\r]+", " ", r.text).strip(" "))
        for r in docs if r.doc_id not in low
    }
    got = token_counts.op9_token_counts(spark, folder).collect()
    assert {
        (r.source, r.lang, r.version): [r.documents, r.tokens, r.chars] for r in got
    } == totals_of(state, token_counts.VERSIONS)


@pytest.mark.parametrize("where", ["folder", "messy"])
def test_pipeline_stages(spark, request, where):
    """Each stage against its own input."""
    sf_dir = request.getfixturevalue(where)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = [function for _, function in corpus_pipeline.STAGES]
    held = [docs]
    for function in stages[:-1]:
        held.append(stored(function(spark, held[-1], sf_dir), "test-stage"))
        assert held[-1].columns == columns

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r.doc_id for r in score(docs, model).collect() if r.score >= PREDICTED}
    assert ids(held[1]) == Counter({i: n for i, n in ids(docs).items() if i not in toxic})
    assert ids(held[2]) == Counter({r.class_id for r in near_groups(held[1]).collect()})
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = {r.doc_id for r in find_passages(held[2], benchmark).collect() if not r.n_hit}
    assert set(ids(held[3])) == clean
    mixed = ids(held[4])
    assert mixed and set(mixed) <= clean and max(mixed.values()) <= 2
    rows = stages[-1](spark, held[4], sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert {r.doc_id for r in rows} == set(mixed)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("where", ["folder", "messy"])
def test_the_mix_hands_on_as_many_words_as_it_takes(spark, request, where):
    docs = spark.read.parquet(f"{request.getfixturevalue(where)}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mix(docs).collect() if r.taken}
    texts = {r.doc_id: r for r in docs.collect()}
    words, cut = Counter(), Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        given = texts[r.doc_id]
        words[r.doc_id] += len(words_of(r.text))
        if r != given:
            cut[r.source] += 1
            assert given.text.startswith(r.text) and words_of(given.text)[: len(words_of(r.text))] == words_of(r.text)
            assert str(r.n_chars) == str(len(r.text))
    assert words == taken
    assert cut and max(cut.values()) == 1


def test_short_items_drop_every_document_that_has_them(spark, tmp_path):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, "Yes"), (2, "New York"), (3, f"{ten} eleven"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "he said yes to all of it"), (2, "in NEW, york it rains"), (3, "york is not new, yesterday"),
            (4, f"so {ten}."), (5, ten.removeprefix("one ") + " twelve"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [3, 5, 6]


def test_one_long_document_is_taken_in_part(spark):
    text = "\n" + " \t".join(f"w{i}" for i in range(20_000))
    rows = [(1, text, "b"), (2, "x " * 2000, "a")]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    longs = sorted((r.text for r in got if r.doc_id == 1), key=len)
    target = 1.5 * 22_000 - 2 * 2000
    assert abs(sum(len(words_of(t)) for t in longs) - target) <= 8
    assert longs[1] == text and text.startswith(longs[0]) and len(longs) == 2


def test_pipeline_runs_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
