"""Exact duplicates and mixing: missing ids, repeated rows, plans without Python, the quotas."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tradewind.llm.exact_dedup import exact_dedup
from tradewind.llm.mixing import BLOCK, deal_blocks, mix, shard_quotas, source_targets, word_count


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_and_other_digests_give_the_same(spark):
    texts = [("a b", i) for i in range(50)] + [(f"t {i % 30}", 100 + i) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    rows = [sorted(exact_dedup(docs, heavy=h, tracked=t).collect()) for h, t in ((1, 8), (64, 64))]
    assert rows[0] == rows[1]
    assert Counter(r.group_size for r in rows[0]) == {50: 50, 3: 90}
    assert sum(r.kept for r in rows[0]) == 31


def test_longest_text_stays_then_least_id(spark):
    docs = spark.createDataFrame(
        [(5, "ab"), (4, "a b"), (3, "a b"), (9, "a  b"), (None, "a  b"), (7, None), (8, " ")],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert {k: r.keep_id for k, r in rows.items()} == {5: 9, 4: 9, 3: 9, 9: 9, None: 9, 7: 8, 8: 8}
    assert rows[9].kept and not rows[None].kept and rows[8].kept


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "same")] * 4, "doc_id long, text string")
    assert [r.kept for r in exact_dedup(docs).collect()].count(True) == 1


def test_native_plans_have_no_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (exact_dedup(docs), mix(docs)):
        assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)


def sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda s: (-votes[s] / (2 * won[s] + 1), s))
        won[best] += 1
    return won


@pytest.mark.parametrize("shards", [1, 7])
def test_quotas_are_those_of_the_highest_quotients(spark, shards):
    sizes = {f"s{i:02d}": (i * i * 37) % 900 + 1 for i in range(23)}
    targets = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    votes = {r.source: Fraction(r.target) for r in targets.collect()}
    got = shard_quotas(targets, block=3, shards=shards).collect()
    seats = int(sum(float(v) for v in votes.values()) / 3 + 0.5)
    for shard in range(shards):
        so_far = Counter()
        for r in got:
            if r.shard <= shard:
                so_far[r.source] += r.quota
        assert {s: n for s, n in so_far.items() if n} == {
            s: n for s, n in sainte_lague(votes, seats * (shard + 1) // shards).items() if n
        }
    assert all(r.quota >= 0 for r in got)


def test_targets_stop_at_twice_the_size(spark):
    sizes = [("a", 1), ("b", 1000), ("c", 0), (None, 10)]
    rows = {r.source: r.target for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert rows["a"] == 2 and rows["c"] == 0 and rows[None] == 20
    assert abs(sum(rows.values()) - 1.5 * 1011) < 1e-9


def test_taken_words_meet_their_targets(spark, folder):
    rows = mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target, r.source_size] += r.taken
    for (target, _), words in taken.items():
        assert abs(words - target) <= BLOCK


def test_repeated_rows_and_missing_ids_count_each(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 3 + [(None, "d e", None), (None, None, None)], "doc_id long, text string, source string")
    rows = mix(docs, carry=("text",)).collect()
    assert len(rows) == 5 and sum(r.size for r in rows) == 11
    assert sorted({r.text or "" for r in rows}) == ["", "a b c", "d e"]


@pytest.mark.parametrize("table", ["folder", "messy"])
def test_blocks_go_to_the_shards_by_their_quotas(spark, table, request):
    docs = spark.read.parquet(f"{request.getfixturevalue(table)}/documents.parquet")
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    targets = source_targets(sizes)
    most = {r.source: 2 * r.source_size for r in targets.collect()}
    quotas = {(r.source, r.shard): r.quota for r in shard_quotas(targets, shards=5).collect() if r.quota}
    rows = deal_blocks(docs, shards=5).collect()
    shard_of, words = {}, Counter()
    for r in rows:
        assert shard_of.setdefault((r.source, r.block), r.shard) == r.shard
        words[r.source, r.block] += r.words
    short = {k for k, n in words.items() if n != BLOCK}
    assert all(sum(n for (s, _), n in words.items() if s == k[0]) == most[k[0]] for k in short)
    got = Counter((s, shard) for (s, _), shard in shard_of.items())
    # A source taken twice whole may end before its quota.
    full = {s for s in most if sum(n for (k, _), n in words.items() if k == s) == most[s]}
    assert {k: n for k, n in got.items() if k[0] not in full} == {k: n for k, n in quotas.items() if k[0] not in full}
    assert all(got[k] <= n for k, n in quotas.items()) and got.keys() <= quotas.keys()
    taken, parts = {r.doc_id: r.taken for r in mix(docs).collect() if r.taken}, Counter()
    for r in rows:
        parts[r.doc_id] += r.words
    assert parts == taken
    again = {(r.source, r.block): r.shard for r in deal_blocks(docs, shards=5, seed=18).collect()}
    assert again.keys() == shard_of.keys() and again != shard_of


def test_blocks_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 30 + [(None, "d e", None), (None, None, None)], "doc_id long, text string, source string")
    rows = deal_blocks(docs, block=4, shards=3).collect()
    assert sum(r.words for r in rows) == sum(r.taken for r in mix(docs, block=4, shards=3).collect())
    assert all(0 <= r.first and r.first + r.words <= 3 for r in rows) and {r.shard for r in rows} == {0, 1, 2}
