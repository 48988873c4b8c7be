"""Vector search against plain loops, upsert and context packing."""

import random

import numpy as np
import pytest

from tradewind.operators import vectors


def corpus(spark, n=500, dim=8, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], i % 3) for i in range(n)]
    # A third of the collection are copies of one vector, and one has no direction.
    rows += [(n + i, [0.5] * dim, 0) for i in range(n // 2)]
    rows += [(10 * n, [0.0] * dim, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    return rows, df.repartition(7)


def best(rows, query, k, keep=lambda r: True):
    q = np.array(query, dtype=float)
    scored = []
    for row in rows:
        if keep(row):
            v = np.array(row[1], dtype=np.float32).astype(float)
            length = np.linalg.norm(v) * np.linalg.norm(q)
            score = round(float(v @ q / length), 6) if length else 0.0
            scored.append((-score, row[0]))
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("part_rows", [vectors.PART_ROWS, 90])
@pytest.mark.parametrize("as_table", [True, False])
def test_topk_is_exact(spark, part_rows, as_table):
    rows, df = corpus(spark)
    rng = random.Random(5)
    queries = {f"q{i}": [rng.uniform(-1, 1) for _ in range(8)] for i in range(3)}
    queries["copies"] = [1.0] * 8
    got = {}
    asked = queries
    if as_table:
        asked = spark.createDataFrame(list(queries.items()), "query_id string, vector array<float>")
    found = vectors.vector_topk(df, asked, 6, payload=["label"], part_rows=part_rows)
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got.keys() == queries.keys()
    for name, query in queries.items():
        wanted = best(rows, query, 6)
        assert [i for i, _ in got[name]] == [i for i, _ in wanted]
        assert np.allclose([s for _, s in got[name]], [s for _, s in wanted], atol=2e-6)


def test_filter_and_threshold(spark):
    rows, df = corpus(spark)
    query = {"q": [1.0, 0, 0, 0, 0, 0, 0, 0]}
    found = vectors.vector_topk(df, query, 5, where={"label": 2}, min_score=0.5).collect()
    wanted = [w for w in best(rows, query["q"], 5, lambda r: r[2] == 2) if w[1] >= 0.5]
    assert sorted(r.id for r in found) == sorted(i for i, _ in wanted)


def test_wrong_length_fails(spark):
    _, df = corpus(spark)
    with pytest.raises(Exception, match="numbers of the query"):
        vectors.vector_topk(df, {"q": [1.0, 2.0]}, 1).collect()


def test_no_questions_give_no_rows(spark):
    _, df = corpus(spark)
    assert vectors.vector_topk(df, {}, 3).count() == 0
    asked = spark.createDataFrame([("q", None)], "query_id string, vector array<float>")
    assert vectors.vector_topk(df, asked, 3).count() == 0
    assert vectors.vector_topk(df.limit(0), {"q": [1.0] * 8}, 3).count() == 0


def test_scores_are_taken_in_tiles(spark, monkeypatch):
    rows, df = corpus(spark)
    queries = {f"q{i:03d}": [float((i * j) % 7 - 3) for j in range(8)] for i in range(1, 40)}
    search = vectors._PartSearch(2, ["id"])
    whole = {tuple(r) for r in vectors.vector_topk(df, queries, 2).collect()}
    monkeypatch.setattr(vectors, "TILE_BYTES", 1)
    small = pytest.importorskip("pyarrow").RecordBatch.from_pydict({
        "_part": [0] * 4, "_asks": [False, False, True, True],
        "_vector": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], [0.0, 2.0]],
        "_key": [5, 6, None, None], "_query": [None, None, "a", "b"], "id": [5, 6, None, None],
    })
    out = [b.to_pydict() for b in search(iter([small]))]
    assert [(o["query_id"], o["id"]) for o in out] == [(["a", "a"], [5, 6]), (["b", "b"], [6, 5])]
    assert len(whole) == 39 * 2


def test_default_embedding_equals_the_provider(spark):
    texts = [(1, "Ação ação b, c_d 12"), (2, None), (3, ""), (4, "... "), (5, "x " * 500 + "y")]
    df = spark.createDataFrame(texts, "id int, t string")
    rows = {r.id: r.embedding for r in vectors.embed_words(df, ["id"], "t", 16).collect()}
    wanted = vectors.HashingProvider(16).embed([t or "" for _, t in texts])
    assert sorted(rows) == [1, 2, 3, 4, 5]
    for (i, _), vector in zip(texts, wanted, strict=True):
        assert np.allclose(rows[i], vector)


def test_upsert(spark):
    base = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "id int, embedding array<float>, p string")
    delta = spark.createDataFrame([(2, [9.0], "c"), (3, [3.0], "d")], "id int, embedding array<float>, p string")
    rows = sorted((r.id, r.embedding[0], r.p) for r in vectors.upsert_vectors(base, delta, dim=1).collect())
    assert rows == [(1, 1.0, "a"), (2, 9.0, "c"), (3, 3.0, "d")]
    with pytest.raises(Exception, match="expected 2"):
        vectors.upsert_vectors(base, delta, dim=2).collect()


def test_stored_collection(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS vectors")

    def rows(*cells):
        return spark.createDataFrame(list(cells), "id int, embedding array<float>, p string")

    def stored():
        return sorted((r.id, r.p) for r in spark.table("vectors.points").collect())

    vectors.store_vectors(rows((1, [1.0], "a"), (2, [2.0], "b")), "vectors.points", 1)
    vectors.store_vectors(rows((2, [3.0], "c"), (3, [3.0], "d")), "vectors.points", 1)
    assert stored() == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError, match="1 numbers, not 2"):
        vectors.store_vectors(rows((4, [1.0, 2.0], "e")), "vectors.points", 2)
    with pytest.raises(Exception, match="expected 1"):
        vectors.store_vectors(rows((4, [1.0, 2.0], "e")), "vectors.points", 1)

    open_reader = spark.table("vectors.points")
    vectors.store_vectors(rows((9, [9.0], "z")), "vectors.points", 1)
    assert stored() == [(1, "a"), (2, "c"), (3, "d"), (9, "z")]
    assert sorted((r.id, r.p) for r in open_reader.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    vectors.store_vectors(rows((9, [9.0], "y")), "vectors.points", 1)
    names = [t.name for t in spark.catalog.listTables("vectors") if not t.isTemporary]
    assert len([n for n in names if n.startswith("points__")]) == 2
    assert "points" in names


def test_context(spark):
    hits = spark.createDataFrame(
        [("q", 2, 0.25, "two"), ("q", 1, 0.5, "one"), ("q", 3, 0.125, None)],
        "query_id string, rank int, score double, document string",
    )
    assert vectors.pack_context(hits).collect()[0].context == (
        "[score=0.500]\none\n\n[score=0.250]\ntwo\n\n[score=0.125]\n")


def test_index_size(spark):
    assert vectors.index_size(spark, "marts.no_such_index").collect()[0].n_vectors == 0


def test_hashing_provider():
    provider = vectors.HashingProvider(16)
    rows = provider.embed(["", "Ação ação b", "b"])
    assert rows.shape == (3, 16) and not rows[0].any()
    assert np.isclose(np.linalg.norm(rows[1]), 1)
    assert np.isclose(rows[1].max(), 2 / np.sqrt(5)) or np.isclose(rows[1].max(), 1)


def test_embedding_of_missing_text(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    rows = {r.id: r.embedding for r in vectors.embed(df, "t", vectors.HashingProvider(4)).collect()}
    assert rows[1] == [0.0] * 4 and sum(rows[2]) == 1.0


def clustered(spark, dim=12, centres=25, size=60, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = [(c * size + i, (middle[c] + 0.02 * rng.normal(size=dim)).tolist(), c) for c in range(centres) for i in range(size)]
    rows += [(90_000 + i, [0.0] * dim, -1) for i in range(7)] + [(91_000 + i, middle[3].tolist(), 3) for i in range(40)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(6), middle


@pytest.mark.parametrize("k", [1, 4, 100])
def test_grid_leaves_out_parts_and_no_row(spark, k):
    rows, df, middle = clustered(spark)
    rng = np.random.default_rng(8)
    asked = {f"q{i}": (middle[i % 25] + 0.05 * rng.normal(size=12)).tolist() for i in range(40)}
    asked |= {"far": (-middle[0]).tolist(), "copies": middle[3].tolist(), "nowhere": [0.0] * 12}
    table = spark.createDataFrame(list(asked.items()), "query_id string, vector array<double>")
    got = {}
    for r in vectors.vector_topk(df, table, k, part_rows=20).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {name: [i for i, _ in best(rows, vector, k)] for name, vector in asked.items()}

    source = df.selectExpr("cast(embedding AS array<double>) AS _vector", "id AS _key", "id")
    asks = table.selectExpr("query_id AS _query", "vector AS _vector")
    held, met = vectors.question_grid(source, asks, k, part_rows=20)
    assert held.count() == len(rows)
    parts = held.select("_part").distinct().count()
    pairs = met.count()
    assert parts > 60 and met.distinct().count() == pairs
    if k <= 4:
        assert pairs < 0.35 * parts * len(asked)


def test_grid_over_odd_corpora(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    for rows in ([(1, [0.0, 0.0]), (2, [0.0, 0.0])], [(5, [1.0, 1.0])], []):
        df = spark.createDataFrame(rows, "id long, embedding array<double>")
        found = [r.id for r in vectors.vector_topk(df, asked, 2).orderBy("rank").collect()]
        assert found == [i for i, _ in rows]
    other = spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="numbers of the query"):
        vectors.vector_topk(other, asked, 2).collect()


def test_few_questions_shuffle_nothing_of_the_corpus(spark):
    _, df = corpus(spark)
    plan = vectors.vector_topk(df, {"q": [1.0] * 8}, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("hashpartitioning(query_id") < plan.index("MapInArrow")
    assert plan.count("hashpartitioning") == 1
