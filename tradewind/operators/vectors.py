"""Vector collections: upsert, exact cosine search, context packing, bulk embedding."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain, pairwise
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.ranking import bounded_result, first_per_group
from tradewind.sources.tables import materialize

# Corpus rows that a task holds at a time, and bytes of its tile of scores.
PART_ROWS = 50_000
TILE_BYTES = 32 * 1024 * 1024
SCORE_PLACES = 6
# Corpus rows that cells are made around, the most parts of a cell, and what rounding of scores and
# distances may hide.
PIVOTS = 64
PARTS = 1 << 32
SLACK = 4e-6

# The functions below travel to the tasks as they are; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def upsert_vectors(
    base: DataFrame,
    delta: DataFrame,
    key: str = "id",
    vector: str = "embedding",
    dim: int | None = None,
    version: str | None = None,
) -> DataFrame:
    """Insert or replace by key. ``dim`` fails the job on vectors of another length.

    A key given more than once in ``delta`` keeps the row of the highest ``version``; the
    copies are reduced on the map side. Without ``version`` the keys must be distinct."""
    if version is not None:
        others = [c for c in delta.columns if c != key]
        latest = delta.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("_row"))
        delta = latest.select(key, "_row.*")
    if dim is not None:
        wrong = F.size(vector) != dim
        message = F.format_string(f"vector of %s numbers, expected {dim}", F.size(vector))
        checked = F.when(wrong, F.raise_error(message)).otherwise(F.col(vector))
        delta = delta.withColumn(vector, checked)
    kept = base.join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.select(*base.columns))


def store_vectors(
    delta: DataFrame, name: str, dim: int, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """Upsert into a stored collection; the first call creates it with its fixed ``dim``.

    A collection is a view over the table of its latest content. New content is written to a
    table of its own, then the view is pointed at it. The content before stays until the
    next call, so a reader that has it open is not disturbed."""
    spark = delta.sparkSession
    base = delta.limit(0)
    if spark.catalog.tableExists(name):
        base = spark.table(name)
        stored = base.select(F.size(vector).alias("dim")).first()
        if stored is not None and stored.dim != dim:
            raise ValueError(f"{name} holds vectors of {stored.dim} numbers, not {dim}")
    return materialize(upsert_vectors(base, delta, key, vector, dim), name)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero and is like nothing."""
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)


def _best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, equal ones by id."""
    if scores.size > k:
        kth = np.partition(scores, scores.size - k)[scores.size - k]
        rows = np.flatnonzero(scores >= kth)
    else:
        rows = np.arange(scores.size)
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


class _PartSearch:
    """Searches one part of the corpus, whose rows come first, for the questions that follow.
    Questions are scored in tiles of bounded size, and each gives its k best rows of the part."""

    def __init__(self, k: int, names: list[str]):
        self.k, self.names = k, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, corpus = None, [], None
        for batch in batches:
            parts = np.asarray(batch.column("_part"))
            asks = np.asarray(batch.column("_asks"))
            edges = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in pairwise([0, *edges.tolist(), len(parts)]):
                if high == low:
                    continue
                piece = batch.slice(low, high - low)
                if parts[low] != part:
                    part, held, corpus = parts[low], [], None
                if not asks[low]:
                    held.append(piece)
                    continue
                if corpus is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    corpus = (rows, _matrix(rows.column("_vector")), np.asarray(rows.column("_key")))
                    held = []
                if corpus is not None:
                    yield from self.search(piece, *corpus)

    def search(self, questions, rows, matrix, ids) -> Iterator[pa.RecordBatch]:
        asked = _matrix(questions.column("_vector"))
        if asked.shape[1] != matrix.shape[1]:
            raise ValueError(f"corpus vectors do not have the {asked.shape[1]} numbers of the query")
        tile = max(1, TILE_BYTES // (8 * len(matrix)))
        for low in range(0, len(asked), tile):
            scores = np.round(asked[low : low + tile] @ matrix.T, SCORE_PLACES)
            best = [_best_rows(line, ids, self.k) for line in scores]
            found = np.concatenate(best)
            question = np.repeat(np.arange(len(best)), [len(b) for b in best])
            taken = rows.select(self.names).take(pa.array(found))
            yield pa.RecordBatch.from_arrays(
                [
                    questions.column("_query").take(pa.array(question + low)),
                    pa.array(scores[question, found]),
                    *taken.columns,
                ],
                ["query_id", "score", *self.names],
            )


def _scan_search(questions: Sequence[Any], numbers: np.ndarray, k: int, names: list[str]):
    """A function for the tasks: every batch of the corpus answers with k rows per question."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _PartSearch(k, names)
        vectors = pa.array(numbers.tolist(), pa.list_(pa.float64()))
        asked = pa.RecordBatch.from_arrays([vectors, pa.array(questions, pa.string())], ["_vector", "_query"])
        for batch in batches:
            if batch.num_rows and asked.num_rows:
                matrix = _matrix(batch.column("_vector"))
                yield from part.search(asked, batch, matrix, np.asarray(batch.column("_key")))

    return search


def _distances(vectors: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the directions of vectors to the pivots, and which vectors have none."""
    unit = _matrix(vectors)
    if len(unit) and unit.shape[1] != pivots.shape[1]:
        raise ValueError(f"corpus vectors do not have the {unit.shape[1]} numbers of the query")
    products = unit @ pivots.T if len(unit) else np.zeros((0, len(pivots)))
    return np.sqrt(np.maximum(2 - 2 * products, 0)), ~unit.any(axis=1) if len(unit) else np.zeros(0, bool)


def _near_pivot(pivots: np.ndarray):
    """A function for the tasks: adds the nearest pivot and the distance to it. Vectors of no
    direction are a cell of their own, -1."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances, nowhere = _distances(batch.column("_vector"), pivots)
            cell = np.where(nowhere, -1, distances.argmin(axis=1))
            yield batch.append_column("_cell", pa.array(cell.astype(np.int32))).append_column(
                "_far", pa.array(np.where(nowhere, 0.0, distances.min(axis=1, initial=np.inf)))
            )

    return near


def _to_pivots(pivots: np.ndarray):
    """A function for the tasks: adds the distances to all pivots, or null where there is no
    direction."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances, nowhere = _distances(batch.column("_vector"), pivots)
            told = [None if no else row.tolist() for row, no in zip(distances, nowhere, strict=True)]
            yield batch.append_column("_fars", pa.array(told, pa.list_(pa.float64())))

    return measure


def question_grid(
    rows: DataFrame, asks: DataFrame, k: int, part_rows: int = PART_ROWS, pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame]:
    """The corpus (_key, _vector, ...) with its ``_part``, and the questions (_query, _vector), each once
    per part that may hold one of its ``k`` nearest rows.

    A cell holds the rows nearest to one of the pivots, which are corpus rows; large cells are
    dealt into parts of about ``part_rows`` rows. By the triangle inequality the rows of a cell are no
    nearer to a question than its distance to the pivot less the cell's radius (or the nearest row's
    distance less that), and k rows of a cell are no farther than that distance and the one of the
    cell's k-th row. So a cell whose best possible score is below the k-th score that some other cell
    is sure to give is left out; results are the same as without."""
    order = F.xxhash64("_key")
    sample = bounded_result(rows.select("_vector").orderBy(order, "_key"), pivots).rows
    chosen = _matrix(pa.array([r._vector for r in sample], pa.list_(pa.float64())))
    chosen = np.unique(chosen[chosen.any(axis=1)], axis=0) if len(chosen) else chosen
    dims = chosen.shape[1]
    if not len(chosen):
        # Nothing to be near to: a corpus without a direction is one cell.
        dims = len(sample[0]._vector) if sample else 0
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    if len(chosen):
        placed = rows.mapInArrow(_near_pivot(chosen), f"{kinds}, _cell int, _far double")
        ask_kinds = ", ".join(f"`{name}` {kind}" for name, kind in asks.dtypes)
        measured = asks.mapInArrow(_to_pivots(chosen), f"{ask_kinds}, _fars array<double>")
    else:
        placed = rows.withColumns({"_cell": F.lit(-1), "_far": F.lit(0.0)})
        wrong = F.raise_error(F.lit("corpus vectors do not have the numbers of the query"))
        checked = F.when(F.size("_vector") != dims, wrong) if sample else F.lit(None)
        measured = asks.withColumn("_fars", checked.cast("array<double>"))

    sizes = placed.groupBy("_cell").agg(
        F.count("*").alias("rows"), F.min("_far").alias("low"), F.max("_far").alias("high")
    )
    nearest = first_per_group(placed.select("_cell", "_far"), ["_cell"], [F.col("_far")], k)
    sure = nearest.groupBy("_cell").agg(F.when(F.count("*") == k, F.max("_far")).alias("sure"))
    salts = F.ceil(F.col("rows") / part_rows).cast("bigint")
    cells = sizes.join(sure, "_cell").withColumn("salts", salts)
    part = F.col("_cell").cast("bigint") * PARTS
    held = (
        placed.join(F.broadcast(cells.select("_cell", "salts")), "_cell")
        .withColumn("_part", part + F.pmod(F.xxhash64("_key", F.lit(1)), F.col("salts")))
        .drop("_cell", "_far", "salts")
    )

    table = cells.agg(F.collect_list(F.struct("_cell", "salts", "low", "high", "sure")).alias("cells")).scalar()

    def score(distance: Column) -> Column:
        return 1 - distance * distance / 2

    def far(cell: Column) -> Column:
        return F.get("_fars", cell["_cell"])

    def may_hold(cell: Column) -> Column:
        gap = F.greatest(far(cell) - cell["high"], cell["low"] - far(cell), F.lit(0.0))
        # A row of no direction scores 0.
        best = F.when(cell["_cell"] < 0, F.lit(0.0)).otherwise(score(gap))
        return F.col("_fars").isNull() | F.col("_sure").isNull() | (best >= F.col("_sure") - SLACK)

    certain = F.array_max(
        F.transform("_cells", lambda c: F.when(c["_cell"] >= 0, score(F.least(far(c) + c["sure"], F.lit(2.0)))))
    )
    met = measured.withColumn("_cells", table).withColumn("_sure", certain)
    parts = F.flatten(
        F.transform(
            F.filter("_cells", may_hold),
            lambda c: F.transform(
                F.sequence(F.lit(0).cast("bigint"), c["salts"] - 1), lambda i: c["_cell"].cast("bigint") * PARTS + i
            ),
        )
    )
    return held, met.withColumn("_part", F.explode(parts)).drop("_cells", "_sure", "_fars")


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame | Mapping[str, Sequence[float]],
    k: int = 5,
    where: Mapping[str, Any] | None = None,
    min_score: float | None = None,
    key: str = "id",
    vector: str = "embedding",
    payload: Sequence[str] = (),
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The ``k`` nearest corpus rows per query by cosine, exact, with payload.

    ``queries`` is a table (query_id, vector) of any size, or a mapping of few questions. Few
    questions travel to the corpus: each batch of it answers with k rows per question, and nothing
    else is shuffled. A table of questions meets the corpus part by part in a grid (see
    :func:`question_grid`): a question goes to the parts that may hold one of its rows, each answers
    with k rows per question, and the k best of all are kept, so the product of both tables is never a
    table. A task holds its part, a batch of questions and a tile of scores. ``where`` keeps rows
    whose payload equals the given values, before scoring and as a condition the scan can use. Rows
    and questions without a vector have no score; no questions give no rows."""
    for name, value in (where or {}).items():
        corpus = corpus.where(F.col(name) == F.lit(value))
    names = [key, *payload]
    kinds = dict(corpus.dtypes)
    rows = corpus.where(F.col(vector).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("_vector"), F.col(key).alias("_key"), *names
    )
    asks_kind = "string" if not isinstance(queries, DataFrame) else dict(queries.dtypes)["query_id"]
    schema = ", ".join([
        f"query_id {asks_kind}", "score double", *[f"`{name}` {kinds[name]}" for name in names]
    ])
    if not isinstance(queries, DataFrame):
        asked = np.array([[float(x) for x in numbers] for numbers in queries.values()])
        found = rows.mapInArrow(_scan_search(list(queries), asked, k, names), schema)
    else:
        asks = queries.where("vector IS NOT NULL").select(
            F.col("query_id").alias("_query"), F.col("vector").cast("array<double>").alias("_vector")
        )
        held, met = question_grid(rows, asks, k, part_rows)
        nothing = {c: F.lit(None).cast(kind) for c, kind in held.dtypes if c not in ("_part", "_vector")}
        columns = ["_part", "_asks", "_vector", "_key", "_query", *names]
        held = held.withColumns({"_asks": F.lit(False), "_query": F.lit(None).cast(asks_kind)})
        met = met.withColumns({**nothing, "_asks": F.lit(True)})
        dealt = held.select(*columns).unionByName(met.select(*columns))
        found = (
            dealt.repartition("_part")
            .sortWithinPartitions("_part", "_asks")
            .mapInArrow(_PartSearch(k, names), schema)
        )
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return first_per_group(found, ["query_id"], [F.desc("score"), F.col(key)], k)


def pack_context(hits: DataFrame, document: str = "document") -> DataFrame:
    """One text per query: scored blocks, best first. A group holds the k hits of a query."""
    block = F.concat(
        F.format_string("[score=%.3f]\n", "score"), F.coalesce(F.col(document), F.lit(""))
    )
    blocks = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(blocks["block"], "\n\n").alias("context"))


def index_size(spark: SparkSession, table: str) -> DataFrame:
    """One row with the number of vectors; 0 for a collection that does not exist."""
    if not spark.catalog.tableExists(table):
        return spark.range(1).select(F.lit(0).cast("bigint").alias("n_vectors"))
    return spark.table(table).agg(F.count("*").alias("n_vectors"))


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of ``dim`` numbers. Instances travel to the tasks."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]] | np.ndarray: ...


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:8], "big")


class HashingProvider:
    """Offline default: counts each word in one of ``dim`` places, then scales to length 1.
    Words are numbered for the whole batch, and only distinct ones are hashed."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [re.findall(r"\w+", text.lower()) for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(found) for found in words])
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
        places = np.array([_token_hash(w) % self.dim for w in distinct], dtype=np.int64)
        counts = np.bincount(rows * self.dim + places[codes], minlength=len(texts) * self.dim)
        out = counts.astype(np.float64).reshape(len(texts), self.dim)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)


def embed(
    df: DataFrame, text: str, provider: EmbeddingProvider, name: str = "embedding"
) -> DataFrame:
    """Add the vector of each whole text. The provider sees one Arrow batch at a time and is
    sent to a task once."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.asarray(provider.embed(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(found))

    return df.withColumn(name, vectors(F.col(text)))


def embed_words(
    df: DataFrame, keys: Sequence[str], text: str, dim: int = 384, name: str = "embedding"
) -> DataFrame:
    """The vectors of :class:`HashingProvider` in built-in functions: ``keys`` and the vector of
    the whole text. Each word has a place by its MD5; places are counted per row on the map side,
    so a row sends one number per place, and the counts are scaled to length 1. Rows with the same
    keys are one text; a text without words is a zero vector."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # 64 bits of the digest are read as a signed number, which is 2^64 less where it is negative.
    below = F.when(F.col("_number") < 0, (1 << 64) % dim).otherwise(0)
    placed = (
        df.select(*keys, F.explode_outer(words).alias("_word"))
        .select(*keys, F.conv(F.substring(F.md5("_word"), 1, 16), 16, -10).cast("bigint").alias("_number"))
        .select(*keys, F.pmod(F.col("_number") % dim + below, F.lit(dim)).cast("int").alias("_place"))
    )
    counts = placed.groupBy(*keys, "_place").agg(F.count("_place").cast("double").alias("_count"))
    filled = F.filter(F.collect_list(F.struct("_place", "_count")), lambda x: x["_place"].isNotNull())
    rows = counts.groupBy(*keys).agg(
        F.map_from_entries(filled).alias("_counts"),
        F.sqrt(F.sum(F.col("_count") * F.col("_count"))).alias("_length"),
    )
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda p: F.coalesce(F.try_divide(F.try_element_at("_counts", p), F.col("_length")), F.lit(0.0)),
    )
    return rows.select(*keys, vector.alias(name))


def retrieve(
    index: DataFrame,
    questions: DataFrame | Sequence[str],
    provider: EmbeddingProvider,
    k: int = 5,
    **options,
) -> DataFrame:
    """The ``k`` nearest documents of an index per question, best first; ``options`` as of
    :func:`vector_topk`. ``questions`` are texts or a table with a text column ``query_id``; they
    are embedded in the tasks. An empty index gives no rows."""
    if not isinstance(questions, DataFrame):
        rows = [(question,) for question in questions]
        questions = index.sparkSession.createDataFrame(rows, "query_id string")
    asked = embed(questions.select("query_id").distinct(), "query_id", provider, "vector")
    return vector_topk(index, asked, k, **options)
