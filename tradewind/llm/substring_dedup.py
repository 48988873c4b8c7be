"""Passages that repeat between documents, by windows of words of doubling length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.bitmap import BITS, bitmap_of, members
from tradewind.llm.words import (
    OF_WORDS,
    blocks,
    signed,
    span_hashes,
    text_column,
    window_hashes,
    word_spans,
)

# Words of a window.
WINDOW = 13
# Windows that a task gathers before it settles those of its own and passes the rest on.
GATHER = 800_000
NO_ID = (1 << 63) - 1


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id (a missing one counts as the largest), a mark of the text, and the text itself. Rows
    with the same id and text are one document."""
    return docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.hash(text_column).alias("mark"),
        F.col(text_column).alias("text"),
    )


def _anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` places the first place with the least hash."""
    n = max(len(hashes) - span + 1, 0)
    place = np.zeros(n, np.int64)
    least = hashes[:n].copy()
    for step in range(1, span):
        other = hashes[step : step + n]
        less = other < least
        least[less] = other[less]
        place[less] = step
    return place + np.arange(n)


def _windows(buf, bounds, window: int):
    """Word hashes, the row of each word, and for every window of a row its first word and the
    place of its anchor, the half window with the least hash. Equal windows have equal anchors."""
    half = (window + 1) // 2
    starts, ends, row = word_spans(buf, bounds)
    words = span_hashes(buf, starts, ends)
    halves = window_hashes(words, half)
    first = np.arange(max(len(words) - window + 1, 0))
    whole = row[first] == row[first + window - 1] if len(first) else first.astype(bool)
    anchor = _anchors(halves, window - half + 1)
    return words, row, halves, first[whole], anchor[whole]


def _half_windows(batches, window: int, gather: int) -> Iterator[pa.RecordBatch]:
    """Hashes of anchors, each once per gathered part of a task, with 1, or 2 if several documents
    of the part have it. No document is in two parts, so what adds up to more than 1 repeats."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settled():
        hashes = np.concatenate([h for h, _ in held])
        ids = np.concatenate([i for _, i in held])
        held.clear()
        order = np.argsort(hashes)
        hashes, ids = hashes[order], ids[order]
        at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        several = np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)
        yield from pa.Table.from_arrays(
            [signed(hashes[at]), pa.array(several.astype(np.int64) + 1)], ["hash", "documents"]
        ).to_batches(max_chunksize=100_000)

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for low, high, buf, bounds in blocks(text_column(batch, "text")):
            _, row, halves, _, anchor = _windows(buf, bounds, window)
            if not len(anchor):
                continue
            places = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])]
            held.append((halves[places], ids[low:high][row[places]]))
            size += len(places)
            if size >= gather:
                yield from settled()
                size = 0
    if held:
        yield from settled()


def _whole_windows(batches, window: int, gather: int, repeated: bytes) -> Iterator[pa.RecordBatch]:
    """Windows with a repeated anchor. Of equal windows of a task only those of the least id are
    passed on, with their place; the others repeat for certain, and their places are packed into
    one row per document."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def out(a, b, ids, marks, places, packed):
        # Mark and place share a number, which leaves fewer zeros to shuffle.
        table = pa.Table.from_arrays(
            [
                signed(a),
                pa.array(b.astype(np.uint32).view(np.int32)),
                pa.array(ids),
                pa.array((marks.astype(np.int64) << 32) | places.astype(np.int64)),
                packed,
            ],
            ["a", "b", "id", "at", "packed"],
        )
        return table.to_batches(max_chunksize=100_000)

    def settled():
        a, b, ids, marks, places = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((ids, b, a))
        a, b, ids, marks, places = a[order], b[order], ids[order], marks[order], places[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        first = np.flatnonzero(ids == least)
        rest = np.flatnonzero(ids != least)
        # Rows of a document together: what they share is compressed away in the shuffle.
        first = first[np.lexsort((places[first], marks[first], ids[first]))]
        yield from out(a[first], b[first], ids[first], marks[first], places[first], pa.nulls(len(first), pa.binary()))
        del a, b
        ids, marks, places = ids[rest], marks[rest], places[rest]
        if len(ids):
            order = np.lexsort((marks, ids))
            ids, marks, places = ids[order], marks[order], places[order].astype("<i4")
            at = np.flatnonzero(
                np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
            )
            packed = pa.array([x.tobytes() for x in np.split(places, at[1:])], pa.binary())
            ids, marks = ids[at], marks[at]
            # A key of their own: they meet no other row.
            key = span_hashes(
                ids.view(np.uint8), np.arange(len(ids)) * 8, np.arange(1, len(ids) + 1) * 8
            )
            yield from out(key, key, ids, marks, np.zeros(len(ids), np.int32), packed)

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        marks = batch.column("mark").to_numpy(zero_copy_only=False)
        for low, high, buf, bounds in blocks(text_column(batch, "text")):
            words, row, halves, first, anchor = _windows(buf, bounds, window)
            if not len(first):
                continue
            suspect = members(repeated, halves)[anchor]
            first = first[suspect]
            if not len(first):
                continue
            rows = row[first]
            begins = np.searchsorted(row, np.arange(high - low))
            others = span_hashes(buf, *word_spans(buf, bounds)[:2], seed=1)
            held.append((
                window_hashes(words, window, OF_WORDS[0])[first],
                window_hashes(others, window, OF_WORDS[1])[first],
                ids[low:high][rows],
                marks[low:high][rows],
                (first - begins[rows]).astype(np.int32),
            ))
            size += len(first)
            if size >= gather:
                yield from settled()
                size = 0
    if held:
        yield from settled()


def repeated_windows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    bits: int = BITS,
    gather: int = GATHER,
) -> DataFrame:
    """The places where a window of ``window`` words starts whose words also start in a document
    with a smaller id: (id, mark, places, packed), one row per document that has any.

    Level by level: the half windows are counted first, at one anchor per window (the half with
    the least hash, which equal windows share), and those of one document alone are left out. Only windows with a repeated half are extended to the whole length and compared
    by 96 bits, and at that length none is left to extend. Every task first settles the windows
    of its own rows, so what many documents share is shuffled once per task and not per document.
    The repeated halves reach the tasks as a bitmap of ``bits`` bits, whose false members only
    cost time."""
    keyed = _keyed(docs, id_column, text_column)

    halves = keyed.select("id", "text").mapInArrow(
        lambda batches: _half_windows(batches, window, gather),
        "hash bigint, documents bigint",
    )
    repeated = halves.groupBy("hash").agg(F.sum("documents").alias("documents")).where("documents > 1")
    bitmap = bitmap_of(repeated, "hash", bits)
    whole = keyed.mapInArrow(
        lambda batches: _whole_windows(batches, window, gather, bitmap.value),
        "a bigint, b int, id bigint, at bigint, packed binary",
    )
    of_window = Window.partitionBy("a", "b")
    later = whole.withColumn("least", F.min("id").over(of_window)).where(
        "packed IS NOT NULL OR id > least"
    )
    place = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return later.groupBy("id", F.shiftright("at", 32).cast("int").alias("mark")).agg(
        F.collect_list(F.when(F.col("packed").isNull(), place)).alias("places"),
        F.collect_list("packed").alias("packed"),
    )


def _without(batches, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, digests, texts = [], [], [], []
        columns = [batch.column(c) for c in ("text", "places", "packed")]
        for text, places, packed in zip(*columns, strict=True):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            if places.is_valid:
                starts = np.concatenate([
                    places.values.to_numpy(zero_copy_only=False).astype(np.int64),
                    *(np.frombuffer(x, "<i4").astype(np.int64) for x in packed.as_py()),
                ])
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                kept = np.cumsum(change)[:-1] == 0
                words = list(compress(words, kept.tolist()))
            joined = b" ".join(words)
            removed.append(counts[-1] - len(words))
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            ["id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    bits: int = BITS,
    gather: int = GATHER,
) -> DataFrame:
    """Every document without the words that a window covers whose words also start in a document
    with a smaller id; the first document with a passage keeps it.

    Words are runs of anything but space and tab to carriage return, unchanged. A null or blank
    text has no words, a text of fewer words than a window keeps all of its own. A passage that
    repeats within one document alone stays. Rows with the same id are one document to
    each other: they take nothing from each other. A missing id counts as the largest. Columns of
    other names are ignored; an empty table gives no rows.

    Columns: the id column, n_words, n_removed, kept_sha256, kept (the words left, joined by one
    space)."""
    found = repeated_windows(docs, id_column, text_column, window, bits, gather)
    joined = _keyed(docs, id_column, text_column).join(found, ["id", "mark"], "left")
    result = joined.select("id", "text", "places", "packed").mapInArrow(
        lambda batches: _without(batches, window),
        "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string",
    )
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    return result.select(known.alias(id_column), "n_words", "n_removed", "kept_sha256", "kept")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP2_SQL = rf"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT doc_id, place, array_to_string(words[place:place + {WINDOW} - 1], ' ') AS sequence
    FROM (SELECT *, unnest(range(1, len(words) - {WINDOW} + 2)) AS place FROM texts)
), later AS (
    SELECT doc_id, place FROM windows
    QUALIFY doc_id > min(doc_id) OVER (PARTITION BY sequence)
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(place, place + {WINDOW})) AS place FROM later
), words AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
), kept AS (
    SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
    FROM words w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.place = c.place
    GROUP BY w.doc_id
)
SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
