"""Passages of benchmark items in documents, found by an Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of a window; a shorter item is one window.
WINDOW = 10
# Characters of items in one automaton, about 60 bytes of memory each. A larger benchmark takes
# several automata, each of which reads the documents once more in the same tasks.
AUTOMATON_CHARS = 2_000_000

# What a byte becomes: capitals small, digits, letters and bytes of other alphabets themselves,
# everything else a space.
_NORMAL = bytearray(b" " * 256)
for _byte in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _NORMAL[_byte] = _byte
for _byte in range(0x41, 0x5B):
    _NORMAL[_byte] = _byte + 32
NORMAL = bytes(_NORMAL)
_IS_WORD = np.frombuffer(NORMAL, np.uint8) != 0x20


def normalised(text: str | None) -> str:
    """The words between single spaces, one more before and after. Bytes are spelled as
    characters of the same number, which keeps one byte per character in memory."""
    words = (text or "").encode().translate(NORMAL).split(b" ")
    return (b" " + b" ".join(filter(None, words)) + b" ").decode("latin-1")


def windows_of(text: str, window: int) -> list[str]:
    """The windows of a normalised text, each with the spaces around it."""
    words = text.split(" ")[1:-1]
    if not words or not words[0]:
        return []
    size = min(window, len(words))
    return [" " + " ".join(words[i : i + size]) + " " for i in range(len(words) - size + 1)]


_built: dict[str, object] = {}


def automaton_of(items: list[tuple[str, str]], window: int, name: str):
    """One automaton over the windows of all items, each with its length in words and the places
    of the items that have it; kept by the worker until another is asked for."""
    if name not in _built:
        _built.clear()
        found: dict[str, list[int]] = {}
        for place, (_, text) in enumerate(items):
            for each in windows_of(text, window):
                found.setdefault(each, []).append(place)
        automaton = ahocorasick.Automaton()
        for each, places in found.items():
            automaton.add_word(each, (len(each), each.count(" ") - 1, sorted(set(places))))
        if found:
            automaton.make_automaton()
        _built[name] = automaton
    return _built[name]


def hits_in(automaton, text: str) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, first and last hit word of each hit (sorted), and the items."""
    n_words = 0 if text == "  " or text == " " else text.count(" ") - 1
    found: list[tuple[int, int]] = []
    items: set[int] = set()
    if n_words and len(automaton):
        for end, (length, size, places) in automaton.iter(text):
            found.append((end - length + 1, size))
            items.update(places)
    if not found:
        return n_words, np.empty((0, 2), np.int64), items
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
    spans = np.array(sorted(set(found)), np.int64)
    first = np.searchsorted(spaces, spans[:, 0])
    return n_words, np.stack([first, first + spans[:, 1]], axis=1), items


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching [first, after) spans, sorted by the first, as one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], axis=1)


def original_offsets(text: str, spans: np.ndarray) -> list[dict[str, int]]:
    """Code points of the original text that [first word, word after) spans stand for."""
    data = text.encode()
    inside = np.concatenate([[False], _IS_WORD[np.frombuffer(data, np.uint8)], [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [
        {"start": int(points[starts[a]] - 1), "end": int(points[ends[b - 1] - 1])}
        for a, b in spans.tolist()
    ]


def _scan(batches, items, window: int, name: str, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds the hits of one automaton to those so far; after the last one, the results."""
    automaton = automaton_of(items, window, name)
    names = [item for item, _ in items]
    for batch in batches:
        texts = batch.column("text")
        out = {k: [] for k in ("hits", "items", "n_words", "n_hit", "spans")}
        for place, value in enumerate(texts):
            text = value.as_py() or ""
            n_words, spans, found = hits_in(automaton, normalised(text))
            if held := batch.column("hits")[place].as_py():
                spans = np.concatenate([np.frombuffer(held, np.int64).reshape(-1, 2), spans])
            if len(spans):
                spans = _merged(spans)
            known = {names[i] for i in found} | set(batch.column("items")[place].as_py() or [])
            out["hits"].append(spans.tobytes() if len(spans) else None)
            out["items"].append(sorted(known))
            out["n_words"].append(n_words)
            out["n_hit"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["spans"].append(original_offsets(text, spans) if last and len(spans) else [])
        kinds = {
            "hits": pa.binary(),
            "items": pa.list_(pa.string()),
            "n_words": pa.int64(),
            "n_hit": pa.int64(),
            "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
        }
        columns = {k: pa.array(out[k], kind) for k, kind in kinds.items()}
        rest = ["id"] if last else ["id", "text"]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in rest} | columns)


def _groups(items: DataFrame, chars: int) -> Iterator[list[tuple[str, str]]]:
    """Normalised items in groups of about ``chars`` characters, in the order of their ids."""
    group: list[tuple[str, str]] = []
    size = 0
    for row in items.orderBy("id", "text").toLocalIterator():
        text = normalised(row["text"])
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append((row["id"], text))
        size += len(text)
    yield group


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    chars: int = AUTOMATON_CHARS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document with its words, the words inside a passage of the benchmark, the
    items these come from and where they stand in the original text.

    Words are runs of letters, digits and bytes beyond ASCII, A to Z lower-cased. A window is
    ``window`` consecutive words of an item, or the whole item if it is shorter; an item without
    words has none. Every occurrence counts and occurrences may overlap. Nothing is shuffled: the
    items, in groups of ``chars`` characters, go to the tasks as automata, which read each text
    once. Null texts have no words, repeated rows count each, an empty benchmark finds nothing,
    and an item without an id goes by the empty name. Other columns are ignored, except those in
    ``carry``.

    Columns: the id column, n_words, n_hit, items (ids as strings, sorted), spans (start and end
    in code points), then ``carry``."""
    context = docs.sparkSession.sparkContext
    asked = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("id"),
        F.col(item_text_column).alias("text"),
    )
    kept = F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    id_type = docs.select(kept.alias("id")).schema["id"].dataType.simpleString()
    found = docs.select(
        kept.alias("id"),
        F.col(text_column).alias("text"),
        F.lit(None).cast("binary").alias("hits"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    results = (
        "hits binary, items array<string>, n_words bigint, n_hit bigint, "
        "spans array<struct<start: int, end: int>>"
    )
    groups = list(map(context.broadcast, _groups(asked, chars)))
    for place, group in enumerate(groups):
        last = place == len(groups) - 1
        name = f"{context.applicationId}-{group._jbroadcast.id()}-{window}"

        def scan(batches, group=group, name=name, last=last):
            return _scan(batches, group.value, window, name, last)

        found = found.mapInArrow(
            scan, f"id {id_type}, " + ("" if last else "text string, ") + results
        )
    return found.select(
        F.col("id.id").alias(id_column),
        "n_words",
        "n_hit",
        "items",
        "spans",
        *[F.col(f"id.c{i}").alias(c) for i, c in enumerate(carry)],
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_passages(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP3_SQL = rf"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (
    SELECT item_id, words, least(len(words), {WINDOW}) AS size
    FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0
), asked AS (
    SELECT DISTINCT item_id, size, array_to_string(words[place:place + size - 1], ' ') AS sequence
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS place FROM items)
), windows AS (
    SELECT doc_id, size, place, array_to_string(words[place:place + size - 1], ' ') AS sequence
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS place
        FROM texts, (SELECT DISTINCT size FROM asked) WHERE len(words) >= size)
), hits AS (
    SELECT doc_id, place, size, item_id FROM windows JOIN asked USING (size, sequence)
), words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(place, place + size)) AS place FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT t.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM texts t LEFT JOIN words w USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
