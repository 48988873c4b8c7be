"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.components import components
from tradewind.llm.stored import stored
from tradewind.llm.words import (
    OF_WORDS,
    blocks,
    mixed,
    signed,
    span_hashes,
    text_column,
    window_hashes,
    word_spans,
)

# Words of an n-gram and the least Jaccard similarity of a link.
N = 5
THRESHOLD = 0.8
# Share of the pairs at the threshold that the bands must bring together, and the hashes to spend.
RECALL = 0.9999
MOST_HASHES = 96
# Members of a band's bucket that are compared in one task; larger buckets are cut into blocks.
BLOCK = 256
SEED = 11
NO_ID = (1 << 63) - 1


def choose_bands(
    threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES
) -> tuple[int, int]:
    """(bands, rows): the most rows per band, and so the fewest false candidates, for which
    ``most`` hashes still bring pairs at the threshold together with the wanted probability."""
    best = None
    for rows in range(1, most + 1):
        bands = next(
            (b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None
        )
        if bands:
            best = (bands, rows)
    if not best:
        raise ValueError("more hashes are needed for this recall")
    return best


def ngram_sets(texts: pa.Array, n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block (first row, row after the last, hashes, bounds): the sorted distinct n-gram hashes
    of each row. A text of fewer words than ``n`` is one n-gram, one without words has none."""
    for low, high, buf, bounds in blocks(texts):
        starts, ends, row = word_spans(buf, bounds)
        words = span_hashes(buf, starts, ends)
        hashes = window_hashes(words, n)
        whole = row[: len(hashes)] == row[n - 1 :] if len(hashes) else np.empty(0, bool)
        rows, hashes = row[: len(hashes)][whole], hashes[whole]
        counts = np.bincount(row, minlength=high - low)
        for short in np.flatnonzero((counts > 0) & (counts < n)):
            of_row = words[row == short]
            rows = np.append(rows, short)
            hashes = np.append(hashes, window_hashes(of_row, len(of_row), OF_WORDS[1]))
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
        yield low, high, hashes, np.searchsorted(rows, np.arange(high - low + 1))


def _signatures(batches, n: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per document the size and a 128-bit digest of its n-gram set and one key per band."""
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = random.integers(0, 1 << 63, bands * rows, np.uint64)
    for batch in batches:
        sizes, ones, twos, keys = [], [], [], []
        for low, high, hashes, bounds in ngram_sets(text_column(batch, "text"), n):
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            at = bounds[:-1][full]
            one = np.zeros(high - low, np.uint64)
            two = np.zeros(high - low, np.uint64)
            key = np.zeros((high - low, bands), np.uint64)
            if len(full):
                one[full] = np.add.reduceat(mixed(hashes), at)
                two[full] = np.add.reduceat(mixed(hashes ^ np.uint64(OF_WORDS[1])), at)
                for band in range(bands):
                    found = np.full(len(full), band, np.uint64)
                    for j in range(band * rows, (band + 1) * rows):
                        least = np.minimum.reduceat(hashes * factors[j] + offsets[j], at)
                        found = mixed(found * np.uint64(OF_WORDS[0]) + least)
                    # 0 stands for no key.
                    key[full, band] = np.maximum(found, np.uint64(1))
            sizes.append(size)
            ones.append(one)
            twos.append(two)
            keys.append(key)
        if not sizes:
            continue
        key = np.concatenate(keys)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(np.concatenate(sizes).astype(np.int64)),
                signed(np.concatenate(ones)),
                signed(np.concatenate(twos)),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(key) + 1, dtype=np.int32) * bands), signed(key.ravel())
                ),
            ],
            ["id", "n", "one", "two", "bands"],
        )


def _blocked(batches, n: int, bands: int, block: int) -> Iterator[pa.RecordBatch]:
    """A row for each comparison that a document takes part in: bucket, pair of blocks, its side of
    that pair, its buckets by band, and its n-gram set."""
    schema = pa.schema([
        ("bucket", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()),
        ("band", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()),
        ("buckets", pa.binary()), ("grams", pa.binary()),
    ])
    for batch in batches:
        ids = batch.column("id").to_pylist()
        copies = batch.column("copies").to_pylist()
        member = batch.column("member").to_pylist()
        out, held = [], 0
        for low, high, hashes, bounds in ngram_sets(text_column(batch, "text"), n):
            for place in range(low, high):
                grams = hashes[bounds[place - low] : bounds[place - low + 1]].tobytes()
                buckets = np.zeros(bands, np.int64)
                for m in member[place]:
                    buckets[m["band"]] = m["bucket"]
                spread = int(mixed(np.array([ids[place]], np.int64).view(np.uint64))[0])
                for m in member[place]:
                    parts = -(-m["members"] // block)
                    own = spread % parts
                    for other in range(parts):
                        out.append((
                            m["bucket"], min(own, other), max(own, other), int(own > other),
                            m["band"], ids[place], copies[place], buckets.tobytes(), grams,
                        ))
                        held += len(grams)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                            schema=schema,
                        )
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                schema=schema,
            )


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    all_grams = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(all_grams, kind="stable")
    grams, rows = all_grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    place = np.cumsum(new) - 1
    often = np.bincount(place) > 1
    keep = often[place]
    column, rows = (np.cumsum(often) - 1)[place[keep]], rows[keep]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, int(often.sum()) + width, width))
    for at, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        table = np.zeros((len(sets), width), np.float32)
        table[rows[a:b], column[a:b] - at * width] = 1
        counts += table @ table.T
    return counts


def _links(group: dict, threshold: float):
    """(i, j, similarity, first): the pairs of a comparison that are similar enough, and whether
    this bucket is the first that the two share."""
    sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    size = np.array([len(s) for s in sets], np.float64)
    shared = _shared(sets).astype(np.float64)
    union = size[:, None] + size[None, :] - shared
    alike = shared >= threshold * union - 1e-9
    side, ids = np.array(group["side"]), np.array(group["id"])
    if group["low"] != group["high"]:
        alike &= side[:, None] < side[None, :]
    else:
        alike &= np.tri(len(sets), k=-1, dtype=bool).T
    alike &= ids[:, None] != ids[None, :]
    i, j = np.nonzero(alike)
    buckets = np.stack([np.frombuffer(b, np.int64) for b in group["buckets"]])[:, : group["band"]]
    earlier = ((buckets[i] == buckets[j]) & (buckets[i] != 0)).any(axis=1)
    return i, j, shared[i, j] / union[i, j], ~earlier


def _groups(batches) -> Iterator[dict]:
    """The rows of one comparison after the other; they follow each other, at most two blocks."""
    now, key = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for at, row_key in enumerate(
            zip(columns["bucket"], columns["low"], columns["high"], strict=True)
        ):
            if row_key != key:
                if now and len(now["id"]) > 1:
                    yield now
                key = row_key
                now = {"low": key[1], "high": key[2], "band": columns["band"][at]} | {
                    c: [] for c in ("side", "id", "copies", "buckets", "grams")
                }
            for c in ("side", "id", "copies", "buckets", "grams"):
                now[c].append(columns[c][at])
    if now and len(now["id"]) > 1:
        yield now


def _verified(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """Per comparison and document with a link: the least document that its links there lead to,
    and the number of documents linked whose first shared bucket this is."""
    out: list[tuple[int, int, int]] = []
    for group in _groups(batches):
        i, j, _, first = _links(group, threshold)
        if not len(i):
            continue
        ids, copies = np.array(group["id"]), np.array(group["copies"])
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i[first], copies[j[first]])
        np.add.at(links, j[first], copies[i[first]])
        root = ids.copy()
        while True:
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            if (root == before).all():
                break
        linked = np.unique(np.concatenate([i, j]))
        out += zip(ids[linked].tolist(), root[linked].tolist(), links[linked].tolist(), strict=True)
        if len(out) > 50_000:
            yield _batch(out, ["id", "root", "links"])
            out = []
    if out:
        yield _batch(out, ["id", "root", "links"])


def _pairs(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        i, j, similarity, first = _links(group, threshold)
        if first.any():
            ids = np.array(group["id"])
            a, b = ids[i[first]], ids[j[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(similarity[first])],
                ["a", "b", "similarity"],
            )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


class NgramJoin:
    """The stages of the join over one table; see ``near_groups`` for what they keep to."""

    def __init__(self, docs, id_column, text_column, n, threshold, recall, most_hashes, block, seed):
        self.n, self.threshold, self.block = n, threshold, block
        bands, rows = choose_bands(threshold, recall, most_hashes)
        self.bands = bands
        self.texts = docs.select(
            F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"),
            F.col(text_column).alias("text"),
        )
        self.signatures = stored(
            self.texts.mapInArrow(
                lambda batches: _signatures(batches, n, bands, rows, seed),
                "id bigint, n bigint, one bigint, two bigint, bands array<bigint>",
            ),
            "ngram-signatures",
        )
        # Documents with the same n-grams are one class and compared once.
        self.classes = stored(
            self.signatures.where("n > 0")
            .groupBy("one", "two", "n")
            .agg(
                F.min("id").alias("first"),
                F.count("*").alias("copies"),
                F.min_by("bands", "id").alias("bands"),
            ),
            "ngram-classes",
        )

    def comparisons(self) -> DataFrame:
        """Rows of the buckets, brought together by bucket and pair of blocks."""
        n, bands, block = self.n, self.bands, self.block
        members = self.classes.select("first", "copies", F.posexplode("bands").alias("band", "bucket"))
        buckets = members.groupBy("bucket").agg(
            F.count("*").alias("members"),
            F.bit_xor(F.xxhash64("first")).alias("mark"),
            F.bit_xor(F.xxhash64("first", F.lit(1))).alias("mark_2"),
        )
        # Buckets with the same members, in most bands of most groups, are compared once.
        kept = stored(
            buckets.where("members > 1")
            .groupBy("members", "mark", "mark_2")
            .agg(F.min("bucket").alias("bucket"))
            .select("bucket", "members"),
            "ngram-buckets",
        )
        asked = (
            members.join(kept, "bucket")
            .groupBy(F.col("first").alias("id"))
            .agg(
                F.first("copies").alias("copies"),
                F.collect_list(F.struct("band", "bucket", "members")).alias("member"),
            )
        )
        rows = (
            self.texts.join(asked, "id")
            .select("id", "text", "copies", "member")
            .mapInArrow(
                lambda batches: _blocked(batches, n, bands, block),
                "bucket bigint, low int, high int, side int, band int, id bigint, copies bigint, "
                "buckets binary, grams binary",
            )
        )
        key = ["bucket", "low", "high"]
        return rows.repartition(*key).sortWithinPartitions(*key)


def similar_pairs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(a, b, similarity): the linked pairs, each of the first documents of two classes of equal
    n-gram sets, a < b. Their number may grow with the square of a group of near copies; use
    ``near_groups`` where groups or counts are enough."""
    join = NgramJoin(docs, id_column, text_column, n, threshold, recall, most_hashes, block, seed)
    return join.comparisons().mapInArrow(
        lambda batches: _pairs(batches, threshold), "a bigint, b bigint, similarity double"
    )


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: the group it is linked to and the number of its links.

    Two documents are linked if the Jaccard similarity of their sets of ``n``-word sequences is
    ``threshold`` or more. Band and row counts follow from the recall wanted; band hashes are
    shuffled, and documents that share one are compared on their full sets. Equal sets are
    compared once. A bucket of many members is cut into blocks of ``block``, and each pair of
    blocks is a comparison of its own, so no task holds more than two blocks, no pair leaves a
    task as a row, and none is left out. Work grows with the square of a group of different near
    copies, spread over its pairs of blocks.

    Words are runs of anything but space and tab to carriage return, unchanged. A text of fewer
    than ``n`` words is one sequence; texts without words (null, blank) have no links. Rows with
    the same id are one document to each other: they do not link, and each gets the links of its
    own text. A missing id counts as the largest. Other columns are ignored; an empty table gives
    no rows.

    Columns: the id column, class_id (least id of the group), n_links (documents, copies
    included), copy_id (least id with the same set), n_copies, n_grams."""
    join = NgramJoin(docs, id_column, text_column, n, threshold, recall, most_hashes, block, seed)
    verified = stored(
        join.comparisons().mapInArrow(
            lambda batches: _verified(batches, threshold), "id bigint, root bigint, links bigint"
        ),
        "ngram-links",
    )
    labels = components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy(F.col("id").alias("of")).agg(F.sum("links").alias("links"))
    classes = (
        join.classes.select("one", "two", "n", "first", "copies")
        .join(labels, F.col("first") == F.col("node"), "left")
        .join(links, F.col("first") == F.col("of"), "left")
        .select(
            "one",
            "two",
            "n",
            F.coalesce("label", "first").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.col("first").alias("copy_id"),
            F.col("copies").alias("n_copies"),
        )
    )
    classes = stored(classes, "ngram-result")
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    return join.signatures.select("id", "one", "two", "n").join(
        classes, ["one", "two", "n"], "left"
    ).select(
        known.alias(id_column),
        F.when(F.col("class_id").isNull(), known)
        .otherwise(F.nullif("class_id", F.lit(NO_ID)))
        .alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("copy_id").isNull(), known)
        .otherwise(F.nullif("copy_id", F.lit(NO_ID)))
        .alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.col("n").alias("n_grams"),
    )


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(words[place:place + size - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS place
        FROM (SELECT *, least(len(words), {N}) AS size FROM texts WHERE len(words) > 0))
), sets AS (
    SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS mark
    FROM grams GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id
    WHERE 5 * common >= 4 * (x.n + y.n - common)
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM texts
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT t.doc_id, class_id, coalesce(n_links, 0) AS n_links,
    coalesce(copy_id, t.doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, coalesce(n, 0) AS n_grams
FROM texts t
JOIN (SELECT a, min(b) AS class_id FROM reached GROUP BY a) g ON t.doc_id = g.a
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON t.doc_id = l.a
LEFT JOIN (
    SELECT doc_id, n, min(doc_id) OVER (PARTITION BY mark) AS copy_id,
        count(*) OVER (PARTITION BY mark) AS n_copies FROM sets
) s ON t.doc_id = s.doc_id
"""
