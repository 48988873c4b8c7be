"""Prefix trie of conversations: which first turns conversations share, and what that saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.double_array import ROOT, DoubleArray, dense
from tradewind.llm.merkle import CRC32_SQL
from tradewind.llm.mixing import WORD, word_count
from tradewind.llm.numbering import numbered
from tradewind.llm.stored import stored

# Turns of a conversation in one row, and turns in one double array.
SEGMENT = 512
CHUNK = 1 << 17
# Conversation ids that are joined in one row on the way to their digest.
IDS = 4096
# A turn is 16 bytes of its digest and 4 of its word count, a node's key 16 bytes.
TOKEN, DIGEST = 20, 16
_START = bytes(DIGEST)
# Conversations take their first turns from the first of so many ids, and less than so many turns.
FAMILY, BORROWED = 20, 4

_ITEM = "line binary, n bigint, least bigint, root_least bigint, below_children bigint, below_leaves bigint, below_saved bigint"
_NODE = (
    "key binary, parent binary, depth bigint, n_convs bigint, conv_id bigint, parent_conv_id bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, words bigint, side binary, counted boolean"
)


def turn_token(role: Column, text: Column) -> Column:
    """20 bytes that stand for a turn; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.lpad(F.hex(word_count(text)), 2 * (TOKEN - DIGEST), "0")
    return F.unhex(F.concat(F.substring(digest, 1, 2 * DIGEST), words))


def _chained(key: Column, token: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(key, token), 256), 1, 2 * DIGEST))


def _tries(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct sequences in, nodes out, a double array for each ``chunk`` of turns."""
    held, turns = [], 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            held.append(row)
            turns += 1 + (len(row[0]) - DIGEST) // TOKEN
            if turns >= chunk:
                yield _nodes(held)
                held, turns = [], 0
    if held:
        yield _nodes(held)


def _nodes(items: list[tuple]) -> pa.RecordBatch:
    """The nodes of the trie over ``items``. Those on the way to the first and the last item may go
    on in the chunks beside this one: they are told once for each of the two ways, with ``side`` to
    name the way, and are counted on the first."""
    lines = [item[0] for item in items]
    told = [np.array(column, np.int64) for column in zip(*(item[1:] for item in items), strict=True)]
    n, least, root_least, below_children, below_leaves, below_saved = told
    # The symbols of an item: the key it starts from, then its turns.
    symbols = [s for line in lines for s in (line[:DIGEST], *(line[i : i + TOKEN] for i in range(DIGEST, len(line), TOKEN)))]
    lengths = np.array([1 + (len(line) - DIGEST) // TOKEN for line in lines])
    item_of = np.repeat(np.arange(len(lines)), lengths)
    starts = np.cumsum(lengths) - lengths
    depth_of = np.arange(len(symbols)) - starts[item_of]
    padded = np.array([s.ljust(TOKEN, b"\0") for s in symbols], f"V{TOKEN}")
    trie = DoubleArray()
    slots = trie.add(dense(padded, np.lexsort((item_of, depth_of))), lengths)

    size, parents = trie.top, trie.check[: trie.top]
    far = np.iinfo(np.int64).max
    n_convs, conv_id = np.zeros(size, np.int64), np.full(size, far)
    depth, words = np.zeros(size, np.int64), np.zeros(size, np.int64)
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    np.add.at(n_convs, slots, n[item_of])
    np.minimum.at(conv_id, slots, np.where(depth_of == 0, root_least[item_of], least[item_of]))
    depth[slots] = depth_of
    words[slots] = [int.from_bytes(s[DIGEST:], "big") for s in symbols]
    ends = slots[starts + lengths - 1]
    children[ends], leaves[ends], saved[ends] = below_children, below_leaves, below_saved
    saved += (n_convs - 1) * words
    used = np.flatnonzero(parents >= ROOT)
    np.add.at(children, parents[used], 1)
    leaves[used[children[used] == 0]] = 1
    by_depth = used[np.argsort(-depth[used], kind="stable")]
    bounds = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, bounds):
        np.add.at(leaves, parents[level], leaves[level])
        np.add.at(saved, parents[level], saved[level])

    first_at = np.zeros(size, np.int64)
    first_at[slots[::-1]] = np.arange(len(slots))[::-1]
    keys: dict[int, bytes] = {ROOT: b""}
    for slot in by_depth[::-1].tolist():
        symbol, above = symbols[first_at[slot]], keys[int(parents[slot])]
        keys[slot] = hashlib.sha256(above + symbol).digest()[:DIGEST] if above else symbol

    first = slots[: lengths[0]].tolist()
    last = slots[len(slots) - lengths[-1] :].tolist() if len(items) > 1 else []
    before, ways = set(first), {*first, *last}
    name = hashlib.sha256(lines[0]).digest()[:DIGEST]
    inner = [s for s in used.tolist() if s not in ways]
    rows = inner + first + last
    sides = [None] * len(inner) + [name + b"<"] * len(first) + [name + b">"] * len(last)
    counted = [True] * (len(inner) + len(first)) + [s not in before for s in last]
    at = np.array(rows, np.int64)
    parent = parents[at]
    # The smallest member of a parent that goes on elsewhere is not known here.
    open_parent = np.isin(parent, np.array([ROOT, *ways]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[s] for s in rows], pa.binary()),
            pa.array([keys[s] or None for s in parent.tolist()], pa.binary()),
            pa.array(depth[at]),
            pa.array(n_convs[at]),
            pa.array(conv_id[at]),
            pa.array(conv_id[parent], mask=open_parent),
            pa.array(children[at]),
            pa.array(leaves[at]),
            pa.array(saved[at]),
            pa.array(words[at]),
            pa.array(sides, pa.binary()),
            pa.array(counted, pa.bool_()),
        ],
        [field.split()[0] for field in _NODE.split(", ")],
    )


def _merged(found: DataFrame) -> DataFrame:
    """The nodes of a table of ``_tries``, each once, with ``parent_conv_id`` where the parent is there.

    Nodes on the ways to the ends of a chunk meet by their key; sums over their chunks count a
    shared node below once per chunk that has it, and call it a leaf where its children are
    elsewhere. What that is too much or too little is a number per shared node, which counts for
    all nodes above it. They lie on the way that the node is told on, so a running sum up one
    way per node hands it on; ways are as long as a row of turns at most."""
    ways = found.where("side IS NOT NULL")
    once = {c: F.sum(F.when(F.col("counted"), F.col(c))).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    shared = stored(
        ways.groupBy("key").agg(
            *once.values(),
            F.first("parent").alias("parent"),
            F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.first("words").alias("words"),
            F.min("side").alias("told_on"),
            F.count_if("counted").alias("chunks"),
            F.count_if(F.col("counted") & (F.col("n_children") == 0)).alias("ends"),
        ),
        "trie-shared",
    )
    again = F.col("chunks") - 1
    wrong = shared.select(
        "key",
        F.col("told_on").alias("side"),
        F.when(F.col("n_children") > 0, -F.col("ends")).otherwise(-again).alias("leaves_by"),
        (again * F.col("words")).alias("saved_by"),
    )
    upwards = Window.partitionBy("side").orderBy(F.desc("depth"))
    below = (
        ways.select("key", "side", "depth")
        .join(wrong, ["key", "side"], "left")
        .select(
            "key",
            F.sum(F.coalesce("leaves_by", F.lit(0))).over(upwards).alias("leaves_by"),
            F.sum(F.coalesce("saved_by", F.lit(0))).over(upwards).alias("saved_by"),
        )
        .groupBy("key")
        .agg(F.sum("leaves_by").alias("leaves_by"), F.sum("saved_by").alias("saved_by"))
    )
    twice = shared.groupBy(F.col("parent").alias("key")).agg(F.sum(again).alias("children_by"))
    columns = ["key", "parent", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]
    right = (
        shared.join(below, "key")
        .join(twice, "key", "left")
        .withColumn("n_children", F.col("n_children") - F.coalesce("children_by", F.lit(0)))
        .withColumn("n_leaves", F.col("n_leaves") + F.col("leaves_by"))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved_by"))
        .select(*columns)
    )
    inner = found.where("side IS NULL")
    asking = inner.where("parent_conv_id IS NULL").select(*columns).unionByName(right)
    parents = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        inner.where("parent_conv_id IS NOT NULL")
        .select(*columns, "parent_conv_id")
        .unionByName(asking.join(parents, "parent", "left"))
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end, conv_id) to rows of up to IDS ids."""
    end, ids = None, []
    done: list[tuple] = []
    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (key != end or len(ids) == IDS):
                done.append((end, ids[0], ",".join(map(str, ids))))
                ids = []
            end = key
            ids.append(conv_id)
        if len(done) >= 64:
            yield _rows(done, [pa.binary(), pa.int64(), pa.string()], ["end", "first", "ids"])
            done = []
    if ids:
        done.append((end, ids[0], ",".join(map(str, ids))))
    if done:
        yield _rows(done, [pa.binary(), pa.int64(), pa.string()], ["end", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end, first, ids) to a digest per end; only the state of one is held."""
    end, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != end:
                if state:
                    done.append((end, state.hexdigest()))
                end, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(done, [pa.binary(), pa.string()], ["key", "ends_sha256"])
    if state:
        yield _rows([(end, state.hexdigest())], [pa.binary(), pa.string()], ["key", "ends_sha256"])


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (end, conv_id). The ids of an end that has many are joined into rows
    where they lie, sorted; what meets to be hashed in order is a row per some thousand ids."""
    counts = members.groupBy("end").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    lone = counts.where("n = 1").select(
        F.col("end").alias("key"), F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256")
    )
    joined = (
        members.join(counts.where("n > 1").select("end"), "end", "left_semi")
        .select("end", "conv_id")
        .repartitionByRange("end", "conv_id")
        .sortWithinPartitions("end", "conv_id")
        .mapInArrow(_joined_ids, "end binary, first bigint, ids string")
    )
    many = (
        joined.repartition("end")
        .sortWithinPartitions("end", "first")
        .mapInArrow(_hashed_ids, "key binary, ends_sha256 string")
    )
    return lone.unionByName(many)


def prefix_trie(turns: DataFrame, members: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct sequence of first turns that a conversation begins with.

    ``turns`` has conv_id, depth (from 1, without gaps) and token (``turn_token``), ``members`` every
    conv_id once with its length, 0 for one without turns. Columns: conv_id (the smallest member),
    depth, parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, the words of a node's last turn for each member but one) and
    ends_sha256 (of the sorted ids of the conversations that end there, joined by commas).

    Equal conversations are one sequence with a count. Distinct sequences are sorted and dealt to
    tasks by ranges, so a prefix that many share is spread over as many tasks as it needs; each task
    packs double arrays of about ``chunk`` turns and walks them. Only nodes on the way to the first
    or last sequence of an array can go on elsewhere; they are merged by key. Texts are 20 bytes a
    turn from the start; a conversation is cut into rows of ``segment`` turns, the tries of later
    rows hang below the nodes that the earlier rows end in. No members, no rows."""
    longest = members.agg(F.max("length")).first()[0]
    last = max((longest or 0) - 1, 0) // segment
    rows = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / segment).cast("int").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "token"))), lambda t: t["token"]).alias("tokens")
    )
    rows = stored(rows, "trie-rows") if last else rows
    none = members.where("length = 0").select("conv_id", F.array().cast("array<binary>").alias("tokens"))
    reached = members.select("conv_id", F.lit(_START).alias("key"))
    parts, items, ended = [], [], []
    for part in range(last + 1):
        here = rows.where(F.col("part") == part).select("conv_id", "tokens")
        here = here.unionByName(none) if part == 0 else here
        end = F.aggregate("tokens", F.col("key"), _chained)
        line = F.unhex(F.concat(F.hex("key"), F.array_join(F.transform("tokens", F.hex), "")))
        stop = F.greatest(F.ceil(F.col("length") / segment), F.lit(1)) - 1 == part
        at = stored(
            here.join(reached, "conv_id")
            .join(members, "conv_id")
            .select("conv_id", "key", end.alias("end"), line.alias("line"), stop.alias("stops")),
            "trie-lines",
        )
        parts.append(at)
        ended.append(at.where("stops").select("end", "conv_id"))
        distinct = at.groupBy("line", "key", "end").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
        if part == 0:
            distinct = distinct.withColumn("root_least", F.col("least"))
        else:
            above = items[-1].select(F.col("end").alias("key"), F.col("least").alias("root_least"))
            distinct = distinct.join(above, "key")
        items.append(stored(distinct, "trie-items"))
        reached = at.where(~F.col("stops")).select("conv_id", F.col("end").alias("key"))

    levels: list[DataFrame] = []
    below = None
    for part in reversed(range(last + 1)):
        given = items[part]
        if below is None:
            for name in ("children", "leaves", "saved"):
                given = given.withColumn(f"below_{name}", F.lit(0).cast("bigint"))
        else:
            given = given.join(below, "end", "left").fillna(0, ["below_children", "below_leaves", "below_saved"])
        columns = [field.split()[0] for field in _ITEM.split(", ")]
        sorted_lines = given.select(*columns).repartitionByRange("line").sortWithinPartitions("line")
        found = stored(sorted_lines.mapInArrow(lambda batches: _tries(batches, chunk), _NODE), "trie-nodes")
        nodes = _merged(found)
        if part:
            nodes = stored(nodes, "trie-merged")
            below = nodes.where("depth = 0").select(
                F.col("key").alias("end"),
                F.col("n_children").alias("below_children"),
                F.col("n_leaves").alias("below_leaves"),
                F.col("saved_tokens").alias("below_saved"),
            )
            nodes = nodes.where("depth > 0").withColumn("depth", F.col("depth") + part * segment)
        levels.append(nodes)
    nodes, ends = levels[0], ended[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    for more in ended[1:]:
        ends = ends.unionByName(more)
    return nodes.join(_ends(ends), "key", "left").select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the conversations as the registered query takes them: each one's first h
    turns are those of the first conversation of its twenty, h by the checksum of its id.

    Turns are ordered by turn, null first, those with the same number by their content. Rows without
    a conv_id belong to no conversation. Repeated rows are turns each."""
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        turn_token(F.col("role"), F.col("text")).alias("token"),
    )
    placed = stored(numbered(stored(own, "turns"), ["conv_id"], ["turn", "token"]), "turns-placed")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = placed.where(F.col("conv_id") == base)
    sizes = heads.where("slot = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h = F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % BORROWED)
    told = (
        placed.withColumn("base", base)
        .withColumn("h", h)
        .join(sizes, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    )
    members = told.where("slot = 0").select(
        "conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    first = heads.where(F.col("slot") < BORROWED - 1).select(
        F.col("conv_id").alias("base"), F.col("slot").alias("place"), F.col("token").alias("given")
    )
    borrowed = (
        told.where("slot = 0 AND h > 0")
        .join(first, "base")
        .where("place < h")
        .select("conv_id", (F.col("place") + 1).alias("depth"), F.col("given").alias("token"))
    )
    kept = told.where("slot >= h").select(
        "conv_id", (F.col("taken") + F.col("slot") - F.col("h") + 1).alias("depth"), "token"
    )
    return kept.unionByName(borrowed), members


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns, members = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(turns, stored(members, "members"))


OP13_SQL = rf"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) - 1 AS slot
    FROM (SELECT conv_id, turn, words, left(sha256(strlen(role) || ':' || role || text), 32) || printf('%08x', words) AS token
        FROM (SELECT *, len(regexp_extract_all(text, '{WORD}')) AS words FROM given))
), convs AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % {FAMILY} AS base,
        CASE WHEN conv_id % {FAMILY} = 0 THEN 0 ELSE {CRC32_SQL.format(text="conv_id::VARCHAR")} % {BORROWED} END AS h
    FROM own GROUP BY conv_id
), planned AS (
    SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), turns AS (
    SELECT p.conv_id, o.slot + 1 AS depth, o.token, o.words FROM planned p JOIN own o ON o.conv_id = p.base AND o.slot < p.h
    UNION ALL
    SELECT p.conv_id, p.taken + o.slot - p.h + 1, o.token, o.words FROM planned p JOIN own o ON o.conv_id = p.conv_id AND o.slot >= p.h
), paths AS (
    SELECT conv_id, depth, words, string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM planned
), lengths AS (
    SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        left(path, greatest(len(path) - 40, 0)) AS above,
        string_agg(CASE WHEN length = depth THEN conv_id END, ',' ORDER BY conv_id) AS ends
    FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
), children AS (
    SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above
), sums AS (
    SELECT p.path, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE c.path IS NULL) AS n_leaves
    FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.path = n.path
    GROUP BY p.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
    s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN children c USING (path)
LEFT JOIN nodes u ON u.path = n.above AND n.depth > 0
"""
