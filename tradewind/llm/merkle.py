"""Merkle manifest of a dataset: a tree of digests per part, and a tree over the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.numbering import numbered
from tradewind.llm.stored import stored

# Nodes that one parent hashes.
ARITY = 2
# Levels that one pass climbs. A pass sorts blocks of ARITY^LEVELS nodes.
LEVELS = 8
# What a row's leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows whose id has a checksum that this divides are tampered with in the registered query.
TAMPERED = 7


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over the fields: ``-`` for a null, else the UTF-8 length, ``:`` and the value."""
    told = []
    for field in fields:
        value = field.cast("string")
        length = F.octet_length(value).cast("string")
        told.append(F.coalesce(F.concat(length, F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def _climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (tree, slot, n, node) with ``block``, ``top`` and ``path``: the blocks of
    arity^levels consecutive nodes, the one node that a block becomes, and per level what is hashed to
    the left and to the right of the row's ancestor.

    A node stands on the row of its first leaf, so on a level all nodes are a fixed offset apart and
    lag and lead columns find the siblings; the place in the run and the end of the tree mask them.
    A level on which a tree has one node left hashes nothing."""
    block = Window.partitionBy("tree", "block").orderBy("slot")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumn("block", F.floor(F.col("slot") / arity**levels).cast("bigint"))
    rows = rows.withColumn("node_0", F.col("node"))
    for level in range(levels):
        step, node = arity**level, F.col(f"node_{level}")
        place = F.floor(F.col("slot") / step) % arity
        before = [F.when(place >= j, F.lag(node, j * step).over(block)) for j in range(arity - 1, 0, -1)]
        after = [F.when(place + j < arity, F.lead(node, j * step).over(block)) for j in range(1, arity)]
        hashed = node.isNotNull() & (F.col("n") > step)
        rows = rows.withColumns({
            f"left_{level}": F.when(hashed, F.concat_ws("", *before)),
            f"right_{level}": F.when(hashed, F.concat_ws("", *after)),
        })
        parent = F.when(hashed, F.sha2(F.concat(node, F.col(f"right_{level}")), 256)).otherwise(node)
        rows = rows.withColumn(
            f"node_{level + 1}", F.when(F.col("slot") % (step * arity) == 0, parent)
        )
    sides = [
        F.when(
            F.col("n") > arity**level,
            F.struct(
                F.last(f"left_{level}", ignorenulls=True).over(so_far).alias("left"),
                F.last(f"right_{level}", ignorenulls=True).over(so_far).alias("right"),
            ),
        )
        for level in range(levels)
    ]
    return rows.select(
        *nodes.columns,
        "block",
        F.first(f"node_{levels}").over(so_far).alias("top"),
        F.filter(F.array(*sides), lambda side: side.isNotNull()).alias("path"),
    )


def _ladder(leaves: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The leaves, the tops of their blocks, the tops of those, to one row per tree."""
    size = arity**levels
    tables = [leaves]
    while tables[-1].where("n > 1").limit(1).count():
        tops = _climbed(tables[-1], arity, levels).where(F.col("slot") % size == 0)
        above = tops.select(
            "tree",
            F.col("block").alias("slot"),
            F.ceil(F.col("n") / size).cast("bigint").alias("n"),
            F.col("top").alias("node"),
        )
        tables.append(stored(above, "merkle-tops"))
    return tables


def _descended(tables: list[DataFrame], above: DataFrame, arity: int, levels: int) -> DataFrame:
    """The lowest table with whole paths. ``above`` has one row per tree: tree, slot 0, path and
    whatever every row of the tree shall carry."""
    shared = [c for c in above.columns if c not in ("tree", "slot", "path")]
    for table in reversed(tables[:-1]):
        upper = above.select(
            "tree", F.col("slot").alias("block"), F.col("path").alias("upper"), *shared
        )
        rows = _climbed(table, arity, levels).join(upper, ["tree", "block"])
        above = rows.select(
            *table.columns, F.concat("path", "upper").alias("path"), *shared
        )
    if len(tables) == 1:
        above = tables[0].join(above.drop("slot"), "tree")
    return above


def merkle_manifest(
    leaves: DataFrame,
    part_column: str,
    order_column: str,
    leaf_column: str = "leaf",
    arity: int = ARITY,
    levels: int = LEVELS,
) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path``, the proof that a leaf belongs to the root.

    The leaves of a part ascend by ``order_column`` (null first; then by leaf). While a part has more
    than one node, every ``arity`` consecutive ones, the last run fewer, become the SHA-256 of their
    hex digests. The parts' subroots, by part (null first, then bytewise), become the root in
    the same way. ``path`` has a row per level from the leaf up: the digests ``left`` and ``right`` of
    the node in its run, joined. A part of one leaf has that as its subroot; one part's subroot is the
    root; no leaves, no rows. Repeated rows are leaves each.

    Each pass brings blocks of ``arity``^``levels`` nodes together, so a part of any size is spread
    over all tasks, and hands one node a block to the next pass. Texts take no part: leaves are
    digests. ``leaves`` must not have columns named tree, slot, n, node, block, path, upper, subroot, root.
    """
    part = F.col(part_column).cast("string")
    rows = stored(
        leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), part), F.lit(""))), "merkle-leaves"
    )
    placed = numbered(rows, ["tree"], [order_column, leaf_column])
    tables = _ladder(stored(placed.withColumn("node", F.col(leaf_column)), "merkle-slots"), arity, levels)
    none = F.array().cast("array<struct<left:string,right:string>>")

    parts = tables[-1].select("tree", F.col("node").alias("subroot"))
    trees = numbered(
        parts.select(F.lit("").alias("all"), F.col("tree").alias("part"), "subroot"), ["all"], ["part"]
    ).select(F.col("all").alias("tree"), "part", "subroot", "slot", "n", F.col("subroot").alias("node"))
    over = _ladder(stored(trees, "merkle-parts"), arity, levels)
    summit = over[-1].select("tree", F.lit(0).cast("bigint").alias("slot"), F.col("node").alias("root"), none.alias("path"))
    of_parts = _descended(over, summit, arity, levels).select(
        F.col("part").alias("tree"), F.lit(0).cast("bigint").alias("slot"), "subroot", "root", "path"
    )
    found = _descended(tables, of_parts, arity, levels)
    return found.select(*leaves.columns, "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(
        path, leaf, lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256)
    )


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and for each whether its row, tampered with where the
    checksum of its id says so, still leads to the root. A tampered number that is not an integer
    (the column may be text) or null stays as it is, and so does a row without an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {c: F.col(c) for c in FIELDS}
    more = (F.col("n_chars").try_cast("decimal(20,0)") + 1).cast("string")
    other = leaf_digest([more if c == "n_chars" else f for c, f in fields.items()])
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & more.isNotNull()
    leaves = docs.select(
        "doc_id", "lang", leaf_digest(list(fields.values())).alias("leaf"), F.when(hit, other).alias("tampered")
    )
    found = merkle_manifest(leaves, "lang", "doc_id")
    end = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), end.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# Unsigned CRC-32 of a text of ASCII characters: a number per character to take in, then eight
# shifts, each written as -1.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}) || ':' || {column}, '-')"


OP11_SQL = f"""
WITH RECURSIVE given AS (
    SELECT doc_id, lang, doc_id::VARCHAR AS f1, source::VARCHAR AS f2, lang::VARCHAR AS f3, n_chars::VARCHAR AS f4,
        text::VARCHAR AS f5, (TRY_CAST(n_chars AS DECIMAL(20, 0)) + 1)::VARCHAR AS more,
        {CRC32_SQL.format(text="doc_id::VARCHAR")} % {TAMPERED} = 0 AS hit
    FROM documents
), hashed AS (
    SELECT doc_id, lang,
        sha256({_field("f1")} || {_field("f2")} || {_field("f3")} || {_field("f4")} || {_field("f5")}) AS leaf,
        CASE WHEN hit AND more IS NOT NULL
            THEN sha256({_field("f1")} || {_field("f2")} || {_field("f3")} || {_field("more")} || {_field("f5")}) END AS tampered
    FROM given
), leaves AS (
    SELECT *, coalesce('=' || lang, '') AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot,
        count(*) OVER (PARTITION BY lang) AS n
    FROM hashed
), nodes AS (
    SELECT tree, 0 AS level, slot, n, leaf AS node FROM leaves
    UNION ALL
    SELECT tree, level + 1, slot // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY slot))
    FROM nodes WHERE n > 1 GROUP BY tree, level, slot // 2, n
), parts AS (
    SELECT tree, node AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS n
    FROM nodes WHERE n = 1
), summits AS (
    SELECT 0 AS level, slot, n, subroot AS node FROM parts
    UNION ALL
    SELECT level + 1, slot // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY slot))
    FROM summits WHERE n > 1 GROUP BY level, slot // 2, n
), steps AS (
    SELECT l.doc_id, l.leaf, l.tampered, l.tree, l.slot AS spot, o.level,
        (o.slot & 1) = 0 AS is_left, s.node AS sibling
    FROM leaves l JOIN nodes o ON o.tree = l.tree AND o.slot = l.slot >> o.level AND o.n > 1
    LEFT JOIN nodes s ON s.tree = o.tree AND s.level = o.level AND s.slot = xor(o.slot, 1)
    UNION ALL
    SELECT l.doc_id, l.leaf, l.tampered, l.tree, l.slot, p.height + o.level, (o.slot & 1) = 0, s.node
    FROM leaves l JOIN parts p USING (tree) JOIN summits o ON o.slot = p.slot >> o.level AND o.n > 1
    LEFT JOIN summits s ON s.level = o.level AND s.slot = xor(o.slot, 1)
), proofs AS (
    SELECT tree, spot, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof FROM steps GROUP BY tree, spot
), folds AS (
    SELECT tree, slot AS spot, 0 AS level, coalesce(tampered, leaf) AS node FROM leaves
    UNION ALL
    SELECT f.tree, f.spot, f.level + 1,
        sha256(CASE WHEN s.is_left THEN f.node || coalesce(s.sibling, '') ELSE coalesce(s.sibling, '') || f.node END)
    FROM folds f JOIN steps s ON s.tree = f.tree AND s.spot = f.spot AND s.level = f.level
)
SELECT l.doc_id, l.leaf, p.subroot, r.node AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
    f.node AS folded_root, f.node = r.node AS verified
FROM leaves l JOIN parts p USING (tree) JOIN summits r ON r.n = 1
LEFT JOIN proofs w ON w.tree = l.tree AND w.spot = l.slot
JOIN (SELECT tree, spot, arg_max(node, level) AS node FROM folds GROUP BY tree, spot) f ON f.tree = l.tree AND f.spot = l.slot
"""
