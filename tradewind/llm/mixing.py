"""Mixing sources to target weights by Sainte-Laguë apportionment, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.stored import stored

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
# Words the mix takes, as a share of all words, and the most that a source gives of its own.
SHARE = 1.5
MOST_TIMES = 2
# Words of a block, and the output shards that the blocks are dealt to.
BLOCK = 8
SHARDS = 16
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sources: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_times: int = MOST_TIMES,
) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Targets share ``share`` of all words by weight. A target above ``most_times`` its source's
    size stops there and the excess is shared again by weight until none is above: sources fill
    up in the order of size by weight, so one running sum finds who is full."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_code_point) - 1
    choice = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")
    )
    weighed = sources.withColumn("weight", choice.cast("bigint")).withColumn(
        "most", F.col("source_size") * most_times
    )
    fills = Window.orderBy(
        F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    full = weighed.withColumn("level", level).withColumn(
        "full", F.col("most") <= F.col("level") * F.col("weight")
    )
    # The first source that is not full has the level of all that follow it; theirs are lower.
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest * F.col("weight"))
    return full.withColumn("target", target).select("source", "source_size", "weight", "target")


def shard_quotas(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Blocks that each source gives to each shard: (source, shard, quota), whole numbers.

    Sainte-Laguë gives seat after seat to the source with the highest quotient
    target / (2 seats + 1). Its result for a number of seats is the rounding of target / divisor
    for a common divisor, and with n sources that divisor lies between total / (seats + n/2) and
    total / (seats - n/2). So each source surely has the seats of the large divisor, and only the
    few quotients up to the small one compete for what is left: about 2n rows for any number of
    blocks. More seats never take one away, so the shards are differences of running totals."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    votes = targets.where("target > 0").select(
        "source",
        F.col("target").alias("votes"),
        F.sum("target").over(everything).alias("total"),
        F.count("*").over(everything).alias("n"),
    )
    seats = F.round(F.col("total") / block).cast("bigint")
    houses = votes.withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn(
        "seats", F.floor(seats * F.col("house") / shards).cast("bigint")
    )

    def rounded(seats_of_divisor: Column) -> Column:
        return F.round(F.col("votes") * F.greatest(seats_of_divisor, F.lit(0.0)) / F.col("total"))

    bounds = houses.withColumn(
        "sure", F.greatest(rounded(F.col("seats") - F.col("n") / 2) - 1, F.lit(0)).cast("bigint")
    ).withColumn("most", rounded(F.col("seats") + F.col("n") / 2).cast("bigint") + 1)
    of_house = Window.partitionBy("house")
    left = F.col("seats") - F.sum("sure").over(of_house)
    rivals = (
        bounds.withColumn("left", left)
        .withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("most"))))
        .withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1))
    )
    highest = of_house.orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "seat")
    won = rivals.withColumn("won", (F.row_number().over(highest) <= F.col("left")).cast("bigint"))
    running = won.groupBy("source", "house").agg((F.max("sure") + F.sum("won")).alias("blocks"))
    so_far = Window.partitionBy("source").orderBy("house")
    before = F.coalesce(F.lag("blocks").over(so_far), F.lit(0))
    return running.select(
        "source", (F.col("house") - 1).alias("shard"), (F.col("blocks") - before).alias("quota")
    )


def _place(column: Column, seed: int) -> Column:
    """60 bits of a hash, so that the order is the same in every engine."""
    key = F.concat_ws(":", F.lit(str(seed)), column.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _sources(
    rows: DataFrame, block: int, shards: int, weights: tuple[int, ...], share: float, most_times: int
) -> DataFrame:
    """One row per source of ``rows`` (source, size): of, its number s, source_size, target, the words
    taken as whole rounds and a rest, the number of buckets, and ends, the running total of its
    blocks after each shard (null without blocks)."""
    n_buckets = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("rows"))))
    counted = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows")
    )
    targets = source_targets(counted.select("source", "source_size"), weights, share, most_times)
    so_far = Window.partitionBy("source").orderBy("shard")
    quotas = (
        shard_quotas(targets, block, shards)
        .withColumn("end", F.sum("quota").over(so_far))
        .groupBy(F.col("source").alias("quota_of"))
        .agg(F.max("end").alias("q"), F.array_sort(F.collect_list("end")).alias("ends"))
    )
    buckets = counted.select(F.col("source").alias("buckets_of"), n_buckets.cast("bigint").alias("buckets"))
    words = F.least(
        F.coalesce(F.col("q"), F.lit(0)) * block, F.col("source_size") * most_times
    ).cast("bigint")
    size = F.greatest(F.col("source_size"), F.lit(1))
    return stored(
        targets.join(quotas, F.col("source").eqNullSafe(F.col("quota_of")), "left")
        .withColumn("words", words)
        .withColumn("rounds", F.floor(F.col("words") / size).cast("bigint"))
        .withColumn("rest", F.col("words") - F.col("rounds") * size)
        .join(buckets, F.col("source").eqNullSafe(F.col("buckets_of")))
        .select(
            F.col("source").alias("of"),
            F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("s"),
            "source_size",
            "target",
            "rounds",
            "rest",
            "buckets",
            "ends",
        ),
        "mix-sources",
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_times: int = MOST_TIMES,
) -> DataFrame:
    """One row per input row with the number of its words that the mix takes.

    A source's documents follow each other in a seeded order and are cut into blocks of ``block``
    words. Its quota of blocks is taken from the front, again from the front once all are taken.
    So a row is taken whole so many times, and once more if it lies before the last block taken;
    the row on that border is taken in part. The border is found on sums of hash buckets, of
    which there are about as many as the square root of the rows; only the buckets that hold a
    border are sorted. No source, however large, meets in one task.

    A null text has no words and a null source is a source of its own, the last. Repeated rows
    count each. An empty table gives no rows; other columns are ignored, except those in ``carry``.

    Columns: the id column, size, source_size, target, taken, then ``carry``.
    """
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
        ),
        "mix-sizes",
    )
    sources = _sources(rows, block, shards, weights, share, most_times).drop("ends", "s")
    # Each source has about the square root of its rows as buckets; they follow each other.
    width = F.col("place") / F.lit(float(2**60)) * F.col("buckets")
    placed = (
        rows.join(sources, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("place", _place(F.col("id"), seed))
        .withColumn("bucket", F.floor(width).cast("bigint"))
    )
    sums = placed.groupBy("of", "bucket").agg(
        F.sum("size").alias("in_bucket"), F.first("rest").alias("rest")
    )
    in_order = Window.partitionBy("of").orderBy("bucket")
    # One row per source; its written size lets Spark send it to the rows instead of shuffling them.
    edges = stored(
        sums.withColumn("end", F.sum("in_bucket").over(in_order))
        .where((F.col("end") - F.col("in_bucket") <= F.col("rest")) & (F.col("rest") < F.col("end")))
        .select(
            F.col("of").alias("edge_of"),
            F.col("bucket").alias("edge"),
            (F.col("end") - F.col("in_bucket")).alias("before"),
        ),
        "mix-edges",
    )
    known = placed.join(edges, F.col("of").eqNullSafe(F.col("edge_of")), "left")
    once = F.col("rounds") * F.col("size")
    clear = known.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn(
        "taken", once + F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0)
    )
    order = Window.partitionBy("of").orderBy("place", "id", *[f"carry_{i}" for i in range(len(carry))])
    end = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = F.least(F.greatest(F.col("rest") - (end - F.col("size")), F.lit(0)), F.col("size"))
    border = known.where(F.col("bucket") == F.col("edge")).withColumn("taken", once + part)
    return clear.unionByName(border).select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        F.col("taken").cast("bigint").alias("taken"),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Written rows (row, id, source, size); the row numbers tell rows of one id apart."""
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
        ),
        "mix-rows",
    )


def _ordered(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's columns and begin, the words before them in its seeded order. The
    sums of hash buckets are added up, and each bucket is sorted by itself."""
    width = F.col("place") / F.lit(float(2**60)) * F.col("buckets")
    placed = (
        rows.join(sources, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("place", _place(F.col("id"), seed))
        .withColumn("bucket", F.floor(width).cast("bigint"))
    )
    in_order = Window.partitionBy("s").orderBy("bucket")
    before = stored(
        placed.groupBy("s", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(in_order) - F.col("in_bucket"))
        .select(F.col("s").alias("of_s"), F.col("bucket").alias("of_bucket"), "before"),
        "mix-buckets",
    )
    order = Window.partitionBy("s", "bucket").orderBy("place", "id", "row")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return stored(
        placed.withColumn("inside", inside)
        .join(before, (F.col("s") == F.col("of_s")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("begin", F.col("before") + F.col("inside"))
        .select("row", "id", "source", "s", "size", "source_size", "rounds", "rest", "ends", "begin"),
        "mix-ordered",
    )


def _dealt(rows: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(row, id, source, shard, block, first, words) of the blocks taken; see ``deal_blocks``."""
    start = F.col("round") * F.col("source_size") + F.col("begin")
    words = F.col("rounds") * F.col("source_size") + F.col("rest")
    opens = F.col("block") * block
    first = F.greatest(opens, F.col("start"))
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("source"), F.col("block")), 4)
    blocks = F.element_at("ends", -1)
    n_buckets = F.ceil(F.sqrt(blocks))
    pieces = (
        _ordered(rows, sources, seed)
        .where("ends is not null and size > 0")
        .withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rounds"))))
        .withColumn("start", start)
        .withColumn("stop", F.least(F.col("start") + F.col("size"), words))
        .where("stop > start")
        .withColumn("block", F.explode(F.sequence(
            F.floor(F.col("start") / block).cast("bigint"),
            F.floor((F.col("stop") - 1) / block).cast("bigint"),
        )))
        .withColumn("rank", rank)
    )
    # Each block once: in the row that its first word is in.
    opened = pieces.where(opens >= F.col("start")).select(
        "s",
        "block",
        "rank",
        F.floor(F.col("rank") / F.lit(float(2**60)) * n_buckets).cast("bigint").alias("bucket"),
    )
    in_order = Window.partitionBy("s").orderBy("bucket")
    below = (
        opened.groupBy("s", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("below", F.sum("n").over(in_order) - F.col("n"))
    )
    ends = sources.select(F.col("s").alias("ends_s"), F.posexplode("ends").alias("shard", "end"))
    # A shard begins at the block whose place by rank is the end of the shard before it; only the
    # buckets that hold such a block are sorted.
    begins = stored(
        below.join(
            ends,
            (F.col("s") == F.col("ends_s"))
            & (F.col("below") <= F.col("end"))
            & (F.col("end") < F.col("below") + F.col("n")),
        ).select(
            F.col("s").alias("of_s"),
            F.col("bucket").alias("of_bucket"),
            (F.col("end") - F.col("below") + 1).alias("nth"),
        ),
        "mix-begins",
    )
    held = begins.select("of_s", "of_bucket").distinct()
    same = (F.col("s") == F.col("of_s")) & (F.col("bucket") == F.col("of_bucket"))
    by_rank = Window.partitionBy("s", "bucket").orderBy("rank", "block")
    sorted_blocks = opened.join(F.broadcast(held), same, "left_semi").withColumn(
        "place", F.row_number().over(by_rank)
    )
    cuts = stored(
        sorted_blocks.join(begins, same & (F.col("place") == F.col("nth")))
        .groupBy(F.col("s").alias("cuts_s"))
        .agg(F.collect_list(F.struct("rank", "block")).alias("cuts")),
        "mix-cuts",
    )
    after = F.filter(
        "cuts",
        lambda c: (c["rank"] < F.col("rank"))
        | ((c["rank"] == F.col("rank")) & (c["block"] <= F.col("block"))),
    )
    return pieces.join(F.broadcast(cuts), F.col("s") == F.col("cuts_s"), "left").select(
        "row",
        "id",
        "source",
        F.coalesce(F.when(F.col("cuts").isNotNull(), F.size(after)), F.lit(0)).alias("shard"),
        "block",
        (first - F.col("start")).alias("first"),
        (F.least(opens + block, F.col("stop")) - first).alias("words"),
    )


def deal_blocks(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = SEED,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_times: int = MOST_TIMES,
) -> DataFrame:
    """The blocks of the mix and the shard each is dealt to, one row per block and input row.

    A source's blocks are numbered along the seeded order of its documents, and on through the
    next round of it; those up to its quota are taken, which are the words that ``mix`` counts.
    Each has a seeded rank, a hash of source and block. By rank, the first go to shard 0, as many
    as its quota there, the next to shard 1 and so on. The ranks that part the shards are found on
    sums of rank buckets, so no source's blocks meet in one task.

    A block that goes over the end of a document has a row in each. ``first`` counts the words of
    the document before the part. Where a source is taken ``most_times`` whole, its words may end
    before its quota does: the last block is short then, and the last shards may miss blocks.

    Columns: the id column, the source column, shard, block, first, words."""
    rows = _sized(docs, id_column, text_column, source_column)
    sources = _sources(rows, block, shards, weights, share, most_times)
    return _dealt(rows, sources, block, seed).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "shard",
        "block",
        "first",
        "words",
    )


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Deals the blocks, writes them, and counts the words taken of each document from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = _sized(docs, "doc_id", "text", "source")
    sources = _sources(rows, BLOCK, SHARDS, WEIGHTS, SHARE, MOST_TIMES)
    dealt = stored(_dealt(rows, sources, BLOCK, SEED), "mix-blocks")
    taken = dealt.groupBy(F.col("row").alias("taken_row")).agg(F.sum("words").alias("taken"))
    return (
        rows.join(sources, F.col("source").eqNullSafe(F.col("of")))
        .join(taken, F.col("row") == F.col("taken_row"), "left")
        .select(
            F.col("id").alias("doc_id"),
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        )
    )


OP8_SQL = rf"""
WITH rows AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM rows GROUP BY source
), levels AS (
    SELECT *, {MOST_TIMES} * source_size AS most,
        ((sum(source_size) OVER ())::DOUBLE * {SHARE}
            - coalesce(sum({MOST_TIMES} * source_size) OVER (fills ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (fills ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM sources WINDOW fills AS (ORDER BY source_size / weight, source NULLS LAST)
), targets AS (
    SELECT source, source_size,
        CASE WHEN most <= level * weight THEN most::DOUBLE
            ELSE max(CASE WHEN most > level * weight THEN level END) OVER () * weight END AS target
    FROM levels
), quotients AS (
    SELECT source, target / (2 * unnest(range(0, ceil(target / {BLOCK})::BIGINT + 2)) + 1) AS quotient
    FROM targets WHERE target > 0
), seats AS (
    SELECT source, count(*) AS blocks FROM (
        SELECT source, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST) AS place FROM quotients
    ) WHERE place <= (SELECT round(sum(target) / {BLOCK}) FROM targets) GROUP BY source
), words AS (
    SELECT t.*, least(coalesce(blocks, 0) * {BLOCK}, {MOST_TIMES} * source_size)::BIGINT AS words
    FROM targets t LEFT JOIN seats s ON t.source IS NOT DISTINCT FROM s.source
), placed AS (
    SELECT doc_id, size, source_size, target,
        words // greatest(source_size, 1) AS rounds, words % greatest(source_size, 1) AS rest,
        sum(size) OVER (PARTITION BY r.source
            ORDER BY ('0x' || substr(md5('{SEED}:' || doc_id), 1, 15))::BIGINT, doc_id
            ROWS UNBOUNDED PRECEDING) - size AS before
    FROM rows r JOIN words w ON r.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (rounds * size + least(greatest(rest - before, 0), size))::BIGINT AS taken
FROM placed
"""
