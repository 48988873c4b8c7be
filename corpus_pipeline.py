"""From raw documents to shuffled token shards, in five stages.

Each stage reads what the one before it wrote and returns the columns of ``documents``; the last one
writes the shards and returns a row per sequence. Rows with a null text go through the first
three stages (they are neither toxic, nor copies, nor contaminated) and leave in the mix, which
takes words. An empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.decontaminate import find_passages
from tradewind.llm.mixing import SPACE, WORD, mix
from tradewind.llm.ngram_join import near_groups
from tradewind.llm.stored import stored
from tradewind.llm.token_shards import materialised
from tradewind.llm.toxicity import PREDICTED, fit_on, score


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no operator uses for its own columns, and those names."""
    names = {c: "doc_id" if c == "doc_id" else f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def _named(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not predict toxic."""
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names = _numbered(docs)
    others = tuple(n for n in names.values() if n != "doc_id")
    scored = score(rows, model, text_column=names["text"], carry=others)
    return _named(scored.where(F.col("score") < PREDICTED), names)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are linked by a similarity of 0.8 or more, directly or through
    others, the one with the smallest id. Rows that share an id stay together, each text once; a
    missing id stays unless it is linked to one that is there."""
    groups = near_groups(docs)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias("stays")
    )
    first = docs.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    return first.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item: ten words in a row, or the whole item if it
    has fewer. So an item of one or two words, such as a short answer, drops every document that has
    these words in a row, however common they are. Items that must not do that are for the caller
    to leave out of the benchmark: a short item's leak cannot be told from chance here."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names = _numbered(docs)
    others = tuple(n for n in names.values() if n != "doc_id")
    found = find_passages(rows, benchmark, text_column=names["text"], carry=others)
    return _named(found.where("n_hit = 0"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document as often as it is taken whole, and the one on its
    source's border once more with its first words alone, as far as they are taken. The spaces
    between words stay; ``n_chars``, where there is one, is that of the cut text."""
    rows, names = _numbered(docs)
    others = tuple(n for n in names.values() if n != "doc_id")
    mixed = mix(rows, text_column=names["text"], source_column=names["source"], carry=others)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = F.sequence(F.lit(1), F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0))
    repeated = (
        mixed.where("taken > 0")
        .withColumn("whole", whole)
        .withColumn("part", part)
        .withColumn("copy", F.explode(copies))
    )
    text = F.col(names["text"])
    words = F.regexp_extract_all(text, F.lit(rf"{SPACE}*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("part")), "")
    is_cut = F.col("copy") > F.col("whole")
    parted = repeated.withColumn(names["text"], F.when(is_cut, cut).otherwise(text))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        chars = F.col(names["n_chars"])
        parted = parted.withColumn(
            names["n_chars"], F.when(is_cut, F.length(text).cast(kind)).otherwise(chars)
        )
    return _named(parted, names)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per sequence of the token shards."""
    return materialised(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

# The classifier and the tokenizer are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
