"""Token counts as rollups that signed changes keep up to date."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.files import opened
from tradewind.llm.tokens import encoder
from tradewind.llm.words import blocks
from tradewind.llm.words import text_column as strings
from tradewind.session import shared_folder

VERSIONS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

_COUNTS = "id bigint, version string, source string, lang string, present boolean, tokens bigint, chars bigint"
_DELTAS = "source string, lang string, version string, documents bigint, tokens bigint, chars bigint"


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``token_counts``, one number per version, and ``chars``, its
    code points. A null text has none of either."""
    rest = [c for c in docs.columns if c != text_column]
    rows = docs.select(
        F.struct(*[F.col(c) for c in rest]).alias("kept"),
        F.col(text_column).alias("text"),
        F.length(F.coalesce(F.col(text_column), F.lit(""))).cast("bigint").alias("chars"),
    )

    def count(batches):
        for batch in batches:
            table = np.zeros((batch.num_rows, len(versions)), np.int64)
            for low, high, buf, bounds in blocks(strings(batch, "text")):
                for k, version in enumerate(versions):
                    _, at = encoder(version).encode(buf, bounds)
                    table[low:high, k] = np.diff(at)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(versions)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kept"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel())),
                    batch.column("chars"),
                ],
                ["kept", "token_counts", "chars"],
            )

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(count, f"kept {kind}, token_counts array<bigint>, chars bigint").select(
        "kept.*", "token_counts", "chars"
    )


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that the cluster shares.

    Each batch of changes is committed under its number: the counts of its documents and, from
    them and the counts before, what it adds to each total. Totals are the sums of all batches, so
    no document is counted twice to keep them. A batch that is delivered again changes nothing and
    costs nothing; one whose commit broke off is not there and replaces what it left. Batches go in
    order: a number below the last is only accepted if it is there already.

    A change is a row (id, source, lang, kind, text), kind ``put`` (insert or revise) or
    ``delete``. Of several rows with one id in a batch a put beats a delete, then the greatest
    text. Deletes of unknown documents and rows without an id change nothing. A null source or language is a
    group of its own; a null text has 0 tokens."""

    def __init__(self, spark: SparkSession, folder: str, versions: tuple[str, ...] = VERSIONS) -> None:
        self.spark, self.folder, self.versions = spark, folder, versions

    def batches(self) -> list[int]:
        """Numbers of the committed batches: those whose totals are complete."""
        import pyarrow.fs as fs

        system, path = opened(f"{self.folder}/deltas")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        names = [info.path.split("/") for info in found if info.base_name == "_SUCCESS"]
        return sorted(int(name[-2].partition("=")[2]) for name in names)

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([], f"{schema}, batch bigint")
        for batch in batches:
            part = self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/batch={batch}")
            rows = rows.unionByName(part.withColumn("batch", F.lit(batch).cast("bigint")))
        return rows

    def counts(self, before: int | None = None) -> DataFrame:
        """The present documents with their counts, one row per version."""
        batches = [b for b in self.batches() if before is None or b < before]
        rows = self._read("counts", _COUNTS, batches)
        state = F.struct("source", "lang", "present", "tokens", "chars")
        last = rows.groupBy("id", "version").agg(F.max_by(state, "batch").alias("last"))
        return last.select("id", "version", "last.*").where("present").drop("present")

    def commit(self, batch: int, changes: DataFrame) -> None:
        known = self.batches()
        if batch in known:
            return
        if known and known[-1] > batch:
            raise ValueError(f"batch {known[-1]} is already there")
        put = F.col("kind") == "put"
        texts = changes.where("id IS NOT NULL").select(
            F.col("id").cast("bigint").alias("id"), "source", "lang", put.alias("present"),
            F.when(put, F.col("text")).alias("text"),
        )
        each = counted(texts, self.versions)
        rank = F.struct("present", "chars", "token_counts", "source", "lang")
        one = each.groupBy("id").agg(F.max(rank).alias("row")).select("id", "row.*")
        version = F.array(*[F.lit(v) for v in self.versions])
        pairs = F.explode(F.arrays_zip(version.alias("version"), F.col("token_counts").alias("tokens")))
        rows = one.select("id", "source", "lang", "present", "chars", pairs.alias("pair")).select(
            "id", "pair.version", "source", "lang", "present", "pair.tokens", "chars"
        )
        path = f"{self.folder}/counts/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(_COUNTS).parquet(path)
        old = self.counts(before=batch).join(new.select("id", "version"), ["id", "version"], "left_semi")
        signed = new.where("present").select(
            "source", "lang", "version", F.lit(1).alias("sign"), "tokens", "chars"
        ).unionByName(
            old.select("source", "lang", "version", F.lit(-1).alias("sign"), "tokens", "chars")
        )
        deltas = signed.groupBy("source", "lang", "version").agg(
            F.sum("sign").cast("bigint").alias("documents"),
            F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("sign") * F.col("chars")).alias("chars"),
        )
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens, chars: the sums over all batches."""
        sums = self._read("deltas", _DELTAS, self.batches()).groupBy("source", "lang", "version").agg(
            *[F.sum(c).alias(c) for c in ("documents", "tokens", "chars")]
        )
        return sums.where("documents <> 0")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in; those whose white space is not single
    spaces are revised to it; those labelled of low quality go. The second batch is delivered once
    more in between and at the end. No batch shuffles texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), "source", "lang", "text")
    plain = F.trim(F.regexp_replace("text", r"[ \t\n\x0b\f\r]+", " "))
    revised = rows.withColumn("plain", plain).where("plain <> text").select(
        "id", "source", "lang", F.lit("put").alias("kind"), F.col("plain").alias("text")
    )
    low = labels.where("quality = 0").select(F.col("doc_id").alias("id")).distinct()
    gone = rows.select("id", "source", "lang").join(low, "id").select(
        "id", "source", "lang", F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("text")
    )
    rollup = TokenRollup(spark, shared_folder(spark, "token-counts"))
    rollup.commit(1, rows.withColumn("kind", F.lit("put")))
    rollup.commit(2, revised)
    rollup.commit(2, revised)
    rollup.commit(3, gone)
    rollup.commit(2, revised)
    return rollup.totals()
