"""The corpus pipeline: quality, near copies, benchmark leaks, then token ids. Each stage is written as Parquet and read back as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm import bpe, leaks, ngram_join, quality
from pairwell.session import stored

THRESHOLD = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3; the classifier learns from labelled documents of this stage's input outside the held-out fold."""
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, out="quality_score").where(F.col("quality_score") >= THRESHOLD).drop("quality_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles: the row with the smallest id, a null one last.

    Repeated rows and rows without id that copy a kept text go like other copies; of rows that share an id with different texts each group keeps its own.
    Documents without words are linked with nothing and all stay.
    """
    docs = docs.select(*COLUMNS)
    groups = ngram_join.linked_groups(docs, size=5, percent=80, groups=True)
    rows = groups.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "n"))
    linked = rows.where("group is not null").groupBy("group").agg(first.alias("first")).select("first.doc_id", "first.text_hash", "first.n")
    wordless = rows.where("group is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n"))
    kept = stored(linked.union(wordless), "near-kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n")
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]) & (F.xxhash64("text") == F.col("hash")))
    # of equal rows of one document, any: only documents that have some are grouped
    once = found.where("n = 1").select(*COLUMNS)
    return once.unionByName(found.where("n > 1").dropDuplicates(["doc_id", "hash"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with at most a fifth of the item edited."""
    marked = leaks.find(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).drop("leaks")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether they decode to the text."""
    columns = {"ids": ("array<int>", bpe.Coded.lists), "decoded": ("string", bpe.Coded.texts)}
    coded = bpe.transcode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), columns, batch_bytes=1 << 20)
    exact = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: SQL has no twin for training, walks and merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
