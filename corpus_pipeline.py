"""A corpus pipeline of four stages: drop bad text, keep one of each group of near copies, cut repeats, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import ngram_join, packing, quality, repeats
from tidewell.llm.common import prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 7), trained on the labelled documents, doesn't reject."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.75 (operator 2): the one of smallest id.

    Of equal rows with one id one stays. Different texts under one id stay or go each with its own group; of a group all
    texts under its smallest id stay, and so do rows without an id.
    """
    prepare(spark)
    kept = ngram_join.join(docs, hashed=True).where("doc_id = component_id").select("doc_id", F.col("text_hash").alias("__text")).distinct()
    return docs.where("doc_id is null").select(*COLUMNS).union(docs.withColumn("__text", F.xxhash64("text")).join(kept, ["doc_id", "__text"]).dropDuplicates(["doc_id", "__text"]).select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters that 200-byte strings found more than once cover whole (operator 9); those left empty go."""
    prepare(spark)
    cut = repeats.dedup(docs, carry=tuple(c for c in COLUMNS if c != "text"), whole_characters=True, keep_text=True)
    return cut.where(F.length("kept") > 0).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens (operator 1), as pieces with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]
#: No SQL can express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet to the session's checkpoint folder and read again.

    A stage's files are removed once the next one's are written; those that the last stage reads stay for its result.
    """
    prepare(spark)
    docs, last = table(spark, sf_dir, "documents"), ""
    base = spark.sparkContext.getCheckpointDir()
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}-{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
