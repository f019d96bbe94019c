"""A corpus pipeline of five stages over ``documents``.

Every stage works on all rows its predecessor kept and returns them with the columns of ``documents``
(the last one returns the encoded texts). Ids name documents: rows that repeat an id and a
text are one document. Nulls, empty tables and further columns: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import chosenpath, decontam, langid, lines, pieces
from tracewell.llm.shared import forget, written


#: Bytes of the documents that a stage hands to a Python worker at once.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts are bounded in bytes: at Spark's 10,000 rows, each task's share of the corpus was one batch, held by the worker and by the JVM.

    This lowers the session's setting, as a stage's plan runs after the stage has returned; no result depends on it.
    """
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(_LIMIT)) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (null or letterless texts) go."""
    small_batches(spark)
    return langid.identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; so do documents that lose all their text by it."""
    small_batches(spark)
    n, removed = (next(c for c in (name + "_" * k for k in range(len(docs.columns) + 1)) if c not in docs.columns) for name in ("__n", "__removed"))
    out = lines.dedup_lines(docs, names=(n, removed))
    out = out.filter((F.col(removed) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join stays, that of the smallest id; a document is an id and a text."""
    small_batches(spark)
    kept = chosenpath.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.expr(chosenpath.TEXT_HASH).eqNullSafe(F.col("__hash"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    small_batches(spark)
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, and whether they decode to its text."""
    small_batches(spark)
    both = pieces.round_trip(docs)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("ngram_join", near_dedup),
    ("decontamination", decontamination),
    ("pieces", encoding),
]

#: Suffix automata, edit distance joins, components and sampling are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(spark, before)
        before = docs
    return docs
