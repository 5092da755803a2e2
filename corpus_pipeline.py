"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all documents that its predecessor kept, as a written table,
and all but the last return the columns of documents, extra ones included.

Defined cases, for every stage: null and empty texts are not toxic, have no
copies, hold no benchmark passage and no secret, and are packed as an end id
alone; very long texts are taken whole; null ids stay, without copies; rows
that repeat an id stay or go together as copies, and by their own texts
otherwise; ties for the document that stays of a group go to the smallest id;
extra columns may have any names; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import decontaminate, jaccard, packing, secrets, storage, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.7; it learns from the labelled documents still there."""
    return toxicity.accepted(docs, toxicity.fit(docs, storage.read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8."""
    return jaccard.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, storage.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    before = storage.free_name(docs, "before")
    out = secrets.redact(docs.withColumn(before, F.col("text")))
    size = F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", size).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 4096 tokens."""
    return packing.pack(packing.cut_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, tokens and packings have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    rows = storage.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows, _ = storage.materialize(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
