"""The corpus pipeline: documents to token ids in five stages.

Every stage is a function of (spark, docs, sf_dir) that works on all its predecessor
kept; ``run`` writes each stage's result as Parquet to the shared folder that the session
names and reads it again for the next.  All but the last return the columns of
``documents``.

Defined cases: an empty table passes through; nulls, empty texts, repeated rows and
extra columns, of whatever name, are handled as each operator's docstring says.  Rows with a null id are
no near-duplicates of anything.  Of rows that share the id of the one document kept of a
group, all stay that have that id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import bpe_prefix, partenum_join, qgram_decontam, risk_rules, secret_parts
from threadlens.llm.common import mark_of, per_worker, ready, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (2): documents that the base or the certified rules reject go."""
    ready(spark)
    judged = risk_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.where(mark_of(docs) + "kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (6): of each group the document with the smallest id stays."""
    ready(spark)
    got = partenum_join.near_duplicates(docs.select("doc_id", "text"))
    gone = got.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (8): documents with a benchmark passage go."""
    ready(spark)
    found = qgram_decontam.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(mark_of(docs) + "matches") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (10): every reported span is replaced by a mark; ``n_chars`` follows."""
    found = secret_parts.find_secrets(docs)
    spans = mark_of(docs) + "spans"
    clean = found.withColumn("text", secret_parts.redacted(F.col("text"), F.col(spans)))
    changed = F.size(spans) > 0
    return clean.withColumn(
        "n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    ).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (3): the token ids of every text, checked against its decoding."""
    import public_tokenizers as vocabulary

    ready(spark)
    ranks = per_worker(spark, bpe_prefix.Ranks.load(vocabulary.path("byte_bpe_50k.tiktoken")))
    got = bpe_prefix.encode_texts(docs.select("doc_id", "lang", "source", "text"), ranks, vocabulary.PATTERN, out="_ids", back="_back")
    return got.select(
        "doc_id", "lang", "source", F.size("_ids").cast("long").alias("n_tokens"),
        (F.col("_back") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("exact"),
        F.col("_ids").alias("token_ids"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("byte_bpe", tokens),
]

# the joins, alignments and encodings are not expressible in SQL; see the brute-force test
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again; what a stage stored on its way is
    freed when its result is written."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
