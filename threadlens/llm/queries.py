"""The subpackage's registered queries: thin bindings of operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (
    bitplane_kmeans,
    bpe_prefix,
    chat_format,
    deobfuscate,
    host_reputation,
    merkle_manifest,
    pairwise_rank,
    partenum_join,
    qgram_decontam,
    risk_rules,
    secret_parts,
    sliced_simhash,
    unigram_trie,
)
from threadlens.llm.common import per_worker, ready, table

# the guard conversation: both rows say this
GUARD_ID = -7
GUARD_TEXT = r"\### Assistant: </turn> ok"

URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed content parts: every conversation formatted, digests read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    guard = spark.range(2).select(
        F.lit(GUARD_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(GUARD_TEXT).alias("text"),
    )
    turns = rows.unionByName(guard).withColumn("parts", chat_format.text_part(F.col("text")))
    return chat_format.digest(chat_format.format_chat(turns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk-controlled thresholds: measures and verdict of every document."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    got = risk_rules.quality_rules(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return got.select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words",
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix dynamic programming: every document encoded and decoded again."""
    import public_tokenizers as vocabulary

    ready(spark)
    ranks = per_worker(spark, bpe_prefix.Ranks.load(vocabulary.path("byte_bpe_50k.tiktoken")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe_prefix.encode_texts(docs, ranks, vocabulary.PATTERN, back="decoded")
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _predicted(got: DataFrame, cut: float) -> DataFrame:
    return got.select(
        "doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= cut).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-channel deobfuscation: every document's toxicity."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predicted(deobfuscate.score_toxicity(docs, table(spark, sf_dir, "labels")), 0.3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry pairwise ranking: every document's quality."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predicted(pairwise_rank.rank_documents(docs, table(spark, sf_dir, "labels")), pairwise_rank.CUT)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PartEnum signatures: every document's near-duplicate component."""
    ready(spark)
    return partenum_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical-Bayes host reputation: every page's url judged."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = host_reputation.outcomes_from_labels(pages, table(spark, sf_dir, "labels"))
    return host_reputation.judge_urls(pages, outcomes, URL_RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-gram lemma filtering: every benchmark passage in every document, one row each."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = qgram_decontam.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", F.explode("_matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.end", "m.edits")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie-shared dynamic programming: unigram token counts of every document."""
    import public_tokenizers as vocabulary

    ready(spark)
    pieces = per_worker(spark, unigram_trie.Pieces.load(vocabulary.path("piece_bpe_32k.model")))
    got = unigram_trie.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    return got.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_tokens").alias("n_tokens"),
        F.col("_n_byte_tokens").alias("n_byte_tokens"),
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipart credential linking: every document's secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secret_parts.find_secrets(docs)
    return got.select(
        "doc_id",
        F.col("_n_assign").alias("n_assign"),
        F.col("_n_access").alias("n_access"),
        F.col("_n_hex").alias("n_hex"),
        F.sha2(secret_parts.listed(F.col("_base")), 256).alias("base_sha256"),
        secret_parts.listed(F.col("_spans")).alias("spans"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-forward processing: every document's leaf, proof and check against the root."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in merkle_manifest.FIELDS}
    tampered = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = merkle_manifest.leaf_digest([*values.values()])
    leaves = docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("key"), leaf.alias("leaf"),
        F.when(chosen, merkle_manifest.leaf_digest([*tampered.values()])).alias("changed"),
    )
    made = merkle_manifest.manifest(leaves, carry=("changed",)).withColumn("given", F.coalesce("changed", "leaf"))
    got = merkle_manifest.folded(made, "given")
    return got.select(
        F.col("key").alias("doc_id"),
        *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-plane popcount: every usable vector's cluster after five rounds."""
    ready(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got = bitplane_kmeans.with_inertia(*bitplane_kmeans.cluster(vectors))
    return got.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-sliced comparison: every document's fingerprint and near-duplicate component."""
    ready(spark)
    got = sliced_simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_url_filters": op7_url_filters,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scans": op10_secret_scans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_simhash_dedup": op13_simhash_dedup,
}
