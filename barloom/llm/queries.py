"""The registered queries of the text operators: name -> (callable, SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    bpe,
    chat,
    hnsw,
    jaccard,
    kmeans_tree,
    lattice,
    lines,
    mixing,
    prefix_counts,
    quality,
    secret_scan,
    spelling,
    turn_trie,
)
from barloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

#: Where the vocabulary files lie.
RANKS = os.environ.get("BYTE_BPE_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY_FILE = os.environ.get("BYTE_BPE_JSON") or public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def register(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return put


@register("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: token count and digests of the ids and of the bytes."""
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    return bpe.decode(docs, RANKS).select(
        "doc_id",
        F.col("tokens.n").alias("n_tokens"),
        F.sha2("tokens.ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("tokens.n_split").alias("n_split_tokens"),
    )


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, from its counts at every prefix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_counts.prefix_counts(docs, LIBRARY_FILE).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        F.col("prefix.n").alias("n_tokens"),
        (F.col("prefix.n") > 1024).alias("over_limit"),
    )


#: Share of documents whose labels are never learnt from, as crc32(id) mod 5 = 0.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, false)"
GOOD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """The classifier as used in production: learnt from all rows that are not held out."""
    learn = ~F.expr(HELD_OUT)
    return quality.fit(docs.where(learn), labels.where(learn), trusted=F.col("quality") == 1)


@register("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; positives are the labelled good texts that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        F.expr(HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@register("op6_line_dedup", lines.dedup_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines in every document, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id",
        F.col("lines.total").cast("bigint").alias("n_lines"),
        F.col("lines.removed").cast("bigint").alias("n_removed"),
        F.col("lines.runs").alias("removed_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@register("op3_shingle_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and component of every document by shingle similarity."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )


@register("op7_mixing", mixing.mix_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot and window of every document in the mix of sources by tempered weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix.*")


@register("op8_chat_rotation", chat.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant, with the mask as text."""
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return chat.rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "speaker", "segment", "n_turns", "text", F.array_join(spans, ",").alias("mask"), "offset"
    )


@register("op5_secret_scan", secret_scan.scan_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; candidates that one source alone holds are added to the base spans."""
    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secret_scan.label(F.col("base")), 256).alias("base_sha256"),
        secret_scan.label(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


@register("op4_nearest_vectors")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    found, _ = kmeans_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found


@register("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9."""
    found, _ = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found


#: Documents that the word counts and weights of the language model are not learnt from.
UNSEEN = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2, false)"


@register("op11_lattice_score")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text by the subword lattice, beside an add-one word model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.score_texts(docs, PIECES, ~F.expr(UNSEEN)).select(
        "doc_id",
        (~F.col("learnt")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@register("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart and the common form each one leads to."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op13_turn_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))
