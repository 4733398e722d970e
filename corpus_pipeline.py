"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; every stage but the last returns the
columns of ``documents``. Between stages the frame is written as Parquet and read again.

Defined cases: null texts count as empty; rows with a null id are never duplicates of others and
stay; a text that loses all its lines to earlier copies is dropped as a copy; rows that share an id but
not the text are documents of their own; empty tables pass. Input columns of any name are kept: columns
of a stage's own take names that the input does not have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, jaccard, lines, mixing, quality
from barloom.llm.common import shared_folder, table, text_of, unused
from barloom.llm.queries import GOOD, RANKS, quality_model


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return quality.score(docs, model, into=score).where(F.col(score) >= GOOD).drop(score)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeats of line runs out of the texts; a text of which nothing is left is dropped."""
    told = unused(docs, "_lines")
    done = lines.dedup_lines(docs, into=told)
    cut = F.col(f"{told}.removed") > 0
    emptied = cut & (F.length(F.trim("text")) == 0)
    return (
        done.where(~F.coalesce(emptied, F.lit(False)))
        .withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
        .select(*docs.columns)
    )


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by similar shingle sets, keep the one with the least id (then the
    least hash of id and text). Documents are told apart by id and text: rows that repeat an id are
    judged each by its own text, and only rows equal in both count once (that of least other columns)."""
    row = unused(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64("doc_id", text_of("text")))
    known = marked.where("doc_id IS NOT NULL")
    found = jaccard.similar_groups(known.select("text", row), key=row)
    named = found.join(known.select(row, "doc_id").distinct(), row)
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("_k")).select("_k.*")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.struct(*[F.col(c).cast("string") for c in rest]) if rest else F.lit(0)
    one = (
        known.join(kept, ["doc_id", row], "left_semi")
        .groupBy("doc_id", row)
        .agg(F.min_by(F.struct(*docs.columns), first).alias("_d"))
        .select("_d.*")
    )
    return one.unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into the order of the mix; the written files follow it, by name."""
    place = unused(docs, "_mix")
    mixed = mixing.mix(docs, into=place)
    return mixed.orderBy(f"{place}.slot", f"{place}.row").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with a digest of the bytes that decoding them gives, in the order of
    the mix. Files are read in any order, so the position is derived again, by the same seed. Rows are
    sorted before they are encoded: the sort's sampling would encode twice. One worker encodes and
    decodes."""
    docs = docs.select("doc_id", "text", "source")
    docs = mixing.mix(docs, into="_mix").orderBy("_mix.slot", "_mix.row")
    done = bpe.encode(docs, RANKS, into="_tokens", decoded=True)
    return done.select(
        "doc_id",
        "source",
        F.col("_tokens.n").alias("n_tokens"),
        F.col("_tokens.ids").alias("token_ids"),
        F.sha2("_tokens.ids", 256).alias("ids_sha256"),
        F.sha2("_tokens.decoded", 256).alias("decoded_sha256"),
        F.col("_mix.slot").alias("mix_slot"),
        F.col("_mix.row").alias("mix_row"),
    )


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables lie in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None
