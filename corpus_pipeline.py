"""Corpus pipeline: quality, near copies, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage reads
it; all but the last return the columns of ``docs``. Rows with null or empty texts pass every stage that
finds nothing in them; empty tables stay empty. Columns of ``docs`` may have any names: an operator sees ``doc_id``, ``text`` and
numbered others, so none of its own names meets one of theirs; the columns that the last stage adds are ``ids`` and ``round_trip``,
or names with underscores around them where ``docs`` has these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import jaccard, piece_lattice, pii, quality, simhash, suffixes
from spanweave.llm.names import free_name
from spanweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text")


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with numbered names for all columns but the id and the text."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"other{i}") for i, c in enumerate(docs.columns)])


def as_before(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, from rows made of :func:`apart`."""
    return [F.col(c if c in OWN else f"other{i}").alias(c) for i, c in enumerate(docs.columns)]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(apart(docs), quality.fit(apart(docs), labels))
    return scored.where(F.col("__score") >= 0.5).select(*as_before(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies: texts that share four fifths of their 5-word shingles, or whose
    fingerprints differ in at most 2 bits, as op7 finds them."""
    return simhash.keepers_of(docs, jaccard.near_duplicates(docs, also=simhash.near_duplicates))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = suffixes.judge(apart(docs), benchmark)
    return judged.where(~F.col("__found.contaminated")).select(*as_before(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind; n_chars follows the text."""
    found = pii.spans(apart(docs), pii.train(apart(docs)))
    redacted = found.withColumn("text", pii.redact(F.col("text"), F.col("__spans"))).select(*as_before(docs))
    return redacted.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else redacted


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they decode to it."""
    import public_tokenizers

    pieces = piece_lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = piece_lattice.encode(apart(docs), pieces, verify=True)
    ids, whole = (n if n not in docs.columns else free_name(n, docs.columns) for n in ("ids", "round_trip"))
    return encoded.select(*as_before(docs), F.col("__ids").alias(ids), F.col("__whole").alias(whole))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter), ("near_copies", near_copies), ("decontaminate", decontaminate),
    ("personal_data", personal_data), ("encode", encode),
]
#: learned models and xxhash shingles are not expressible in SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
