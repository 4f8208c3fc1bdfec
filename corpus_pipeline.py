"""A corpus pipeline of five stages: quality, near-duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.llm.common import shared_folder, table
from wayfinder.llm.mixing import mixture
from wayfinder.llm.near_dedup import near_duplicates
from wayfinder.llm.packing import pack
from wayfinder.llm.pii import redacted
from wayfinder.llm.quality_crf import train, with_quality
from wayfinder.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of at least 0.5 by the line CRF; a null text is judged as an empty one."""
    scored = with_quality(docs, train(spark, sf_dir))
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id; rows without an id stay.

    Rows of one id are one document; of a kept one every different text stays, once. Of rows that repeat an id and a text the
    one whose other columns are least stays, so reruns agree."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", *[F.col(f"`{c}`") for c in rest])
    once = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("__hash"), F.crc32(F.col("text").cast("binary")).alias("__crc")).agg(F.min(row).alias("__row"))
    once = once.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    return once.union(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts replaced by its kind."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; documents without words go."""
    return mixture(docs)


def best_two_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", best_two_fit),
]
#: The CRF, SuperMinHash and the tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents; what goes between stages is written to the shared folder."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        place = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4()}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
