"""Shared pieces of the corpus operators: checkpoints, whole-table reads and Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..session import checkpoint, shared_folder

__all__ = ["BLOCK_BYTES", "WORD", "checkpoint", "chunks", "held_out", "labelled_sample", "let", "shared_folder", "slices", "table"]
#: Words everywhere in this subpackage: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy block works on; longer documents make a block of their own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows whose labels stay unseen: crc32 of doc_id as text, modulo modulus; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks and would keep the most that they ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with at most about `most` bytes of text each, and their texts ('' for null)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        begin = size = 0
        for i, n in enumerate([*pc.fill_null(pc.binary_length(column), 0).to_pylist(), most + 1]):
            if (size and size + n > most) or i == len(column):
                yield batch.slice(begin, i - begin), ["" if t is None else t for t in column.slice(begin, i - begin).to_pylist()]
                begin, size = i, 0
            size += n
    _give_back()


def chunks(texts: list[str], most: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The texts in order, in lists of about `most` bytes at most."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if texts:
        yield texts[begin:]


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, modulus: int, remainder: int, most: int) -> list[tuple[str, int]]:
    """Up to `most` (text, label) rows that aren't held out, half of them of either label if there are as many, in a fixed
    pseudo-random order that ids alone decide.

    Only here is anything sampled, for fitting a classifier; `most` bounds what reaches the driver."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    labels = labels.withColumn("at", F.xxhash64("doc_id"))
    half = [labels.where(F.col("label") == y).orderBy("at", "doc_id").limit(most // 2) for y in (0, 1)]
    chosen = half[0].union(half[1])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(F.broadcast(chosen), "doc_id").select("at", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return [(r.text, int(r.label)) for r in sorted(rows.toLocalIterator(), key=lambda r: (r.at, r.doc_id, r.label, r.text))]
