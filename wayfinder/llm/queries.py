"""The queries of this subpackage for the driver, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import fingerprints
from .html_extract import extracted
from .lm_score import pseudo_likelihood
from .mixing import mixed
from .near_dedup import near_duplicates
from .packing import pack
from .pii import personal_data
from .quality_crf import quality
from .quality_crf import train as train_quality
from .quality_rules import rule_quality
from .toxicity import toxicity
from .toxicity import train as train_toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), train_toxicity(spark, sf_dir))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), train_quality(spark, sf_dir))


def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_text, op2_personal_data, op3_best_two_fit, op4_toxicity, op5_quality_crf, op6_rule_quality, op7_mix_sources, op8_pseudo_likelihood, op9_near_dedup, op10_order_minhash)}

OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.root AS component_id, s.doc_id = r.root AS kept FROM sets s JOIN roots r USING (doc_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('0' || source, '1') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s1 AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight
  FROM d GROUP BY src),
s2 AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER o, 0) AS most_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM s1 WINDOW o AS (ORDER BY 3 * source_size * (10 // weight), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CAST(most AS HUGEINT) * (weights - weight_before) <= weight * (total - most_before) AS is_full FROM s2),
s4 AS (
  SELECT *, total - coalesce(sum(most) FILTER (is_full) OVER (), 0) AS rest_words, weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS rest_weight FROM s3),
s5 AS (
  SELECT src, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(rest_words AS DOUBLE) / CAST(greatest(rest_weight, 1) AS DOUBLE) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM s5),
r AS (
  SELECT d.doc_id, d.size, s6.source_size, s6.target, s6.epochs, CAST(floor(s6.target) AS BIGINT) - s6.epochs * s6.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN s6 USING (src))
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""

ORACLES: dict[str, str] = {"op7_mix_sources": OP7, "op9_near_dedup": OP9}
