"""Mixing sources to target weights: hash-random order within each source, prefix sums of sizes, an exact cut.

The order of a source is that of md5(doc_id, text), uniformly random, so the leading BUCKET_DIGITS hex digits split each
source into even ranges of that order without sampling. Sums of the ranges, then of the keys of the one range that holds the
cut, are the prefix sums: no task sorts or sums a whole source. What remains is a row per source: how many times all its
documents are taken, and the place up to which they are taken once more. Rows that repeat an id and a text share a key; of
those at the cut a row number says how far it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

#: Source weights by order of source, repeating, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
BUCKET_DIGITS = 3
#: Sources, of some 100 bytes each, whose plan goes to all tasks at most; parts of a source where there are more.
MOST_SENT, SALTS = 100_000, 64


def _source(source: str = "source") -> Column:
    """Sources in code point order, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of the id and the text; no id has a colon, so each pair has a string of its own but null, which is as ''."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, src, key, size) of each row: all that the plan needs, written once."""
    return checkpoint(docs.select("doc_id", _source().alias("src"), _key().alias("key"), n_words().alias("size")))


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target): weighted shares of all sizes, none above EPOCHS times its source.

    Sources are filled in the order of limit / weight. One stays at its limit if its weighted share of what the ones
    before it leave is at least that. All sums are whole numbers, so the result doesn't depend on their order. The
    windows below run over one row per source."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy("src")) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long")).withColumn("most", EPOCHS * F.col("source_size"))
    before = Window.orderBy((F.col("most") * 10 / F.col("weight")).cast("long"), "src").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    s = s.select("*", F.sum("source_size").over(everywhere).alias("total"), F.sum("weight").over(everywhere).alias("weights"), F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"))
    wide = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")
    full = (wide("most") * wide(F.col("weights") - F.col("weight_before"))) <= (wide("weight") * wide(F.col("total") - F.col("most_before")))
    s = s.withColumn("full", full)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everywhere), F.lit(0))
    share = F.col("weights") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everywhere), F.lit(0))
    rest = F.col("weight").cast("double") * left.cast("double") / F.greatest(share, F.lit(1)).cast("double")
    return s.select("src", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest).alias("target"))


def plan(sizes: DataFrame) -> DataFrame:
    """A row per source: (src, source_size, target, epochs, cut_key, cut_rows, cut_words, copies).

    Every document is taken `epochs` times; those before cut_key in order once more, of the `copies` rows there cut_rows
    whole, and of one more row cut_words words. The sum over a source is the whole part of its target."""
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sizes = sizes.withColumn("bucket", bucket)
    goal = targets(sizes).withColumn("quota", F.floor("target").cast("long"))
    goal = goal.withColumn("epochs", F.expr("CASE WHEN source_size > 0 THEN quota DIV source_size ELSE 0 END")).withColumn("rest", F.expr("quota - epochs * source_size"))
    order = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    crossed = parts.join(goal, "src").where("before <= rest AND rest < before + words").select("src", "bucket", "before", "rest")
    inside = Window.partitionBy("src").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    near = sizes.join(crossed, ["src", "bucket"]).groupBy("src", "key", "size", "before", "rest").agg(F.count("*").alias("copies"))
    near = near.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    cut = near.where("at <= rest AND rest < at + size * copies").select("src", F.col("key").alias("cut_key"), F.expr("(rest - at) DIV size").alias("cut_rows"), F.expr("(rest - at) % size").alias("cut_words"), "copies")
    return goal.join(cut, "src", "left").select("src", "source_size", "target", "epochs", "cut_key", "cut_rows", "cut_words", "copies")


def _planned(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows(src, key, size, ...) with their source's plan and once: the words that the last epoch takes of the row.

    The plan is sent to all tasks if a count says that it is small; otherwise it is repeated for SALTS parts of each source,
    so that no task gets a whole one. Only where several equal rows stand at a cut are those numbered."""
    p = checkpoint(plan(sizes))
    if p.count() <= MOST_SENT:
        joined = rows.join(F.broadcast(p), "src")
    else:
        salted = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["src", "salt"]).drop("salt")
    before, number = F.coalesce(F.col("key") < F.col("cut_key"), F.lit(False)), F.col("number")
    there = F.coalesce(F.col("key") == F.col("cut_key"), F.lit(False))
    once = F.when(before, F.col("size")).when(there & (number <= F.col("cut_rows")), F.col("size")).when(there & (number == F.col("cut_rows") + 1), F.col("cut_words")).otherwise(0)
    if p.where("copies > 1").isEmpty():
        return joined.withColumn("number", F.lit(1)).withColumn("once", once.cast("long"))
    equal = Window.partitionBy("src", "key").orderBy(F.lit(1))
    numbered = joined.where(there).withColumn("number", F.row_number().over(equal))
    return joined.where(~there).withColumn("number", F.lit(1)).unionByName(numbered).withColumn("once", once.cast("long"))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, text, source).

    Size: words of the text, 0 for null and blank texts, of which nothing is taken. Null sources are one source, the last.
    Null ids take part like others. Rows that repeat an id and a text are one place in the order, of which any rows are
    taken. Other columns are ignored; an empty table gives an empty result. Ids and texts alone decide the order, so reruns
    agree."""
    sizes = sized(docs)
    taken = F.col("epochs") * F.col("size") + F.col("once")
    return _planned(sizes, sizes).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix has them: once for each time taken, in the columns of docs.

    The copy at a source's cut ends after its last taken word; n_chars follows the text where there is such a column."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _source().alias("src"), _key().alias("key"), n_words().alias("size"))
    sizes = checkpoint(rows.select("src", "key", "size"))
    whole = F.col("once") == F.col("size")
    copies = F.array_repeat(F.lit(-1).cast("long"), (F.col("epochs") + F.when(whole, 1).otherwise(0)).cast("int"))
    part = F.when(~whole & (F.col("once") > 0), F.array("once")).otherwise(F.array().cast("array<long>"))
    out = _planned(rows, sizes).where("size > 0").select("row", F.explode(F.concat(copies, part)).alias("words"))
    space = r"[\x20\x09-\x0D]"
    cut = F.regexp_substr(F.col("row.text"), F.concat(F.lit(f"(?:{space}*+{WORD}+)"), F.lit("{"), F.col("words").cast("string"), F.lit("}+")))
    text = F.when(F.col("words") >= 0, cut).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("words") >= 0, F.length(cut)).otherwise(F.col("row.n_chars")).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
