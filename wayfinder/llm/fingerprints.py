"""Order MinHash fingerprints, in DataFrame expressions only.

The k-mers of a text are its runs of K words, each with its occurrence number, so that repeats differ. A hash of both ranks
them; every slot has a permutation of its own, the rank XOR the slot's number in the leading SLOT_BITS bits. A slot selects
its TAKEN least k-mers, puts them back in text order and hashes them as a tuple: equal slots mean equal k-mers in equal
order. Likeness is the share of equal slots.

One sort serves all slots: a slot's least k-mers are those with its number in the rank's leading bits. Only where fewer than
TAKEN have it are the others compared, of which the TAKEN least of each number are enough. What is hashed doesn't depend on
the text's length; the low bits of ranks only give way to places for sorting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let

K, TAKEN = 3, 2
SLOT_BITS = 6
#: Rows that a range of ids aims at, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4096, 65_536


def fingerprint(text: Column) -> Column:
    """Of each slot, in order, a long: the slot in its leading SLOT_BITS bits, then the hash of its tuple.

    A text of fewer than K words is one k-mer; one without words has no slots. A text of one k-mer has tuples of one."""
    shift = 64 - SLOT_BITS
    slot = lambda x: F.shiftright(x, shift)

    def of(words: Column) -> Column:
        kmer = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])
        n = F.greatest(F.size(words) - (K - 1), F.lit(1))
        # the low bits of a long that hold a place; bound once, as lambdas work out all that they name for each element
        bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + 1)).cast("int")) - 1
        kmers = F.transform(F.sequence(F.lit(0), n - 1), kmer)
        many = let(bits, lambda mask: let(F.bitwise_not(mask), lambda top: let(kmers, lambda k: ranked(F.transform(k, lambda x, i: x.bitwiseAND(top).bitwiseOR(i)), n, mask, top, lambda i: F.get(k, i)))))
        only = F.xxhash64(F.array_join(words, " "))
        few = let(F.lit(1).cast("long"), lambda mask: let(F.bitwise_not(mask), lambda top: ranked(F.array(only.bitwiseAND(top)), F.lit(1), mask, top, lambda i: only)))  # noqa: ARG005
        return F.when(F.size(words) >= K, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))

    def ranked(packed: Column, n: Column, mask: Column, top: Column, kmer: Callable[[Column], Column]) -> Column:
        def numbered(s: Column) -> Column:
            # s: hash above place, sorted; a run of equal hashes is one k-mer, its members' numbers go from 0
            begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i - 1).bitwiseXOR(F.get(s, i)).bitwiseAND(top) != 0))
            numbers = let(begins, lambda b: F.flatten(F.transform(b, lambda r, j: F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), n) - r - 1))))
            ranks = let(numbers, lambda k: F.transform(s, lambda x, i: F.xxhash64(kmer(x.bitwiseAND(mask).cast("int")), F.get(k, i)).bitwiseAND(top).bitwiseOR(x.bitwiseAND(mask))))
            return let(F.sort_array(ranks), selected)

        def selected(r: Column) -> Column:
            return let(F.filter(r, lambda x, i: (i < TAKEN) | (slot(F.get(r, i - TAKEN)) != slot(x))), tuples)

        def tuples(m: Column) -> Column:
            at = lambda x: x.bitwiseAND(mask).cast("int")
            low = F.lit((1 << shift) - 1).cast("long")

            def tagged(s: Column, pair: Column) -> Column:
                return F.call_function("shiftleft", s, F.lit(shift)).bitwiseOR(pair.bitwiseAND(low))

            def pair(a: Column, b: Column) -> Column:
                return F.xxhash64(kmer(F.least(at(a), at(b))), kmer(F.greatest(at(a), at(b))))

            def full(x: Column, i: Column) -> Column:
                # the first of a number's two
                return F.when(slot(F.get(m, i + 1)) == slot(x), tagged(slot(x), pair(x, F.get(m, i + 1))))

            def sparse(s: Column) -> Column:
                # XOR with this gives k-mers of the slot's number the leading bits of the least longs
                own = F.call_function("shiftleft", s.bitwiseXOR(F.lit(-(1 << SLOT_BITS - 1)).cast("long")), F.lit(shift))
                return let(own, lambda o: let(F.transform(m, lambda x: x.bitwiseXOR(o)), lambda y: let(F.array_min(y), lambda a: let(F.array_min(F.filter(y, lambda x: x > a)), lambda b: tagged(s, F.when(b.isNull(), F.xxhash64(kmer(at(a)))).otherwise(pair(a, b)))))))

            def all_slots(f: Column) -> Column:
                rest = F.array_except(F.lit(list(range(-(1 << SLOT_BITS - 1), 1 << SLOT_BITS - 1))).cast("array<bigint>"), F.transform(f, slot))
                return F.sort_array(F.concat(f, F.transform(rest, sparse)))

            return let(F.filter(F.transform(m, full), lambda x: x.isNotNull()), all_slots)

        return let(F.sort_array(packed), numbered)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), of)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots, 0 to 1; two fingerprints without slots are alike."""
    slots = F.greatest(F.size(a), F.size(b))
    return F.when(slots == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(slots, F.lit(1)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id, by two short searches; -1 for null."""
    side = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    longs = lambda x: F.lit(x).cast("array<bigint>") if x else F.array().cast("array<bigint>")
    block = F.size(F.filter(longs([f[0] for f in fine]), lambda c: c <= doc_id))
    within = let(block, lambda k: F.when(k > 0, (k - 1) * side + F.size(F.filter(F.get(F.lit(fine).cast("array<array<bigint>>"), k - 1), lambda c: c <= doc_id))).otherwise(0)) if cuts else F.lit(0)
    return F.when(doc_id.isNull(), -1).otherwise(within).cast("int")


def _parts_of(doc_id: Column, hashed: Column, often: dict[int | None, int]) -> Column:
    """Which of its id's parts a row is in: 0 for ids that fill no range, else 1 and on, in the order of the texts' hashes."""
    at = (hashed.cast("double") + 2.0**63) / 2.0**64
    out = F.lit(0)
    for x, n in often.items():
        out = F.when(doc_id.isNull() if x is None else doc_id == x, F.least(F.floor(at * n).cast("int"), F.lit(n - 1)) + 1).otherwise(out)
    return out


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs(doc_id, text, ...) with next_<c> of the next row, in descending doc_id, for each of the columns; after the last
    comes the first. Equal ids go by the hash of the text, then the text; null ids come last.

    Ids are cut into ranges of about RANGE_ROWS rows at approximate quantiles, so rows move once, to their range. An id that
    fills ranges by itself, or null, is cut further by the texts' hashes. The first row of a range is also sent, as a guest,
    to the end of the range before it."""
    hashed = F.xxhash64("text")
    c = docs.select("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n = min(MOST_RANGES, -(-c.n // RANGE_ROWS))
    cuts: list[int] = []
    often: dict[int | None, int] = {}
    if n > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first().q
        found = [int(x) for x in found or []]
        cuts = sorted(set(found))
        # quantiles that repeat an id say how many ranges it fills; there are at most n of them
        often = {x: k for x, k in Counter(found).items() if k > 1}
        if c.nulls > RANGE_ROWS:
            often[None] = min(MOST_RANGES, -(-c.nulls // RANGE_ROWS))
    spread = F.struct(_range_of(F.col("doc_id"), cuts).alias("a"), _parts_of(F.col("doc_id"), hashed, often).alias("b"))
    # ranges in their order, and rows in theirs
    part = let(spread, lambda x: F.struct((-x["a"]).alias("a"), x["b"].alias("b")))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("down"), hashed.alias("h"))
    tops = docs.select(part.alias("part"), key.alias("key")).groupBy("part").agg(F.min("key").alias("top"))  # a row per range
    order = Window.orderBy("part")
    guests = tops.select("top", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("dest"), F.lit(True).alias("is_top"))
    rows = docs.withColumn("part", part).withColumn("key", key).join(F.broadcast(guests), F.col("key") == F.col("top"), "left")
    own = F.struct("part", F.lit(0).alias("guest"))
    places = F.when(F.col("is_top"), F.array(own, F.struct(F.col("dest").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    rows = rows.select(*docs.columns, "key", F.explode(places).alias("place")).select(*docs.columns, "key", "place.part", "place.guest")
    w = Window.partitionBy("part").orderBy("guest", "key", "text")
    return rows.select(*docs.columns, "guest", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document's. A null text counts as empty; a document alone is its own next; equal texts have equal fingerprints, and
    repeated rows follow each other. Other columns are ignored; an empty table gives an empty result."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "fp"]).withColumn("n_chars", F.length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("fp"))).alias("edited"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("edited.sha").alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited.fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited.fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
