"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good or bad, or abstains, from measures of a whole text. Votes make a table of at most 3^9 patterns;
expectation-maximisation over it estimates for each rule how often it gives each vote on good and on bad documents. The
posterior probability of being good decides, instead of all rules having to pass. Two base rules reject before that."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, let

SYMBOLS = r"[#*$%&|<>]"
ROUNDS = 12
#: Very frequent short words of the four languages of the corpus.
STOPS = "the|of|and|to|in|is|that|it|for|as|was|with|be|on|by|der|die|und|das|den|von|zu|mit|sich|des|ist|le|la|les|de|et|un|une|que|en|du|est|pour|qui|el|los|las|y|del|se|por|con|su|para"


def _hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _repeated(words: Column) -> Column:
    """Words of an array that lie in a run of three words found twice or more in it, the first time included.

    Runs are hashed; a hash with its place in the low bits makes one long, and a sort brings equal runs together. A place
    takes as many bits as the array's size needs, the hash the rest. Runs of equal hashes are compared word by word; should
    some differ, the text's runs are sorted themselves, so counts are exact."""
    n = F.size(words)
    at = lambda i: [F.get(words, i + k) for k in range(3)]

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def exactly() -> Column:
        runs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("run"), i.alias("at")))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["run"] == x["run"], F.lit(False))
        found = lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x))
        return let(F.sort_array(F.transform(let(F.sort_array(runs), found), lambda x: x["at"])), covered)

    def of(mask: Column, top: Column) -> Column:
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: _hash(*at(i)).bitwiseAND(top).bitwiseOR(i))
        place = lambda x: x.bitwiseAND(mask).cast("int")

        def marks(s: Column) -> Column:
            # two packed longs hold equal hashes if they differ in the place bits alone
            same = lambda i, x: F.coalesce(F.get(s, i).bitwiseXOR(x).bitwiseAND(top) == 0, F.lit(False))
            return let(F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x)), counted)

        def counted(found: Column) -> Column:
            def mistaken(x: Column, i: Column) -> Column:
                before = F.get(found, i - 1)
                differ = reduce(lambda a, b: a | b, [p != q for p, q in zip(at(place(x)), at(place(before)), strict=True)])
                return (i > 0) & (before.bitwiseXOR(x).bitwiseAND(top) == 0) & differ

            wrong = F.exists(F.transform(found, mistaken), lambda x: x)
            return F.when(wrong, exactly()).otherwise(let(F.sort_array(F.transform(found, place)), covered))

        return let(F.sort_array(packed), marks)

    # bound once, as lambdas work out all that they name for each element
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + 1)).cast("int")) - 1
    return F.when(n >= 4, let(bits, lambda mask: let(F.bitwise_not(mask), lambda top: of(mask, top)))).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """A struct of all that base and rules need of a text."""
    text = F.coalesce(text, F.lit(""))

    solid = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def count(x: Column, pattern: str) -> Column:
        return F.regexp_count(x, F.lit(pattern)).cast("long")

    def of(words: Column, solid: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"), count(solid, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), _repeated(words).alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
            count(solid, "[A-Z]").alias("n_upper"), count(solid, "!").alias("n_bangs"), count(solid, "[0-9]").alias("n_digits"),
            F.size(F.filter(words, lambda w: w.isin(STOPS.split("|")))).cast("long").alias("n_stops"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:\")][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        )

    # each is worked out once: lambdas share nothing that they only name
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return let(words, lambda w: let(solid, lambda x: let(lines, lambda y: of(w, x, y))))


def _rule(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from the columns of measures(): 1 good, -1 bad, 0 none."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    symbols, upper, bangs, digits = (F.col(c) / chars for c in ("n_symbols", "n_upper", "n_bangs", "n_digits"))
    length, repeated, dup = F.col("word_chars") / words, F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    return {
        "symbols": _rule(symbols < 0.01, symbols > 0.05),
        "upper": _rule(upper < 0.1, upper > 0.3),
        "bangs": _rule(bangs < 0.005, bangs > 0.02),
        "digits": _rule(digits < 0.02, digits > 0.15),
        "length": _rule(length.between(3, 8), ~length.between(2, 12)),
        "repeats": _rule(repeated < 0.05, repeated > 0.2),
        "lines": _rule(dup < 0.05, dup > 0.3),
        "stops": _rule(F.col("n_stops") >= 0.1 * words, (F.col("n_stops") < 0.02 * words) & (words >= 20)),
        "ends": _rule(F.col("n_ended") >= 0.8 * F.col("n_lines"), F.col("n_ended") < 0.3 * F.col("n_lines")),
    }


NAMES = ("symbols", "upper", "bangs", "digits", "length", "repeats", "lines", "stops", "ends")


def learn(votes: DataFrame) -> tuple[float, dict[tuple[str, int, int], float]]:
    """The share of good documents, and the chance of each vote by a rule on bad (0) and good (1) documents, by EM.

    The table of vote patterns and counts, of at most 3^9 = 19,683 rows at any size of input, is what reaches the driver. EM
    begins with a document's probability of being good falling with each bad vote, so that a kind of bad documents that one
    rule alone sees isn't outvoted before it is known. A rule is never taken for worse than chance: a vote that would count
    against what it says counts nothing."""
    patterns = sorted((tuple(r[:-1]), float(r[-1])) for r in votes.groupBy(*NAMES).agg(F.count("*")).collect())
    total = sum(n for _, n in patterns)
    p = [0.95 * 0.3 ** sum(v < 0 for v in vs) for vs, _ in patterns]
    for _ in range(ROUNDS):
        good = sum(n * q for (_, n), q in zip(patterns, p, strict=True))
        rest = total - good
        prior = (good + 1.6) / (total + 2)
        all_of: dict[tuple[str, int], float] = {}
        good_of: dict[tuple[str, int], float] = {}
        for (vs, n), q in zip(patterns, p, strict=True):
            for key in zip(NAMES, vs, strict=True):
                all_of[key] = all_of.get(key, 0.0) + n
                good_of[key] = good_of.get(key, 0.0) + n * q
        chance = {}
        for r in NAMES:
            for v in (-1, 0, 1):
                # each rule keeps a say of two documents that vote as a fair rule would
                first = lambda y: 0.5 if v == 0 else 1.1 if (v > 0) == (y > 0) else 0.4  # noqa: E731, B023
                voted, on = all_of.get((r, v), 0.0), good_of.get((r, v), 0.0)
                on_good, on_bad = (on + first(1)) / (good + 2), (voted - on + first(0)) / (rest + 2)
                if v and (on_good - on_bad) * v < 0:
                    on_good = on_bad = (on_good * good + on_bad * rest + 1e-9) / (good + rest + 1e-9)
                chance[r, 1, v], chance[r, 0, v] = on_good, on_bad
        odds = {(r, v): math.log(chance[r, 1, v] / chance[r, 0, v]) for r in NAMES for v in (-1, 0, 1)}
        start = math.log(prior / (1 - prior))
        p = [1 / (1 + math.exp(-max(-500.0, min(500.0, start + sum(odds[k] for k in zip(NAMES, vs, strict=True)))))) for vs, _ in patterns]
    return prior, chance


def posterior(prior: float, chance: dict[tuple[str, int, int], float]) -> Column:
    z = F.lit(math.log(prior / (1 - prior)))
    for r in NAMES:
        odds = {v: math.log(chance[r, 1, v] / chance[r, 0, v]) for v in (-1, 0, 1)}
        z = z + F.when(F.col(r) == 1, odds[1]).when(F.col(r) == -1, odds[-1]).otherwise(odds[0])
    return 1 / (1 + F.exp(-z))


def rule_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) for each row of docs.

    base_failed: under 50 words, or more than half of them in repeated runs of three. kept: base passed and the posterior
    probability of being good, column quality, is at least 0.5. A null text counts as empty and fails the base; null ids
    stay null; repeated rows appear each; other columns are ignored; an empty table gives an empty result."""
    stats = checkpoint(docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*"))
    voted = stats.withColumns(rules())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    prior, chance = learn(voted.where(~failed))
    out = voted.withColumn("quality", posterior(prior, chance)).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality")
