"""Personal data by weak supervision, in DataFrame expressions only.

Regular expressions propose spans. Five labelers vote on each or abstain: its format, gazetteers (top-level domains,
reserved networks, card issuers, calling codes, prefixes of keys), cue words before it, its shape, and its edges.
Expectation-maximisation over the table of vote patterns estimates how often each labeler is right, and a logistic
regression, trained on the posteriors with what the span itself looks like, is the final span classifier. Spans of the base
definition stay whatever it says; it adds others: numbers that only look like cards or phones until context says more, and
secrets. All steps take time in proportion to a text's length and its matches."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let

#: Kinds of proposals in their order; the base definition has the first four. NAMES are what spans are called.
KINDS = ("email", "ip", "card", "phone", "secret", "local")
NAMES = ("email", "ip", "card", "phone", "secret", "phone")
#: How issued keys begin.
KEY_PREFIXES = "ghp_|gho_|sk-|pk_|rk_|AKIA|ASIA|xox[abp]-|AIza|eyJ"
#: A run is tried from its start, or from where the last match ended: from elsewhere in it a match would have begun earlier.
#: Secrets are long runs, shorter ones with the prefix of a key, and what is assigned to a name like password.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]{{24,}}+|(?:{KEY_PREFIXES})[A-Za-z0-9_-]{{12,}}+|(?<=[=:\"'])(?<=(?i:passw(?:or)?d|pwd|token|secret|key|auth)[=:]\"?)[A-Za-z0-9_-]{{8,}}+)",
    "local": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
LABELERS = ("format", "gazetteer", "context", "shape", "edges")
#: Fixed values of the gazetteers and cue words.
DOMAINS = "com|net|org|edu|gov|info|io|biz|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pl|se|br|mx|ar|jp|cn|in|au|ru"
ISSUERS = "4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(011|4[4-9]|5)|35"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[01]|97[0-7]"
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|addr|login|from", "card": "card|visa|master|credit|karte|carte|tarjeta|pay|number", "phone": "phone|tel|call|mobile|cell|fax|ruf|appel|llam",
    "secret": "token|key|secret|passw|pwd|auth|api|bearer|credential", "local": "phone|tel|call|mobile|cell|fax|ruf|appel|llam|or|dial",
}
AGAINST = "version|isbn|issn|order|figure|fig\\.|page|doi|sha|commit|hash|id|ref"
BEFORE = 40
#: What a span looks like, as yes or no: the classifier's own features beside the votes.
LOOKS = ("long", "digits", "upper", "parted")
#: Elements that a running total takes in one step, and characters of a part of a text.
STRIDE, PART = 256, 4096
EM_ROUNDS, FIT_ROUNDS = 8, 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass Luhn's test?"""
    value = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return total % 10 == 0


def _is_base(kind: str, m: Column) -> Column:
    d = _digits(m)
    return {
        "email": F.lit(True),
        "ip": m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
        "card": F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False),
        "phone": F.length(d).between(10, 15),
        "secret": F.lit(False),
        "local": F.lit(False),
    }[kind]


def _yes(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(-1)


def _votes(kind: str, m: Column, base: Column, before: Column, after: Column) -> list[Column]:
    d = _digits(m)
    known = {
        "email": F.when(m.rlike(rf"(?i)\.(?:{DOMAINS})$"), 1).otherwise(0),
        "ip": F.when(m.rlike(r"^(?:0+|127|255|22[4-9]|23[0-9])\."), -1).otherwise(1),
        "card": _yes(d.rlike(f"^(?:{ISSUERS})")),
        "phone": F.when(d.rlike(f"^(?:{CALLING_CODES})"), 1).otherwise(-1),
        "secret": F.when(m.rlike(f"^(?:{KEY_PREFIXES})"), 1).otherwise(0),
        "local": _yes(d.rlike("^[2-9][0-9]{2}[2-9]")),
    }[kind]
    shape = {
        "email": _yes(~m.contains("..") & (F.instr(m, "@") <= 65)),
        "ip": _yes(~m.rlike(r"(?:^|\.)0[0-9]")),
        "card": _yes(F.length(d).isin(15, 16)),
        "phone": F.when(m.rlike(r"[\x20().-]"), 1).otherwise(0),
        "secret": _yes(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("[_-]{2}")),
        "local": F.when(m.rlike(r"\(|-.*-"), 1).otherwise(0),
    }[kind]
    if kind == "secret":
        form = F.when(F.length(m).isin(32, 40, 64) & m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1).otherwise(0)
    else:
        form = F.lit(0) if kind == "local" else _yes(base)
    cue = F.when(before.rlike(f"(?i)(?:{CUES[kind]})"), 1).when(before.rlike(f"(?i)\\b(?:{AGAINST})[^A-Za-z]*$"), -1).otherwise(0)
    if kind == "secret":  # a run always ends at other characters: what counts is an assignment or quotes
        edges = F.when(before.rlike("[=:\"']$") | after.isin('"', "'"), 1).otherwise(0)
    else:
        edges = _yes(~F.substring(before, -1, 1).rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]"))
    return [form, known, cue, shape, edges]


def _looks(m: Column) -> list[Column]:
    return [F.length(m) >= 20, 2 * F.length(_digits(m)) >= F.length(m), m.rlike("[A-Z]"), m.rlike(r"[\x20()._-]")]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """values[0], step(values[0], values[1]), ... of an array of int, in blocks of STRIDE: an array that grows by one element
    is copied each time, so only short ones may."""

    def short(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(step(F.get(a, F.size(a) - 1), v)))))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / STRIDE).cast("int"), F.lit(0))), lambda b: F.slice(x, b * STRIDE + 1, F.lit(STRIDE)))

    def joined_up(parts: Column) -> Column:
        ends = short(F.transform(parts, lambda x: F.get(x, F.size(x) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda x, b: F.when(b == 0, x).otherwise(let(F.get(e, b - 1), lambda before: F.transform(x, lambda v: step(before, v)))))))

    return let(values, lambda x: let(F.transform(blocks(x), short), joined_up))


def _found(kind: str, text: Column) -> Column:
    """The matches of a kind in a text: start, kind, end (code points, end exclusive), base, votes and looks.

    The text splits at its matches; running totals of the lengths of parts and matches are the places."""
    pattern = F.lit(PATTERNS[kind])
    tail = lambda x: F.substring(F.coalesce(x, F.lit("")), -BEFORE, BEFORE)

    def of(parts: Column, ms: Column, at: Column) -> Column:
        def full(m: Column, i: Column) -> Column:
            base = _is_base(kind, m)
            # the part before the match may be short: then the match and the part before it follow
            before = tail(F.concat(tail(F.get(parts, i - 1)), F.coalesce(F.get(ms, i - 1), F.lit("")), tail(F.get(parts, i))))
            after = F.substring(F.concat(F.substring(F.get(parts, i + 1), 1, 1), F.substring(F.coalesce(F.get(ms, i + 1), F.lit("")), 1, 1)), 1, 1)
            votes = let(before, lambda b: F.array(*[v.cast("int") for v in _votes(kind, m, base, b, after)]))
            row = [F.get(at, 2 * i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(at, 2 * i + 1).alias("end"), base.alias("base")]
            return F.struct(*row, votes.alias("votes"), F.array(*_looks(m)).alias("looks"))

        return F.transform(ms, full)

    def placed(parts: Column, ms: Column) -> Column:
        lengths = F.flatten(F.transform(ms, lambda m, i: F.array(F.length(F.get(parts, i)), F.length(m))))
        return let(running(lengths, lambda a, v: a + v), lambda at: of(parts, ms, at))

    return let(F.split(text, PATTERNS[kind], -1), lambda parts: let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda ms: placed(parts, ms)))


SPAN = "struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,looks:array<boolean>>"


def candidates(text: Column) -> Column:
    """All proposed spans of a text by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    some = {
        "email": text.contains("@"), "secret": text.rlike(PATTERNS["secret"]), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"),
        "local": text.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    }
    return F.sort_array(F.concat(*[F.when(some[k], _found(k, text)).otherwise(F.array().cast(f"array<{SPAN}>")) for k in KINDS]))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _parts(kind: int, votes: tuple[int, ...], looks: tuple[bool, ...]) -> list[tuple]:
    """The names of the classifier's weights that apply to a span."""
    return [("kind", kind), *[(v, x) for v, x in zip(LABELERS, votes, strict=True) if x], *[(n, kind) for n, x in zip(LOOKS, looks, strict=True) if x]]


def learn(spans: DataFrame) -> dict[tuple, float]:
    """Weights of the span classifier from spans(kind, votes, looks): EM on vote patterns, then logistic regression.

    A table of patterns with their counts, of at most 6 * 3^5 * 2^4 = 23,328 rows at any size of input, holds all that both
    need; it is what reaches the driver."""
    found = spans.groupBy("kind", "votes", "looks").agg(F.count("*").alias("n")).collect()
    rows = sorted((r.kind, tuple(r.votes), tuple(r.looks), float(r.n)) for r in found)
    right = {(k, v): 0.8 for k in range(len(KINDS)) for v in range(len(LABELERS))}
    prior = dict.fromkeys(range(len(KINDS)), 0.7)

    def posteriors() -> list[float]:
        odds = {kv: _logit(p) for kv, p in right.items()}
        return [_sigmoid(_logit(prior[k]) + sum(odds[k, v] * x for v, x in enumerate(votes))) for k, votes, _, _ in rows]

    for _ in range(EM_ROUNDS):
        p = posteriors()
        for k in range(len(KINDS)):
            own = [(votes, n, q) for (kind, votes, _, n), q in zip(rows, p, strict=True) if kind == k]
            prior[k] = (sum(n * q for _, n, q in own) + 7) / (sum(n for _, n, _ in own) + 10)
            for v in range(len(LABELERS)):
                said = sum(n * abs(votes[v]) for votes, n, _ in own)
                good = sum(n * (q if votes[v] > 0 else 1 - q) for votes, n, q in own if votes[v])
                right[k, v] = min(0.99, max(0.5, (good + 8) / (said + 10)))

    p = posteriors()
    weights: dict[tuple, float] = {}
    named = [_parts(k, votes, looks) for k, votes, looks, _ in rows]
    for _ in range(FIT_ROUNDS):  # each weight by its own Newton step, shortened: features overlap
        slope: dict[tuple, float] = {}
        curve: dict[tuple, float] = {}
        for names, (_, _, _, n), q in zip(named, rows, p, strict=True):
            s = _sigmoid(sum(weights.get(x, 0.0) for x in names))
            for x in names:
                slope[x] = slope.get(x, 0.0) + n * (q - s)
                curve[x] = curve.get(x, 0.0) + n * s * (1 - s)
        for x, g in slope.items():
            w = weights.get(x, 0.0)
            weights[x] = w + 0.3 * max(-3.0, min(3.0, (g - 0.1 * w) / (curve[x] + 0.1)))
    return weights


def classifier(weights: dict[tuple, float], span: Column) -> Column:
    """Log-odds that a span is personal data."""
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    z = F.get(array(weights.get(("kind", k), 0.0) for k in range(len(KINDS))), span["kind"])
    for i, v in enumerate(LABELERS):
        z = z + F.get(array(weights.get((v, x), 0.0) for x in (-1, 0, 1)), F.get(span["votes"], F.lit(i)) + 1)
    for i, n in enumerate(LOOKS):
        z = z + F.when(F.get(span["looks"], F.lit(i)), F.get(array(weights.get((n, k), 0.0) for k in range(len(KINDS))), span["kind"])).otherwise(0.0)
    return z


def accepted(spans: Column, weights: dict[tuple, float]) -> Column:
    """The base spans and those that the classifier adds."""
    return F.filter(spans, lambda s: s["base"] | (classifier(weights, s) > 0))


def joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs(doc_id, text).

    A null text counts as empty: no spans, the digest of ''. Null ids stay null, repeated rows appear each, other columns
    are ignored, an empty table gives an empty result. Places count code points; ends are exclusive."""
    rows = checkpoint(docs.select("doc_id", candidates(F.col("text")).alias("found")))
    weights = learn(rows.select(F.explode("found").alias("s")).select("s.*"))
    base = F.filter("found", lambda s: s["base"])
    of_kind = lambda k: lambda s: s["base"] & (s["kind"] == k)
    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(accepted(F.col("found"), weights)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in angle brackets; n_chars follows.

    Of overlapping spans the first stands, up to the furthest end of those that begin within it. Texts without spans,
    and null ones, stay as they are. Texts are matched twice, to learn and to replace: keeping them with their spans
    meanwhile would write the whole corpus once more."""
    text = F.col("text")
    weights = learn(docs.select(F.explode(candidates(text)).alias("s")).select("s.*"))
    kind = F.array(*map(F.lit, NAMES))
    size = PART.bit_length() - 1

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """The characters from a to b of a text in parts of PART characters."""
        first, last, within = F.shiftright(a, size), F.shiftright(b, size), lambda x: x.bitwiseAND(PART - 1)
        one = F.substring(F.get(parts, first), within(a) + 1, b - a)
        many = F.concat(F.substring(F.get(parts, first), within(a) + 1, F.lit(PART)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(F.coalesce(F.get(parts, last), F.lit("")), F.lit(1), within(b)))
        return F.when(a >= b, "").when(first == last, one).otherwise(many)

    def apart(chosen: Column) -> Column:
        def of(ends: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda i: (i == 0) | (F.get(chosen, i)["start"] >= F.get(ends, i - 1)))
            return let(begins, lambda x: F.transform(x, lambda i, j: F.struct(F.get(chosen, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(x, j + 1), F.size(chosen)) - 1).alias("end"), F.get(chosen, i)["kind"].alias("kind"))))

        return let(running(F.transform(chosen, lambda s: s["end"]), F.greatest), of)

    def rebuilt(spans: Column, parts: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.concat(cut(parts, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), s["start"]), F.lit("<"), F.get(kind, s["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), cut(parts, F.get(spans, F.size(spans) - 1)["end"], F.length(text)))

    def replaced(chosen: Column) -> Column:
        new = let(apart(chosen), lambda spans: let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda parts: rebuilt(spans, parts)))
        return F.when(F.size(chosen) > 0, new).otherwise(text)

    new = docs.withColumn("text", let(accepted(candidates(text), weights), replaced))
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new
