"""Toxicity: a counterfactual-regularised classifier of words and their beginnings.

Logistic regression over which features a text has: whole words (letters, lower-cased) and their first 4 to 6 letters, hashed
to DIMS weights. Its penalty, of the sum of absolute weights, makes neutral words weigh exactly nothing, so long texts don't
gather a score from noise. Training also sees each labelled sentence-bearing text with identity terms swapped or put in:
the squared change of the score is penalised, so a mere mention of a group doesn't count as toxic."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, labelled_sample, slices
from .hashing import STEP, U, mix

#: Labelled documents that the fit reads at most, its passes, and its penalties.
SAMPLE = 3000
STEPS = 120
L1, SWAP = 2e-4, 1.0
BITS = 20
DIMS = 1 << BITS
PREFIXES = (4, 5, 6)
#: Identity terms that the counterfactuals swap, by language.
IDENTITY = {
    "en": "women men girls boys muslims muslim christians christian jews jewish hindus buddhists atheists gay lesbian bisexual transgender straight black white asian latino african european american arab mexican indian chinese immigrants refugees disabled deaf blind elderly young".split(),
    "de": "frauen männer muslime christen juden schwule lesben ausländer flüchtlinge behinderte".split(),
    "fr": "femmes hommes musulmans chrétiens juifs gays lesbiennes noirs blancs immigrés réfugiés handicapés".split(),
    "es": "mujeres hombres musulmanes cristianos judíos gais lesbianas negros blancos inmigrantes refugiados discapacitados".split(),
}
_LANGUAGE = {w: words for words in IDENTITY.values() for w in words}
_LETTERS = re.compile(r"[^\W\d_]+")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: the byte that it counts as (A-Z as a-z), and whether it belongs to a word."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[97:123] = word[65:91] = True
    word[128:] = True
    return low, word


_LOW, _WORD = _classes()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, sorted, and where each text's begin.

    A word is a run of ASCII letters and non-ASCII characters; letters with accents are lower-cased where they differ from
    the capital by one bit in UTF-8. Words hash by a running polynomial, of which a prefix is a part."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b" "]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    inside = _WORD[data]
    low = _LOW[data].astype(U)
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[capital] += U(32)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    stops = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    doc = np.searchsorted(ends, starts, side="right")
    size = stops - starts
    out, who = [], []
    hashed = np.zeros(len(starts), U)
    live = np.arange(len(starts))
    longest = int(size.max())
    for k in range(min(longest, 64)):
        live = live[size[live] > k]
        hashed[live] = mix(hashed[live] * STEP[3] + low[starts[live] + k] + U(1))
        if k + 1 in PREFIXES:
            out.append(hashed[live] + U(k + 1)), who.append(doc[live])
    # of longer words the rest comes in as a sum over its bytes
    for w in live[size[live] > 64].tolist():
        rest = low[starts[w] + 64 : stops[w]]
        hashed[w] += mix(rest + np.arange(len(rest), dtype=U) * U(257)).sum(dtype=U)
    out.append(hashed ^ STEP[4]), who.append(doc)
    code = (mix(np.concatenate(out)) >> U(64 - BITS)) | np.concatenate(who).astype(U) << U(BITS)
    code = np.unique(code)
    return (code & U(DIMS - 1)).astype(np.int64), np.searchsorted(code, np.arange(len(texts) + 1).astype(U) << U(BITS))


def swapped(text: str, at: int) -> str:
    """The text with every identity term replaced by another of its language, or, if it has none, with one put into its
    middle. `at` says which."""
    hits = 0

    def other(m: re.Match[str]) -> str:
        nonlocal hits
        words = _LANGUAGE.get(m.group().lower())
        if words is None:
            return m.group()
        hits += 1
        return words[(words.index(m.group().lower()) + 1 + (at * 7 + hits * 11) % (len(words) - 1)) % len(words)]

    new = _LETTERS.sub(other, text)
    if hits:
        return new
    words = list(IDENTITY.values())[at % len(IDENTITY)]
    space = re.compile(r"\s").search(text, len(text) // 2)
    middle = space.start() if space else len(text)
    return f"{text[:middle]} {words[at * 7 % len(words)]} {text[middle:]}"


def _all_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts, and which text each is of."""
    out, who, done = [], [], 0
    for c in chunks(texts):
        x, at = features(c)
        out.append(x.astype(np.int32))
        who.append(np.repeat(np.arange(done, done + len(c), dtype=np.int32), np.diff(at)))
        done += len(c)
    return np.concatenate(out), np.concatenate(who)


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated proximal gradient steps with a step for each feature by how many texts have it."""
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        p = np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99)
        return np.zeros(DIMS, np.float32), float(np.log(p / (1 - p)))
    x, row = _all_features([t for t, _ in rows])
    z, other = _all_features([swapped(t, i) for i, (t, _) in enumerate(rows)])
    used = np.zeros(DIMS, bool)
    used[x] = used[z] = True
    names = np.flatnonzero(used)
    position = np.cumsum(used, dtype=np.int32) - 1
    x, z = position[x], position[z]
    held = np.bincount(x, minlength=len(names))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    # a sum over rows of many features moves far: each step is scaled by the mean number of weighing features
    rate = 1.0 / (0.25 * np.bincount(x, share[row], len(names)) + 2 * SWAP * (np.bincount(x, minlength=len(names)) + np.bincount(z, minlength=len(names))) / len(y) * 0.02 + 2e-3)
    rate *= 0.08
    w, b, v, vb = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    total = lambda c, k, weights: np.bincount(k, weights[c], len(y))
    for t in range(STEPS):
        s, s2 = total(x, row, v) + vb, total(z, other, v) + vb
        p, q = 1 / (1 + np.exp(-np.clip(s, -30, 30))), 1 / (1 + np.exp(-np.clip(s2, -30, 30)))
        e = (p - y) * share
        d = 2 * SWAP * (p - q) / len(y)
        gs, g2 = e + d * p * (1 - p), -d * q * (1 - q)
        grad = np.bincount(x, gs[row], len(names)) + np.bincount(z, g2[other], len(names))
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
        nb = vb - 0.5 * e.sum()
        k = t / (t + 3)
        v, vb = new + k * (new - w), nb + k * (nb - b)
        w, b = new, nb
    w[held < 2] = 0
    s = total(x, row, w) + b
    out = np.zeros(DIMS, np.float32)
    out[names] = w
    return out, float(b + _shift(s, y))


def _shift(s: np.ndarray, y: np.ndarray) -> float:
    """What to add to log-odds so that a threshold of 0.3 makes the fewest errors, both kinds alike."""
    order = np.argsort(s)
    wrong = np.concatenate([[(y == 0).sum() / max((y == 0).sum(), 1)], (y == 0).sum() / max((y == 0).sum(), 1) + np.cumsum(np.where(y[order] == 1, 1 / max((y == 1).sum(), 1), -1 / max((y == 0).sum(), 1)))])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(best[len(best) // 2])
    cut = (s[order[k - 1]] if k else s.min() - 1) / 2 + (s[order[k]] if k < len(s) else s.max() + 1) / 2
    return float(np.log(0.3 / 0.7) - cut)


def scores(texts: list[str], weights: np.ndarray, intercept: float) -> np.ndarray:
    x, at = features(texts)
    sums = np.bincount(np.repeat(np.arange(len(texts)), np.diff(at)), weights[x], len(texts))
    return 1 / (1 + np.exp(-np.clip(sums + intercept, -30, 30)))


def _score(names: np.ndarray, values: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(DIMS)
        weights[names] = values
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores(texts, weights, intercept))], ["doc_id", "score"])

    return run


def train(spark: SparkSession, sf_dir: str, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    return fit(labelled_sample(spark, sf_dir, "toxic", 4, 2, most))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); predicted is 1 from a score of 0.3 on.

    Null and empty texts have no features and get the score of the intercept; null ids stay null; repeated rows are scored
    each; other columns are ignored; an empty table gives an empty result."""
    weights, intercept = model
    names = np.flatnonzero(weights)
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(names, weights[names], intercept), "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
