"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line with a word is good or bad. Its score has indicator features of the line and of the lines before and after it
(shares of symbols, capitals, exclamation marks, digits, bars and repeated words, word lengths, repeated lines, length), and a
2 x 2 table scores neighbouring labels. Forward-backward gives each line's probability of being good; their mean, weighted by
the lines' characters, is the document's, and a logistic curve fitted on the training documents turns it into the score.
Training maximises the likelihood of the documents' labels, given to their lines, over a bounded sample of labelled
documents, each taken whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, labelled_sample, slices
from .hashing import SPACE, STEP, mix, word_hashes

#: Labelled documents that the fit reads at most, and its passes over them.
SAMPLE = 3000
STEPS = 120
#: Thresholds of each measure of a line; a feature says that the measure is above one.
CUTS = {
    "symbols": (0.01, 0.05, 0.1, 0.2, 0.4), "capitals": (0.1, 0.3, 0.6, 0.9), "bangs": (0.05, 0.2, 0.6), "digits": (0.05, 0.2, 0.5), "bars": (0.02, 0.1, 0.3),
    "repeats": (0.05, 0.2, 0.5), "distinct": (0.3, 0.5, 0.7, 0.9), "word_length": (2.5, 3.5, 5, 7, 9, 12), "words": (1.5, 3.5, 8.5, 20.5, 50.5), "ended": (0.5,), "seen": (0.5,), "stops": (0.05, 0.15, 0.3),
}
N_OWN = sum(map(len, CUTS.values()))
N_ALL = 3 * N_OWN + 3
#: Very frequent short words of the four languages of the corpus.
STOPS = "the of and to in is that for it as was with be by on der die und das den von zu mit sich des für ist le la les de et des un une que en du est pour qui el los las y del se por con su para al"
_BYTES = np.arange(256)
_CLASSES = {
    "solid": ~SPACE & ((_BYTES < 128) | (_BYTES >= 192)), "symbols": np.isin(_BYTES, list(b"#*$%&|<>{}[]\\^~=_@+")), "capitals": (_BYTES >= 65) & (_BYTES <= 90),
    "letters": ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 192), "bangs": _BYTES == 33, "digits": (_BYTES >= 48) & (_BYTES <= 57), "bars": _BYTES == 124,
}
_STOP_HASHES = np.sort(word_hashes([STOPS])[0])


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a word, in order: their features (rows, N_OWN), their characters, and where each text begins.

    A text without words gets one line of no features and weight 1."""
    split = [[x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")] or [""] for t in texts]
    flat = [x for s in split for x in s]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])])
    data = [x.encode("utf-8", "surrogatepass") for x in flat]
    ends = np.cumsum([len(x) + 1 for x in data])
    code = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    starts = ends - [len(x) + 1 for x in data]
    count = {k: np.add.reduceat(np.append(c[code], 0).astype(np.int32), starts) for k, c in _CLASSES.items()}
    words, at = word_hashes(flat)
    n = np.diff(at)
    line = np.repeat(np.arange(len(flat)), n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((words, line))
    first = np.ones(len(words), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])
    per_line = lambda mask: np.bincount(line, mask, len(flat))
    stop = _STOP_HASHES[np.minimum(np.searchsorted(_STOP_HASHES, words), len(_STOP_HASHES) - 1)] == words
    place = np.arange(len(words)) - at[:-1][line]
    whole = np.zeros(len(flat), np.uint64)
    np.add.at(whole, line, mix(words * STEP[12] + mix(place.astype(np.uint64) + STEP[13])))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    by = np.lexsort((np.arange(len(flat)), whole, doc))
    seen = np.zeros(len(flat), bool)
    seen[by[1:]] = (whole[by][1:] == whole[by][:-1]) & (doc[by][1:] == doc[by][:-1]) & (n[by][1:] > 0)
    solid, w = np.maximum(count["solid"], 1), np.maximum(n, 1)
    measures = {
        "symbols": count["symbols"] / solid, "capitals": count["capitals"] / np.maximum(count["letters"], 1), "bangs": count["bangs"] / w, "digits": count["digits"] / solid, "bars": count["bars"] / w,
        "repeats": per_line(again) / w, "distinct": np.bincount(line[order], first, len(flat)) / w, "word_length": count["letters"] / w, "words": n,
        "ended": np.array([x.rstrip().endswith((".", "!", "?", ":", '"', ")")) for x in flat]), "seen": seen, "stops": per_line(stop) / w,
    }
    own = np.column_stack([measures[k] > c for k, cuts in CUTS.items() for c in cuts]).astype(np.float32)
    own[n == 0] = 0
    return own, np.maximum(np.array([len(x) for x in flat], float), 1), bounds


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(own), N_ALL), np.float32)
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    out[first, N_OWN : 2 * N_OWN] = 0
    out[last, 2 * N_OWN : 3 * N_OWN] = 0
    out[:, -3] = 1
    out[first, -2] = 1
    out[last, -1] = 1
    return out


def forward_backward(score: np.ndarray, edge: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected label pairs of neighbours (lines, 2, 2), 0 at first lines.

    score: log-weight of good over bad. Chains run side by side, the longest first, so that step t works on those that have a
    line t; probabilities are scaled at each step."""
    sizes = np.diff(bounds)
    by = np.argsort(-sizes, kind="stable")
    start, size = bounds[:-1][by], sizes[by]
    own = np.empty((len(score), 2))
    own[:, 1] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    own[:, 0] = 1 - own[:, 1] + 1e-13
    move = np.exp(edge)
    forth, back = np.empty_like(own), np.ones_like(own)
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))] if len(size) else []
    prev = None
    for t, k in enumerate(live):
        at = start[:k] + t
        a = own[at] if t == 0 else (prev[:k] @ move) * own[at]
        prev = a / a.sum(1, keepdims=True)
        forth[at] = prev
    for t in range(len(live) - 1, 0, -1):
        at = start[: live[t]] + t
        b = (back[at] * own[at]) @ move.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    good = forth * back
    good /= good.sum(1, keepdims=True)
    pairs = np.zeros((len(score), 2, 2))
    inner = np.ones(len(score), bool)
    inner[bounds[:-1]] = False
    i = np.flatnonzero(inner)
    p = forth[i - 1][:, :, None] * move[None] * (own[i] * back[i])[:, None, :]
    pairs[i] = p / p.sum((1, 2), keepdims=True)
    return good[:, 1], pairs


def document_means(good: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def fit(rows: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Weights of lines and label pairs, by gradient ascent with momentum on the penalised likelihood, then the curve."""
    if not rows or len({y for _, y in rows}) < 2:
        base = np.clip(np.mean([y for _, y in rows]) if rows else 0.5, 0.01, 0.99)
        return {"w": np.zeros(N_ALL), "edge": np.zeros((2, 2)), "curve": np.array([0.0, np.log(base / (1 - base))])}
    parts = [lines(c) for c in chunks([t for t, _ in rows])]
    own, weight = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    x, label = with_neighbours(own, bounds), np.array([y for _, y in rows])
    y = np.repeat(label, np.diff(bounds))
    # a document's lines weigh as much as 1 + log of their number, and both labels the same in sum
    share = np.repeat((1 + np.log(np.diff(bounds))) / np.diff(bounds), np.diff(bounds))
    share *= np.where(y == 1, 0.5 / max(share[y == 1].sum(), 1e-9), 0.5 / max(share[y == 0].sum(), 1e-9))
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    said = np.zeros((2, 2))
    np.add.at(said, (y[inner], y[inner]), share[inner])
    w, edge, dw, de = np.zeros(N_ALL), np.zeros((2, 2)), 0.0, 0.0
    for _ in range(STEPS):
        good, pairs = forward_backward(x @ w, edge, bounds)
        gw = x.T @ ((y - good) * share) - 1e-4 * w
        ge = said - (pairs * share[:, None, None]).sum(0) - 1e-2 * edge
        dw, de = 0.9 * dw + 2.0 * gw, 0.9 * de + 0.5 * ge
        w, edge = w + dw, edge + de
    good, _ = forward_backward(x @ w, edge, bounds)
    m = document_means(good, weight, bounds)
    z = np.log((m + 1e-3) / (1 - m + 1e-3))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps on the two numbers of the curve
        p = 1 / (1 + np.exp(-(a * z + b)))
        r, v = label - p, p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * z).sum() - (a - 1), r.sum()])
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return {"w": w, "edge": edge, "curve": np.array([a, b])}


def scores(texts: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    own, weight, bounds = lines(texts)
    good, _ = forward_backward(with_neighbours(own, bounds) @ model["w"], model["edge"], bounds)
    m = document_means(good, weight, bounds)
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * np.log((m + 1e-3) / (1 - m + 1e-3)) + b, -30, 30)))


def _score(model: dict[str, np.ndarray], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, most=1 << 19):
            columns = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(scores(texts, model))], [*columns, name])

    return run


def train(spark: SparkSession, sf_dir: str, most: int = SAMPLE) -> dict[str, np.ndarray]:
    return fit(labelled_sample(spark, sf_dir, "quality", 3, 1, most))


def with_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs with a last column (0 to 1, higher: better), by the whole text alone; a null text counts as empty.

    The column is named score, with underscores behind it if docs has such a column."""
    from pyspark.sql.types import DoubleType, StructType

    name = "score"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return docs.mapInArrow(_score(model, name), StructType([*docs.schema.fields]).add(name, DoubleType()))


def quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); predicted is 1 from 0.5 on.

    Null and empty texts get the score of a document without lines; null ids stay null; repeated rows are scored each;
    other columns are ignored; an empty table gives an empty result."""
    s = with_quality(docs.select("doc_id", "text"), model)
    return s.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
