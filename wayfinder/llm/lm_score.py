"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the two before and the two after it.

Words, A-Z lower-cased, are counted over the whole corpus; the most frequent ones get ids of their own, the others share
HASHED ids by hash. The network embeds the four neighbours, has one hidden layer, and predicts an id in two steps, its
class and its place in the class, so a word costs 2 * 32 outputs and not 1,024. Every partition trains on all its words
from the same start, whose output biases are the corpus' frequencies; the mean of the partitions' networks, weighted by
their words and summed by a distributed aggregation, is the model. A word without an id of its own has the probability of
its hash id times its own share of that id's words, from the counts of all words: those of up to SENT frequent words go to
every task, the others' are joined. The sum of the words' conditional log-probabilities scores a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .hashing import U, mix, word_hashes

CLASSES = PLACES = 32
IDS = CLASSES * PLACES
HASHED = 256
OWN = IDS - HASHED
EDGE = IDS  # stands beyond a document's ends
REACH = (-2, -1, 1, 2)
WIDTH, HIDDEN = 16, 32
#: Words of a step of training; the first steps are short, so that few words teach something too.
STEP_WORDS, FIRST_STEP = 8192, 256
RATE = 0.01
#: Words whose counts go to every task; the counts of all others are joined.
SENT = 1 << 18
#: What is added to every word's count; an unseen word of each hash id has as much.
MORE = 0.5
SHAPES = {"embed": (IDS + 1, WIDTH), "w1": (len(REACH) * WIDTH, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wm": (CLASSES, HIDDEN, PLACES), "bm": (CLASSES, PLACES)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the hashes of a partition's words and how often each occurs; merged once in a while to bound memory."""
    names, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        word, inverse = np.unique(np.concatenate(names), return_inverse=True)
        return word, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

    def batch() -> pa.RecordBatch:
        word, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])

    for _, texts in slices(batches):
        word, n = np.unique(word_hashes(texts)[0], return_counts=True)
        names.append(word), counts.append(n)
        held += len(word)
        if held > 4_000_000:
            yield batch()
            names, counts, held = [], [], 0
        elif len(names) > 16:
            word, n = merged()
            names, counts, held = [word], [n], len(word)
    if held:
        yield batch()


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes with an id of their own, sorted, and their ids; how often each id occurs; and ln of the smoothed number of
    words that share each hash id. At most IDS rows come back."""
    own = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    words = np.array([w for w, _ in own], np.int64).astype(U)
    order = np.argsort(words)
    rest = counts.groupBy(F.pmod("word", F.lit(HASHED)).alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("names")).collect()
    n, names = np.zeros(IDS), np.zeros(HASHED)
    n[: len(own)] = [c for _, c in own]
    for r in rest:
        n[OWN + r.id], names[r.id] = r.n, r.names
    at = (words % U(HASHED)).astype(np.int64)
    np.subtract.at(n, OWN + at, n[: len(own)])
    np.subtract.at(names, at, 1)
    return words[order], order, n, np.log(n[OWN:] + MORE * (names + 1))


def sent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes of the words that occur at least `least` times, sorted, and their counts; and `least`, with which they are
    SENT at most."""
    least, held = 1 << 62, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += r["count"]
        if held > SENT:
            break
        least = r.n
    got = counts.where(F.col("n") >= least).toArrow()
    word, n = got["word"].to_numpy().astype(U), got["n"].to_numpy()
    order = np.argsort(word)
    return word[order], n[order], least


def ids(texts: list[str], words: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed, bounds = word_hashes(texts)
    out = OWN + (hashed % U(HASHED)).astype(np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, hashed), len(words) - 1)
        out = np.where(words[at] == hashed, own[at], out)
    return out, bounds


def neighbours(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ids of the four neighbours of each word, EDGE beyond the document."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((len(tokens), len(REACH)), EDGE)
    for k, d in enumerate(REACH):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        same = doc[a] == doc[b]
        out[a, k] = np.where(same, tokens[b], EDGE)
    return out


def start(n: np.ndarray) -> dict[str, np.ndarray]:
    """The network before training: small fixed random weights, and output biases that give the corpus' frequencies."""
    rng = np.random.default_rng(7)
    p = {k: (rng.standard_normal(s) * (0.3 if k == "embed" else s[-2] ** -0.5 if len(s) > 1 else 0)).astype(np.float32) for k, s in SHAPES.items()}
    p["wc"] *= 0.1
    p["wm"] *= 0.1
    f = (n + 0.5).reshape(PLACES, CLASSES).T  # id = place * CLASSES + class
    p["bc"] = np.log(f.sum(1) / f.sum()).astype(np.float32)
    p["bm"] = np.log(f / f.sum(1, keepdims=True)).astype(np.float32)
    return p


def _log_softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities in place of z, and exp(z) over its rows' sums times those sums: what a gradient divides by them."""
    ones = np.ones((z.shape[1], 1), z.dtype)
    z -= z.max(initial=0.0)  # of all rows, which is fast; of each where that leaves a row nothing to add up
    total = (e := np.exp(z)) @ ones
    if len(z) and total.min() < 1e-20:
        z -= z.max(1, keepdims=True)
        total = (e := np.exp(z)) @ ones
    z -= np.log(total)
    return e, total


def log_probabilities(p: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """log P(token | neighbours) of each word; with grad, the gradient of their mean is written there."""
    n = len(tokens)
    c, m = tokens % CLASSES, tokens // CLASSES
    order = np.argsort(c.astype(np.uint16), kind="stable")  # words of a class side by side; 16 bits are sorted by radix
    tokens, c, m, around = tokens[order], c[order], m[order], around[order]
    x = p["embed"][around].reshape(n, -1)
    h = np.tanh(x @ p["w1"] + p["b1"])
    lc = h @ p["wc"] + p["bc"]
    ec, sc = _log_softmax(lc)
    rows = np.arange(n)
    ends = np.searchsorted(c, np.arange(CLASSES + 1))
    lm = np.empty((n, PLACES), h.dtype)
    for k in range(CLASSES):
        a, b = ends[k], ends[k + 1]
        if b > a:
            np.matmul(h[a:b], p["wm"][k], out=lm[a:b])
            lm[a:b] += p["bm"][k]
    em, sm = _log_softmax(lm)
    got = lc[rows, c] + lm[rows, m]
    if grad is not None:
        dc, dm = ec, em  # (1 at the word - probability) / n
        dc /= -n * sc
        dm /= -n * sm
        dc[rows, c] += 1 / n
        dm[rows, m] += 1 / n
        grad["wc"], grad["bc"] = h.T @ dc, dc.sum(0)
        dh = dc @ p["wc"].T
        grad["wm"], grad["bm"] = np.zeros_like(p["wm"]), np.zeros_like(p["bm"])
        for k in range(CLASSES):
            a, b = ends[k], ends[k + 1]
            if b > a:
                grad["wm"][k], grad["bm"][k] = h[a:b].T @ dm[a:b], dm[a:b].sum(0)
                dh[a:b] += dm[a:b] @ p["wm"][k].T
        dh *= 1 - h * h
        grad["w1"], grad["b1"] = x.T @ dh, dh.sum(0)
        dx = (dh @ p["w1"].T).reshape(-1, WIDTH)
        flat = around.ravel().astype(np.uint16)
        by = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[by], return_index=True)
        grad["embed"] = np.zeros_like(p["embed"])
        grad["embed"][names] = np.add.reduceat(dx[by], first)
    out = np.empty_like(got)
    out[order] = got
    return out


def _train(p0: dict[str, np.ndarray], words: np.ndarray, own: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in p0.items()}
        m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        seen = steps = 0
        for _, texts in slices(batches):
            tokens, bounds = ids(texts, words, own)
            around = neighbours(tokens, bounds)
            a = 0
            while a < len(tokens):
                size = min(STEP_WORDS, FIRST_STEP << min(steps // 24, 20))
                t, grad = tokens[a : a + size], {}
                log_probabilities(p, t, around[a : a + size], grad)
                a += size
                steps += 1
                share = len(t) / size
                for k in p:  # Adam, ascending
                    m[k] += 0.1 * (grad[k] - m[k])
                    v[k] += 0.01 * (grad[k] ** 2 - v[k])
                    p[k] += np.float32(RATE * share / (1 + steps / 2000)) * (m[k] / np.float32(1 - 0.9**steps)) / (np.sqrt(v[k] / np.float32(1 - 0.99**steps)) + np.float32(1e-6))
                seen += len(t)
        if seen:
            flat = np.concatenate([p[k].ravel() for k in SHAPES]).astype(float)
            for a in range(0, len(flat), 8192):
                part = flat[a : a + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part * seen), pa.array(np.full(len(part), float(seen)))], ["at", "value", "seen"])

    return run


Model = tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model: the network, the words with ids of their own, their ids, ln of the words of each hash id, and the words
    and counts that are sent to every task; and (word, n) of the words that aren't and occur more than once."""
    counts = checkpoint(word_counts(docs))
    words, own, n, shared = frequent(counts)
    names, times, least = sent(counts)
    p = start(n)
    sums = docs.select("text").mapInArrow(_train(p, words, own), "at int, value double, seen double").groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value"))
    got = sums.toPandas().sort_values("at")
    if len(got):
        flat, a = got["value"].to_numpy(np.float32), 0
        for k, shape in SHAPES.items():
            p[k] = flat[a : a + int(np.prod(shape))].reshape(shape)
            a += int(np.prod(shape))
    return (p, words, own, shared, names, times), counts.where((F.col("n") < least) & (F.col("n") > 1))


def scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text, its words and the sum of their log-probabilities, 0 without words; and (text, word, times) of the words
    whose counts aren't at hand, for which ln(count + MORE) is still to be added."""
    p, words, own, shared, names, times = model
    hashed, _ = word_hashes(texts)
    tokens, bounds = ids(texts, words, own)
    around = neighbours(tokens, bounds)
    logs = np.concatenate([np.zeros(1), *(log_probabilities(p, tokens[a : a + STEP_WORDS], around[a : a + STEP_WORDS]) for a in range(0, len(tokens), STEP_WORDS))])
    logs = logs.astype(float)
    rare = np.flatnonzero(tokens >= OWN)
    word, inverse = np.unique(hashed[rare], return_inverse=True)
    at = np.minimum(np.searchsorted(names, word), max(len(names) - 1, 0))
    there = names[at] == word if len(names) else np.zeros(len(word), bool)
    known = np.zeros(len(word))
    known[there] = np.log(times[at[there]] + MORE)
    logs[rare + 1] += known[inverse] - shared[tokens[rare] - OWN]
    sums = np.add.reduceat(np.append(logs[1:], 0.0), np.minimum(bounds[:-1], len(tokens))) * (np.diff(bounds) > 0)
    asked = ~there[inverse]
    text, which = np.searchsorted(bounds, rare[asked], "right") - 1, inverse[asked]
    pair, n = np.unique(text * max(len(word), 1) + which, return_counts=True)
    return np.diff(bounds), sums, (pair // max(len(word), 1), word[pair % max(len(word), 1)] if len(word) else word, n)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part, texts in slices(batches):
            n, sums, (text, word, times) = scores(texts, model)
            rows, none = np.arange(row, row + len(texts)), np.zeros(len(text), np.int64)
            row += len(texts)
            # a document's own row asks for no word: a hash of its number deals it to any task
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[text]])), pa.concat_arrays([part.column(0).cast(pa.int64()), pa.nulls(len(text), pa.int64())]), pa.array(np.concatenate([n.astype(np.int64), none])),
                    pa.array(np.concatenate([sums.astype(float), none.astype(float)])), pa.array(np.concatenate([mix(rows.astype(U)), word]).astype(np.int64)), pa.array(np.concatenate([np.zeros(len(rows), np.int64), times])),
                ], ["row", "doc_id", "n_tokens", "log_likelihood", "word", "times"],
            )

    return run


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of docs(doc_id, text).

    Texts without words (null, empty, blank) have 0 tokens, likelihood 0 and no mean. Null ids stay null; repeated rows
    are counted and scored each; other columns are ignored; an empty table gives an empty result."""
    model, counts = train(docs)
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "row long, doc_id long, n_tokens long, log_likelihood double, word long, times long")
    s = s.join(counts, "word", "left").withColumn("own", F.col("times") * F.log(F.coalesce("n", F.lit(1)) + MORE))
    s = s.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(F.col("log_likelihood") + F.col("own")).alias("log_likelihood")).drop("row")
    return s.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
