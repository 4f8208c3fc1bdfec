"""Best-fit packing of token sequences: best-two-fit on the histogram of lengths.

Pieces have 1 to 2,048 tokens, so a histogram of at most 2,048 counts says all that packing needs, whatever the input's
size. The driver packs the histogram: fill a bin greedily with the largest piece that fits, then replace its smallest
piece by two unpacked ones that fill the gap more tightly; the bin's pattern repeats as often as the counts allow. Each
piece finds its bin from its rank among the pieces of its length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices

CAPACITY = 2048
#: Rank ranges of the pieces of one length.
BUCKETS = 4096
#: Words whose ids a worker keeps.
KEPT_WORDS = 400_000
#: Text bytes that are encoded at once.
TEXT_BYTES = 1 << 22
#: Latin letters that the tokenizer's normaliser turns into letters one by one, and ASCII marks that may follow them.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_tokenizers: dict[str, _Words] = {}


class _Words:
    """Ids of texts, put together from ids of words. The tokenizer splits at white space anyway: it never joins or
    composes characters over an ASCII space, so the ids of a text are those of its words in order."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        # for plain words, which are lower-cased and parted before: only spaces part them then
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_plain = getattr(self.plain, "encode_batch_fast", self.plain.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Knows the empty word alone."""
        self.known = pa.array([""], pa.large_string())
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Ids of new words. Words of letters go to the tokenizer as one text a chunk: each ends with the only token that
        has the suffix of word ends, which tells them apart."""
        plain = pc.match_substring_regex(words, _LETTERS)
        for some, encode in ((words.filter(plain), self.plain_ids), (words.filter(pc.invert(plain)), self.own_ids)):
            for k in range(0, len(some), 20_000):
                chunk = some.slice(k, 20_000)
                ids, ends = encode(chunk.to_pylist())
                self.begin = np.concatenate([self.begin, len(self.ids) + ends])
                self.ids = np.concatenate([self.ids, ids])
                self.known = pa.concat_arrays([self.known, chunk])

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.encode_plain([" ".join(words).lower()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, ends) if len(ends) == len(words) else self.own_ids(words)

    def own_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.encode_batch(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([len(ids) for ids in found])

    def places(self, words: pa.Array) -> pa.Array:
        """Where the words' ids are, learning those that are new."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            self.learn(pc.unique(words.filter(at.is_null())))
            at = pc.index_in(words, value_set=self.known)
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.clear()
        column = pa.array(texts, pa.large_string())
        if not any("<|" in t for t in texts):  # the tokenizer looks for its special tokens before it lower-cases
            column = pc.ascii_lower(column)
        split = pc.ascii_split_whitespace(column)
        bounds = split.offsets.to_numpy()
        coded = pc.dictionary_encode(split.flatten())
        unique = coded.dictionary
        if not len(unique):
            return [np.zeros(0, np.uint32) for _ in texts]
        # a word of letters and the marks after it are parts of their own to the tokenizer
        bare = pc.ascii_rtrim(unique, characters=_MARKS)
        plain = pc.match_substring_regex(bare, _LETTERS)
        marks = _after(unique, bare, plain)
        both = pa.concat_arrays([pc.if_else(plain, bare, unique), marks])
        at = self.places(both).to_numpy(zero_copy_only=False).reshape(2, -1)
        table = pa.LargeListArray.from_arrays(pa.array(self.begin), pa.array(self.ids))
        pairs = table.take(pa.array(at.T.ravel()))
        words = pa.LargeListArray.from_arrays(pa.array(pairs.offsets.to_numpy()[::2]), pairs.values)
        taken = words.take(coded.indices)
        flat, ends = taken.values.to_numpy(), taken.offsets.to_numpy()
        at = ends[bounds - bounds[0]]
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _after(words: pa.Array, heads: pa.Array, take: pa.Array) -> pa.Array:
    """What follows heads[i] in words[i] where take[i], else ''."""
    _, offsets, data = words.buffers()
    begin = np.frombuffer(offsets, np.int64, len(words), words.offset * 8)
    head = pc.binary_length(heads).to_numpy()
    size = np.where(take.to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy() - head, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(begin + head - ends[:-1], size)
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(np.frombuffer(data, np.uint8)[at]))


def encoder(path: str) -> _Words:
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    return _tokenizers[path]


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, most=TEXT_BYTES):
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder(path).encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    p = ids[k : k + capacity]
                    rows.append((doc, k // capacity, k, len(p), zlib.crc32(p.tobytes()), p if with_ids else None))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cols[5], pa.list_(pa.int64()))] if with_ids else arrays, [*names, "ids"] if with_ids else names)

    return run


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: uses}, times) that hold counts[length] pieces of each length exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    sizes = np.arange(capacity + 1)
    while left.any():
        free = left.copy()
        below = np.maximum.accumulate(np.where(free > 0, sizes, 0))  # largest free size up to each size
        bin_: list[int] = []
        gap = capacity
        while gap and (x := int(below[gap])):
            bin_.append(x)
            free[x] -= 1
            gap -= x
            if not free[x]:
                below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        while gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            a = np.flatnonzero(free[:room] > 0)
            b = below[np.minimum(room - a, a)]
            twice = (b == a) & (free[a] < 2)
            b = np.where(twice, below[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if not len(both) or (k := int(both.argmax())) < 0 or both[k] <= small:
                break
            bin_.remove(small)
            free[small] += 1
            for x in (int(a[k]), int(b[k])):
                bin_.append(x)
                free[x] -= 1
            below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            gap = room - int(both[k])
        uses = {x: bin_.count(x) for x in sorted(set(bin_), reverse=True)}
        times = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
        out.append((uses, times))
    return out


def _slots(bins: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of lengths to places: sorted keys length << 40 | first rank, and rows (first rank, uses, first bin, offset)."""
    used: dict[int, int] = {}
    keys, rows, first = [], [], 0
    for uses, times in bins:
        offset = 0
        for x, n in uses.items():
            rank = used.get(x, 0)
            keys.append(x << 40 | rank)
            rows.append((rank, n, first, offset))
            used[x] = rank + n * times
            offset += n * x
        first += times
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(rows, np.int64).reshape(-1, 4)[order]


def _place(keys: np.ndarray, rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            r = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            turn = rank - r[:, 0]
            out = {c: batch.column(names.index(c)) for c in names if c != "rank"}
            out |= {"sequence_id": pa.array(r[:, 2] + turn // r[:, 1]), "offset": pa.array(r[:, 3] + turn % r[:, 1] * length)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text), each with its place in a sequence of at most `capacity` tokens.

    A document is the ids of its text by the tokenizer file at `path`, without special tokens, and then end_id; a null
    text counts as empty and gives end_id alone. Documents of more than `capacity` ids are cut into pieces of that many,
    the last may be shorter; others stay whole. Reruns agree: pieces of equal id and number go by their ids' CRC. Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids with with_ids. Repeated rows are packed each for itself; null ids stay null; other columns are ignored; an empty
    table gives an empty result."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, capacity, end_id, with_ids), schema))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    parts = checkpoint(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.join(parts, ["length", "bucket"]).withColumn("rank", (F.col("before") + within - 1).cast("long"))
    cols = [c.split()[0] for c in schema.split(", ")]
    return ranked.select(*cols, "rank").mapInArrow(_place(*_slots(best_two_fit(counts, capacity))), schema + ", sequence_id long, offset long")
