"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives each element of a set a pseudo-random permutation of the signature's slots and, at its j-th slot, the
value j + r with r in [0, 1); a slot keeps the least value. All values of step j lie below those of step j + 1, so one may
take the steps one after another for all elements at once and stop as soon as no slot is empty: the early stop of the
method, vectorised. Most texts need one or two steps.

Documents whose sets are equal collapse first (by a 128-bit hash of the set). The rest meet in buckets, one for each band
of ROWS slots. Each bucket's least document is compared with all others, on full sets; links found this way make
components. Where a bucket then still has several components, signatures tell which of them may hold similar documents;
these make clusters, and in each cluster the documents outside its largest component meet all others on full sets, in
blocks that an index of shingles joins. No bucket is capped and no task gets a whole one: what is known of a key is sent to
its rows, or joined in parts, so that rows are never dealt by a key that many share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .components import components
from .hashing import STEP, U, mix, shingle_sets

#: A pair of similarity 0.75 meets in no band with probability (1 - 0.75^5)^32 = 0.0002, one of 0.8 with 0.000003.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Share of equal signature bytes that a pair of similarity 0.75 reaches but for chances of one in 10^5: 4.4 deviations below.
LEAST_ALIKE = 0.6
#: Members of a bucket, or of a star, that one group of a block comparison takes from each side.
BLOCK = 256
#: Rows of a few numbers that may go to all tasks; parts of a key where there are more.
MOST_SENT, SALTS = 100_000, 16
EMPTY = U(2**64 - 1)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of every set: a row of `slots` values; of an empty set all EMPTY."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * slots, EMPTY, U)
    if not sizes.sum():
        return out.reshape(len(sets), slots)
    items, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = None
    for step in range(slots):
        h = mix(items + U((step + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = (step + ((h >> U(32)) * U(slots - step) >> U(32)).astype(np.int64)).astype(np.intp)
        if step == 0:
            slot, first_pick = pick, pick
        else:
            at = np.arange(len(items))
            slot = order[at, pick].astype(np.intp)
            order[at, pick] = order[:, step]
            order[:, step] = slot
        np.minimum.at(out, row * slots + slot, (h & U(0xFFFFFFFF)) | U(step << 32))
        open_rows = (out.reshape(-1, slots) == EMPTY).any(1)
        stay = open_rows[row]
        if not stay.any():
            break
        if step == 0:
            items, row, first_pick = items[stay], row[stay], first_pick[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(items), 1))
            at = np.arange(len(items))
            order[at, first_pick] = 0
            order[:, 0] = first_pick
        elif not stay.all():
            items, row, order = items[stay], row[stay], order[stay]
    return out.reshape(len(sets), slots)


def band_keys(signs: np.ndarray) -> np.ndarray:
    s = signs.reshape(len(signs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), s.shape[:2])
    for k in range(ROWS):
        key = mix(key * STEP[5 + k] + s[:, :, k])
    return key.astype(np.int64)


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sign binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        sets = shingle_sets(texts)
        signs = signatures(sets)
        keys, low = band_keys(signs), (mix(signs) & U(255)).astype(np.uint8)
        sums = [[int(mix(s * STEP[k]).sum(dtype=U).astype(np.int64)) for s in sets] for k in (10, 11)]
        some = np.array([len(s) > 0 for s in sets])
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()), mask=pa.array(~some)),
                pa.array([x.tobytes() for x in low], pa.binary()),
            ],
            ["doc_id", "n_shingles", "h1", "h2", "keys", "sign"],
        )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (grp, side, doc_id, root, n, sign): links (a, b) between the roots of a group's possibly similar members.

    Side 1 meets side 0, side 2 meets itself. Links already implied by others of the group are left out."""
    for _, rows in _groups(batches, ["grp"]):
        side = np.array(rows["side"])
        root, n = (np.array(rows[c], np.int64) for c in ("root", "n"))
        sign = np.frombuffer(b"".join(rows["sign"]), np.uint8).reshape(len(n), -1)
        names, at = np.unique(root, return_inverse=True)
        group = np.arange(len(names))
        right = np.flatnonzero(side != 1)
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(side >= 1):
            other = right[group[at[right]] != group[at[i]]]
            other = other[100 * np.minimum(n[other], n[i]) >= 75 * np.maximum(n[other], n[i])]
            if len(other):
                near = np.unique(at[other[(sign[other] == sign[i]).mean(1) >= LEAST_ALIKE]])
                for r in near:
                    if group[r] != group[at[i]]:
                        found.append((int(names[at[i]]), int(names[r])))
                        group[group == group[r]] = group[at[i]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (grp, side, doc_id, root, text), sorted so that in each group sides 2 and 1 come before 0: all links (a, b) of
    different roots. The group's first rows are indexed by shingle; the others, or on side 2 they themselves, look up
    theirs one by one. Each row gives a link to each root at most."""
    key, ids, roots, sets, index, both = None, [], [], [], None, False
    found: list[tuple[int, int]] = []

    def close() -> None:
        nonlocal index
        sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, U)
        order = np.argsort(flat, kind="stable")
        index = (flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes, np.array(ids, np.int64), np.array(roots, np.int64))

    def look(doc: int, root: int, own: np.ndarray) -> None:
        flat, who, sizes, names, theirs = index
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        count = hi - lo
        hit = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(who[hit], minlength=len(sizes))
        good = np.flatnonzero((theirs != root) & (100 * shared >= 75 * (sizes + len(own) - shared)))
        if len(good):
            for k in good[np.unique(theirs[good], return_index=True)[1]]:
                found.append((min(doc, int(names[k])), max(doc, int(names[k]))))

    def ended() -> None:
        if both:
            close()
            for x in zip(ids, roots, sets, strict=True):
                look(*x)

    for part, texts in slices(batches):
        cols = part.to_pydict()
        for grp, side, doc, root, own in zip(cols["grp"], cols["side"], cols["doc_id"], cols["root"], shingle_sets(texts), strict=True):
            if grp != key:
                ended()
                key, ids, roots, sets, index, both = grp, [], [], [], None, False
            if side:
                ids.append(doc), roots.append(root), sets.append(own)
                both |= side == 2
            else:
                if index is None:
                    close()
                look(doc, root, own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
            found = []
    ended()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Runs of rows with equal keys, of sorted batches, as dicts of lists."""
    held, rows = None, None
    for batch in batches:
        cols = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
        ks = list(zip(*(cols[k] for k in keys), strict=True))
        begin = 0
        for i in range(1, len(ks) + 1):
            if i == len(ks) or ks[i] != ks[begin]:
                if rows is not None and held == ks[begin]:
                    for c in rows:
                        rows[c].extend(cols[c][begin:i])
                else:
                    if rows is not None:
                        yield held, rows
                    held, rows = ks[begin], {c: v[begin:i] for c, v in cols.items()}
                begin = i
    if rows is not None:
        yield held, rows


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, salt, role, doc_id, text) sorted by (a, salt, role), role 0 being a itself, the pairs of 0.75 or more."""
    key, own = None, None
    for part, texts in slices(batches):
        cols = part.to_pydict()
        found: list[tuple[int, int]] = []
        for a, salt, role, b, s in zip(cols["a"], cols["salt"], cols["role"], cols["doc_id"], shingle_sets(texts), strict=True):
            if role == 0:
                own = [s] if key != (a, salt) else [*own, s]
                key = (a, salt)
            else:
                for o in own if key == (a, salt) else []:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if both and 100 * both >= 75 * (len(o) + len(s) - both):
                        found.append((a, b))
                        break
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _told(rows: DataFrame, facts: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows(doc_id, ...) with what facts, one row for each key, says of their key. Facts that a count shows to be few go to
    all tasks; others are repeated for SALTS parts of each key, so that no task gets all rows of one."""
    if facts.count() <= MOST_SENT:
        return rows.join(F.broadcast(facts), key, how)
    parts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(parts, [*key, "salt"], how).drop("salt")


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows(doc_id, ...) with the documents' columns of table. Rows that a count shows to be few go to all tasks, so that
    only what is asked for moves; else both sides are shuffled by doc_id."""
    rows = checkpoint(rows)
    return table.join(F.broadcast(rows) if rows.count() <= MOST_SENT else rows, "doc_id")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of 0.75 or more.

    Each a goes with up to BLOCK of its partners to a task; an a with more of them is sent again for every BLOCK."""
    many = checkpoint(pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("a", F.ceil(F.col("c") / BLOCK).cast("int").alias("salts")))
    salted = _told(pairs.select("a", F.col("b").alias("doc_id")), many, ["a"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    stars = salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()
    rows = _with(salted.select("a", "salt", F.lit(1).alias("role"), "doc_id").union(stars), texts).select("a", "salt", "role", "doc_id", "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Words are runs of non-white-space, A-Z lower-cased; a set is the distinct 5-word shingles, or the whole sequence if a
    text has fewer words. Texts without words (null, empty, blank) have size 0 and link with nothing. Links have
    100 * intersection >= 75 * union; component_id is the least doc_id reachable over links. Rows of equal doc_id are one
    document; each of them appears. A row without doc_id links with nothing: component_id null, kept true. Other columns
    are ignored; an empty table gives an empty result."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = checkpoint(docs.select("doc_id", "text").mapInArrow(_sign, SIGNED))
    some = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one document for each set: the least; what its rows hold besides follows from the set
    sets = checkpoint(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sign").alias("sign")))
    solo = sets.select(F.col("rep").alias("doc_id"), "n", "keys", "sign")

    rows = solo.select("doc_id", "n", F.explode("keys").alias("key"))
    heads = rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    bucket = checkpoint(rows.join(heads, "key").select("key", "doc_id", "n", F.col("head.doc_id").alias("head"), F.col("head.n").alias("head_n")))
    fit = 100 * F.least("n", "head_n") >= 75 * F.greatest("n", "head_n")
    pairs = checkpoint(bucket.where((F.col("doc_id") != F.col("head")) & fit).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct())
    roots = components(checkpoint(confirm(pairs, texts)))  # a task of two Python steps would hold two workers
    more = _left_over(bucket, solo, texts, roots)
    copies = checkpoint(sets.where("rep <> last").select("h1", "h2", "rep"))
    more = more.union(_of_one_id(some, copies))
    rooted = _rooted(roots, more)
    rep = _told(some.select("doc_id", "n_shingles", "h1", "h2"), copies, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    linked = _told(rep, checkpoint(rooted.select(F.col("node").alias("rep"), "root")), ["rep"], "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _of_one_id(some: DataFrame, copies: DataFrame) -> DataFrame:
    """Links (a, b) between the least documents of the sets that one id holds, for ids of several different texts."""
    ids = some.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2") for f in (F.min, F.max)]).where("min_h1 <> max_h1 OR min_h2 <> max_h2").select("doc_id")
    held = _told(_with(ids, some.select("doc_id", "h1", "h2")).distinct(), copies, ["h1", "h2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def _rooted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(node, root) after further links (a, b): only the roots that they join are searched again."""

    def root(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))

    links = checkpoint(links.distinct())
    met = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    tops = components(met.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    below = _told(roots.withColumnRenamed("node", "doc_id"), tops, ["root"], "left").select(F.col("doc_id").alias("node"), F.coalesce("top", "root").alias("root"))
    # nodes that had no link before
    return below.union(tops.join(roots.select(F.col("node").alias("root")), "root", "left_anti"))


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, doc_id, root, ...) of the keys that hold several roots, in groups: further columns grp and side.

    A key's outsiders are those outside its most frequent root. Every block of outsiders meets every block of insiders, every
    later block of outsiders and itself; insiders never meet insiders. Side 1 of a group meets its side 0; side 2 meets
    itself."""
    sizes = rows.groupBy(key, "root").agg(F.count("*").alias("size"))
    info = sizes.groupBy(key).agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("main"), F.max("size").alias("ins"), F.sum("size").alias("all")).where("ins < all")
    info = checkpoint(info.select(key, "main", F.ceil((F.col("all") - F.col("ins")) / BLOCK).cast("int").alias("ob"), F.ceil(F.col("ins") / BLOCK).cast("int").alias("ib")))
    placed = _told(rows, info, [key]).withColumn("out", F.col("root") != F.col("main"))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.when(F.col("out"), F.col("ob")).otherwise(F.col("ib"))).cast("int"))
    groups = F.expr(
        "CASE WHEN out THEN concat(transform(sequence(1, ib), j -> struct(at AS i, 0 AS kind, j - 1 AS j, 1 AS side)), "
        "transform(sequence(0, ob - 1), j -> struct(least(at, j) AS i, 1 AS kind, greatest(at, j) AS j, CASE WHEN j = at THEN 2 WHEN at < j THEN 1 ELSE 0 END AS side))) "
        "ELSE transform(sequence(0, ob - 1), i -> struct(i AS i, 0 AS kind, at AS j, 0 AS side)) END")  # fmt: skip
    dealt = placed.withColumn("g", F.explode(groups))
    return dealt.select(*rows.columns, F.xxhash64(key, "g.i", "g.kind", "g.j").alias("grp"), F.col("g.side").alias("side"))


def _left_over(bucket: DataFrame, solo: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) between documents of a bucket that the first comparison left in different components.

    First signatures tell which components hold documents that may be similar; they make clusters. Then, in each cluster,
    the documents outside its largest component meet all others of the cluster on full sets."""
    roots = roots.withColumnRenamed("node", "doc_id")
    named = checkpoint(bucket.select("key", "doc_id", "n").join(roots, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("root", "doc_id").alias("root")))
    met = _with(_blocks(named, "key"), solo.select("doc_id", "sign")).select("grp", "side", "doc_id", "root", "n", "sign")
    near = checkpoint(met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_alike, "a long, b long"))
    cluster = components(near).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    mine = _told(roots, cluster, ["root"]).select("cluster", "doc_id", "root")
    alone = cluster.join(roots.select("root").distinct(), "root", "left_anti").select("cluster", F.col("root").alias("doc_id"), "root")
    rows = checkpoint(mine.union(alone))
    dealt = _with(_blocks(rows, "cluster").select("grp", "side", "doc_id", "root"), texts).select("grp", "side", "doc_id", "root", "text")
    return dealt.repartition("grp").sortWithinPartitions("grp", F.col("side").desc()).mapInArrow(_meet, "a long, b long")
