"""Removing word sequences that an earlier document has, by partitioned suffix trees.

A suffix starts at every word. Suffixes are split by prefixes of variable length:
by the first word, and where one word starts too many, by the second as well, and so
on, until every group fits in memory; whole passes over the texts count them. The
only nodes of a group's tree that matter are those ``window`` words deep, and no others
are made: hashes of all windows, sorted, stand for them. Leaves under one such node are
a repeat, and a chain of them through consecutive words is a maximal one.

Documents are cut into buckets by a hash of their id and text. A bucket sends each group the
distinct depth-``window`` nodes it has there, once, with the smallest id under
them, and gets back a bit for each: whether another bucket has a smaller id. So a
passage that every document holds costs a group one leaf per bucket. Nodes are known by
64-bit hashes of their word sequence, within a group of equal prefixes.

The texts are shuffled once; both uses read that shuffle. Documents with the text of
a smaller id are found beforehand by a digest, and have no suffixes of their own.

Defined cases: NULL and empty texts have no words. A NULL id is not smaller than any
and none is smaller than it: such rows keep all words and remove none. Rows with equal
ids do not remove each other's words. A text shorter than a window keeps all its words.
Further columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.scratch import written
from planar.llm.words import Words, hash_windows, mix, slices, split_words, window_starts

WINDOW = 13
BUCKET_BYTES = 6 << 20
GROUP_LEAVES = 2_000_000
_FIRST_BITS, _NEXT_BITS = 16, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- prefixes ------------------------------------------------------------------


@dataclass
class Plan:
    """Where suffixes go. A prefix is known by a hash of some bits of its words; ``open``
    has, by depth, the sorted ones that are split by one more word. What is not open is
    dealt to ``groups``."""

    groups: int
    open: list[np.ndarray]

    def _walk(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The prefix that each suffix ends up at, which suffixes are below all open
        ones, and their prefixes."""
        prefix = mix((h[starts] >> np.uint64(64 - _FIRST_BITS)) + np.uint64(1))
        still = np.arange(len(starts))
        for depth, known in enumerate(self.open, 1):
            here = prefix[still]
            hit = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
            still = still[hit]
            bits = h[starts[still] + depth] >> np.uint64(64 - _NEXT_BITS)
            prefix[still] = mix(prefix[still] * _ODD + bits + np.uint64(1))
        return prefix, still, prefix[still]

    def place(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The group of each suffix."""
        return (self._walk(h, starts)[0] % np.uint64(self.groups)).astype(np.int64)


def _suffixes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the words at which a whole window starts."""
    return words.hashes(), window_starts(words.first, window)


def _count(docs: DataFrame, plan: Plan, window: int) -> DataFrame:
    """``prefix, n``: the suffixes below all open prefixes; a task has 65,536 prefixes at
    most at first, and 256 per open one later."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h, starts = _suffixes(split_words(part.column("text")), window)
                here, times = np.unique(plan._walk(h, starts)[2], return_counts=True)
                known, which = np.unique(np.concatenate([known, here]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([n, times]), minlength=len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["prefix", "n"])

    rows = docs.select("text").mapInArrow(scan, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    return written(docs.sparkSession, rows, "prefixes")


def plan_groups(docs: DataFrame, window: int, leaves: int) -> tuple[Plan, int]:
    """Prefixes such that none has more than ``leaves`` suffixes, unless they agree in a
    whole window; and the bytes of all texts. The counts stay in Spark; only the prefixes
    to be split, one per ``leaves`` suffixes at most, come to the driver."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    plan = Plan(1, [])
    counts = _count(docs, plan, window)
    plan.groups = max(1, -(-2 * (counts.agg(F.sum("n")).first()[0] or 0) // leaves))
    while len(plan.open) < window - 1:
        crowd = [r.prefix for r in counts.where(F.col("n") > leaves).collect()]
        if not crowd:
            break
        plan.open.append(np.sort(np.array(crowd, np.int64).view(np.uint64)))
        counts = _count(docs, plan, window)
    return plan, size


# --- leaves of a bucket --------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


@dataclass
class Bucket:
    """The documents of a bucket by id, and the nodes under them, by group."""

    ids: list
    words: Words
    copies: np.ndarray  # per document: has the text of a smaller id
    start: np.ndarray  # per suffix: its word
    owner: np.ndarray  # and its document
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    # group, nodes, smallest id per node, suffixes of the group, node per suffix


def _bucket(docs: pa.Table, copies: set[tuple[int, int]], plan: Plan, window: int) -> Bucket:
    ids, t = docs.column("doc_id").to_pylist(), docs.column("t").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, t[i]))
    docs = docs.take(pa.array(order, pa.int64()))
    ids = [ids[i] for i in order]
    copy = np.array([(ids[i], t[o]) in copies for i, o in enumerate(order)], bool)
    words = split_words(docs.column("text").combine_chunks())
    h, start = _suffixes(words, window)
    owner = np.searchsorted(words.first, start, "right") - 1
    known = np.array([i is not None for i in ids], bool)
    right = (known & ~copy)[owner]
    node = hash_windows(h, window)
    start, owner = start[right], owner[right]
    node = node[start]
    where = plan.place(h, start)
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    number = np.array([i or 0 for i in ids], np.int64)
    groups = []
    for part in np.split(order, cuts) if len(order) else []:
        nodes, which = np.unique(node[part], return_inverse=True)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, which, number[owner[part]])
        groups.append((int(where[part[0]]), nodes, least, part, which))
    return Bucket(ids, words, copy, start, owner, groups)


def _copies_of(side: pa.Table) -> set[tuple[int, int]]:
    rows = side.filter(pc.equal(side.column("grp"), -1))
    return set(zip(rows.column("doc_id").to_pylist(), rows.column("t").to_pylist()))


def _leaves(plan: Plan, window: int):
    def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
        rows = {"bucket": [], "grp": [], "nodes": [], "ids": []}
        if docs.num_rows:
            number = docs.column("bucket")[0].as_py()
            for group, nodes, least, _, _ in _bucket(docs, _copies_of(copies), plan, window).groups:
                rows["bucket"].append(number)
                rows["grp"].append(group)
                rows["nodes"].append(_packed(np.diff(nodes, prepend=np.uint64(0))))
                rows["ids"].append(_packed(least))
        return pa.table({
            "bucket": pa.array(rows["bucket"], pa.int32()), "grp": pa.array(rows["grp"], pa.int32()),
            "nodes": pa.array(rows["nodes"], pa.binary()), "ids": pa.array(rows["ids"], pa.binary())})

    return run


def _tree(group: pa.Table) -> pa.Table:
    """Leaves of all buckets in a group; a bit for each that is not of the smallest id."""
    nodes = [np.cumsum(_unpacked(x, np.uint64)) for x in group.column("nodes").to_pylist()]
    ids = [_unpacked(x, np.int64) for x in group.column("ids").to_pylist()]
    ends = np.cumsum([len(n) for n in nodes])
    node, id_ = np.concatenate(nodes), np.concatenate(ids)
    del nodes, ids
    order = np.argsort(node, kind="stable")
    node, id_ = node[order], id_[order]
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    least = np.repeat(np.minimum.reduceat(id_, begin), np.diff(np.append(begin, len(node))))
    later = np.zeros(len(node), bool)
    later[order] = id_ > least
    bits = [_packed(np.packbits(part)) for part in np.split(later, ends[:-1])]
    return pa.table({
        "bucket": group.column("bucket"), "grp": group.column("grp"), "data": pa.array(bits, pa.binary()),
        "doc_id": pa.nulls(len(bits), pa.int64()), "t": pa.nulls(len(bits), pa.int64())})


def _cleaned(plan: Plan, window: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "removed": []}
        if docs.num_rows:
            marks = {g: d for g, d in zip(side.column("grp").to_pylist(), side.column("data").to_pylist()) if g >= 0}
            bucket = _bucket(docs, _copies_of(side), plan, window)
            gone = np.zeros(len(bucket.words.start) + 1, np.int64)
            number = np.array([i or 0 for i in bucket.ids], np.int64)
            for group, nodes, least, part, which in bucket.groups:
                later = np.unpackbits(_unpacked(marks[group], np.uint8), count=len(nodes)).astype(bool)
                hit = bucket.start[part[later[which] | (number[bucket.owner[part]] > least[which])]]
                np.add.at(gone, hit, 1)
                np.subtract.at(gone, hit + window, 1)
            gone = np.cumsum(gone)[:-1] > 0
            first = bucket.words.first
            for i in np.flatnonzero(bucket.copies):
                if first[i + 1] - first[i] >= window:
                    gone[first[i] : first[i + 1]] = True
            at, data = bucket.words.text_at, bucket.words.data
            for i, id_ in enumerate(bucket.ids):
                mine = gone[first[i] : first[i + 1]]
                words = data[at[i] : at[i + 1]].tobytes().split()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                out["doc_id"].append(id_)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(mine.sum()))
                out["kept"].append(b" ".join(compress(words, (~mine).tolist()) if len(edges) else words).decode())
                out["removed"].append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string()),
            "removed": pa.array(out["removed"], kind)})

    return run


def bucket_of(n: int) -> Column:
    """Of ``n`` buckets; with the hash of the text, rows without an id, or with the
    same, spread over all of them."""
    return F.pmod(F.xxhash64("doc_id", "t"), F.lit(n)).cast("int")


def dedup(
    docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id",  # noqa: A002
    bucket_bytes: int = BUCKET_BYTES, group_leaves: int = GROUP_LEAVES,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the other words, joined by spaces) and
    ``removed`` (maximal spans of removed words) for every row."""
    given = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    plan, size = plan_groups(given, window, group_leaves)
    given = given.withColumn("t", F.xxhash64("text"))
    n = max(1, -(-size // bucket_bytes))
    bucket = bucket_of(n)

    narrow = given.where(F.col("doc_id").isNotNull()).select("doc_id", "t", F.md5("text").alias("digest"))
    narrow = written(docs.sparkSession, narrow, "digests")
    least = narrow.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = attach(narrow, least, "digest", "inner").where(F.col("doc_id") > F.col("low")).select("doc_id", "t").distinct()
    copies = copies.select(
        bucket.alias("bucket"), F.lit(-1).alias("grp"), F.lit(None).cast("binary").alias("data"),
        F.col("doc_id").alias("doc_id"), F.col("t").alias("t"))  # new columns, for the cogroup to tell apart

    buckets = given.select(bucket.alias("bucket"), "doc_id", "t", "text")
    by_bucket = buckets.groupBy("bucket")
    leaves = by_bucket.cogroup(copies.groupBy("bucket")).applyInArrow(
        _leaves(plan, window), "bucket int, grp int, nodes binary, ids binary")
    marks = leaves.groupBy("grp").applyInArrow(_tree, "bucket int, grp int, data binary, doc_id bigint, t bigint")
    return by_bucket.cogroup(marks.unionByName(copies).groupBy("bucket")).applyInArrow(
        _cleaned(plan, window),
        "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:bigint,end:bigint>>")
