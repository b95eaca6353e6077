"""Benchmark decontamination by SimHash over item-sized windows.

Every item has a fingerprint: the signs of the sums, over its shingles of five
words with their multiplicities, of 64 random +1 and -1 each. Every window of a
document that is as long as some item has one, too. A fingerprint is four blocks of
16 bits; of two within 20 bits the first block pair is within 5 or another is within
4, so all of them are found by an equi-join on blocks, with the 6,885 and 2,517 values
that near each item block. Of pairs at a similarity of exactly 0.8, whose prints are
9.4 bits apart on average, at most 16 in 100,000 (simulated with 9 to 55 shingles) are
farther apart. Pairs within the radius are verified on the shingles themselves: the sum
of the smaller multiplicities by the sum of the larger ones is at least 0.8.

A window that is this similar to an item has nine tenths of its shingles from items
of its length; a bitmap of those shingles, of a size that is bounded whatever the
benchmark, leaves out all other windows before they are fingerprinted. Equal windows
are compared once, however many documents hold them.

Words are compared with A-Z in lower case. Items with fewer than five words have one
shingle, all their words. Defined cases: NULL or empty texts and items match nothing;
items that are equal all match; hits are reported per id, rows with a NULL id under
NULL; repeated rows give one hit; further columns are ignored, whatever their names;
empty tables give no hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planar.llm.scratch import written
from planar.llm.words import WORD_GAP, Words, hash_runs, hash_windows, mix, slices, split_words
from planar.plans.sizing import fits_broadcast

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS, BLOCK_BITS = 4, 16
# Bits by which a block may differ; with one more in each, the radius is exceeded.
NEAR = (5, 4, 4, 4)
# log2 of the bits in the bitmap: 256 bits per key within these limits.
LEAST_BITS, MOST_BITS = 16, 27

_GAP = re.compile(WORD_GAP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _least_shared(length: int, similarity: float) -> int:
    """Shingles that a window must share with an item of its length: with n each
    and s in common the similarity is s / (2 n - s)."""
    n = length - min(SHINGLE, length) + 1
    return max(1, int(np.ceil(2 * n * similarity / (1 + similarity) - 1e-9)))


def _word_hashes(words: Words) -> np.ndarray:
    return hash_runs(_LOWER[words.data], words.start, words.end)


def _of_length(h: np.ndarray, length: int) -> np.ndarray:
    """Shingle hashes as looked up for items of this length."""
    return mix(h ^ np.uint64(length * 0x9E3779B9))


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """One per row of shingle hashes."""
    out = np.zeros(len(shingles), np.uint64)
    for bit in range(64):
        ones = ((shingles >> np.uint64(bit)) & np.uint64(1)).sum(1)
        out |= (2 * ones > shingles.shape[1]).astype(np.uint64) << np.uint64(bit)
    return out


def shingle_counts(words: list[str]) -> Counter:
    k = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def weighted_similarity(a: list[str], b: list[str]) -> float:
    a, b = shingle_counts(a), shingle_counts(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item its length, fingerprint, words, and the bitmap places it needs."""
    for batch in batches:
        rows = {"item_id": [], "length": [], "print": [], "content": [], "keys": []}
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
            words = split_words(pa.array([text.as_py()], pa.string()))
            n = len(words.start)
            if not n:
                continue
            shingles = hash_windows(_word_hashes(words), min(SHINGLE, n))
            rows["item_id"].append(item)
            rows["length"].append(n)
            rows["print"].append(int(fingerprints(shingles[None]).view(np.int64)[0]))
            rows["content"].append(_content(words, 0, n))
            keys = np.concatenate([shingles, _of_length(shingles, n)])
            rows["keys"].append(np.unique(keys).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["item_id"], pa.int64()), pa.array(rows["length"], pa.int32()), pa.array(rows["print"], pa.int64()),
             pa.array(rows["content"], pa.string()), pa.array(rows["keys"], pa.list_(pa.int64()))],
            names=list(rows))


def _content(words: Words, first: int, n: int) -> str:
    low = _LOWER[words.data[words.start[first] : words.end[first + n - 1]]].tobytes().decode("utf-8")
    return " ".join(w for w in _GAP.split(low) if w)


def _bitmap(items: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of all shingle keys, and log2 of its bits. At most 2^21 rows, each
    with 64 bits, get to the driver."""
    n = items.agg(F.sum(F.size("keys"))).first()[0] or 1
    bits = int(min(max(np.ceil(np.log2(256 * n)), LEAST_BITS), MOST_BITS))
    place = items.select(F.explode("keys").alias("k")).select(F.shiftrightunsigned("k", 64 - bits).alias("p"))
    one = F.lit(1).cast("bigint")
    rows = place.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).collect()
    out = np.zeros(1 << (bits - 6), np.uint64)
    for w, b in rows:
        out[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return out, bits


def _found(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def windows(batch: pa.RecordBatch, lengths: list[int], bitmap: np.ndarray, bits: int, similarity: float) -> pa.RecordBatch:
    """The windows of a batch that have enough shingles of items of their length."""
    words = split_words(batch.column("text"))
    h = _word_hashes(words)
    owner = words.text
    rows = {"doc": [], "start": [], "length": [], "print": [], "content": []}
    known: dict[int, tuple[np.ndarray, ...]] = {}
    for length in lengths:
        k = min(SHINGLE, length)
        if k not in known:
            shingles = hash_windows(h, k)
            found = _found(bitmap, bits, shingles)
            known[k] = shingles, np.flatnonzero(found), np.concatenate([[0], np.cumsum(found)])
        shingles, hits, upto = known[k]
        n, need = length - k + 1, _least_shared(length, similarity)
        # The first shingle that counts is among the first n - need + 1.
        starts = np.unique((hits[:, None] - np.arange(n - need + 1)).ravel())
        starts = starts[(starts >= 0) & (starts + length <= len(h))]
        starts = starts[owner[starts] == owner[starts + length - 1]]
        starts = starts[upto[starts + n] - upto[starts] >= need]
        if not len(starts):
            continue
        inside = shingles[starts[:, None] + np.arange(n)]
        right = _found(bitmap, bits, _of_length(inside, length)).sum(1) >= need
        starts, inside = starts[right], inside[right]
        for start in starts:
            rows["start"].append(int(start - words.first[owner[start]]))
            rows["content"].append(_content(words, int(start), length))
        rows["doc"] += owner[starts].tolist()
        rows["length"] += [length] * len(starts)
        rows["print"] += fingerprints(inside).view(np.int64).tolist()
    docs = batch.select(["doc_id", "t"]).take(pa.array(rows["doc"], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [*docs.columns, pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int32()),
         pa.array(rows["print"], pa.int64()), pa.array(rows["content"], pa.string())],
        names=["doc_id", "t", "start", "length", "print", "content"])


def _flips(most: int = max(NEAR)) -> Column:
    """All masks that change at most so many bits of a block."""
    masks = [sum(1 << b for b in bits) for r in range(most + 1) for bits in combinations(range(BLOCK_BITS), r)]
    return F.lit(np.array(masks, np.int64))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row per block of ``print``: ``block``, ``value``."""
    values = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("print", BLOCK_BITS * i).bitwiseAND(
            F.lit((1 << BLOCK_BITS) - 1).cast("bigint")).alias("value"))
        for i in range(BLOCKS)
    ]
    return rows.select("*", F.inline(F.array(*values)))


def _text_key(text: str) -> Column:
    """Tells apart the texts of rows with equal ids, or none."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _met(
    docs: DataFrame, benchmark: DataFrame, similarity: float, text: str, id: str, item_text: str, item_id: str,  # noqa: A002
) -> DataFrame:
    """``doc_id, t`` (the key of the text), ``item_id, similarity`` and the place of
    every window of a document that is similar enough to an item."""
    spark: SparkSession = docs.sparkSession
    given = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    items = written(spark, given.mapInArrow(
        _item_rows, "item_id bigint, length int, print bigint, content string, keys array<bigint>").withColumn(
            "number", F.monotonically_increasing_id()), "benchmark")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    bitmap, bits = _bitmap(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield windows(part, lengths, bitmap, bits, similarity)

    rows = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("doc_id"), _text_key(text).alias("t"), F.col(f"`{text}`").alias("text"))
    found = written(spark, rows.mapInArrow(
        scan, "doc_id bigint, t bigint, start bigint, length int, print bigint, content string"), "windows")

    # Each distinct window once; blocks meet within a length.
    distinct = found.groupBy("length", "content").agg(F.first("print").alias("print"))
    theirs = _blocks(distinct)
    flips = F.get(F.array(*[_flips(most) for most in NEAR]), F.col("block"))
    near = F.explode(F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).alias("value")
    ours = _blocks(items.select("number", "length", "print"))
    ours = ours.select("number", "length", "block", F.col("print").alias("item_print"), near)
    # The estimate does not see the thousands of values per block; never broadcast by it.
    pairs = theirs.join(ours.hint("merge"), ["length", "block", "value"])
    pairs = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = pairs.select("content", "number").distinct()
    pairs = pairs.join(items.select("number", "item_id", F.col("content").alias("item")), "number")

    @F.arrow_udf("double")
    def weighted(a: pa.Array, b: pa.Array) -> pa.Array:
        both = zip(a.to_pylist(), b.to_pylist())
        return pa.array([weighted_similarity(x.split(" "), y.split(" ")) for x, y in both], pa.float64())

    true = pairs.withColumn("similarity", weighted("content", "item")).where(F.col("similarity") >= similarity)
    return found.join(true.select("content", "item_id", "similarity"), "content")


def hits(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
    text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",  # noqa: A002
) -> DataFrame:
    """``doc_id, item_id, similarity, start, n_words``: the most similar window (the
    first of those) for every document and item that are similar enough."""
    met = _met(docs, benchmark, similarity, text, id, item_text, item_id)
    best = F.max_by(F.struct("similarity", "start", F.col("length").cast("bigint").alias("n_words")),
                    F.struct("similarity", -F.col("start")))
    return met.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
    text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",  # noqa: A002
) -> DataFrame:
    """The documents in which no window is similar to an item, unchanged. Rows with
    equal ids, or none, are told apart by their text."""
    met = _met(docs, benchmark, similarity, text, id, item_text, item_id)
    leaks = written(docs.sparkSession, met.select(
        F.col("doc_id").alias("_leak"), F.col("t").alias("_leak_text")).distinct(), "leaks")
    small = F.broadcast(leaks) if fits_broadcast(leaks) else leaks
    same = F.col(f"`{id}`").eqNullSafe(F.col("_leak")) & (_text_key(text) == F.col("_leak_text"))
    return docs.join(small, same, "left_anti")
