"""Similarity join on word n-grams: MinHash bands, then exact Jaccard.

1. One pass over the texts gives each a key of its words and a MinHash per band
   row. Texts with equal words are one class from here on, so copies cost nothing.
2. Band hashes are shuffled. A band that several classes share links them to the
   smallest of them, never to each other; the components of these links hold all
   candidate pairs.
3. The n-gram sets of those classes are made in a second pass and compared, a component
   at a time, or, if that needs fewer copies of the sets, a band's bucket at a time;
   there, a pair counts in the first bucket that it shares. What is too large is cut into
   blocks of bounded size and compared block by block, so no task holds a component,
   and a task gives back counts and a spanning forest of the links it found, not the links.
4. The components of these forests are the groups of near-duplicates.

With the similarity and recall given, rows and bands follow: the most rows per band
for which the bands fit ``MOST_HASHES``. Where a component is compared as a whole, every
pair in it is, which only adds to that recall.

Defined cases: a text of one to four words has one n-gram, all of them. Texts
without words (NULL, empty) are equal to each other. A NULL id is never a class id
unless the class has no other. Repeated rows are copies of each other. Further
columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.graph import components
from planar.llm.joins import attach
from planar.llm.scratch import written
from planar.llm.words import Words, hash_windows, mix, slices, split_words
from planar.plans.sizing import fits_broadcast

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 128
# A block of a component or bucket: at most about so many classes and n-grams.
BLOCK_CLASSES, BLOCK_NGRAMS = 1_024, 400_000
# Classes and n-grams of small components or buckets that share a task.
BIN_CLASSES, BIN_NGRAMS = 1_000, 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def banding(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """``(bands, rows)`` with which a pair of this similarity meets in some band
    with probability ``recall``."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def _ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, and where each text's begin and end; texts with
    fewer words have one, the hash of all their words."""
    h = words.hashes()
    count = np.diff(words.first)
    width = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    end = np.cumsum(width)
    begin = end - width
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    long = hash_windows(h, n)
    full = count >= n
    at = np.arange(len(out)) - np.repeat(begin, width) + np.repeat(words.first[:-1], width)
    from_long = np.repeat(full, width)
    out[from_long] = long[at[from_long]]
    for i in np.flatnonzero((count > 0) & ~full):
        own = h[words.first[i] : words.first[i + 1]]
        out[begin[i]] = hash_windows(own, len(own))[0]
    return out, begin, end


def _keys(words: Words) -> np.ndarray:
    """Two 64-bit hashes of the whole word sequence of each text."""
    h = words.hashes()
    place = (np.arange(len(h)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64)
    out = np.zeros((len(words.first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(words.first))
    for lane, salt in enumerate(_LANES):
        if len(some):
            out[some, lane] = mix(np.add.reduceat(mix((h ^ salt) + place * _ODD), words.first[some]) + salt)
    return out


def _bands(grams: np.ndarray, begin: np.ndarray, end: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes per text; texts without n-grams have zeros."""
    out = np.zeros((len(begin), bands), np.uint64)
    some = np.flatnonzero(end > begin)
    if not len(some):
        return out
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _ODD)
    # Parts that stay in a processor's cache.
    cut = np.concatenate([[0], np.flatnonzero(np.diff(begin[some] >> 15)) + 1, [len(some)]])
    for lo, hi in zip(cut[:-1], cut[1:]):
        texts = some[lo:hi]
        part = grams[begin[texts[0]] : end[texts[-1]]]
        starts = begin[texts] - begin[texts[0]]
        for band in range(bands):
            h = np.full(len(texts), np.uint64(band + 1))
            for salt in salts[band * rows : (band + 1) * rows]:
                low = np.minimum.reduceat((part ^ salt) * (salt | np.uint64(1)), starts)
                h = mix(h * _ODD ^ low)
            out[texts, band] = h
    return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """``id, t`` (given) with ``k1, k2`` and ``bands`` for ``id, t, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                keys = _keys(words).view(np.int64)
                hashes = _bands(*_ngrams(words, n), bands, rows).view(np.int64)
                offsets = pa.array(np.arange(len(hashes) + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("t"), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()),
                     pa.array(np.diff(words.first)), pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel()))],
                    names=["id", "t", "k1", "k2", "n_words", "bands"])

    return docs.mapInArrow(scan, "id bigint, t bigint, k1 bigint, k2 bigint, n_words bigint, bands array<bigint>")


def _sets(n: int):
    """Sorted distinct n-gram hashes as bytes, for rows whose text has their key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                keys = _keys(words).view(np.int64)
                right = (keys[:, 0] == part.column("k1").to_numpy()) & (keys[:, 1] == part.column("k2").to_numpy())
                grams, begin, end = _ngrams(words, n)
                sets = [np.unique(grams[begin[i] : end[i]]).tobytes() for i in np.flatnonzero(right)]
                kept = part.filter(pa.array(right))
                names = ["node", "copies", "bands", "tiles"]
                yield pa.RecordBatch.from_arrays([*map(kept.column, names), pa.array(sets, pa.binary())], names=[*names, "grams"])

    return scan


def _shared(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices."""
    values = np.concatenate(sets + others)
    known, which = np.unique(values, return_inverse=True)
    often = np.bincount(which) > 1
    column = (np.cumsum(often) - 1)[which]
    keep = often[which]
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in sets + others])[keep]
    column = column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(others)), np.float32)
    width = 2048
    for low in range(0, int(often.sum()), width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        m = np.zeros((len(sets) + len(others), width), np.float32)
        m[owner[part], column[part] - low] = 1
        total += m[: len(sets)] @ m[len(sets) :].T
    return total


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that keep connected what ``pairs`` connect."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            kept.append((a, b))
    return kept


def _compare(similarity: float):
    """Within a tile: links of every class, weighed by copies, and a forest."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("unit", "ascending"), ("node", "ascending")])
        columns = {c: tile.column(c).to_numpy() for c in ("node", "unit", "copies", "side", "other", "band")}
        raw = tile.column("grams").to_pylist()
        # Rows that repeat a class's id and text give its set more than once.
        fresh = np.ones(len(raw), bool)
        fresh[1:] = (columns["node"][1:] != columns["node"][:-1]) | (columns["unit"][1:] != columns["unit"][:-1])
        columns = {c: v[fresh] for c, v in columns.items()}
        sets = [np.frombuffer(r, np.uint64) for r, f in zip(raw, fresh) if f]
        if columns["band"].max() >= 0:
            bands = tile.column("bands").combine_chunks()
            bands = bands.flatten().to_numpy().reshape(len(raw), -1)[fresh]
        out_a, out_b, out_n = [], [], []
        cuts = np.flatnonzero(np.diff(columns["unit"])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(sets)]):
            node, copies, side, other = (columns[c][lo:hi] for c in ("node", "copies", "side", "other"))
            group = sets[lo:hi]
            if side[0] != other[0]:  # two blocks
                if side.min() == side.max():
                    continue  # one of them is empty; the other has a tile of its own
                left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
            else:
                left = right = np.arange(len(group))
            size = np.array([len(s) for s in group], np.float32)
            both = _shared([group[i] for i in left], [group[i] for i in right])
            union = size[left][:, None] + size[right][None] - both
            near = both >= np.float32(similarity) * union - 1e-3
            # On the edge of the threshold, in whole numbers.
            i, j = np.nonzero(near)
            exact = both[i, j].astype(np.float64) >= similarity * union[i, j].astype(np.float64) - 1e-9
            i, j = left[i[exact]], right[j[exact]]
            apart = i != j
            i, j = i[apart], j[apart]
            band = columns["band"][lo]
            if band >= 0:
                # Pairs that share an earlier band have been counted there.
                own, here = bands[lo:hi], np.ones(len(i), bool)
                for earlier in range(band):
                    here &= own[i, earlier] != own[j, earlier]
                i, j = i[here], j[here]
            links = np.zeros(len(group), np.int64)
            np.add.at(links, i, copies[j])
            if left is not right:
                np.add.at(links, j, copies[i])
            linked = np.flatnonzero(links)
            out_a += node[linked].tolist()
            out_b += [None] * len(linked)
            out_n += links[linked].tolist()
            for a, b in _forest(np.stack([i, j], 1), len(group)):
                out_a.append(int(node[a]))
                out_b.append(int(node[b]))
                out_n.append(0)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return run


_TILES = "array<struct<tile:bigint,unit:bigint,side:int,other:int,band:int>>"


def _blocks(classes: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(F.greatest(classes / BLOCK_CLASSES, grams / BLOCK_NGRAMS)), F.lit(1)).cast("int")


def _tiles(unit: str, blocks: str, band: Column, bins: int, first: int = 0) -> Column:
    """The tiles that a class of a unit (component or bucket) goes to: one for each other
    block of the unit, or one that small units share, numbered from ``first``."""
    side = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")

    def tile(number: Column, side: Column, other: Column) -> Column:
        return F.struct(
            number.alias("tile"), F.col(unit).alias("unit"), side.alias("side"), other.cast("int").alias("other"), band.alias("band"))

    def pair(j: Column) -> Column:
        return tile(F.xxhash64(unit, F.least(side, j), F.greatest(side, j)), side, j)

    small = tile(F.pmod(F.xxhash64(unit), F.lit(bins)) + first, F.lit(-1), F.lit(-1))
    return F.when(F.col(blocks) > 1, F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), pair)).otherwise(F.array(small)).cast(_TILES)


def _placed(loose: DataFrame, classes: DataFrame, met: DataFrame, shared: DataFrame) -> DataFrame:
    """Of all classes of candidate components the ``tiles`` they are compared in."""
    spark = loose.sparkSession
    sizes = loose.join(classes.select("node", "n_words"), "node").groupBy("label").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("grams"))
    sizes = written(spark, sizes.withColumn("blocks", _blocks(F.col("m"), F.col("grams"))), "components")
    # Sets to be copied: each to all blocks of its component, or of its buckets.
    large = sizes.where("blocks > 1").select("label", (F.col("m") * F.col("blocks")).alias("whole"))
    owner = attach(loose, large, "label", "inner").select(F.col("node").alias("low"), "label", "whole")
    buckets = shared.withColumn("blocks", _blocks(F.col("m"), F.col("grams"))).join(owner, "low")
    parts = buckets.groupBy("label", "whole").agg(F.sum(F.col("m") * F.col("blocks")).alias("parts"))
    by_band = written(spark, parts.where("parts < whole").select("label"), "by-band").withColumn("by_band", F.lit(True))
    total = sizes.where("blocks = 1").agg(F.sum("m").alias("m"), F.sum("grams").alias("grams")).first()

    def bins(m: int | None, grams: int | None) -> int:
        return max(1, (m or 0) // BIN_CLASSES, (grams or 0) // BIN_NGRAMS)

    whole = attach(loose, sizes.join(by_band, "label", "left").where("by_band IS NULL").select("label", "blocks"), "label", "inner")
    tiles = _tiles("label", "blocks", F.lit(-1), bins(total.m, total.grams))
    out = whole.select("node", tiles.alias("tiles"))
    if not by_band.isEmpty():
        chosen = buckets.join(by_band, "label").select("bucket", "blocks", "m", "grams")
        chosen = written(spark, chosen, "buckets")
        total = chosen.where("blocks = 1").agg(F.sum("m").alias("m"), F.sum("grams").alias("grams")).first()
        rows = attach(met, chosen.select("bucket", "blocks"), "bucket", "inner")
        tiles = _tiles("bucket", "blocks", F.col("band"), bins(total.m, total.grams), 1 << 40)
        rows = rows.select("node", tiles.alias("tiles")).groupBy("node").agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
        out = out.unionByName(rows)
    keys = classes.select("node", "k1", "k2", "t", "rep", "copies", "bands")
    return written(spark, out.join(keys, "node"), "placed")


def near_groups(
    docs: DataFrame, similarity: float = SIMILARITY, n: int = NGRAM, recall: float = RECALL,
    text: str = "text", id: str = "doc_id",  # noqa: A002
) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the smallest id of its group of
    near-duplicates), ``n_links`` (other documents at least this similar to it) and
    ``n_copies`` (other documents with the same words), and ``first`` for one
    document of each group; ``t`` is the hash of its text."""
    spark = docs.sparkSession
    bands, rows = banding(similarity, recall)
    # ``t`` tells texts apart on the JVM, where a join can use it.
    given = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    given = given.withColumn("t", F.xxhash64("text"))
    signed = written(spark, signatures(given.select("id", "t", "text"), bands, rows, n), "signatures")
    # One row of each class stands for it; NULL ids come last.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    classes = signed.groupBy("k1", "k2").agg(
        least.alias("least"), F.count(F.lit(1)).alias("copies"),
        F.max("n_words").alias("n_words"), F.first("bands").alias("bands"))
    classes = classes.select("k1", "k2", F.col("least.id").alias("rep"), "copies", F.col("least.t").alias("t"), "n_words", "bands")
    classes = written(spark, classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    met = classes.where(F.col("n_words") > 0).select("node", "n_words", F.posexplode("bands").alias("band", "hash"))
    met = met.select("node", "n_words", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = met.groupBy("bucket").agg(
        F.min("node").alias("low"), F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("grams")).where("m > 1")
    shared = written(spark, shared, "shared-bands")
    stars = attach(met, shared.select("bucket", "low"), "bucket", "inner").where(F.col("node") != F.col("low"))
    loose = written(spark, components(stars.select(F.col("node").alias("a"), F.col("low").alias("b"))), "loose")
    placed = _placed(loose, classes, met.select("node", "band", "bucket"), shared)

    chosen = F.broadcast(placed) if fits_broadcast(placed, 2) else placed
    again = given.join(chosen, (given["t"] == chosen["t"]) & given["id"].eqNullSafe(chosen["rep"])).select(
        "node", "k1", "k2", "copies", "bands", "tiles", "text")
    sets = again.mapInArrow(_sets(n), f"node bigint, copies bigint, bands array<bigint>, tiles {_TILES}, grams binary")
    # Only buckets need the bands.
    bands_of = F.when(F.col("tile.band") >= 0, F.col("bands"))
    sets = sets.select("node", "copies", "bands", "grams", F.explode("tiles").alias("tile")).select(
        "node", "copies", "grams", bands_of.alias("bands"), "tile.*")
    found = written(spark, sets.groupBy("tile").applyInArrow(_compare(similarity), "a bigint, b bigint, n bigint"), "links")

    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    known = classes.select("node", "k1", "k2", "rep", "t", "copies").join(groups, "node", "left").join(links, "node", "left")
    known = known.where((F.col("copies") > 1) | F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "node"))
    # The row that stays: the one with the smallest id, NULL last, then by its text.
    heads = known.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "t")).alias("head"))
    known = written(spark, known.join(heads, "label").select(
        "k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.col("head.rep").alias("class_id"), F.col("head.t").alias("head_t")), "near-classes")
    out = attach(signed.select("id", "t", "k1", "k2"), known, ["k1", "k2"])
    other = F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(
        F.col("id").alias("doc_id"), "t", F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + other).cast("bigint").alias("n_links"), other.cast("bigint").alias("n_copies"),
        F.when(F.col("head_t").isNull(), True).otherwise(
            (F.col("t") == F.col("head_t")) & F.col("id").eqNullSafe(F.col("class_id"))).alias("first"))


def one_of_each(
    docs: DataFrame, similarity: float = SIMILARITY, n: int = NGRAM, recall: float = RECALL,
    text: str = "text", id: str = "doc_id",  # noqa: A002
) -> DataFrame:
    """The documents, unchanged, of which each group of near-duplicates keeps the one
    with the smallest id. Of rows that repeat it as a whole one stays."""
    spark = docs.sparkSession
    groups = near_groups(docs, similarity, n, recall, text, id).where("first").select(
        F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    t = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    same = F.col(f"`{id}`").eqNullSafe(F.col("_id")) & (t == F.col("_t"))
    firsts = groups.groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_n"))
    firsts = written(spark, firsts, "firsts")
    once, often = firsts.where("_n = 1"), firsts.where("_n > 1")
    out = docs.join(_small(once), same, "left_semi")
    if often.isEmpty():
        return out
    # Rows that repeat each other in id and text; any of them will do.
    again = docs.join(_small(often), same, "left_semi")
    return out.unionByName(again.dropDuplicates([id, text]))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df
