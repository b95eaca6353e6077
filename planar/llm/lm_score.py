"""Language-model scores by context-tree weighting over bytes, beside word counts.

The model predicts each byte bit by bit. For the bits so far of a byte there is a
tree of contexts, the last 0 to ``DEPTH`` bytes; every node has a Krichevsky-
Trofimov estimate from the counts of its bits, and its weighted probability is
half its own estimate and half the product of its children's. Mixing over all
depths is then a matter of one weight per node. A node that training never reached
predicts 1/2 at all depths. ``DEPTH`` may be up to 7, what a 64-bit key holds beside the
byte itself.

How it is spread out. Documents are cut into buckets by a hash. A bucket sends its
distinct strings of ``DEPTH + 1`` bytes, with their counts in training texts, to the groups
of trees they belong to: a message is both a contribution and a question. Groups are made of
trees below a context of two bytes; where that is too much, of three or more. A first
pass over the messages works out what the trees below the cuts add up to, from which the
few nodes above follow; a second one answers every message with log probabilities. Trees for
different bits of a byte do not touch, so a group handles one bit after the other.

Texts are lower-cased (A-Z) and end with a NUL byte, which counts; contexts before
the start are NUL. Defined cases: a NULL text is an empty one; a NULL id is hashed as
an empty text; repeated rows count each; without training texts every bit has
probability 1/2. Further columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.scratch import written
from planar.llm.words import hash_runs, mix, slices, split_words, text_bytes

DEPTH = 5
BUCKET_BYTES = 8 << 20
# Bytes of text whose contexts a group has, and words a group of words has, at most.
GROUP_BYTES, GROUP_WORDS = 32 << 20, 1_000_000
# Context bytes that all groups are cut by; deeper cuts follow.
_FIRST_CUT = 2
_SLICE = 1 << 20
_FLUSH_KEYS = 1_500_000
END = np.uint64(0x5851F42D4C957F2D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HALF = float(np.log(0.5))


# --- contents of texts ---------------------------------------------------------


def strings(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The ``depth + 1`` bytes up to every byte, as integers, and how many each text
    has; a text's NUL end is one of its bytes."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    length = np.diff(at) + 1
    begin = np.cumsum(length) - length
    # depth NULs before every text keep contexts apart.
    room = length + depth
    start = np.cumsum(room) - room + depth
    line = np.zeros(int(room.sum()), np.uint8)
    place = np.arange(len(data)) + np.repeat(start - at[:-1], np.diff(at))
    line[place] = _LOWER[data]
    where = np.arange(int(length.sum())) + np.repeat(start - begin, length)
    ends = np.zeros(max(0, len(line) - depth), np.uint64)
    for back in range(depth, -1, -1):
        ends <<= np.uint64(8)
        ends |= line[depth - back : len(line) - back]
    return ends[where - depth], length if n else np.zeros(0, np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts with an end each, and how many
    tokens each text has."""
    words = split_words(texts)
    h = hash_runs(_LOWER[words.data], words.start, words.end)
    counts = np.diff(words.first)
    ends = np.cumsum(counts + 1) - 1
    out = np.full(int((counts + 1).sum()), END)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = h
    return out, counts + 1


def _word_group(keys: np.ndarray, groups: int) -> np.ndarray:
    """Negative, unlike the groups of trees."""
    return -1 - (keys % np.uint64(groups)).astype(np.int64)


def _context(keys: np.ndarray, length: int) -> np.ndarray:
    """The last so many bytes before the byte that a key ends with."""
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * length)) - 1)


@dataclass
class Cuts:
    """Which trees go together: those below the contexts of ``_FIRST_CUT`` bytes, dealt to
    ``groups``, but for contexts in ``open`` (by length, sorted), which are cut by one more
    byte and dealt to sixteen groups each."""

    groups: int
    open: dict[int, np.ndarray]

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each string, and the length of the context it is cut at."""
        cut = np.full(len(keys), _FIRST_CUT, np.int64)
        group = (mix(_context(keys, _FIRST_CUT)) % np.uint64(self.groups)).astype(np.int64)
        still = np.arange(len(keys))
        for length in sorted(self.open):
            context, known = _context(keys[still], length), self.open[length]
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            hit = known[at] == context
            still, context = still[hit], context[hit]
            nibble = (keys[still] >> np.uint64(8 * length + 12)) & np.uint64(15)
            own = mix((context << np.uint64(4) | nibble) + np.uint64(length) * END)
            group[still] = ((own >> np.uint64(2)) | np.uint64(1 << 61)).astype(np.int64)
            cut[still] = length + 1
        return group, cut


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and which one each is, like ``np.unique``; hashing
    is faster where keys repeat a lot."""
    codes, known = pd.factorize(keys)
    order = np.argsort(known)
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    return known[order], place[codes]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, which = distinct(keys)
    return known, np.bincount(which, weights=n, minlength=len(known)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes by their context of ``_FIRST_CUT`` bytes, of all of a task's texts."""
    total = np.zeros(1 << (8 * _FIRST_CUT), np.int64)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            keys, _ = strings(part.column("text"), _FIRST_CUT)
            total += np.bincount(_context(keys, _FIRST_CUT).astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["context", "n"])


def _count_below(open_: np.ndarray, length: int):
    """Bytes by contexts that are one byte longer than an open one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                keys, _ = strings(part.column("text"), length + 1)
                at = np.minimum(np.searchsorted(open_, _context(keys, length)), len(open_) - 1)
                keys = _context(keys[open_[at] == _context(keys, length)], length + 1)
                known, n = _summed(np.concatenate([known, keys]), np.concatenate([n, np.ones(len(keys), np.int64)]))
                if len(known) > _FLUSH_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["context", "n"])
                    known, n = known[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["context", "n"])

    return scan


def plan_cuts(docs: DataFrame, group_bytes: int) -> tuple[Cuts, int]:
    """Cuts such that no group has the contexts of more than about ``group_bytes`` of text,
    as far as ``DEPTH`` goes, and the bytes of all texts. Only contexts with more than
    that come to the driver, one per ``group_bytes`` of text at most."""
    kind = "context bigint, n bigint"
    counts = docs.select("text").mapInArrow(_count, kind).groupBy("context").agg(F.sum("n").alias("n"))
    counts = written(docs.sparkSession, counts, "contexts")
    size = counts.agg(F.sum("n")).first()[0] or 0
    cuts = Cuts(max(1, -(-2 * size // group_bytes)), {})
    for length in range(_FIRST_CUT, DEPTH):
        crowd = np.array([r.context for r in counts.where(F.col("n") > group_bytes).collect()], np.int64)
        if not len(crowd):
            break
        cuts.open[length] = np.sort(crowd.view(np.uint64))
        if length + 1 < DEPTH:
            below = docs.select("text").mapInArrow(_count_below(cuts.open[length], length), kind)
            counts = written(docs.sparkSession, below.groupBy("context").agg(F.sum("n").alias("n")), "contexts")
    return cuts, size


# --- trees ---------------------------------------------------------------------

_TABLE = 4096
_LOG_INT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE)))])  # log k!
_LOG_HALF = np.log(np.pi) / 2 + np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log Gamma of n + 1/2 or n + 1, for whole numbers n."""
    out = (_LOG_HALF if half else _LOG_INT)[np.minimum(n, _TABLE - 1)]
    large = np.flatnonzero(n >= _TABLE)
    if len(large):
        x = n[large] + (0.5 if half else 1.0)
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False) - np.log(np.pi)


def _at_depth(node: np.ndarray, depth: int) -> np.ndarray:
    """A node is its context before the bits so far, which have a 1 in front."""
    return node & np.uint64((1 << (8 * depth + 8)) - 1)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes, with the log of their children's product: the weight of their own
    estimate, its probability of a 1, and the log of the mixture."""
    kt = _HALF + log_kt(zeros, ones)
    mixed = np.logaddexp(kt, _HALF + below)
    return np.exp(np.minimum(0.0, kt - mixed)), (ones + 0.5) / (zeros + ones + 1), mixed


@dataclass
class Level:
    """Nodes of a depth: weight of the own estimate, its probability of a 1; and which of
    them each node of the next depth lies under."""

    own: np.ndarray
    one: np.ndarray
    under: np.ndarray


@dataclass
class Roots:
    """The nodes that trees were cut at, and what is below them."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    mixed: np.ndarray


def _merged(parent: np.ndarray, zeros: np.ndarray, ones: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, Roots]:
    under, known = pd.factorize(parent)
    sums = (np.bincount(under, weights=v, minlength=len(known)) for v in (zeros, ones, mixed))
    zeros, ones, mixed = sums
    return under, Roots(known, zeros.astype(np.int64), ones.astype(np.int64), mixed)


class BitTrees:
    """The trees for one bit of a byte over sorted strings with training counts, some of
    which may be 0, down from the depth of the cut."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int, cut: int):
        byte = keys & np.uint64(0xFF)
        self.bit = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        node = (keys & ~np.uint64(0xFF)) | (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = node[1:] != node[:-1]
        self.leaf = np.cumsum(fresh) - 1
        node = node[fresh]
        zeros, ones = (np.bincount(self.leaf, weights=n * side, minlength=len(node)).astype(np.int64) for side in (~self.bit, self.bit))
        self.leaf_one = (ones + 0.5) / (zeros + ones + 1)
        self.levels: list[Level] = []
        at = Roots(node, zeros, ones, log_kt(zeros, ones))
        for depth in range(DEPTH - 1, cut - 1, -1):
            under, at = _merged(_at_depth(at.node, depth), at.zeros, at.ones, at.mixed)
            own, one, at.mixed = weigh(at.zeros, at.ones, at.mixed)
            self.levels.append(Level(own, one, under))
        self.roots = at

    def log10(self, above: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], cut: int) -> np.ndarray:
        """Of each string's bit, all depths mixed. ``above`` has, by depth, the sorted
        nodes over the cut with ``own`` and ``one``."""
        done, left = np.zeros(len(self.roots.node)), np.ones(len(self.roots.node))
        for depth in range(cut):
            own, one = np.full(len(done), 0.5), np.full(len(done), 0.5)
            known, known_own, known_one = above.get(depth, (np.zeros(0, np.uint64),) * 3)
            if len(known):
                node = _at_depth(self.roots.node, depth)
                at = np.minimum(np.searchsorted(known, node), len(known) - 1)
                seen = known[at] == node
                own[seen], one[seen] = known_own[at[seen]], known_one[at[seen]]
            done, left = done + left * own * one, left * (1 - own)
        for level in reversed(self.levels):
            done, left = done + left * level.own * level.one, left * (1 - level.own)
            done, left = done[level.under], left[level.under]
        p = (done + left * self.leaf_one)[self.leaf]
        return np.log10(np.where(self.bit, p, 1 - p))


# --- questions and answers -----------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _by_group(group: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(group, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else [])


def _in_order(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending"), ("t", "ascending")]).combine_chunks()


Contents = list[tuple[pa.RecordBatch, dict[str, tuple[np.ndarray, np.ndarray]]]]


def _contents(docs: pa.Table) -> Contents:
    """A bucket in slices, with its strings and words and how many each text has."""
    return [
        (part, {"strings": strings(part.column("text")), "words": tokens(part.column("text"))})
        for batch in docs.to_batches() for part in slices(batch, "text", _SLICE)]


def _distinct_in(bucket: Contents) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct strings and words of a bucket, with their training counts."""
    found: dict[str, list] = {"strings": [], "words": []}
    for part, contents in bucket:
        train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for name, (keys, length) in contents.items():
            known, which = distinct(keys)
            found[name].append((known, np.bincount(which, weights=np.repeat(train, length), minlength=len(known))))
    return {name: _summed(*(np.concatenate(c) for c in zip(*parts))) for name, parts in found.items()}


_MESSAGE = "bucket int, grp bigint, cut int, parent bigint, data binary, n binary"


def _messages(cuts: Cuts, word_groups: int):
    """A row per group that a bucket has strings or words of: keys and training counts."""

    def run(docs: pa.Table) -> pa.Table:
        rows = []
        number = docs.column("bucket")[0].as_py()
        for name, (keys, n) in _distinct_in(_contents(_in_order(docs))).items():
            group, cut = cuts.place(keys) if name == "strings" else (_word_group(keys, word_groups), np.zeros(len(keys), np.int64))
            for part in _by_group(group):
                first = part[0]
                parent = int(_context(keys[first : first + 1], int(cut[first]) - 1)[0]) if cut[first] > _FIRST_CUT else 0
                rows.append({
                    "bucket": number, "grp": int(group[first]), "cut": int(cut[first]), "parent": parent,
                    "data": _packed(np.diff(keys[part], prepend=np.uint64(0))), "n": _packed(n[part].astype(np.uint32))})
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_pylist(rows, pa.schema(list(zip(("bucket", "grp", "cut", "parent", "data", "n"), kinds))))

    return run


def _received(messages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of all messages and their counts; which key each entry
    of the messages is, and where messages end."""
    parts = [np.cumsum(_unpacked(d, np.uint64)) for d in messages.column("data").to_pylist()]
    n = np.concatenate([_unpacked(d, np.uint32) for d in messages.column("n").to_pylist()])
    ends = np.cumsum([len(p) for p in parts])
    keys, which = distinct(np.concatenate(parts))
    return keys, np.bincount(which, weights=n, minlength=len(keys)).astype(np.int64), which, ends


_ROOTS = "depth int, node bigint, zeros bigint, ones bigint, below double"


def _roots(messages: pa.Table) -> pa.Table:
    """What the trees of a group add up to in the nodes above their cut; of words (depth
    -1), the distinct ones in training texts and all."""
    keys, n, _, _ = _received(messages)
    cut = messages.column("cut")[0].as_py()
    if not cut:
        found = [Roots(np.zeros(1, np.uint64), np.array([(n > 0).sum()]), np.array([n.sum()]), np.zeros(1))]
    else:
        found = []
        for bit in range(8):
            at = BitTrees(keys, n, bit, cut).roots
            found.append(_merged(_at_depth(at.node, cut - 1), at.zeros, at.ones, at.mixed)[1])
    node, zeros, ones, below = (np.concatenate([getattr(r, c) for r in found]) for c in ("node", "zeros", "ones", "mixed"))
    return pa.table({
        "depth": pa.array(np.full(len(node), cut - 1), pa.int32()), "node": node.view(np.int64),
        "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "below": below})


def _upper(roots: DataFrame, cuts: Cuts) -> dict[int, DataFrame]:
    """By depth, ``node, own, one`` of the nodes above the cuts, each depth from what the
    one below adds up to."""

    @F.arrow_udf("struct<own:double,one:double,mixed:double>")
    def level(zeros: pa.Array, ones: pa.Array, below: pa.Array) -> pa.Array:
        found = weigh(zeros.to_numpy(), ones.to_numpy(), below.to_numpy())
        return pa.StructArray.from_arrays([pa.array(v) for v in found], names=["own", "one", "mixed"])

    out, lifted = {}, None
    for depth in range(max([_FIRST_CUT - 1, *cuts.open]), -1, -1):
        rows = roots.where(F.col("depth") == depth).select("node", "zeros", "ones", "below")
        rows = rows if lifted is None else rows.unionByName(lifted)
        rows = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
        rows = written(roots.sparkSession, rows.withColumn("w", level("zeros", "ones", "below")), "upper")
        out[depth] = rows.select("node", "w.own", "w.one")
        mask = F.lit((1 << (8 * depth)) - 1).cast("bigint")
        lifted = rows.select(F.col("node").bitwiseAND(mask).alias("node"), "zeros", "ones", F.col("w.mixed").alias("below"))
    return out


def _nodes(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node = np.array([r.node for r in rows], np.int64).view(np.uint64)
    order = np.argsort(node)
    return node[order], np.array([r.own for r in rows])[order], np.array([r.one for r in rows])[order]


def _answers(top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """The log probability of every string of a message, or the count of every word."""

    def run(messages: pa.Table, upper: pa.Table) -> pa.Table:
        data = []
        if messages.num_rows:
            keys, n, which, ends = _received(messages)
            cut = messages.column("cut")[0].as_py()
            value = n.astype(np.uint32)
            if cut:
                above = dict(top)
                depth, node = (upper.column(c).to_numpy() for c in ("depth", "node"))
                for d in range(_FIRST_CUT, cut):
                    some = np.flatnonzero(depth == d)
                    some = some[np.argsort(node[some].view(np.uint64))]
                    above[d] = tuple(upper.column(c).to_numpy()[some] for c in ("node", "own", "one"))
                    above[d] = (above[d][0].view(np.uint64), *above[d][1:])
                value = sum(BitTrees(keys, n, bit, cut).log10(above, cut) for bit in range(8)).astype(np.float32)
            data = [_packed(part) for part in np.split(value[which], ends[:-1])]
        return pa.table({"bucket": messages.column("bucket"), "grp": messages.column("grp"), "data": pa.array(data, pa.binary())})

    return run


def _scores(cuts: Cuts, word_groups: int, n_train: int, n_words: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {c: pa.float64() for c in ("base_score", "score")} | {c: pa.int64() for c in ("doc_id", "n_tokens", "n_known")}
        names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
        schema = pa.schema([(c, kinds.get(c, pa.bool_())) for c in names])
        if not docs.num_rows:
            return schema.empty_table()
        bucket = _contents(_in_order(docs))
        given = dict(zip(answers.column("grp").to_pylist(), answers.column("data").to_pylist()))
        lookup = {}
        for name, (keys, _) in _distinct_in(bucket).items():
            group = cuts.place(keys)[0] if name == "strings" else _word_group(keys, word_groups)
            value = np.zeros(len(keys))
            for part in _by_group(group):
                value[part] = _unpacked(given[int(group[part[0]])], np.float32 if name == "strings" else np.uint32)
            lookup[name] = pd.Index(keys), value
        out = []
        for part, contents in bucket:
            found = {}
            for name, (keys, length) in contents.items():
                index, value = lookup[name]
                found[name] = value[index.get_indexer(keys)], np.repeat(np.arange(len(length)), length), length
            m = part.num_rows
            value, owner, _ = found["strings"]
            score = np.bincount(owner, weights=value, minlength=m)
            count, owner, length = found["words"]
            base = np.bincount(owner, weights=np.log10((count + 0.5) / (n_train + 0.5 * (n_words + 1))), minlength=m)
            known = np.bincount(owner, weights=count > 0, minlength=m).astype(np.int64)
            out.append(pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), *map(pa.array, (length.astype(np.int64), known, base, score))],
                schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def held_out(id: str) -> Column:  # noqa: A002
    """Whether the remainder of the id's CRC by 5 is 1."""
    return F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score(
    docs: DataFrame, text: str = "text", id: str = "doc_id",  # noqa: A002
    bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for
    every document, from a model of those that are not held out."""
    spark = docs.sparkSession
    given = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("doc_id"), held_out(id).alias("held_out"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cuts, size = plan_cuts(given, group_bytes)
    n_buckets = max(1, -(-size // bucket_bytes))
    # A word takes some five bytes, and some of a bucket's are repeated.
    word_groups = max(1, size // 5 // (2 * group_words))

    t = F.xxhash64("text")
    bucket = F.pmod(F.xxhash64("doc_id", t), F.lit(n_buckets)).cast("int")
    by_bucket = given.select(bucket.alias("bucket"), "doc_id", "held_out", t.alias("t"), "text").groupBy("bucket")
    messages = written(spark, by_bucket.applyInArrow(_messages(cuts, word_groups), _MESSAGE), "messages")
    roots = written(spark, messages.groupBy("grp").applyInArrow(_roots, _ROOTS), "roots")
    words = roots.where("depth = -1").agg(F.sum("zeros").alias("v"), F.sum("ones").alias("n")).first()
    n_words, n_train = words.v or 0, words.n or 0
    upper = _upper(roots, cuts)
    # At most 65,535 nodes for the two uppermost depths; deeper ones go to where they are asked for.
    top = {depth: _nodes(upper[depth].collect()) for depth in range(_FIRST_CUT)}
    below = messages.where(F.col("cut") > _FIRST_CUT).select("grp", "cut", "parent").distinct()
    below = below.withColumn("depth", F.explode(F.sequence(F.lit(_FIRST_CUT), F.col("cut") - 1)))
    below = below.withColumn("context", F.expr("parent & (shiftleft(1L, 8 * depth) - 1L)")).select("grp", "depth", "context")
    nodes = None
    for depth in sorted(cuts.open):
        rows = upper[depth].select(
            F.lit(depth).alias("depth"), F.expr("shiftrightunsigned(node, 8)").alias("context"), "node", "own", "one")
        nodes = rows if nodes is None else nodes.unionByName(rows)
    if nodes is None:
        nodes = spark.createDataFrame([], "depth int, context bigint, node bigint, own double, one double")
    needed = below.join(nodes, ["depth", "context"]).select("grp", "depth", "node", "own", "one")
    needed = written(spark, needed, "needed-nodes")
    answers = messages.groupBy("grp").cogroup(needed.groupBy("grp")).applyInArrow(
        _answers(top), "bucket int, grp bigint, data binary")
    scored = by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(
        _scores(cuts, word_groups, n_train, n_words),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
