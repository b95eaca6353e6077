import math
import zlib
from collections import Counter, defaultdict
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, lower, words

from planar.llm import lm_score, queries


def train_ids(rows):
    return [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]


def brute_base(rows):
    counts = Counter()
    for t in train_ids(rows):
        counts.update([*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    for _, t in rows:
        tokens = [*words(lower(t)), None]
        yield len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)


class Tree:
    """Context-tree weighting, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.nodes = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for key, bit in self.path(t):
                for d in range(depth + 1):
                    self.nodes[key[0][depth - d :], key[1]][bit] += 1
        below, self.weighted = defaultdict(float), {}
        for key in sorted(self.nodes, key=lambda k: -len(k[0])):
            kt = self.kt(*self.nodes[key])
            self.weighted[key] = kt if len(key[0]) == depth else np.logaddexp(log(0.5) + kt, log(0.5) + below[key])
            if key[0]:
                below[key[0][1:], key[1]] += self.weighted[key]

    @staticmethod
    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(math.pi)

    def path(self, text):
        data = bytes(self.depth) + lower(text).encode() + b"\0"
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield (data[i - self.depth : i], 1 << k | data[i] >> 8 - k), data[i] >> 7 - k & 1

    def score(self, text):
        total = 0.0
        for (context, so_far), bit in self.path(text):
            p = 0.5
            for d in range(self.depth, -1, -1):
                key = context[d and -d or len(context) :], so_far
                if key in self.nodes:
                    a, b = self.nodes[key]
                    own = 1.0 if d == self.depth else exp(log(0.5) + self.kt(a, b) - self.weighted[key])
                    p = own * ((b if bit else a) + 0.5) / (a + b + 1) + (1 - own) * p
            total += math.log10(p)
        return total


def kt_of(zeros, ones):
    pairs, which = np.unique(np.stack([zeros, ones]), axis=1, return_inverse=True)
    return np.array([Tree.kt(int(a), int(b)) for a, b in pairs.T])[which.ravel()]


def whole_scores(rows, depth):
    """The same as ``Tree`` over whole texts, all positions of all texts in one array."""
    lines = [lower(t).encode() + b"\0" for _, t in rows]
    train = {("" if i is None else str(i)): zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows}
    padded = [np.frombuffer(bytes(depth) + line, np.uint8).astype(np.uint64) for line in lines]
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    taught = np.array([train["" if i is None else str(i)] for i, _ in rows])[owner]
    byte = np.concatenate([x[depth:] for x in padded])
    back = [np.concatenate([x[depth - d : len(x) - d] for x in padded]) for d in range(1, depth + 1)]
    total = np.zeros(len(byte))
    for k in range(8):
        so_far, bit = (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k)), (byte >> np.uint64(7 - k)) & np.uint64(1)
        node, which, counts = so_far, [], []
        for d in range(depth + 1):
            node = node if d == 0 else (node << np.uint64(8)) | back[d - 1]  # so far, then backwards
            _, w = np.unique(node, return_inverse=True)
            which.append(w)
            counts.append([np.bincount(w, weights=taught & (bit == side)).astype(np.int64) for side in (0, 1)])
        below, own = None, [None] * (depth + 1)
        for d in range(depth, -1, -1):
            kt = kt_of(*counts[d])
            mixed = kt if d == depth else np.logaddexp(log(0.5) + kt, log(0.5) + below)
            own[d] = np.ones(len(kt)) if d == depth else np.exp(log(0.5) + kt - mixed)
            if d:
                parent = np.zeros(len(kt), np.int64)
                parent[which[d]] = which[d - 1]
                below = np.bincount(parent, weights=mixed)
        p = np.full(len(byte), 0.5)
        for d in range(depth, -1, -1):
            zeros, ones = (c[which[d]] for c in counts[d])
            here = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
            w = own[d][which[d]]
            p = w * here + (1 - w) * p
        total += np.log10(p)
    return np.bincount(owner, weights=total)


def check(got, rows, scores):
    for (i, t), (n, known, total, base), score in zip(rows, brute_base(rows), scores):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1)
        # Log probabilities travel as 32-bit floats.
        assert r.score == pytest.approx(score, rel=1e-6)


def test_brute_node_by_node(spark, texts):
    rows = [(i, t[:700]) for i, t in list(texts.items())[:12]] + [(900, None), (901, ""), (902, "É ü"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tree = Tree(train_ids(rows), lm_score.DEPTH)
    scores = [tree.score(t or "") for _, t in rows]
    assert whole_scores(rows, lm_score.DEPTH) == pytest.approx(scores, rel=1e-9)
    check({r.doc_id: r for r in lm_score.score(docs, bucket_bytes=2_000, group_words=100).collect()}, rows, scores)


@pytest.fixture(scope="module")
def whole(texts):
    rows = list(texts.items())
    return rows, whole_scores(rows, lm_score.DEPTH)


def test_query_on_whole_texts(spark, whole):
    check({r.doc_id: r for r in queries.op6_lm_score(spark, SF).collect()}, *whole)


def test_deeper_cuts(documents, whole):
    """Groups so small that many contexts are cut at three, four and more bytes."""
    cuts, _ = lm_score.plan_cuts(documents, 1_500)
    assert set(cuts.open) >= {2, 3, 4} and all(len(v) for v in cuts.open.values())
    got = lm_score.score(documents, bucket_bytes=100_000, group_bytes=1_500, group_words=3_000)
    check({r.doc_id: r for r in got.collect()}, *whole)


def test_a_text_that_comes_again_scores_higher(spark, whole):
    """One of the training texts once more, under another id that is in training, too."""
    rows, before = whole
    often = Counter(t for _, t in rows)
    at, (_, text) = next((n, r) for n, r in enumerate(rows) if train_ids([r]) and often[r[1]] == 1 and len(r[1]) > 2_000)
    again = next(i for i in range(10**6, 10**6 + 9) if train_ids([(i, "")]))
    docs = spark.createDataFrame([*rows, (again, text)], "doc_id bigint, text string")
    after = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    assert after[again] == pytest.approx(after[rows[at][0]])
    assert after[again] > 0.95 * before[at]


def test_odd(odd_docs, no_docs):
    rows = lm_score.score(odd_docs).collect()
    assert len(rows) == 20 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_score.score(no_docs).count() == 0


def test_probabilities_add_up():
    """Over all bytes after any context, seen or not."""
    strings, _ = lm_score.strings(pa.array(["some text", "some more text"]))
    for context in (strings[3] >> np.uint64(8), np.uint64(0x41424344)):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        keys, which = np.unique(np.concatenate([strings, every]), return_inverse=True)
        n = np.bincount(which[: len(strings)], minlength=len(keys))
        p = 10 ** sum(lm_score.BitTrees(keys, n, bit, 0).log10({}, 0) for bit in range(8))
        assert np.sum(p[which[len(strings) :]]) == pytest.approx(1)


def test_large_counts():
    a, b = np.array([0, 5, 4095, 4096, 10**6]), np.array([0, 3, 4096, 1, 10**7])
    want = [Tree.kt(int(x), int(y)) for x, y in zip(a, b)]
    assert lm_score.log_kt(a, b) == pytest.approx(want, rel=1e-9, abs=1e-9)
