from collections import defaultdict
from itertools import combinations

import numpy as np
from conftest import words

from planar.llm import ngram_join


def ngrams(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    """``(id, text)`` to smallest id of the group and number of links, per row."""
    sets = [ngrams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y if not (x and y) else 5 * len(x & y) >= 4 * len(x | y):
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least |= {i: min(ids, default=None) for i in members}
    return sorted(((rows[i][0], least[i], links[i]) for i in range(len(rows))), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_brute(documents, texts):
    assert got(ngram_join.near_groups(documents)) == brute(list(texts.items()))


def test_odd(odd_docs, odd_rows, no_docs):
    groups = ngram_join.near_groups(odd_docs)
    assert got(groups) == brute([r[:2] for r in odd_rows])
    assert ngram_join.near_groups(no_docs).count() == 0


def test_large_component_in_blocks(spark, monkeypatch):
    """A chain of edits, cut into many blocks, gives the same links."""
    rng = np.random.default_rng(3)
    text, rows = [f"w{i}" for i in range(80)], []
    for i in range(60):
        text = list(text)
        text[int(rng.integers(80))] = f"e{i}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.near_groups(docs)) == brute(rows)


def chain(n, seed, words_=80):
    """Texts that differ from the one before in a word."""
    rng = np.random.default_rng(seed)
    text, rows = [f"w{i}" for i in range(words_)], []
    for i in range(n):
        text = list(text)
        text[int(rng.integers(words_))] = f"e{seed}x{i}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_large_component_by_buckets(spark, monkeypatch):
    """Where fewer copies are needed for the buckets of bands, pairs are counted there, once."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 2)
    placed = []
    plain = ngram_join._placed

    def watched(*args):
        placed.append(plain(*args))
        return placed[-1]

    monkeypatch.setattr(ngram_join, "_placed", watched)
    rows = chain(220, 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.near_groups(docs)) == brute(rows)
    bands = {t.band for r in placed[0].select("tiles").collect() for t in r.tiles}
    assert max(bands) >= 0


def test_copies_of_sets_of_a_large_family(spark, monkeypatch):
    """Near copies that are all linked: a set goes to as many tiles as there are blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 256)
    sizes = []
    plain = ngram_join._placed

    def watched(*args):
        out = plain(*args)
        sizes.append(out.agg({"node": "count"}).first()[0])
        sizes.append(sum(len(r.tiles) for r in out.select("tiles").collect()))
        return out

    monkeypatch.setattr(ngram_join, "_placed", watched)
    text = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*text[: i % 199], f"e{i}", *text[i % 199 + 1 :]])) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = ngram_join.near_groups(docs).collect()
    assert {r.n_links for r in out} == {1_999} and {r.class_id for r in out} == {0}
    assert sizes == [2_000, 8 * 2_000]


def test_recall_of_planted_near_copies(spark):
    """Pairs at 0.8 and a little above, each of words of its own."""
    rows = []
    for n in range(600):
        own = [f"p{n}w{i}" for i in range(120)]
        near = list(own)
        for j in range(2):  # changes 5 of 116 5-grams each: 106 / 126 = 0.84
            near[30 + 40 * j] = f"p{n}c{j}"
        if n % 2:  # 103 / 126 = 0.817
            near = near[:-3]
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_pairs(rows)
    assert len(want) == 600
    found = {r.doc_id: r.class_id for r in ngram_join.near_groups(docs).collect()}
    assert sum(found[a] == found[b] for a, b in want) >= 0.995 * len(want)


def brute_pairs(rows):
    """Neighbours in the list at 0.8 or more."""
    out = []
    for (a, x), (b, y) in zip(rows[::2], rows[1::2]):
        x, y = ngrams(x), ngrams(y)
        if 5 * len(x & y) >= 4 * len(x | y):
            out.append((a, b))
    return out


def test_one_row_of_a_group_whatever_its_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    blanks = text.replace(" ", "\n")
    for rows, kept in (
        ([(0, text), (None, text), (None, blanks)], [0]), ([(None, text), (None, text), (None, blanks)], [None]),
        ([(7, text), (7, blanks)], [7]), ([(7, text), (7, text), (8, blanks)], [7]),
    ):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert [r.doc_id for r in ngram_join.one_of_each(docs).collect()] == kept


def test_one_of_each(odd_docs, odd_rows):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {(c, ) for _, c, _ in brute([r[:2] for r in odd_rows])}
    assert kept.count() == len(groups)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(-5) == 1 and 9 not in ids and 10 in ids


def test_banding():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MOST_HASHES


def test_more_blocks_than_members(spark, monkeypatch):
    """Long texts make many blocks of few members; each pair is counted once."""
    text = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*text[:200], f"e{i}", *text[201:]])) for i in range(3)]
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 100)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.near_groups(docs)) == brute(rows)


def test_class_with_and_without_an_id(spark):
    """Equal words in different white space, one row without an id: still near others."""
    text = [f"w{i}" for i in range(60)]
    near = [*text[:59], "changed"]
    for gap in ("  ", "\n", "\t", " \n "):
        rows = [(None, gap.join(text)), (4, " ".join(text)), (7, " ".join(near))]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert got(ngram_join.near_groups(docs)) == brute(rows)
