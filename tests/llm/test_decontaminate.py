import random
from itertools import accumulate

import numpy as np
from conftest import lower, words

from planar.llm import decontaminate


def brute(docs, items):
    out = {}
    items = [(k, words(lower(item))) for k, item in items]
    for i, text in docs:
        w = words(lower(text))
        for k, v in items:
            if v and not set(v) & set(w):
                continue
            own, k5 = decontaminate.shingle_counts(v), min(5, len(v))
            shared = [tuple(w[s : s + k5]) in own for s in range(len(w) - k5 + 1)] if v else []
            n = len(v) - k5 + 1
            upto = [0, *accumulate(shared)]
            # Others cannot be similar enough.
            starts = [s for s in range(len(w) - len(v) + 1) if v and upto[s + n] - upto[s] >= 0.8 * n]
            best = max((decontaminate.weighted_similarity(w[s : s + len(v)], v) for s in starts), default=0)
            if best >= 0.8:
                out[i, k] = max(best, out.get((i, k), 0))
    return out


def got(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_planted(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 12, 30, 30, 60))]
    items += [(7, None), (8, ""), (9, items[2][1]), (10, "Again and " * 8)]
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(100 + i, f"{filler(50)} {text} {filler(20)}") for i, text in items[:5]]
    near = items[4][1].split()
    near[30] = "changed"
    docs += [(110, filler(30) + " " + " ".join(near).upper()), (111, filler(400)), (112, items[2][1]), (113, " ".join(near[:40]))]
    benchmark = spark.createDataFrame([(*r, "c") for r in items], "item_id bigint, text string, print string")
    table = spark.createDataFrame([(*r, "c") for r in docs], "doc_id bigint, text string, length string")
    found = decontaminate.hits(table, benchmark)
    assert same(got(found), brute(docs, items)) and (110, 4) in got(found) and (111, 2) not in got(found)
    assert {r.doc_id for r in decontaminate.without_leaks(table, benchmark).collect()} == {111, 113}
    plain = [r[:2] for r in odd_rows]
    assert same(got(decontaminate.hits(odd_docs, benchmark)), brute(plain, items))
    assert decontaminate.hits(no_docs, benchmark).count() == 0
    assert decontaminate.hits(table, benchmark.where("false")).count() == 0
    assert decontaminate.without_leaks(odd_docs, benchmark.where("false")).count() == len(odd_rows)


def test_brute(spark, documents, texts):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert same(got(decontaminate.hits(documents, benchmark)), brute(texts.items(), items))


def test_blocks_find_every_print_within_the_radius(spark):
    rng = random.Random(1)
    items, prints = [rng.getrandbits(64) for _ in range(20)], []
    for item in items:
        for distance in (0, 7, 14, 15):
            flips = sum(1 << b for b in rng.sample(range(64), distance))
            prints.append(item ^ flips)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = decontaminate._blocks(spark.createDataFrame([(signed(p),) for p in prints], "print bigint"))
    masks = spark.range(1).select(decontaminate._flips().alias("m")).first().m
    right = decontaminate._blocks(spark.createDataFrame([(signed(p),) for p in items], "print bigint")).collect()
    near = {(r.block, r.value ^ m) for r in right for m in masks}
    met = {r.print for r in left.collect() if (r.block, r.value) in near}
    assert met == {signed(p) for p in prints}


def test_recall_at_the_threshold(spark):
    """Of pairs at 0.8 all but a few in 10,000 are within the radius, and the blocks
    find all that are."""
    rng = np.random.default_rng(1)
    for n, changed in ((9, 1), (36, 4), (45, 5)):
        a = rng.integers(0, 1 << 64, (20_000, n), np.uint64)
        b = a.copy()
        b[:, :changed] = rng.integers(0, 1 << 64, (20_000, changed), np.uint64)
        apart = decontaminate.fingerprints(a) ^ decontaminate.fingerprints(b)
        assert (np.bitwise_count(apart) > decontaminate.RADIUS).mean() < 5e-4
    assert sum(decontaminate.NEAR) + decontaminate.BLOCKS > decontaminate.RADIUS
    masks = [set(spark.range(1).select(decontaminate._flips(m).alias("m")).first().m) for m in decontaminate.NEAR]
    assert [len(m) for m in masks] == [6885, 2517, 2517, 2517]
    for _ in range(200):
        far = sum(1 << int(i) for i in rng.choice(64, decontaminate.RADIUS, replace=False))
        assert any(far >> 16 * i & 0xFFFF in m for i, m in enumerate(masks))


def test_middle_word_replaced(spark):
    """Items of 49 to 59 words with one word replaced are all found."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(10**6)}"
    items = [(i, [word() for _ in range(49 + i % 11)]) for i in range(400)]
    docs = [(i, " ".join([*w[:24], "changed", *w[25:]])) for i, w in items]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert got(decontaminate.hits(table, benchmark)).keys() == {(i, i) for i, _ in items}


def test_rows_and_items_without_an_id(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"v{rng.randrange(10**4)}" for _ in range(n))
    known, other = prose(30), prose(20)
    docs = [(None, "a " + known), (None, prose(60)), (None, None), (5, known + " b"), (5, prose(40)), (6, other), (7, prose(50))]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(None, known), (1, other)], "item_id bigint, text string")
    assert set(got(decontaminate.hits(table, benchmark))) == {(None, None), (5, None), (6, 1)}
    kept = decontaminate.without_leaks(table, benchmark)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([docs[1], docs[2], docs[4], docs[6]], key=str)
