import pytest
from conftest import words
from pyspark.sql import functions as F

from planar.llm import substring_dedup


def brute(rows, window=13):
    first = {}
    for id_, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if id_ is not None:
                first[key] = min(first.get(key, id_), id_)
    out = []
    for id_, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if id_ is not None and first[tuple(w[i : i + window])] < id_:
                gone[i : i + window] = [True] * window
        out.append((id_, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket_bytes, leaves", [(6 << 20, 2_000_000), (20_000, 2_000)])
def test_brute(documents, texts, bucket_bytes, leaves):
    out = substring_dedup.dedup(documents, bucket_bytes=bucket_bytes, group_leaves=leaves)
    assert got(out) == brute(list(texts.items()))
    spans = {r.doc_id: sum(s.end - s.start for s in r.removed) for r in out.collect()}
    assert spans == {r.doc_id: r.n_removed for r in out.collect()}


def test_odd(odd_docs, odd_rows, no_docs):
    assert got(substring_dedup.dedup(odd_docs, bucket_bytes=5_000, group_leaves=500)) == brute([r[:2] for r in odd_rows])
    assert substring_dedup.dedup(no_docs).count() == 0


def test_groups_stay_small(documents):
    plan, size = substring_dedup.plan_groups(documents.select("text"), 13, 1_000)
    assert plan.open and size > 0
    counts = substring_dedup._count(documents.select("text"), substring_dedup.Plan(1, []), 13)
    assert plan.groups == -(-2 * counts.agg(F.sum("n")).first()[0] // 1_000)


def test_equal_and_missing_ids_spread(spark):
    """Over buckets, with the same results."""
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda i: " ".join(vocabulary[(i * 7 + j * (i % 3 + 1)) % 500] for j in range(60))
    rows = [(None, text(i)) for i in range(60)] + [(5, text(i)) for i in range(60)] + [(9, text(i)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    buckets = docs.select("doc_id", F.xxhash64("text").alias("t")).select("doc_id", substring_dedup.bucket_of(8).alias("b"))
    assert [r.n for r in buckets.where("doc_id is null or doc_id = 5").groupBy("doc_id").agg(
        F.count_distinct("b").alias("n")).collect()] == [8, 8]
    assert got(substring_dedup.dedup(docs, bucket_bytes=3_000, group_leaves=500)) == brute(rows)
