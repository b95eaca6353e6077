from collections import Counter

from conftest import words

from planar.llm import quality


def brute(text):
    w, text = words(text), text or ""
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if words(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(documents, odd_docs):
    for docs in (documents, odd_docs):
        for r in quality.score(docs).select("doc.text", "counts.*", "base_failed", "kept").collect():
            want = brute(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.base_failed and r.kept)


def test_labels_agree(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.score(documents).select("doc.doc_id", "base_failed", "kept").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_keep_good(odd_docs, no_docs, documents):
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns
    flags = quality.score(documents).where("kept").select("doc.*")
    assert sorted(kept.collect()) == sorted(flags.collect())
    assert quality.keep_good(odd_docs).columns == odd_docs.columns
    assert quality.keep_good(no_docs).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
