from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from planar.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.load(A, B)


def merged(pair, text):
    """Ids of both sides and their groups, by walking both lists; None without tokens."""
    if not text:
        return None
    whole = " " + text
    a, b = pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != whole.encode() or b"".join(pair.bytes_b[i] for i in b) != whole.encode():
        return None
    groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and at_a <= at_b:
            groups[-1][0].append(a[i])
            at_a, i = at_a + len(pair.bytes_a[a[i]]), i + 1
        else:
            groups[-1][1].append(b[j])
            at_b, j = at_b + len(pair.bytes_b[b[j]]), j + 1
        if at_a == at_b:
            groups.append(([], []))
    return a, b, groups[:-1]


def brute(pair, rows):
    """Per row ``(doc_id, n_a, ..., groups_sha256)`` for rows of ``doc_id, text``."""
    found = [(i, merged(pair, text)) for i, text in rows]
    held = [Counter((x, y) for g, h in m[2] for x in g for y in h) if m else Counter() for _, m in found]
    count = Counter(k for links in held for k in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, m), links in zip(found, held):
        if m is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in m[2])
        out.append((
            i, len(m[0]), len(m[1]), len(m[2]), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]),
            sum(n * count[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark, documents, pair):
    out = queries.op11_alignment(spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(out) == brute(pair, [(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd_docs, odd_rows, pair):
    more = odd_docs.sparkSession.createDataFrame(
        [(30, "a <|endoftext|> b <s> </s>"), (31, "   lead and  double   spaces "), (32, "tab\t and\n lines \r\n x"),
         (33, "é   no-break   line 　wide"), (34, "\U0001f600 \U0001f468‍\U0001f469 ▁mark")],
        "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    expected = [(r[0], r[1]) for r in odd_rows] + [tuple(r) for r in more.collect()]
    assert rows_of(alignment.align(docs)) == brute(pair, expected)
    assert rows_of(alignment.align(odd_docs)) == brute(pair, [(r[0], r[1]) for r in odd_rows])


def test_empty(no_docs):
    assert alignment.align(no_docs).count() == 0


def test_counts_beyond_a_broadcast(odd_docs, odd_rows, pair, monkeypatch):
    """The shuffled join of pairs, with every pair of more than one chunk a hot one."""
    from planar.plans import lookup

    monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(lookup.attach, "__defaults__", ("left", 1))
    assert rows_of(alignment.align(odd_docs)) == brute(pair, [(r[0], r[1]) for r in odd_rows])


def test_groups_and_links(monkeypatch):
    cut_a, cut_b = alignment.slice_ends([2, 4, 7, 8], [2, 7, 8])
    assert cut_a.tolist() == [1, 3, 4] and cut_b.tolist() == [1, 2, 3]
    a, b = np.array([5, 5, 6, 9]), np.array([7, 8, 1])
    slices = (np.array([0, 3]), np.array([0, 2]), np.array([3, 1]), np.array([2, 1]))
    want = {(0, 507): 2, (0, 508): 2, (0, 607): 1, (0, 608): 1, (1, 901): 1}
    for most in (10_000, 0):
        monkeypatch.setattr(alignment, "_MOST_LINKS", most)
        found = Counter()
        for g, p, n in zip(*(v.tolist() for v in alignment.expand_links(a, b, *slices, 100))):
            found[g, p] += n
        assert found == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'a1.▁ ́<>|")), min_size=1, max_size=60))
def test_cut_texts_are_like_whole_ones(text):
    pair = alignment.load(A, B)
    figures, owner, pairs, times = alignment._align_texts(pair, [text])
    m = merged(pair, text)
    if m is None:
        assert figures[0] == (0, 0, 0, 0, "") and not len(pairs)
        return
    form = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in m[2])
    assert figures[0][:3] == (len(m[0]), len(m[1]), len(m[2]))
    assert figures[0][4] == hashlib.sha256(form.encode()).hexdigest()
    links = Counter(x * pair.size_b + y for g, h in m[2] for x in g for y in h)
    assert dict(zip(pairs.tolist(), times.tolist())) == links and set(owner) <= {0}
