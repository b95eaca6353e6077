import re

import numpy as np
import pytest
from conftest import SF

from planar.llm import pii, queries

# The patterns as the contract states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) for d in digits[::-1]]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


TRICKY = [
    "", "a@b.c_d@e.f x@y a@b.c.d@e.f @z.z", "1.2.3.4.5 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111-1 4111111111111111",
    "+1 (743) 555-3220 190.1.2.3 +12 +1234567890123456", "é+49 30 123456 ü a+b@c.de.", "1" * 5000, "a" * 3000 + "@b.co", "x@-.-",
]


def test_base_spans(texts):
    for text in [*texts.values(), *TRICKY]:
        assert pii.ordered(pii.candidates(text)[0]) == brute(text)


@pytest.fixture(scope="module")
def crf(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), lines=400)


def test_model_adds_forms_that_fail_a_check(spark, crf, odd_docs, no_docs):
    rows = [(1, "the number 4040549990366438 is on it.\nplain words here"), (2, None), (3, "only é plain words, v2.0 and 40 of them")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.s for r in docs.select("doc_id", pii.personal_spans("text", crf).alias("s")).collect()}
    assert [(s.kind, s.start, s.end) for s in out[1].spans] == [("card", 11, 27)] and not out[1].base
    assert not out[2].spans and not out[3].spans
    assert odd_docs.select("doc_id", pii.personal_spans("text", crf).alias("x")).count() == 20
    assert no_docs.select(pii.personal_spans("text", crf).alias("x")).count() == 0


def test_held_out_accuracy(spark, crf, texts):
    """On documents it was not trained on, it labels what the patterns know."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    import pyarrow as pa

    from planar.llm.words import split_words

    hit = known = 0
    for text in texts.values():
        base = pii.candidates(text)[0]
        found = pii._added([text], pa.array([text]), crf)[0]
        known += len(base)
        hit += sum(any(k == kind and s < e2 and s2 < e for k, s2, e2 in found) for kind, s, e in base)
        assert len(split_words(pa.array([text])).start) >= 0
    assert docs.count() == len(texts) and hit >= 0.9 * known


def test_viterbi_is_exact():
    """Against the best of all label sequences."""
    rng = np.random.default_rng(1)
    crf = pii.fit([(["aaa", "999", "aaa"], [0, 5, 0]), (["a@a.a", "aa"], [1, 0])], rounds=5)
    crf.steps[:] = rng.normal(size=crf.steps.shape)
    which, line = np.array([0, 1, 2, 0, 1]), np.array([0, 0, 0, 1, 1])
    shapes = ["aaa", "999", "a@a.a"]
    scores = crf.emissions(shapes, which, line)
    got = crf.decode(shapes, which, line)
    for lo, hi in ((0, 3), (3, 5)):
        best = max(np.ndindex(*[pii.N_LABELS] * (hi - lo)), key=lambda y: sum(scores[lo + i, v] for i, v in enumerate(y))
                   + sum(crf.steps[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got[lo:hi]) == best


def test_query(spark, texts):
    rows = queries.queries()["op5_personal_data"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans)
