import hashlib
import random
import re
import string

from conftest import SF
from pyspark.sql import functions as F

from planar.llm import queries, secret_scan

PATTERNS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def brute(text):
    found = [(k, *m.span()) for k, (p, g, n) in PATTERNS.items() for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


_RNG = random.Random(4)
RANDOM = "".join(_RNG.choice(string.ascii_letters + string.digits) for _ in range(40))
TRICKY = [
    "", 'PassWord"  :  \'abc123', "token=abc", "api_key=AKIA" + "A1" * 10, "apiſkey=abcdefgh tokeN= secretvalue",
    "0123456789abcdef" * 3, "é " + "f" * 24 + "G", "secret=password=abcdefg", "token" * 50,
]


def test_base_spans(texts):
    for text in [*texts.values(), *TRICKY]:
        assert sorted(secret_scan.base_spans(text)) == sorted(brute(text))


def test_random_strings(spark, odd_docs, no_docs):
    rows = [
        (1, f"key {RANDOM} end"), (2, "commit DA39A3EE5E6B4B0D3255BFEF95601890AFD80709 and 123e4567-e89b-12d3-a456-426614174000"),
        (3, "a_long_identifier_with_parts2 /usr/local/share/applications/menu"), (4, None), (5, "plain words " * 50), (6, RANDOM[:19]),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = docs.select("doc_id", secret_scan.secret_spans("text").alias("s"), secret_scan.mask_secrets("text").alias("m")).collect()
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.s] for r in out}
    assert found == {1: [("random", 4, 44)], 2: [], 3: [], 4: [], 5: [], 6: []}
    masked = {r.doc_id: r.m for r in out}
    assert masked[1] == "key [secret] end" and masked[4] is None and masked[5] == rows[4][1]
    assert odd_docs.withColumn("text", secret_scan.mask_secrets("text")).count() == 20
    assert no_docs.select(secret_scan.secret_spans("text")).count() == 0


def test_masked_merges_spans():
    assert secret_scan.masked("ab cdef gh", [("a", 1, 5), ("b", 3, 7), ("c", 9, 10)]) == "a[secret] g[secret]"


def test_query(spark, texts):
    rows = queries.queries()["op8_secret_scan"](spark, SF)
    rows = rows.where(F.col("doc_id").isNotNull()).collect()
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x[0] for x in base) for k in PATTERNS]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_keys_of_letters():
    """Random letters are found, as one run or joined; names and dates are not."""
    rng = random.Random(6)
    encoding = secret_scan._encoding(secret_scan.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    find = lambda text: secret_scan.find(text, encoding, secret_scan.MOST_CHARS_PER_TOKEN)
    for alphabet in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits):
        for n in (20, 24, 40):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(400)]
            joined = ["-_/+="[i % 5].join(k[j : j + n // 4] for j in range(0, n, n // 4)) for i, k in enumerate(keys)]
            for some in (keys, joined):
                assert sum(find(f"key {k} end") == [("random", 4, 4 + len(k))] for k in some) >= 0.98 * len(some), (alphabet, n)
    names = ["a_long_identifier_with_parts2", "/usr/local/share/applications/menu", "getUserAccountDetailsByIdentifier",
             "src/btree/rbtree_impl", "2021-03-04-12-30-45-000", "kubernetes-ingress-nginx-ctrl-mgr", "shipment_reference_20240101"]
    assert [x for x in names if find(x)] == []


def test_texts_with_very_many_spans():
    """Digests without end take time in proportion."""
    import time

    encoding = secret_scan._encoding(secret_scan.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng, seconds = random.Random(1), []
    for n in (2_000, 16_000):
        text = "\n".join(f"{rng.getrandbits(128):032x}  file{i}" for i in range(n))
        start = time.process_time()
        assert len(secret_scan.find(text, encoding, secret_scan.MOST_CHARS_PER_TOKEN)) == n
        seconds.append(time.process_time() - start)
    assert seconds[1] < 24 * seconds[0]
