import hashlib
from collections import Counter

import oracle
from conftest import SF
from pyspark.sql import functions as F

from planar.llm import queries, warc
from planar.plans.scratch import scratch_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "x" * 150), (2, "x" * 150), (3, "hello WARC/1.0\r\n world"), (4, FAKE * 3), (5, None), (6, ""), (7, "é" * 60),
    (8, "é" * 60), (None, "x" * 150), (9, "WARC/1.0\r\n"), (10, "a" + FAKE), (11, FAKE + "tail" * 900),
    (12, FAKE + "tail" * 900), (1, "x" * 150), (13, "y" * 99), (14, "y" * 99),
] + [(100 + i, f"page {i} " * (i % 40)) for i in range(120)]


def brute():
    first = {}
    for i, html in ROWS:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = Counter()
    for i, html in ROWS:
        data = (html or "").encode()
        to = first.get(data)
        revisit = i is not None and to is not None and i > to
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


def test_round_trip_with_magic_in_payloads(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, html string").withColumn("digest", F.lit(1)).coalesce(2)
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "6000")  # many blocks per file
    try:
        got = warc.round_trip(spark, pages).collect()
    finally:
        spark.conf.set(limit, before)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute()


def test_salted_join_and_empty(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, "page_id bigint, html string")
    monkeypatch.setattr("planar.llm.joins.fits_broadcast", lambda df: False)
    got = warc.round_trip(spark, pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute()
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_broken_chain_ends(spark):
    """What stands behind a cut off record is not on the chain."""
    path = scratch_path(spark, "broken")
    good = FAKE.replace("abc", "xyz").rstrip("\n")  # the writer adds the last byte
    broken = good.replace("Content-Length: 3", "Content-Length: 7")
    spark.createDataFrame([(good,), (broken,), (good,)], "value string").coalesce(1).write.text(path)
    rows = warc.read(spark, path).collect()
    assert sum(r.payload_digest is not None for r in rows) == 1


def test_sql(spark):
    name = "op4_warc"
    want = oracle.connect(SF).execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
