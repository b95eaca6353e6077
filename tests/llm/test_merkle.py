from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import oracle
import pytest
from conftest import SF, lower
from pyspark.sql import functions as F

from planar.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and per node its siblings level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i // 8 * 8
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[g] = tree([leaf(r, r["text"]) for r in groups[g]])
    if not order:
        return []
    root, upper = tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, upper):
        for r, path in zip(groups[g], trees[g][1]):
            path = path + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = lower(r["text"]) if hit and r["text"] is not None else r["text"]
            node = leaf(r, text)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[g][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark, documents):
    out = queries.op12_merkle(spark, SF)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(out) == brute([r.asDict() for r in documents.collect()])


def test_sql(spark):
    ok, message = oracle.same(queries.op12_merkle(spark, SF), oracle.connect(SF), queries.oracle_sql()["op12_merkle"])
    assert ok, message


def test_odd_rows(odd_docs):
    docs = odd_docs.withColumns({
        "lang": F.when(F.length("source") > 0, F.upper("source")), "n_chars": F.length("text").cast("bigint"),
        **{c: F.lit("clash") for c in ("grp", "pos", "digest", "block", "items", "level0", "top", "root", "carry", "segments")}})
    assert rows_of(merkle.verified_rows(docs)) == brute([r.asDict() for r in docs.collect()])
    assert merkle.verified_rows(docs.where("false")).count() == 0


def test_one_row(spark):
    docs = spark.createDataFrame([(7, "s", None, None, "Text")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    row = merkle.verified_rows(docs).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")


@pytest.mark.parametrize("n", [8, 9, 512, 513, 1030])
def test_trees_of_several_blocks(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)] + [(n + i, "s", f"l{i}", None, None) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert rows_of(merkle.verified_rows(docs)) == brute([r.asDict() for r in docs.collect()])


def test_blocks_of_blocks(spark, monkeypatch):
    """Three trees of blocks over each other."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i % 90, "s", "en" if i % 3 else None, 1, f"Text {i % 100}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert rows_of(merkle.verified_rows(docs)) == brute([r.asDict() for r in docs.collect()])


def test_no_python_in_the_plan(spark, documents):
    plan = merkle.verified_rows(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
