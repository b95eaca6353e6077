import sys

import pytest
from conftest import SF, words
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_mixing import brute_targets
from test_ngram_join import brute as groups

import __spark_entry__ as entry
import corpus_pipeline
from planar.llm import secret_scan
from planar.llm.scratch import written


def test_stages(spark, documents):
    """Each stage against what it should do to its own input."""
    docs, columns = documents, documents.columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = {}
    for name, stage in stages.items():
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(spark, stage(spark, docs, SF), "test-stage")
        kept[name] = before, docs.collect()
        if name != "training mix":
            assert docs.columns == columns
    before, after = kept["quality rules"]
    assert 0 < len(after) < len(before) and all(len(words(r.text)) >= 20 for r in after)
    before, after = kept["n-gram jaccard join"]
    assert {r.doc_id for r in after} == {least for _, least, _ in groups([(i, r.text) for i, r in before.items()])}
    before, after = kept["benchmark decontamination"]
    gone = {i for i, _ in leaks([(i, r.text) for i, r in before.items()], benchmark)}
    assert {r.doc_id for r in after} == before.keys() - gone
    before, after = kept["secret scan"]
    assert {r.doc_id for r in after} == before.keys()
    for r in after:
        text = before[r.doc_id].text
        assert r.text == text if not secret_scan.base_spans(text) else not secret_scan.base_spans(r.text)
        assert r.n_chars == len(r.text)
    before, after = kept["training mix"]
    sizes = {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for source, target in brute_targets(sizes).items():
        mine = [len(words(r.text)) for r in after if r.source == source]
        assert abs(sum(mine) - target) <= max(len(words(r.text)) for r in before.values() if r.source == source)


def test_stages_on_odd_rows(spark, odd_docs):
    """Ids that are 0, NULL or repeated, clashing names, and no rows at all."""
    good = " ".join(f"the word{i} of a text" for i in range(12))
    rows = [(0, good, "a"), (None, good, "a"), (None, good.replace(" ", "  "), "b"), (0, good, "a"), (7, good + " tail", None)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumn("n_chars", F.length("text").cast("bigint"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        columns, docs = docs.columns, written(spark, stage(spark, docs, SF), "odd-stage")
        left[name] = docs.collect()
        if name != "training mix":
            assert docs.columns == columns
    # The group of the five: the row with id 0, once.
    assert sum((r.text or "").split() == good.split() for r in left["quality rules"]) == 4
    family = [r for r in left["n-gram jaccard join"] if (r.text or "").split()[:40] == good.split()[:40]]
    assert [(r.doc_id, r.text) for r in family] == [(0, good)]
    kept = {(r.doc_id, r.text) for r in left["secret scan"]}
    assert {(r.doc_id, r.text) for r in left["training mix"]} <= kept


def test_registered():
    names = entry.queries().keys()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("missing", ["corpus_pipeline", "planar.llm", "zstandard", "public_tokenizers"])
def test_entry_without_this_package(missing):
    """In a fresh interpreter in which it cannot be found."""
    import subprocess

    code = f"""
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + '.'):
            raise ModuleNotFoundError(f'No module named {{name!r}}', name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
assert e.queries().keys() == e.core_queries().keys() and 'pipeline' not in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


def test_queries_in_new_workers(tmp_path):
    """Every task in a worker of its own, which has imported nothing for an earlier one."""
    import subprocess

    code = f"""
import sys
sys.path.insert(0, {str(entry.__file__.rsplit("/", 1)[0])!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[8]').config('spark.python.worker.reuse', 'false').config('spark.ui.enabled', 'false')
         .config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate())
spark.sparkContext.setLogLevel('ERROR')
import __spark_entry__ as entry
for name, query in entry.corpus_queries().items():
    assert query(spark, {SF!r}).count() >= 0, name
"""
    subprocess.run([sys.executable, "-c", code], check=True)
