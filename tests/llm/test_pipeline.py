import os

import duckdb
import pytest

import corpus_pipeline
from rillcep.llm import catalogue
from tests.llm.common import awkward, empty, frame, prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_awkward_stage(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, awkward())
    out = stage(spark, docs, SF)
    if name == "near_dedup":
        kept = [r.doc_id for r in out.collect()]
        assert kept.count(1) == 1 and 2 not in kept and kept.count(None) == 2 and out.columns == docs.columns and {4, 5, 6, 7, 10, 11} <= set(kept)
    elif name != "packing":
        assert out.columns == docs.columns and out.count() == len(awkward())
    assert stage(spark, empty(spark), SF).count() == 0


def test_near_dedup_of_clashing_ids(spark):
    """One doc_id with two texts, repeated rows, and rows without a doc_id."""
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    out = corpus_pipeline.near_dedup(spark, frame(spark, [(1, a), (1, b), (1, a), (2, c), (3, c + " more"), (None, c), (None, c), (None, a)]), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (1, b), (2, c), (None, c), (None, a)], key=str)


def test_decontamination_by_row(spark):
    """A contaminated row without a doc_id goes, and of two rows of one doc_id only the contaminated one."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    bad, clean = prose(30, 1) + " " + item, prose(60, 2)
    out = corpus_pipeline.decontamination(spark, frame(spark, [(None, bad), (None, clean), (5, bad), (5, clean), (6, None)]), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, clean), (5, clean), (6, None)], key=str)


def test_passages_of_short_words(spark):
    """Sixty short words are far under 400 bytes, and a passage all the same."""
    passage = " ".join("ab cd e fg"[i % 8 :][:2].strip() or "x" for i in range(60)) + " " + prose(3, 9)
    rows = [(1, f"{prose(20, 1)} {passage} {prose(20, 2)}"), (2, f"{prose(20, 3)}  {passage}"), (3, prose(80, 4)), (4, None)]
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, frame(spark, rows), SF).collect()}
    assert got == {1: f"{prose(20, 1)}  {prose(20, 2)}", 2: f"{prose(20, 3)}  ", 3: rows[2][1], 4: None} and len(passage.encode()) < 240


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents labels pages benchmark conversations embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=str) == sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
