"""Registered queries: their columns, the next-document edit, and the pipeline as a whole."""

import hashlib
import os

import pytest
from llm_cases import edge_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_all_are_registered(entry):
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in names and entry.oracle_sql().keys() <= names.keys()


@pytest.mark.parametrize("name", ["op2_warc", "op12_vector_codes", "op13_collocations"])
def test_equals_sql(spark, entry, name):
    from checks.compare import database, rows_of

    df = entry.queries()[name](spark, SF)
    result = database(SF).execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())


def test_edited_texts(spark, entry):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    found = sorted(entry.queries()["op4_fingerprints"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert len(docs) == len(found)
    for k, (doc, r) in enumerate(zip(docs, found)):
        text, other = doc.text or "", docs[(k + 1) % len(docs)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r.doc_id, r.n_chars) == (doc.doc_id, len(text))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) or r.fingerprint != r.edited_fingerprint
    assert sum(r.near_edited for r in found) > 5 * sum(r.near_next for r in found)


def test_pipeline_stages(spark):
    import corpus_pipeline

    from trafficlens.session import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
            sizes.append(len(ids))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids


def test_pipeline_stages_on_edge_cases(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([r[:5] for r in edge_rows()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).count()
    once = corpus_pipeline.keep_one_of_each_group(spark, rows, SF).collect()
    assert sum(r.doc_id == 4 for r in once) == 1 and not any(r.doc_id in (5, 6) for r in once)
    assert sum(r.doc_id is None for r in once) == sum(r[0] is None for r in edge_rows())


def test_pipeline_runs(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in found) > 0
    # The mix takes documents several times; no sequence holds two beginnings of one.
    starts = {}
    for r in found:
        if r.start == 0:
            starts[r.sequence_id, r.doc_id] = starts.get((r.sequence_id, r.doc_id), 0) + 1
    assert set(starts.values()) == {1} and len(starts) > len({doc for _, doc in starts})
