"""The pipeline, stage by stage, and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lineweave.llm import mixing, packing, quality, secrets
from lineweave.llm.stages import reread

from test_similar import slow_kept

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect() if "text" in docs.columns else []
        docs = reread(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect(), docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "mixing_sources", "packing"]
    assert all(cols == names for n, (_, _, cols) in seen.items() if n != "packing")
    before, after, _ = seen["quality_rules"]
    verdict = {r.id: r.kept for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, k in verdict.items() if k) and 0 < len(after) < len(before)
    before, after, _ = seen["simhash_near_dedup"]
    # the stage's rule is five-word shingles and 4/5, not the two bits of the query op2_simhash
    assert sorted(r.doc_id for r in after) == slow_kept([(r.doc_id, r.text) for r in before])
    before, after, _ = seen["secret_scans"]
    clean = {r.doc_id: r for r in after}
    assert len(clean) == len(before) and all(clean[r.doc_id].text == secrets.redact(r.text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text) for r in before)
    before, after, _ = seen["mixing_sources"]
    taken = {r.id: r.taken for r in mixing.mixed_sizes(spark.createDataFrame(before)).collect()}
    words = {}
    for r in after:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {k: v for k, v in taken.items() if v}
    before, after, _ = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and max(r.offset + r.length for r in after) <= packing.MAX_TOKENS
    assert sum(r.length for r in after if r.start == 0) > 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == len(after)


def test_stages_take_empty_tables_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = reread(stage(spark, docs, SF), name)
        docs.count()
    for name, stage in corpus_pipeline.STAGES[1:]:  # each on nulls itself
        stage(spark, spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "a b", None, None, 3)], schema), SF).count()


def test_queries_run(spark):
    q = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in q} and "pipeline" in q
    for name in sorted(q):
        if name.startswith("op"):
            assert q[name](spark, SF).count() > 0
