"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry
from eventlens.llm import jaccard, quality
from eventlens.llm.catalog import ORACLES, QUERIES
from eventlens.llm.common import BATCH, table
from eventlens.session import materialize

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


def test_stages(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, SF), "stage")
        if i < 3:
            assert out.columns == columns
            assert {r.doc_id: r.text for r in out.collect()}.items() <= seen[-1].items()
            seen.append({r.doc_id: r.text for r in out.collect()})
        docs_before, docs = docs, out
        if i == 0:
            model = quality.train(quality.split_training(docs_before), table(spark, SF, "labels"))
            assert seen[-1].keys() == {r.id for r in quality.score(docs_before, model).collect() if r.score >= 0.5}
        if i == 1:
            joined = jaccard.join(docs_before).collect()
            assert seen[-1].keys() == {r.id for r in joined if r.component_id == r.id}
    items = [" ".join((r.text or "").lower().split()) for r in table(spark, SF, "benchmark").collect()]
    whole = {d for d, t in seen[2].items() if any(x in " ".join((t or "").lower().split()) for x in items)}
    assert whole and not whole & seen[3].keys()
    assert {r.doc_id for r in docs.collect()} == seen[3].keys()
    run = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {tuple(r) for r in docs.collect()}


def test_stages_set_the_size_of_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.unset(name)
        stage(spark, table(spark, SF, "documents").limit(0), SF)
        assert spark.conf.get(name) == str(BATCH)
