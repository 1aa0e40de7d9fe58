"""The pipeline, stage by stage, against what its operators say of each stage's own input."""

import corpus_pipeline as cp
from tests.llm.test_exact import hits, linked


def test_stages(spark, small):
    from tidemark.llm import pii, toxicity
    from tidemark.llm.common import store

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "packing"]
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(store(stage(spark, kept[-1], small), name))
    sets = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in kept[:5]]
    assert all(t.columns == docs.columns for t in kept[:5])
    scored = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 0").collect()}
    assert set(sets[1]) == scored
    assert set(sets[2]) == {d for d, (_, c) in linked(sets[1]).items() if c == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert set(sets[3]) == {d for d, v in hits(sets[2], items).items() if not v[4]}
    spans = {r.doc_id: r.spans for r in pii.find(kept[3]).collect()}
    assert set(sets[4]) == set(sets[3])
    assert all((sets[4][d] == sets[3][d]) == (spans[d] == "") for d in sets[4])
    pieces = kept[5].groupBy("doc_id").sum("length").count()
    assert pieces == len(sets[4])
    assert cp.run(spark, small).count() == kept[5].count()


def test_empty(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
