"""The pipeline's stages on their own inputs, and the whole."""

from collections import Counter

import corpus_pipeline
from fixtures import documents, texts
from test_near_copies import smallest_ids

from terrapath.llm import decontaminate, sharding
from terrapath.llm.common import store, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]
    label = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    bench = [decontaminate.fold(r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = store(stage(spark, docs, SF))
        after = docs.collect()
        rows = Counter((r.doc_id, r.text) for r in after)
        if name != "sharding":
            assert docs.columns == corpus_pipeline.COLUMNS
        assert set(rows) <= {(r.doc_id, r.text) for r in before}
        gone = [r for r in before if (r.doc_id, r.text) not in rows]
        if name == "toxicity":
            assert sum(label.get(r.doc_id) == 0 for r in gone) <= 0.02 * len(before)
            assert sum(label.get(r.doc_id) == 1 for r in after) <= 0.2 * sum(label.values())
        if name == "near-dedup":
            wanted = smallest_ids([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == wanted
        if name == "decontamination":
            assert {r.doc_id for r in gone} == {r.doc_id for r in before if any(b in decontaminate.fold(r.text) for b in bench)}
        if name == "mixing":
            assert not gone and len(after) > len(before) and set(rows.values()) <= {1, 2}
        if name == "sharding":
            assert len(after) == len(before)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in after)


def test_stages_with_odd_rows(spark):
    docs = documents(spark, texts(), clash=False)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = store(stage(spark, docs, SF))
    assert {r.shard for r in docs.collect()} <= set(range(24))
    assert sharding.assign_shards(docs, 3).count() == docs.count()


def test_leaks_go_by_row(spark):
    leak = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(1, leak), (None, leak), (2, "a clean text of a few words"), (1, "another clean text"), (None, "clean, without an id"), (3, None)]
    kept = corpus_pipeline.drop_leaks(spark, documents(spark, rows, clash=False), SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows[2:])
