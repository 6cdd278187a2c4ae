"""Toxicity is learned in a task: the driver of a pipeline has no room for it."""

import os

import numpy as np

from terrapath.llm import queries, toxicity
from terrapath.llm.common import table


def test_the_driver_does_not_train(spark, sf, monkeypatch):
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, *settings: train(rows, *settings) | {"pid": os.getpid()})
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = queries.toxicity_model(docs, labels)
    assert model.pop("pid") != os.getpid()
    want = train(toxicity.sample_labelled(docs, labels.where(queries.part_of("doc_id", 5) != 0)))
    assert set(model) == set(want) and all(np.allclose(model[k], want[k], atol=1e-2) for k in want)
    assert set(queries.toxicity_model(docs.limit(0), labels)) == set(want) | {"pid"}
