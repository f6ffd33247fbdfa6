"""The registered model query trains the production forest."""

from gatewarden.operators import features
from gatewarden.plans import requests as plans


def test_forest_of_the_query_has_production_size(spark, monkeypatch):
    kept, train = [], features.train
    monkeypatch.setattr(features, "train", lambda *a, **kw: kept.append(train(*a, **kw)) or kept[-1])
    plans.QUERIES["rf_train_score"](spark, "/root/testdata/sf0.001")
    forest = kept[0].stages[-1]
    assert forest.getNumTrees == 100 and forest.getOrDefault("maxDepth") == 12
