"""Queries that train candidates use every fold and the whole grid."""

import pytest

from tidecast.operators import split, training
from tidecast.plans import registry

import __spark_entry__  # noqa: F401


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["d7_ridge", "d10_gradient_boosting", "d13_rbf_kernel", "d17_trained_candidates",
                                  "d20_skipped_models", "d22_saved_models", "e10_expansion_round"])
def test_all_folds_and_sets(spark, sf, monkeypatch, name):
    def record(train, holdout, features, names, folds, search=True):
        raise Seen(len(folds), search)

    monkeypatch.setattr(training, "train_candidates", record)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[name](spark, sf)
    assert seen.value.args == (split.FOLDS, True)
