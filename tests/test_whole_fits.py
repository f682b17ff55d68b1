"""Registered model queries fit with the full numbers of trees, rounds, folds and repeats."""

import inspect

import pytest

import __spark_entry__ as entry
from wayloom.operators import models as M


class Asked(Exception):
    """What a registered query asked an operator for."""


@pytest.mark.parametrize("name, operator, want", [
    ("travel_time_evaluation", "evaluate_travel_time", {"trees": 50, "depth": 10}),
    ("travel_time_verdict", "evaluate_travel_time", {"trees": 50, "depth": 10}),
    ("ensemble_evaluation", "evaluate_ensemble", {"trees": 100, "rounds": 100}),
    ("route_predictions", "fit_ensemble", {"trees": 100, "rounds": 100}),
    ("high_delay_classifiers", "evaluate_high_delay", {"trees": 100, "subsets": ("sqrt", "log2", "0.3", "0.5")}),
    ("travel_time_regression", "evaluate_regression", {"rounds": 250}),
    ("count_model_validation", "cross_validate_counts", {"repeats": 10, "folds": 5}),
    ("count_model_study", "target_study", {"repeats": 10, "folds": 5, "replicates": 2000}),
    ("count_model_ensemble", "bootstrap_ensemble", {"times": 10}),
    ("closure_model_validation", "cross_validate_closures", {"repeats": 10, "folds": 5, "models": M.CLOSURE_MODELS}),
])
def test_registered_fits_are_whole(spark, monkeypatch, name, operator, want):
    signature = inspect.signature(getattr(M, operator))

    def caught(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(M, operator, caught)
    with pytest.raises(Asked) as asked:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert {k: asked.value.args[0][k] for k in want} == want
