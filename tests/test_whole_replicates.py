"""Resampling queries draw the operators' full number of replicates."""

import pytest

import __spark_entry__ as entry
from wayloom.operators import causal as A
from wayloom.operators import evaluation as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, module, operator, at", [("auc_decision", E, "clustered_auc", 1), ("matched_effect", A, "cluster_interval", 3)])
def test_registered_replicates(spark, monkeypatch, name, module, operator, at):
    seen, run = [], getattr(module, operator)

    def noted(*args, **kwargs):
        seen.append(args[at] if len(args) > at else kwargs.get("replicates", run.__defaults__[0]))
        return run(*args, **kwargs)

    monkeypatch.setattr(module, operator, noted)
    entry.queries()[name](spark, SF)
    assert seen == [{"auc_decision": 1000, "matched_effect": 300}[name]]


def test_all_replicates_of_the_auc(spark):
    assert entry.queries()["clustered_auc_all_replicates"](spark, SF).agg({"replicate": "max"}).first()[0] == 999
    for name, n in (("stratified_att", 300), ("specification_table", 300), ("cluster_bootstrap", 300)):
        assert f"range(0, {n})" in entry.oracle_sql()[f"{name}_all_replicates"]
