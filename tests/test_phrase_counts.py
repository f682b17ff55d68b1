"""Counts of n-grams against HashingTF over the n-grams themselves."""

import math

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from wayloom.functions import text as X
from wayloom.operators import models as M

TEXTS = ["la marina  bar", "Café\tÓptica \n日本語 ñandú", "a", "", "   ", None, "x\U0001f600y aaaa aaaa zzzzzzzzzzzz", "uno dos uno", "no break here"]


@pytest.mark.parametrize("low, high, slots", [(2, 5, 1 << 18), (3, 4, 1000), (4, 7, 1 << 18)])
def test_counts_are_those_of_the_ngrams(spark, monkeypatch, low, high, slots):
    monkeypatch.setattr(M, "WORDS_KEPT", 3)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    grams = df.dropna().withColumn("g", X.word_ngrams(X.model_text(F.col("t")), low, high))
    want = {r["id"]: {int(i): 1 + math.log(v) for i, v in zip(r["v"].indices, r["v"].values)} for r in HashingTF(inputCol="g", outputCol="v", numFeatures=slots).transform(grams).collect()}
    got = {r["id"]: r["_ltf"] for r in M.counted(df, "t", low, high, slots).collect()}
    assert len(got) == len(TEXTS) and not len(got[5].indices)
    for i, counts in want.items():
        assert got[i].size == slots and dict(zip(got[i].indices.tolist(), got[i].values.tolist())) == pytest.approx(counts)


def test_ngrams_are_counted_without_a_row_or_string_for_each(spark):
    """No list of n-grams is made for a text: the plan has the texts and their vectors."""
    df = spark.createDataFrame([(1, "uno dos")], "id int, t string")
    assert "transform(" not in M.counted(df, "t")._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_fit_keep_their_parts_and_only_used_places(spark, monkeypatch):
    """Rows are not exchanged by their few labels; places that no text of the fit has get no coefficient."""
    seen = []

    class Caught(M.LogisticRegression):
        def _fit(self, dataset):
            seen.append(dataset)
            return super()._fit(dataset)

    monkeypatch.setattr(M, "LogisticRegression", Caught)
    df = spark.createDataFrame([(f"{'casa' if i % 2 else 'perro'} {i}", "uv"[i % 2]) for i in range(60)] + [("otro", None)], "t string, c string")
    model = M.fit_phrases(df, "t", "c")
    assert seen[0].rdd.getNumPartitions() == M.spread(df).rdd.getNumPartitions() and seen[0].count() == 60
    assert model[2].numFeatures == len(model[0][2]) < 1000
    out = {r["t"]: r["category"] for r in M.classify_phrases(model, spark.createDataFrame([("casa nueva",), ("perro",)], "t string"), "t").collect()}
    assert out == {"casa nueva": "v", "perro": "u"}
