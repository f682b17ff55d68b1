"""Results come through the dealt method: where it is switched off, they are lost."""

import random

import brute
from pyspark.sql import functions as F
from test_dedup import exact_want, frame, prose

from wayloom.llm import decontamination, exact_dedup


def test_exact_dedup_decides_in_the_buckets_of_the_directory(spark, monkeypatch):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(1000 + i, "Hot" if i % 2 else "hot") for i in range(300)] + [(None, "hot")]
    docs = frame(spark, rows)

    def answer():
        got = exact_dedup.exact_dedup(docs, capacity=16).cache()
        return sorted((tuple(r)[:5] for r in got.collect()), key=str), got

    rightly, got = answer()
    assert rightly == exact_want(rows)
    hot = got.filter("keep_id = 1299").select("depth", "bucket").distinct().collect()
    assert len(hot) == 1
    genuine = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: genuine(*a).filter("bucket % 2 = 0"))
    assert len(answer()[0]) < len(rows)
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: genuine(*a).withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 100_000))))
    assert answer()[0] != rightly


def test_exact_dedup_chains_texts_of_one_key(spark, monkeypatch):
    """With every text under the same key, bytes alone tell texts apart."""
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(None, None), (90, "")]
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *cols: F.lit(5).cast("long"))
    got = exact_dedup.exact_dedup(frame(spark, rows), capacity=8)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == exact_want(rows)
    assert {r["chain"] for r in got.collect()} == set(range(8))


def test_signatures_of_every_size_class(spark, monkeypatch):
    rng = random.Random(8)
    items = {n: prose(rng, n) for n in (*range(1, 40), 63, 64, 65, 130, 260, 1030, 5000)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    signed = decontamination.item_signatures(bench).groupBy("item_id", "n", "need", "size_class", "matches").agg(F.sum(F.col("in_signature").cast("int")).alias("k"), F.count("*").alias("all"))
    for r in signed.collect():
        assert r["n"] == r["all"] == len(brute.shingles(items[r["item_id"]])) and r["need"] == -(-r["n"] * 75 // 100)
        assert 2 ** r["size_class"] <= r["n"] < 2 ** (r["size_class"] + 1) and r["matches"] >= 1 and r["k"] - r["matches"] == r["n"] - r["need"]
    filler = prose(rng, 200_000)
    texts = {}
    for d, n in enumerate((8, 30, 64, 130, 1030, 5000)):
        words = items[n].split(" ")
        texts[d] = f"{filler} {items[n]} {filler[:900]}"
        texts[10 + d] = " ".join(words[: n - (n - 4) // 4])
        texts[20 + d] = " ".join(words[: n - (n - 4) // 4 - 1])
        texts[30 + d] = filler[: 50 * n] + " . ".join(" ".join(words[i : i + 40]) for i in range(0, n, 40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.leaks(texts, items)
    assert {(d, n) for d, n in enumerate((8, 30, 64, 130, 1030, 5000))} <= want
    found = decontamination.contained_items(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    genuine = decontamination.item_signatures
    monkeypatch.setattr(decontamination, "item_signatures", lambda *a: genuine(*a).withColumn("in_signature", F.lit(False)))
    assert decontamination.contained_items(docs, bench).count() == 0
