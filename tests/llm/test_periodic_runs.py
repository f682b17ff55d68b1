"""Periodic runs against a scan of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wayloom.llm import periodic_runs as pr
from wayloom.llm import queries

SF = "/root/testdata/sf0.001"


def runs(words, length=24, times=3):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(length, times * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def want(doc_id, words, length=24, times=3):
    own = runs(words, length, times)
    gone = {i for s, n, p in own for i in range(s + p, s + n)}
    best = None
    for r in own:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
    return doc_id, len(own), best, own, digest, " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repetitive(rng):
    k, out = rng.choice([1, 2, 3, 10, 100]), []
    for _ in range(rng.randrange(0, 9)):
        if rng.random() < 0.5:
            out += [str(rng.randrange(k)) for _ in range(rng.randrange(0, 40))]
        else:
            unit = [str(rng.randrange(k)) for _ in range(rng.randrange(1, rng.choice([4, 12, 60, 150])))]
            again = unit * rng.randrange(1, 9)
            out += again[: max(0, len(again) - rng.randrange(3))]
    return rng.choice([" ", "\n", " \t "]).join(out)


def texts():
    rng = random.Random(8)
    nasty = [None, "", " \n\t ", "a " * 24, "a " * 23, "A a " * 20, "é\xa0x " * 30, "a b c " * 12, "x" * 300_000, ("p q " * 12 + "r s t " * 9) * 4]
    return [repetitive(rng) for _ in range(250)] + nasty


def answer(r):
    return r["doc_id"], r["n_runs"], r["best"] and tuple(r["best"]), [tuple(x) for x in r["runs"]], r["runs_sha256"], r["collapsed"]


@pytest.mark.parametrize("options", [{}, {"length": 10}, {"times": 4}, {"direct": 1}])
def test_against_all_lags(spark, options):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, start int, n_runs int, best string").repartition(4)
    got = {r["doc_id"]: answer(r) for r in pr.periodic_runs(df, **options).collect()}
    own = {k: v for k, v in options.items() if k != "direct"}
    assert got == {d: want(d, words_of(t), **own) for d, t in rows}


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b " * 20), (5, "a b " * 20), (5, "c")], "doc_id long, text string")
    assert sorted((answer(r) for r in pr.periodic_runs(df).collect()), key=str) == sorted([want(None, ["a", "b"] * 20), want(5, ["a", "b"] * 20), want(5, ["c"])], key=str)
    assert pr.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(df, times=2)


def test_seeds_beyond_the_direct_lags_come_from_minimizers(monkeypatch):
    ids = np.r_[np.tile(np.arange(40), 5), 10**6]
    assert pr.runs_of(ids, np.array([201])).tolist() == [[0, 200, 40]]
    monkeypatch.setattr(pr, "scale_seeds", lambda seq, low, high: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert pr.runs_of(ids, np.array([201])).tolist() == []


def test_lying_hashes_are_put_right(monkeypatch):
    """Hashes that call everything equal: stretches come out right all the same."""
    ids = np.r_[np.arange(100, 150), np.tile(np.arange(20), 4), np.arange(200, 240)]
    at, n = pr._confirmed(ids, np.array([0]), np.array([150]), np.array([20]), np.array([70]))
    assert (at.tolist(), n.tolist()) == ([50], [60])


def test_long_texts():
    """Text of a million words: none, one period, two words that alternate by Thue and Morse (which fools hashes modulo 2^64)."""
    rng = np.random.default_rng(2)
    for words, count in ((rng.integers(0, 5000, 10**6), 0), (np.tile(rng.integers(0, 10**6, 7919), 130), 1), (np.array([bin(i).count("1") & 1 for i in range(1 << 18)]), 0)):
        assert len(pr.runs_of(np.r_[words, 10**7], np.array([len(words) + 1]))) == count


def test_query_on_its_table(spark):
    expected = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, h = words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        doc_id, n_runs, best, _, digest, collapsed = want(r["doc_id"], words)
        start, length, period = best or (None,) * 3
        expected.append((doc_id, n_runs, start, length, period, best and 1000 * length // period, digest, hashlib.sha256(collapsed.encode()).hexdigest()))
    got = queries.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert sum(e[1] for e in expected) > 10
