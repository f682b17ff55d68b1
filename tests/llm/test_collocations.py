"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wayloom.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def want(rows, least, words=5, percent=100, first=None):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for k in range(1, words + 1):
                counts.setdefault(lang, Counter()).update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, f in counts.items():
        found, n = [], totals[lang]
        frequent = {p: c for p, c in f.items() if c >= least}
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            longer = [c for q, c in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= percent * a for c in longer):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def texts(rng, n):
    stock = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(rng.choice([rng.choice(stock), rng.choice("ABCDefghijkl"), "x x x", f"w{rng.randrange(40)}", "ÄÖ\xa0ü", "Éa"]))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b", "\r\n", "\x1c"]))
        rows.append(("".join(parts), rng.choice(["en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize(("least", "percent", "chunk", "shipped"), [(10, 100, 2 << 20, co.SHIPPED), (4, 100, 300, 0), (4, 100, 300, 40), (6, 60, 300, co.SHIPPED)])
def test_against_a_plain_count(spark, monkeypatch, least, percent, chunk, shipped):
    """Chunks of any size, with rankings sent to the tasks, joined, or some of each."""
    monkeypatch.setattr(co, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(co, "SHIPPED", shipped)
    monkeypatch.setattr(co, "HELD_WORDS", shipped + 20)
    rows = texts(random.Random(least), 150) + [(None, "en"), ("", "en"), (" \t\n.", "fr"), ("word", None), ("!" * 50, "en"), ("q " * 5000, "long")]
    df = spark.createDataFrame([(i, t, g, "c", 5, 7) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, chunk string, n int, id int").repartition(3)
    got = co.collocations(df, least=least, percent=percent, first=None)
    assert sorted(tuple(r) for r in got.collect()) == want(rows, least, percent=percent)
    first = co.collocations(df, least=least, percent=percent, first=3)
    assert sorted(tuple(r) for r in first.collect()) == want(rows, least, percent=percent, first=3)


def test_other_lengths_and_empty_tables(spark):
    rows = [("a b c d e f g", "en")] * 3 + [("a b c x", "en")] * 2
    df = spark.createDataFrame(rows, "text string, lang string")
    for words in (2, 3, 7):
        assert sorted(tuple(r) for r in co.collocations(df, 2, words, first=None).collect()) == want(rows, 2, words)
    assert co.collocations(df.limit(0)).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def test_scores_past_64_bits(spark):
    row = (2**44, 2**45, [2**44, 2**44], [2**44, 2**44])
    df = spark.createDataFrame([row], "n long, total long, first_counts array<long>, last_counts array<long>")
    assert df.select(co.lowest_cut(2)["score"]).first()[0] == 1000 * 2**44 * 2**45 // 2**88


@pytest.mark.parametrize("dense", [1, 50, 10**9])
def test_tiles_count_like_a_counter(dense):
    rng = np.random.default_rng(1)
    a, b = (rng.zipf(1.3, 20_000).clip(1, 2**31 - 1) - 1 for _ in range(2))
    codes = a.astype(np.int64) << 32 | b.astype(np.int64)
    found, counts = co.tile_counts(codes, side_bits=4, dense=dense)
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == Counter(codes.tolist())


def test_long_text(spark):
    """One text of some MB, far longer than a chunk, with phrases across where a chunk would end."""
    words = [f"w{i % 997}" for i in range(600_000)]
    got = co.collocations(spark.createDataFrame([(" ".join(words), "en")], "text string, lang string"), first=None)
    found = got.collect()
    assert len(found) == 997 and {len(r["phrase"].split()) for r in found} == {5}
    assert {r["a"] for r in found} == {601, 602} and {r["n"] for r in found} == {600_000}
