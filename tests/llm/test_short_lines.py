"""The registered line dedup links short lines too, and allows long ones more edits."""

import random

import brute
import numpy as np

from wayloom.llm import line_dedup
from wayloom.llm.queries import QUERIES


def allowed(n):
    return 0 if n < 2 else 1 if n < 40 else 2 if n < 160 else 3 if n < 320 else 4


def classes(rows):
    names = {(d, n): x.strip(brute.SPACE) for d, t in rows for n, x in enumerate(t.split("\n")) if x.strip(brute.SPACE)}
    texts = sorted(set(names.values()))
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= 4 and brute.edit_distance(a, b) <= allowed(min(len(a), len(b)))]
    roots = brute.roots(texts, links)
    return {p: min(q for q in names if roots[names[q]] == roots[x]) for p, x in names.items()}


def test_short_and_long_lines(spark, tmp_path):
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("abcdefghij 0123456789é") for _ in range(n)).replace(" ", "x", 1).strip().ljust(n, "z")

    def changed(x, edits):
        for _ in range(edits):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice(["", "Q", x[at] + "Q"]) + x[at + 1 :]
        return x

    lines = ["Page 1 of 9", "Page 2 of 9", "Share (3)", "Share (4)", "a", "b", "ab", "cb", "x" * 39, "x" * 38 + "yx", "y" * 39, "y" * 39 + "zz"]
    for n in (2, 3, 4, 7, 12, 20, 38, 39, 40, 41, 42, 60, 158, 159, 160, 161, 162, 250, 318, 319, 320, 321, 323):
        for _ in range(3):
            base = text(n)
            lines += [base, *(changed(base, k) for k in range(1, 6) if k < n)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i::25])) for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == classes(rows)


def test_limits_by_length():
    assert line_dedup.limit_of(np.array([0, 1, 2, 39, 40, 159, 160, 319, 320, 9999]), line_dedup.LIMITS).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_lines_within_their_limit_share_a_key_of_the_shorter_one():
    rng = random.Random(8)
    limits = line_dedup.LIMITS
    starts = line_dedup.length_classes(limits, 700)[0].tolist()
    pairs = []
    for n in [*range(2, 60), *(s + d for s in starts for d in (-2, -1, 0, 1, 2) if s > 58)]:
        for _ in range(6):
            a = "".join(rng.choice("abcxyz019é") for _ in range(n))
            b = a
            edits = rng.randrange(1, allowed(n) + 1)
            for _ in range(edits):
                at = rng.choice([0, max(0, len(b) - 1), rng.randrange(max(1, len(b)))])
                b = b[:at] + rng.choice(["", "Q", b[at] + "Q"]) + b[at + 1 :]
            a, b = sorted((a, b), key=len)
            if edits <= allowed(len(a)):
                pairs.append((a, b))
    lines = line_dedup.Lines([x for p in pairs for x in p])
    rows, keys, indexed = line_dedup.segment_keys(lines, np.arange(len(lines.length)), limits)
    own = {}
    for row, key, first in zip(rows.tolist(), keys.tolist(), indexed.tolist()):
        own.setdefault(row, ({}, set()))[1].add(key)
        if first:
            own[row][0][key] = True
    assert len(pairs) > 800
    assert all(own[2 * i][0].keys() & own[2 * i + 1][1] for i in range(len(pairs)))


def test_a_line_has_few_postings():
    rng = random.Random(9)
    for n, most in ((30, 3), (100, 6), (200, 11), (400, 18), (3000, 13)):
        lines = line_dedup.Lines(["".join(rng.choice("abcdefgh") for _ in range(n + d)) for d in range(9)])
        rows, _, indexed = line_dedup.segment_keys(lines, np.arange(9), line_dedup.LIMITS)
        assert len(rows) <= 9 * most
        assert indexed.sum() == 9 * (allowed(n) + 1)


def test_crowded_lines_that_are_not_alike_make_no_pairs(spark):
    """Lines of one key in many classes meet in tasks; only links come out, and none is lost."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
    lines = []
    for _ in range(60):
        own = list(words)
        for at in rng.sample(range(30), 2):
            own[at] = "".join(rng.sample(own[at], 6))
        lines += [" ".join(own), " ".join(own)[: -rng.randrange(1, 4)]] if rng.random() < 0.3 else [" ".join(own)]
    rows = [(i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = classes(rows)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in line_dedup.line_classes(docs, small=4, limits=line_dedup.LIMITS).collect()}
    assert len(set(want.values())) > 5 and got == want
    meeting = line_dedup.met(line_dedup.postings(docs, line_dedup.LIMITS), 4).cache()
    members, texts = meeting.filter("tag = 1"), line_dedup.line_texts(docs, meeting.selectExpr("bx AS x", "by AS y").distinct())
    none = spark.createDataFrame([], "node struct<x: long, y: long>, root struct<x: long, y: long>")
    for block in (1024, 16):
        links = line_dedup._rest(members, none, texts, line_dedup.LIMITS, block)
        assert links.count() < 4 * len(lines)
    meeting.unpersist()
