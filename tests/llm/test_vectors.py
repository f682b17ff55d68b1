"""Embedding near-dedup against all pairs, on vectors with planted copies and on rows that cannot be compared."""

import math

import numpy as np
import pytest

from wayloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, a int, root string, code long"


def planted(rng, dim=48):
    """Spread-out vectors, chains of near copies, one large group, and equal rows."""
    base = rng.standard_normal((150, dim))
    rows = list(base)
    for k in range(20):
        at = base[k]
        for _ in range(6):
            at = at + rng.standard_normal(dim) * 0.25 * np.linalg.norm(at) / math.sqrt(dim)
            rows.append(at)
    rows += [base[30] + rng.standard_normal(dim) * 0.05 for _ in range(300)]
    rows += [base[31]] * 50
    return np.array(rows, np.float32)


def want(rows, cosine=ed.COSINE):
    """All pairs in double precision, on (vec_id, vector) rows."""
    good = [(i, np.array(v, np.float64)) for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, near = [0] * len(rows), {}
    for n, (i, x) in enumerate(good):
        for j, y in good[:n]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                near.setdefault(rows[i][0], set()).add(rows[j][0])
                near.setdefault(rows[j][0], set()).add(rows[i][0])
    root = {}
    for d in sorted({d for d, _ in rows if d is not None}):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = d
                todo += near.get(x, ())
    return sorted(((d, links[i], root.get(d), d is None or root[d] == d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("options", [{}, {"block": 16, "bucket": 1}])
def test_all_links_are_found(spark, options):
    vectors = planted(np.random.default_rng(3))
    rows = [(int(d), [float(x) for x in v]) for d, v in zip(np.random.default_rng(4).permutation(len(vectors)) * 7, vectors)]
    df = spark.createDataFrame([(d, v, 1, "x", 2) for d, v in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in ed.embedding_dedup(df, **options).collect()), key=str) == want(rows)


def test_rows_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]),
        (2, [0.0, 1.0]), (11, [0.0, 3.0]), (12, [0.0, 1.0, 0.0]), (13, [inf, 1.0]), (6, [0.0, -1.0]), (14, [0.0, 0.0]), (15, None), (None, None),
    ]
    df = spark.createDataFrame([(d, v, 1, "x", 2) for d, v in rows], SCHEMA)
    assert sorted((tuple(r) for r in ed.embedding_dedup(df).collect()), key=str) == want(rows)
    assert ed.embedding_dedup(df.limit(0)).collect() == []


def test_extreme_components_and_whole_numbers(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e-320, 0.0]), (3, [-1e300, 1e300]), (4, [-1.0, 1.0])]
    got = ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    got = ed.embedding_dedup(spark.createDataFrame([(1, [3, 4]), (2, [6, 8]), (3, [4, -3])], "vec_id int, embedding array<int>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("vectors", [1, 10**4, 10**7, 10**10])
def test_recall_at_the_threshold(vectors):
    """Pairs at exactly the threshold, hashed as planned for this number of vectors; the planned recall, less four deviations."""
    bits, tables = ed.plan_tables(vectors)
    assert vectors / 2**bits <= ed.BUCKET
    rng, n = np.random.default_rng(9), 800
    x, y = rng.standard_normal((2, n, 96))
    x = ed.units(x)
    y = ed.units(y - (x * y).sum(axis=1)[:, None] * x)
    y = ed.COSINE * x + math.sqrt(1 - ed.COSINE**2) * y
    met = (ed.sign_codes(x, bits, tables) == ed.sign_codes(y, bits, tables)).any(axis=1)
    assert met.mean() >= 0.999 - 4 * math.sqrt(0.001 / n)


def test_other_hyperplanes_lose_links(spark, monkeypatch):
    """The result hangs on the tables: with one table of very many planes most links between different vectors are gone."""
    vectors = planted(np.random.default_rng(3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    full = sum(r["n_links"] for r in ed.embedding_dedup(df).collect())
    monkeypatch.setattr(ed, "plan_tables", lambda *a: (60, 1))
    assert sum(r["n_links"] for r in ed.embedding_dedup(df).collect()) < full / 4
