"""Exact, near and line dedup and decontamination against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import decontamination, exact_dedup, line_dedup, near_dedup
from wayloom.llm.shared import components

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta omega sigma kappa theta lambda zeta iota river stone cloud green amber north south".split()
NASTY = [None, "", " \n\t ", "One", "one", "x" * 300_000, "Éa b", "éa b", "a b c d", "A B C D", "word " * 4000]


def frame(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, i, "k", 1, "en") for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int, key string, n int, root string")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def varied(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def exact_want(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(brute.ASCII_LOWER), []).append(d)
    out = []
    for d, t in rows:
        t = (t or "").translate(brute.ASCII_LOWER)
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1, 4096])
def test_exact_dedup(spark, capacity):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(100, "dup"), (101, "DUP"), (101, "dup"), (None, "dup"), (None, "lone")] + [(200 + i, "hot") for i in range(40)]
    got = exact_dedup.exact_dedup(frame(spark, rows), capacity=capacity)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == exact_want(rows)
    if capacity == 1:
        assert got.select("bucket", "depth").distinct().count() > 8
    kept = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "row", "key", "n", "root"]
    assert sorted(r["doc_id"] for r in kept.filter("doc_id >= 100").collect()) == [101, 101, 239]
    assert exact_dedup.exact_dedup(frame(spark, []), capacity).count() == 0


def test_exact_copies_go_by_document_and_text(spark):
    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(frame(spark, rows)).collect()), key=str)

    assert kept([(5, "A"), (5, "B"), (9, "B"), (3, "A")]) == [(5, "A"), (9, "B")]
    assert kept([(None, "a"), (7, "A"), (None, "lone"), (None, None), (8, "")]) == [(7, "A"), (8, ""), (None, "lone")]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    want = brute.roots({x for link in links for x in link}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {n for n in want if all(a == b for a, b in links if n in (a, b))}
    assert got == {n: r for n, r in want.items() if n not in alone}


def test_near_dedup(spark):
    rng = random.Random(9)
    texts = dict(enumerate(NASTY))
    base = prose(rng, 150)
    for i in range(100, 190):
        texts[i] = varied(base, rng, rng.randrange(0, 14))
    passage = prose(rng, 60)
    for i in range(200, 260):
        texts[i] = prose(rng, rng.randrange(20, 120)) + " " + passage
    for i in range(300, 340):
        texts[i] = texts[200 + i % 60] + " tail" * (i % 3)
    rows = list(texts.items()) + [(120, texts[120]), (None, base), (None, None)]
    want, sizes = brute.near_components(texts)
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r["doc_id"]
    kept = near_dedup.drop_near_copies(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, c in want.items() if d == c} | {None}
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_near_dedup_blocks_find_what_hubs_leave(spark):
    """Without any component known, the block join alone gives every pair, whatever the block size."""
    rng = random.Random(2)
    base = prose(rng, 120)
    texts = {i: varied(base, rng, rng.randrange(0, 9)) for i in range(60)}
    docs = frame(spark, list(texts.items()))
    sets = near_dedup.sketches(docs).select("doc_id", "sig")
    posts, full = near_dedup.postings(sets), near_dedup.shingle_sets(docs)
    nobody = spark.createDataFrame([], "node long, root long")
    shingled = {d: brute.shingles(t) for d, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and 100 * len(shingled[a] & shingled[b]) >= 75 * len(shingled[a] | shingled[b])}
    for block in (7, 1000):
        pairs = near_dedup.rest_pairs(posts, nobody, full, block=block)
        assert {tuple(r) for r in near_dedup.verified(pairs, full).collect()} == want


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_near_dedup_crowded_blocks_are_connected(spark, block):
    """Chains of near copies, crowded in every list: a block gives no more rows than it has documents, and what links connects
    stays connected, whatever the block size."""
    rng = random.Random(12)
    texts, base = {}, prose(rng, 150)
    for i in range(150):
        texts[i] = base = varied(base, rng, 2)
        if i % 50 == 49:
            base = prose(rng, 150)
    docs = frame(spark, list(texts.items()))
    posts, full = near_dedup.postings(near_dedup.sketches(docs).select("doc_id", "sig")), near_dedup.shingle_sets(docs)
    nobody = spark.createDataFrame([], "node long, root long")
    found = near_dedup.rest_pairs(posts, nobody, full, block=block, folded=True).collect()
    blocks = {}
    for r in found:
        blocks.setdefault((r["place"], r["value"], r["x"], r["y"]), []).append(r)
    sizes = {(r["place"], r["value"]): r["n"] for r in posts.groupBy("place", "value").agg(F.count("*").alias("n")).collect()}
    assert any(r["b"] is None for r in found) and all(len(own) <= sizes[key[:2]] for key, own in blocks.items())
    links = near_dedup.rest_links(posts, nobody, full, block=block)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want, _ = brute.near_components(texts)
    assert {d: got.get(d, d) for d in texts} == want
    shingled = {d: brute.shingles(t) for d, t in texts.items()}
    assert all(100 * len(shingled[a] & shingled[b]) >= 75 * len(shingled[a] | shingled[b]) for a, b in links.collect())


def test_near_dedup_whole_table(spark):
    want, sizes = brute.near_components(documents(spark))
    from wayloom.llm.queries import QUERIES

    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in QUERIES["op3_minhash_near_dedup"](spark, SF).collect()}
    assert got == {d: (want[d], sizes[d]) for d in want}


def test_decontamination(spark):
    rng = random.Random(3)
    items = {1: prose(rng, 30), 2: prose(rng, 200), 3: "four words are here", 4: None, 5: "", 6: prose(rng, 8)}
    filler = prose(rng, 3000)
    texts = {
        1: filler + " " + items[1].upper() + "\n" + filler, 2: prose(rng, 40), 3: "Four  words are\nhere", 4: "no four words are here", 5: None, 6: "",
        7: varied(items[2], rng, 4) + " end", 8: varied(items[2], rng, 60), 9: "x " + items[6] + " y " + items[1], 10: " ".join(items[1].split(" ")[:28]),
    }
    rows = list(texts.items()) + [(9, texts[9]), (None, items[1])]
    bench = spark.createDataFrame(list(items.items()) + [(1, items[1]), (None, items[1])], "item_id long, text string")
    want = brute.leaks(texts, items)
    assert {(1, 1), (7, 2), (9, 6), (10, 1)} <= want and all(d != 8 for d, _ in want)
    got = decontamination.decontamination(frame(spark, rows), bench).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], i) for r in got for i in r["item_ids"]} == want
    assert all(r["contaminated"] == (r["n_items"] > 0) == (r["best"] >= 0.75) for r in got)
    kept = decontamination.drop_contaminated(frame(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontamination(frame(spark, rows), empty).filter("contaminated").count() == 0
    assert decontamination.decontamination(frame(spark, []), bench).count() == 0


def test_decontamination_whole_table(spark):
    from wayloom.llm.queries import QUERIES

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], i) for r in QUERIES["op6_decontamination"](spark, SF).collect() for i in r["item_ids"]}
    assert got == brute.leaks(documents(spark), items)


def test_lines_are_trimmed_and_named_by_their_text():
    rng = random.Random(1)
    texts = ["\n".join("".join(rng.choice(" \t\r\x0bab") for _ in range(rng.randrange(14))) for _ in range(200)), "", "\n\n", " " * 5000 + "x" + " " * 900]
    lines = line_dedup.Lines(texts)
    want = [x.strip(brute.SPACE) for t in texts for x in t.split("\n")]
    assert [lines.points[a:b].tobytes().decode("utf-32-le") for a, b in zip(lines.start, lines.end)] == want
    assert len(set(want)) == len(set(zip(lines.x.tolist(), lines.y.tolist())))


def test_banded_distance():
    rng = random.Random(5)
    xs = ["".join(rng.choice("aébc") for _ in range(rng.choice([0, 1, 2, 3, 10, 70, 140]))) for _ in range(600)]
    ys = []
    for x in xs:
        y = list(x)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
        ys.append("".join(y))
    for edits in (1, 2, 4):
        assert line_dedup.within(xs, ys, edits).tolist() == [brute.edit_distance(x, y) <= edits for x, y in zip(xs, ys)]


@pytest.mark.parametrize("small", [3, 64])
def test_line_dedup(spark, small):
    rng = random.Random(6)
    base = "the quick brown fox jumps over a lazy dog near the river bank"
    lines = [base, base.upper(), "short line", "shorx line", "  short line\r", "", "   ", "é" * 50, "é" * 48 + "xé", "y" * 500, "y" * 499 + "z"]
    for _ in range(40):
        x = list(base)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = rng.choice("abcxyz")
        lines.append("".join(x))
    rows = [(i, "\n".join(rng.sample(lines, 6))) for i in range(30)] + [(90, None), (91, ""), (92, "\n\n"), (93, base)]
    got = {(r["doc_id"], r["line_no"]): ((r["class_doc_id"], r["class_line_no"]), r["class_size"], r["kept"]) for r in line_dedup.line_classes(frame(spark, rows), small=small).collect()}
    want = {}
    hashes = {r["doc_id"]: r["h"] for r in frame(spark, rows).select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert len(set(hashes)) == len(rows)
    for place, (first, size) in brute.line_classes(rows).items():
        want[place] = (first, size, place == first)
    assert got == want
    if small == 64:
        texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
        for d, t in rows:
            left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want or want[d, n][2])
            assert texts[d] == left
        assert line_dedup.line_classes(frame(spark, [])).count() == 0


def test_line_dedup_repeated_and_null_ids(spark):
    line = "a line that is long enough to be compared with others"
    got = line_dedup.line_classes(frame(spark, [(3, line), (3, line), (None, line + "s"), (4, line)])).collect()
    assert sorted((str(r["doc_id"]), r["class_doc_id"], r["class_size"], r["kept"]) for r in got) == [("3", None, 4, False), ("3", None, 4, False), ("4", None, 4, False), ("None", None, 4, True)]


def test_line_dedup_hot_segment(spark):
    """Very many lines under one key, in one batch and over several, lose no link."""
    head = "the same beginning of very many lines, then"
    rows = [(i, f"{head} {i:04d}{i:04d} and {'a' if i % 2 else 'b'} different end {i * 7919 % 100000:05d}") for i in range(160)]
    rows += [(10_000 + i, rows[i][1][:-1] + "x") for i in range(0, 160, 20)]
    got = {r["doc_id"]: r["class_doc_id"] for r in line_dedup.line_classes(frame(spark, rows).repartition(3), small=5).collect()}
    want = brute.line_classes(rows)
    assert got == {d: want[d, 0][0][0] for d, _ in rows}


def test_shingle_hashes_do_not_depend_on_pieces():
    from wayloom.llm import shingles as S
    import pyarrow as pa

    texts = ["one two three four five six seven", None, "", "A b", "long " * 300_000 + "end", "x" * 2_500_000 + " y", "z" * (S.PIECE + 5000), "short one", "w" * (S.PIECE - 3) + " " + "v" * 9000, None, "one two\tthree\nfour five SIX seven"]
    column = pa.array(texts)
    data, bounds = S.text_buffer(column)
    together = S.shingle_hashes(data, bounds)
    for i, t in enumerate(texts):
        d, b = S.text_buffer(pa.array([t], pa.string()))
        own, n = S.shingle_hashes(d, b)
        at = int(together[1][:i].sum())
        assert n[0] == together[1][i] and np.array_equal(own, together[0][at : at + n[0]])
        assert len(set(own.tolist())) == len(brute.shingles(t))
    assert np.array_equal(together[0][:3], together[0][-3:])
