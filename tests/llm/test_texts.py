"""Language ID, BPE, HTML, PII, URL filter, sharding and the pipeline: round trips, brute force, held-out accuracy, odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import bpe, html_text, language_id, pii, sharding, url_filter
from wayloom.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


# --- BPE -------------------------------------------------------------------------------------------------------------
ODD = [None, "", " ", "\n\n a  b\t\tc  ", "it's I'll 've 's 'S don''t \n's", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext", "日本語 텍스트 \U0001f469‍\U0001f52c é é", "x" * 5000,
       "ab" * 700 + " " * 300, "\x00\x1c\x1d\x85\xa0 ﻿", "Ⅷ²½ 12ab34", "՘࢏₏ \U000323b0x", " ñandú  Straße\r\n", "1" * 999]


def test_bpe_equals_the_tokenizer(spark, tokenizer):
    rng = random.Random(8)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3000, 0xD7FF), 32, 39, 10])) for _ in range(60)) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)] + [(0, None, 1, "y"), (None, "a b", 1, "z")], "doc_id long, text string, n_tokens int, ids string")
    got = bpe.bpe_encoding(frame, tokenizer_path()).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (list(r["ids"]), r["n_tokens"], r["decoded"]) == (ids, len(ids), tokenizer.decode(ids, skip_special_tokens=False)), repr(text)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.bpe_encoding(frame.limit(0), tokenizer_path()).count() == 0


def test_bpe_splits_where_the_tokenizer_does(tokenizer):
    own = bpe.Merges(tokenizer_path())
    own.ready()
    wrong = []
    for point in itertools.chain(range(0xD800), range(0xE000, 0x33000), range(0x3D000, 0x3D100)):
        c = chr(point)
        text = "a" + c + "1" + c + " " + c + "!" + c + "a"
        at = list(itertools.accumulate(map(len, own.words(text)), initial=0))
        if [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)] != list(zip(at, at[1:])):
            wrong.append(hex(point))
    assert not wrong


def test_bpe_whole_table(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in rows_of(spark, "documents")}
    for r in QUERIES["op7_bpe"](spark, SF).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- language ID -----------------------------------------------------------------------------------------------------
def test_language_id_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in rows_of(spark, "documents")}
    got = QUERIES["op10_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_language_id_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("score"), F.lit("x").alias("lettered"))
    whole = docs.filter("doc_id = 1").first()["text"]
    odd = [(9001, None, "en"), (9002, "", "fr"), (9003, " 12 +-!\n", None), (9004, "é", None), (9005, whole * 2000, None), (None, whole, None), (9006, whole, None), (9006, whole, None)]
    extra = spark.createDataFrame([(*r, 1, "y") for r in odd], "doc_id long, text string, lang string, score int, lettered string")
    found = defaultdict(list)
    for r in language_id.language_id(docs.unionByName(extra)).collect():
        found[r["row"]["doc_id"]].append((r["lang_pred"], r["score"]))
    assert [found[i][0] for i in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert found[9004][0][0] in {"en", "fr", "de", "es"}
    assert {found[i][0][0] for i in (9005, None, 9006)} == {"en"} and len(found[9006]) == 2 and found[9006][0] == found[9006][1]
    kept = language_id.drop_unknown(docs.unionByName(extra))
    assert kept.columns == docs.columns and kept.filter("doc_id in (9001, 9002, 9003)").count() == 0 and kept.count() == docs.count() + 5
    nothing = language_id.language_id(extra.filter("lang is null"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).count() == 0


def test_prediction_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = [b"the old man and the sea ", b"der alte mann und das meer ", b"", b"le vieil homme et la mer " * 40]
    model = language_id.Discriminator(rng.random((40, 1 << language_id.BITS)), ["en", "de", "fr", "es"] * 10)
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    together = model.margins(data, bounds)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], model.margins(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


# --- HTML ------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>no &amp; no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1><p>Welcome to the site where we write about many things. Yes, very many.</p></header>
<div class="cookie-notice"><p>We use cookies to make this site work better for you. Accept all of them, please.</p></div><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="layout sidebar-left"><main><article><header><h1>Title &mdash; here</h1></header><p>First &amp; paragraph   with
text and <a href=x>one link</a>. It goes on for a while.<p>Second<br>line &#8364;5, and more words. <ul><li>One item<li>Two items</ul><div class="ad">Buy this now. It is great. Really great.</div><p>Last words. The end.</p>
<section class="comments"><h3>Comments</h3><article><p>I really liked this article a lot, thanks very much for writing it. More please.</p></article></section></article></main>
<aside><p>Related story about something else that is long enough to look like content. Yes.</p></aside></div><form><p>Subscribe to our list. Enter your mail address here, please.</p><input></form><script>var x="<p>no</p>";</script><footer>&copy; us</footer></body></html>"""
TEXT = "Title — here\nFirst & paragraph with text and one link. It goes on for a while.\nSecond line €5, and more words.\nOne item\nTwo items\nLast words. The end."


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT
    assert html_text.main_text("<p>unclosed <b>bold text that goes on. And on, and on, until it ends. <p>And another one, also long enough to be kept.") == (
        "unclosed bold text that goes on. And on, and on, until it ends.\nAnd another one, also long enough to be kept.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script><!-- y -->") == html_text.main_text("<nav>a b c d</nav>") == ""


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 8)
        s, t = ([rng.choice([0, rng.random() * 3]) for _ in range(n)] for _ in range(2))
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 1.5) for _ in range(rng.randint(0, 14))]

        def cost(k):
            return sum(t[i] if k[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if k[a] != k[b])

        best = min(cost(k) for k in itertools.product([True, False], repeat=n))
        assert math.isclose(cost(html_text.minimum_cut(s, t, edges)), best, abs_tol=1e-9)


def test_html_rows(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<article>" + "<p>Some words of a long page. " * 3000)]
    frame = spark.createDataFrame([(*p, "x", 5) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.html_text(frame).collect()), key=str)
    long = "\n".join(["Some words of a long page."] * 3000)
    assert got == [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "v", "", 0), (3, "v", "", 0), (4, "w", long, len(long))]
    assert html_text.html_text(frame.limit(0)).count() == 0


def test_html_whole_table(spark):
    import html as H

    for p, r in zip(sorted(rows_of(spark, "pages"), key=lambda p: p["page_id"]), sorted(QUERIES["op5_html_text"](spark, SF).collect(), key=lambda r: r["page_id"])):
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*(>|$)", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        want = "\n".join(b for b in blocks if b)
        assert (r["page_id"], r["url"], r["text"], r["n_chars"]) == (p["page_id"], p["url"], want, len(want))


# --- PII -------------------------------------------------------------------------------------------------------------
def luhn(digits):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_surrogates(spark):
    texts = {
        1: "Contact Mr. John Smith or Mrs Smith at John.Smith@Mail.example.org, +1 (017) 555-7713 or +1-017-555-7713.", 2: "john.smith@mail.example.org and SMITH; card 4539 1488 0343 6467, not 4539 1488 0343 6468",
        3: None, 4: "", 5: "Мария Иванова, господин Петров; Μαρία Παππά. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", 6: "ip 10.0.0.1, not 300.1.1.1, nor 1.2.3; 123-45-6789; 4929348385146306 1219538112535716",
        7: "nothing of the kind: 2024-01-01, 12345678901234, v4.0, a @ b, Thea Re." * 3000, 8: "Herr Klaus Weber, Frau Petra Weber",
    }
    rows = [(d, t, "x", 1) for d, t in texts.items()] + [(2, texts[2], "y", 2), (None, "mail me: a@b.org", "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, matches string, at int")
    got = [(r["row"]["doc_id"], r["n_entities"], r["kinds"], r["text"]) for r in pii.replace_entities(frame).collect()]
    by = {d: (n, k, t) for d, n, k, t in got}
    assert len(got) == len(rows) and [x for x in got if x[0] == 2][0] == [x for x in got if x[0] == 2][1]
    assert by[3] == (0, [], None) and by[4] == (0, [], "") and by[7] == (0, [], texts[7])
    assert by[1][1] == ["email", "person", "phone"] and by[6][1] == ["card", "ip", "ssn"] and by[5][1] == ["person", "secret"]
    for d in (1, 2, 5, 6, 8):
        for secret in ("john.smith@", "Smith ", "017) 555", "6467", "Иванова", "Παππά", "04dbeb", "10.0.0.1", "123-45-6789", "4929348385146306", "Weber"):
            assert secret.lower() not in by[d][2].lower()
    mail = re.search(r"[\w.]+@[\w.]+", by[1][2])[0].rstrip(".")
    assert mail in by[2][2] and re.fullmatch(r"[a-z]{4}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.org", mail)
    first = re.fullmatch(r"Contact Mr\. (\w+) (\w+) or Mrs (\w+) at \S+, \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4})\.", by[1][2])
    assert first[1] in pii.GIVEN["m", "latin"].split() and first[2] == first[3] and first.groups()[3:6] == first.groups()[6:9]
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), not 4539 1488 0343 6468", by[2][2])[1]
    assert card[0] == "4" and luhn(card.replace(" ", ""))
    assert "300.1.1.1" in by[6][2] and "1219538112535716" in by[6][2]
    assert re.match(r"\w+ \w+, господин \w+; \w+ \w+\. token = \"[0-9a-f]{40}\"$", by[5][2]) and by[5][2].split()[0] in pii.GIVEN["f", "cyrillic"].split()
    assert re.fullmatch(r"Herr (\w+) (\w+), Frau (\w+) \2", by[8][2])
    other = {r["row"]["doc_id"]: r["text"] for r in pii.replace_entities(frame, key="another").collect()}
    assert other[1] != by[1][2] and other[7] == texts[7]
    assert pii.replace_entities(frame.limit(0)).count() == 0


def test_surrogates_stay_distinct_where_few_are_to_be_had(spark):
    names = [f"{a}{b}@x.org" for a in "abcdefghijkl" for b in "abcdefghijkl"]
    entities = spark.createDataFrame([("mailbox", n) for n in names] + [("given_f_greek", f"όνομα{i}") for i in range(40)], "kind string, canonical string")
    table = pii.surrogate_table(entities).collect()
    assert len(table) == len(names) + 40
    for kind in ("mailbox", "given_f_greek"):
        drawn = [r["surrogate"].lower() for r in table if r["kind"] == kind]
        assert len(set(drawn)) == len(drawn) and not set(drawn) & {r["canonical"] for r in table}


# --- URL filter ------------------------------------------------------------------------------------------------------
URLS = [
    ("http://A.Example.COM/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://sub.www.example.com/en/", "sub.www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://x.net/es/1://", "x.net", "/es/1://", "net/es/", "block"), ("http://x.net/es", "x.net", "/es", None, None), ("http://com", "com", "", None, None), ("http://xcom/", "xcom", "/", None, None),
    ("http://É.com/", "É.com", "/", "com/", "allow"), (None, "", "", None, None), ("", "", "", None, None), ("no scheme.com/en/", "", "", None, None), ("http://?x", "", "", None, None), ("http://a.org/" + "p" * 3000, "a.org", "/" + "p" * 3000, None, None),
]


def plain_ratio(labelled, text, order=url_filter.ORDER):
    """The mean log ratio in units, straight from the definition."""
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    for chars, verdict in labelled:
        for i in range(order, len(chars)):
            for k in range(order + 1):
                counts[verdict][chars[i - k : i]][chars[i]] += 1
    total = 0
    for i in range(order, len(text)):
        logs = {}
        for v, seen in counts.items():
            p = 1 / 256
            for k in range(order + 1):
                c = seen.get(text[i - k : i])
                if c:
                    p = (c[text[i]] + len(c) * p) / (sum(c.values()) + len(c))
            logs[v] = math.log(p)
        total += round((logs["allow"] - logs["block"]) * url_filter.UNIT)
    return total / (len(text) - order) / url_filter.UNIT


def test_url_rules_and_scores(spark):
    pages = [(i, u[0], "x", 1.0) for i, u in enumerate(URLS)] + [(r["page_id"] + 1000, r["url"], "y", 2.0) for r in rows_of(spark, "pages")] + [(0, URLS[0][0], "x", 1.0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, rule string, score double")
    got = url_filter.url_filter(frame).collect()
    assert len(got) == len(pages)
    for r in got:
        if r["page_id"] < 1000:
            _, host, path, rule, verdict = URLS[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])
        assert (r["rule"] is None) == (r["score"] is not None) and r["verdict"] in ("allow", "block")

    def chars(host, path):
        return "\1" * url_filter.ORDER + re.sub("[0-9]", "0", host + path) + "\2"

    urls = {(r["host"], r["path"]): r["verdict"] for r in got if r["rule"]}
    fold = {u: int(hashlib.md5("".join(u).encode()).hexdigest()[:8], 16) % url_filter.FOLDS for u in urls}
    taught = [(chars(*u), v) for u, v in urls.items() if fold[u]]
    held = [(math.floor(plain_ratio(taught, chars(*u)) * url_filter.GRAIN), v) for u, v in urls.items() if not fold[u]]
    good = {b: sum(v == "block" and x < b for x, v in held) / sum(v == "block" for _, v in held) + sum(v == "allow" and x >= b for x, v in held) / sum(v == "allow" for _, v in held) for b, _ in held}
    cut = min(b for b in good if math.isclose(good[b], max(good.values()))) / url_filter.GRAIN
    for r in got:
        if not r["rule"]:
            want = plain_ratio(taught, chars(r["host"], r["path"]))
            assert math.isclose(r["score"], want, abs_tol=1e-8) and r["verdict"] == ("allow" if want >= cut else "block")


def test_url_filter_without_examples(spark):
    frame = spark.createDataFrame([(1, "http://a.org/x"), (2, None), (3, "http://b.com/")], "page_id long, url string")
    assert {(r["page_id"], r["verdict"], r["score"]) for r in url_filter.url_filter(frame).collect()} == {(1, "allow", None), (2, "allow", None), (3, "allow", None)}
    assert url_filter.url_filter(frame.limit(0)).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------
def test_sharding(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 400)) for i in range(300)] + [(7, "r" * 90)] * 60 + [(8, "b" * 5000), (8, "s"), (None, "n" * 30), (None, None), (900, None), (901, "é" * 700)]
    frame = spark.createDataFrame([(d, t, i, "z") for i, (d, t) in enumerate(rows)], "doc_id long, text string, at int, h string")
    limit = 1000
    got = sharding.shard_assignment(frame, limit, ["at", "doc_id"]).collect()
    assert sorted(r["row"]["at"] for r in got) == list(range(len(rows)))
    held = Counter()
    for r in got:
        d, t = rows[r["row"]["at"]]
        assert r["n_bytes"] == len((t or "").encode()) and r["depth"] == len(r["shard"])
        assert f"{int(hashlib.md5(('' if d is None else str(d)).encode()).hexdigest()[:15], 16):060b}".startswith(r["shard"])
        held[r["shard"], r["page"]] += r["n_bytes"]
    prefixes = {r["shard"] for r in got}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    for r in got:
        assert r["shard_bytes"] == held[r["shard"], r["page"]] and r["oversize"] == (r["shard_bytes"] > limit)
        if r["oversize"]:
            assert sum((x["shard"], x["page"]) == (r["shard"], r["page"]) for x in got) == 1
    parents = Counter()
    for r in got:
        if r["depth"]:
            parents[r["shard"][:-1]] += r["n_bytes"]
            parents[r["shard"][:-1] + "10"[int(r["shard"][-1])]] += 0
    hashes = [(f"{int(hashlib.md5(('' if d is None else str(d)).encode()).hexdigest()[:15], 16):060b}", len((t or "").encode())) for d, t in rows]
    assert all(sum(n for h, n in hashes if h.startswith(s[:-1])) > limit for s in prefixes if s)
    sharding.write_shards(frame, str(tmp_path / "shards"), limit)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows) and set(frame.columns) < set(back.columns) and back.select("shard_name").distinct().count() == len(held)
    assert sharding.shard_assignment(frame.limit(0), limit).count() == 0
    assert {r["shard"] for r in sharding.shard_assignment(frame.limit(3), 10**6).collect()} == {""}


# --- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline(spark, tokenizer):
    import corpus_pipeline

    docs = rows_of(spark, "documents")
    kept = {r["doc_id"]: r["text"] for r in docs if any(map(str.isalpha, r["text"] or ""))}
    best = {}
    for d, t in kept.items():
        best[t.translate(brute.ASCII_LOWER)] = max(d, best.get(t.translate(brute.ASCII_LOWER), d))
    kept = {d: kept[d] for d in best.values()}
    roots, _ = brute.near_components(kept)
    kept = {d: t for d, t in kept.items() if roots[d] == d}
    leaks = {d for d, _ in brute.leaks(kept, {r["item_id"]: r["text"] for r in rows_of(spark, "benchmark")})}
    kept = {d: t for d, t in kept.items() if d not in leaks}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in kept.items()}
    columns = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, columns.limit(0), SF).columns == columns.columns, name
