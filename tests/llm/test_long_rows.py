"""Single rows of some MB: no crash, and time in proportion."""

import time

import pytest

from wayloom.llm import pii, url_filter


@pytest.mark.parametrize("text", [
    "x@" + "a." * 500_000 + "com", "x@" + "a" * 1_000_000, "a." * 500_000 + "@b.com", "1.2." * 250_000, "4111 1111 " * 100_000, "+49 30 " * 150_000, "Mr " * 300_000, "Anna-" * 200_000,
    "token=" + "A" * 1_000_000, "password: " * 100_000, "123-45-" * 150_000,
], ids=range(11))
def test_long_texts_of_every_kind(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "write to ann@example.com")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_entities(docs).select("row.doc_id", "n_entities", "text").collect()}
    assert got[2]["n_entities"] == 1 and "ann@example.com" not in got[2]["text"]
    assert len(got[1]["text"]) > 100_000


def test_hosts_of_many_labels(spark):
    docs = spark.createDataFrame([(1, "a@" + "b." * 100 + "org"), (2, "a@b..org"), (3, "a@b.c.d.org.")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_entities"] for r in pii.replace_entities(docs).select("row.doc_id", "n_entities").collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_long_urls_take_time_in_proportion(spark):
    def took(n):
        pages = spark.createDataFrame([(1, "http://a.com/" + "ü\U0001f600" * (n // 2)), (2, "http://www.example.com/en/x"), (3, "http://b.net/es/y")], "page_id long, url string")
        began = time.perf_counter()
        got = {r["page_id"]: r for r in url_filter.url_filter(pages).collect()}
        assert len(got) == 3 and got[3]["verdict"] == "block"
        return time.perf_counter() - began

    took(1000)
    assert took(160_000) < 8 * max(took(40_000), 1.0)
