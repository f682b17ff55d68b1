"""Joins of the URL filter, whose sides grow with the URLs."""

from wayloom.llm import url_filter as U


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_is_collected_on_the_driver(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.{'net/es' if i % 3 else 'com/x'}/{'ab' * (i % 5)}{i}") for i in range(200)] + [(900, "https://other.org/ab"), (901, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    out = U.url_filter(pages)
    assert "Broadcast" not in plan(out) and out.count() == len(rows)
    urls = pages.dropna().select(U.host_of(pages.url).alias("host"), U.path_of(pages.url).alias("path"))
    urls = urls.withColumn("verdict", U.rule_for(urls.host, urls.path)["verdict"]).withColumn("chars", U.characters(urls.host, urls.path, U.ORDER))
    models = U.language_models(urls.filter("verdict is not null"), U._grams(urls, U.ORDER))
    for df in (models, U.scored(urls, models)):
        assert "Broadcast" not in plan(df)
