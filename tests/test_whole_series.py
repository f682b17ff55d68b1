"""The forecast of the whole series starts from its newest real value."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_forecast_of_the_whole_series_differs_from_the_gapped(spark):
    def rows(name):
        return {(r["data_source"], r["step"]): r["forecast"] for r in entry.queries()[name](spark, SF).collect()}

    whole, gapped = rows("seasonal_forecast_whole_series"), rows("seasonal_forecast")
    assert whole.keys() == gapped.keys() and whole != gapped
    assert "CASE WHEN NOT (hour" not in entry.oracle_sql()["seasonal_forecast_whole_series"]
