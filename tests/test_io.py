"""File sources and sinks on tiny files in a temp folder."""

import os

import pytest
from pyspark.sql import functions as F

from tillcast.sources import files
from tillcast.plans import models


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_csv_with_schema_and_nulls(spark, tmp_path):
    p = tmp_path / "store.csv"
    _write(p, 'Store,StoreType,Assortment,CompetitionDistance,CompetitionOpenSinceMonth,CompetitionOpenSinceYear,'
              'Promo2,Promo2SinceWeek,Promo2SinceYear,PromoInterval\n'
              '41,"d","b",315,2,1999,0,,,\n42,"b","c",90,,,1,7,2003,"Feb,May,Aug,Nov"\n')
    df = files.read_csv(spark, str(p), files.STORE_SCHEMA)
    rows = df.orderBy("Store").collect()
    assert rows[0]["Promo2SinceWeek"] is None and rows[1]["PromoInterval"] == "Feb,May,Aug,Nov"
    assert dict(df.dtypes)["CompetitionDistance"] == "double"


def test_train_codes_stay_strings(spark, tmp_path):
    p = tmp_path / "train.csv"
    _write(p, 'Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday\n'
              '41,2,2001-03-06,777,31,1,0,"0","1"\n41,1,2001-03-05,0,0,0,0,a,0\n')
    df = files.read_csv(spark, str(p), files.TRAIN_SCHEMA)
    assert sorted(r[0] for r in df.select("StateHoliday").collect()) == ["0", "a"]


def test_semicolon_and_bom(spark, tmp_path):
    p = tmp_path / "ALL.csv"
    _write(p, "﻿Date;Goog_trend\n2001-02-03;11\n2001-02-04;12\n")
    df = files.read_csv(spark, str(p), files.TREND_SCHEMA, sep=";")
    assert df.count() == 2 and df.agg(F.sum("Goog_trend")).first()[0] == 23


def test_keyed_files_from_names(spark, tmp_path):
    d = tmp_path / "trends"
    d.mkdir()
    _write(d / "AA.csv", "Date;Goog_trend\n2001-02-03;33\n")
    _write(d / "BB.csv", "Date;Goog_trend\n2001-02-03;44\n")
    df = files.read_keyed_files(spark, str(d / "*.csv"), files.TREND_SCHEMA, restore={"BB": "CC,BB"})
    assert {r["State"]: r["Goog_trend"] for r in df.collect()} == {"AA": 33, "CC,BB": 44}


def test_keyed_files_with_a_state_column(spark, tmp_path):
    d = tmp_path / "trends"
    d.mkdir()
    _write(d / "AA.csv", '"Date";"State";"Goog_trend"\n2001-02-03;"AA";33\n2001-02-04;"AA";34\n')
    _write(d / "NI.csv", '"Date";"State";"Goog_trend"\n2001-02-03;"HB,NI";44\n')
    df = files.read_keyed_files(spark, str(d / "*.csv"), files.STATE_TREND_SCHEMA)
    got = sorted((r["State"], str(r["Date"]), r["Goog_trend"]) for r in df.collect())
    assert got == [("AA", "2001-02-03", 33), ("AA", "2001-02-04", 34), ("HB,NI", "2001-02-03", 44)]


def test_a_layout_that_differs_fails_loudly(spark, tmp_path):
    p = tmp_path / "AA.csv"
    _write(p, '"Date";"State";"Goog_trend"\n2001-02-03;"AA";33\n')
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_csv(spark, str(p), files.TREND_SCHEMA, sep=";").collect()
    q = tmp_path / "BB.csv"
    _write(q, "Date;Goog_trend\n2001-02-03;33\n2001-02-04;many\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_csv(spark, str(q), files.TREND_SCHEMA, sep=";").collect()


def test_weekly_report(spark, tmp_path):
    p = tmp_path / "report.csv"
    _write(p, "Category: All\n\nInterest over time\nWeek,some term\n"
              "2001-02-04 - 2001-02-10,21\n2001-02-11 - 2001-02-17,22\n\nTop regions\nAA,100\n")
    df = files.read_weekly_report(spark, str(p)).orderBy("week_start").collect()
    assert [(str(r[0]), str(r[1]), r[2]) for r in df] == [("2001-02-04", "2001-02-10", 21),
                                                         ("2001-02-11", "2001-02-17", 22)]


def test_wide_indicators_with_footer(spark, tmp_path):
    p = tmp_path / "wdi.csv"
    _write(p, '﻿Country Name,Country Code,Series Name,Series Code,1991 [YR1991],1992 [YR1992]\n'
              'Freedonia,FRE,"Ducks, total",D.K.TOT,1234567,..\n\n\n'
              'Data from database: Invented Indicators,,,,,\nLast Updated: 02/03/2001,,,,,\n')
    df = files.read_wide_indicators(spark, str(p))
    got = {r["year"]: r["value"] for r in df.collect()}
    assert got == {1991: 1234567.0, 1992: None}


def test_release_timestamps(spark, tmp_path):
    p = tmp_path / "conf.csv"
    _write(p, "DateTime,Actual,Consensus,Previous,Revised\n04/18/2001 09:30:00,5.5,5.4,5.1,5.2\n"
              "03/14/2001 09:30:00,5.1,5.0,4.9,\n")
    df = files.read_releases(spark, str(p)).orderBy("Released").collect()
    assert str(df[0]["Released"]).startswith("2001-03-14 09:30") and df[0]["Revised"] is None


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 10.0, "test"), (1, 0.0, "train"), (3, 5.5, "train")],
                               "Id int, Sales double, type string")
    files.write_submission(df, str(tmp_path / "sub"), single_file=True)
    back = files.read_csv(spark, str(tmp_path / "sub"), "Id INT, Sales DOUBLE")
    assert back.count() == 3 and len(os.listdir(tmp_path / "sub")) >= 1
    files.write_by_tag(df, str(tmp_path / "by_type"), "type")
    assert {"type=test", "type=train"} <= set(os.listdir(tmp_path / "by_type"))
    files.write_csv(df.drop("type"), str(tmp_path / "plain"))
    assert files.read_csv(spark, str(tmp_path / "plain"), "Id INT, Sales DOUBLE").count() == 3


def test_index_column_and_feature_list(spark, tmp_path):
    p = tmp_path / "varimp.csv"
    _write(p, '"variable","relative_importance","scaled_importance","percentage"\n'
              '"Sales_day_avg",1.0,1.0,0.6\n"Store",0.5,0.5,0.3\n"Promo",0.2,0.2,0.1\n')
    assert files.read_feature_list(spark, str(p)) == ["Sales_day_avg", "Store", "Promo"]
    assert files.read_feature_list(spark, str(p), limit=2) == ["Sales_day_avg", "Store"]
    df = spark.createDataFrame([(0, 1)], "`Unnamed: 0` int, x int")
    assert files.drop_index_columns(df).columns == ["x"]


def test_model_save_load(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 3), float(i) * 0.1) for i in range(60)],
                               "a double, b double, logSales double")
    m = models.forest(["a", "b"], trees=3, depth=3).fit(df)
    files.save_model(m, str(tmp_path / "m"))
    back = files.load_model(str(tmp_path / "m"))
    a = [r[0] for r in m.transform(df).select("prediction").collect()]
    b = [r[0] for r in back.transform(df).select("prediction").collect()]
    assert a == b
