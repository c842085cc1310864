import datetime as dt

from pyspark.sql import functions as F

from cairnwork.functions.text import instant_us, normal_form


def test_normal_form(spark):
    given = ["  Ab\t", "ÉTÉ", "été", "　x ", "", " \t\n", None, "straße", "​z"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").orderBy("i").select(normal_form(F.col("x"))).collect()]
    assert got == ["ab", "été", "été", "x", None, None, None, "straße", "​z"]


def test_instants_in_many_forms(spark):
    us = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    noon = us(2024, 3, 1, 12, 0, 0)
    cases = {
        "2024-03-01T12:00:00Z": noon, "2024-03-01 12:00:00": noon, "2024/03/01 12:00:00.250": noon + 250_000, "2024-03-01T14:00:00+02:00": noon, "2024-03-01T07:00:00-0500": noon,
        "2024-03-01T17:30:00.5+0530": noon + 500_000, "1709294400": noon, "1709294400123": noon + 123_000, "Fri, 01 Mar 2024 12:00:00 GMT": noon, "2024-03-01": noon - 43_200_000_000, " 2024-03-01T12:00:00z ": noon,
        "20240301T120000Z": noon, "1 Mar 2024 12:00:00 +0100": noon - 3_600_000_000, "1709294400123456": noon + 123_456,
        "soon": None, "n/a": None, "": None, None: None, "2024-02-30": None, "2024-13-01T00:00:00Z": None, "Fri, 31 Xyz 2024 12:00:00 GMT": None, "17": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i").select("t", instant_us(F.col("t")).alias("us"))
    assert {r["t"]: r["us"] for r in df.collect()} == cases


def test_instants_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert spark.range(1).select(instant_us(F.lit("2024-03-01 12:00:00"))).first()[0] == 1709294400000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
