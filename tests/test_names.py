import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.functions import text
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column).first()[0]


def test_full_width_and_case(spark):
    rows = spark.createDataFrame([("ＢＯØＷＹ",), ("boøwy",), ("BOØWY!!",), ("サカナクション。",), ("!?",), (None,)], "n string")
    got = [r[0] for r in rows.select(text.normalize_name("n")).collect()]
    assert got == ["boøwy", "boøwy", "boøwy", "サカナクション", "", None]


@settings(max_examples=200)
@given(st.text())
def test_normal_is_stable(value):
    once = text.normal(value)
    assert not any(c.isspace() for c in once)
    assert text.normal(once) == text.normal(text.normal(once))


@pytest.mark.parametrize(("value", "expected"), [(" YES\t", True), ("1", True), ("true", True), ("False", False), ("0", False), ("no", False), ("", None), ("　 ", None), (None, None), ("yeſ", True)])
def test_optional_bool(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(text.parse_optional_bool(F.col("v"))).first()[0] is expected


def test_optional_bool_rejects(spark):
    with pytest.raises(Exception, match="Unsupported boolean value"):
        spark.createDataFrame([("maybe",)], "v string").select(text.parse_optional_bool(F.col("v"))).collect()


@pytest.mark.parametrize(("value", "expected"), [("95", 95), ("９５", 95), ("1_000", 1000), (" -3 ", -3), ("95.5", 0), ("", 0), (None, 0), ("x", 0), ("1__0", 0), ("٤٢", 42), ("१२३", 123), ("9" * 30, (1 << 63) - 1), ("-" + "9" * 60, -(1 << 63)), ("12\n3", 0)])
def test_safe_int(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(text.safe_int(F.col("v"))).first()[0] == expected


def test_hint_tokens(spark):
    assert one(spark, text.hint_tokens(F.col("h")), h="Japanese バンド of 東京 ab") == ["Japanese", "バンド", "東京"]


def test_columns_give_what_python_gives(spark):
    """ASCII by built-in functions, the rest in Python: one result."""
    values = ["MONO!", "a_b c", "Straße", "ＢＯØＷＹ", "", None, "x\ny", "İstanbul", "Kelvin K", "tab\tbed", "9 Lives_"]
    pairs = [(a, b) for a in values for b in values]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", text.normalize_name("a").alias("n"), text.casefold("a").alias("c"), text.normalize_names(F.array("a", "b")).alias("both"), text.hint_match(F.col("a"), F.col("b")).alias("h")
    )
    for r in rows.collect():
        assert r.n == (None if r.a is None else text.normal(r.a)) and r.c == (None if r.a is None else r.a.casefold())
        assert r.both == [text.normal(x) for x in (r.a, r.b) if x is not None] and r.h == text.hinted(r.a or "", r.b or "")


def test_weak_hint_matches():
    assert text.hinted("Japanese band", "British band")
    assert not text.hinted("Japanese band", "electronic duo")
    assert text.hinted("", "anything") and text.hinted("!!", "")


def test_last_part(spark):
    rows = spark.createDataFrame([("http://a/b/Q5",), ("",), (None,)], "u string")
    assert [r[0] for r in rows.select(text.last_part(F.col("u"))).collect()] == ["Q5", "", ""]
