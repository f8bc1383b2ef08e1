"""The numbered queries against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from kindred.llm import queries, urlfilter
from pyspark.sql import functions as F

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = queries.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = con.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(df.select(*columns).collect()) == order(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_a_url_of_very_many_rows(spark):
    """Rows of one page and url are judged once and all come back; so do those of a null."""
    pages = spark.range(0, 1_000_000, 1, 8).select(F.lit(7).alias("page_id"), F.when(F.col("id") % 4 > 0, F.lit("http://a.example.com/en/x")).alias("url"), F.col("id").alias("rule"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict): r["count"] for r in urlfilter.filter_urls(pages, urlfilter.rules_table(spark)).groupBy("page_id", "host", "path", "rule", "verdict").count().collect()}
    assert got == {(7, "a.example.com", "/en/x", "example.com/en/", "block"): 750_000, (7, "", "", None, "allow"): 250_000}
    no_rules = spark.createDataFrame([], "rule string, verdict string")
    assert urlfilter.filter_urls(pages, no_rules).where("verdict = 'allow' and rule is null").count() == 1_000_000
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.rules_table(spark)).count() == 0
