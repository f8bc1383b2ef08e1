"""The coverage validation from snapshots to reports, and its command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import coverage, resolve
from ..sources import readers, writers


def coverage_rows(artists: DataFrame, searches: DataFrame, stats: DataFrame, triples: DataFrame) -> DataFrame:
    """Resolved artists with statistics and knowledge-base counts."""
    resolved = resolve.resolve(artists, searches)
    enriched = coverage.with_stats(resolved, stats)
    kb = coverage.knowledge_base(resolved.select(F.col("resolved_mbid").alias("mbid")), triples)
    return coverage.with_knowledge(enriched, kb)


def run_validation(spark: SparkSession, artists: str, searches: str, stats: str, triples: str, reports: str, expected_rows: int | None = config.VALIDATION_ROWS) -> tuple[DataFrame, Row]:
    """Reads the list and the snapshots, writes the rows (CSV) and the summary (JSON, Markdown) under ``reports``."""
    rows = coverage_rows(readers.validation_list(spark, artists, expected_rows), readers.searches(spark, searches), readers.listener_stats(spark, stats), readers.triples(spark, triples)).cache()
    summary = coverage.summary(rows).first()
    writers.write_csv(rows, f"{reports}/artist_coverage.csv")
    writers.write_json(summary, f"{reports}/coverage_summary.json", spark)
    writers.write_markdown(summary, f"{reports}/coverage_summary.md", spark)
    return rows, summary


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Validate artist-data coverage from snapshots")
    for name in ("artists", "searches", "stats", "triples"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--report-dir", default="reports")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("coverage-validation").getOrCreate()
    _, summary = run_validation(spark, given.artists, given.searches, given.stats, given.triples, given.report_dir)
    print(json.dumps(summary.asDict(True), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
