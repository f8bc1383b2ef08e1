"""Field ledger, output contracts and load checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOWED = ("CC0",)
#: Columns that must never be in serving output: they belong to single listeners.
PRIVATE = ("user_id", "user_identifier", "user_name", "listeners", "listen_timestamp", "recording_mbid")


def serving_fields(ledger: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Fields that may be served: used in full and under an allowed licence."""
    return ledger.where((F.col("use_in_mvp") == "yes") & F.col("license_class").isin(*allowed)).select("source", "field")


def refused_fields(fields: DataFrame, ledger: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Of (source, field), those that are not to be served."""
    return fields.join(serving_fields(ledger, allowed), ["source", "field"], "left_anti")


def private_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.lower() in PRIVATE]


def load_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count, and the share of nulls of each column: one row each."""
    stats = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return stats.unpivot(["n"], columns, "column", "present").select("column", F.col("n").alias("rows"), F.when(F.col("n") > 0, 1 - F.col("present") / F.col("n")).otherwise(0.0).alias("null_rate"))


def gate(quality: DataFrame, max_null_rate: dict[str, float], min_rows: int = 1) -> DataFrame:
    """The offending rows of ``load_quality``; empty if the load may go on."""
    limits = F.create_map(*[F.lit(x) for kv in max_null_rate.items() for x in kv]) if max_null_rate else F.lit(None).cast("map<string,double>")
    return quality.where((F.col("rows") < min_rows) | (F.col("null_rate") > F.coalesce(F.try_element_at(limits, F.col("column")), F.lit(1.0))))
