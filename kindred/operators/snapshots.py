"""Snapshots that were appended to: of several lines for one key the newest counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: When a line was taken, if its table says so.
FETCHED = "fetched_at"


def newest_lines(rows: DataFrame, key: str, failed: str | None = None) -> DataFrame:
    """One line for each ``key``, of all columns but FETCHED: the last one taken. Of those taken at the same time, or at times
    unknown, one that did not fail (null in the column ``failed``) goes first, and then an order of their contents decides, so
    that the choice does not depend on that of the files. Lines are combined before the shuffle; null keys count as one key."""
    columns = [c for c in rows.columns if c != FETCHED]
    if FETCHED not in rows.columns:
        rows = rows.withColumn(FETCHED, F.lit(None).cast("timestamp"))
    good = F.col(failed).isNull() if failed else F.lit(True)
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    order = F.struct(F.col(FETCHED), good, F.length(content), F.sha2(content, 256))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), order).alias("__line")).select("__line.*")
