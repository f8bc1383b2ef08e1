"""Ids that were merged into others: chains are followed to the id that is alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Ids that an error message names at most.
NAMED = 20
#: Bytes of a looked-up table that are broadcast at most; larger ones are merged, so that the driver is sent no share of the input.
SENT = 1 << 20


class RedirectCycle(ValueError):
    """Ids that redirect to each other in a circle, so that none of them is alive."""

    def __init__(self, ids: list, more: bool):
        self.ids = ids
        super().__init__(f"redirects go in a circle: {', '.join(map(str, ids))}{' and more' if more else ''}")


def live_ids(redirects: DataFrame) -> DataFrame:
    """(old_id, live_id, hops) of (old_id, new_id): where each chain of redirects ends, by pointer jumping.

    In every round each id that does not point to a live one takes over the pointer of the id that it points to, so that pointers
    double their reach, and a chain of n redirects needs log2(n) rounds. Rounds are written tables, joined by merging beyond ``SENT`` bytes. An id that
    everything was merged into is one row on the side that is looked up; the other side's large partitions are split by Spark.

    Rows with a null are no redirects, repeated ones count once, and of several targets of one id the smallest counts. RedirectCycle
    if a chain never ends."""
    table = redirects.where("old_id is not null and new_id is not null").groupBy("old_id").agg(F.min("new_id").alias("live_id")).withColumns({"hops": F.lit(1).cast("long"), "open": F.lit(True)})
    table, rounds, n = shared.save(table, "redirects"), 0, 0
    while True:
        n = n or table.count()
        ahead = table.select(F.col("old_id").alias("__at"), F.col("live_id").alias("__to"), F.col("hops").alias("__hops"))
        moving = table.where("open").join(_looked_up(ahead, n), F.col("live_id") == F.col("__at"), "left")
        moved = moving.select("old_id", F.coalesce("__to", "live_id").alias("live_id"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.col("__at").isNotNull().alias("open"))
        table = shared.save(moved.unionByName(table.where("not open")), "redirects")
        if table.where("open").isEmpty():
            return table.drop("open")
        rounds += 1
        if 1 << rounds - 1 >= n:  # a pointer that still moves had passed as many redirects as there are: it is on a circle
            found = [r[0] for r in table.where("open").select("live_id").distinct().orderBy("live_id").limit(NAMED + 1).collect()]
            raise RedirectCycle(found[:NAMED], len(found) > NAMED)


def _looked_up(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows * 64 <= SENT else table.hint("merge")


def redirected(rows: DataFrame, redirects: DataFrame, column: str = "artist_id", hops: str | None = None) -> DataFrame:
    """``rows`` with every id that was merged into another one, at whatever remove, replaced by the one that is alive; ``hops`` names
    a column for the number of redirects that were followed."""
    moved = live_ids(redirects).select(F.col("old_id").alias("__old"), F.col("live_id").alias("__new"), F.col("hops").alias("__hops"))
    joined = rows.join(_looked_up(moved, moved.count()), rows[column] == F.col("__old"), "left")
    out = joined.withColumn(column, F.coalesce("__new", F.col(column)))
    return (out.withColumn(hops, F.coalesce("__hops", F.lit(0).cast("long"))) if hops else out).drop("__old", "__new", "__hops")
