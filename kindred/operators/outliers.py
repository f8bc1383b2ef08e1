"""Days on which a user listened beyond what is usual for that user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

S = config.Similarity()


def _day() -> Column:
    return F.to_date(F.col("ts").cast("timestamp"))


def plays_per_day(listens: DataFrame) -> DataFrame:
    """(user_id, day, plays): combined before the shuffle, whatever a user's history is."""
    return listens.groupBy("user_id", _day().alias("day")).agg(F.count("*").alias("plays"))


def _median(histogram: DataFrame, value: str, name: str) -> DataFrame:
    """(user_id, name) of (user_id, value, days): the smallest value that half of the days do not exceed. A user has as many rows as
    there are different values, not as there are listens."""
    order = Window.partitionBy("user_id").orderBy(value)
    counted = histogram.withColumn("__up_to", F.sum("days").over(order)).withColumn("__all", F.sum("days").over(Window.partitionBy("user_id")))
    return counted.where("2 * __up_to >= __all").groupBy("user_id").agg(F.min(value).alias(name), F.max("__all").alias("n_days"))


def usual(daily: DataFrame) -> DataFrame:
    """(user_id, n_days, median, deviation) of ``plays_per_day``: the median of plays a day, and the median deviation from it.

    Days are first counted by their value: such histograms add up, whichever part of a history they come from."""
    histogram = daily.groupBy("user_id", "plays").agg(F.count("*").alias("days"))
    median = _median(histogram, "plays", "median")
    of = median.withColumnRenamed("user_id", "__u")
    off = histogram.join(of, F.equal_null("user_id", "__u")).select("user_id", F.abs(F.col("plays") - F.col("median")).alias("off"), "days")
    deviation = _median(off.groupBy("user_id", "off").agg(F.sum("days").alias("days")), "off", "deviation").drop("n_days")
    return median.join(deviation.withColumnRenamed("user_id", "__u"), F.equal_null("user_id", "__u")).select("user_id", "n_days", "median", "deviation")


def outlier_days(daily: DataFrame, width: float = S.outlier_width, floor: float = S.outlier_floor, least_days: int = S.outlier_days) -> DataFrame:
    """(user_id, day, plays, limit) of days with more plays than median + width * deviation, a deviation under ``floor``
    counting as ``floor``. Users with under ``least_days`` days have no habit to depart from."""
    limits = usual(daily).where(F.col("n_days") >= least_days).select(F.col("user_id").alias("__u"), (F.col("median") + width * F.greatest("deviation", F.lit(floor))).alias("limit"))
    return daily.join(limits, F.equal_null("user_id", "__u")).where(F.col("plays") > F.col("limit")).select("user_id", "day", "plays", "limit")


def without_outliers(listens: DataFrame, width: float = S.outlier_width, floor: float = S.outlier_floor, least_days: int = S.outlier_days) -> DataFrame:
    """Listens (user_id, artist_id, ts) less those of outlier days, all of which leave: which of a day's listens are real is unknown.

    What is joined to the listens are the few days that leave, not the users."""
    gone = outlier_days(plays_per_day(listens), width, floor, least_days).select(F.col("user_id").alias("__u"), F.col("day").alias("__day"))
    return listens.join(gone, F.equal_null("user_id", "__u") & (_day() == F.col("__day")), "left_anti")
