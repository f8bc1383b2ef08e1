"""Quality rules with adaptive thresholds, in DataFrame functions only.

Three measures that every text has some of: punctuation among its characters, how far its words repeat (how much the
logarithm of the distinct words lags behind that of all), and the length of its words. Values fall into log-linear
buckets (64 per power of two, as in an HDR histogram): a group's sketch is its bucket counts, sketches merge by adding
counts, and a quantile read from one is exact up to 1/64 of its value, whatever the order of merging. No limit is fixed: the
quartiles of each language and source give its fence ``q3 + fence * (q3 - q1)`` (and the mirrored lower one for word
length), with a spread of at least one bucket, which is what a sketch can tell apart. A group of under ``least`` texts
uses its language's merged sketch, and a language of under ``least`` that of all texts. The limits are then joined
to the measures, null-safely, and a text outside a fence, or failing the base rule, is rejected.

Defined results: null, empty and word-less texts have zero measures, fail the base rule and are rejected; null languages
and sources are groups of their own; repeated rows are judged alike; a null doc_id is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
FENCE, LEAST = 4, 50
#: Whole-number value of each measure in 1 / 10,000 (1 / 1,000 for word length), and whether low values are fenced too.
VALUES = {
    "marks": ("if(word_chars > 0, 10000 * n_marks div word_chars, 0)", False),
    "sameness": ("if(n_words > 1, 10000 - cast(floor(10000 * ln(n_distinct) / ln(n_words) + 1e-6) as bigint), 0)", False),
    "word_length": ("if(n_words > 0, 1000 * word_chars div n_words, 0)", True),
}
#: ASCII punctuation.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WHITE = r"[\x20\x09-\x0D]"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, n_lines and the base measures of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    two = one.select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split("t", _WHITE + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", _WHITE + "+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", MARKS, ""))).cast("long").alias("n_marks"),
    )
    three = two.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "word_chars",
        "n_symbols",
        "n_marks",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    k = REPEAT_WINDOW
    four = three.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long")).withColumn(
        "windows", F.when(F.size("h") > k, F.expr(f"transform(sequence(1, size(h) - {k - 1}), i -> xxhash64(" + ", ".join(f"h[i + {j}]" for j in range(-1, k - 1)) + "))"))
    ).drop("h")
    # Only texts with a repeated window go on to sort their windows by hash and place.
    five = four.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.expr("array_sort(transform(windows, (x, i) -> struct(x as h, i as i)))"))).drop("windows")
    six = five.withColumn(
        "places",
        F.expr("array_sort(transform(filter(sorted, (x, i) -> (i > 0 and x.h = sorted[greatest(i - 1, 0)].h) or (i < size(sorted) - 1 and x.h = sorted[least(i + 1, size(sorted) - 1)].h)), x -> x.i))"),
    ).drop("sorted")
    covered = F.expr(f"aggregate(transform(places, (p, i) -> if(i = size(places) - 1, {k}, least({k}, places[least(i + 1, size(places) - 1)] - p))), 0L, (s, x) -> s + x)")
    seven = six.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return seven.withColumn("base_failed", failed)


def bucket(x: Column) -> Column:
    """Log-linear bucket of a long >= 0: values under 128 have their own, larger ones 64 per power of two."""
    shift = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return (shift * 64 + F.expr("shiftright(v, greatest(length(bin(v)) - 7, 0))")).cast("int")


#: Values in bucket b, and the largest of them.
WIDTH = "if(b < 128, 1L, shiftleft(1L, cast(b div 64 - 1 as int)))"
UPPER_EDGE = f"cast(if(b < 128, b, (b % 64 + 65) * {WIDTH} - 1) as long)"


def values() -> list[Column]:
    return [F.struct(F.lit(name).alias("measure"), F.expr(v).cast("long").alias("v")) for name, (v, _) in VALUES.items()]


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, b, n): the bucket counts of each language and source, over the texts with a word."""
    return (
        rows.where("n_words > 0").select("lang", "source", F.inline(F.array(*values()))).withColumn("b", bucket(F.col("v"))).groupBy("lang", "source", "measure", "b").agg(F.count("*").alias("n"))
    )


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches with the same ``keys`` added up."""
    return sketch.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per key and measure: the count, the first and third quartile as upper edges of their buckets, and the spread."""
    grouped = sketch.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("s"), F.sum("n").alias("total"))
    at = "aggregate(s, named_struct('c', 0L, 'b', -1), (a, x) -> if(a.c * 4 >= total * {q}, a, named_struct('c', a.c + x.n, 'b', x.b))).b"
    out = grouped.withColumn("b", F.expr(at.format(q=1))).withColumn("q1", F.expr(UPPER_EDGE))
    out = out.withColumn("b", F.expr(at.format(q=3))).withColumns({"q3": F.expr(UPPER_EDGE), "width": F.expr(WIDTH)})
    return out.select(*keys, "measure", "total", "q1", "q3", F.greatest(F.col("q3") - F.col("q1"), "width").alias("spread"))


def group_limits(rows: DataFrame, fence: int = FENCE, least: int = LEAST) -> DataFrame:
    """(lang, source, measure, total, low, high) of each language and source; total counts the texts of the sketch used."""
    fine = scratch.save(sketches(rows), "sketches")
    kept = F.struct("total", "q1", "q3", "spread")
    own = quartiles(fine, "lang", "source")
    lang = quartiles(merge(fine, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), kept.alias("by_lang"))
    every = quartiles(merge(fine)).select(F.col("measure").alias("a_measure"), kept.alias("by_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(F.broadcast(every), F.col("measure") == F.col("a_measure"))
    used = joined.select("lang", "source", "measure", F.when(F.col("total") >= least, kept).when(F.col("by_lang.total") >= least, F.col("by_lang")).otherwise(F.col("by_all")).alias("u"))
    return used.select("lang", "source", "measure", "u.total", (F.col("u.q1") - fence * F.col("u.spread")).alias("low"), (F.col("u.q3") + fence * F.col("u.spread")).alias("high"))


def thresholds(rows: DataFrame, fence: int = FENCE, least: int = LEAST) -> DataFrame:
    """One row per language and source: the limits of each measure."""
    one = lambda name, end: F.max(F.when(F.col("measure") == name, F.col(end))).alias(f"{name}_{end}")
    ends = [one(name, end) for name, (_, both) in VALUES.items() for end in (("high", "low") if both else ("high",))]
    return group_limits(rows, fence, least).groupBy("lang", "source").agg(*ends)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with kept: false if the base rule failed or a measure is outside its group's fence."""
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for name, (value, both) in VALUES.items():
        inside = inside & F.coalesce(F.expr(value) <= F.col(f"{name}_high"), F.lit(True))
        if both:
            inside = inside & F.coalesce(F.expr(value) >= F.col(f"{name}_low"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def quality_digest(docs: DataFrame) -> DataFrame:
    rows = scratch.save(measures(docs), "measures")
    return judged(rows, thresholds(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are. The verdicts are joined by doc_id and text hash."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h"), "lang", "source").alias("doc_id"), "lang", "source", "text")
    rows = scratch.save(measures(keyed), "measures")
    gone = judged(rows, thresholds(rows)).where("not kept").select("doc_id.*").distinct()
    gone = scratch.save(gone.toDF("__id", "__h", "__l", "__s"), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h")) & docs["lang"].eqNullSafe(F.col("__l")) & docs["source"].eqNullSafe(F.col("__s"))
    return docs.join(scratch.bounded(gone, 64), same, "left_anti")
