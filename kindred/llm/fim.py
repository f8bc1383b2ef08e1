"""Fill-in-the-middle: the transformation is SQL that DuckDB runs over Arrow batches inside ``mapInArrow``.

A text is cut into units (lines) left to right; four numbers from a digest of its id choose two cuts, whether it is cut at all, and the
order of the parts. Every batch is registered as a table, cut with ``regexp_extract_all``, put together from ``list_slice`` and
``array_to_string``, and given back as Arrow: no row passes through Python. There is no shuffle, and a row depends on nothing but
itself, so that a hot source or a group of copies is work for whichever task reads it, and a lost task is run again with the same rows.

Memory: a batch is handed over in runs of rows of about ``RUN_BYTES`` of text (a longer text is a run by itself), which
bounds what DuckDB holds; its spilling is off, since executors share no local folder.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays as it is (``plain``); a null id has the
digest of an empty string; repeated rows give repeated rows; other columns, whatever their names, are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

#: A line with its end, or the rest after the last one; code points.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
RUN_BYTES = 4 << 20


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _check(sentinels: tuple[str, str, str]) -> None:
    """ValueError unless an occurrence of a sentinel can never overlap another one, which makes outputs reversible."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or i != j and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels must be different and must not overlap: {', '.join(sentinels)}")


def _transform(unit: str, sentinels: tuple[str, str, str], seed: str, percent: int, spm_percent: int) -> str:
    """SQL: doc_id, n, form, prefix_chars, middle_chars and output of every row of ``batch`` (doc_id, key, text)."""
    pre, suf, mid = map(_quoted, sentinels)
    number = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    joined = lambda x: f"array_to_string({x}, '')"
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_quoted(unit)}) AS units, sha256({_quoted(seed + ":")} || coalesce(key, '')) AS digest FROM batch
), chosen AS (
  SELECT *, len(units)::BIGINT AS n, {number(0)} % (len(units) + 1) AS x, {number(1)} % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, {pre}) OR contains(text, {suf}) OR contains(text, {mid}) OR {number(2)} % 100 >= {percent} THEN 'plain'
              WHEN {number(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, {joined("list_slice(units, 1, least(x, y))")} AS prefix, {joined("list_slice(units, least(x, y) + 1, greatest(x, y))")} AS middle,
         {joined("list_slice(units, greatest(x, y) + 1, n)")} AS suffix
  FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {pre} || prefix || {suf} || suffix || {mid} || middle ELSE {suf} || suffix || {pre} || prefix || {mid} || middle END AS output
FROM parts"""


def _restore(rows: str, sentinels: tuple[str, str, str]) -> str:
    """SQL: all columns of ``rows`` and ``restored``, the text that output and form stand for."""
    pre, suf, mid = map(_quoted, sentinels)
    return f"""
SELECT * EXCLUDE (halves, ends), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN halves[1] || ends[2] || ends[1] ELSE ends[1] || ends[2] || halves[1] END AS restored
FROM (
  SELECT *, string_split(halves[2], {mid}) AS ends FROM (
    SELECT *, CASE form WHEN 'psm' THEN string_split(substr(output, length({pre}) + 1), {suf}) WHEN 'spm' THEN string_split(substr(output, length({suf}) + 1), {pre}) END AS halves FROM {rows}
  )
)"""


def _in_duckdb(sql: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each run of rows as the table ``batch``, and what ``sql`` makes of it. ``sql`` reads the column that is called ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        try:
            for batch in batches:
                for start, end, _, _ in text.blocks(batch.column("text"), RUN_BYTES):
                    con.register("batch", pa.Table.from_batches([batch.slice(start, end - start)]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))


def fill_in_middle(
    docs: DataFrame, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS, seed: str = "7", percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output of every row.

    ``percent`` of the texts are cut, and of these ``spm_percent`` begin with the suffix; ``unit`` must match all of a text."""
    _check(sentinels)
    made = _input(docs)
    kind = made.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(_in_duckdb(_transform(unit, sentinels, seed, percent, spm_percent)), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id and text, from the doc_id, form and output of ``fill_in_middle`` alone."""
    _check(sentinels)
    made = rows.select("doc_id", "form", F.col("output").alias("text"))
    source = "(SELECT doc_id, form, text AS output FROM batch)"
    return made.mapInArrow(_in_duckdb(f"SELECT doc_id, restored AS text FROM ({_restore(source, sentinels)})"), f"doc_id {made.schema['doc_id'].dataType.simpleString()}, text string")


def fim_digest(docs: DataFrame, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS, seed: str = "7", percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of the output, and of the text rebuilt from it, in place of the output."""
    _check(sentinels)
    made = _input(docs)
    sql = f"""SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
    FROM ({_restore(f"({_transform(unit, sentinels, seed, percent, spm_percent)})", sentinels)})"""
    kind = made.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(_in_duckdb(sql), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
