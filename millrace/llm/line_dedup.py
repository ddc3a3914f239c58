"""Line dedup by overlapping windows of three lines (DataFrame functions only).

Every three consecutive lines of a document are a window.  So that a long passage of one or two
lines is found too, one or two consecutive lines of more than 50 words together are windows as
well.  Windows are compared by the hashes of their lines, trimmed of ASCII white space.  Of the
windows that occur more than once, in one document or several, the first occurrence (by doc_id,
then by place) stays; the positions that later occurrences cover are merged, and the lines there
are removed.  What is removed is thus still to be found earlier.

Only hashes and positions are shuffled to find repeats; counts combine before they are sent.  A
window that very many documents hold is a skewed join key, which Spark splits.

Edge cases: null text has no lines and stays null; documents of fewer than three lines without a
long passage have no window and stay as they are; a null doc_id orders first.  Rows of the same
doc_id and text are one document: each gets the same result.  Documents may become empty.  Other
columns are returned by dedup_lines() as they were; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

LINES = 3
#: Words beyond which fewer lines are a window.
WORDS = 50


def _windows(lines: Column, words: Column, hashes: Column) -> Column:
    """Array of (pos, len, h); lines, words and hashes are arrays with one entry for each line."""
    def of(length: int) -> Column:
        def at(i: Column, array: Column) -> list[Column]:
            return [F.get(array, i + k) for k in range(length)]

        places = F.when(F.size(lines) >= length, F.sequence(F.lit(0), F.size(lines) - length)).otherwise(F.array().cast("array<int>"))
        if length < LINES:
            places = F.filter(places, lambda i: sum(at(i, words), F.lit(0)) > WORDS)
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.lit(length), *at(i, hashes)).alias("h")))

    return F.concat(*map(of, range(1, LINES + 1)))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, removed): positions of the lines to remove, for documents that have some."""
    trimmed = F.transform("_lines", lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    count = lambda x: F.when(x != "", F.size(F.split(x, r"[\x20\x09-\x0D]+"))).otherwise(0)
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.split(common.text_or_empty(), "\n").alias("_lines")).select("doc_id", "_text", trimmed.alias("lines"))
    lines = lines.select("doc_id", "_text", "lines", F.transform("lines", count).alias("words"), F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"))
    spread = lines.select("doc_id", "_text", F.explode(_windows(F.col("lines"), F.col("words"), F.col("hashes"))).alias("w"))
    windows = common.save(spread.select("doc_id", "_text", "w.pos", "w.len", "w.h"), "windows")
    place = F.struct("doc_id", "_text", "pos")
    # written before it is joined: Spark splits a hot key only between sides that are bare shuffles
    repeated = common.save(windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "hashes")
    again = common.save(windows.join(repeated, "h"), "repeated")
    first = common.save(again.groupBy("h").agg(F.min(place).alias("first")), "first")
    later = again.join(first, "h").where(place > F.col("first"))
    positions = later.select("doc_id", "_text", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("pos"))
    return positions.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the remaining lines as text, and the columns n_lines and removed (positions)."""
    found = covered(docs).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_same"), "removed")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_text"), F.split(common.text_or_empty(), "\n").alias("_lines"))
    both = keyed.join(found, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same")), "left")
    left = F.filter("_lines", lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines")
    others = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "removed")]
    return both.select(*others, n_lines, F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(common.text_or_empty().cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
t AS (SELECT doc_id, list_transform(s, lambda x: regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')) AS s FROM d),
w AS (SELECT doc_id, s, list_transform(s, lambda x: CASE WHEN x <> '' THEN len(regexp_split_to_array(x, '[ \t\n\v\f\r]+')) ELSE 0 END) AS n FROM t),
p AS (
  SELECT doc_id, i - 1 AS pos, 3 AS k, s[i:i + 2] AS v FROM (SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS i FROM w)
  UNION ALL SELECT doc_id, i - 1, 2, s[i:i + 1] FROM (SELECT doc_id, s, n, unnest(range(1, len(s))) AS i FROM w) WHERE n[i] + n[i + 1] > 50
  UNION ALL SELECT doc_id, i - 1, 1, s[i:i] FROM (SELECT doc_id, s, n, unnest(range(1, len(s) + 1)) AS i FROM w) WHERE n[i] > 50),
r AS (SELECT doc_id, pos, k, row_number() OVER (PARTITION BY k, v ORDER BY doc_id, pos) AS o FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS x FROM r WHERE o > 1),
g AS (SELECT doc_id, list(x ORDER BY x) AS rem FROM c GROUP BY 1)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(s) END AS n_lines, coalesce(len(rem), 0) AS n_removed, coalesce(array_to_string(rem, ','), '') AS removed,
  sha256(CASE WHEN rem IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(s)), lambda i: NOT list_contains(rem, i)), lambda i: s[i + 1]), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
