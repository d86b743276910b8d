"""Line dedup (3): explode normalised lines, hash, count distinct documents per hash, drop lines at or over the threshold, reassemble by position.

DataFrame functions only. What is shuffled per line is a pair of hashes, not the line: (line hash, document key) once to count
documents, and once to find the lines to drop; the texts move at most once, to meet their list of dropped positions. A line that a third of all
documents share is counted with map-side partial sums, and its occurrences are dealt over SALTS joins with copies of its hash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import row_key, table, without

#: Parts that the occurrences of one line are dealt to.
SALTS = 16

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII blanks at both ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def drop_common_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; columns of those names in the input are replaced, all others stay.

    A null or empty text is one empty line and is kept as an empty text. Lines with a key shorter than min_chars are never dropped.
    Rows equal in id and text are one document for the count and each come back. A null id is a value like any other.
    An empty table gives an empty result.
    """
    base = without(docs, "n_lines", "n_dropped", "kept_text", "__k1", "__k2", "__lines", "__gone")
    base = base.select("*", *row_key(301, id_col, text_col))
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    lines = base.select("__k1", "__k2", F.posexplode(split).alias("__pos", "__line")).select("__k1", "__k2", "__pos", line_key(F.col("__line")).alias("__key"))
    lines = lines.where(F.char_length("__key") >= max(1, min_chars)).select("__k1", "__k2", "__pos", F.xxhash64(F.lit(303), "__key").alias("__h1"), F.xxhash64("__key", F.lit(304)).alias("__h2"))
    common = lines.select("__h1", "__h2", "__k1", "__k2").distinct().groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs).select("__h1", "__h2")
    common = common.select("__h1", "__h2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    salted = lines.withColumn("__salt", F.pmod("__k1", F.lit(SALTS)))
    gone = salted.join(common, ["__h1", "__h2", "__salt"]).groupBy("__k1", "__k2").agg(F.sort_array(F.collect_set("__pos")).alias("__gone"))
    out = base.join(gone, ["__k1", "__k2"], "left").withColumn("__lines", split)
    none = F.array().cast("array<int>")
    out = out.withColumn("__gone", F.coalesce("__gone", none))
    # the lines between one dropped position and the next, so that a long text costs its length once
    starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda p: p + 1))
    ends = F.concat(F.col("__gone"), F.array(F.size("__lines")))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(F.col("__lines"), a + 1, b - a))
    kept = F.when(F.size("__gone") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.size("__gone").cast("long"), "kept_text": kept})
    return out.drop("__k1", "__k2", "__lines", "__gone")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, (common.k IS NOT NULL) AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
