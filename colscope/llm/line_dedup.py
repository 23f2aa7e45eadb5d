"""Line dedup: lines that too large a share of a host's pages hold are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import carried, join_hot, table

#: A line on more than this share of its host's pages, and on so many pages at least, is boilerplate.
RATIO, MIN_PAGES = 0.1, 3
#: Hosts with 1 / HOT_SHARE of all pages or more, HOT_SHARE hosts at most, are served by broadcast.
HOT_SHARE = 200

HIDDEN = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->"
TAG = r"<[^>]*>"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SPACE = " \t\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; what has none, null included, belongs to the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def text_lines(text: Column) -> Column:
    """The trimmed non-empty lines of a text; a null text has none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n\r]"), lambda x: F.trim(x, F.lit(SPACE)))
    return F.filter(lines, lambda x: x != "")


def html_lines(html: Column) -> Column:
    """The visible lines of a page: scripts, styles and comments go, every tag ends a line."""
    return text_lines(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), TAG, "\n"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, hot: int) -> DataFrame:
    """Per host (``_host``, ``_lines`` in): its pages, and the lines on too many of them.

    A page counts once for a line however often it repeats it. A host has fewer boilerplate lines
    than its pages' mean number of lines over ``ratio``, so the array stays small whatever the host.
    """
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    holding = (
        pages.select("_host", F.explode(F.array_distinct("_lines")).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_holding"))
        .where(F.col("_holding") >= min_pages)
    )
    share = F.col("_holding") / F.col("_pages")
    found = join_hot(holding, totals, "_host", "_pages", hot).where(share > ratio)
    lists = found.groupBy("_host").agg(F.collect_set("_line").alias("_boilerplate"), F.first("_pages").alias("_pages"))
    return lists


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    lines: Column,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Every page with host, n_lines, n_kept and kept_text: its lines in order, less boilerplate.

    A line is boilerplate for a host if more than ``ratio`` of the host's pages, and ``min_pages`` at
    least, hold it. Repeated rows count as pages of their own; a page without lines (null or empty
    included) counts as a page and keeps an empty text. Input columns named like a result are
    replaced. An empty table gives none.
    """
    first, _, last = carried(pages, ["host", "n_lines", "n_kept", "kept_text"])
    split = pages.select(*first, host.alias("_host"), lines.alias("_lines"))
    hot = max(1000, pages.count() // HOT_SHARE)
    lists = boilerplate(split.select("_host", "_lines"), ratio, min_pages, hot)
    joined = join_hot(split, lists, "_host", "_pages", hot)
    kept = F.filter("_lines", lambda x: ~F.array_contains(F.coalesce("_boilerplate", F.array().cast("array<string>")), x))
    return joined.withColumn("_kept", kept).select(
        *last,
        F.col("_host").alias("host"),
        F.size("_lines").alias("n_lines"),
        F.size("_kept").alias("n_kept"),
        F.array_join("_kept", "\n").alias("kept_text"),
    )


def op7_line_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    out = drop_boilerplate(pages, host_of(F.col("url")), html_lines(F.col("html")))
    return out.select("page_id", "host", "n_lines", "n_kept", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS row_no, page_id,
         lower(coalesce(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
         list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '[\n\r]'),
           lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12))), lambda x: x <> '') AS lines
  FROM pages),
f AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
b AS (
  SELECT f.host, list(line) AS lines
  FROM f JOIN (SELECT host, count(*) AS n FROM p GROUP BY host) h USING (host)
  WHERE f.n >= 3 AND f.n / h.n > 0.1 GROUP BY f.host)
SELECT page_id, host, CAST(len(p.lines) AS INTEGER) AS n_lines, CAST(len(kept) AS INTEGER) AS n_kept,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM (SELECT p.*, list_filter(p.lines, lambda x: NOT list_contains(coalesce(b.lines, []), x)) AS kept
      FROM p LEFT JOIN b USING (host)) p
"""
