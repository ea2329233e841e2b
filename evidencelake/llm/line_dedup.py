"""Drop a site's boilerplate: lines found on more than a given share of the site's pages.

All of it is DataFrame and SQL expressions. What is counted is (site, line) pairs, reduced before the shuffle, so neither a large site
nor a line on all its pages meets in one task. A site has at most (lines per page) / ratio boilerplate lines; they travel as one
array per site, written first, so that Spark knows its size when it chooses the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.session import materialise


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a page that hold no text.
HIDDEN = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def text_lines(text: Column) -> Column:
    """Non-empty lines without the spaces around them."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def html_lines(html: Column) -> Column:
    """Non-empty pieces of text between tags and line feeds, without the spaces around them."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "<>")
    return F.filter(F.transform(F.split(shown, r"<[^>]*>|\n"), lambda x: F.trim(x)), lambda x: x != "")


def site_lines(pages: DataFrame, ratio: float, min_pages: int, min_line_pages: int) -> DataFrame:
    """From (site, lines): per site with boilerplate, the hashes of its boilerplate lines."""
    hashed = pages.select("site", F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))).alias("hashes"))
    totals = hashed.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")).filter(F.col("site_pages") >= min_pages)
    found = hashed.select("site", F.explode("hashes").alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("line_pages"))
    often = found.filter((F.col("line_pages") >= min_line_pages) & (F.col("line_pages") > ratio * min_pages)).join(totals, "site").filter(F.col("line_pages") > ratio * F.col("site_pages"))
    return often.groupBy("site").agg(F.collect_list("line").alias("boilerplate"))


def drop_boilerplate(pages: DataFrame, site: Column, lines: Column, ratio: float = 0.1, min_pages: int = 1, min_line_pages: int = 2) -> DataFrame:
    """``pages`` with site, n_lines, n_dropped and text (the lines that stay, one under another).

    A line goes when at least ``min_line_pages`` pages of its site hold it and they, divided by all pages of the site, exceed ``ratio``; with 2 and 0.1, that is the ratio alone from
    10 pages on. ``min_pages`` exempts smaller sites as a whole. A line that a page repeats counts once, and goes everywhere or nowhere. Lines are compared by a 64-bit hash.
    Null texts have no lines, a null site is the empty one, repeated rows are pages of their own. Columns of the new names are replaced.
    """
    own = pages.select(F.struct("*").alias("row"), F.coalesce(site, F.lit("")).alias("site"), lines.alias("lines"))
    bad = materialise(site_lines(own.select("site", "lines"), ratio, min_pages, min_line_pages), "boilerplate")
    joined = own.join(bad, "site", "left")
    joined = joined.withColumn("kept", F.expr("if(boilerplate is null, lines, filter(lines, x -> not array_contains(boilerplate, xxhash64(x))))"))
    others = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("site", "n_lines", "n_dropped", "text")]
    return joined.select(*others, "site", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
