"""Boilerplate lines by their frequency on the site, as columns and SQL functions only.

For every host, the pages that contain a line are counted and divided by the
host's pages; lines above a ratio are boilerplate there and leave every page of
the host. Elsewhere the same line stays.

A second, much lower bar may be set for lines that are too long to repeat by
chance: `Rare`. Written text has about one bit of news a character, so a line
of 20 characters meets an equal one once in some 2^20 lines. On a site of ten
lines a page that is a share of 1e-5 of its pages for each line; RARE asks for
500 times as much, and for five unlike pages, so that neither a small site nor
one page that was copied makes its own lines boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shared_table

RATIO = 0.08
MIN_PAGES = 5


@dataclass(frozen=True)
class Rare:
    """The lower bar: share of the host's pages, unlike pages that hold the line, characters of the line."""

    ratio: float = 0.005
    min_texts: int = 5
    min_chars: int = 20


RARE = Rare()


def host_of(url: Column) -> Column:
    """Lower-case host of a web address, without user, port and a leading www."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _plain(line: Column) -> Column:
    """A line as it is compared: without white space at its ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _key(line: Column) -> Column:
    """96 bits that stand for a line: two unlike hashes of its text."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(
    pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, rare: Rare | None = None
) -> DataFrame:
    """host, key, pages, host_pages of lines on more than `ratio` of the host's pages, or over the lower bar `rare`.

    A line counts once a page, and travels as its key. Hosts with fewer than
    `min_pages` pages have no boilerplate: on so few, a ratio says nothing.
    Counts are combined in the tasks before they are shuffled, so a host with a
    third of all pages, or a line on all of them, adds one row a task. At most
    (lines of an average page) / (lowest ratio) lines of a host can pass.
    """
    plain = F.filter(F.transform(_lines(text), _plain), lambda x: x != "")
    enough = F.lit(0) if rare is None else F.lit(rare.min_chars)
    keys = F.array_distinct(F.transform(plain, lambda x: F.struct(_key(x).alias("key"), (F.length(x) >= enough).alias("long"))))
    rows = pages.select(host.alias("host"), keys.alias("keys"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= min_pages)
    if rare is None:
        rows = rows.withColumn("copies", F.lit(1))
    else:
        rows = rows.groupBy("host", "keys").agg(F.count(F.lit(1)).alias("copies"))
    found = rows.select("host", "copies", F.explode("keys").alias("line")).select("host", "copies", "line.*")
    counts = found.groupBy("host", "key", "long").agg(
        F.sum("copies").alias("pages"), F.count(F.lit(1)).alias("texts")).where("pages > 1")
    totals = totals.select(F.col("host").alias("own_host"), "host_pages")
    over = F.col("pages") > F.col("host_pages") * F.lit(ratio)
    if rare is not None:
        over |= F.col("long") & (F.col("texts") >= rare.min_texts) & (
            F.col("texts") > F.col("host_pages") * F.lit(rare.ratio))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("own_host"))).where(over).select(
        "host", "key", "pages", "host_pages")


def without_boilerplate(
    pages: DataFrame, host_col: str | Column, text_col: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, rare: Rare | None = None,
) -> DataFrame:
    """The pages with all columns, boilerplate lines taken out of the text, and `_removed`, their number.

    A null host is a host of its own. A null text stays null; empty and blank
    lines stay. No page is dropped, not even one that ends up empty. Repeated
    rows count as pages of their own. An empty table gives no rows.
    """
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    found = boilerplate(pages, host, F.col(text_col), ratio, min_pages, rare)
    marked = shared_table(found.groupBy(F.col("host").alias("_host")).agg(
        F.collect_list("key").alias("_lines")), "boilerplate")
    rows = pages.select(F.struct("*").alias("_row"), host.alias("_own"), F.col(text_col).alias("_text"))
    rows = rows.join(marked, F.col("_own").eqNullSafe(F.col("_host")), "left")
    lines = _lines(F.col("_text"))
    left = F.filter(lines, lambda x: (_plain(x) == "") | ~F.array_contains(F.col("_lines"), _key(_plain(x))))
    cleaned = F.when(F.col("_lines").isNull() | F.col("_text").isNull(), F.col("_text")).otherwise(
        F.array_join(left, "\n"))
    removed = F.when(F.col("_lines").isNull() | F.col("_text").isNull(), F.lit(0)).otherwise(
        F.size(lines) - F.size(left)).cast("long")
    out = [(cleaned if c == text_col else F.col("_row")[c]).alias(c) for c in pages.columns]
    return rows.select(*out, removed.alias("_removed"))
