"""Boilerplate lines by their frequency on a site.

For every site (host) a line's frequency is the number of its different pages that
contain the line, divided by the site's number of different pages. Lines that exceed a
ratio and are on several different pages are boilerplate and are dropped from all pages
of that site. Copies of a page count once, so a page does not become boilerplate by being
copied.

All of it is DataFrame functions. Counting shuffles 128-bit marks of lines, no text. A
site has fewer boilerplate lines than its mean lines per page divided by the ratio, so
they are one short list per site, which the pages are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import stored, unused, whole_text

# A line on more than a tenth of a site's pages is boilerplate.
RATIO = 0.1
# A line on fewer different pages than this is no boilerplate, whatever the ratio: on a site
# of nine pages a line of one page exceeds a tenth. It binds below forty pages.
LEAST_PAGES = 5
_BLANK = " \t\r\x0b\f"


def _mark(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), F.reverse(line)).alias("b"))


def _site(host: str) -> Column:
    """The host as a key that tells null from any name."""
    return F.when(F.col(host).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(host).cast("string")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """site, marks: the lines of each site that exceed the ratio; sites without any are left out.

    Null texts count as empty pages; a null host is a site like any other. Lines of
    white space alone are never boilerplate, nor are lines on fewer than `least_pages`
    different pages.
    """
    pages = docs.select(_site(host).alias("site"), whole_text(text).alias("text")).select(
        "site", _mark(F.col("text")).alias("page"), "text")
    totals = pages.groupBy("site").agg(F.countDistinct("page").alias("pages"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(_BLANK)) != "")
    counts = (
        pages.select("site", "page", F.explode(F.array_distinct(F.transform(lines, _mark))).alias("mark"))
        .groupBy("site", "mark").agg(F.countDistinct("page").alias("found"))
        .where(F.col("found") >= least_pages)
    )
    return counts.join(totals, "site").where(F.col("found") / F.col("pages") > ratio).groupBy("site").agg(
        F.collect_list("mark").alias("marks"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                        ratio: float = RATIO, least_pages: int = LEAST_PAGES, dropped: str | None = None) -> DataFrame:
    """docs with the boilerplate lines cut out of the text; all rows and other columns stay.

    A text loses whole lines with their line ends; if it loses all, it is empty. A null
    text stays null. `dropped` names a column to add: the number of lines cut out.
    """
    site, marks, kept = (unused(docs, n) for n in ("site_of_page", "marks_of_site", "lines_kept"))
    found, _ = stored(boilerplate(docs, host, text, ratio, least_pages), "boilerplate")
    found = found.select(F.col("site").alias(site), F.col("marks").alias(marks))
    joined = docs.withColumn(site, _site(host)).join(found, site, "left")
    lines = F.split(text, "\n")
    joined = joined.withColumn(kept, F.when(F.col(marks).isNotNull(), F.filter(
        lines, lambda line: (F.trim(line, F.lit(_BLANK)) == "") | ~F.array_contains(F.col(marks), _mark(line)))))
    cut = F.col(kept).isNotNull() & (F.size(kept) < F.size(lines))
    result = [F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns]
    if dropped:
        result.append(F.when(cut, F.size(lines) - F.size(kept)).otherwise(0).cast("bigint").alias(dropped))
    return joined.select(*result)


ORACLE = f"""
WITH pages AS (SELECT source, coalesce(text, '') AS text FROM documents),
totals AS (SELECT source, count(DISTINCT text) AS pages FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages),
bad AS (
    SELECT l.source, list(l.line) AS lines FROM (
        SELECT source, line, count(*) AS found FROM lines
        WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' GROUP BY source, line
        HAVING count(*) >= {LEAST_PAGES}
    ) l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
    WHERE l.found::DOUBLE / t.pages > {RATIO}::DOUBLE GROUP BY l.source
),
cut AS (
    SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines, CASE WHEN b.lines IS NULL THEN string_split(d.text, chr(10))
        ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.lines, x)) END AS kept
    FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
    coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped FROM cut
"""
