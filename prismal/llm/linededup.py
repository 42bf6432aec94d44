"""Line dedup by site-relative frequency (DataFrame operations only).

Documents are grouped by host. For each host, the number of its pages that
contain a line is divided by the number of its pages; a line that exceeds
`max_share`, on at least `min_pages` pages, is boilerplate of that host and
goes from all of its pages. Lines are compared without surrounding blanks.

A page counts once for a line however often it repeats it. With `copies_once`
pages of one host with the same text count as one, in the share's numerator
and denominator alike, so that a much copied page isn't taken for boilerplate.

The count by (host, line) has a partial sum before the shuffle, so that neither
a host with most pages nor a line that is on all of them makes a large group.
What comes out is small: a host has at most (mean lines a page) / max_share
such lines. It is written to the shared folder, and Catalyst broadcasts it if
its true size allows; otherwise it joins by host, and a hot host's pages are
split.

Null hosts are a host of their own; blank lines are never boilerplate and
stay; null texts stay null with no lines; repeated rows are separate pages; a
line on exactly `max_share` of the pages stays; an empty table gives no rows.
A very long text is one array of its lines. All columns of the input travel in
one struct, whatever their names; those named n_lines and n_dropped are
replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import packed, unpacked
from prismal.session import stored

MAX_SHARE = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def boilerplate(pages: DataFrame, *, host: str, text: str, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(_host, _drop): the 64-bit hashes of each host's boilerplate lines."""
    x = pages.select(F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("_host"), F.col(text).alias("_t"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("_t")), _trimmed), lambda s: s != ""), lambda s: F.xxhash64(s)))
    x = x.select("_host", F.xxhash64("_t").alias("_text"), F.coalesce(hashes, F.array().cast("array<bigint>")).alias("_lines"))
    if copies_once:
        x = x.groupBy("_host", "_text").agg(F.first("_lines").alias("_lines"))
    # The page itself is a "line" with no hash: one aggregate gives both counts.
    seen = x.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "_lines")).alias("_line"))
    counts = seen.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= min_pages) | F.col("_line").isNull())
    counts = stored(counts, "lines")
    total = counts.where(F.col("_line").isNull()).select("_host", F.col("_n").alias("_pages"))
    return (
        counts.where(F.col("_line").isNotNull())
        .join(total, "_host")
        .where(F.col("_n") > F.col("_pages") * max_share)
        .groupBy("_host")
        .agg(F.collect_list("_line").alias("_drop"))
    )


def cleaned(pages: DataFrame, *, host: str = "source", text: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """`pages` with `text` rid of its host's boilerplate lines, and the counts n_lines and n_dropped."""
    drop = stored(boilerplate(pages, host=host, text=text, max_share=max_share, min_pages=min_pages, copies_once=copies_once), "boilerplate")
    x = pages.select(F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("_host"), F.col(text).alias("_text"), packed(pages).alias("_row"))
    x = x.join(drop, "_host", "left").withColumn("_all", F.transform(_lines(F.col("_text")), lambda s: F.struct(s.alias("line"), F.xxhash64(_trimmed(s)).alias("h"))))
    # The few of the host's lines that the page has: one hashed pass over both lists.
    x = x.withColumn("_here", F.array_intersect("_drop", F.col("_all")["h"]))
    kept = F.when(F.size("_here") > 0, F.filter("_all", lambda s: ~F.array_contains(F.col("_here"), s["h"]))).otherwise(F.col("_all"))
    x = x.withColumn("_kept", kept)
    own = {
        text: F.array_join(F.col("_kept")["line"], "\n"),
        "n_lines": F.coalesce(F.when(F.col("_all").isNotNull(), F.size("_all")), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.when(F.col("_all").isNotNull(), F.size("_all") - F.size("_kept")), F.lit(0)).cast("long"),
    }
    return x.select(*unpacked("_row", pages.columns, own))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return cleaned(docs).select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
