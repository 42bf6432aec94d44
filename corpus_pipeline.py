"""The training-data pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage works on everything that the one before it kept, and returns the
columns of `documents`, but for the last, which adds what the mix takes of
each document: size, source_size, target and taken.

A stage's result is written and read back before the next stage begins, which
then deletes what the one before it kept in the scratch folder. Null texts fail
the quality rules; a null doc_id is a row like any other, and near-dedup keeps
the smallest id of a group; repeated rows are rows of their own, of which
near-dedup leaves one; very long texts are one row each; empty tables give
empty results; columns beside those of `documents` travel along, whatever their
names, but for the four that the last stage sets.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import decontamination, linededup, mixing, neardup, quality
from prismal.llm.common import NO_ID, packed, text_tag, unpacked
from prismal.session import stage, stored


def staged(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage(spark):
            return f(spark, docs, sf_dir)

    return run


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go.

    Null and empty texts fail the base rule; repeated rows have one verdict; a
    posterior of exactly a half stays; an empty table gives no rows.
    """
    counted = stored(quality.with_counts(docs), "counts")  # the votes are counted, then looked up
    return quality.verdicts(counted).where("_verdict.kept").select("_row.*")


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go, exact copies counting as one page; n_chars follows the text."""
    x = docs.select(packed(docs).alias("_docs"), "source", "text")
    x = linededup.cleaned(x, copies_once=True)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return x.select(*unpacked("_docs", docs.columns, own))


def with_rows(docs: DataFrame) -> DataFrame:
    """(_row, _docs), stored: a key for each row, for ids repeat and can be null, and all columns of docs in one struct."""
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs).alias("_docs")), "rows")


def keyed_rows(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("_row", *(F.col("_docs")[c].alias(c) for c in columns))


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id: five-word shingles, similarity of 0.8 or more."""
    rows = with_rows(docs)
    judged = neardup.linked(keyed_rows(rows, "text"), width=5, percent=80, bands=40, rows=4, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    judged = stored(judged.join(rows.select("_row", F.col("_docs.doc_id").alias("_id")), "_row"), "judged")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))  # a null id comes last
    groups = stored(judged.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first")).where("_n > 1").select("component_id", F.col("_first._row").alias("_stays")), "groups")
    gone = stored(judged.join(groups, "component_id").where("_row <> _stays").select("_row"), "copies")
    return rows.join(gone, "_row", "left_anti").select("_docs.*")


@staged
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(found.select("_id", "_th"), "leaks")
    x = docs.select(packed(docs).alias("_docs"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), text_tag(F.col("text")).alias("_th"))
    return x.join(gone, ["_id", "_th"], "left_anti").select("_docs.*")


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, with the number of its words that the mix takes."""
    rows = with_rows(docs)
    sizes = stored(mixing.mixed_sizes(keyed_rows(rows, "doc_id", "source", "text"), row_col="_row").drop("doc_id", "source"), "sizes")
    own = {c: F.col(c) for c in ("size", "source_size", "target", "taken")}
    return rows.join(sizes, "_row").select(*unpacked("_docs", docs.columns, own))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

#: Near-dedup follows links to any distance, and the quality model is estimated: the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
