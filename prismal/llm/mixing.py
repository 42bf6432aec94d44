"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Every document is measured in words. A source's share of the mix follows its
weight, but no source is repeated more than `cap` times: what a capped source
cannot use is shared again among the others by weight, which is the usual
water filling and has a closed form over the sources sorted by their cap.

The mix is then a house of equal-token blocks. Sainte-Lague gives each source
an integer number of blocks by highest quotients, and gives each shard of a
source its own integer quota the same way. Inside a shard the documents are
laid end to end in a seeded order and cut into blocks; every block is taken
quota / blocks times, and a systematic draw with a seeded start takes the
remaining ones once more. The draw has a closed form, so that a document's
words in the mix come from its two ends alone, without a row for each block.

A shard holds about `shard_words` words, so that a source with most of the
corpus is still spread over many tasks.

The sources are apportioned in one task, a row each: that is meant for sources
that are counted in thousands, not for one a host. Nothing else is: a source's
shards and their documents are dealt by (source, shard).

Null and empty texts have size 0; a null source is a source of its own and comes
last; rows that repeat an id are separate documents, and rows that agree in all
that is read take what they take together in any order; an empty table gives no
rows. A very long text is one document, of which the mix takes words of some
blocks more often than of others. Only the columns that are named are read, so
that others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import n_words
from prismal.session import stored

BLOCK = 16
SHARD_WORDS = 1 << 22
WEIGHTS = (5, 2, 1)
CAP = 3


def _number(*parts: Column) -> Column:
    """60 bits that depend on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def apportioned(votes: DataFrame, by: list[str], order: list[Column], *, vote: str, house: str, quota: str) -> DataFrame:
    """Sainte-Lague seats in column `quota`: within each group `by`, `house` seats go to the highest quotients vote / (2k + 1).

    The multiplier (house - parties / 2) / votes leaves at most `parties`
    seats open, so that only a few quotients of each party compete for them.
    """
    group = Window.partitionBy(*by)
    x = (
        votes.withColumn("_n", F.sum((F.col(vote) > 0).cast("long")).over(group))
        .withColumn("_v", F.sum(vote).over(group))
        .withColumn("_sure", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.floor(F.col(vote) * (F.col(house) - F.col("_n") / 2) / F.col("_v") + 0.5))).otherwise(0).cast("long"))
        .withColumn("_open", F.col(house) - F.sum("_sure").over(group))
        .withColumn("_more", F.when(F.col("_v") > 0, F.ceil(F.col("_n") * F.col(vote) / F.col("_v")) + 2).otherwise(1).cast("int"))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_more"))))
    )
    quotient = F.col(vote) / (2 * (F.col("_sure") + F.col("_k")) + 1)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), *order, "_k"))
    won = ((place <= F.col("_open")) & (F.col(vote) > 0)).cast("long")
    kept = [c for c in votes.columns]
    return x.withColumn("_won", won).groupBy(*kept).agg((F.first("_sure") + F.sum("_won")).alias(quota))


def targets(sized: DataFrame, *, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """One row a source: _src, source, source_size, target. The table has as many rows as there are sources."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    by_cap = every.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return (
        sized.groupBy("_src", "source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", cap * F.col("source_size"))
        .withColumn("_level", (F.sum("source_size").over(every) - before) / rest)
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.max("_level").over(every) * F.col("_w")))
        .select("_src", "source", "source_size", "target")
    )


def mixed_sizes(docs: DataFrame, *, seed: str = "mix", block: int = BLOCK, shard_words: int = SHARD_WORDS, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, and row_col, which tells apart rows that repeat an id."""
    row = [row_col] if row_col else []
    sized = docs.select(
        *row,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_src"),
        n_words(F.col(text_col)).alias("size"),
    )
    house = F.floor((F.sum("source_size").over(Window.partitionBy(F.lit(0))) + block // 2) / block).cast("long")
    sources = apportioned(targets(sized, weights=weights, cap=cap).withColumn("_house", house), ["_house"], [F.col("source").asc_nulls_last()], vote="target", house="_house", quota="_quota").drop("_house")
    sources = stored(sources, "sources")  # of known size: broadcast while it is small, so that no source's documents meet in one task
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = (
        sized.drop("source")
        .join(sources, "_src")
        .withColumn("_turn", _number(F.lit(seed), name))
        .withColumn("_shard", F.col("_turn") % F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    )
    shards = placed.groupBy("_src", "_shard", "_quota").agg(F.sum("size").alias("_shard_size"))
    quotas = apportioned(shards, ["_src"], [F.col("_shard")], vote="_shard_size", house="_quota", quota="_q")
    quotas = (
        quotas.drop("_quota", "_shard_size")
        .withColumnsRenamed({"_src": "_src2", "_shard": "_shard2"})
    )
    line = Window.partitionBy("_src", "_shard").orderBy("_turn", "doc_id", "size", *row)
    laid = placed.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("size").over(Window.partitionBy("_src", "_shard")))
    x = (
        laid.join(quotas, (F.col("_src") == F.col("_src2")) & (F.col("_shard") == F.col("_shard2")))
        .withColumn("_b", F.greatest(F.lit(1), F.ceil(F.col("_total") / block)).cast("long"))
        .withColumn("_base", F.least(F.lit(cap), F.floor(F.col("_q") / F.col("_b"))).cast("long"))
        .withColumn("_extra", F.when(F.col("_base") < cap, F.col("_q") - F.col("_base") * F.col("_b")).otherwise(0))
        .withColumn("_start", _number(F.lit(seed), F.col("_src"), F.col("_shard").cast("string")) % F.col("_b"))
    )

    def drawn(j: Column) -> Column:
        return F.floor((j * F.col("_extra") + F.col("_start")) / F.col("_b")).cast("long")

    def words_before(t: Column) -> Column:
        j, inside = F.floor(t / block).cast("long"), t % block
        return (drawn(j) - drawn(F.lit(0))) * block + (drawn(j + 1) - drawn(j)) * inside

    taken = F.col("_base") * F.col("size") + words_before(F.col("_end")) - words_before(F.col("_end") - F.col("size"))
    return x.select(*row, "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed_sizes(docs).drop("source")
