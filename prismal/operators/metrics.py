"""Detection metrics: ROC and precision-recall areas, pooled tables, confusion at a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_value(scored: DataFrame, by: list[str], score: str, positive: str, weight: str | None = None) -> DataFrame:
    """Positives p and negatives q of every different score, counted or weighed."""
    x = scored.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    if weight is None:
        counts = F.count_if(positive), F.count_if(~F.col(positive))
    else:
        counts = (F.sum(F.when(side, F.col(weight)).otherwise(0.0)) for side in (F.col(positive), ~F.col(positive)))
    return x.groupBy(*by, F.col(score).alias("_s")).agg(*(c.alias(n) for c, n in zip(counts, "pq")))


def roc_auc(scored: DataFrame, *, by: list[str] = ("scene_id",), score: str = "score", positive: str = "gt", weight: str | None = None) -> DataFrame:
    """Chance that a positive outscores a negative, ties counting a half; NULL if one of both is absent."""
    by = list(by)
    below = F.sum("q").over(Window.partitionBy(*by).orderBy("_s")) - F.col("q")
    x = _by_value(scored, by, score, positive, weight).withColumn("_won", F.col("p") * (below + F.col("q") / 2))
    return x.groupBy(*by).agg(F.try_divide(F.sum("_won"), (F.sum("p") * F.sum("q")).cast("double")).alias("roc_auc"))


def average_precision(scored: DataFrame, *, by: list[str] = ("scene_id",), score: str = "score", positive: str = "gt", weight: str | None = None) -> DataFrame:
    """Sum over different thresholds of the gain in recall times the precision."""
    by = list(by)
    down = Window.partitionBy(*by).orderBy(F.col("_s").desc())
    x = _by_value(scored, by, score, positive, weight)
    x = x.withColumn("_tp", F.sum("p").over(down)).withColumn("_all", F.sum(F.col("p") + F.col("q")).over(down))
    return x.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("_tp") / F.col("_all")), F.sum("p").cast("double")).alias("pr_auc"))


def confusion(scored: DataFrame, threshold: float, *, by: list[str] = ("scene_id",), score: str = "score", positive: str = "gt") -> DataFrame:
    by = list(by)
    flag = F.col(score) >= threshold
    x = scored.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count_if(flag & F.col(positive)).alias("tp"), F.count_if(flag & ~F.col(positive)).alias("fp"), F.count_if(~flag & F.col(positive)).alias("fn"))
    return x.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def pooled(rows: DataFrame, *, by: list[str], value: str, weight: str, ok: str = "status = 'ok'") -> DataFrame:
    """Macro mean, weighted micro mean and the number of failures of each group; failures stay in the table."""
    good = F.expr(ok)
    return rows.groupBy(*by).agg(F.avg(F.when(good, F.col(value))).alias("macro"), F.try_divide(F.sum(F.when(good, F.col(value) * F.col(weight))), F.sum(F.when(good, F.col(weight)))).alias("micro"), F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"))
