"""Cases worth reading: best and worst items, disagreements, weaknesses, diagnostic cards and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.operators.skills import bad_cases, first_ids


def best_and_worst(pairs: DataFrame, focal: str, n: int = 5) -> DataFrame:
    """side, rank, item_id, rate: the items on which the focal model wins least and most, over its competitors. Both are top-k
    by sort, which Spark takes from each partition first."""
    rate = F.coalesce(F.try_divide(F.col("a_wins") + F.col("ties") * 0.5, F.col("a_wins") + F.col("b_wins") + F.col("ties")), F.lit(0.5))
    rates = pairs.where(F.col("model_a") == focal).groupBy("item_id").agg(F.avg(rate).alias("rate"))
    worst = rates.orderBy("rate", "item_id").limit(n).withColumn("side", F.lit("worst"))
    best = rates.orderBy(F.desc("rate"), F.desc("item_id")).limit(n).withColumn("side", F.lit("best"))
    rows = worst.unionByName(best).groupBy("side").agg(F.collect_list(F.struct("rate", "item_id")).alias("found"))
    ordered = F.when(F.col("side") == "worst", F.array_sort("found")).otherwise(F.reverse(F.array_sort("found")))
    return rows.select("side", F.posexplode(ordered).alias("rank", "x")).select("side", (F.col("rank") + 1).alias("rank"), "x.item_id", "x.rate")


def lowest_agreement(verdicts: DataFrame, n: int = 10) -> DataFrame:
    return verdicts.where("agreement is not null").select("item_id", "model", "agreement", "correctness").orderBy("agreement", "item_id", "model").limit(n)


def weaknesses(verdicts: DataFrame, items: DataFrame, focal: str) -> DataFrame:
    """error_type, category, count, ids of a model's wrong and partial answers; missing items have category 'default'."""
    category = F.get(F.col("category"), F.lit(0)) if dict(items.dtypes)["category"].startswith("array") else F.col("category")
    rows = bad_cases(verdicts, focal).join(items.select("item_id", category.alias("category")), "item_id", "left")
    rows = rows.select("item_id", F.when(F.coalesce("error_type", F.lit("")) == "", "未归类").otherwise(F.col("error_type")).alias("error_type"), F.coalesce("category", F.lit("default")).alias("category"))
    group = ["error_type", "category"]
    sums = rows.groupBy(*group).agg(F.count("*").alias("count"))
    return sums.join(first_ids(rows, group), group).select(*group, "count", F.array_join("ids", ",").alias("ids"))


def cards(items: DataFrame, verdicts: DataFrame, pairs: DataFrame, metas: DataFrame, focal: str) -> DataFrame:
    """Per item: the focal model's verdict, each competitor's win rate, meta agreement and diagnostic flags."""
    own = verdicts.where(F.col("model") == focal).select("item_id", "correctness", "total", "low_agreement")
    by_model = verdicts.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "total")))).alias("totals"))
    rates = pairs.where(F.col("model_a") == focal).groupBy("item_id").agg(F.min("win_rate_a").alias("worst_rate"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_b", "win_rate_a")))).alias("win_rates"))
    meta = metas.where(F.col("model") == focal).select("item_id", "agree", "objective")
    rows = items.select("item_id", "question", "category", "difficulty").join(own, "item_id", "left").join(by_model, "item_id", "left").join(rates, "item_id", "left").join(meta, "item_id", "left")
    flags = F.array_compact(F.array(
        F.when(F.col("low_agreement"), "低一致率"), F.when(F.col("correctness").isin("wrong", "partial"), F.concat(F.lit("focal判"), "correctness")),
        F.when(~F.col("agree"), "元评测判错"), F.when(F.col("worst_rate") < 0.5, "focal此题落后"),
    ))
    return rows.select("item_id", F.substring("question", 1, 200).alias("question"), "category", "difficulty", "correctness", "total", "totals", "win_rates", "worst_rate", "objective", "agree", flags.alias("flags"))


def advice_rows(win_rates: DataFrame, dim_means: DataFrame, overview: DataFrame, scale: int = 5) -> DataFrame:
    """Rules over small aggregates as (section, key, detail, metric, value): competitors behind below 0.45, ahead above 0.55, level
    between; the five weakest dimensions under 0.6 of the scale; more than a fifth of verdicts with low agreement."""
    side = F.when(F.col("win_rate") < 0.45, "behind").when(F.col("win_rate") > 0.55, "ahead").otherwise("level")
    row = lambda key, detail, metric, value: [F.lit("advice").alias("section"), key.alias("key"), detail.alias("detail"), F.lit(metric).alias("metric"), value.cast("double").alias("value")]
    against = win_rates.where("win_rate is not null").select(*row(side, F.col("model_b"), "win_rate", F.col("win_rate")))
    weak = dim_means.where(F.col("mean") < 0.6 * scale).orderBy("mean", "dim").limit(5).select(*row(F.lit("weak dimension"), F.col("dim"), "mean", F.col("mean")))
    low = overview.where("low_rate > 0.2").select(*row(F.lit("judges often disagree"), F.lit(""), "low_rate", F.col("low_rate")))
    return against.unionByName(weak).unionByName(low)
