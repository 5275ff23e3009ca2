"""Overviews of verdicts by model and slice, and dimension gaps between models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("right", "partial", "wrong", "unclear")


def _measures(scale: int) -> list:
    return [
        F.count("*").alias("n"), F.avg("total").alias("mean_total"), (F.avg("total") / scale).alias("norm_mean"),
        *(F.count_if(F.col("correctness") == c).alias(f"{c}_n") for c in LABELS),
        F.avg(F.col("low_agreement").cast("double")).alias("low_rate"),
    ]


def overview(verdicts: DataFrame, by: list[str], scale: int = 5) -> DataFrame:
    return verdicts.groupBy(*by).agg(*_measures(scale))


def overview_by_slices(verdicts: DataFrame, items: DataFrame, scale: int = 5) -> DataFrame:
    """model, slice (all, category, difficulty, has_ref), value and the overview's measures, in one pass over (slice, value) pairs. An
    array of categories counts an item in each of them; the other slices count it once."""
    category = F.col("category") if dict(items.dtypes)["category"].startswith("array") else F.array("category")
    pair = lambda name, value: F.struct(F.lit(name).alias("slice"), value.alias("value"))
    ref = F.when(F.col("has_ref"), "with reference").otherwise("without reference")
    once = F.array(pair("all", F.lit("all")), pair("difficulty", F.col("difficulty")), pair("has_ref", ref))
    several = F.transform(F.coalesce(category, F.array().cast("array<string>")), lambda c: pair("category", c))
    rows = verdicts.join(items.select("item_id", F.concat(once, several).alias("slices")), "item_id")
    rows = rows.select("model", "total", "correctness", "low_agreement", F.explode("slices").alias("s")).select("model", "total", "correctness", "low_agreement", "s.slice", "s.value")
    return rows.groupBy("model", "slice", "value").agg(*_measures(scale))


def dim_means(verdicts: DataFrame, dims: DataFrame, by: list[str]) -> DataFrame:
    """by, dim, mean: a verdict without the dimension counts as 0; a dimension that any verdict of the slice calls not
    applicable is left out of the slice. `by` are columns of verdicts besides model."""
    keyed = verdicts.select("item_id", "model", *[c for c in by if c != "model"])
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("verdicts"))
    sums = keyed.join(dims, ["item_id", "model"]).groupBy(*by, "dim").agg(F.sum("mean_score").alias("points"), F.bool_or("is_na").alias("any_na"))
    return sums.where(~F.col("any_na")).join(sizes, by).select(*by, "dim", (F.coalesce("points", F.lit(0.0)) / F.col("verdicts")).alias("mean"))


def dim_gaps(dims: DataFrame, verdicts: DataFrame, focal: str) -> DataFrame:
    """other, dim, focal_mean, other_mean, gap over the items that both models answered; missing scores are 0 and
    dimensions not applicable to any of their verdicts are left out."""
    mine = verdicts.where(F.col("model") == focal).select("item_id")
    both = verdicts.where(F.col("model") != focal).select("item_id", F.col("model").alias("other")).join(mine, "item_id")
    sizes = both.groupBy("other").agg(F.count("*").alias("items"))
    score = dims.select("item_id", "model", "dim", "mean_score", "is_na")
    theirs = both.join(score, (both["item_id"] == score["item_id"]) & (both["other"] == score["model"])).select("other", "dim", F.lit(0.0).alias("f"), F.col("mean_score").alias("o"), "is_na")
    own = both.join(score.where(F.col("model") == focal), "item_id").select("other", "dim", F.col("mean_score").alias("f"), F.lit(0.0).alias("o"), "is_na")
    sums = own.unionAll(theirs).groupBy("other", "dim").agg(F.sum("f").alias("f"), F.sum("o").alias("o"), F.bool_or("is_na").alias("any_na")).where(~F.col("any_na"))
    rows = sums.join(sizes, "other")
    return rows.select("other", "dim", (F.col("f") / F.col("items")).alias("focal_mean"), (F.col("o") / F.col("items")).alias("other_mean"), ((F.col("f") - F.col("o")) / F.col("items")).alias("gap"))
