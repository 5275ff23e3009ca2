"""Judges against reference answers: objective labels, agreement, bias and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions import text as T


def metas(qa: DataFrame, verdicts: DataFrame, scale: int = 5) -> DataFrame:
    """For items with a reference, per verdict: em, f1, objective, judged, judge_total, agree, delta.

    qa: item_id, answer, reference (one row an item, or one a model with a model column). A missing answer counts as
    empty; items without a verdict are skipped. agree is null if the judges could not tell.
    """
    return metas_of_scored(scored_answers(qa), verdicts, scale)


def scored_answers(qa: DataFrame) -> DataFrame:
    """em and f1 of each answer with a reference, by item (and model, where qa has one): one row an item is scored before the join
    with its verdicts, so that a text is compared once."""
    keys = ["item_id", "model"] if "model" in qa.columns else ["item_id"]
    known = qa.where("reference <> ''").select(*keys, F.coalesce("answer", F.lit("")).alias("answer"), "reference")
    return known.select(*keys, T.exact_match(F.col("answer"), F.col("reference")).alias("em"), T.character_f1(F.col("answer"), F.col("reference")).alias("f1"))


def metas_of_scored(scored: DataFrame, verdicts: DataFrame, scale: int = 5) -> DataFrame:
    """metas() from scored_answers()."""
    keys = [c for c in scored.columns if c in ("item_id", "model")]
    return _judged(scored.join(verdicts.select("item_id", "model", "correctness", "total"), keys), scale)


def agreements(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """item_id, model, agree of metas_of_scored(), from verdicts' labels alone."""
    return metas_of_scored(scored, labels.withColumn("total", F.lit(None).cast("double"))).select("item_id", "model", "agree")


def metas_of_answers(verdicts: DataFrame, items: DataFrame, answers: DataFrame, scale: int = 5) -> DataFrame:
    """metas() of each verdict on an item with a reference, where answers (item_id, model, answer; one row each) are a store of their
    own: a verdict without an answer there is held against an empty one. Null references are none."""
    known = verdicts.select("item_id", "model", "correctness", "total").join(items.where("reference <> ''").select("item_id", "reference"), "item_id")
    rows = known.join(answers.select("item_id", "model", "answer"), ["item_id", "model"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return _judged(rows.withColumns({"em": T.exact_match(F.col("answer"), F.col("reference")), "f1": T.character_f1(F.col("answer"), F.col("reference"))}), scale)


def _judged(rows: DataFrame, scale: int) -> DataFrame:
    objective = T.objective_label(F.col("em"), F.col("f1"))
    return rows.select(
        "item_id", "model", "em", "f1", objective.alias("objective"), F.col("correctness").alias("judged"), F.col("total").alias("judge_total"),
        F.when(F.col("correctness").isin("right", "wrong", "partial"), F.col("correctness") == objective).alias("agree"), (F.col("total") / scale - F.col("f1")).alias("delta"),
    )


def pearson(x: str, y: str) -> Column:
    """Null for fewer than three rows or a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count("*") >= 3, F.try_divide(F.covar_pop(x, y), spread))


def bias_direction(delta: Column) -> Column:
    return F.when(delta.isNull(), "unknown").when(delta > 0.1, "lenient").when(delta < -0.1, "strict").otherwise("neutral")


def _measures() -> list[Column]:
    return [F.count("*").alias("n"), F.avg(F.col("agree").cast("double")).alias("accuracy"), F.avg("delta").alias("mean_delta"), pearson("judge_total", "f1").alias("pearson")]


def reliability(metas: DataFrame) -> DataFrame:
    """One row: n, accuracy, mean_delta, pearson, bias over rows whose agreement is known."""
    return metas.where("agree is not null").agg(*_measures()).withColumn("bias", bias_direction(F.col("mean_delta")))


def reliability_by(metas: DataFrame, items: DataFrame) -> DataFrame:
    """kind (category or difficulty), value and the measures, both groupings in one pass."""
    rows = metas.where("agree is not null").join(items.select("item_id", "category", "difficulty"), "item_id")
    found = rows.groupingSets([["category"], ["difficulty"]], "category", "difficulty").agg(F.grouping_id().alias("g"), *_measures())
    return found.select(F.when(F.col("g") == 1, "category").otherwise("difficulty").alias("kind"), F.coalesce("category", "difficulty").alias("value"), "n", "accuracy", "mean_delta", "pearson")


def disagreements(metas: DataFrame, first: int = 50) -> DataFrame:
    """The first rows on which judges and reference differ: a report's list."""
    return metas.where("agree = false").select("item_id", "model", "judged", "objective", "delta").orderBy("item_id", "model").limit(first)


def without_reference(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """One row over verdicts of items without a reference: n, mean_agreement, low_rate, flagged."""
    rows = verdicts.join(items.where(~F.col("has_ref")).select("item_id"), "item_id", "left_semi")
    return rows.agg(F.count("*").alias("n"), F.avg("agreement").alias("mean_agreement"), F.avg(F.col("low_agreement").cast("double")).alias("low_rate"), F.count_if("low_agreement").alias("flagged"))


def verdict_sentence(accuracy: float | None) -> str:
    if accuracy is None:
        return "No rows with a reference: reliability unknown."
    return f"Judges agree with references on {accuracy:.1%}: " + ("reliable." if accuracy >= 0.85 else "usable with spot checks." if accuracy >= 0.7 else "not reliable enough.")
