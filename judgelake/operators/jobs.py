"""What is left to do: candidate jobs, done sets and latest rows of append-only stores; exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelake.functions import text as T
from judgelake.operators.positions import numbered

#: The list of models goes into the plan; a longer one is an error.
MOST_MODELS = 10_000


def usable(answers: DataFrame) -> DataFrame:
    return answers.where("error is null and answer <> ''")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: one aggregate with map-side combine."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return found.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def latest_answers(answers: DataFrame, order: list[str]) -> DataFrame:
    """Of each (item_id, model) the latest usable row, else the latest one."""
    rows = answers.withColumn("ok", F.col("error").isNull() & (F.coalesce("answer", F.lit("")) != ""))
    return latest(rows, ["item_id", "model"], ["ok", *order])


def todo(items: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """(item_id, model) pairs that are not done. models is the list of models under test, one row each; more than MOST_MODELS
    are an error."""
    names = [r[0] for r in models.select("model").distinct().limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    jobs = items.select("item_id").withColumn("model", F.explode(F.array(*map(F.lit, sorted(names, key=lambda n: (n is not None, n or ""))))))
    return jobs.join(done.select("item_id", "model").distinct(), ["item_id", "model"], "left_anti")


def pair_jobs(items: DataFrame, answers: DataFrame, focal: str, done: DataFrame, also_with_reference: bool = False) -> DataFrame:
    """(item_id, model_a, model_b): both answers usable, no reference unless asked, not compared yet."""
    good = usable(answers).select("item_id", "model").distinct()
    eligible = items if also_with_reference else items.where(~F.col("has_ref"))
    own = good.where(F.col("model") == focal).select("item_id", F.col("model").alias("model_a"))
    other = good.where(F.col("model") != focal).select("item_id", F.col("model").alias("model_b"))
    rows = eligible.select("item_id").join(own, "item_id").join(other, "item_id")
    return rows.join(done.select("item_id", "model_a", "model_b").distinct(), ["item_id", "model_a", "model_b"], "left_anti")


def rubric_pivot(dims: DataFrame, names: list[str]) -> DataFrame:
    """item_id, model and one column a dimension: its score as text, N/A, or empty."""
    cell = F.when(F.col("is_na"), "N/A").otherwise(F.coalesce(F.bround("mean_score", 2).cast("string"), F.lit("")))
    rows = dims.withColumn("cell", cell).groupBy("item_id", "model").pivot("dim", names).agg(F.first("cell"))
    return rows.select("item_id", "model", *(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))


def chart_rows(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Two lists beside each other, padded to the longer: position, l and r as structs. Positions are counted part by part."""

    def number(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.struct(*df.columns).alias(name), F.struct(order, *[c for c in df.columns if c != order]).alias("__order"))
        return numbered(rows, [], ["__order"]).select((F.col("position") - 1).alias("position"), name)

    return number(left, "l").join(number(right, "r"), "position", "full")


def run_summary(verdicts: DataFrame, items: DataFrame, metas: DataFrame, model: str, scale: int = 5) -> DataFrame:
    """One row: total, done, failed, right_n, problem_n, accuracy, mean_total, norm_mean, judge_accuracy. The last counts
    rows with unknown agreement in its denominator."""
    own = verdicts.where(F.col("model") == model)
    left = items.select("item_id").join(own.select("item_id", "correctness", F.col("total").alias("points")), "item_id", "left")
    sums = left.agg(
        F.count("*").alias("total"), F.count("correctness").alias("done"), F.count_if(F.col("correctness") == "right").alias("right_n"), F.avg("points").alias("m"),
    )
    judged = metas.where(F.col("model") == model).agg(F.try_divide(F.count_if("agree"), F.count("*")).alias("judge_accuracy"))
    return sums.crossJoin(judged).select(  # one row by one row
        "total", "done", (F.col("total") - F.col("done")).alias("failed"), "right_n", (F.col("done") - F.col("right_n")).alias("problem_n"),
        F.bround(F.try_divide(F.col("right_n"), F.col("done")), 3).alias("accuracy"), F.bround("m", 2).alias("mean_total"), F.bround(F.col("m") / scale, 3).alias("norm_mean"),
        F.bround("judge_accuracy", 3).alias("judge_accuracy"),
    )


def interleave(hits: DataFrame, query: str = "query_id", most: int = 10) -> DataFrame:
    """Search hits (query, provider_ord, rank, url, title, snippet) merged round robin over providers: of equal hits the
    first stays, and twice `most` remain, the feature's limit."""
    keyed = hits.withColumn("key", T.dedupe_key(F.col("url"), F.col("title"), F.col("snippet")))
    first = keyed.groupBy(query, "key").agg(F.min(F.struct("rank", "provider_ord", "url", "title")).alias("h"))
    rows = first.select(query, "h.rank", "h.provider_ord", "h.url", "h.title", "key")
    place = F.row_number().over(Window.partitionBy(query).orderBy("rank", "provider_ord", "key"))
    return rows.withColumn("place", place).where(F.col("place") <= 2 * most)
