"""The three reports and the export as row-sets (section, key, detail, metric, value), composed from a run's stored tables.

A report is small: one row a model, slice, skill or cluster, and lists of fixed length. Its parts read verdicts, dims, pairs and
metas several times, so pass tables that are stored (see sources.files.save_run), which is also how a run is reported again
without judging.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.operators import calibration, cases, pairs, skills, slices
from judgelake.operators.results import ordered_clusters

OVERVIEW = ["n", "mean_total", "norm_mean", *(f"{c}_n" for c in slices.LABELS), "low_rate"]


def long(rows: DataFrame, section: str, key: Column, detail: Column, metrics: list[str]) -> DataFrame:
    """Each metric of each row as a row of its own."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    out = rows.select(F.lit(section).alias("section"), key.cast("string").alias("key"), detail.cast("string").alias("detail"), F.explode(cells).alias("c"))
    return out.select("section", "key", "detail", "c.metric", "c.value")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def report_a(run: dict[str, DataFrame], focal: str) -> DataFrame:
    """Models against each other: overviews, win rates, dimension gaps, best and worst cases, disagreements, weaknesses."""
    none, items = F.lit(""), run["items"]
    own = run["verdicts"].where(F.col("model") == focal).join(items.select("item_id", "category"), "item_id")
    rates = pairs.win_rates(run["pairs"].where(F.col("model_a") == focal))
    by_category = pairs.win_rates(run["pairs"].where(F.col("model_a") == focal).join(run["pair_items"], "item_id"), ["category"])
    return _all(
        long(slices.overview(run["verdicts"], ["model"]), "model", F.col("model"), none, OVERVIEW),
        long(rates, "winrate", F.col("model_b"), none, ["n_items", "win_rate", "inconsistent_items"]),
        long(by_category, "winrate_by_category", F.col("model_b"), F.col("category"), ["win_rate"]),
        long(slices.dim_gaps(run["dims"], run["verdicts"], focal), "dim_gap", F.col("other"), F.col("dim"), ["gap"]),
        long(slices.overview(own, ["category"]), "focal_by_category", F.col("category"), none, ["n", "mean_total"]),
        long(cases.best_and_worst(run["pairs"], focal), "case", F.concat("side", F.lit(" "), "rank"), F.col("item_id"), ["rate"]),
        long(cases.lowest_agreement(run["verdicts"]), "disagreement", F.col("item_id"), F.col("model"), ["agreement"]),
        long(cases.weaknesses(run["verdicts"], items, focal), "weakness", F.col("error_type"), F.col("category"), ["count"]),
        cases.advice_rows(rates, slices.dim_means(run["verdicts"].where(F.col("model") == focal), run["dims"], ["model"]), slices.overview(run["verdicts"].where(F.col("model") == focal), ["model"])),
    )


def report_b(run: dict[str, DataFrame]) -> DataFrame:
    """Judges against references: accuracy, bias and correlation, by category and difficulty, and answers without a reference."""
    none, whole = F.lit(""), calibration.reliability(run["metas"])
    return _all(
        long(whole, "summary", F.col("bias"), none, ["n", "accuracy", "mean_delta", "pearson"]),
        long(calibration.reliability_by(run["metas"], run["items"]), "accuracy_by", F.col("kind"), F.col("value"), ["n", "accuracy"]),
        long(calibration.without_reference(run["verdicts"], run["items"]), "without_reference", none, none, ["n", "mean_agreement", "low_rate", "flagged"]),
        long(calibration.disagreements(run["metas"]), "disagreement", F.col("item_id"), F.col("model"), ["delta"]),
        long(whole, "conclusion", conclusion(F.col("accuracy")), none, ["accuracy"]),
    )


def conclusion(accuracy: Column) -> Column:
    return F.when(accuracy.isNull(), "unknown").when(accuracy >= 0.85, "reliable").when(accuracy >= 0.7, "usable with spot checks").otherwise("not reliable enough")


def domain_overview(run: dict[str, DataFrame], focal: str) -> DataFrame:
    """The skills' overview with the first cluster of errors and how many items fell back to the default category."""
    base = skills.skill_overview(run["verdicts"], run["routed"], run["pairs"], run["metas"], focal)
    first = ordered_clusters(skills.error_clusters(run["verdicts"], run["routed"], run["items"], focal)).where("place = 1").select("skill", F.col("error_label").alias("first_cluster"))
    fallback = skills.source_mix(run["items"], run["routed"]).where("category_source = 'fallback_default'").select("skill", F.col("share").alias("fallback_share"))
    rows = base.join(first, "skill", "left").join(fallback, "skill", "left").withColumn("fallback_share", F.coalesce("fallback_share", F.lit(0.0)))
    return rows.withColumn("first_cluster", F.coalesce("first_cluster", F.lit("—"))).withColumn("fallback_count", F.bround(F.col("n_items") * F.col("fallback_share")).cast("long"))


def report_c(run: dict[str, DataFrame], focal: str) -> DataFrame:
    """By skill: overview, clusters in order, problems by dimension and where categories came from. run may hold the cells of all
    models by themselves; then verdicts and dims of the focal model do, and of metas whether they agree."""
    none = F.lit("")
    clusters = ordered_clusters(skills.error_clusters(run["verdicts"], run["routed"], run["items"], focal))
    return _all(
        long(domain_overview(run, focal), "overview", F.col("skill"), F.col("first_cluster"), ["n_items", "eval_n", "right_n", "problem_n", "failed_n", "right_rate", "problem_rate", "mean_total", "win_rate", "judge_accuracy", "fallback_count"]),
        long(clusters, "cluster", F.col("skill"), F.col("error_label"), ["place", "count"]),
        long(skills.dim_problems(run["dims"], run["routed"], focal), "dim_problem", F.col("skill"), F.col("dim"), ["count", "rate"]),
        long(skills.source_mix(run["items"], run["routed"]), "source", F.col("skill"), F.col("category_source"), ["n", "share"]),
        long(run.get("cells", run["verdicts"]).agg(F.count("*").alias("verdicts"), F.count_distinct("model").alias("models")), "run", none, none, ["verdicts", "models"]),
    )


def markdown(report: DataFrame, title: str, most: int = 1000) -> str:
    """A report's rows as a table in Markdown; ValueError beyond `most` rows, which belong into a file."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [f"# {title}", "", "| section | key | detail | metric | value |", "|-|-|-|-|-|"]
    return "\n".join([*lines, *(f"| {r['section']} | {r['key']} | {r['detail']} | {r['metric']} | {'—' if r['value'] is None else f'{r[4]:.4g}'} |" for r in sorted(rows, key=str))])
