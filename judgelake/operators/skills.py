"""Routing items to skills, and per-skill clusters, problems and overviews."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelake.functions import text as T

#: Names and displays are broadcast; more of them are an error.
MOST_NAMES = 10_000


def route(items: DataFrame, skills: DataFrame) -> DataFrame:
    """item_id, skill, display: the first skill, by load_ord, that lists one of the item's categories or carries its name;
    'default' otherwise. category may be a string or an array; skills is one row per skill and category."""
    listed = F.col("category") if dict(items.dtypes)["category"].startswith("array") else F.array("category")
    exploded = items.select("item_id", F.explode_outer(listed).alias("category"))
    named = skills.select("skill", "display", "load_ord", F.col("skill").alias("category")).distinct()
    keys = skills.select("skill", "display", "load_ord", "category").unionByName(named).groupBy("category").agg(F.min_by(F.struct("skill", "display", "load_ord"), "load_ord").alias("s"))
    found = exploded.join(keys, "category", "left").groupBy("item_id").agg(F.min_by("s", "s.load_ord").alias("s"))
    return found.select("item_id", F.coalesce("s.skill", F.lit("default")).alias("skill"), F.coalesce("s.display", F.lit("通用")).alias("display"))


def keyword_counts(texts: DataFrame, group: list[str], id_col: str, text_col: str, per_text: int = 4, per_group: int = 5) -> DataFrame:
    """group, keyword, texts, rank: how many texts have a bigram among their most frequent ones; ties alphabetically. A text is one
    row (one per id), so it sends per_text rows to the shuffle."""
    top = texts.select(*group, F.explode(T.top_bigrams(F.col(text_col), per_text)).alias("keyword")).groupBy(*group, "keyword").agg(F.count("*").alias("texts"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("texts"), "keyword"))).where(F.col("rank") <= per_group)


def first_ids(rows: DataFrame, group: list[str], id_col: str = "item_id", first: int = 10) -> DataFrame:
    """group, ids: the smallest ids of each group as an array (a preview; row_number is limited before the shuffle)."""
    distinct = rows.select(*group, id_col).distinct()
    kept = distinct.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(id_col))).where(F.col("rn") <= first)
    return kept.groupBy(*group).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def bad_cases(verdicts: DataFrame, focal: str) -> DataFrame:
    return verdicts.where((F.col("model") == focal) & F.col("correctness").isin("wrong", "partial"))


def error_clusters(verdicts: DataFrame, routed: DataFrame, items: DataFrame, focal: str) -> DataFrame:
    """Per skill and error label of a model's wrong and partial answers: count, ids, keywords, representative."""
    group = ["skill", "error_label"]
    rows = bad_cases(verdicts, focal).join(routed, "item_id").join(items.select("item_id", "question"), "item_id")
    rows = rows.select("skill", T.error_label(F.col("error_type")).alias("error_label"), "item_id", "question")
    sums = rows.groupBy(*group).agg(F.count("*").alias("count"), F.substring(F.min_by("question", "item_id"), 1, 120).alias("representative"))
    words = keyword_counts(rows, group, "item_id", "question").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    words = words.select(*group, F.array_join(F.transform("k", lambda x: x["keyword"]), " ").alias("keywords"))
    return sums.join(first_ids(rows, group), group).join(words, group, "left").select(*group, "count", "representative", F.array_join("ids", ",").alias("ids"), F.coalesce("keywords", F.lit("")).alias("keywords"))


def dim_problems(dims: DataFrame, routed: DataFrame, focal: str, threshold: float = 2.0) -> DataFrame:
    """Per skill and dimension: items at or below the threshold, their share of the skill's items, a preview of ids. Missing
    scores are no problem; dimensions that any verdict calls not applicable are left out."""
    items = routed.groupBy("skill").agg(F.count("*").alias("n_items"))
    rows = dims.where(F.col("model") == focal).join(routed.select("item_id", "skill"), "item_id")
    bad = F.coalesce(F.col("mean_score") <= threshold, F.lit(False))
    sums = rows.groupBy("skill", "dim").agg(F.count_if(bad).alias("count"), F.bool_or("is_na").alias("any_na")).where(~F.col("any_na"))
    ids = first_ids(rows.where(bad), ["skill", "dim"])
    return sums.join(items, "skill").join(ids, ["skill", "dim"], "left").select(
        "skill", "dim", "count", (F.col("count") / F.col("n_items")).alias("rate"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"),
    )


def skill_overview(verdicts: DataFrame, routed: DataFrame, pairs: DataFrame, metas: DataFrame, focal: str) -> DataFrame:
    """Per skill: n_items, eval_n, right_n, problem_n, failed_n, rates, mean_total, win_rate, judge_accuracy.

    Everything that is not right is a problem; failed items have no verdict. Rates are null without rows. The
    accuracy of judges pools all models.
    """
    own = verdicts.where(F.col("model") == focal).select("item_id", "correctness", "total")
    base = routed.join(own, "item_id", "left").groupBy("skill", "display").agg(
        F.count("*").alias("n_items"), F.count("correctness").alias("eval_n"), F.count_if(F.col("correctness") == "right").alias("right_n"), F.avg("total").alias("mean_total"),
    )
    wins = pairs.where(F.col("model_a") == focal).join(routed, "item_id").groupBy("skill").agg(
        F.try_divide(F.sum("a_wins") + F.sum("ties") * 0.5, F.sum("a_wins") + F.sum("b_wins") + F.sum("ties")).alias("win_rate")
    )
    accuracy = metas.where("agree is not null").join(routed, "item_id").groupBy("skill").agg(F.avg(F.col("agree").cast("double")).alias("judge_accuracy"))
    problem = F.greatest(F.col("eval_n") - F.col("right_n"), F.lit(0))
    return base.join(wins, "skill", "left").join(accuracy, "skill", "left").select(
        "skill", "display", "n_items", "eval_n", "right_n", problem.alias("problem_n"), F.greatest(F.col("n_items") - F.col("eval_n"), F.lit(0)).alias("failed_n"),
        F.try_divide(F.col("right_n"), F.col("eval_n")).alias("right_rate"), F.try_divide(problem, F.col("eval_n")).alias("problem_rate"), "mean_total", "win_rate", "judge_accuracy",
    )


def source_mix(items: DataFrame, routed: DataFrame) -> DataFrame:
    """skill, category_source, n, share: how categories came about. category_source is dataset, or fallback_default for a
    missing or default category, unless items carry the column already."""
    given = "category_source" in items.columns
    kind = F.col("category_source") if given else F.when(F.coalesce("category", F.lit("")).isin("", "default"), "fallback_default").otherwise("dataset")
    counts = items.select("item_id", kind.alias("category_source")).join(routed, "item_id").groupBy("skill", "category_source").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("skill")))


def match_label(said: DataFrame, labels: DataFrame, fallback: str = "无法归类") -> DataFrame:
    """id, label: a classifier's free text to a skill. Text with the fallback word has none; an exact name or display wins,
    else the longest label contained, of those as long the last one in order. Null texts have none.

    labels (skill, display) is a handful of rows by nature: one row a skill; more than MOST_NAMES names and displays are an
    error. An automaton of all of them is broadcast, so that a text is read once however many labels there are.
    """
    named = labels.select("skill", F.explode(F.array("skill", "display")).alias("word")).where("word <> '' and skill is not null").groupBy("word").agg(F.max("skill").alias("skill"))
    words = named.limit(MOST_NAMES + 1).collect()
    if len(words) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} skill names and displays")
    shared = said.sparkSession.sparkContext.broadcast({r["word"]: r["skill"] for r in words})

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        skills = shared.value
        automaton = ahocorasick.Automaton()
        for word in skills:
            automaton.add_word(word, word)
        automaton.make_automaton()

        def label(text: str | None) -> str | None:
            if not skills or text is None or fallback in text:
                return None
            text = text.strip(" ")
            if text in skills:
                return skills[text]
            best = max(((len(word), skills[word]) for _, word in automaton.iter(text)), default=None)
            return best and best[1]

        for batch in batches:
            yield batch.map(label)

    return said.select("id", F.pandas_udf(found, "string")("said").alias("label"))
