"""From pasted rows to evaluation items, and from items and judges to the dimensions they are scored on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_items(rows: DataFrame, position: str = "line") -> DataFrame:
    """Pasted rows (files.pasted) as evaluation items: id, question, context, has_ref, reference, category, trace, answer, competitor,
    frames. Rows without an id get `q<position>`, rows without a category `default`; has_ref follows the reference, and frames of
    recordings are kept where there are some. Rows with an error are no items."""
    there = lambda name, kind="string": F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    rows = rows.where("error is null") if "error" in rows.columns else rows
    frames = there("frames", "array<string>")
    return rows.select(
        F.coalesce(there("id"), F.concat(F.lit("q"), F.col(position).cast("string"))).alias("id"), F.coalesce(there("query"), there("question")).alias("question"), there("context").alias("context"),
        (F.coalesce(there("reference"), F.lit("")) != "").alias("has_ref"), there("reference").alias("reference"), F.coalesce(there("category"), F.lit("default")).alias("category"), there("trace").alias("trace"),
        F.coalesce(there("answer"), there("answer_a")).alias("answer"), F.coalesce(there("competitor"), there("answer_b")).alias("competitor"), F.when(F.size(frames) > 0, frames).alias("frames"),
    )


def scoring_dims(assigned: DataFrame, dim_sets: DataFrame) -> DataFrame:
    """The rows of assigned (with mode, persona, skill, trace, competitor) once for each dimension that they are scored on: the
    scoring (operation, process, compare or result), dim_set, dim and dim_ord beside their columns.

    Recordings are scored on the set `operation`; processes on the set `process` if they have a trace; product experts compare
    where there is a competitor's answer; the rest by result. Both of the latter use the skill's own set, and all use the
    set `base` where theirs is missing. dim_sets (dim_set, dim, dim_ord) is configuration: a few sets of a few dimensions.
    """
    known = F.broadcast(dim_sets.agg(F.collect_set("dim_set").alias("known")))  # one row of a few names
    filled = lambda name: F.coalesce(F.trim(name), F.lit("")) != ""
    has = lambda name: F.array_contains("known", name)
    process = F.coalesce((F.col("mode") == "process") & has(F.lit("process")) & filled("trace"), F.lit(False))
    compare = F.coalesce((F.col("persona") == "product_expert") & filled("competitor"), F.lit(False))
    scoring = F.when(F.col("mode") == "operation", "operation").when(process, "process").when(compare, "compare").otherwise("result")
    own = F.when(F.col("scoring").isin("operation", "process"), F.col("scoring")).otherwise(F.col("skill"))
    rows = assigned.crossJoin(known).withColumn("scoring", scoring).withColumn("dim_set", F.when(F.coalesce(has(own), F.lit(False)), own).otherwise("base")).drop("known")
    return rows.join(F.broadcast(dim_sets), "dim_set")


def classified_once(items: DataFrame, labels: DataFrame) -> DataFrame:
    """items (id, category, key) with category and category_source: their own (dataset), the label of their key (auto_classified), or
    default (fallback_default). labels: key, label, one row a key."""
    own = (F.coalesce("category", F.lit("")) != "") & (F.col("category") != "default")
    rows = items.join(labels.select("key", "label"), "key", "left")
    source = F.when(own, "dataset").when(F.col("label").isNotNull(), "auto_classified").otherwise("fallback_default")
    return rows.withColumn("category_source", source).withColumn("category", F.when(own, F.col("category")).otherwise(F.coalesce("label", F.lit("default")))).drop("label")
