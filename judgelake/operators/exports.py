"""A run's results as sheets of text cells, for all tasks at once, and as CSV files that spreadsheets open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.operators.positions import numbered

# Names of sheets and columns, and the mark of a dimension that does not apply.
ALL_SHEET, SKILL_PREFIX, FAILED_SHEET = "逐题结果", "逐题-", "评估失败"
SCORE_PREFIX, REASON_PREFIX = "维度_", "理由_"
NOT_APPLICABLE = "N/A"

#: Dimensions of configuration: an error beyond, since their names travel with every task of the job.
MOST_DIMS = 10_000


def cell(value: Column, kind: str) -> Column:
    """A value as the text of a cell: empty for null, JSON for nested values."""
    text = F.to_json(value) if kind.startswith(("array", "map", "struct")) else value.cast("string")
    return F.coalesce(text, F.lit(""))


def dim_map(dim_sets: DataFrame) -> Column:
    """dim_sets (dim_set, dim, dim_ord), a few sets of a few dimensions, as a literal map from set to its dimensions in order."""
    rows = dim_sets.orderBy("dim_set", "dim_ord").limit(MOST_DIMS + 1).collect()
    if len(rows) > MOST_DIMS:
        raise ValueError(f"more than {MOST_DIMS} dimensions")
    sets: dict[str, list[str]] = {}
    for row in rows:
        sets.setdefault(row["dim_set"], []).append(row["dim"])
    entries = [part for name, dims in sets.items() for part in (F.lit(name), F.array(*map(F.lit, dims)))]
    return F.create_map(*entries) if entries else F.expr("cast(map() as map<string, array<string>>)")


def own_dims(skill: Column, sets: Column, base: str = "base") -> Column:
    """The dimensions of a skill, or those of the set `base` where it has none of its own."""
    return F.coalesce(F.try_element_at(sets, skill), F.try_element_at(sets, F.lit(base)), F.array().cast("array<string>"))


def sheet_rows(results: DataFrame, dim_sets: DataFrame, order: str = "item_id") -> DataFrame:
    """task_id, sheet, position (from 1), header and cells (arrays of text): each result once in its task's sheet of all results and,
    unless the task compares two answers, once in the sheet of its skill or in the sheet of failures.

    results: task_id, mode, category, category_display, error, rubric (map), rubric_reasons (map), na_dimensions (array), `order`, and any
    other columns, which come first in a row, in their order. A skill's sheet has the skill's dimensions; the others have the sorted union
    of those of the skills in them. A skill is shown by the name that its first result has. A null category is `default`. A task with a
    third of all results is spread over tasks: rows are numbered part by part, and only one row a sheet is joined back.
    """
    plain = [c for c in results.columns if c not in ("rubric", "rubric_reasons", "na_dimensions", "mode")]
    kinds = dict(results.dtypes)
    sets, skill = dim_map(dim_sets), F.coalesce("category", F.lit("default"))
    failed = F.col("error").isNotNull()
    own = F.when(failed, F.struct(F.lit(2).alias("kind"), F.lit("").alias("skill"))).otherwise(F.struct(F.lit(1).alias("kind"), skill.alias("skill")))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("skill")), own)
    rows = results.select(
        F.col("task_id").alias("__task"), F.col(order).alias("__order"), F.array(*(cell(F.col(f"`{c}`"), kinds[c]) for c in plain)).alias("plain"), own_dims(skill, sets).alias("dims"),
        F.coalesce("category_display", skill).alias("shown"), F.coalesce("rubric", F.create_map().cast(kinds["rubric"])).alias("rubric"),
        F.coalesce("rubric_reasons", F.create_map().cast(kinds["rubric_reasons"])).alias("reasons"), F.coalesce("na_dimensions", F.array().cast("array<string>")).alias("na"),
        F.explode(F.when(F.col("mode") == "compare", F.slice(both, 1, 1)).otherwise(both)).alias("s"),
    ).select("*", "s.kind", "s.skill").drop("s")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("dims"))))
    heads = rows.groupBy("__task", "kind", "skill").agg(F.min_by("shown", "__order").alias("first_shown"), names.alias("names"), F.first("dims").alias("skill_dims"))
    sheet = F.when(F.col("kind") == 0, ALL_SHEET).when(F.col("kind") == 2, FAILED_SHEET).otherwise(F.concat(F.lit(SKILL_PREFIX), "first_shown"))
    sheet = F.substring(F.regexp_replace(sheet, r"[\[\]:*?/\\]", "_"), 1, 31)
    heads = heads.select(F.col("__task").alias("task"), F.col("kind").alias("k"), F.col("skill").alias("of"), sheet.alias("sheet"), F.when(F.col("kind") == 1, F.col("skill_dims")).otherwise(F.col("names")).alias("sheet_dims"))
    placed = numbered(rows, ["__task", "kind", "skill"], ["__order", "plain"], "position")
    joined = placed.join(heads, F.col("__task").eqNullSafe(F.col("task")) & (F.col("kind") == F.col("k")) & (F.col("skill") == F.col("of")))

    def scored(dim: Column) -> Column:
        there = F.array_contains("na", dim)
        score = F.coalesce(F.try_element_at("rubric", dim).cast("string"), F.lit(""))
        return F.when(there, F.array(F.lit(NOT_APPLICABLE), F.lit(""))).otherwise(F.array(score, F.coalesce(F.try_element_at("reasons", dim), F.lit(""))))

    titles = F.flatten(F.transform("sheet_dims", lambda d: F.array(F.concat(F.lit(SCORE_PREFIX), d), F.concat(F.lit(REASON_PREFIX), d))))
    return joined.select(
        F.col("__task").alias("task_id"), "sheet", F.col("position").cast("long").alias("position"), F.concat(F.array(*map(F.lit, plain)), titles).alias("header"), F.concat("plain", F.flatten(F.transform("sheet_dims", scored))).alias("cells"),
    )


def csv_line(cells: Column) -> Column:
    """Cells as a line of CSV: those with commas, quotes or line ends are quoted."""
    quoted = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, quoted), ",")


def write_sheets(rows: DataFrame, folder: str) -> None:
    """sheet_rows() as CSV under folder/task_id=.../sheet=.../: UTF-8 with a byte-order mark, the header once, lines in order over the
    files' names. Rows are range-partitioned by task, sheet and position, so that a large sheet is many files and no task's whole."""
    first = rows.where("position = 1").select("task_id", "sheet", F.lit(0).cast("long").alias("position"), F.concat(F.lit("\ufeff"), csv_line(F.col("header"))).alias("line"))
    lines = first.unionByName(rows.select("task_id", "sheet", "position", csv_line(F.col("cells")).alias("line")))
    ordered = lines.repartitionByRange("task_id", "sheet", "position").sortWithinPartitions("task_id", "sheet", "position")
    ordered.select("task_id", "sheet", "line").write.mode("overwrite").partitionBy("task_id", "sheet").option("lineSep", "\r\n").text(folder)


def union_header(rows: DataFrame, fields: str, order: str) -> list[str]:
    """The keys of the maps in a column, in the order in which they first occur. Keys are counted before they reach the driver."""
    keys = rows.select(F.col(order).alias("at"), F.posexplode(F.map_keys(fields)).alias("k", "key"))
    found = keys.groupBy("key").agg(F.min(F.struct("at", "k")).alias("first")).orderBy("first").limit(MOST_DIMS + 1).collect()
    if len(found) > MOST_DIMS:
        raise ValueError(f"more than {MOST_DIMS} columns")
    return [r["key"] for r in found]


def wide_fields(rows: DataFrame, fields: str, header: list[str]) -> DataFrame:
    """The other columns of the rows, and a text column for each key of the header, empty where a row's map lacks it."""
    rest = [c for c in rows.columns if c != fields]
    return rows.select(*rest, *(F.coalesce(F.try_element_at(F.col(fields), F.lit(k)).cast("string"), F.lit("")).alias(k) for k in header))
