"""JSON Lines, pasted text, manifests and YAML in; append-only stores, CSV and traces out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelake.functions import text as T

ITEM = (
    "id string, question string, has_ref boolean, reference string, key_points array<string>, category string, difficulty string, "
    "context string, tags array<string>, trace string, media array<string>, metadata string"
)
ANSWER = "item_id string, model string, answer string, latency_ms long, tokens_in long, tokens_out long, cost double, error string, seq long"
#: Fewest fields of a pasted line, and their names, by mode.
FIELDS = {
    "single": (2, ("query", "answer", "competitor", "reference")), "compare": (3, ("query", "answer_a", "answer_b", "reference")),
    "online": (1, ("query", "reference")), "process": (3, ("query", "answer", "trace", "reference")),
}


def read_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation items of JSON Lines. Blank lines are skipped, bad ones fail the job; has_ref follows the reference;
    category becomes an array. `limit` reads no further, as asked."""
    rows = spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)
    rows = rows.limit(limit) if limit is not None else rows
    listed = F.when(F.col("category").startswith("["), F.from_json("category", "array<string>")).otherwise(F.array(F.coalesce("category", F.lit("default"))))
    return rows.withColumns({"has_ref": F.coalesce(F.length("reference") > 0, F.lit(False)), "category": listed, "difficulty": F.coalesce("difficulty", F.lit("medium"))})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files of any size: each split's lines are numbered where they are read, and the lines of the
    splits before are added. Numbers rest on both scans being cut into the same splits, as scans of one path are."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a file's splits
    counts = counts.select(F.col("file").alias("of"), F.col("block").alias("begin"), "first", before.alias("before"))
    joined = rows.join(counts, (F.col("file") == F.col("of")) & (F.col("block") == F.col("begin")))
    return joined.select(F.col("of").alias("file"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def bad_items(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of the lines of JSON Lines that are no item: no JSON object, or a field of another type. Blank lines are none."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return rows.where(F.from_json("value", f"{ITEM}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})["__bad"].isNotNull())


def checked_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """read_items(), or a ValueError that names file and line of the first bad lines."""
    bad = bad_items(spark, path).orderBy("file", "line").limit(20).collect()
    if bad:
        raise ValueError("\n".join(f"{r['file']}:{r['line']}: no item: {r['value'][:80]}" for r in bad))
    return read_items(spark, path, limit)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER).option("mode", "DROPMALFORMED").json(path)


def append(rows: DataFrame, path: str, by: str | None = "model") -> None:
    """Adds to a store; files appear only when the whole job has succeeded."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def save_run(folder: str, **tables: DataFrame) -> None:
    """A run's tables, each its own store under the folder; repeated saves replace them."""
    for name, rows in tables.items():
        overwrite(rows, f"{folder}/{name}")


def load_run(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """A saved run's tables: what reports need, without judging again."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def run_listing(spark: SparkSession, folder: str) -> DataFrame:
    """run, files, bytes: the runs under a folder (`<run>/...`) with their files, newest name first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    relative = F.regexp_extract("path", r".*?" + folder.split(":")[-1].rstrip("/").replace(".", r"\.") + r"/([^/]+)/", 1)
    return files.select(relative.alias("run"), "length").where("run <> ''").groupBy("run").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("run"))


def final_output(rounds: Column) -> Column:
    """The last content of a call's rounds (array of content) that is not empty; empty if there is none."""
    said = F.filter(rounds, lambda r: F.coalesce(r["content"], F.lit("")) != "")
    return F.coalesce(F.get(said, F.size(said) - 1)["content"], F.lit(""))


def allowed_path(path: Column, roots: list[str], suffixes: tuple[str, ...] = ("mp4", "mov", "webm", "mkv", "avi")) -> Column:
    """Whether a path is an absolute one under one of the roots, without steps back, and ends like a video."""
    under = F.lit(False)
    for root in roots:
        under = under | path.startswith(root.rstrip("/") + "/")
    return F.coalesce(under & ~path.rlike(r"(^|/)\.\.?(/|$)") & F.lower(path).rlike(r"\.(" + "|".join(suffixes) + ")$"), F.lit(False))


def pasted(lines: DataFrame, mode: str, line_col: str = "value", number_col: str = "line") -> DataFrame:
    """Lines `query ||| field ...` with their numbers: line, the mode's fields, context, error.

    A second segment `@context: ...` goes to context; blank lines are left out. error tells line number and
    first 40 characters where fields are missing, and is null otherwise.
    """
    least, names = FIELDS[mode]
    text = T.strip(F.col(line_col))
    parts = F.transform(F.split(text, r"\|\|\|", -1), T.strip)
    tagged = (F.size(parts) > 1) & F.lower(F.get(parts, F.lit(1))).startswith("@context:")
    rows = lines.where(text != "").select(F.col(number_col).alias("line"), text.alias("raw"), parts.alias("p"), F.coalesce(tagged, F.lit(False)).alias("tagged"))
    rows = rows.withColumn("context", F.when(F.col("tagged"), F.nullif(T.strip(F.substring(F.get("p", F.lit(1)), 10, 1 << 30)), F.lit(""))))
    rows = rows.withColumn("p", F.when(F.col("tagged"), F.concat(F.slice("p", 1, 1), F.slice("p", F.lit(3), F.greatest(F.size("p"), F.lit(1))))).otherwise(F.col("p")))
    short = F.size("p") < least if mode != "online" else F.get("p", F.lit(0)) == ""
    error = F.when(short, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(f": {mode} needs {least} fields: "), F.substring("raw", 1, 40)))

    def field(k: int) -> Column:
        value = F.get("p", F.lit(k))
        return F.when(~short, value if k < least else F.nullif(value, F.lit("")))

    return rows.select("line", *(field(k).alias(n) for k, n in enumerate(names)), F.when(~short, F.col("context")).alias("context"), error.alias("error"))


def manifest(lines: DataFrame, default_start: float = 7.0) -> DataFrame:
    """Lines of JSON for operation items (value, line): id, query, context, video_path, start, end, statement, error."""
    v = F.try_parse_json("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.nullif(F.trim(F.try_variant_get("v", path, "string")), F.lit("")))
    number = lambda path: F.when(kind(path).rlike("BIGINT|DOUBLE|DECIMAL"), F.try_variant_get("v", path, "double"))
    rows = lines.where(F.trim("value") != "").select("line", v.alias("v")).select(
        "line", F.col("v").isNull().alias("bad"), text("$.id").alias("id"), F.coalesce(text("$.query"), text("$.question")).alias("query"), text("$.context").alias("context"),
        text("$.video_path").alias("video_path"), F.coalesce(number("$.task_start_time"), F.lit(default_start)).alias("start"), number("$.task_end_time").alias("end"), text("$.agent_statement").alias("statement"),
        (F.try_variant_get("v", "$.task_start_time", "variant").isNotNull() & number("$.task_start_time").isNull()).alias("odd_start"),
        (F.try_variant_get("v", "$.task_end_time", "variant").isNotNull() & number("$.task_end_time").isNull()).alias("odd_end"),
    )
    repeated = rows.where("id is not null").groupBy("id").agg(F.min("line").alias("first_line"))
    rows = rows.join(repeated, "id", "left")
    error = (
        F.when(F.col("bad"), "not JSON").when(F.col("query").isNull(), "no query").when(F.col("video_path").isNull(), "no video_path")
        .when(F.col("odd_start") | F.col("odd_end"), "times must be numbers").when((F.col("start") < 0) | F.isnan("start"), "start below 0")
        .when(F.col("end").isNotNull() & ~(F.col("end") > F.col("start")), "end not after start").when(F.col("line") > F.col("first_line"), "id repeated")
    )
    return rows.select("line", "id", "query", "context", "video_path", "start", "end", "statement", error.alias("error"))


def manifest_of(lines: DataFrame, mode: str) -> DataFrame:
    """Lines of JSON (value, line) for the modes single, compare, online and process: line, query, context, the mode's fields,
    reference, category, error. Blank lines are left out."""
    v = F.try_parse_json("value")
    needed = {"single": ("answer",), "compare": ("answer_a", "answer_b"), "online": (), "process": ("answer", "trace")}[mode]
    names = {"answer_a": ("answer_a", "answerA"), "answer_b": ("answer_b", "answerB")}
    text = lambda *keys: F.coalesce(*(F.nullif(F.trim(F.try_variant_get("v", f"$.{k}", "string")), F.lit("")) for k in keys))
    rows = lines.where(F.trim("value") != "").select("line", v.alias("v"))
    kind = F.schema_of_variant(F.col("v"))
    context = F.try_variant_get("v", "$.context", "variant")
    odd = context.isNotNull() & ~F.schema_of_variant(context).isin("STRING", "VOID")
    rows = rows.select(
        "line", (F.col("v").isNull() | ~kind.startswith("OBJECT")).alias("bad"), text("question", "query").alias("query"), F.when(~odd, text("context")).alias("context"), F.coalesce(odd, F.lit(False)).alias("odd"),
        *(text(*names.get(n, (n,))).alias(n) for n in needed), *([text("competitor").alias("competitor")] if mode == "single" else []), text("reference").alias("reference"), text("category").alias("category"),
    )
    error = F.when(F.col("bad"), "not a JSON object").when(F.col("query").isNull(), "no question").when(F.col("odd"), "context must be text")
    for name in needed:
        error = error.when(F.col(name).isNull(), f"no {name}")
    return rows.withColumn("error", error).drop("bad", "odd")


def settings_from_yaml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Models, judges or rubrics of a small configuration file as a table: name, ord, weight, and the rest as JSON."""
    import json

    import yaml

    found = (yaml.safe_load(Path(path).read_text("utf-8")) or {}).get(kind) or []
    rows = [(str(e["name"]), k, float(e.get("weight", 1.0)), json.dumps({a: b for a, b in e.items() if a not in ("name", "weight")}, ensure_ascii=False, sort_keys=True)) for k, e in enumerate(found)]
    return spark.createDataFrame(rows, "name string, ord int, weight double, settings string")


def skills_from_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """(skill, display, load_ord, category) from a folder of small configuration files, by file name."""
    import yaml

    rows = []
    for order, path in enumerate(sorted(Path(folder).glob("*.yaml"))):
        found = yaml.safe_load(path.read_text("utf-8")) or {}
        name = found.get("name") or path.stem
        rows += [(name, found.get("display") or name, order, c) for c in found.get("matching_categories") or [name]]
    return spark.createDataFrame(rows, "skill string, display string, load_ord int, category string")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header behind a byte-order mark, nested columns as JSON, nulls and empty texts empty, quotes doubled; as many files as
    partitions, each with its header."""
    cells = [(F.to_json(F.col(f"`{c}`")) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`")).alias(c if k else f"\ufeff{c}") for k, (c, kind) in enumerate(rows.dtypes)]
    rows.select(*cells).write.mode("overwrite").options(header=True, nullValue="", emptyValue="", escape='"').csv(path)


def trace_results(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Judge calls with their items' results. Where both have a column the result's value wins, and the call's stays as
    call_<column> where it differs."""
    shared = [c for c in calls.columns if c in results.columns and c not in keys]
    rows = calls.select(*keys, *(F.col(c).alias(f"__{c}") for c in calls.columns if c not in keys)).join(results, keys, "left")
    own = [F.col(f"__{c}").alias(c) for c in calls.columns if c not in keys and c not in shared]
    merged = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in shared]
    kept = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")) & F.col(c).isNotNull(), F.col(f"__{c}")).alias(f"call_{c}") for c in shared]
    return rows.select(*keys, *own, *merged, *(F.col(c) for c in results.columns if c not in keys and c not in shared), *kept)
