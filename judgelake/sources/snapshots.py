"""Versions of a group of tables under one folder: data is written first and a manifest is published last, by one rename, so that a
version is there as a whole or not at all, and readers keep what they read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _files(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system of the folder, and a function that makes paths below it."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(folder).getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: place("/".join([folder, *parts]))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that can be loaded, oldest first; none where nothing was saved."""
    files, path = _files(spark, folder)
    if not files.exists(path("versions")):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path("versions"))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """{"version", "tables": {name: {"schema", "paths"}}} of a version, the newest unless one is given."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} under {folder}")
    return json.loads(spark.read.text(f"{folder}/versions/{known[-1] if version is None else version:010d}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, folder: str, tables: dict[str, dict], base: int | None = None) -> int:
    """Makes {name: {"schema", "paths"}} the version after `base` (the newest unless given). FileExistsError if somebody else has
    published that version meanwhile: then nothing has changed and the work can be done again on theirs."""
    files, path = _files(spark, folder)
    known = versions(spark, folder)
    version = (base if base is not None else known[-1] if known else 0) + 1
    draft, final = path("versions", f"_{uuid.uuid4().hex}"), path("versions", f"{version:010d}.json")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:  # unlike a plain rename, this one never replaces a file
        context.rename(files.makeQualified(draft), files.makeQualified(final), spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0))
    except Exception as error:
        files.delete(draft, False)
        if files.exists(final):
            raise FileExistsError(f"version {version} under {folder} was published by another run") from error
        raise
    return version


def written(folder: str, rows: DataFrame, name: str) -> dict:
    """A table's rows as new files under the folder: an entry of a manifest."""
    target = f"data/{uuid.uuid4().hex}/{name}"
    rows.write.parquet(f"{folder}/{target}")
    return {"schema": rows.schema.jsonValue(), "paths": [target]}


def written_buckets(folder: str, rows: DataFrame, name: str, bucket: Column) -> dict:
    """As written(), in one path for each bucket that has rows; `buckets` says which."""
    target, spark = f"data/{uuid.uuid4().hex}/{name}", rows.sparkSession
    rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/{target}")
    files, path = _files(spark, folder)
    found = {n.removeprefix("__bucket="): f"{target}/{n}" for n in (s.getPath().getName() for s in files.listStatus(path(target))) if n.startswith("__bucket=")}
    return {"schema": rows.schema.jsonValue(), "paths": sorted(found.values()), "buckets": found}


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """A new version with these tables, returned by number. A run that ends before the last table is written leaves the old one."""
    base = (versions(spark, folder) or [0])[-1]
    return publish(spark, folder, {name: written(folder, rows, name) for name, rows in tables.items()}, base)


def frame(spark: SparkSession, folder: str, entry: dict, paths: list[str] | None = None) -> DataFrame:
    """The rows of a manifest's entry, or of some of its paths."""
    wanted, schema = entry["paths"] if paths is None else paths, StructType.fromJson(entry["schema"])
    return spark.read.schema(schema).parquet(*(f"{folder}/{p}" for p in wanted)) if wanted else spark.createDataFrame([], schema)


def load(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """A version's tables by name."""
    return {name: frame(spark, folder, entry) for name, entry in manifest(spark, folder, version)["tables"].items()}


def delete_old(spark: SparkSession, folder: str, keep: int = 1) -> list[int]:
    """Deletes all but the last `keep` versions, and then the data that none of these holds; returns the versions deleted. Data that
    no manifest ever held (of runs that failed) goes as well, so no run may be saving meanwhile."""
    if keep < 1:
        raise ValueError("at least one version stays")
    files, path = _files(spark, folder)
    known = versions(spark, folder)
    for version in known[:-keep]:
        files.delete(path("versions", f"{version:010d}.json"), False)
    held = {p.split("/")[1] for version in known[-keep:] for entry in manifest(spark, folder, version)["tables"].values() for p in entry["paths"]}
    for status in files.listStatus(path("data")) if files.exists(path("data")) else []:
        if status.getPath().getName() not in held:
            files.delete(status.getPath(), True)
    return known[:-keep]


def scored_once(spark: SparkSession, folder: str, prompts: DataFrame, score: Callable[[DataFrame], DataFrame], name: str = "scores") -> tuple[DataFrame, int]:
    """All scores stored under the folder, one row a prompt, and how many were made now.

    prompts: key, prompt; rows of one key are one prompt (take a hash of the prompt as key). score() gets the prompts without a
    score and returns key and further columns; what it returns is written once and published as a whole, so that a run
    that fails or is repeated scores no prompt twice, and prompts that it leaves out are tried again by the next run.
    """
    known = versions(spark, folder)
    held = manifest(spark, folder, known[-1]) if known else {"version": 0, "tables": {}}
    todo = prompts.where("key is not null").groupBy("key").agg(F.min("prompt").alias("prompt"))
    if name in held["tables"]:
        todo = todo.join(frame(spark, folder, held["tables"][name]), "key", "left_anti")
    entry = written(folder, score(todo), name)
    made = frame(spark, folder, entry).count()
    if made:
        entry["paths"] += held["tables"].get(name, {"paths": []})["paths"]
        publish(spark, folder, held["tables"] | {name: entry}, held["version"])
    else:
        entry = held["tables"].get(name, entry)
    return frame(spark, folder, entry), made
