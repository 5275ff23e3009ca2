"""Shared helpers: tables in the cluster's shared folder, and connected components as Spark jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.shipping import shared_dir

#: Keys with more than a HOT_KEYS-th of all rows are hot: there are fewer than HOT_KEYS of them, however large the table.
HOT_KEYS = 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """The text with A-Z alone in lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/judgelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: lineage ends here."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._judgelake_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that written() returned and that nothing reads any more."""
    folder = getattr(df, "_judgelake_folder", None)
    if folder:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_unique(big: DataFrame, small: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """big joined with small, which has one row per key and in `size` the number of big's `total` rows with it. Rows of hot keys
    meet their row of small by broadcast (fewer than HOT_KEYS rows) and never gather in one task; the others are shuffled.
    Both tables are read twice. Keys are never null."""
    hot = F.col(size) * HOT_KEYS > F.lit(total)
    there = big.join(F.broadcast(small.where(hot)), keys)
    rest = big.join(F.broadcast(small.where(hot).select(*keys)), keys, "left_anti")
    return there.unionByName(rest.join(small.where(~hot).hint("merge"), keys))


def row_keys(docs: DataFrame) -> list[Column]:
    """Two columns, __r1 and __r2, of 96 bits that tell rows apart by all their values; equal rows share them."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return [F.xxhash64(*columns).alias("__r1"), F.hash(*columns).alias("__r2")]


def trim_memory() -> None:
    """Gives a Python worker's freed memory back to the system, so that reused workers do not keep a stage's peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Each step takes minima
    (combined before the shuffle) and joins them back, so that a node with many neighbours is never
    gathered into one row. Rows with a null end and loops are ignored; repeated edges count once.
    """
    current = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a <> b").select("u", "v").distinct(), "edges",
    )
    count = current.count()
    while count:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))
        large = (
            join_unique(both.where("v > u"), least, ["u"], "size", 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        joined = join_unique(large, least, ["u"], "size", large.count())
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
        following = written(small.where("u <> v").distinct(), "small-star")
        discard(large)
        now = following.count()
        same = now == count and following.join(current, ["u", "v"], "left_anti").isEmpty()
        discard(current)
        current, count = following, now
        if same:
            break
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
