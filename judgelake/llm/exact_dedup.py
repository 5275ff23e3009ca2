"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and get integers as
names: equal blocks share a name and different blocks never do, because names come from comparing whole
contents, not from hashing. Adjacent names are then paired, distinct pairs are sorted and named, and so on,
until each document has one name. Together with its number of blocks this name identifies its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_unique, lower_ascii, row_keys, written

BLOCK_CHARS = 1024


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with one integer each: sorted inside the partitions of a shuffle by key."""
    return rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(rid, doc_id, text_sha256, n_blocks, name) for each row; rows have equal (n_blocks, name) exactly if
    their texts are equal after lower-casing A-Z. A null text counts as empty (one empty block). rid tells
    repeated rows apart. Other columns of docs are ignored, whatever their names.
    """
    text = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
        lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
    )
    cut = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), 0)
    parts = text.select("rid", "doc_id", F.sha2(F.col("t"), 256).alias("sha"), F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(cut).alias("parts"))
    blocks = parts.select("rid", "doc_id", "sha", F.size("parts").alias("n_blocks"), F.posexplode("parts").alias("pos", "block"))
    only = text.select(F.explode(F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(cut)).alias("block"))
    current = written(
        blocks.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))).join(_named(only, ["block"]), "block")
        .select("rid", "doc_id", "sha", "n_blocks", F.col("pos").cast("long").alias("pos"), "name"), "block-names",
    )
    longest = current.agg(F.max("n_blocks")).first()[0] or 1
    done, width = [], 1
    while width < longest:
        done.append(current.where(F.col("n_blocks") <= width))
        pairs = (
            current.where(F.col("n_blocks") > width)
            .groupBy("rid", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("n_blocks").alias("n_blocks"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        current = written(
            pairs.join(_named(pairs, ["left", "right"]), ["left", "right"])
            .select("rid", "doc_id", "sha", "n_blocks", "pos", "name"), "pair-names",
        )
        width *= 2
    every = reduce(DataFrame.unionAll, [*done, current])
    return every.select("rid", "doc_id", F.col("sha").alias("text_sha256"), "n_blocks", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    Of equal texts the row with the largest id stays (null ids count as smallest); of rows that repeat that id,
    one stays. Null texts count as empty. An empty table gives no rows.
    """
    rows = block_names(docs, id_col, text_col, block_chars)
    groups = written(rows.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", (-F.col("rid")).alias("rid"))).alias("best"), F.count("*").alias("group_size")
    ), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return join_unique(rows, groups, ["n_blocks", "name"], "group_size", total).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("best.rid") == -F.col("rid")).alias("kept"), "text_sha256", "n_blocks",
    )


def keep_one_of_each(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of documents that stay, with all their columns: of equal texts one row with the largest doc_id. Rows that
    share an id but not the text are different documents; of rows equal in all columns one stays."""
    keyed = docs.select(F.struct("doc_id", *row_keys(docs)).alias("__key"), "text")
    found = exact_dedup(keyed, "__key", block_chars=block_chars).where("kept").select("doc_id.__r1", "doc_id.__r2")
    rows = docs.select("*", *row_keys(docs)).join(written(found, "kept").hint("merge"), ["__r1", "__r2"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("__r1", "__r2").orderBy(F.lit(0)))  # as the join has sorted them
    return rows.withColumn("__n", nth).where("__n = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY {_LOWER} ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256({_LOWER}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {_LOWER})
"""
