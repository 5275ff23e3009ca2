"""Mixing sources to target weights by the cube method of balanced sampling.

Each source's target gives every document of it an expected number of repeats. The whole part is taken at
once; the rest is an inclusion probability. Three units at a time, these move inside the null space of the
balancing constraints (documents and tokens) until one of them is 0 or 1, so that both totals keep their
values. Groups of bounded size do this in parallel and pass on the two units that may be left, level by
level, until a landing problem of two units a source remains.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_unique, row_keys, written

MOST_REPEATS = 3
#: Documents of one source that a task balances at once.
GROUP = 4096
_SEED = 20_240_229


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST_REPEATS) -> DataFrame:
    """From (source, size) one row per source: source, ix, docs, source_size, target.

    Sources by code point, null last, weigh `weights` in turn. They share the sum of all sizes; no target
    exceeds `most` times its source's size, and the excess goes to the others by weight until none does.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    sums = sums.withColumn("ix", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ix") % len(weights) + 1).cast("int"))
    sums = written(sums.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = float(sums.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.col("cap")
        now, fixed, free = sums.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if now == capped or not free:
            break
        capped, level = now, max(level, (total - fixed) / free)
    return sums.select("source", "ix", "docs", "source_size", F.least(F.col("w") * F.lit(level), F.col("cap")).alias("target"))


def _flight(pi: np.ndarray, size: np.ndarray, land: bool, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase on counts and sizes; with land, all of them are 0 or 1."""
    pi, size = pi.tolist(), size.tolist()
    start = list(pi)
    draws = iter(rng.random(2 * len(pi) + 8).tolist())
    held: list[int] = []

    def move(units: list[int], u: tuple[float, ...]) -> None:
        up = min(((1 - pi[k]) if d > 0 else pi[k]) / abs(d) for k, d in zip(units, u, strict=True) if d)
        down = min((pi[k] if d > 0 else (1 - pi[k])) / abs(d) for k, d in zip(units, u, strict=True) if d)
        by = up if next(draws) * (up + down) < down else -down
        for k, d in zip(units, u, strict=True):
            p = pi[k] + by * d
            pi[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p

    for k in range(len(pi)):
        if 0 < pi[k] < 1:
            held.append(k)
        while len(held) == 3:
            a, b, c = (size[j] for j in held)
            u = (float(c - b), float(a - c), float(b - a))
            move(held, u if any(u) else (1.0, -1.0, 0.0))
            held = [j for j in held if 0 < pi[j] < 1]
    if land and held:  # of the few outcomes that are left, the one nearest to the token total
        outcomes = list(itertools.product((0.0, 1.0), repeat=len(held)))
        missed = [abs(sum((o - pi[k]) * size[k] for o, k in zip(outcome, held, strict=True))) for outcome in outcomes]
        for k, value in zip(held, outcomes[int(np.argmin(missed))], strict=True):
            pi[k] = value
        # What rounding left is made good by flipping one or two more documents of this last group at a time.
        missed, chosen, widths = sum((pi[k] - p) * size[k] for k, p in enumerate(start)), np.array(pi), np.array(size, dtype=float)
        for _ in range(8):
            change = (1 - 2 * chosen) * widths
            order = np.argsort(change, kind="stable")
            wanted = -missed - change
            right = np.searchsorted(change[order], wanted)
            single = int(np.argmin(np.abs(missed + change)))
            best = (float(abs(missed + change[single])), single, -1)
            for at in (right - 1, right):
                other = order[np.clip(at, 0, len(order) - 1)]
                gap = np.where(other == np.arange(len(change)), np.inf, np.abs(missed + change + change[other]))
                k = int(np.argmin(gap))
                best = min(best, (float(gap[k]), k, int(other[k])))
            if not best[0] < abs(missed) - 1e-9:
                break
            for k in best[1:]:
                if k >= 0:
                    missed += change[k]
                    chosen[k] = 1 - chosen[k]
        pi = chosen.tolist()
    return np.array(pi)


def balanced_sample(units: DataFrame, docs: str = "docs", group: int = GROUP, seed: int = _SEED) -> DataFrame:
    """units (__r1, __r2, ix, size > 0, pi in (0, 1), number of documents of ix in `docs`, and any other columns) with pi 0 or 1.

    Depends on nothing but the rows and the seed: a row's group and its place there follow from its key, and rows with
    equal keys are equal. Each level leaves at most two units a group, so the number of groups follows without a count.
    """

    def fly(key: tuple, rows: pa.Table) -> pa.Table:
        size, r1, r2, pi = (rows[c].to_numpy() for c in ("size", "__r1", "__r2", "pi"))
        order = np.lexsort((r2, r1, -size))  # small ones land
        moved = np.empty(len(order))
        moved[order] = _flight(pi[order], size[order], rows["groups"][0].as_py() == 1, np.random.default_rng([seed, *(k.as_py() for k in key)]))
        return rows.set_column(rows.schema.get_field_index("pi"), "pi", pa.array(moved))

    units = units.withColumn("groups", F.ceil(F.col(docs) / group).cast("long"))
    done, level = [], 0
    while True:
        bucket = F.pmod(F.xxhash64("__r1", "__r2", F.lit(level)), F.col("groups")).cast("int")
        dealt = units.withColumn("level", F.lit(level)).withColumn("bucket", bucket)
        flown = written(dealt.groupBy("level", "ix", "bucket").applyInArrow(fly, dealt.schema), "flight").drop("level", "bucket")
        done.append(flown.where("pi = 0 or pi = 1"))
        units = flown.where("pi > 0 and pi < 1").withColumn("groups", F.ceil(F.col("groups") * 2 / group).cast("long"))
        level += 1
        if units.isEmpty():
            break
    return reduce(DataFrame.unionAll, done).drop("groups")


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int, group: int) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and the row key of each row of docs."""
    source = F.col("source").cast("string")
    sized = written(
        docs.select(
            *row_keys(docs), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("none"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ), "sizes",
    )
    targets = source_targets(sized.select(F.when(~F.col("none"), F.col("s")).alias("source"), "size"), weights, most)
    targets = written(targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "ix", "docs", "source_size", "target"), "targets")
    rate = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    rows = join_unique(sized, targets, ["s", "none"], "docs", sized.count()).withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).drop("rate")
    moving = (F.col("size") > 0) & (F.col("pi") > 1e-9)
    still = rows.where(~moving).withColumn("pi", F.lit(0.0))
    rows = balanced_sample(rows.where(moving), group=group, seed=seed).unionByName(still)
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.col("pi")).otherwise(0).cast("long")
    return rows.select("doc_id", F.when(~F.col("none"), F.col("s")).alias("source"), "size", "source_size", "target", repeats.alias("repeats"), "__r1", "__r2")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST_REPEATS, seed: int = _SEED, group: int = GROUP) -> DataFrame:
    """For each row of docs (doc_id, text, source; other columns only tell rows apart): doc_id, size, source_size, target,
    taken, repeats, source.

    A null text has size 0, like any text without words; such rows are never taken. A null source is a source
    of its own. Repeated rows count each. An empty table gives no rows. The result does not depend on how rows are
    partitioned or ordered.
    """
    rows = _mixed(docs, weights, most, seed, group)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "source")


def mixed_documents(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with all columns of docs. Equal rows share the number of
    times that they are taken together as evenly as can be."""
    taken = _mixed(docs, (1.0, 2.0, 3.0), MOST_REPEATS, _SEED, group).groupBy("__r1", "__r2").agg(F.sum("repeats").alias("__repeats"), F.count("*").alias("__rows"))
    taken = written(taken.where("__repeats > 0"), "repeats")
    rows = docs.select("*", *row_keys(docs)).join(taken.hint("merge"), ["__r1", "__r2"])
    nth = F.row_number().over(Window.partitionBy("__r1", "__r2").orderBy(F.lit(0)))  # as the join has sorted them
    times = F.floor(F.col("__repeats") / F.col("__rows")) + (nth <= F.col("__repeats") % F.col("__rows")).cast("int")
    rows = rows.withColumn("__times", times).where("__times > 0")
    return rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
