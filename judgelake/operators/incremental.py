"""Verdicts kept up to date: counts of all votes so far are stored by bucket of cells, new votes are added to the counts of their
own buckets, and only the cells they touch are judged again. Votes once counted are never read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.operators.votes import CELL, dim_cells, rubrics, verdicts_of, vote_cells
from judgelake.sources import snapshots

#: Buckets of a new store; a store keeps the number it was made with.
BUCKETS = 64
_VOTES, _DIMS = [*CELL, "judge", "correctness", "error_type"], [*CELL, "dim", "score"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*CELL), F.lit(buckets)).cast("int")


def _added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    sums = [c for c in new.columns if c not in keys]
    return old.select(*new.columns).unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def _judged(votes: DataFrame, dims: DataFrame, weights: DataFrame | None) -> DataFrame:
    return verdicts_of(votes, rubrics(dims, weights))


def _replaced(folder: str, rows: DataFrame, name: str, buckets: int, touched: list[int], entry: dict) -> dict:
    """A manifest's entry in which the touched buckets are new files and the others what they were."""
    fresh = snapshots.written_buckets(folder, rows, name, _bucket(buckets))
    fresh["buckets"] = {b: p for b, p in entry["buckets"].items() if int(b) not in touched} | fresh["buckets"]
    fresh["paths"] = sorted(fresh["buckets"].values())
    return fresh


def _published(spark: SparkSession, folder: str, out: dict[str, dict], buckets: int, base: int) -> int:
    for entry in out.values():
        entry["of"] = buckets
    return snapshots.publish(spark, folder, out, base)


def add_votes(spark: SparkSession, folder: str, votes: DataFrame, vote_dims: DataFrame, weights: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Adds votes and their scored dimensions to the store under the folder and returns its new version, with tables votes and dims
    (counts) and verdicts. A vote added twice counts twice; jobs.jobs_todo() tells which are new. If another run publishes first,
    FileExistsError is raised and nothing has changed."""
    known = snapshots.versions(spark, folder)
    held = snapshots.manifest(spark, folder, known[-1]) if known else {"version": 0, "tables": {}}
    tables = held["tables"]
    buckets = tables["votes"]["of"] if tables else buckets
    made = {"votes": (vote_cells(votes), _VOTES), "dims": (dim_cells(vote_dims), _DIMS)}
    if not tables:  # the new counts are the store's, and all cells are judged
        out = {name: snapshots.written_buckets(folder, new, name, _bucket(buckets)) for name, (new, _) in made.items()}
        out["verdicts"] = snapshots.written_buckets(folder, _judged(*(snapshots.frame(spark, folder, out[n]) for n in made), weights), "verdicts", _bucket(buckets))
        return _published(spark, folder, out, buckets, 0)
    fresh = {name: snapshots.frame(spark, folder, snapshots.written(folder, new, "new")) for name, (new, _) in made.items()}
    cells = fresh["votes"].select(*CELL).unionByName(fresh["dims"].select(*CELL)).distinct()
    touched = [r["b"] for r in fresh["votes"].select(*CELL).unionByName(fresh["dims"].select(*CELL)).select(_bucket(buckets).alias("b")).distinct().collect()]  # at most `buckets` rows

    def of(entry: dict) -> DataFrame:
        return snapshots.frame(spark, folder, entry, [p for b, p in entry["buckets"].items() if int(b) in touched])

    out = {name: _replaced(folder, _added(of(tables[name]), fresh[name], keys), name, buckets, touched, tables[name]) for name, (_, keys) in made.items()}
    judged = _judged(*(of(out[name]).join(cells, CELL, "left_semi") for name in made), weights)
    rows = judged.unionByName(of(tables["verdicts"]).join(cells, CELL, "left_anti"))
    out["verdicts"] = _replaced(folder, rows, "verdicts", buckets, touched, tables["verdicts"])
    return _published(spark, folder, out, buckets, held["version"])
