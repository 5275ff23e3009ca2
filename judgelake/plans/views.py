"""Evaluation-shaped views of one data folder, shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake.fixtures import frame, table
from judgelake.operators import calibration, pairs, skills, votes
from judgelake.shipping import shared_dir
from judgelake.sources import files

FOCAL = "m0"
#: Configuration: what each dimension weighs.
WEIGHTS = {"accuracy": 1.5, "completeness": 1.0, "safety": 0.5}
DIMS = list(WEIGHTS)
#: Fewer than any item's events at the sizes at hand, so that the bound acts.
KEPT_EVENTS = 50


class Views:
    """Intermediate results of one data folder; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, view: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, view)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def dims(self) -> DataFrame:
        return votes.verdict_dims(self.vote_dims)

    def weights(self) -> DataFrame:
        return self.spark.createDataFrame(list(WEIGHTS.items()), "dim string, weight double")

    def verdicts(self, carry: tuple[str, ...] = ()) -> DataFrame:
        return votes.judged(self.votes, self.vote_dims, self.weights(), carry=carry)

    def stored(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """Tables that several parts of a query read: made once, written to the shared folder and read again."""
        folder = f"{shared_dir(self.spark)}/judgelake/stored-{uuid.uuid4().hex}"
        files.save_run(folder, **tables)
        return files.load_run(self.spark, folder, list(tables))

    def verdicts_of(self, dims: DataFrame) -> DataFrame:
        return votes.verdicts_of(votes.vote_cells(self.votes), votes.rubrics_of(dims, self.weights()))

    def judged(self, model: str | None = None, items: DataFrame | None = None) -> DataFrame:
        """verdicts() of one model, or of the items given (item_id): votes on others are left out before they are counted."""
        every = _of(self.votes, model, None), _of(self.vote_dims, model, None)
        # Values are looked for without the join with items, which would move all votes once more.
        return votes.judged(*(_of(rows, None, items) for rows in every), self.weights(), among=every)

    def labels(self, model: str | None = None, items: DataFrame | None = None) -> DataFrame:
        """correctness and error_type of judged(), which need no scores."""
        return votes.labels(_of(self.votes, model, items))

    def stored_labels(self, model: str | None = None) -> DataFrame:
        return self.stored(labels=self.labels(model))["labels"]

    def stored_verdicts(self, model: str | None = None) -> DataFrame:
        return self.stored(verdicts=self.judged(model))["verdicts"]

    def scored(self) -> DataFrame:
        """Answers held against references, stored, so that Spark knows how few they may be beside the votes."""
        return self.stored(scored=calibration.scored_answers(self.qa))["scored"]

    def pairs(self) -> DataFrame:
        return pairs.pair_results(self.pair_votes)

    def metas(self) -> DataFrame:
        scored = self.scored()
        few = lambda rows: _of(rows, None, scored.select("item_id"))
        # So few votes are left that counting them by rows costs less than reading all of them twice, as judged() would.
        judged = votes.verdicts_of(votes.vote_cells(few(self.votes)), votes.rubrics_of(votes.verdict_dims(few(self.vote_dims)), self.weights()))
        return calibration.metas_of_scored(scored, judged)

    def metas_of(self, verdicts: DataFrame) -> DataFrame:
        return calibration.metas(self.qa, verdicts)

    def agreements(self) -> DataFrame:
        """Whether judges agree with references, without the scores of metas()."""
        scored = self.scored()
        return calibration.agreements(scored, votes.labels_of(votes.vote_cells(_of(self.votes, None, scored.select("item_id")))))

    def routed(self) -> DataFrame:
        return skills.route(self.items, self.skills)


def _of(rows: DataFrame, model: str | None, items: DataFrame | None) -> DataFrame:
    rows = rows if model is None else rows.where(F.col("model") == model)
    return rows if items is None else rows.join(items, "item_id", "left_semi")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def micros() -> F.Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")


def frames(v: Views) -> DataFrame:
    sig = F.array((F.col("event_id") % 4) / 40.0, F.floor(F.col("event_id") / 50) % 2 / 2.0)
    return v.table("events").select(F.col("user_id").alias("video_id"), F.col("event_id").cast("double").alias("t"), sig.alias("sig"), F.array(F.floor(F.col("event_id") / 50) % 2 / 10.0).alias("shell"), (F.col("event_type") == "signup").alias("protected"), (F.col("event_id") % 3).alias("priority"), F.col("value").alias("novelty"))


def query(build, digits: int = 6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Views(spark, sf_dir)), digits)

    return run
