"""Versioned stores and incremental verdicts: runs that break off, concurrent runs, and equality with a full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from judgelake import catalog
from judgelake.operators import incremental, results, votes
from judgelake.plans import result_queries, views
from judgelake.shipping import ship
from judgelake.sources import snapshots

from .conftest import SMALL, plain


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def test_a_run_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "run")
    assert snapshots.versions(spark, folder) == []
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, folder)
    one, two = spark.range(3).select(F.col("id").alias("n")), spark.range(5).select(F.col("id").alias("n"))
    assert snapshots.save(spark, folder, {"a": one, "b": two.limit(0)}) == 1
    broken = two.select(F.when(F.col("n") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        snapshots.save(spark, folder, {"a": two, "b": broken})  # a is written when b fails
    assert snapshots.versions(spark, folder) == [1]
    assert numbers(snapshots.load(spark, folder)["a"]) == [0, 1, 2] and numbers(snapshots.load(spark, folder)["b"]) == []
    assert snapshots.save(spark, folder, {"a": two}) == 2 and numbers(snapshots.load(spark, folder)["a"]) == [0, 1, 2, 3, 4]
    assert numbers(snapshots.load(spark, folder, 1)["a"]) == [0, 1, 2]


def test_versions_are_published_once_and_deleted(spark, tmp_path):
    folder, rows = str(tmp_path / "run"), spark.range(2).select(F.col("id").alias("n"))
    for _ in range(3):
        snapshots.save(spark, folder, {"a": rows})
    with pytest.raises(FileExistsError):
        snapshots.publish(spark, folder, {}, base=2)
    assert snapshots.versions(spark, folder) == [1, 2, 3] and not [p for p in (tmp_path / "run/versions").iterdir() if p.name.startswith("_")]
    snapshots.written(folder, rows, "left over")
    assert snapshots.delete_old(spark, folder, 2) == [1] and snapshots.versions(spark, folder) == [2, 3]
    assert len(list((tmp_path / "run/data").iterdir())) == 2 and numbers(snapshots.load(spark, folder, 2)["a"]) == [0, 1]
    with pytest.raises(ValueError):
        snapshots.delete_old(spark, folder, 0)


def made_votes(spark, seed, items):
    draw = random.Random(seed)
    rows = [(i, f"m{draw.randrange(2)}", f"j{draw.randrange(3)}", draw.choice(["right", "wrong", None, ""]), draw.choice(["a", "b", None]), draw.choice([1.0, 2.5, 4.0, None])) for i in items for _ in range(draw.randrange(1, 25))]
    dims = [(i, m, draw.choice("xyz"), draw.choice([None, 1.0, 2.0, 5.0]), draw.choice([True, False, None])) for i, m, *_ in rows for _ in range(2)]
    return spark.createDataFrame(rows, "item_id long, model string, judge string, correctness string, error_type string, total double"), spark.createDataFrame(dims, "item_id long, model string, dim string, score double, is_na boolean")


def test_added_votes_equal_a_full_recomputation(spark, tmp_path):
    folder, weights = str(tmp_path / "counts"), spark.createDataFrame([("x", 2.0), ("y", 0.5)], "dim string, weight double")
    parts = [made_votes(spark, 1, range(60)), made_votes(spark, 2, range(40, 80)), made_votes(spark, 3, [7])]
    for number, (some, dims) in enumerate(parts, 1):
        assert incremental.add_votes(spark, folder, some, dims, weights, buckets=8) == number
        every, every_dims = parts[0]
        for more, more_dims in parts[1:number]:
            every, every_dims = every.unionAll(more), every_dims.unionAll(more_dims)
        full = votes.verdicts(every, votes.verdict_dims(every_dims), weights)
        found = snapshots.load(spark, folder)["verdicts"]
        assert plain(found.select(*full.columns).collect(), full.columns) == plain(full.collect(), full.columns)
    before, after = (snapshots.manifest(spark, folder, v)["tables"]["votes"]["buckets"] for v in (2, 3))
    assert sum(before[b] != after[b] for b in before) <= 2  # item 7 has two cells: no other bucket was written again
    assert incremental.add_votes(spark, folder, parts[0][0].limit(0), parts[0][1].limit(0), weights) == 4
    assert plain(snapshots.load(spark, folder)["verdicts"].collect(), full.columns) == plain(snapshots.load(spark, folder, 3)["verdicts"].collect(), full.columns)


def test_rubrics_equal_dims_and_totals(spark):
    _, dims = made_votes(spark, 5, range(30))
    weights = spark.createDataFrame([("x", 2.0)], "dim string, weight double")
    old = votes.verdict_dims(dims)
    new = votes.rubrics(votes.dim_cells(dims), weights)
    flat = new.select("item_id", "model", F.explode("dims").alias("d")).select("item_id", "model", "d.*")
    assert plain(flat.select(*old.columns).collect(), old.columns) == plain(old.collect(), old.columns)
    totals = votes.weighted_totals(old, weights)
    assert plain(new.select(*totals.columns).collect(), totals.columns) == plain(totals.collect(), totals.columns)


@pytest.mark.parametrize("name", ["result_rows", "arbitrated_fully", "report_a", "report_b", "report_c"])
def test_a_query_reads_the_scores_once(spark, name, monkeypatch):
    ship(spark)
    read = []
    plain_frame = views.frame
    monkeypatch.setattr(views, "frame", lambda *given: read.append(given[-1]) or plain_frame(*given))
    result_queries.QUERIES[name](spark, SMALL)
    assert read.count("vote_dims") == 1


@pytest.fixture
def reads(spark, monkeypatch):
    """The views that a query reads while it is made and run, and the tables that it stores."""
    ship(spark)
    read, kept = [], {}
    plain_frame, plain_stored = views.frame, views.Views.stored
    monkeypatch.setattr(views, "frame", lambda *given: read.append(given[-1]) or plain_frame(*given))
    monkeypatch.setattr(views.Views, "stored", lambda self, **tables: (lambda found: kept.update(found) or found)(plain_stored(self, **tables)))

    def run(name):
        return catalog.QUERIES[name](spark, SMALL), read, kept

    return run


@pytest.mark.parametrize("name", ["skill_clusters", "cluster_order", "weaknesses"])
def test_what_needs_labels_only_reads_no_scores(reads, name):
    _, read, kept = reads(name)
    assert "vote_dims" not in read and {r["model"] for r in kept["labels"].select("model").distinct().collect()} == {views.FOCAL}


def test_cards_judge_the_focal_model_only(reads):
    _, _, kept = reads("case_cards")
    assert {r["model"] for r in kept["verdicts"].select("model").distinct().collect()} == {views.FOCAL}


def test_calibration_judges_items_with_a_scored_answer_only(spark, reads):
    _, _, kept = reads("calibration")
    v = views.Views(spark, SMALL)
    every, some = v.verdicts(), v.judged(items=kept["scored"].select("item_id"))
    wanted = every.join(kept["scored"], "item_id", "left_semi")
    assert 0 < some.count() < every.count() and plain(some.collect(), some.columns) == plain(wanted.select(*some.columns).collect(), some.columns)


def test_report_b_judges_no_item_it_does_not_read(spark, reads):
    _, read, kept = reads("report_b")
    items = {r["item_id"] for r in views.Views(spark, SMALL).items.where(~F.col("has_ref")).select("item_id").collect()} | {r["item_id"] for r in kept["scored"].collect()}
    assert "pair_votes" not in read and {r["item_id"] for r in kept["verdicts"].collect()} <= items


def test_report_c_scores_the_focal_model_only(reads):
    _, _, kept = reads("report_c")
    assert all({r["model"] for r in kept[name].select("model").distinct().collect()} == {views.FOCAL} for name in ("dims", "verdicts"))
    assert {r["model"] for r in kept["metas"].select("model").distinct().collect()} == {"m0", "m1", "m2"}


def test_result_rows_store_no_scores(reads):
    assert "dims" not in reads("result_rows")[2]


def test_labels_are_those_of_verdicts(spark):
    some, dims = made_votes(spark, 9, range(80))
    full, labels = votes.verdicts(some, votes.verdict_dims(dims)), votes.labels_of(votes.vote_cells(some))
    assert plain(labels.collect(), labels.columns) == plain(full.select(*labels.columns).collect(), labels.columns)


def odd_votes(spark):
    """made_votes() with judges without a name, ties, cells beyond ten votes and a dimension without any score."""
    some, dims = made_votes(spark, 11, range(40))
    more, more_dims = made_votes(spark, 12, [3] * 4)
    some = some.unionAll(more).withColumn("judge", F.when(F.col("judge") != "j1", F.col("judge")))
    return some, dims.unionAll(more_dims).unionAll(dims.limit(5).select("item_id", "model", F.lit("w"), F.lit(None).cast("double"), F.lit(True)))


@pytest.mark.parametrize("most", [0, 32])
def test_counts_in_columns_equal_counts_in_rows(spark, monkeypatch, most):
    some, dims = odd_votes(spark)
    weights = spark.createDataFrame([("x", 2.0), ("y", 0.5)], "dim string, weight double")
    monkeypatch.setattr(votes, "MOST_VALUES", most)
    rows = votes.verdicts_of(votes.vote_cells(some), votes.rubrics(votes.dim_cells(dims), weights))
    found = votes.judged(some, dims, weights)
    assert plain(found.collect(), found.columns) == plain(rows.select(*found.columns).collect(), found.columns)
    labels, own = votes.labels(some), votes.labels_of(votes.vote_cells(some))
    assert plain(labels.collect(), labels.columns) == plain(own.select(*labels.columns).collect(), labels.columns)
    flat = votes.scored(dims, weights).select("item_id", "model", F.explode("dims").alias("d")).select("item_id", "model", "d.*")
    means = votes.verdict_dims(dims)
    assert plain(flat.collect(), flat.columns) == plain(means.select(*flat.columns).collect(), flat.columns)


def test_values_that_the_first_rows_lack_are_counted_too(spark, monkeypatch):
    some, dims = odd_votes(spark)
    weights = spark.createDataFrame([("x", 2.0), ("y", 0.5)], "dim string, weight double")
    rows = votes.verdicts_of(votes.vote_cells(some), votes.rubrics(votes.dim_cells(dims), weights))
    wanted = plain(rows.collect(), rows.columns)
    monkeypatch.setattr(votes, "FIRST_ROWS", 1)
    monkeypatch.setattr(votes, "vote_cells", lambda _: pytest.fail("votes are counted by rows"))
    found = votes.judged(some, dims, weights)
    assert plain(found.select(*rows.columns).collect(), rows.columns) == wanted
    assert votes._few(some, ["judge", "correctness"]) == {"judge": [None, "j0", "j2"], "correctness": [None, "", "right", "wrong"]}
    assert votes._few_scores(dims) == {"w": [], **{d: [1.0, 2.0, 5.0] for d in "xyz"}}
    many = some.unionAll(some.withColumn("judge", F.concat(F.lit("j"), "item_id")))
    assert votes._few(many, ["judge"]) is None
    for odd in ((1, "m0", None, 1.0, False), (1, "m0", "x", float("nan"), False)):
        assert votes._few_scores(dims.unionAll(spark.createDataFrame([odd], dims.schema))) is None


@pytest.mark.parametrize("name", ["report_b"])
def test_values_are_looked_for_without_the_join_with_items(reads, monkeypatch, name):
    looked = []
    for search in ("_few", "_few_scores"):
        monkeypatch.setattr(votes, search, lambda rows, *given, found=getattr(votes, search): looked.append(plan_of(rows)) or found(rows, *given))
    reads(name)
    assert len(looked) == 2 and not any("LeftSemi" in plan for plan in looked)


def test_votes_without_any_value(spark):
    some, dims = made_votes(spark, 13, range(5))
    silent = some.withColumns({c: F.lit(None).cast("string") for c in ("judge", "correctness", "error_type")})
    for cells, scores in ((silent, dims.withColumn("score", F.lit(None).cast("double"))), (some.limit(0), dims.limit(0))):
        found, rows = votes.judged(cells, scores), votes.verdicts_of(votes.vote_cells(cells), votes.rubrics(votes.dim_cells(scores)))
        assert plain(found.collect(), found.columns) == plain(rows.select(*found.columns).collect(), found.columns)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["overview_by_model", "metas_of_answers"])
def test_votes_are_judged_without_sorting_them(spark, name):
    ship(spark)
    plan = plan_of(catalog.QUERIES[name](spark, SMALL))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["case_cards", "report_b", "skill_clusters", "cluster_order"])
def test_queries_count_votes_in_columns(reads, monkeypatch, name):
    monkeypatch.setattr(votes, "vote_cells", lambda _: pytest.fail("votes are counted by rows"))
    reads(name)


@pytest.mark.parametrize("name", ["calibration", "calibration_by_category"])
def test_few_votes_are_read_once(reads, monkeypatch, name):
    monkeypatch.setattr(votes, "_few", lambda *_: pytest.fail("votes are read for their values"))
    reads(name)


def test_opening_votes_give_the_same_rows(spark):
    rows = [(1, "m", "j1", 0, "second", False, False), (1, "m", "j0", 0, "first", False, True), (1, "m", "j0", 1, "later", True, False), (2, "m", "j2", 0, None, False, False)]
    said = spark.createDataFrame(rows, "item_id long, model string, judge string, run_idx int, rationale string, used_search boolean, truncated boolean")
    verdicts = spark.createDataFrame([(1, "m", "right", 2.0, None, True, None), (2, "m", "wrong", 1.0, "e", False, None), (3, "m", "wrong", 1.0, "e", False, None)], "item_id long, model string, correctness string, total double, error_type string, low_agreement boolean, reasons array<struct<dim_ord:int,dim:string,reason:string>>")
    full, found = results.result_rows(verdicts, said), results.result_rows(verdicts, said, opening=said.where("run_idx = 0"))
    assert plain(found.collect(), found.columns) == plain(full.collect(), full.columns) and found.where("item_id = 1").first()["rationale"] == "first"
