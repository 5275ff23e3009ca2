"""Result, report, store, media and source operators on small tables, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from judgelake import scoring
from judgelake.functions import judgement
from judgelake.operators import jobs, pairs, reports, results, timeline
from judgelake.plans.views import FOCAL, Views
from judgelake.shipping import ship
from judgelake.sources import files

from .conftest import SMALL


def test_browse_failures_and_pages(spark):
    rows = spark.createDataFrame([(k, "a" if k % 2 else None, "x" if k % 5 == 0 else None, "Right", "Some TEXT") for k in range(23)], "item_id int, category string, error string, correctness string, query string")
    assert sorted(r["item_id"] for r in results.browse(rows, "__error__").collect()) == [0, 5, 10, 15, 20]
    assert results.browse(rows, query=" some text ", columns=("query", "category")).count() == 23 and results.browse(rows, query="%", columns=("query",)).count() == 0
    assert [r["item_id"] for r in results.page(rows, "item_id", 99).collect()] == [20, 21, 22] and results.page(rows.where("false"), "item_id", 1).count() == 0


def test_assignments_need_a_judge_for_every_item(spark):
    judges = spark.createDataFrame([("e", 0, "product_expert"), ("s", 1, None)], "judge string, ord int, persona string")
    items = spark.createDataFrame([(1, "b"), (2, None)], "item_id int, competitor string")
    assert sorted((r["item_id"], r["judge"], r["persona"]) for r in results.assignments(items, judges, ["e", "s"]).collect()) == [(1, "e", "product_expert"), (1, "s", "balanced"), (2, "s", "balanced")]
    with pytest.raises(ValueError):
        results.assignments(items, judges, ["e"])
    assert results.assignments(items.where("item_id = 1"), judges, ["unknown"]).count() == 1


def test_too_many_votes_for_a_prompt_are_an_error(spark):
    votes = spark.createDataFrame([(1, "m", "j", k, "right", 1.0) for k in range(4)], "item_id int, model string, judge string, run_idx int, correctness string, total double")
    assert results.judges_summary(votes).first()["summary"].count(";") == 3
    with pytest.raises(Exception, match="too many votes"):
        results.judges_summary(votes, 3).collect()


def test_reports_again_without_judging(spark, tmp_path):
    ship(spark)
    v = Views(spark, SMALL)
    folder = str(tmp_path / "run")
    files.save_run(folder, verdicts=v.verdicts(), dims=v.dims(), pairs=v.pairs(), items=v.items, pair_items=v.pair_items, routed=v.routed())
    names = ["verdicts", "dims", "pairs", "items", "pair_items", "routed"]
    first = reports.report_a(files.load_run(spark, folder, names), FOCAL).collect()
    assert sorted(first, key=str) == sorted(reports.report_a(files.load_run(spark, folder, names), FOCAL).collect(), key=str)
    text = reports.markdown(spark.createDataFrame(first), "A")
    assert text.startswith("# A\n") and text.count("\n") == len(first) + 3
    with pytest.raises(ValueError):
        reports.markdown(spark.createDataFrame(first), "A", 3)
    listing = files.run_listing(spark, str(tmp_path)).collect()
    assert [r["run"] for r in listing] == ["run"] and listing[0]["files"] >= 6


def test_manifests_of_each_mode(spark):
    lines = ['{"query": "q", "answer": "a", "competitor": "c", "reference": "r"}', '{"question": "q"}', "", '{"question": "q", "answer": "a", "trace": "t", "context": "  "}', "null", '{"question": 5, "answer": "a"}']
    frame = spark.createDataFrame(list(enumerate(lines, 1)), "line int, value string")
    errors = lambda mode: {r["line"]: r["error"] for r in files.manifest_of(frame, mode).collect()}
    assert errors("single") == {1: None, 2: "no answer", 4: None, 5: "not a JSON object", 6: None}
    assert errors("online") == {1: None, 2: None, 4: None, 5: "not a JSON object", 6: None}
    assert errors("process") == {1: "no trace", 2: "no answer", 4: None, 5: "not a JSON object", 6: "no trace"}


def test_settings_and_numbered_lines(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "judges.yaml").write_text("judges:\n- name: a\n  persona: strict\n- name: b\n  weight: 2\n")
    assert [(r["name"], r["ord"], r["weight"], json.loads(r["settings"])) for r in files.settings_from_yaml(spark, str(tmp_path / "judges.yaml"), "judges").collect()] == [("a", 0, 1.0, {"persona": "strict"}), ("b", 1, 2.0, {})]
    (tmp_path / "lines.txt").write_text("".join(f"l{k}\n" for k in range(5000)))
    assert {r["line"]: r["value"] for r in files.numbered_lines(spark, str(tmp_path / "lines.txt")).collect()} == {k + 1: f"l{k}" for k in range(5000)}


def test_arithmetic_follows_python():
    draw = random.Random(6)
    for _ in range(400):
        text = str(draw.randrange(9))
        for _ in range(draw.randrange(5)):
            piece = draw.choice(["+", "-", "*", "/", "//", "%", "**"])
            text = f"({text})" if draw.random() < 0.2 else text
            text += f" {piece} {draw.choice(['', '-', '(1 + 1) * '])}{draw.randrange(4)}{draw.choice(['', '.5'])}"
        try:
            expected = eval(text)  # noqa: S307 - made above
        except (ArithmeticError, OverflowError):
            expected = None
        if isinstance(expected, complex) or expected is None or abs(expected) > 1e200:
            continue
        assert scoring.arithmetic(text) == pytest.approx(expected)
    for bad in ("", "(1", "1)", "1 2", "1 +", "x", "()", "9 ** 9 ** 9", "(-8) ** 0.5", "1 // 0"):
        with pytest.raises(ValueError):
            scoring.arithmetic(bad)


def test_judgements_with_odd_numbers():
    for value in ("NaN", "1e999", "-Infinity", "true", '"5"'):
        assert judgement.parse_one('{"rubric": {"a": ' + value + ', "b": 3}}')["total"] == 3.0
    assert judgement.flattened({"x": None, "y": 3, "z": 4}, ["p", "q"]) == [("p", 3.0, False, None), ("q", 4.0, False, None)]
    assert json.loads(judgement.repaired('{"a": "he said "so"' + " " * 500 + 'and left"}'))["a"].startswith('he said "so"')


def test_bootstrap_covers_the_rate(spark):
    ship(spark)
    votes = spark.createDataFrame([(k, "a", "b", "ab", "a" if k % 10 < 7 else "b") for k in range(1000)] + [(1, "a", "c", "ab", "tie")], "item_id int, model_a string, model_b string, pres_order string, raw_winner string")
    found = {r["model_b"]: r for r in pairs.bootstrap_intervals(votes, vote_id="item_id").collect()}
    assert found["b"]["low"] < 0.7 < found["b"]["high"] and found["b"]["high"] - found["b"]["low"] == pytest.approx(2 * 1.96 * math.sqrt(0.21 / 1000), rel=0.3)
    assert found["c"]["low"] is None


def test_task_end_and_key_frames(spark):
    """Two seconds of home, ten of a task, four of home again: the task ends with its last frame."""
    ship(spark)
    rows = [("v", float(t), [0.9, 0.9] if 3 <= t <= 12 else [0.1, 0.1], [0.5] if 3 <= t <= 12 else [0.0], False, 3, 0.0) for t in range(17)]
    frames = spark.createDataFrame([*rows, ("w", 0.0, [0.0, 0.0], [0.0], False, 3, 0.0)], "video_id string, t double, sig array<double>, shell array<double>, protected boolean, priority int, novelty double")
    assert [(r["video_id"], r["end"], round(r["confidence"], 6)) for r in timeline.task_end(frames).collect()] == [("v", 12.0, 1.0)]
    chosen = sorted((r["video_id"], r["t"]) for r in timeline.key_frames(frames, most=4).collect())
    assert ("v", 12.0) in chosen and ("w", 0.0) in chosen and len([c for c in chosen if c[0] == "v"]) <= 4


def test_fallback_count_follows_the_shown_share(spark):
    """A share of 1/7 shown with six digits differs by more than a row from a few million rows on; two digits show it on 700."""
    rows = spark.range(700).select(F.lit("a").alias("category"), F.lit(None).cast("string").alias("error"), F.lit("right").alias("correctness"), F.lit(1.0).alias("total"), F.when(F.col("id") % 7 == 0, "fallback_default").otherwise("dataset").alias("category_source"), F.lit(True).alias("agree"), F.lit(None).cast("string").alias("error_type"))
    assert results.web_overview(rows).first()["fallback_count"] == 100
    shown = results.web_overview(rows, digits=2).first()
    assert (shown["fallback_share"], shown["fallback_count"]) == (0.14, 98)
    assert results.fallback_share(results.web_overview(rows, digits=2)).first()["fallback"] == 98


def test_chart_rows_pad_the_shorter_list(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "n int, l string"), spark.createDataFrame([(9, "q")], "n int, r string")
    found = {r["position"]: (r["l"] and r["l"]["l"], r["r"] and r["r"]["r"]) for r in jobs.chart_rows(a, b, "n").collect()}
    assert found == {0: ("x", "q"), 1: ("y", None), 2: ("z", None)}


def test_empty_tables_pass(spark):
    ship(spark)
    v = Views(spark, SMALL)
    none = v.results.where("false")
    for frame in (results.skill_tabs(none), results.sheets(none), results.web_overview(none), results.category_histogram(v.items.where("false")), results.snapshot_list(v.snapshots.where("false"), none), results.web_verdicts(none)):
        assert frame.count() == 0
    assert results.compare_summary(none).first()["a_winrate"] is None and results.fallback_share(results.web_overview(none)).first()["rate"] == 0.0
    assert v.results.select(results.percent(F.lit(None).cast("double")).alias("p")).first()["p"] == "—"


def test_deep_pages_read_two_parts(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    results.store_pages(rows, ["n"], str(tmp_path / "pages"), parts=9)
    for number in (1, 2, 17, 50, 99, 100, 250):
        found = results.stored_page(spark, str(tmp_path / "pages"), number)
        begin = 10 * (min(number, 100) - 1)
        assert [r["n"] for r in found.collect()] == list(range(begin, begin + 10))
        assert 1 <= len(found.inputFiles()) <= 2
    assert len(spark.read.parquet(str(tmp_path / "pages/rows")).inputFiles()) == 9
    results.store_pages(rows.where("false"), ["n"], str(tmp_path / "none"))
    assert results.stored_page(spark, str(tmp_path / "none"), 3).count() == 0
