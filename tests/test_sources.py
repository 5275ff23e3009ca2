"""Bad lines of files of many splits, scores that are made once, and judgements as rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from judgelake.functions import judgement
from judgelake.operators import modes
from judgelake.shipping import ship
from judgelake.sources import files, snapshots


def test_bad_lines_are_named_by_file_and_line(spark, tmp_path):
    lines = [json.dumps({"id": f"i{k}", "question": "q" * (k % 50)}) for k in range(3000)]
    for at, bad in ((0, "{not json"), (1777, '{"id": "x", "tags": 5}'), (2999, "[1]")):
        lines[at] = bad
    lines[5] = "  "
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"id": "fine"}\n\noops\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["value"]) for r in files.bad_items(spark, str(tmp_path)).collect())
        numbered = files.numbered_lines(spark, str(tmp_path / "a.jsonl"))
        assert numbered.rdd.getNumPartitions() > 3 and {r["line"]: r["value"] for r in numbered.collect()} == dict(enumerate(lines, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [("a.jsonl", 1, "{not json"), ("a.jsonl", 1778, '{"id": "x", "tags": 5}'), ("a.jsonl", 3000, "[1]"), ("b.jsonl", 3, "oops")]
    with pytest.raises(ValueError, match=r"b.jsonl:3: no item: oops"):
        files.checked_items(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "c.jsonl").write_text('{"id": "fine", "reference": "r"}\n\n')
    assert [r["has_ref"] for r in files.checked_items(spark, str(tmp_path / "c.jsonl")).collect()] == [True]


def test_no_prompt_is_scored_twice(spark, tmp_path):
    folder, asked = str(tmp_path / "scores"), []

    def score(prompts):
        rows = prompts.collect()
        asked.extend(r["prompt"] for r in rows)
        return spark.createDataFrame([(r["key"], len(r["prompt"])) for r in rows if r["prompt"] != "later"], "key string, label int")

    prompts = spark.createDataFrame([("a", "one"), ("a", "one"), ("b", "four"), ("c", "later"), (None, "none")], "key string, prompt string")
    labels, made = snapshots.scored_once(spark, folder, prompts.where("key = 'a' or key is null"), score)
    assert made == 1 and asked == ["one"]
    with pytest.raises(ZeroDivisionError):
        snapshots.scored_once(spark, folder, prompts, lambda p: 1 / 0)
    labels, made = snapshots.scored_once(spark, folder, prompts, score)
    assert made == 1 and sorted(asked) == ["four", "later", "one"] and {r["key"]: r["label"] for r in labels.collect()} == {"a": 3, "b": 4}
    labels, made = snapshots.scored_once(spark, folder, prompts, score)
    assert made == 0 and sorted(asked) == ["four", "later", "later", "one"] and labels.count() == 2


def test_judgements_as_rows_equal_parsed_ones(spark):
    ship(spark)
    draw = random.Random(6)
    values = ["1", "2.5", "null", "NaN", "-3.7", "1e999", '"s"', '"say "so" now"', '"a\\\\"', "[1]", '{"total": 4.2, "reason": "x"}', '{"x": 2, "y": 3, "reason": "he said "no", twice"}', "{}", "true", "}"]
    texts = ['{"rubric": {' + ", ".join(f'"{draw.choice("abcd")}": {draw.choice(values)}' for _ in range(draw.randrange(5))) + draw.choice(["}}", "},}", "}"]) for _ in range(300)]
    texts += ['{"rubric": {"a": 3.9, "b": null, "c": {"x": 2, "y": 5, "reason": "he said "no" to it"}}}', '{"rubric": {"p": 1, "q": 2}}', "", None]
    raw = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for declared in (None, ["a", "b"]):
        parsed = judgement.parse_judgements(raw, "id", "text", declared)
        expected = parsed.select("id", "status", F.explode("dims").alias("d")).select("id", "d.*", "status").collect()
        found = judgement.rubric_rows(raw, "id", "text", declared).collect()
        assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, (tuple(r) for r in expected))) and len(found) > 50


def test_modes_without_sets_and_items_without_ids(spark):
    rows = spark.createDataFrame([(1, "j", "process", "balanced", None, None, None), (2, "j", "process", "balanced", "s", " t ", None), (3, "j", None, "product_expert", "s", None, " ")], "item_id int, judge string, mode string, persona string, skill string, trace string, competitor string")
    sets = spark.createDataFrame([("base", "a", 0), ("s", "b", 0), ("process", "c", 0)], "dim_set string, dim string, dim_ord int")
    assert {(r["item_id"], r["scoring"], r["dim"]) for r in modes.scoring_dims(rows, sets).collect()} == {(1, "result", "a"), (2, "process", "c"), (3, "result", "b")}
    assert {(r["item_id"], r["dim"]) for r in modes.scoring_dims(rows, sets.where("dim_set <> 'process'")).collect()} == {(1, "a"), (2, "b"), (3, "b")}
    pasted = files.pasted(spark.createDataFrame([(1, "q ||| a ||| c"), (2, "only")], "line int, value string"), "single")
    item = modes.as_items(pasted).collect()
    assert len(item) == 1 and (item[0]["id"], item[0]["question"], item[0]["answer"], item[0]["competitor"], item[0]["has_ref"], item[0]["category"], item[0]["frames"]) == ("q1", "q", "a", "c", False, "default", None)
