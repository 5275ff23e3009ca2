"""Sheets, CSV files and the small text functions of logs and runners, on small tables."""

import csv
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from judgelake.functions import judgement
from judgelake.functions import text as T
from judgelake.operators import calibration, exports, results, timeline
from judgelake.sources import files

SETS = [("base", "accuracy", 0), ("base", "safety", 1), ("music", "taste", 0), ("music", "accuracy", 1)]
KIND = "task_id long, item_id long, mode string, category string, category_display string, error string, kind string, rubric map<string,double>, rubric_reasons map<string,string>, na_dimensions array<string>"


def sheets_of(spark, rows, sets=SETS):
    found = exports.sheet_rows(spark.createDataFrame(rows, KIND), spark.createDataFrame(sets, "dim_set string, dim string, dim_ord int"))
    out = {}
    for r in found.orderBy("task_id", "sheet", "position").collect():
        out.setdefault((r["task_id"], r["sheet"]), []).append(dict(zip(r["header"], r["cells"], strict=True)) | {"#": r["position"]})
    return out


def test_sheets_follow_the_dimensions_of_their_skills(spark):
    rows = [
        (1, 3, "single", "music", "Mu[s]ic", None, "x", {"taste": 4.0, "extra": 1.0}, {"taste": "fine, \"really\""}, ["accuracy"]),
        (1, 1, "single", None, None, None, None, {"accuracy": 2.5}, None, None),
        (1, 2, "single", "music", "Other", None, "y", None, None, []),
        (1, 4, "single", "news", "News", "boom", "z", None, None, None),
        (2, 9, "compare", "music", "Music", None, None, None, None, None),
    ]
    found = sheets_of(spark, rows)
    assert set(found) == {(1, "逐题结果"), (1, "逐题-Other"), (1, "逐题-default"), (1, "评估失败"), (2, "逐题结果")}
    assert [r["#"] for r in found[1, "逐题结果"]] == [1, 2, 3, 4] and [r["item_id"] for r in found[1, "逐题结果"]] == ["1", "2", "3", "4"]
    names = lambda key: [c for c in found[key][0] if c.startswith("维度_")]
    assert names((1, "逐题结果")) == ["维度_accuracy", "维度_safety", "维度_taste"] and names((1, "逐题-Other")) == ["维度_taste", "维度_accuracy"]
    assert names((1, "评估失败")) == ["维度_accuracy", "维度_safety"] and names((2, "逐题结果")) == ["维度_accuracy", "维度_taste"]
    third = found[1, "逐题-Other"][1]
    assert third["维度_accuracy"] == "N/A" and third["理由_accuracy"] == "" and third["维度_taste"] == "4.0" and third["kind"] == "x" and "extra" not in third
    assert found[1, "逐题-default"][0]["维度_accuracy"] == "2.5" and found[1, "逐题-default"][0]["维度_safety"] == ""


def test_sheets_without_sets_or_rows(spark):
    assert sheets_of(spark, []) == {}
    found = sheets_of(spark, [(None, 1, None, None, None, None, None, {"a": 1.0}, None, None)], [])
    assert found == {(None, s): [{"task_id": "", "item_id": "1", "category": "", "category_display": "", "error": "", "kind": "", "#": 1}] for s in ("逐题结果", "逐题-default")}


def test_sheets_as_files(spark, tmp_path):
    """One task holds nearly all rows; its lines are in order over its files, behind one header."""
    rows = [(1 if k else 2, k, "single", "music", "Music", None, "a,\"b\"\r\nc" if k % 7 == 0 else f"k{k}", {"taste": float(k)}, {"taste": "=1"}, None) for k in range(600)]
    found = exports.sheet_rows(spark.createDataFrame(rows, KIND), spark.createDataFrame(SETS, "dim_set string, dim string, dim_ord int"))
    exports.write_sheets(found, f"{tmp_path}/sheets")
    parts = sorted(Path(tmp_path, "sheets", "task_id=1", "sheet=逐题结果").glob("*.txt"))
    raw = b"".join(p.read_bytes() for p in parts)
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1 and raw.endswith(b"\r\n")
    read = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert [int(r["item_id"]) for r in read] == list(range(1, 600)) and read[6]["kind"] == "a,\"b\"\r\nc" and read[6]["维度_taste"] == "7.0" and read[0]["kind"] == "k1"


def test_csv_of_any_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a \"b\", c", ["x", None], ""), (2, None, None, "line\nline")], "id long, said string, tags array<string>, note string")
    files.write_csv(rows.coalesce(1), f"{tmp_path}/rows")
    raw = next(Path(tmp_path, "rows").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    assert list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline=""))) == [{"id": "1", "said": "a \"b\", c", "tags": '["x",null]', "note": ""}, {"id": "2", "said": "", "tags": "", "note": "line\nline"}]


def test_header_is_the_union_of_keys_in_order(spark):
    rows = spark.sql("SELECT * FROM VALUES (2L, map('c', '3', 'a', null)), (1L, map('b', '1', 'a', '2')), (3L, null), (4L, cast(map() as map<string, string>)) AS t(at, fields)")
    header = exports.union_header(rows, "fields", "at")
    assert header == ["b", "a", "c"]
    assert [tuple(r) for r in exports.wide_fields(rows, "fields", header).orderBy("at").collect()] == [(1, "1", "2", ""), (2, "", "", "3"), (3, "", "", ""), (4, "", "", "")]
    assert exports.union_header(rows.where("false"), "fields", "at") == []


@pytest.mark.parametrize("value", ["plain", "two words", "a|b", "a=b", "line\r\nline", 'quo"ted', 'quo"ted \\ slash', "tab\there", "nar\u202frow", "", "中 文"])
def test_log_values(spark, value):
    flat = value.replace("\r", "\\r").replace("\n", "\\n")
    expected = json.dumps(flat, ensure_ascii=False) if any(c.isspace() or c in "|=" for c in flat) else flat
    row = spark.createDataFrame([(value, True, None, ["a b", value])], "t string, b boolean, n string, l array<string>")
    found = row.select(T.display_value(F.col("t"), "string"), T.display_value(F.col("b"), "boolean"), T.display_value(F.col("n"), "string"), T.display_value(F.col("l"), "array<string>")).first()
    assert tuple(found) == (expected, "是", "-", json.dumps(["a b", value], ensure_ascii=False, separators=(",", ":")))
    line = row.select(T.details({"x": (F.col("t"), "string"), "n": (F.col("n"), "string"), "b": (F.col("b"), "boolean")})).first()[0]
    assert line == (f"x={expected} | b=是" if value else "b=是")


def test_answers_and_paths(spark):
    said = ['{"answer": " a "}', '{"text": "t", "output": "o"}', '{"output": "o"}', '{"other": 1}', " bare ", None, "{broken"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k long, s string")
    assert [r[0] for r in rows.orderBy("k").select(judgement.answer_of(F.col("s"))).collect()] == ["a", "t", "o", "", "bare", "", ""]
    deep = spark.createDataFrame([('{"a": {"b": [{"c": "x"}, {"c": null}]}}',), ("nothing",), (None,)], "s string")
    for path, expected in (("$.a.b[0].c", ["x", None, None]), ("$.a.b[1].c", [None] * 3), ("$.a.b[2].c", [None] * 3), ("$.z", [None] * 3)):
        assert [r[0] for r in deep.select(judgement.at_path(F.col("s"), path)).collect()] == expected


@pytest.mark.parametrize(("n", "k"), [(1, 1), (5, 1), (5, 5), (10, 4), (11, 3), (16, 7), (1000, 16)])
def test_even_positions(spark, n, k):
    expected = [0] if k == 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)]
    assert spark.range(1).select(timeline.even_positions(F.lit(n), F.lit(k))).first()[0] == expected


def test_answer_store_drops_bad_lines(spark, tmp_path):
    Path(tmp_path, "m.jsonl").write_text('{"item_id": 1, "answer": "a"}\nnot json\n\n{"item_id": 2, "answer": null}\n')
    assert files.read_answers(spark, str(tmp_path)).count() == 2


def test_usage_and_errors_of_awkward_calls(spark):
    said = ['{"usage": {"prompt_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 2}}}', '{"usage": null}', '{"usage": {"prompt_tokens": "x"}}', "no json", None]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k long, s string").orderBy("k")
    assert [tuple(r["u"]) for r in rows.select(results.usage(F.col("s")).alias("u")).collect()] == [(3, None, 2), (None,) * 3, (None,) * 3, (None,) * 3, (None,) * 3]
    null = F.lit(None).cast("string")
    found = spark.range(1).select(results.error_details(F.lit("E"), null, F.lit(429), null, F.lit(""), F.lit(" at x ")).alias("a"), results.without_keys(F.lit(None).cast("map<string,string>"), ["a"]).alias("b")).first()
    assert found["a"] == {"错误类型": "E", "错误": None, "HTTP状态": "429", "服务商请求ID": None, "调用栈": "at x"} and found["b"] == {}


def test_verdicts_without_an_answer_are_held_against_an_empty_one(spark):
    verdicts = spark.createDataFrame([(1, "a", "right", 5.0), (1, "b", "wrong", 0.0), (2, "a", "right", 5.0), (3, "a", "unclear", None)], "item_id long, model string, correctness string, total double")
    items = spark.createDataFrame([(1, "Paris"), (2, ""), (3, "x"), (4, "y")], "item_id long, reference string")
    answers = spark.createDataFrame([(1, "a", " paris. "), (3, "a", None), (9, "a", "z")], "item_id long, model string, answer string")
    found = {(r["item_id"], r["model"]): (r["em"], r["f1"], r["objective"], r["agree"], r["delta"]) for r in calibration.metas_of_answers(verdicts, items, answers).collect()}
    assert found == {(1, "a"): (1.0, 1.0, "right", True, 0.0), (1, "b"): (0.0, 0.0, "wrong", True, 0.0), (3, "a"): (0.0, 0.0, "wrong", None, None)}
