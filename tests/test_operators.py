import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelake import scoring
from judgelake.functions import judgement
from judgelake.functions import text as T
from judgelake.operators import calibration, jobs, pairs, positions, skills, timeline, votes
from judgelake.sources import files


def test_mean_is_trimmed_from_ten_values_on(spark):
    data = {"a": [5.0, 4.0, 2.0], "b": [1.0] + [3.0] * 8 + [5.0] * 1, "c": [float(k % 7) for k in range(31)]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("d", None)], "k string, score double")
    found = {r["k"]: r["mean"] for r in votes.trimmed_means(rows, ["k"]).collect()}
    for k, vs in data.items():
        cut = int(len(vs) * 0.1) if len(vs) > 2 else 0
        assert found[k] == pytest.approx(np.mean(sorted(vs)[cut : len(vs) - cut]))
    assert "d" not in found


def test_weighted_total_and_majority(spark):
    dims = spark.createDataFrame([(1, "m", "x", 5.0, False), (1, "m", "y", 2.0, False), (1, "m", "z", None, True), (2, "m", "z", None, True)], "item_id long, model string, dim string, mean_score double, is_na boolean")
    weights = spark.createDataFrame([("x", 2.0)], "dim string, weight double")
    assert {r["item_id"]: r["rubric_total"] for r in votes.weighted_totals(dims, weights).collect()} == {1: pytest.approx(4.0), 2: 0.0}
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None)], "k long, v string")
    assert {r["k"]: r["winner"] for r in votes.majority(rows, ["k"], "v").collect()} == {1: "a", 2: None}


def test_swapping_sides_mirrors_the_win_rate(spark):
    draw = random.Random(3)
    data = [(k % 5, "a", "b", "j", k, draw.choice(["ab", "ba"]), draw.choice(["a", "b", "tie", "?"])) for k in range(80)]
    names = "item_id long, model_a string, model_b string, judge string, vote_id long, pres_order string, raw_winner string"
    swapped = [(*r[:6], {"a": "b", "b": "a"}.get(r[6], r[6])) for r in data]
    one, two = ({r["item_id"]: r["win_rate_a"] for r in pairs.pair_results(spark.createDataFrame(d, names)).collect()} for d in (data, swapped))
    assert all(one[k] == pytest.approx(1 - two[k]) for k in one)
    interval = pairs.bootstrap_intervals(spark.createDataFrame(data, names)).first()
    rate = np.mean([one[k] for k in one])
    assert interval["low"] < rate < interval["high"]


def test_labels_in_texts_equal_all_comparisons(spark):
    draw = random.Random(8)
    words = [("".join(draw.choice("abc") for _ in range(draw.randrange(1, 4))), "".join(draw.choice("abc") for _ in range(draw.randrange(0, 3)))) for _ in range(12)]
    texts = [None, "", " ", *("".join(draw.choice("abcd x") for _ in range(draw.randrange(9))) for _ in range(300))]
    named = {}
    for skill, display in words:
        for word in filter(None, (skill, display)):
            named[word] = max(skill, named.get(word, ""))

    def label(text):
        if text is None or "x" in text:
            return None
        text = text.strip(" ")
        best = max(((text == w, len(w), s) for w, s in named.items() if w in text), default=None)
        return best and best[2]

    found = skills.match_label(spark.createDataFrame(list(enumerate(texts)), "id int, said string"), spark.createDataFrame(words, "skill string, display string"), "x")
    assert {r["id"]: r["label"] for r in found.collect()} == {k: label(t) for k, t in enumerate(texts)}
    none = spark.createDataFrame([], "skill string, display string")
    assert skills.match_label(spark.createDataFrame([(1, "a")], "id int, said string"), none).first()["label"] is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, model string, judge string, run_idx int, total double, correctness string, error_type string")
    dims = spark.createDataFrame([], "item_id long, model string, dim string, score double, is_na boolean")
    assert votes.verdicts(none, votes.verdict_dims(dims)).count() == 0


def test_pearson_on_constant_and_few_rows(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (3, 3.0, 3.0)], "k int, x double, y double")
    found = {r["k"]: r["p"] for r in rows.groupBy("k").agg(calibration.pearson("x", "y").alias("p")).collect()}
    assert found == {1: None, 2: None, 3: pytest.approx(1.0)}


def test_text_functions(spark):
    row = spark.range(1).select(
        T.normalize(F.lit("A b，C!_　d")).alias("n"), T.character_f1(F.lit("abca"), F.lit("aab")).alias("f"), T.character_f1(F.lit(None).cast("string"), F.lit("x")).alias("z"),
        T.error_label(F.lit("严重偏题")).alias("e"), T.top_bigrams(F.lit("ab c，的dab"), 2).alias("g"), T.top_bigrams(F.lit("x"), 4).alias("one"), T.analysis_tag(F.lit("x<analysis> y\n</analysis>")).alias("a"),
        T.prompt(F.lit(" q "), F.lit(None).cast("string")).alias("p"), T.retriable(F.lit(429), F.lit("")).alias("r"),
    ).first()
    assert row["n"] == "abc_d" and row["f"] == pytest.approx(6 / 7) and row["z"] == 0.0
    assert row["e"] == "指令偏离" and row["g"] == ["ab", "bc"] and row["one"] == [] and row["a"] == "y" and row["p"] == "q" and row["r"]


def test_judgements_are_repaired_flattened_and_renamed(spark):
    good = json.dumps({"rubric": {"x": 3.9, "y": {"s": 4, "t": 5, "reason": "r"}, "z": None, "w": True}, "correctness": "right"})
    texts = [(1, f"```json\n{good}\n```"), (2, '{"rubric": {"x": 2,}, "rationale": "he said "no" twice"}'), (3, "nothing"), (4, None)]
    found = {r["id"]: r for r in judgement.parse_judgements(spark.createDataFrame(texts, "k long, t string"), "k", "t").collect()}
    assert [(d["dim"], d["score"], d["is_na"]) for d in found[1]["dims"]] == [("x", 3.0, False), ("y", 4.0, False), ("z", None, True)]
    assert found[1]["total"] == 3.5 and found[2]["status"] == "repaired" and found[2]["rationale"] == 'he said "no" twice'
    assert found[3]["status"] == found[4]["status"] == "failed"
    assert [d for d, *_ in judgement.flattened({"p": 1, "q": 2}, ["a", "b"])] == ["a", "b"]


def test_pasted_lines_and_manifests(spark):
    lines = spark.createDataFrame([(1, "q ||| @CONTEXT: c ||| a ||| "), (2, "only"), (3, "  "), (4, "q|||a|||x|||r")], "line long, value string")
    found = {r["line"]: r for r in files.pasted(lines, "single").collect()}
    assert set(found) == {1, 2, 4} and found[1]["context"] == "c" and found[1]["answer"] == "a" and found[1]["competitor"] is None
    assert "line 2" in found[2]["error"] and found[4]["reference"] == "r"
    rows = ['{"id":"x","query":"q","video_path":"v","task_end_time":9}', '{"id":"x","query":"q","video_path":"v"}', '{"query":"q","video_path":"v","task_start_time":true}', "{", '{"query":"q","video_path":"v","task_start_time":9,"task_end_time":8}']
    found = files.manifest(spark.createDataFrame(list(enumerate(rows)), "line long, value string")).orderBy("line").collect()
    assert [r["error"] for r in found] == [None, "id repeated", "times must be numbers", "not JSON", "end not after start"] and found[0]["start"] == 7.0


def test_stores_and_items(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text('{"id":"q1","question":"a","has_ref":true,"category":"x"}\n\n{"id":"q2","question":"b","reference":"r","category":["x","y"]}\n')
    found = {r["id"]: r for r in files.read_items(spark, str(tmp_path / "items.jsonl")).collect()}
    assert not found["q1"]["has_ref"] and found["q2"]["has_ref"] and found["q2"]["category"] == ["x", "y"]
    items = spark.createDataFrame([(k,) for k in range(8)], "item_id long")
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    store = str(tmp_path / "answers")
    files.append(jobs.todo(items, models, spark.createDataFrame([], "item_id long, model string")), store)
    assert spark.read.parquet(store).count() == 16
    assert jobs.todo(items, models, spark.read.parquet(store)).count() == 0


def test_too_many_models_or_names_are_an_error(spark):
    many = spark.range(10_001).select(F.col("id").cast("string").alias("model"), F.col("id").cast("string").alias("skill"), F.lit("d").alias("display"))
    with pytest.raises(ValueError):
        jobs.todo(spark.createDataFrame([(1,)], "item_id long"), many, spark.createDataFrame([], "item_id long, model string"))
    with pytest.raises(ValueError):
        skills.match_label(spark.createDataFrame([(1, "x")], "id long, said string"), many)


def test_min_gap_compares_with_the_last_kept(spark):
    rows = spark.createDataFrame([(1, t) for t in (0.0, 2.0, 4.0, 5.0, 9.0)], "k int, t double")
    assert [r["kept"] for r in timeline.min_gap(rows, "k", "t", 3.0).orderBy("kept").collect()] == [0.0, 4.0, 9.0]


def greedy(rows, gap):
    kept = []
    for key in {str(k): k for k, _ in rows}.values():
        last = None
        for t in sorted({t for k, t in rows if str(k) == str(key) and t is not None and t == t}):
            if last is None or t - last >= gap:
                kept.append((str(key), t))
                last = t
    return sorted(kept)


@pytest.mark.parametrize("gap", [0.3, 50.0, 3000.0, 1e6])
def test_min_gap_of_a_hot_key_over_many_parts(spark, gap):
    draw = random.Random(1)
    rows = [("hot", draw.uniform(0, 10_000)) for _ in range(2500)] + [("hot", float(k)) for k in range(0, 10_000, 7)] + [(f"k{draw.randrange(200)}", draw.uniform(0, 10_000)) for _ in range(2000)]
    rows += [(None, draw.uniform(0, 99)) for _ in range(150)] + [("hot", None), ("x", float("nan")), ("hot", 7.0)]
    found = timeline.min_gap(spark.createDataFrame(rows, "k string, t double"), "k", "t", gap, parts=13)
    assert sorted((str(r["k"]), r["kept"]) for r in found.collect()) == greedy(rows, gap)


def test_min_gap_spreads_a_hot_key_over_tasks(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    found = timeline.min_gap(rows, "k", "t", 2.0, parts=6)
    assert found.count() == 30_000 and found.where("kept % 2 <> 0").isEmpty()
    store = positions.sorted_store(rows, ["k", "t"], 6)
    sizes = [r["count"] for r in store.groupBy("__part").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 15_000
    nan = spark.createDataFrame([(float("nan"), float(t)) for t in range(10)], "k double, t double")
    assert timeline.min_gap(nan, "k", "t", 4.0, parts=3).count() == 3 and timeline.min_gap(nan.limit(0), "k", "t", 4.0).count() == 0


def test_positions_of_hot_and_null_keys(spark):
    rows = [("hot", k % 977, k) for k in range(4000)] + [(f"k{k % 50}", k, k) for k in range(500)] + [(None, k, k) for k in range(30)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    found = {(r["k"], r["id"]): r["position"] for r in positions.numbered(df, ["k"], ["o", "id"], parts=11).collect()}
    expected, seen = {}, {}
    for key, o, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[key] = seen.get(key, 0) + 1
        expected[key, i] = seen[key]
    assert found == expected


def test_farthest_fill_equals_all_distances(spark):
    draw = random.Random(4)
    data = [(v, float(draw.randrange(40)), draw.random() < v / 12) for v in range(6) for _ in range(30)]
    expected = []
    for v in range(6):
        own = sorted([r for r in data if r[0] == v], key=lambda r: r[1])
        kept = [k for k, r in enumerate(own) if r[2]] or [0]
        while len(kept) < 8:
            kept.append(max((k for k in range(30) if k not in kept), key=lambda k: (min(abs(own[k][1] - own[j][1]) for j in kept), -k)))
        expected += [own[k] for k in kept]
    found = timeline.farthest_fill(spark.createDataFrame(data, "video_id int, t double, protected boolean"), 8).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_scorers(spark):
    rows = spark.createDataFrame([(1, "q", "a b"), (2, "q", None)], "item_id long, question string, answer string")
    assert {r["item_id"]: r["correctness"] for r in scoring.score(rows).collect()} == {1: "right", 2: "wrong"}
    with pytest.raises(ValueError):
        scoring.score(rows.withColumn("reference", F.lit("x")))
    assert scoring.arithmetic("2 ** 3 // 3 - -1") == 3
    for bad in ("9 ** 9 ** 9", "__import__('os')", "1 / 0", "x"):
        with pytest.raises(ValueError):
            scoring.arithmetic(bad)


def test_traces_keep_what_results_replace(spark):
    calls = spark.createDataFrame([(1, "bad", "m"), (2, "ok", "m")], "k int, status string, judge string")
    results = spark.createDataFrame([(1, "good", 4.0)], "k int, status string, total double")
    found = {r["k"]: r for r in files.trace_results(calls, results, ["k"]).collect()}
    assert (found[1]["status"], found[1]["call_status"], found[2]["status"], found[2]["call_status"]) == ("good", "bad", "ok", None)


def test_verdicts_equal_plain_python_and_evaluate_no_step_again(spark):
    draw = random.Random(11)
    marks = [(k % 7, "m", "xyz"[draw.randrange(3)], s := draw.choice([None, 1.0, 2.0, 3.5, 5.0]), s is None and draw.random() < 0.7) for k in range(400)] + [(8, "m", "x", None, True)]
    said = [(k % 7, "m", "j%d" % draw.randrange(4), draw.choice(["right", "wrong", "", None]), draw.choice(["a", "b", None]), draw.choice([None, 1.0, 4.0])) for k in range(60)]
    cells = votes.dim_cells(spark.createDataFrame(marks, "item_id long, model string, dim string, score double, is_na boolean"))
    rubric = votes.rubrics(cells, spark.createDataFrame([("x", 2.0), ("y", 0.5)], "dim string, weight double"))
    found = votes.verdicts_of(votes.vote_cells(spark.createDataFrame(said, "item_id long, model string, judge string, correctness string, error_type string, total double")), rubric)
    rubrics, verdicts = ({r["item_id"]: r for r in rows.collect()} for rows in (rubric, found))

    def most(values):
        counts = sorted((values.count(v), v) for v in set(values) if v)
        return (None if len(counts) > 1 and counts[-1][0] == counts[-2][0] else counts[-1][1]), counts[-1][0] / sum(n for n, _ in counts)

    for item in {r[0] for r in marks}:
        points = weights = 0.0
        for dim in {r[2] for r in marks if r[0] == item}:
            own = [r for r in marks if r[0] == item and r[2] == dim]
            scores = sorted(r[3] for r in own if r[3] is not None)
            cut = int(len(scores) * 0.1) if len(scores) > 2 else 0
            mean = np.mean(scores[cut : len(scores) - cut]) if scores else None
            got = next(d for d in rubrics[item]["dims"] if d["dim"] == dim)
            assert got["mean_score"] == (None if mean is None else pytest.approx(mean)) and got["is_na"] == all(r[4] for r in own)
            if mean is not None:
                weight = {"x": 2.0, "y": 0.5}.get(dim, 1.0)
                points, weights = points + weight * mean, weights + weight
        assert rubrics[item]["rubric_total"] == pytest.approx(points / weights if weights else 0.0)
    for item, got in verdicts.items():
        own = [r for r in said if r[0] == item]
        (label, share), (error, _) = most([r[3] for r in own]), most([r[4] for r in own])
        by_judge = [[r[5] for r in own if r[2] == j and r[5] is not None] for j in {r[2] for r in own}]
        runs = [sum(r[2] == j for r in own) for j in {r[2] for r in own}]
        spreads = [np.std(t) for t, n in zip(by_judge, runs, strict=True) if n > 1 and t]
        assert (got["correctness"], got["error_type"], got["n_judges"]) == (label or "unclear", error, len(by_judge))
        assert got["agreement"] == pytest.approx(share) and got["repeat_std"] == pytest.approx(np.mean(spreads) if spreads else 0.0)
        assert got["total"] == pytest.approx(rubrics[item]["rubric_total"])
    # Higher-order functions are interpreted: none over scores, and those over a cell's counts not inlined where they are read again.
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    assert plan(rubric) == 0 and plan(found) <= 24


def test_rows_of_judgements_come_by_batch(spark):
    draw = random.Random(5)

    def by_character(text):
        out, inside, k = [], False, 0
        while k < len(text):
            if inside and text[k] == "\\":
                out.append(text[k : k + 2])
                k += 2
                continue
            after = text[k + 1 :].lstrip()
            if text[k] == '"' and inside and after and after[0] not in ":,}]":
                out.append('\\"')
            else:
                inside ^= text[k] == '"'
                out.append(text[k])
            k += 1
        return judgement._COMMA.sub(r"\1", "".join(out))

    for _ in range(3000):
        text = "".join(draw.choice('"\\,:{}] ab') for _ in range(draw.randrange(14)))
        assert judgement.repaired(text) == by_character(text)
    texts = [(1, 'so {"rubric": {"a": 4.7, "b": null, "c": {"x": 1, "y": 2, "reason": "r"}},} end'), (2, "no"), (3, None), (4, '{"rubric": {}}')]
    rows = judgement.rubric_rows(spark.createDataFrame(texts, "n int, said string"), "n", "said")
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 4.0, False, None, "repaired"), (1, "b", None, True, None, "repaired"), (1, "c", 2.0, False, "r", "repaired")]
    assert judgement.rubric_rows(spark.createDataFrame([(2, "no")], "n int, said string"), "n", "said").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPythonUDTF" not in plan  # a table function makes a frame for each row
