"""The registered queries: operators applied to the evaluation-shaped views of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake import scoring
from judgelake.functions import judgement
from judgelake.functions import text as T
from judgelake.operators import calibration, cases, jobs, pairs, skills, slices, timeline, votes
from judgelake.plans.views import DIMS, FOCAL, KEPT_EVENTS, Views, frames, micros, query
from judgelake.shipping import shared_dir
from judgelake.sources import files
from judgelake.streaming import progress

def _arbitrated(v: Views) -> DataFrame:
    given = v.items.select(F.col("item_id"), F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("model"), F.lit("right").alias("correctness"), (F.col("item_id") % 5 + 1).cast("double").alias("total"), F.lit(0.8).alias("confidence"))
    return votes.arbitrated(v.verdicts(), given.where(F.col("item_id") % 3 == 0))


def _jobs_todo(v: Views) -> DataFrame:
    models = v.spark.createDataFrame([(m,) for m in ("m0", "m1", "m2", "m3")], "model string")
    return jobs.todo(v.items, models, v.votes.where("correctness <> 'unclear'"))


def _answers(v: Views) -> DataFrame:
    return v.table("events").select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("model"), F.when(F.col("value") > 5, F.col("event_id").cast("string")).otherwise("").alias("answer"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "timeout").alias("error"), F.col("event_id").alias("seq"),
    )


def _pair_jobs(v: Views) -> DataFrame:
    answers = v.votes.select("item_id", "model", F.when(F.col("used_search"), "").otherwise("a").alias("answer"), F.lit(None).cast("string").alias("error"))
    done = v.pairs().select("item_id", "model_a", "model_b")
    return jobs.pair_jobs(v.items, answers, FOCAL, done)


def _prompts(v: Views) -> DataFrame:
    asked = T.prompt(F.col("question"), F.when(F.col("item_id") % 3 == 0, F.col("answer")))
    return v.qa.select("item_id", F.length(asked).cast("long").alias("n_chars"), F.sha2(asked, 256).alias("prompt_sha256"))


def _text_ingest(v: Views) -> DataFrame:
    k = F.col("item_id") % 4
    text = F.when(k == 0, F.col("question")).when(k == 1, F.concat_ws(" ||| ", "question", F.lit("@Context: seen"), "answer")).otherwise(F.concat_ws("|||", "question", "answer", F.lit(""), F.coalesce("reference", F.lit(""))))
    found = files.pasted(v.qa.select(F.col("item_id").alias("line"), text.alias("value")), "single")
    return found.select("line", F.sha2("query", 256).alias("query_sha"), F.sha2("answer", 256).alias("answer_sha"), F.sha2("reference", 256).alias("reference_sha"), "competitor", "context", F.col("error").isNotNull().alias("failed"))


def _search_merge(v: Views) -> DataFrame:
    return jobs.interleave(v.hits, "query_id", 10).select("query_id", "place", "rank", "provider_ord", "key")


def _html_text(v: Views) -> DataFrame:
    text = T.html_text(F.col("html"))
    return v.table("pages").select("page_id", text.alias("text"))


def _raw_judgements(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    number = lambda x: x.cast("string")
    rubric = F.concat(
        F.lit('{"rubric": {"accuracy": '), number(k % 5 + 1), F.lit(', "completeness": '), F.when(k % 11 == 0, "null").otherwise(number(k % 4 + 1)),
        F.lit(', "safety": {"x": '), number(k % 5 + 1), F.lit(', "y": '), number(k % 3 + 1), F.lit(', "reason": "said "so" twice"}}, "correctness": "'),
        F.when(k % 2 == 0, "right").otherwise("wrong"), F.lit('", "rationale": "fine",}'),
    )
    return v.table("orders").select(k.alias("id"), F.when(k % 13 == 0, "no verdict").otherwise(F.concat(F.lit("<analysis>a</analysis>```json\n"), rubric, F.lit("\n```"))).alias("text"))


def _judgements(v: Views) -> DataFrame:
    parsed = judgement.parse_judgements(_raw_judgements(v), "id", "text", DIMS)
    score = lambda n: F.get(F.filter("dims", lambda d: d["dim"] == n), F.lit(0))["score"]
    return parsed.select("id", "status", "correctness", F.round("total", 6).alias("total"), *(score(n).alias(n) for n in DIMS))


def _stream_fold(v: Views) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = v.table("documents").select("doc_id", text.alias("text"), F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("attempt"))
    pieces = F.greatest(F.ceil(F.length("text") / 500.0), F.lit(1)).cast("int")
    cut = docs.select("doc_id", "attempt", "text", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("seq"))
    last = F.col("seq") == F.col("pieces") - 1
    chunks = cut.select(
        F.col("doc_id").alias("call_id"), "attempt", "seq", F.substr("text", F.col("seq") * 500 + 1, F.lit(500)).alias("content"), F.when(last, "stop").alias("finish_reason"),
        F.when(last, F.length("text").cast("long")).alias("tokens"), F.when(last & (F.col("doc_id") % 3 == 0) & (F.col("attempt") == 0), "reset").alias("error"),
    )
    return timeline.fold_stream(chunks).select("call_id", "attempt", "finish_reason", "tokens", F.sha2("content", 256).alias("content_sha256"))


def _sessions(v: Views) -> DataFrame:
    rows = v.table("events").select("user_id", (micros()).alias("at"), "event_id")
    return timeline.sessions(rows, "user_id", "at", 12 * 3_600_000_000, "event_id")


def _label_match(v: Views) -> DataFrame:
    """Part names, some with their brand, against names of brands and wares."""
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.concat_ws(" by ", "p_name", "p_brand"))
    labels = v.table("part").select(F.lower("p_brand").alias("skill"), F.col("p_brand").alias("display")).unionAll(v.table("part").select(F.upper("p_name"), F.split("p_name", " ")[1])).distinct()
    return skills.match_label(v.table("part").select(F.col("p_partkey").alias("id"), said.alias("said")), labels, "red")


def _progress_stream(v: Views) -> DataFrame:
    """The stream over the events file, run to its end, as a table: the latest state of each item."""
    source = v.table("events")
    stream = v.spark.readStream.schema(source.schema).parquet(f"{v.sf_dir}/events.parquet*")
    events = stream.select("event_id", F.col("user_id").alias("item_id"), "ts", F.col("event_type").alias("module"), F.when(F.col("event_type") == "signup", F.col("value")).alias("started_at"))
    return progress.latest_states(events, lambda rows: progress.tail_updates(rows, KEPT_EVENTS), progress.TAIL)


def _client_events(rows: DataFrame) -> DataFrame:
    """Events as a client gets them: two of three with a sequence, the others known by their fields."""
    at, event = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"), F.concat(F.lit("e"), "event_id")
    sequence = F.when(F.col("event_id") % 3 > 0, F.col("event_id"))
    key = progress.event_key(sequence, [at, F.col("event_type"), event, F.when(F.col("event_id") % 2 == 0, "j1"), F.col("event_id") % 4, F.lit("said")])
    return rows.select(F.col("user_id").alias("item_id"), key.alias("key"), at.alias("updated_at"), F.col("event_type").alias("module"), event.alias("message"), F.when(F.col("event_type") == "signup", F.col("value")).alias("started_at"))


def _progress_replayed(v: Views) -> DataFrame:
    """The stream over events that came twice, in two orders and several files, run to its end."""
    folder = f"{shared_dir(v.spark)}/judgelake/replayed-{uuid.uuid4().hex}"
    source = v.table("events")
    source.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(folder)
    source.repartition(2, "event_type").write.mode("append").parquet(folder)
    stream = v.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return progress.latest_states(_client_events(stream), lambda rows: progress.replay_safe(rows, KEPT_EVENTS), progress.SEEN)


def _event_windows(v: Views) -> DataFrame:
    found = progress.windowed_counts(v.table("events").select("ts", F.col("event_type").alias("module"), "value"))
    return found.select(F.col("window.start").alias("begin"), "module", "n", "total")


def _new_rows(v: Views) -> DataFrame:
    twice = v.table("events").select("ts", "event_type", "event_id")
    return progress.new_only(twice.unionAll(twice), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {
    name: query(build)
    for name, build in {
        "verdict_dims": lambda v: v.dims(),
        "verdicts": lambda v: v.verdicts(),
        "verdict_rationales": lambda v: votes.merged_texts(v.votes, F.coalesce("error_type", F.lit(""))),
        "arbitrated_verdicts": _arbitrated,
        "pair_results": lambda v: v.pairs(),
        "winrate": lambda v: pairs.win_rates(v.pairs()),
        "winrate_by_category": lambda v: pairs.win_rates(v.pairs().join(v.pair_items, "item_id"), ["category"]),
        "bootstrap_ci": lambda v: pairs.bootstrap_intervals(v.pair_votes),
        "bootstrap_by_category": lambda v: pairs.bootstrap_intervals(v.pair_votes.join(v.pair_items.select("item_id", "category"), "item_id"), ["category"]),
        "overview_by_model": lambda v: slices.overview(v.verdicts(), ["model"]),
        "overview_by_slice": lambda v: slices.overview_by_slices(v.verdicts(), v.items),
        "dim_means": lambda v: slices.dim_means(v.verdicts(), v.dims(), ["model"]),
        "dim_gap": lambda v: slices.dim_gaps(v.dims(), v.verdicts(), FOCAL),
        "category_histogram": lambda v: v.items.groupBy("category").agg(F.count("*").alias("n")),
        "ground_truth": lambda v: v.qa.where("reference <> ''").select("item_id", T.exact_match(F.col("answer"), F.col("reference")).alias("em"), T.character_f1(F.col("answer"), F.col("reference")).alias("f1")).withColumn("objective", T.objective_label(F.col("em"), F.col("f1"))),
        "metas": lambda v: v.metas(),
        "calibration": lambda v: calibration.reliability(v.metas()),
        "calibration_by_category": lambda v: calibration.reliability_by(v.metas(), v.items),
        "judge_disagreements": lambda v: calibration.disagreements(v.metas()),
        "noref_reliability": lambda v: calibration.without_reference(v.verdicts(), v.items),
        "error_normalize": lambda v: v.votes.select(T.error_label(F.col("error_type")).alias("error_label")).groupBy("error_label").agg(F.count("*").alias("n")),
        "skill_route": lambda v: v.routed(),
        "skill_label_match": _label_match,
        "skill_clusters": lambda v: skills.error_clusters(v.stored_labels(FOCAL), v.routed(), v.items, FOCAL),
        "keywords": lambda v: skills.keyword_counts(v.table("documents").select("lang", "doc_id", "text"), ["lang"], "doc_id", "text"),
        "dim_problems": lambda v: skills.dim_problems(v.dims(), v.routed(), FOCAL),
        "skill_overview": lambda v: skills.skill_overview(v.judged(FOCAL), v.routed(), v.pairs(), v.agreements(), FOCAL),
        "source_mix": lambda v: skills.source_mix(v.items.withColumn("category", F.when(F.col("item_id") % 9 == 0, F.lit("default")).otherwise(F.col("category"))), v.routed()),
        "cases_best_worst": lambda v: cases.best_and_worst(v.pairs(), FOCAL),
        "disagreements": lambda v: cases.lowest_agreement(v.verdicts()),
        "weaknesses": lambda v: cases.weaknesses(v.stored_labels(FOCAL), v.items, FOCAL),
        "case_cards": lambda v: (lambda judged: cases.cards(v.items, judged, v.pairs(), v.metas_of(judged), FOCAL))(v.stored_verdicts(FOCAL)).select("item_id", "correctness", "total", "worst_rate", "agree", F.array_join("flags", ";").alias("flags")),
        "run_summary": lambda v: (lambda judged: jobs.run_summary(judged, v.items, v.metas_of(judged), FOCAL))(v.stored_verdicts(FOCAL)),
        "jobs_todo": _jobs_todo,
        "pair_jobs": _pair_jobs,
        "latest_answers": lambda v: jobs.latest_answers(_answers(v), ["seq"]),
        "rubric_pivot": lambda v: jobs.rubric_pivot(v.dims(), DIMS),
        "search_merge": _search_merge,
        "prompts": _prompts,
        "text_ingest": _text_ingest,
        "html_text": _html_text,
        "parse_judgement": _judgements,
        "judgement_rows": lambda v: judgement.rubric_rows(_raw_judgements(v), "id", "text", DIMS),
        "scorer_demo": lambda v: scoring.score(v.qa.select("item_id", "question", "answer")),
        "progress_tail": lambda v: timeline.progress_tail(v.fx_events, KEPT_EVENTS),
        "progress_stream": _progress_stream,
        "progress_replayed": _progress_replayed,
        "progress_tails": lambda v: progress.replayed_tails(_client_events(v.table("events")), KEPT_EVENTS),
        "event_windows": _event_windows,
        "new_rows": _new_rows,
        "progress_status": lambda v: timeline.progress_status(v.fx_events),
        "stream_fold": _stream_fold,
        "frame_sessions": _sessions,
        "min_gap_dedupe": lambda v: timeline.min_gap(v.table("events").select("user_id", (micros() / 1e6).alias("at")), "user_id", "at", 6 * 3600.0),
        "stable_runs": lambda v: timeline.stable_runs(frames(v)),
        "task_end": lambda v: timeline.task_end(frames(v), 0.065),
        "strict_duplicates": lambda v: timeline.strict_duplicates(frames(v)),
        "farthest_fill": lambda v: timeline.farthest_fill(frames(v), 16),
    }.items()
}
