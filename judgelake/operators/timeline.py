"""Order-dependent operators on events and frames: tails, sessions, runs, gaps and even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelake.operators.positions import min_gap, stored

STAGES = ("view", "click", "signup", "purchase", "error")


def progress_tail(events: DataFrame, keep: int = 100) -> DataFrame:
    """The last events of each item (the feature's bound), with started_at carried forward from earlier ones.

    The carried value is taken per item before the cut, so it survives the events it came from.
    """
    so_far = Window.partitionBy("item_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("carried", F.last("started_at", ignorenulls=True).over(so_far))
    newest = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sequence")))
    return rows.withColumn("rn", newest).where(F.col("rn") <= keep).select("item_id", "sequence", "event_id", "module", F.col("carried").alias("started_at"))


def progress_status(events: DataFrame, finished: str = "purchase", failed: str = "error") -> DataFrame:
    """Per item: events (distinct by sequence), stage (never falls; finishing forces the last), percent, status."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("module")) - 1
    sums = events.dropDuplicates(["item_id", "sequence"]).groupBy("item_id").agg(
        F.count("*").alias("events"), F.max(F.when(F.col("module") != failed, rank)).alias("top"), F.bool_or(F.col("module") == finished).alias("finished"),
        F.max_by("module", "sequence").alias("last_module"), F.max("value").alias("most"),
    )
    return sums.select(
        "item_id", "events", F.when(F.col("finished"), 4).otherwise(F.coalesce("top", F.lit(0))).cast("int").alias("stage"),
        F.when(F.col("finished"), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("most")))).alias("percent"),
        F.when(F.col("finished"), "done").when(F.col("last_module") == failed, "error").otherwise("running").alias("status"),
    )


def sessions(rows: DataFrame, key: str, at: str, gap: float, priority: str) -> DataFrame:
    """Groups of times no further apart than `gap` from the one before: key, session, first, last, n and the time of the row
    with the smallest priority."""
    in_order = Window.partitionBy(key).orderBy(at, priority)
    new = F.when(F.col(at) - F.lag(at).over(in_order) > gap, 1).otherwise(0)
    grouped = rows.withColumn("new", new).withColumn("session", F.sum("new").over(in_order))
    return grouped.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.min(F.struct(priority, at)).alias("p")).select(key, "session", "first", "last", "n", F.col(f"p.{at}").alias("kept"))


def even_positions(n: Column, k: Column) -> Column:
    """k whole positions from 0 to n - 1, evenly spaced, halves to even."""
    return F.when(k <= 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int")))


def rms_difference(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.greatest(F.size(a), F.lit(1)))


def changed_share(a: Column, b: Column, least: float = 12 / 255) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) >= least), lambda x: x)) / F.greatest(F.size(a), F.lit(1))


def stable_runs(frames: DataFrame, threshold: float = 0.065) -> DataFrame:
    """Runs of alike neighbouring frames (video_id, t, sig): video_id, run, start, end, frames, transient.

    A transient run lasts at most four seconds between two alike runs.
    """
    in_order = Window.partitionBy("video_id").orderBy("t")
    new = F.when(rms_difference(F.lag("sig").over(in_order), F.col("sig")) >= threshold, 1).otherwise(0)
    numbered = frames.withColumn("new", new).withColumn("run", F.sum("new").over(in_order))
    runs = numbered.groupBy("video_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("frames"), F.min_by("sig", "t").alias("sig"))
    by_run = Window.partitionBy("video_id").orderBy("run")
    around = rms_difference(F.lag("sig").over(by_run), F.lead("sig").over(by_run)) < threshold
    return runs.select("video_id", "run", "start", "end", "frames", ((F.col("end") - F.col("start") <= 4.0) & F.coalesce(around, F.lit(False))).alias("transient"))


def _numbered(frames: DataFrame, threshold: float) -> DataFrame:
    in_order = Window.partitionBy("video_id").orderBy("t")
    new = F.when(rms_difference(F.lag("sig").over(in_order), F.col("sig")) >= threshold, 1).otherwise(0)
    return frames.withColumn("new", new).withColumn("run", F.sum("new").over(in_order))


def task_end(frames: DataFrame, threshold: float = 0.05, stable: float = 1.5, returned: float = 0.02, least: float = 0.60) -> DataFrame:
    """video_id, end, confidence: where a recorded task ends, for videos that come back to the frame (shell) they began with and stay
    there. Of the stable runs before the last one whose shell differs from the final one, the longest with enough confidence
    counts, then the more confident, then the later one. frames: video_id, t, sig, shell."""
    numbered = _numbered(frames, threshold)
    runs = numbered.groupBy("video_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max_by("sig", "t").alias("sig"), F.max_by("shell", "t").alias("shell"), F.min_by("shell", "t").alias("first_shell"))
    finals = runs.groupBy("video_id").agg(F.max_by(F.struct("run", "start", "end", "sig", "shell"), "run").alias("f"), F.min_by("first_shell", "run").alias("start_shell"))
    lasts = F.col("f.end") - F.col("f.start")
    finals = finals.where((rms_difference(F.col("start_shell"), F.col("f.shell")) <= returned) & (lasts >= stable)).select("video_id", "f", lasts.alias("lasts"))
    part = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    rows = runs.join(finals, "video_id").where(F.col("run") < F.col("f.run")).withColumn("d", F.col("end") - F.col("start"))
    rows = rows.withColumn("shell_gap", rms_difference(F.col("shell"), F.col("f.shell"))).withColumn("layout_gap", rms_difference(F.col("sig"), F.col("f.sig")))
    confidence = 0.40 * part(F.col("d") / 8.0) + 0.20 * part((F.col("layout_gap") - 0.04) / 0.08) + 0.15 * part((F.col("shell_gap") - 0.02) / 0.08) + 0.15 * part(F.col("lasts") / 3.0) + 0.10
    rows = rows.withColumn("confidence", confidence).where((F.col("d") >= stable) & (F.col("shell_gap") > 0.02) & (F.col("confidence") >= least))
    best = rows.groupBy("video_id").agg(F.max(F.struct("d", "confidence", "end")).alias("b"))
    return best.select("video_id", "b.end", "b.confidence")


def transient_peaks(frames: DataFrame, threshold: float = 0.05, stable: float = 1.5, most: float = 4.0, back: float = 0.065, share: tuple[float, float] = (0.02, 0.55)) -> DataFrame:
    """video_id, run, t: of each short run between two alike ones, the frame that differs most from both, if it differs from both in a
    local part only. Earlier frames win ties."""
    numbered = _numbered(frames, threshold)
    runs = numbered.groupBy("video_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.min_by("sig", "t").alias("first_sig"), F.max_by("sig", "t").alias("last_sig"))
    by_run = Window.partitionBy("video_id").orderBy("run")
    runs = runs.withColumn("before", F.lag("last_sig").over(by_run)).withColumn("after", F.lead("first_sig").over(by_run))
    d = F.col("end") - F.col("start")
    short = runs.where((d < stable) & (d <= most) & (rms_difference(F.col("before"), F.col("after")) < back)).select("video_id", "run", "before", "after")
    near = F.least(rms_difference(F.col("sig"), F.col("before")), rms_difference(F.col("sig"), F.col("after")))
    peaks = numbered.join(short, ["video_id", "run"]).groupBy("video_id", "run").agg(F.max(F.struct(near.alias("near"), (-F.col("t")).alias("t"), "sig", "before", "after")).alias("p"))
    apart = lambda a: F.transform(F.zip_with(F.col("p.sig"), F.col(a), lambda x, y: F.abs(x - y)), lambda x: x >= 12 / 255)
    both = F.size(F.filter(F.zip_with(apart("p.before"), apart("p.after"), lambda x, y: x & y), lambda x: x)) / F.size("p.sig")
    return peaks.where((both >= share[0]) & (both <= share[1])).select("video_id", "run", (-F.col("p.t")).alias("t"))


def uniform_plan(videos: DataFrame, most: int = 16) -> DataFrame:
    """video_id, place, t: evenly spaced times from start to end, one a second but at most `most`. videos: video_id, start, end."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("end") - F.col("start")).cast("int") + 1))
    rows = videos.select("video_id", "start", "end", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("place"))
    step = F.when(F.col("n") > 1, (F.col("end") - F.col("start")) / (F.col("n") - 1)).otherwise(0.0)
    return rows.select("video_id", "place", (F.col("start") + F.col("place") * step).alias("t"))


def key_frames(frames: DataFrame, gap: float = 0.25, most: int = 16) -> DataFrame:
    """video_id, t, protected: times close together made one (by priority), frames that hardly differ made one, and then the protected
    and the farthest ones up to `most`. Tasks' ends and peaks of transient runs are protected."""
    ends, peaks = task_end(frames).select("video_id", F.col("end").alias("t")), transient_peaks(frames).select("video_id", "t")
    forced = ends.unionByName(peaks).distinct().withColumn("forced", F.lit(True))
    rows = frames.join(forced, ["video_id", "t"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)) | F.coalesce("forced", F.lit(False))).drop("forced")
    near = F.when(F.col("t") - F.lag("t").over(Window.partitionBy("video_id").orderBy("t")) <= gap, 0).otherwise(1)
    grouped = rows.withColumn("new", near).withColumn("g", F.sum("new").over(Window.partitionBy("video_id").orderBy("t")))
    best = F.row_number().over(Window.partitionBy("video_id", "g").orderBy(F.desc("protected"), "priority", "t"))
    one = grouped.withColumn("rn", best).where("rn = 1").drop("rn", "g", "new")
    return farthest_fill(strict_duplicates(one), most)


def cache_use(requests: DataFrame, key: str, at: str, ttl: float) -> DataFrame:
    """key, requests, fetches, hits: requests in order of time, served from a result that was fetched less than `ttl` ago."""
    fetched = min_gap(requests, key, at, ttl).groupBy(key).agg(F.count("*").alias("fetches"))
    asked = requests.groupBy(key).agg(F.count("*").alias("requests"))
    return asked.join(fetched, key).select(key, "requests", "fetches", (F.col("requests") - F.col("fetches")).alias("hits"))


def strict_duplicates(frames: DataFrame, rms: float = 0.008, changed: float = 0.01) -> DataFrame:
    """Of neighbouring frames that hardly differ one stays: a protected one, else by priority, novelty, time. Frames: video_id,
    t, sig, protected, priority, novelty."""
    in_order = Window.partitionBy("video_id").orderBy("t")
    before = F.lag("sig").over(in_order)
    new = F.when((rms_difference(before, F.col("sig")) < rms) & (changed_share(before, F.col("sig")) < changed), 0).otherwise(1)
    grouped = frames.withColumn("new", new).withColumn("g", F.sum("new").over(in_order))
    best = F.row_number().over(Window.partitionBy("video_id", "g").orderBy(F.desc("protected"), F.desc("priority"), F.desc("novelty"), F.desc("t")))
    return grouped.withColumn("rn", best).where("rn = 1 or protected").select("video_id", "t", "protected", "priority", "novelty")


def farthest_fill(frames: DataFrame, limit: int) -> DataFrame:
    """Protected frames (video_id, t, protected) and then, up to `limit` a video (the feature's limit), the frame farthest in time
    from all chosen, the earlier of two; a video without protected ones begins with its first. Null times do not count and null
    videos are one video; further frames of a chosen time have distance 0 and come last.

    Chosen times cut a video into intervals, and an interval's farthest frame is a maximum that is combined before the shuffle. An
    interval's halves hold no farther frame than it did, so the choice is the farthest of all intervals' frames once those among
    them are cut as well. Every round cuts all of these at once, in all videos; what is held of a video is at most `limit` times.
    """
    kind = dict(frames.dtypes)["t"]
    times = frames.where("t is not null").groupBy(F.struct("video_id").alias("video"), "t").agg(F.count_if("protected").alias("p"), F.count("*").alias("n"))
    times = stored(times, "frames")  # a struct is never null, so that null videos join
    counts = times.groupBy("video").agg(F.sum("p").alias("p"), F.min("t").alias("first"))
    opened = stored(counts.where(F.col("p") < limit), "open").select("video", (limit - F.greatest("p", F.lit(1))).alias("wanted"), "p", "first")
    begun = opened.where("p = 0").select("video", F.col("first").alias("t"))
    seeds = times.where("p > 0").join(opened.select("video"), "video", "left_semi").select("video", "t").unionByName(begun)
    cut = None
    while True:
        bounds = (seeds if cut is None else seeds.unionByName(cut.select("video", "t"))).groupBy("video").agg(F.array_sort(F.collect_list("t")).alias("bounds"))
        rows = times.join(bounds, "video").where(~F.array_contains("bounds", F.col("t")))
        rows = rows.withColumn("left", F.array_max(F.filter("bounds", lambda x: x < F.col("t")))).withColumn("right", F.array_min(F.filter("bounds", lambda x: x > F.col("t"))))
        away = F.least(F.col("t") - F.col("left"), F.col("right") - F.col("t"))  # the least of those that are there
        leaves = rows.groupBy("video", "left", "right").agg(F.max(F.struct(away.alias("d"), (-F.col("t")).alias("u"))).alias("b"))
        leaves = leaves.select("video", (-F.col("b.u")).cast(kind).alias("t"), F.col("b.d").alias("d"), F.lit(False).alias("cut"))
        known = leaves if cut is None else leaves.unionByName(cut.withColumn("cut", F.lit(True)))
        rank = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("d"), "t"))
        top = stored(known.withColumn("rank", rank).join(opened.select("video", "wanted"), "video").where("rank <= wanted"), "farthest")
        if top.where("not cut and rank < wanted").isEmpty():  # what the last one would be cut into comes after it
            break
        cut = stored(top.where("cut or rank < wanted").select("video", "t", "d"), "cut")
    chosen = begun.unionByName(top.select("video", "t"))
    left = opened.join(top.groupBy("video").agg(F.count("*").alias("k")), "video", "left").select("video", (F.col("wanted") - F.coalesce("k", F.lit(0))).alias("left")).where("left > 0")
    spare = times.withColumn("more", F.col("n") - F.greatest("p", F.lit(1))).where("more > 0").join(left, "video")
    spare = spare.select("video", "t", "left", F.explode(F.sequence(F.lit(1).cast("long"), F.least("more", "left"))))
    spare = spare.withColumn("rank", F.row_number().over(Window.partitionBy("video").orderBy("t"))).where("rank <= left")
    protected = times.where("p > 0").select("video", "t", F.explode(F.array_repeat(F.lit(True), F.col("p").cast("int"))).alias("protected"))
    return protected.unionByName(chosen.unionByName(spare.select("video", "t")).withColumn("protected", F.lit(False))).select("video.video_id", "t", "protected")


def fold_stream(chunks: DataFrame) -> DataFrame:
    """Chunks (call_id, attempt, seq, content, finish_reason, tokens, error) to one row a call: of the last attempt that
    finished without an error, content in order, the last finish_reason and usage. A call's chunks are one answer."""
    by_attempt = chunks.groupBy("call_id", "attempt").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))).alias("c"), F.bool_or(F.col("error").isNotNull()).alias("failed"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"), F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("seq"))).alias("tokens"),
    ).where(~F.col("failed") & F.col("finish_reason").isNotNull())
    text = F.array_join(F.transform("c", lambda x: x["content"]), "")
    return by_attempt.groupBy("call_id").agg(F.max_by(F.struct(text.alias("content"), "finish_reason", "tokens"), "attempt").alias("r"), F.max("attempt").alias("attempt")).select("call_id", "attempt", "r.content", "r.finish_reason", "r.tokens")


def fold_tool_calls(chunks: DataFrame) -> DataFrame:
    """Pieces of tool calls (call_id, seq, index, id, name, arguments) to one row a call and index: the last id, and names and
    arguments in order. A call's pieces are one answer."""
    text = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    piece = F.struct("seq", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"))
    rows = chunks.groupBy("call_id", "index").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max_by("id", F.when(F.coalesce("id", F.lit("")) != "", F.col("seq"))).alias("id"))
    return rows.select("call_id", "index", "id", text("name").alias("name"), text("arguments").alias("arguments"))


# Reasons to finish that are failures of the service, and those that withhold the answer.
ABORTED = ("aborted", "abort", "cancelled", "canceled", "error", "failed", "server_error")
BLOCKED = ("blocked", "content_filter", "content_filtered", "safety", "prohibited_content")


def stream_outcome(choices: Column, finish_reason: Column) -> Column:
    """ok, or why a stream's answer cannot be used: no_choice, retry, blocked, unfinished."""
    reason = F.lower(F.trim(F.coalesce(finish_reason, F.lit(""))))
    return F.when(choices == 0, "no_choice").when(reason.isin(*ABORTED), "retry").when(reason.isin(*BLOCKED), "blocked").when(reason == "", "unfinished").otherwise("ok")
