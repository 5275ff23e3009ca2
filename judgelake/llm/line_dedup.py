"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Every non-blank line is hashed. From each line, the fewest following lines that hold SHINGLE_WORDS words are a
shingle; of the shingles that start in the fewest lines that hold WINDOW_WORDS words, the smallest hash is
kept as a fingerprint. Any run of at least SHINGLE_WORDS + WINDOW_WORDS - 1 words that two places share then has a
fingerprint in common. Places of a fingerprint are told apart by how they go on: by the fewest lines around it that hold
MIN_WORDS words, from each line on and back from each line. A place is joined with the first one that goes on alike,
never with all. The join gives matches: a stretch of lines, an earlier document and the distance of the positions in
both. The lines of a match are compared one by one, beyond its ends in both directions too, and the later one of two
equal stretches of MIN_WORDS words or more is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, discard, join_unique, written

SHINGLE_WORDS = WINDOW_WORDS = 25
MIN_WORDS = 50
_LAST = 2**63 - 1


def _words(line: Column) -> Column:
    """Words of a line that is not blank: its parts between spaces."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, lines): uid is 128 bits, equal for rows with equal id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uid = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), text)))
    return docs.select(uid.alias("uid"), "doc_id", F.split(text, "\n", -1).alias("lines"))


def fingerprints(lines: DataFrame, shingle_words: int = SHINGLE_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """From (uid, ord, pos, h, w), one row per non-blank line, the kept (uid, ord, pos, shingle)."""
    ahead = max(shingle_words, window_words) - 1
    following = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.currentRow, ahead)
    rows = lines.withColumn("next", F.collect_list(F.struct("h", "w")).over(following))

    def fewest(words: int) -> Column:
        """How many of the next lines hold so many words, the words they hold and their hash."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("w"), F.lit(42).cast("long").alias("h"))
        step = lambda s, x: F.when(s["w"] >= words, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["w"] + x["w"]).alias("w"), F.xxhash64(s["h"], x["h"]).alias("h")))
        return F.aggregate("next", start, step)

    rows = rows.withColumn("s", fewest(shingle_words)).withColumn("v", fewest(window_words) if window_words != shingle_words else F.col("s"))
    rows = rows.select("uid", "ord", "pos", F.when(F.col("s.w") >= shingle_words, F.col("s.h")).alias("shingle"), F.when(F.col("v.w") >= window_words, F.col("v.n")).alias("n"))
    starts = F.collect_list(F.struct("shingle", (-F.col("pos")).alias("back"))).over(following)  # ties: the last one
    best = F.array_min(F.filter(F.slice(starts, F.lit(1), F.col("n")), lambda x: x["shingle"].isNotNull()))
    kept = rows.withColumn("best", F.when(F.col("n").isNotNull(), best)).where("best is not null")
    return kept.select("uid", "ord", (-F.col("best.back")).alias("pos"), F.col("best.shingle").alias("shingle")).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, runs): for documents with repeated lines, the first and last positions (among all lines, from 0) of each
    repeated run. Order is by doc_id (null last), then position."""
    numbered = F.filter(F.transform("lines", lambda x, k: F.struct(k.alias("k"), F.xxhash64(x).alias("h"), F.hash(x).alias("c"), F.when(F.trim(x) == "", F.lit(0)).otherwise(_words(x)).cast("long").alias("w"))), lambda x: x["w"] > 0)
    base = _lines(docs).select("uid", F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("ord"), numbered.alias("rows"))
    base = written(base.select("uid", "ord", *(F.col(f"rows.{c}").alias(f"{c}s") for c in "khcw")).dropDuplicates(["uid"]), "line-hashes")
    exploded = base.select("uid", "ord", F.posexplode(F.arrays_zip("hs", "ws")).alias("pos", "line")).select("uid", "ord", "pos", F.col("line.hs").alias("h"), F.col("line.ws").alias("w"))
    prints = written(fingerprints(exploded), "fingerprints")
    found = written(windows(_anchored(base, prints), min_words), "windows")
    matches = written(joined_positions(found), "matches")
    runs = written(extended(matches, base, min_words), "runs")
    for done in (prints, found, matches, base):
        discard(done)
    return runs


def _anchored(base: DataFrame, prints: DataFrame) -> DataFrame:
    """(uid, ord, pos, line) of each non-blank line of documents that share a fingerprint, marked where one starts."""
    shared = prints.groupBy("shingle").agg(F.count("*").alias("places")).where("places > 1")
    anchors = join_unique(prints, shared, ["shingle"], "places", prints.count()).groupBy("uid").agg(F.collect_set("pos").alias("anchors"))
    held = base.join(anchors.hint("merge"), "uid").select("uid", "ord", "anchors", F.posexplode(F.arrays_zip("hs", "ws")).alias("pos", "line"))
    return held.select("uid", "ord", "pos", F.struct(F.col("line.hs").alias("h"), F.col("line.ws").alias("w"), F.array_contains("anchors", F.col("pos")).alias("anchored")).alias("line"))


def joined_positions(found: DataFrame) -> DataFrame:
    """(uid, source, shift, first, last): where lines first to last of uid may repeat those of the earlier place, shift lines
    before them in the document source. A place is joined with the first place alone of those that go on alike, so a group of
    places gives as many matches as it has later places."""
    place = F.struct("ord", "uid", "pos")
    first = found.groupBy("back", "hash").agg(F.min(place).alias("source"), F.count("*").alias("places")).where("places > 1")
    later = join_unique(found, first, ["back", "hash"], "places", found.count()).where(F.col("source") < place)
    later = later.select("uid", F.col("source.uid").alias("source"), (F.col("pos") - F.col("source.pos")).alias("shift"), F.struct("first", "last").alias("run"))
    runs = later.groupBy("uid", "source", "shift").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return runs.select("uid", "source", "shift", F.explode(_merged("runs")).alias("run")).select("uid", "source", "shift", "run.first", "run.last")


def extended(matches: DataFrame, base: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, runs): the lines of each match compared with its source's by 96 bits, and on from its ends in both directions for as long as
    they are equal. Stretches of min_words words or more are runs. Each way min_words lines are at hand: a stretch that goes
    on beyond them holds a match of its own there. Sources of very many matches are copied over salts, not broadcast."""
    total = matches.count()
    copies = F.greatest(F.ceil(F.col("places") * HOT_KEYS / F.lit(max(total, 1))), F.lit(1)).cast("int")
    used = matches.groupBy("source").agg(F.count("*").alias("places")).withColumn("copies", copies)
    lines = base.select(F.col("uid").alias("source"), F.arrays_zip("hs", "cs").alias("theirs")).join(used.hint("merge"), "source")
    lines = lines.select("source", "theirs", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    hot = used.where("copies > 1").select("source", "copies")  # fewer than HOT_KEYS
    salt = F.pmod(F.xxhash64("uid", "shift", "first"), F.coalesce("copies", F.lit(1))).cast("int")
    low = F.greatest(F.col("first") - min_words, F.col("shift"), F.lit(0))
    near = matches.join(F.broadcast(hot), "source", "left").select("uid", "source", "shift", low.alias("low"), (F.col("last") + min_words).alias("high"), salt.alias("salt"))
    near = near.join(lines.hint("merge"), ["source", "salt"]).select("uid", F.struct("low", F.slice("theirs", F.col("low") - F.col("shift") + 1, F.col("high") - F.col("low") + 1).alias("theirs")).alias("match"))
    rows = base.select("uid", "ks", "ws", F.arrays_zip("hs", "cs").alias("ours")).join(near.groupBy("uid").agg(F.collect_list("match").alias("matches")).hint("merge"), "uid")

    def stretches(match: Column) -> Column:
        """First and last positions among all lines of the stretches of equal lines."""
        own = [F.slice(c, match["low"] + 1, F.size(match["theirs"])) for c in ("ks", "ours", "ws")]
        none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).cast("long").alias("w"))
        start = F.struct(F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("done"), none.alias("open"))
        ended = lambda s: F.when(s["open"]["w"] >= min_words, F.concat(s["done"], F.array(F.struct(s["open"]["first"].alias("first"), s["open"]["last"].alias("last"))))).otherwise(s["done"])
        longer = lambda s, x: F.struct(F.when(s["open"]["w"] > 0, s["open"]["first"]).otherwise(x["k"]).alias("first"), x["k"].alias("last"), (s["open"]["w"] + x["w"]).alias("w"))
        step = lambda s, x: F.when(x["same"], F.struct(s["done"].alias("done"), longer(s, x).alias("open"))).otherwise(F.struct(ended(s).alias("done"), none.alias("open")))
        pairs = F.zip_with(own[1], match["theirs"], lambda a, b: F.coalesce(a == b, F.lit(False)))
        zipped = F.arrays_zip(own[0].alias("k"), own[2].alias("w"), pairs.alias("same"))
        return F.aggregate(zipped, start, step, ended)

    runs = F.array_sort(F.flatten(F.transform("matches", stretches)))
    return rows.select("uid", _merged(runs).alias("runs")).where(F.size("runs") > 0)


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """From (uid, ord, pos, line), one row per non-blank line, the windows that hold a shared fingerprint: uid, ord, pos, back,
    hash and the first and last position among those lines. A line that alone holds min_words words makes another window with the next
    line, so that each two neighbours of a run share a window and blank lines between them are inside."""
    by_pos = Window.partitionBy("uid").orderBy("pos")
    near = lambda a, b: F.collect_list("line").over(by_pos.rowsBetween(a, b))
    rows = lines.select("uid", "ord", "pos", near(0, min_words).alias("ahead"), F.reverse(near(1 - min_words, 0)).alias("behind"))

    def fewest(column: str, least: int) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("w"), F.lit(42).cast("long").alias("h"), F.lit(False).alias("anchored"))
        longer = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["w"] + x["w"]).alias("w"), F.xxhash64(s["h"], x["h"]).alias("h"), (s["anchored"] | x["anchored"]).alias("anchored"))
        return F.aggregate(column, start, lambda s, x: F.when((s["w"] >= min_words) & (s["n"] >= least), s).otherwise(longer(s, x)))

    own = F.col("ahead")[0]
    pair = F.when((own["w"] >= min_words) & (F.size("ahead") > 1), fewest("ahead", 2))
    kinds = F.array(*(F.struct(F.lit(back).alias("back"), s.alias("s")) for back, s in ((False, fewest("ahead", 1)), (False, pair), (True, fewest("behind", 1)))))
    found = rows.select("uid", "ord", "pos", F.explode(kinds).alias("x")).where(F.col("x.s.anchored") & (F.col("x.s.w") >= min_words))
    more = F.col("x.s.n") - 1
    ends = F.when(F.col("x.back"), F.col("pos") - more).otherwise(F.col("pos")), F.when(F.col("x.back"), F.col("pos")).otherwise(F.col("pos") + more)
    return found.select("uid", "ord", "pos", "x.back", F.col("x.s.h").alias("hash"), ends[0].alias("first"), ends[1].alias("last"))


def _merged(runs: str | Column) -> Column:
    """Sorted runs, those that overlap made one."""
    start = F.struct(F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    ended = lambda s: F.when(s["last"] >= 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))).otherwise(s["done"])
    step = lambda s, x: F.when(x["first"] <= s["last"], F.struct(s["done"].alias("done"), s["first"].alias("first"), F.greatest(s["last"], x["last"]).alias("last"))).otherwise(F.struct(ended(s).alias("done"), x["first"].alias("first"), x["last"].alias("last")))
    return F.aggregate(runs, start, step, ended)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are ignored): doc_id, n_lines, removed_lines, text.

    Lines end at newlines and compare whole; blank lines (spaces only) neither match nor stand between matching lines,
    and stay unless they lie inside a deleted run. A null text counts as empty (one empty line). Rows that repeat both
    id and text are one document and share its result; rows of one id with different texts are ordered by a hash. An empty table gives no rows.
    """
    runs = repeated_runs(docs, min_words)
    rows = _lines(docs).join(runs.hint("merge"), "uid", "left")  # the same plan at every size: texts are shuffled once
    inside = lambda k: F.exists("runs", lambda r: (r["first"] <= k) & (k <= r["last"]))
    kept = F.when(F.col("runs").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: ~inside(k)))
    return rows.withColumn("kept", kept).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("removed_lines"), F.array_join("kept", "\n").alias("text"),
    )


def op8_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
