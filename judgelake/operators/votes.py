"""Many judges' votes on an answer become one verdict.

Every reduction is a histogram or a moment that map-side combines shrink, so one item with very many votes
sends a few rows per task to its group. Where votes have few different values, a histogram is a row of counts (opinions(),
scored()); else its values are rows.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["item_id", "model"]
#: Different values (judges, labels and errors, or scores by dimension) that are counted in columns; of more, counts are rows.
MOST_VALUES = 32
#: Rows that are looked at first; of all others, only those with a value that these lack are told apart.
FIRST_ROWS = 1_000


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, winner, top, votes: winner is null when two values share the highest count. Null values do not vote."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    found = counts.groupBy(*keys).agg(
        F.max(F.struct("n", F.col(value).alias("v"))).alias("last"), F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("first"),
        F.sum("n").alias("votes"),
    )
    return found.select(*keys, F.when(F.col("first.v") == F.col("last.v"), F.col("last.v")).alias("winner"), F.col("last.n").alias("top"), "votes")


def trimmed_means(rows: DataFrame, keys: list[str], value: str = "score", share: float = 0.1) -> DataFrame:
    """keys, mean, n: floor(n * share) values leave at either end if n > 2; null values do not count.

    Works on counts of distinct values: running counts say how many copies of a value survive.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    in_order = Window.partitionBy(*keys).orderBy("x")
    counts = counts.withColumn("upto", F.sum("c").over(in_order)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    k = F.when(F.col("n") > 2, F.floor(F.col("n") * F.lit(share))).otherwise(0)
    left = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("n") - k) - F.greatest(F.col("upto") - F.col("c"), k))
    return counts.withColumn("left", left).groupBy(*keys).agg(
        (F.sum(F.col("x") * F.col("left")) / F.sum("left")).alias("mean"), F.max("n").alias("n"),
    )


def verdict_dims(vote_dims: DataFrame, trim: bool = True) -> DataFrame:
    """item_id, model, dim, mean_score, is_na: a dimension is not applicable only if every vote says so; mean_score is
    null if nobody scored it."""
    keys = [*CELL, "dim"]
    if not trim:
        return vote_dims.groupBy(*keys).agg((F.count_if("is_na") == F.count("*")).alias("is_na"), F.avg("score").alias("mean_score")).select(*keys, "mean_score", "is_na")
    return dims_of(dim_cells(vote_dims))


def weighted_totals(dims: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """item_id, model, rubric_total: weighted mean over scored applicable dimensions. Unknown dimensions weigh 1;
    without any dimension the total is 0. weights (dim, weight) is a handful of rows."""
    rows = dims.join(weights, "dim", "left") if weights is not None else dims.withColumn("weight", F.lit(1.0))
    w = F.when(~F.col("is_na") & F.col("mean_score").isNotNull(), F.coalesce("weight", F.lit(1.0)))
    return rows.groupBy(*CELL).agg(F.coalesce(F.try_divide(F.sum(F.col("mean_score") * w), F.sum(w)), F.lit(0.0)).alias("rubric_total"))


def low_agreement(agreement: Column, repeat_std: Column, threshold: float, scale: int) -> Column:
    """A deviation that is above the bound by rounding only is not above it."""
    return (agreement < threshold) | (F.round(repeat_std, 9) > round(0.15 * scale + 0.3, 9))


def vote_cells(votes: DataFrame) -> DataFrame:
    """Votes counted by cell, judge, label and error: counts and moments that add up, whenever the votes came."""
    square = F.col("total") * F.col("total")
    return votes.groupBy(*CELL, "judge", "correctness", "error_type").agg(F.count("*").alias("n"), F.count("total").alias("k"), F.sum("total").alias("s"), F.sum(square).alias("q"))


def dim_cells(vote_dims: DataFrame) -> DataFrame:
    """Scores counted by cell, dimension and value, with how many votes said that the dimension is not applicable."""
    return vote_dims.groupBy(*CELL, "dim", "score").agg(F.count("*").alias("n"), F.count_if("is_na").alias("na"))


def dims_of(cells: DataFrame, share: float = 0.1) -> DataFrame:
    """verdict_dims() from dim_cells(): means trimmed as by trimmed_means(). All rows of a cell meet in one partition, so that what
    follows by cell needs no shuffle of its own."""
    keys = [*CELL, "dim"]
    rows = cells.repartition(*CELL).withColumn("c", F.when(F.col("score").isNotNull(), F.col("n")).otherwise(F.lit(0)))
    # One order serves both sums, so that Spark evaluates them in one window.
    in_order = Window.partitionBy(*keys).orderBy("score")
    upto, whole = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow), in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", F.sum("c").over(upto).alias("upto"), F.sum("c").over(whole).alias("of"))
    k = F.when(F.col("of") > 2, F.floor(F.col("of") * F.lit(share))).otherwise(0)
    left = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("of") - k) - F.greatest(F.col("upto") - F.col("c"), k))
    return rows.withColumn("left", left).groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("score") * F.col("left")), F.sum(F.when(F.col("score").isNotNull(), F.col("left")))).alias("mean_score"), (F.sum("na") == F.sum("n")).alias("is_na"),
    )


def rubrics(cells: DataFrame, weights: DataFrame | None = None, share: float = 0.1) -> DataFrame:
    """rubrics_of() the dimensions that dim_cells() count."""
    return rubrics_of(dims_of(cells, share), weights)


def rubrics_of(dims: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """item_id, model, dims (array of dim, mean_score, is_na) and rubric_total, the weighted mean over scored applicable dimensions,
    from verdict_dims(). weights (dim, weight) is a handful of rows; unknown dimensions weigh 1."""
    rows = dims.join(F.broadcast(weights), "dim", "left") if weights is not None else dims.withColumn("weight", F.lit(1.0))
    w = F.when(~F.col("is_na") & F.col("mean_score").isNotNull(), F.coalesce("weight", F.lit(1.0)))
    rubric = F.coalesce(F.try_divide(F.sum(F.col("mean_score") * w), F.sum(w)), F.lit(0.0))
    return rows.groupBy(*CELL).agg(F.collect_list(F.struct("dim", "mean_score", "is_na")).alias("dims"), rubric.alias("rubric_total"))


_KINDS = {"judge": "judge", "label": "correctness", "error": "error_type"}


def tallies(cells: DataFrame, kinds: Sequence[str] = tuple(_KINDS)) -> DataFrame:
    """vote_cells() added up by cell and judge, label and error (kind, v): n, k, s, q. All rows of a cell meet in one partition, so
    that what follows by cell needs no shuffle of its own."""
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(_KINDS[kind]).alias("v")) for kind in kinds))
    return cells.repartition(*CELL).select(*CELL, "n", "k", "s", "q", F.inline(kinds)).groupBy(*CELL, "kind", "v").agg(*(F.sum(c).alias(c) for c in ("n", "k", "s", "q")))


def _top(kind: str) -> list[Column]:
    """Of tallies(), the values of a kind with the highest count, last and first in order, and all its votes; null and empty values do
    not vote."""
    votes = lambda x: F.when((F.col("kind") == kind) & (F.col("v") != ""), x)
    return [F.max(votes(F.struct("n", "v"))).alias(f"{kind}_last"), F.min(votes(F.struct((-F.col("n")).alias("n"), "v"))).alias(f"{kind}_first"), F.sum(votes(F.col("n"))).alias(f"{kind}_votes")]


def _unique(kind: str) -> Column:
    """Of _top(), the value that no other one equals in votes, or null."""
    return F.when(F.col(f"{kind}_last.v") == F.col(f"{kind}_first.v"), F.col(f"{kind}_last.v"))


def labels_of(cells: DataFrame) -> DataFrame:
    """item_id, model, correctness, error_type of verdicts_of(): for what asks for no scores."""
    found = tallies(cells, ["label", "error"]).groupBy(*CELL).agg(*_top("label"), *_top("error"))
    return found.select(*CELL, F.coalesce(_unique("label"), F.lit("unclear")).alias("correctness"), _unique("error").alias("error_type"))


def verdicts_of(cells: DataFrame, rubric: DataFrame, threshold: float = 0.6, scale: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (item_id, model): total, correctness, error_type, agreement, repeat_std, n_judges, low_agreement, from
    vote_cells() and rubrics(). carry names columns of the rubric that go with it.

    Ties make correctness 'unclear' and error_type null. repeat_std is the mean over judges with more than one run of
    the population deviation of their totals, 0 without such judges. Counts are shuffled by cell once; there they are added up by
    judge, by label and by error, and these few sums by cell, so that a cell's votes never meet in one row.
    """
    return _with_rubric(_opinions_of(cells), rubric, threshold, scale, carry)


def _opinions_of(cells: DataFrame) -> DataFrame:
    """opinions() from vote_cells()."""
    rows = tallies(cells).groupBy(*CELL).agg(
        *_top("label"), *_top("error"), F.count_if(F.col("kind") == "judge").alias("n_judges"),
        F.avg(F.when((F.col("kind") == "judge") & (F.col("n") > 1) & (F.col("k") > 0), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("q", "k") - F.pow(F.try_divide("s", "k"), 2))))).alias("spread"),
    )
    return rows.select(
        *CELL, _unique("label").alias("correctness"), _unique("error").alias("error_type"), "n_judges", (F.col("label_last.n") / F.col("label_votes")).alias("agreement"),
        F.coalesce("spread", F.lit(0.0)).alias("repeat_std"),
    )


def _with_rubric(rows: DataFrame, rubric: DataFrame, threshold: float = 0.6, scale: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    rows = rows.join(rubric.select(*CELL, "rubric_total", *carry), CELL, "left")
    return rows.select(
        *CELL, F.coalesce("rubric_total", F.lit(0.0)).alias("total"), F.coalesce("correctness", F.lit("unclear")).alias("correctness"), "error_type", "agreement", "repeat_std", "n_judges",
        low_agreement(F.col("agreement"), F.col("repeat_std"), threshold, scale).alias("low_agreement"), *carry,
    )


def _among(column: str, values: Collection) -> Column:
    """Whether a column holds one of the values, of which null may be one; never null."""
    given = [v for v in values if v is not None]
    held = F.coalesce(F.col(column).isin(given), F.lit(False)) if given else F.lit(False)
    return held | F.col(column).isNull() if None in values else held


def _few(rows: DataFrame, columns: list[str]) -> dict[str, list] | None:
    """The different values of each column, null first; None if there are more than MOST_VALUES in all. At most one value more is
    gathered. All rows are read, but those whose values the first rows hold are only compared with them."""
    rows = rows.select(*columns)
    seen = {(c, r[c]) for r in rows.limit(FIRST_ROWS).collect() for c in columns}
    its = lambda c: [v for of, v in seen if of == c]
    if seen and len(seen) <= MOST_VALUES:
        rows = rows.where(~reduce(Column.__and__, [_among(c, its(c)) for c in columns]))
        kinds = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))
        seen |= {(r["c"], r["v"]) for r in rows.distinct().select(F.inline(kinds)).distinct().limit(MOST_VALUES + 1).collect()}
    return {c: sorted(its(c), key=lambda v: (v is not None, v or "")) for c in columns} if len(seen) <= MOST_VALUES else None


def _few_scores(vote_dims: DataFrame) -> dict[str, list[float]] | None:
    """The different scores of each dimension but null, found as by _few(); None if there are more than MOST_VALUES, a dimension is null or a
    score is no number, which has no place in order."""
    rows = vote_dims.select("dim", "score")
    seen = {tuple(r) for r in rows.limit(FIRST_ROWS).collect()}
    if seen and len(seen) <= MOST_VALUES:
        known = [(F.col("dim") == d) & _among("score", {x for of, x in seen if of == d} | {None}) for d in {d for d, _ in seen if d is not None}]
        rows = rows.where(~F.coalesce(reduce(Column.__or__, known, F.lit(False)), F.lit(False)))
        seen |= {tuple(r) for r in rows.distinct().limit(MOST_VALUES + 1).collect()}
    if len(seen) > MOST_VALUES or any(d is None or x != x for d, x in seen):
        return None
    return {d: sorted({x for of, x in seen if of == d and x is not None}) for d in sorted({d for d, _ in seen})}


def _total(columns: Sequence[Column]) -> Column:
    return reduce(Column.__add__, columns, F.lit(0))


def _counts(column: str, values: list[str], prefix: str) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{k}") for k, v in enumerate(values)]


def _highest(n: int, prefix: str) -> Column:
    counts = [F.col(f"{prefix}{k}") for k in range(n)]
    return F.greatest(*counts) if n > 1 else counts[0] if n else F.lit(0)


def _winner(values: list[str], prefix: str, top: str) -> Column:
    """Of _counts() and their _highest(), the value that no other one equals in votes, or null."""
    leads = [(F.col(top) > 0) & (F.col(f"{prefix}{k}") == F.col(top)) for k in range(len(values))]
    one = _total([x.cast("int") for x in leads]) == 1
    return F.when(one, F.coalesce(*(F.when(x, F.lit(v)) for x, v in zip(leads, values, strict=True)))) if values else F.lit(None).cast("string")


def _voted(values: list[str | None]) -> list[str]:
    """Null and empty values do not vote."""
    return [v for v in values if v]


def opinions(votes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """item_id, model, correctness and error_type (null in ties), n_judges, agreement, repeat_std: what verdicts say but for scores.

    With few different judges, labels and errors, a cell is one row of counts and moments from the first task on: no
    text is shuffled beside its key and nothing is sorted. among: as for scored().
    """
    few = _few(votes if among is None else among, ["judge", "correctness", "error_type"])
    if few is None:
        return _opinions_of(vote_cells(votes))
    labels, errors = _voted(few["correctness"]), _voted(few["error_type"])
    sums = [*_counts("correctness", labels, "label"), *_counts("error_type", errors, "error")]
    for j, judge in enumerate(few["judge"]):
        total = F.when(F.col("judge").eqNullSafe(F.lit(judge)), F.col("total"))
        sums += [F.count_if(F.col("judge").eqNullSafe(F.lit(judge))).alias(f"n{j}"), F.count(total).alias(f"k{j}"), F.sum(total).alias(f"s{j}"), F.sum(total * total).alias(f"q{j}")]
    rows = votes.groupBy(*CELL).agg(F.count("*").alias("votes"), *sums).withColumns({"label_top": _highest(len(labels), "label"), "error_top": _highest(len(errors), "error")})
    judges = range(len(few["judge"]))
    spread = [F.when((F.col(f"n{j}") > 1) & (F.col(f"k{j}") > 0), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(f"q{j}", f"k{j}") - F.pow(F.try_divide(f"s{j}", f"k{j}"), 2)))) for j in judges]
    return rows.select(
        *CELL, _winner(labels, "label", "label_top").alias("correctness"), _winner(errors, "error", "error_top").alias("error_type"),
        _total([(F.col(f"n{j}") > 0).cast("long") for j in judges]).cast("long").alias("n_judges"),
        F.try_divide(F.col("label_top"), _total([F.col(f"label{k}") for k in range(len(labels))])).alias("agreement"),
        F.coalesce(F.try_divide(_total([F.coalesce(x, F.lit(0.0)) for x in spread]), _total([x.isNotNull().cast("int") for x in spread])), F.lit(0.0)).alias("repeat_std"),
    )


def labels(votes: DataFrame) -> DataFrame:
    """item_id, model, correctness, error_type of verdicts, counted as by opinions()."""
    few = _few(votes, ["correctness", "error_type"])
    if few is None:
        return labels_of(vote_cells(votes))
    labels, errors = _voted(few["correctness"]), _voted(few["error_type"])
    rows = votes.groupBy(*CELL).agg(F.count("*").alias("votes"), *_counts("correctness", labels, "label"), *_counts("error_type", errors, "error"))
    rows = rows.withColumns({"label_top": _highest(len(labels), "label"), "error_top": _highest(len(errors), "error")})
    return rows.select(*CELL, F.coalesce(_winner(labels, "label", "label_top"), F.lit("unclear")).alias("correctness"), _winner(errors, "error", "error_top").alias("error_type"))


def scored(vote_dims: DataFrame, weights: DataFrame | None = None, share: float = 0.1, among: DataFrame | None = None) -> DataFrame:
    """rubrics_of() verdict_dims(). With few different scores by dimension, a cell is one row of counts from the first task on.
    among: rows that hold all these and more, where those are cheaper to read for their values."""
    values = _few_scores(vote_dims if among is None else among)
    if values is None:
        return rubrics_of(dims_of(dim_cells(vote_dims), share), weights)
    weigh = {r["dim"]: r["weight"] for r in weights.collect()} if weights is not None else {}  # a handful of rows
    # A row is put into its place once: numbers are cheaper to compare than texts, as often as there are counts.
    place = F.coalesce(*(F.when(F.col("dim") == dim, F.lit(i)) for i, dim in enumerate(values))) if values else F.lit(-1)
    slots = [(F.col("dim") == dim) & (F.col("score") == x) for dim, scores in values.items() for x in scores]
    slot = F.coalesce(*(F.when(its, F.lit(k)) for k, its in enumerate(slots)), F.lit(-1))
    rows, sums, k = vote_dims.select(*CELL, "is_na", place.alias("place"), slot.alias("slot")), [], 0
    for i, scores in enumerate(values.values()):
        its = F.col("place") == i
        sums += [F.count_if(its).alias(f"n{i}"), F.count_if(its & F.col("is_na")).alias(f"na{i}"), *(F.count_if(F.col("slot") == k + j).alias(f"c{i}_{j}") for j in range(len(scores)))]
        k += len(scores)
    rows = rows.groupBy(*CELL).agg(F.count("*").alias("scores"), *sums)
    rows = rows.withColumns({f"of{i}": _total([F.col(f"c{i}_{j}") for j in range(len(scores))]).cast("long") for i, scores in enumerate(values.values())})
    rows = rows.withColumns({f"cut{i}": F.when(F.col(f"of{i}") > 2, F.floor(F.col(f"of{i}") * F.lit(share))).otherwise(0) for i in range(len(values))})
    means = {}
    for i, scores in enumerate(values.values()):
        before, points = F.lit(0), F.lit(0.0)
        for j, x in enumerate(scores):
            upto = before + F.col(f"c{i}_{j}")
            left = F.greatest(F.lit(0), F.least(upto, F.col(f"of{i}") - F.col(f"cut{i}")) - F.greatest(before, F.col(f"cut{i}")))
            before, points = upto, points + F.lit(x) * left
        means[f"mean{i}"] = F.try_divide(points, F.col(f"of{i}") - 2 * F.col(f"cut{i}"))
    rows = rows.withColumns(means)
    applies = [(F.col(f"na{i}") < F.col(f"n{i}")) & F.col(f"mean{i}").isNotNull() for i in range(len(values))]
    weight = [F.lit(1.0 if weigh.get(dim) is None else float(weigh[dim])) for dim in values]
    points, whole = (_total([F.when(a, x).otherwise(0.0) for a, x in zip(applies, parts, strict=True)]) for parts in ([F.col(f"mean{i}") * w for i, w in enumerate(weight)], weight))
    dims = [F.when(F.col(f"n{i}") > 0, F.struct(F.lit(dim).alias("dim"), F.col(f"mean{i}").alias("mean_score"), (F.col(f"na{i}") == F.col(f"n{i}")).alias("is_na"))) for i, dim in enumerate(values)]
    listed = F.array_compact(F.array(*dims)) if dims else F.array().cast("array<struct<dim:string,mean_score:double,is_na:boolean>>")
    return rows.select(*CELL, listed.alias("dims"), F.coalesce(F.try_divide(points, whole), F.lit(0.0)).cast("double").alias("rubric_total"))


def judged(
    votes: DataFrame, vote_dims: DataFrame, weights: DataFrame | None = None, threshold: float = 0.6, scale: int = 5, carry: Sequence[str] = (),
    among: tuple[DataFrame | None, DataFrame | None] = (None, None),
) -> DataFrame:
    """verdicts_of() votes and the scores of their dimensions; either is read twice, the first time for its different values, which
    more rows (among) may hold as well."""
    return _with_rubric(opinions(votes, among[0]), scored(vote_dims, weights, among=among[1]), threshold, scale, carry)


def verdicts(votes: DataFrame, dims: DataFrame, weights: DataFrame | None = None, threshold: float = 0.6, scale: int = 5) -> DataFrame:
    """verdicts_of() votes and the dimensions' means (verdict_dims())."""
    return verdicts_of(vote_cells(votes), weighted_totals(dims, weights), threshold, scale)


def merged_texts(votes: DataFrame, text: Column, first: int = 3) -> DataFrame:
    """item_id, model, merged: the first votes' texts by judge and run as `[judge] text`, joined with a bar."""
    ranked = votes.withColumn("text", text).where("text <> ''").withColumn("rn", F.row_number().over(Window.partitionBy(*CELL).orderBy("judge", "run_idx")))
    kept = ranked.where(F.col("rn") <= first)
    parts = F.array_sort(F.collect_list(F.struct("rn", F.concat(F.lit("["), "judge", F.lit("] "), "text").alias("part"))))
    return kept.groupBy(*CELL).agg(F.array_join(F.transform(parts, lambda x: x["part"]), " | ").alias("merged"))


def arbitrated(verdicts: DataFrame, arbitrations: DataFrame) -> DataFrame:
    """Verdicts of low agreement and at least two judges take over an arbitration (item_id, model, correctness, total,
    confidence) where there is one."""
    other = arbitrations.select(*CELL, F.col("correctness").alias("__c"), F.col("total").alias("__t"), "confidence")
    rows = verdicts.join(other, CELL, "left")
    used = F.col("low_agreement") & (F.col("n_judges") >= 2) & F.col("__c").isNotNull()
    return rows.select(
        *CELL, F.when(used, F.col("__t")).otherwise(F.col("total")).alias("total"), F.when(used, F.col("__c")).otherwise(F.col("correctness")).alias("correctness"),
        used.alias("arbitrated"), F.when(used, F.col("confidence")).alias("confidence"),
    )


def arbitrated_fully(verdicts: DataFrame, arbitrations: DataFrame) -> DataFrame:
    """verdicts (with rubric, a map of dimension to score, and rationale) in which those of low agreement and at least two judges take
    over their arbitration (item_id, model, correctness, rubric, total, confidence, rationale) whole: unknown labels
    are unclear, scores are cut to whole numbers, a missing total is their mean, and totals have two digits (halves to even)."""
    names = ("correctness", "rubric", "total", "confidence", "rationale")
    other = arbitrations.select(*CELL, F.struct(*names).alias("a"))
    rows = verdicts.join(other, CELL, "left")
    used = F.col("low_agreement") & (F.col("n_judges") >= 2) & F.col("a").isNotNull()
    label = F.when(F.col("a.correctness").isin("right", "wrong", "partial", "unclear"), F.col("a.correctness")).otherwise("unclear")
    rubric = F.map_filter(F.transform_values("a.rubric", lambda _, x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")), lambda _, x: x.isNotNull())
    scores = F.map_values(rubric)
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)).otherwise(0.0)
    said = F.concat(F.lit("[主席仲裁·置信度"), F.coalesce(F.col("a.confidence").cast("string"), F.lit("None")), F.lit("] "), F.coalesce("a.rationale", F.lit("")))
    taken = {"correctness": label, "rubric": rubric, "total": F.bround(F.coalesce("a.total", mean), 2), "rationale": said}
    return rows.select(
        *CELL, *(F.when(used, new).otherwise(F.col(c)).alias(c) for c, new in taken.items()), used.alias("arbitrated"), F.when(used, F.col("a.confidence")).alias("confidence"),
        *(c for c in verdicts.columns if c not in (*CELL, *names)),
    )
