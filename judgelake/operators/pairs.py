"""A/B votes: pair results, win rates and bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["item_id", "model_a", "model_b"]


def winner_of(raw: Column, order: Column) -> Column:
    """The winner in fixed order: votes on the swapped presentation are swapped back; anything else is a tie."""
    known = F.when(raw.isin("a", "b"), raw).otherwise(F.lit("tie"))
    return F.when((order == "ba") & (known == "a"), "b").when((order == "ba") & (known == "b"), "a").otherwise(known)


def win_rate(a: Column, b: Column, ties: Column) -> Column:
    return F.try_divide(a + ties * 0.5, a + b + ties)


def _unique_top(a: Column, b: Column, t: Column) -> Column:
    return F.when((a > b) & (a > t), "a").when((b > a) & (b > t), "b").when((t > a) & (t > b), "tie")


def pair_results(votes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per pair: a_wins, b_wins, ties, winner, win_rate_a, agreement, consistent, low_agreement.

    consistent is false only if the two presentations have different clear winners.
    """
    v = votes.withColumn("w", winner_of(F.col("raw_winner"), F.col("pres_order")))
    count = lambda *cond: F.count_if(cond[0] if len(cond) == 1 else cond[0] & cond[1])
    is_ = lambda w: F.col("w") == w
    sums = v.groupBy(*PAIR).agg(
        *(count(is_(w)).alias(n) for w, n in (("a", "a_wins"), ("b", "b_wins"), ("tie", "ties"))),
        *(count(is_(w), F.col("pres_order") == o).alias(f"{o}_{w}") for o in ("ab", "ba") for w in ("a", "b", "tie")),
    )
    one, two = (_unique_top(*(F.col(f"{o}_{w}") for w in ("a", "b", "tie"))) for o in ("ab", "ba"))
    agreement = F.greatest("a_wins", "b_wins", "ties") / (F.col("a_wins") + F.col("b_wins") + F.col("ties"))
    rows = sums.withColumn("consistent", F.coalesce(one == two, F.lit(True))).withColumn("agreement", agreement)
    return rows.select(
        *PAIR, "a_wins", "b_wins", "ties",
        F.when(F.col("a_wins") > F.col("b_wins"), "a").when(F.col("b_wins") > F.col("a_wins"), "b").otherwise("tie").alias("winner"),
        win_rate(F.col("a_wins"), F.col("b_wins"), F.col("ties")).alias("win_rate_a"), "agreement", "consistent",
        ((F.col("agreement") < threshold) | ~F.col("consistent")).alias("low_agreement"),
    )


def win_rates(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per pair of models (and further columns): n_items, rate, low and inconsistent items."""
    return results.groupBy("model_a", "model_b", *(by or [])).agg(
        F.count("*").alias("n_items"), win_rate(F.sum("a_wins"), F.sum("b_wins"), F.sum("ties")).alias("win_rate"),
        F.count_if("low_agreement").alias("low_items"), F.count_if(~F.col("consistent")).alias("inconsistent_items"),
    )


#: Weights are drawn eight to a digest of 128 bits, 16 bits each.
_LANES = 8
#: 65536 times the chance that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = tuple(int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def bootstrap_intervals(votes: DataFrame, by: list[str] | None = None, resamples: int = 200, vote_id: str = "vote_id") -> DataFrame:
    """Per group of votes: n, low, high, the 2.5 and 97.5 percentiles of the bootstrapped mean preference for model_a (a win
    1, a tie 0.5). Null for fewer than two votes.

    Poisson resampling: in each resample a vote counts as often as a Poisson variable of mean 1 says, drawn from a hash of the
    vote's id and the resample. So a resample is an ordinary sum, combined before the shuffle, and neither the order of the votes nor
    their place changes it. Other winners are no votes. resamples is rounded up to a multiple of eight; resamples without votes do not count.
    """
    keys = by or ["model_a", "model_b"]
    w = winner_of(F.col("raw_winner"), F.col("pres_order"))
    halves = F.when(w == "a", 2).when(w == "tie", 1).otherwise(0)
    digest = F.md5(F.concat_ws(":", F.col(vote_id).cast("string"), F.col("block").cast("string")))
    blocks = -(-resamples // _LANES)
    drawn = votes.where(w.isin("a", "b", "tie")).select(*keys, halves.alias("halves"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), vote_id).withColumn("digest", digest)

    def weight(lane: int) -> Column:
        u = F.conv(F.substring("digest", 4 * lane + 1, 4), 16, 10).cast("int")
        return sum(((u >= least).cast("int") for least in POISSON[1:]), (u >= POISSON[0]).cast("int"))

    sums = drawn.groupBy(*keys, "block").agg(F.count("*").alias("n"), *(f(weight(k) * x).alias(f"{name}{k}") for k in range(_LANES) for name, f, x in (("w", F.sum, F.lit(1)), ("s", F.sum, F.col("halves")))))
    lanes = F.explode(F.array(*(F.struct(F.col(f"w{k}").alias("w"), F.col(f"s{k}").alias("s")) for k in range(_LANES)))).alias("lane")
    means = sums.select(*keys, "n", lanes).withColumn("mean", F.when(F.col("lane.w") > 0, F.col("lane.s") / (2 * F.col("lane.w"))))
    bound = lambda share: F.when(F.max("n") > 1, F.percentile("mean", share))
    return means.groupBy(*keys).agg(F.max("n").alias("n"), bound(0.025).alias("low"), bound(0.975).alias("high"))
