"""Quality by Bradley-Terry pairwise ranking.

Each document has a strength, linear in features of its whole text. Preference pairs put a document labelled
good before one labelled bad; logistic loss on feature differences learns the strengths. The cut is the
strength's quantile at the share of bad documents, and the score puts that cut at the decision threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Most labelled documents that the ranking is fitted on, taken by hash of their id, and most pairs of them.
SAMPLE_DOCS, PAIRS = 20_000, 200_000
#: The score at the cut.
THRESHOLD = 0.3
BINS = 10

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"#", b"$", b"%", b"&", b"*",
    b"|", b"<>", b"{}[]()", b"=+/\\^~_", b":;", b"'\"`", b"@", b"-", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127]),
]
_GROUP = np.full(256, len(_GROUPS), dtype=np.int64)
for _k, _members in enumerate(_GROUPS):
    _GROUP[list(_members)] = _k


def raw_features(text: str | None) -> list[float]:
    """Shares of character groups, and counts and shares of words, lines and repeats. Null counts as empty."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = np.bincount(_GROUP[data], minlength=len(_GROUPS) + 1) / max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n, distinct = len(words), len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(line[-1:] in ".!?" for line in lines if line)
    symbols = shares[9:14].sum()
    capital = shares[1] / max(1e-9, shares[0] + shares[1])
    odd = max((_line_oddness(line) for line in lines), default=0.0)
    return [
        *shares.tolist(), float(symbols), float(capital), odd, float(np.log1p(n)), distinct / max(1, n), float(np.log1p(n) - np.log1p(distinct)), same / max(1, n),
        len(text) / max(1, n), float(np.log1p(len(lines))), len(set(lines)) / len(lines), n / len(lines), ends / len(lines),
        max(map(len, words), default=0) / 40.0, sum(len(w) == 1 for w in words) / max(1, n),
    ]


def _line_oddness(line: str) -> float:
    """The share of a line's characters that are not among the commonest of running text; 0 for a short line."""
    if len(line) < 20:
        return 0.0
    letters = sum(map(line.count, " .,eaisnrto"))
    return 1.0 - letters / len(line)


N_FEATURES = len(raw_features("a"))


class Ranking:
    """Strengths from raw features by quantile bins, and scores from strengths."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, cut: float, width: float) -> None:
        self.edges, self.weights, self.cut, self.width = edges, weights, cut, width

    def expand(self, raw: np.ndarray) -> np.ndarray:
        return expanded(raw, self.edges)

    def score(self, raw: np.ndarray) -> np.ndarray:
        strength = self.expand(raw) @ self.weights
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((strength - self.cut) / self.width + at, -500, 500)))


def expanded(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column per feature and bin edge: how far the value is above it, on the scale of the bins."""
    scale = np.maximum(edges[:, -1] - edges[:, 0], 1e-6)
    above = (raw[:, :, None] > edges[None]).astype(float)
    slope = np.clip((raw - edges[:, 0]) / scale, -1, 3)
    return np.concatenate([above.reshape(len(raw), -1), slope], axis=1)


def fit_ranking(raw: np.ndarray, label: np.ndarray, seed: int = 11, rounds: int = 300) -> Ranking | None:
    """Bradley-Terry by gradient descent with momentum; None if a label is missing."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    edges = np.quantile(raw, np.linspace(0.02, 0.98, BINS), axis=0).T
    x = expanded(raw, edges)
    rng = np.random.default_rng(seed)
    first, second = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(rounds):
        strength = x @ w
        wrong = 1 / (1 + np.exp(np.clip(strength[first] - strength[second], -30, 30)))
        pull = (np.bincount(first, weights=wrong, minlength=len(x)) - np.bincount(second, weights=wrong, minlength=len(x))) / PAIRS
        speed = 0.9 * speed + x.T @ pull - 1e-4 * w
        w = w + 0.5 * speed
    strength = x @ w
    ordered = np.sort(strength)
    k = min(max(len(bad), 1), len(label) - 1)  # the quantile at the share of bad documents
    cut = float((ordered[k - 1] + ordered[k]) / 2)
    width = float(max(1e-6, np.std(strength) / 3))
    return Ranking(edges, w, cut, width)


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Ranking | None:
    """From documents (doc_id, text) and labels (doc_id, label); held-out rows are never read. Of an id's repeated labels the
    largest counts, of its repeated rows the one with the last text, so that at most `most` rows are used."""
    train = labels.where("label is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max(F.col("text").cast("string")).alias("text")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [raw_features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["label", "raw"])

    rows = written(sample.mapInArrow(run, "label int, raw array<double>"), "features").toPandas()
    if not len(rows):
        return None
    order = np.lexsort([*np.array(rows["raw"].tolist()).T, rows["label"].to_numpy()])  # whatever order the rows came in
    return fit_ranking(np.array(rows["raw"].tolist())[order], rows["label"].to_numpy()[order])


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are never read): doc_id, held_out, score, predicted.

    labels: doc_id, quality. Null texts count as empty; repeated rows score each; null ids are not held out. Without
    labels of both kinds every score is 1. An empty table gives no rows.
    """
    ranking = fit(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                raw = np.array([raw_features(t.as_py()) for t in part.column(1)]).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ranking.score(raw) if ranking else np.ones(len(raw)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
