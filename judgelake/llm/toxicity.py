"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel compares strings by their subsequences of three characters inside a word, each weighed down by the length
it spans, so that an insult with gaps or inserted characters stays close to the plain one. Words are taken without
anything but letters and digits, and runs of single letters are put together.

The machine is trained on sentences that carry the labels of their documents; a sentence that a clean document has too
is clean. As most sentences of a toxic document are harmless, training is multiple-instance: the first machine learns
from whole sentences; then each document is stood for by its highest-valued words, each with the sentence it comes
from, and the machine is fitted again, toxic witnesses against those of clean documents and ordinary clean words. A witness
counts by its different sentences, so copies of one document do not add up. A document is judged by its three
highest values through a logistic curve, which tells whether a word that clean texts have too comes alone or in company.
In the space of the landmarks the machine is linear, and so it collapses to one weight per subsequence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_keys, trim_memory, written

#: Most labelled documents that the machine is fitted on, taken by hash of their id.
SAMPLE_DOCS = 20_000
#: Most sentences of either label, positive strings and negative strings that the driver holds.
SENTENCES, POSITIVES, NEGATIVES = 2500, 2000, 6000
POSITIVE_MARKS, NEGATIVE_MARKS = 256, 96
#: Rounds of multiple-instance fitting, witnesses a document has, and words of a sentence.
ROUNDS, WITNESSES, SENTENCE_WORDS = 3, 3, 16
#: A witness is toxic if it is so many times as frequent in toxic documents as in clean ones.
PRICE = 3.0
DECAY, SPAN, LONGEST = 0.7, 6, 24
#: Words whose value a Python worker remembers before it starts anew.
REMEMBERED = 40_000

_ALPHABET = 64
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_KEEP = re.compile(r"[^\W_]+")
_ENDS = re.compile(r"[.!?\n]+")
_WITNESS = pa.list_(pa.struct([("word", pa.string()), ("sentence", pa.int64())]))


def _code_table() -> np.ndarray:
    table = np.zeros(0x3000, dtype=np.int64)
    table[:] = 37 + np.arange(0x3000) % 26
    for k in range(26):
        table[97 + k] = 1 + k
    for k in range(10):
        table[48 + k] = 27 + k
    table[10] = table[32] = 0  # between strings, and between the words of one
    return table


_CODES = _code_table()


def units(tokens: list[str]) -> set[str]:
    """The distinct tokens, and runs of four or more one-character tokens put together."""
    found = set(tokens)
    single = bytes([len(t) == 1 for t in tokens])
    at = single.find(b"\1\1\1\1")
    while at >= 0:
        end = single.find(b"\0", at)
        end = len(single) if end < 0 else end
        found.add("".join(tokens[at:end]))
        at = single.find(b"\1\1\1\1", end)
    return found


def strings(token: str) -> list[str]:
    """What the kernel compares of a token: its letters and digits, in overlapping parts if it is long."""
    word = "".join(_KEEP.findall(token))
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings (words, or sentences of words with a space between): subsequence codes, weights, the string of each, and
    each string's length in feature space."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _CODES[np.where(points < len(_CODES), points, points % 0x1000 + 0x1000)]
    word = np.cumsum(code == 0)
    owner = np.cumsum(points == 10)
    keys, weights, owners = [], [], []
    norm = np.full(len(words), 1e-9)
    for i, j in _GAPS:
        if len(code) <= j:
            continue
        a, b, c = code[: len(code) - j], code[i : len(code) - j + i], code[j:]
        inside = (word[: len(code) - j] == word[j:]) & (a > 0)
        at = np.flatnonzero(inside)
        keys.append((a[at] * _ALPHABET + b[at]) * _ALPHABET + c[at])
        owners.append(owner[at])
        weights.append(np.full(len(at), DECAY ** (j + 1)))
        norm += np.bincount(owner[at], minlength=len(words)) * DECAY ** (2 * (j + 1))
    if not keys:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(float), none, np.sqrt(norm)
    return np.concatenate(keys), np.concatenate(weights), np.concatenate(owners), np.sqrt(norm)


class StringMachine:
    """f(word) = sum of the weights of its subsequences / its length in feature space + bias."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias
        self.curve = np.array([0.0, 4.0, 0.0, 0.0])

    def values(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        key, weight, owner, norm = subsequences(words)
        return np.bincount(owner, weights=weight * self.table[key], minlength=len(words)) / norm + self.bias

    def of_tokens(self, tokens: list[str]) -> np.ndarray:
        parts = [strings(t) for t in tokens]
        flat = [p for ps in parts for p in ps]
        if not flat:
            return np.full(len(tokens), self.bias)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        return np.maximum.reduceat(self.values(flat), starts)

    def probability(self, top: np.ndarray) -> np.ndarray:
        """From the three highest values of a document's words, highest first."""
        return 1 / (1 + np.exp(-np.clip(_features(top) @ self.curve, -500, 500)))


def _features(top: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(top), 1)), np.clip(top, -1.5, 1.5)])


def top_three(values: Iterable[float]) -> list[float]:
    """The three highest values, those that are missing or below it at -1.5."""
    return [*sorted((v for v in values if v > -1.5), reverse=True)[:3], -1.5, -1.5, -1.5][:3]


def _kernel_rows(words: list[str], columns: np.ndarray, marks: np.ndarray, step: int = 200) -> np.ndarray:
    """Normalised kernel values of strings with landmarks; columns finds a subsequence's row in marks."""
    out = np.zeros((len(words), marks.shape[1]))
    for first in range(0, len(words), step):
        part = words[first : first + step]
        key, weight, owner, norm = subsequences(part)
        known = columns[key] >= 0
        flat = owner[known] * len(marks) + columns[key[known]]
        dense = np.bincount(flat, weights=weight[known], minlength=len(part) * len(marks)).reshape(len(part), len(marks))
        out[first : first + step] = (dense / norm[:, None]) @ marks
    return out


def fit_machine(positive: list[str], negative: list[str], times: np.ndarray | None = None, seed: int = 7) -> StringMachine:
    """An L2 support vector machine on Nystrom features of the landmarks, collapsed to subsequence weights. times: how
    often each positive string counts."""
    rng = np.random.default_rng(seed)
    pick = lambda words, n: [words[k] for k in sorted(rng.permutation(len(words))[:n])]
    landmarks = pick(positive, POSITIVE_MARKS) + pick(negative, NEGATIVE_MARKS)
    key, weight, owner, norm = subsequences(landmarks)
    used, place = np.unique(key, return_inverse=True)
    columns = np.full(_ALPHABET**3, -1, dtype=np.int64)
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(landmarks)))
    np.add.at(marks, (place, owner), weight)
    marks /= norm[None, :]
    values, vectors = np.linalg.eigh(marks.T @ marks)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    x = np.hstack([_kernel_rows(positive + negative, columns, marks) @ whiten, np.ones((len(positive) + len(negative), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 20.0 * max(1.0, len(negative) / max(1, len(positive))) ** 0.5, 20.0)
    if times is not None:
        cost[: len(positive)] *= np.sqrt(times / times.mean())
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):  # Newton's method on the squared hinge
        wrong = y * (x @ w) < 1
        xs, cs = x[wrong], cost[wrong]
        following = np.linalg.solve(ridge + xs.T @ (xs * cs[:, None]), xs.T @ (cs * y[wrong]))
        if np.abs(following - w).max() < 1e-6:
            break
        w = following
    table = np.zeros(_ALPHABET**3)
    table[used] = marks @ (whiten @ w[:-1])
    return StringMachine(table, float(w[-1]))


def _documents(batches: Iterator[pa.RecordBatch], step: int = 400) -> Iterator[tuple[list, list[set[str]]]]:
    """Other columns and the units of each text, some documents at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            yield part.columns[:-1], [units((t.as_py() or "").lower().split()) for t in part.columns[-1]]


def _sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled documents outside the held-out fold; of an id's repeated rows and
    labels one stays."""
    train = labels.where("label is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return written(rows.groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")), "sample")


def sentences(text: str) -> Iterator[str]:
    """The sentences of a text in lower case as words of letters and digits, at most SENTENCE_WORDS at a time."""
    for part in _ENDS.split(text.lower()):
        words = [w for t in units_in_order(part.split()) for w in strings(t) if w]
        for k in range(0, len(words), SENTENCE_WORDS):
            yield " ".join(words[k : k + SENTENCE_WORDS])


def units_in_order(tokens: list[str]) -> list[str]:
    return [*tokens, *sorted(units(tokens).difference(tokens))]


def _labelled_sentences(sample: DataFrame, most: int = SENTENCES) -> tuple[list[str], list[str]]:
    """Distinct sentences of toxic documents that no clean one has, and of clean documents: at most `most` each, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                found = [list(dict.fromkeys(sentences(t.as_py()))) for t in part.column(1)]
                labels = [y for y, own in zip(part.column(0).to_pylist(), found, strict=True) for _ in own]
                yield pa.RecordBatch.from_arrays([pa.array([x for own in found for x in own], pa.string()), pa.array(labels, pa.int32())], ["sentence", "label"])

    rows = sample.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "sentence string, label int")
    distinct = written(rows.groupBy("sentence").agg(F.min("label").alias("label")), "sentences")
    pick = lambda y: [r[0] for r in distinct.where(F.col("label") == y).orderBy(F.xxhash64("sentence"), "sentence").limit(most).collect()]
    return pick(1), pick(0)


def _clean_words(sample: DataFrame) -> list[str]:
    """Words of clean documents: the most frequent ones, and as many by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _documents(batches):
            own = [list({w for t in tokens for w in strings(t) if w}) for tokens in found]
            counts = Counter(w for words in own for w in words)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts = written(sample.where("label = 0").select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = lambda *order: [r[0] for r in counts.orderBy(*order).limit(NEGATIVES // 2).collect()]
    return sorted({*top(F.desc("n"), "word"), *top(F.xxhash64("word"), "word")})


def _best_words(sample: DataFrame, machine: StringMachine) -> DataFrame:
    """A written table with the highest-valued words of each sample document: label, top (three values), and witnesses, each
    with a hash of its sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                witnesses, tops = [], []
                for text in (t.as_py().lower() for t in part.column(1)):
                    own = sorted(units(text.split()))
                    values = machine.of_tokens(own)
                    best = np.argsort(-values, kind="stable")[:WITNESSES]
                    witnesses.append([{"word": max(strings(own[k]), key=lambda w: machine.values([w])[0]), "sentence": _sentence_around(text, own[k])} for k in best if strings(own[k])[0]])
                    tops.append(top_three(values))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(witnesses, _WITNESS), pa.array(tops, pa.list_(pa.float64()))], ["label", "witnesses", "top"])

    rows = sample.select(F.col("label").cast("int").alias("label"), "text")
    return written(rows.mapInArrow(run, "label int, witnesses array<struct<word:string,sentence:long>>, top array<double>"), "best-words")


def _sentence_around(text: str, token: str) -> int:
    at = text.find(token)
    if at < 0:
        return zlib.crc32(token.encode("utf-8", "surrogatepass"))
    before = max(text.rfind(c, 0, at) for c in ".!?\n")
    after = _ENDS.search(text, at + len(token))
    return zlib.crc32(text[before + 1 : after.start() if after else len(text)].encode("utf-8", "surrogatepass"))


def _calibrated(machine: StringMachine, best: DataFrame) -> StringMachine:
    """Fits the logistic curve by Newton's method with a small ridge; best has at most a sample's rows."""
    rows = best.select("label", "top").toPandas()
    order = np.lexsort([*np.array(rows["top"].tolist()).T, rows["label"].to_numpy()])  # whatever order the rows came in
    x, y = _features(np.array(rows["top"].tolist()))[order], rows["label"].to_numpy(dtype=float)[order]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w)), x.T @ (y - p) - 0.02 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    machine.curve = w
    return machine


def _witnesses(best: DataFrame, sizes: dict[int, int]) -> tuple[list[str], np.ndarray, list[str]]:
    """Toxic witnesses with the number of their different sentences, and witnesses of clean documents; bounded by counts."""
    rows = best.select("label", F.explode("witnesses").alias("w"))
    counts = rows.groupBy(F.col("w.word").alias("word")).agg(
        F.count_distinct(F.when(F.col("label") == 1, F.col("w.sentence"))).alias("toxic"), F.count_distinct(F.when(F.col("label") == 0, F.col("w.sentence"))).alias("clean"),
    )
    counts = written(counts.withColumn("telling", F.col("toxic") > F.col("clean") * F.lit(PRICE * sizes[1] / sizes[0])), "witnesses")
    positive = counts.where("telling").orderBy(F.desc("toxic"), "word").limit(POSITIVES).select("word", "toxic").collect()
    least = 2 if any(r["toxic"] >= 2 for r in positive) else 1  # what a single sentence has may be chance
    positive = [r for r in positive if r["toxic"] >= least]
    negative = [r[0] for r in counts.where("not telling and clean > 0").orderBy(F.desc("clean"), "word").limit(NEGATIVES // 2).select("word").collect()]
    return [r["word"] for r in positive], np.array([r["toxic"] for r in positive], dtype=float), negative


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> StringMachine | None:
    """A machine from documents (doc_id, text) and labels (doc_id, label 0 or 1); None without examples of both labels.

    At most `most` labelled documents are used; of rows that share an id, the one with the last text."""
    sample = _sample(documents, labels, most)
    sizes = dict(sample.groupBy("label").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        return None
    toxic, clean = _labelled_sentences(sample)
    if not toxic or not clean:
        return None
    machine = fit_machine(toxic, clean)
    negative = set(_clean_words(sample))
    for _ in range(ROUNDS):
        positive, times, hard = _witnesses(_best_words(sample, machine), sizes)
        if not positive:
            break
        negative |= set(hard)
        machine = fit_machine(positive, sorted(negative.difference(positive)), times)
    return _calibrated(machine, _best_words(sample, machine))


def score_documents(docs: DataFrame, machine: StringMachine | None) -> DataFrame:
    """(doc_id, __r1, __r2, score) for each row, with its row key; whole texts. Null and empty texts score like texts without toxic words.
    Without a machine every score is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for columns, found in _documents(batches, 200):
            new = set().union(*found).difference(known)
            if len(known) > REMEMBERED:
                known.clear()
                new = set().union(*found)
            fresh = list(new)
            for first in range(0, len(fresh), 20_000):
                part = fresh[first : first + 20_000]
                known.update(zip(part, machine.of_tokens(part).tolist(), strict=True))
            top = np.array([top_three(map(known.__getitem__, tokens)) for tokens in found]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(machine.probability(top))], ["doc_id", "__r1", "__r2", "score"])
        known.clear()
        trim_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(docs), F.col("text").cast("string").alias("text"))
    if machine is None:
        return plain.select("doc_id", "__r1", "__r2", F.lit(0.0).alias("score"))
    return plain.mapInArrow(run, "doc_id long, __r1 long, __r2 int, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are never read): doc_id, held_out, score, predicted.

    labels: doc_id, toxic. Repeated rows score each; null ids are not held out; an empty table gives no rows.
    """
    machine = fit(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("label")), most)
    return score_documents(docs, machine).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all columns of docs. Rows of one id are judged each by its own text."""
    machine = fit(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("label")))
    rejected = written(score_documents(docs, machine).where("score >= 0.5").select("__r1", "__r2").distinct(), "toxic")
    keyed = docs.select("*", *row_keys(docs))
    return keyed.join(rejected, ["__r1", "__r2"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
