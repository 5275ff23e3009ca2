"""Best-fit packing of tokenised documents by patterns fitted with non-negative least squares.

Token counts are at most one sequence long after long documents are cut, so their histogram has a fixed
size whatever the corpus. Patterns of a few lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down, and what is left is
packed by best fit on counts. Only this plan reaches the driver; documents find their slots in parallel.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import trim_memory, written

SEQUENCE = 2048
END_ID = 0
#: Pieces of one length are ranked in groups of about a HOT_GROUPS-th of all pieces, or of SALT_ROWS; so the driver holds the
#: sizes of at most HOT_GROUPS groups and one a length.
SALT_ROWS, HOT_GROUPS = 512, 50_000
#: Strings between spaces whose ids a Python worker remembers: twice so many, those not used lately being forgotten at once.
REMEMBERED = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkTokenizer:
    """Token ids as little-endian 32-bit bytes, equal to the tokenizer's own.

    The pre-tokenizer never joins a single space to what stands before it, so a text without two white-space
    characters around a space splits at spaces into parts that encode independently and repeat often. Other
    texts, and those that quote one of the vocabulary's added tokens, are encoded whole. Parts of characters below U+0250 go through the same vocabulary as merge ranks.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.unsplittable = re.compile(r"\s \s|  ").search
        self.rare = re.compile("[^\u0000-ɏ]").search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _exact(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def _encode(self, text: str) -> bytes:
        ids = self._exact(text) if self.rare(text) else self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return np.array(self._exact(text), dtype="<u4").tobytes()
        if self.unsplittable(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known, older, out = self.known, self.older, [self._encode(first)]
        for part in rest:
            ids = known.get(part)
            if ids is None:
                if len(known) >= REMEMBERED:
                    older, known = known, {}
                ids = known[part] = older.get(part) or self._encode(" " + part)
            out.append(ids)
        self.known, self.older = known, older
        return b"".join(out)


def _tokenizer(vocabulary: str, ranks: str) -> ChunkTokenizer:
    """Paths are names of files that every executor has."""
    import public_tokenizers

    return ChunkTokenizer(public_tokenizers.path(vocabulary), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", length: int = SEQUENCE) -> DataFrame:
    """Pieces of at most `length` tokens: doc_id, piece, start, length, ids_crc32.

    Each document is its ids and an id 0 behind them; null text is empty, so it has that id alone. Of a longer
    document the first piece takes the remainder and the others are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary, ranks)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    step = (total - 1) % length + 1 if piece == 0 else length
                    for held, value in zip(rows, (doc_id, piece, start, step, zlib.crc32(ids[4 * start : 4 * (start + step)])), strict=True):
                        held.append(value)
                    start += step
                    piece += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del encode  # a reused worker keeps no vocabulary
        trim_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def fitting_patterns(histogram: np.ndarray, size: int) -> np.ndarray:
    """Patterns of two to four lengths that occur and sum to `size`, one a row, padded with zeros."""
    present = np.flatnonzero(histogram > 0)
    present = present[(present > 0) & (present < size)]
    found = {(int(a), int(size - a), 0, 0) for a in present if a >= size - a and histogram[size - a] > 0}
    for a in present:
        for wanted, parts in ((24, 3), (8, 4)):
            seconds = present[present <= min(a, size - a - 1)]
            for b in seconds[np.linspace(0, len(seconds) - 1, min(wanted, len(seconds))).astype(int)] if len(seconds) else ():
                rest = int(size - a - b)
                if parts == 3:
                    if 0 < rest <= b and histogram[rest] > 0:
                        found.add((int(a), int(b), rest, 0))
                else:
                    thirds = present[(present <= b) & (present >= (rest + 1) // 2) & (present < rest)]
                    for c in thirds[np.linspace(0, len(thirds) - 1, min(3, len(thirds))).astype(int)] if len(thirds) else ():
                        if histogram[rest - c] > 0:
                            found.add((int(a), int(b), int(c), int(rest - c)))
    return np.array(sorted(found), dtype=np.int64).reshape(-1, 4)


def least_squares(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - h|, A holding how often a length is in a pattern (accelerated
    projected gradient; the step follows from A's row and column sums)."""
    target = histogram.astype(float).copy()
    uses = np.bincount(patterns.ravel(), minlength=len(target)).astype(float)
    uses[0] = target[0] = 0
    step = 1.0 / max(1.0, 4.0 * uses.max())
    scale = 1.0 / np.sqrt(np.maximum(uses, 1.0))  # rows are weighed so that common lengths do not slow the rest
    step = 1.0 / max(4.0, (np.bincount(patterns.ravel(), weights=np.repeat((scale[patterns] ** 2).sum(1), 4), minlength=len(target)) * 1.0)[1:].max())
    x = momentum = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        fitted = np.bincount(patterns.ravel(), weights=np.repeat(momentum, 4), minlength=len(target))
        gap = (fitted - target) * scale**2
        gap[0] = 0
        following = np.maximum(0.0, momentum - step * gap[patterns].sum(1) * 4)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (gap[patterns].sum(1) * (following - x)).sum() > 0:
            t_next, momentum = 1.0, following
        else:
            momentum = following + (t - 1) / t_next * (following - x)
        x, t = following, t_next
    return x


def packing_plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); together they use the histogram up exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], wanted: int) -> None:
        values, times = np.unique(lengths, return_counts=True)
        count = int(min(wanted, *(left[values] // times)))
        if count > 0:
            left[values] -= times * count
            plan.append((lengths, count))

    if left[size]:
        use((size,), int(left[size]))
    patterns = fitting_patterns(left, size)
    if len(patterns):
        fitted = least_squares(patterns, left)
        for k in np.argsort(-fitted, kind="stable"):
            if fitted[k] >= 1:
                use(tuple(int(v) for v in patterns[k] if v), int(fitted[k]))
    while (present := np.flatnonzero(left)).size:  # every turn uses a length up or halves its multiple
        top = int(present[-1])
        chosen, gap = [top], size - top
        spare = left.copy()
        spare[top] -= 1
        while gap > 0:
            usable = np.flatnonzero(spare[1 : gap + 1]) + 1
            if not usable.size:
                break
            pick = int(usable[-1])
            if gap != pick:  # an exact pair of lengths beats the longest one
                both = usable[(gap - usable > 0)]
                both = both[(spare[gap - both] > 0) & ((gap - both != both) | (spare[both] > 1))]
                pick = int(both[-1]) if both.size else pick
            chosen.append(pick)
            spare[pick] -= 1
            gap -= pick
        use(tuple(chosen), int(left[top]))
    return plan


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset; gapless from 0 in each sequence. pieces is read three times, so
    pass a written table."""
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # one row a length
        histogram[length] = count
    salts = np.maximum(1, -(-histogram // max(SALT_ROWS, int(histogram.sum()) // HOT_GROUPS)))
    first = np.append(0, np.cumsum(salts))  # number of the first group of each length
    by_length = pieces.sparkSession.createDataFrame([(int(k), int(first[k]), int(salts[k])) for k in np.flatnonzero(histogram)], "length long, first long, salts long")
    salted = pieces.join(F.broadcast(by_length), "length").withColumn("salt", F.col("first") + F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    sizes = np.zeros(int(first[-1]), dtype=np.int64)
    for salt, count in salted.groupBy("salt").count().collect():
        sizes[salt] = count
    base = np.cumsum(sizes) - sizes
    base -= np.repeat(base[first[:-1]], salts)
    # Slots of each length in plan order: first rank, first sequence, offset.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(size + 1, dtype=np.int64)
    sequence = 0
    for lengths, count in packing_plan(histogram, size):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((int(used[length]), sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    keys = sorted((length, *slot) for length, found in slots.items() for slot in found)
    wide = np.array(keys, dtype=np.int64).reshape(-1, 4)
    order = wide[:, 0] * (1 << 48) + wide[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            rank = batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64) - 1 + base[salt]
            at = np.searchsorted(order, length * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(wide[at, 2] + rank - wide[at, 1]), pa.array(wide[at, 3])], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("salt").orderBy("doc_id", "piece", "ids_crc32", "start")).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", size: int = SEQUENCE) -> DataFrame:
    """Documents (doc_id, text; other columns are ignored) as pieces with their places in sequences. Repeated rows
    are packed each; null ids pass through; an empty table gives no rows."""
    return pack(written(token_pieces(docs, vocabulary, ranks, size), "pieces"), size)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
