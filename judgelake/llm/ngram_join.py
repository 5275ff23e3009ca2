"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of word shingles.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least 0.75, that is
`100 * intersection >= 75 * union`. The search is exact; no link between different sets is lost.

1. Texts are hashed in chunks of documents. Shingles are dealt by the first bits of their hash to buckets, whose number
   grows with the input, that count in how many documents each occurs, and tell the chunks which occur more than
   once. The next 48 bits go along, so at least 54 bits tell shingles apart, and all 64 from 1 TB on. A set of n shingles
   needs ceil(0.75 n) shared ones, so documents with fewer repeated shingles than that leave at once; the others
   keep only their repeated shingles. A shingle that fills a chunk is sent once for it, with a count.
2. Equal sets become one class. Every class posts its n - T + 1 rarest shingles; classes that link share one
   of them, so each list's members meet in one candidate group (connected components of stars, not pairs).
3. A group of many classes is cut into blocks of bounded size, and a class goes only to those blocks that post one of
   its rare shingles, so a large group of few candidates costs in proportion to its candidates. Pairs of blocks are joined
   by T-occurrence search: the short inverted lists of a query are merged from a heap, the shortest first; the L
   longest are only probed by binary search for candidates that reached T - L.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, join_unique, trim_memory, written
from .shingles import mix, shingle_sets

#: Link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Documents hashed together; chunks and buckets bound what one task holds.
CHUNK_DOCS = 2000
CHUNK_CHARS = 16_000_000
#: Bytes of text whose shingles meet in one bucket, and the fewest bits that number buckets.
BUCKET_BYTES, LEAST_BITS = 16 << 20, 6
#: A shingle in so many documents of a chunk goes to its bucket once, with this count.
LOCAL_HOT = 8
#: Classes of a candidate group that one task joins with as many others.
BLOCK = 256
#: Posts of one shingle that meet the blocks posting it in one place.
SALT_POSTS = 4096
#: Lists that one step merges, and long lists that one step probes.
FAN_IN, PROBES = 16, 16

_INFO, _LIGHT, _HOT = 0, 1, 2
_SENT = "chunk long, kind int, bucket int, a binary, b binary, c binary"


def least_overlap(n):
    """ceil(0.75 n): what a set of n shingles must share with any set it links to."""
    return -(-NUM * n // DEN)


def bucket_bits(text_bytes: int) -> int:
    return max(LEAST_BITS, int(text_bytes // BUCKET_BYTES).bit_length())


def _packed(keys: np.ndarray, bits: int) -> bytes:
    """The 48 bits behind the bucket's of each key, six bytes each."""
    return ((keys << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes, bucket: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return (wide.view("<u8").ravel() << np.uint64(16) >> np.uint64(bits)) | np.uint64(bucket << (64 - bits))


def _send(docs: DataFrame, bits: int, chunk_docs: int) -> DataFrame:
    """Rows for buckets (shingles of a chunk) and for chunks (ids, set sizes, classes, hot shingles; a bucket below 0)."""
    lost = np.uint64(max(0, 16 - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        texts: list = []

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, number
            sets = list(shingle_sets(texts))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            ends = np.cumsum(sizes)
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(mix(values), out=sums[1:])
            classes = mix((sums[ends] - sums[ends - sizes]) ^ mix(sizes.astype(np.uint64) + np.uint64(1)))
            values = values >> lost << lost
            order = np.lexsort((owner, values))
            key, owner = values[order], owner[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(key)))
            hot = np.repeat(times >= LOCAL_HOT, times)
            chunk = (part << 32) | number
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            doc_ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            own = -1 - (part * 7919 + number) % (1 << 30)
            number += 1
            rows: list[tuple] = [(chunk, _INFO, own, doc_ids.tobytes() + known.tobytes(), np.concatenate((sizes.view(np.uint64), classes)).tobytes(), np.concatenate((key[hot], owner[hot].astype(np.uint64))).tobytes())]
            small = np.uint16 if len(sets) < 65536 else np.uint32
            often = times >= LOCAL_HOT
            for kind, keys, side in ((_LIGHT, key[~hot], owner[~hot].astype(small)), (_HOT, key[first[often]], times[often].astype(np.uint32))):
                buckets, starts = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                for k, a, b in zip(buckets.tolist(), starts, [*starts[1:], len(keys)][: len(starts)], strict=True):
                    rows.append((chunk, kind, k, _packed(keys[a:b], bits), side[a:b].tobytes(), None))
            ids, texts = [], []
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "kind", "bucket", "a", "b", "c"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if len(ids) == chunk_docs or size >= CHUNK_CHARS:
                    yield flush()
                    size = 0
        if ids:
            yield flush()
        trim_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SENT)


def _counter(bits: int):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk of a bucket: its shingles that occur in two documents or more, with their frequencies."""
        bucket = int(key[0])
        if bucket < 0:
            return rows
        light = rows["kind"].to_numpy() == _LIGHT
        mine = [_unpacked(a, bucket, bits) for a in rows["a"]]
        times = [np.ones(len(a), dtype=np.int64) if one else np.frombuffer(b, dtype=np.uint32).astype(np.int64) for a, b, one in zip(mine, rows["b"], light, strict=True)]
        values, inverse = np.unique(np.concatenate(mine), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(values))[inverse].astype(np.uint32)
        del values, inverse, times
        out, at = [], 0
        for chunk, a, b, one in zip(rows["chunk"], rows["a"], rows["b"], light, strict=True):
            n = len(a) // 6
            df = total[at : at + n]
            at += n
            kept = df >= 2
            if kept.any():
                owner = np.frombuffer(b, dtype=np.uint16 if len(b) == 2 * n else np.uint32)[kept].astype(np.uint32).tobytes() if one else b""
                out.append((chunk, _LIGHT if one else _HOT, bucket, np.frombuffer(a, dtype=np.uint8).reshape(-1, 6)[kept].tobytes(), owner, df[kept].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "a", "b", "c"])

    return count


def _gather(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """For each document of a chunk: id, set size, class and, if it may link at all, its repeated shingles,
    rarest first. Of equal sets in a chunk one carries them."""
    info = rows[rows["kind"] == _INFO].iloc[0]
    n = len(info["a"]) // 9
    ids, known = np.frombuffer(info["a"][: 8 * n], dtype=np.int64), np.frombuffer(info["a"][8 * n :], dtype=np.uint8)
    sizes, classes = np.frombuffer(info["b"], dtype=np.int64).reshape(2, n)
    hot_key, hot_owner = np.frombuffer(info["c"], dtype=np.uint64).reshape(2, -1)
    keys, owners, dfs, hot_keys, hot_dfs = [], [], [], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint32)]
    for kind, bucket, a, b, c in zip(rows["kind"], rows["bucket"], rows["a"], rows["b"], rows["c"], strict=True):
        if kind != _INFO:
            full = _unpacked(a, bucket, bits)
            (keys if kind == _LIGHT else hot_keys).append(full)
            (dfs if kind == _LIGHT else hot_dfs).append(np.frombuffer(c, dtype=np.uint32))
            if kind == _LIGHT:
                owners.append(np.frombuffer(b, dtype=np.uint32))
    hot, hot_df = np.concatenate(hot_keys), np.concatenate(hot_dfs)
    by_key = np.argsort(hot)
    keys.append(hot_key)
    owners.append(hot_owner.astype(np.uint32))
    dfs.append(hot_df[by_key[np.searchsorted(hot[by_key], hot_key)]] if len(hot_key) else np.zeros(0, dtype=np.uint32))
    key_, owner, df = np.concatenate(keys), np.concatenate(owners), np.concatenate(dfs)
    order = np.lexsort((key_, df, owner))
    key_, owner = key_[order].astype(np.int64), owner[order]
    cut = np.searchsorted(owner, np.arange(n + 1))
    carried, out_keys = set(), []
    for k in range(n):
        repeated = cut[k + 1] - cut[k]
        if sizes[k] and repeated >= least_overlap(int(sizes[k])) and classes[k] not in carried:
            carried.add(classes[k])
            out_keys.append(key_[cut[k] : cut[k + 1]])
        else:
            out_keys.append(None)
    doc_ids = pd.Series([int(i) if there else None for i, there in zip(ids, known, strict=True)], dtype=object)
    return pd.DataFrame({"doc_id": doc_ids, "n": sizes, "cls": classes, "keys": out_keys})


def shingle_classes(docs: DataFrame, chunk_docs: int = CHUNK_DOCS, bits: int | None = None) -> DataFrame:
    """A written table, one row per row of docs: doc_id, n (set size), cls (equal for equal sets), keys."""
    if bits is None:
        bits = bucket_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    told = _send(docs, bits, chunk_docs).groupBy("bucket").applyInPandas(_counter(bits), _SENT)
    gather = lambda rows: _gather(rows, bits)
    return written(told.groupBy("chunk").applyInPandas(gather, "doc_id long, n long, cls long, keys array<long>"), "classes")


class _Sets:
    """Sorted shingle keys of some classes, and their inverted lists."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.cls, self.n, self.docs = (rows[c].to_numpy() for c in ("cls", "n", "docs"))
        self.keys = [np.asarray(k) for k in rows["keys"]]
        flat = np.concatenate(self.keys)
        owner = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        order = np.lexsort((owner, flat))
        flat, self.owner = flat[order], owner[order]
        self.values, self.start = np.unique(flat, return_index=True)
        self.end = np.append(self.start[1:], len(flat))
        # All lists behind each other as one sorted array: the number of the list, then the member.
        self.places = np.repeat(np.arange(len(self.values)), self.end - self.start) * len(self.keys) + self.owner

    def lists(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the inverted lists of those keys that occur here."""
        at = np.searchsorted(self.values, keys)
        return at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == keys)]

    def probed(self, lists: np.ndarray, members: np.ndarray) -> np.ndarray:
        """In how many of the lists each member is, by binary search."""
        wanted = (lists[:, None] * len(self.keys) + members[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        return (self.places[at] == wanted).reshape(len(lists), -1).sum(axis=0)


def heap_merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and in how many lists each is; a heap yields the FAN_IN shortest lists that are left, which are
    merged to one."""
    heap = [(len(x), k, x, np.ones(len(x), dtype=np.int64)) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, numbers, members, times = zip(*(heapq.heappop(heap) for _ in range(min(FAN_IN, len(heap)))), strict=True)
        run = np.concatenate(members)
        order = np.argsort(run, kind="stable")
        run = run[order]
        new = np.ones(len(run), dtype=bool)
        new[1:] = run[1:] != run[:-1]
        first = np.flatnonzero(new)
        heapq.heappush(heap, (len(first), numbers[0], run[first], np.add.reduceat(np.concatenate(times)[order], first)))
    return heap[0][2], heap[0][3]


def t_occurrence(keys: np.ndarray, n: int, index: _Sets) -> np.ndarray:
    """Members of the index that link with a query set of n shingles, by DivideSkip."""
    lists = index.lists(keys)
    need = least_overlap(n)
    if len(lists) < need:
        return np.zeros(0, dtype=np.int64)
    lengths = index.end[lists] - index.start[lists]
    lists = lists[np.argsort(lengths, kind="stable")]
    longest = int(lengths.max())
    skip = min(need - 1, int(need / (0.05 * np.log2(max(2, longest)) + 1))) if longest > 8 else 0
    short = len(lists) - skip
    found, count = heap_merged([index.owner[index.start[k] : index.end[k]] for k in lists[:short]])
    alive = (count >= max(1, need - skip)) & (DEN * index.n[found] >= NUM * n) & (DEN * n >= NUM * index.n[found])
    found, count = found[alive], count[alive]
    for k in range(short, len(lists), PROBES):  # long lists are probed only
        if not len(found):
            break
        count = count + index.probed(lists[k : k + PROBES], found)
        left = max(0, len(lists) - k - PROBES)
        alive = DEN * (count + left) >= NUM * (n + index.n[found] - count - left)
        found, count = found[alive], count[alive]
    return found[DEN * count >= NUM * (n + index.n[found] - count)]


def _join_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one block of a group with itself or with another: forest edges and partial link counts."""
    left = rows[rows["side"] != 1].sort_values("cls").reset_index(drop=True)
    right = left if int(key[1]) == int(key[2]) else rows[rows["side"] == 1].sort_values("cls").reset_index(drop=True)
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
    index = _Sets(right)
    same = right is left
    out, total = [], np.zeros(len(right), dtype=np.int64)
    root = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for cls, n, docs, keys in zip(left["cls"], left["n"], left["docs"], left["keys"], strict=True):
        found = t_occurrence(np.asarray(keys), int(n), index)
        found = found[index.cls[found] != cls]
        if not len(found):
            continue
        out.append((cls, cls, int(index.docs[found].sum())))
        if not same:
            total[found] += docs
        for other in index.cls[found]:
            x, y = find(int(cls)), find(int(other))
            if x != y:
                root[x] = y
                out.append((cls, other, 0))
    out.extend((c, c, t) for c, t in zip(index.cls, total, strict=True) if t)
    return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")


def dealt_classes(headed: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """cls, component, own, other: each class with its group, its own block there and each block it is joined with. headed: the
    posts (cls, key) of keys that several classes post, with their number (members); groups: node, component."""
    many = groups.groupBy("component").agg(F.count("*").alias("classes")).withColumn("blocks", F.ceil(F.col("classes") / block).cast("int"))
    members = join_unique(groups, many, ["component"], "classes", groups.count()).select(F.col("node").alias("cls"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    whole = members.where("blocks = 1").select("cls", "component", "own", F.col("own").alias("other"))
    salts = F.ceil(F.col("members") / SALT_POSTS).cast("int").alias("salts")
    posted = written(headed.join(members.where("blocks > 1"), "cls").select("cls", "component", "own", "key", salts), "posted")
    there = posted.groupBy("key", F.col("own").alias("other"), "salts").agg(F.count("*").alias("n"))
    there = there.select("key", "other", "n", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    mine = posted.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("salts")).cast("int"))
    shared = mine.join(there, ["key", "salt"]).where("own <> other or n > 1")
    return whole.unionByName(shared.select("cls", "component", "own", "other").distinct())


def class_links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A written table (a, b, links): a = b gives a class's number of linked documents in other classes, in parts;
    a <> b an edge. The edges span the components that all links span."""
    docs = classes.groupBy("cls").agg(F.count("*").alias("docs"))
    sets = classes.where("keys is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    sets = written(sets.join(docs, "cls"), "sets")
    prefix = (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).cast("int")
    # Singletons of a set come first in the order; they are in no list, so they use the prefix up.
    prefix = prefix - (F.col("n") - F.size("keys")).cast("int")
    posts = written(sets.where(prefix > 0).select("cls", F.explode(F.slice("keys", F.lit(1), prefix)).alias("key")), "postings")
    heads = posts.groupBy("key").agg(F.min("cls").alias("head"), F.count("*").alias("members")).where("members > 1")
    headed = written(join_unique(posts, heads, ["key"], "members", posts.count()), "headed")
    discard(posts)
    groups = written(connected_components(headed.select("cls", "head").where("cls <> head").distinct(), "cls", "head"), "groups")
    dealt = dealt_classes(headed, groups, block).select(
        "cls", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    tasks = dealt.join(sets.select("cls", "n", "docs", "keys"), "cls")
    return written(tasks.groupBy("component", "i", "j").applyInPandas(_join_block, "a long, b long, links long"), "links")


def ngram_join(docs: DataFrame, chunk_docs: int = CHUNK_DOCS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable by links (null if all ids are), n_links the number of other rows
    linked directly, rows with an equal set included. Rows without words have n_shingles 0 and link with nothing,
    so component_id is their own id. Repeated rows are rows of one class. An empty table gives no rows. Shingles are
    compared by the first 54 bits or more of a 64-bit hash, whole sets by another of 64 bits.
    """
    classes = shingle_classes(docs, chunk_docs)
    links = class_links(classes, block)
    component = connected_components(links, "a", "b").withColumnRenamed("node", "cls")
    counts = links.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    rows = classes.select("doc_id", "n", "cls")
    own = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    own = own.join(component, "cls", "left").join(counts, "cls", "left")
    own = written(own.withColumn("label", F.coalesce("component", "cls")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("docs") - 1), "own")
    least = own.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    own = written(join_unique(own, least, ["label"], "members", own.count()).select("cls", "docs", "component_id", "n_links"), "components")
    linked = join_unique(rows.where("n > 0"), own, ["cls"], "docs", rows.count())
    alone = rows.where("n = 0").select("cls", "doc_id", "n", F.lit(0).cast("long").alias("docs"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each_component(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is their component's smallest, with all columns of docs. Rows that share an id stay or go
    together."""
    found = ngram_join(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = written(found, "representatives").hint("merge")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
