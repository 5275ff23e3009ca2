"""Work in sorted order over hot keys: rows are range-partitioned and stored once, every part is worked on by itself, and the
little that must pass from part to part is worked out between: counts for numbering, maps of last kept times for minimum gaps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgelake.shipping import shared_dir

#: Spark's monotonically increasing ids hold the number of the part above this many bits.
_PART_BITS = 33
#: Longer stretches of one key are marked by doubling jumps, shorter ones side by side.
_LONG = 256


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and order-dependent columns stay as they are."""
    folder = f"{shared_dir(rows.sparkSession)}/judgelake/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def sorted_store(rows: DataFrame, order: list[str | Column], parts: int | None = None, name: str = "sorted") -> DataFrame:
    """The rows with __at, a number that rises in the given order over all rows, and __part, the range they are in. Ranges hold
    about as many rows each, whatever the keys."""
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return stored(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__at", _PART_BITS))


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """rows with their position (from 1) among the rows of their key, in order; null keys are one key. A hot key's rows stay
    spread: they are numbered inside their parts, and the counts of the parts before (one row a part and key) are added."""
    store = sorted_store(rows, [*keys, *order], parts, "numbered")
    counts = store.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.sum("__n").over(before)).where("__offset is not null")  # no more rows than parts
    offsets = offsets.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), "__offset")
    same = F.col("__part") == F.col("__p")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{n}"))
    local = F.row_number().over(Window.partitionBy("__part", *keys).orderBy("__at"))
    joined = store.withColumn("__local", local).join(F.broadcast(offsets), same, "left")
    return joined.select(*rows.columns, (F.col("__local") + F.coalesce("__offset", F.lit(0))).alias(name))


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)  # NaN keys are one key


def thresholds(last: np.ndarray, gap: float) -> np.ndarray:
    """The least time t with t - last >= gap, in the arithmetic of doubles."""
    found = last + gap
    found = np.where(found - last < gap, np.nextafter(found, np.inf), found)
    below = np.nextafter(found, -np.inf)
    return np.where(below - last >= gap, below, found)


def last_kept(t: np.ndarray, gap: float) -> np.ndarray:
    """For each of the sorted times, the place of the last one that is kept if it is kept: jumps are doubled until all have left."""
    jump, last = np.searchsorted(t, thresholds(t, gap)), np.arange(len(t))
    while (inside := np.flatnonzero(jump < len(t))).size:
        last[inside] = last[jump[inside]]
        jump[inside] = jump[jump[inside]]
    return last


def marked(t: np.ndarray, gap: float, begin: int) -> np.ndarray:
    """Places kept of sorted times if the one at `begin` is kept and none before: every doubling of the jump doubles them."""
    levels = [np.append(np.searchsorted(t, thresholds(t, gap)), len(t))]
    while (levels[-1][:-1] < len(t)).any():
        levels.append(levels[-1][levels[-1]])
    kept = np.array([begin])
    for jump in reversed(levels):
        kept = np.concatenate([kept, jump[kept]])
        kept = kept[kept < len(t)]
    return np.sort(kept)


def _first_after(probes: DataFrame, maps: DataFrame) -> DataFrame:
    """probes (__part, x, and others) with to and exit of the first row of maps (__part, entry, to, exit) whose entry is at least x;
    where there is none, exit is null."""
    rest = [c for c in probes.columns if c not in ("__part", "x")]
    both = probes.withColumns({"probe": F.lit(True), "found": F.lit(None).cast("struct<to:long,exit:double>")}).unionByName(
        maps.select("__part", F.col("entry").alias("x"), F.lit(False).alias("probe"), F.struct("to", "exit").alias("found")), allowMissingColumns=True,
    )
    back = Window.partitionBy("__part").orderBy(F.desc("x"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("found", ignorenulls=True).over(back)).where("probe").select("__part", "x", *rest, "found.to", "found.exit")


def _entries(starts: DataFrame, maps: DataFrame, gap: float) -> dict[int, float]:
    """For each part that continues a key of the one before: the threshold from which it keeps times.

    starts: (__part, x) of parts that follow one in which the key began. maps: (__part, entry, to, exit) of parts that one key fills
    and continues: entering at a threshold up to `entry`, it leaves with `exit` into part `to`; a threshold above all entries
    leaves as it came. Known thresholds and the reach of the maps double in every round.
    """
    known, reach = stored(starts, "entries"), stored(maps, "maps")
    while not reach.isEmpty():
        whither = reach.groupBy("__part").agg(F.max("to").alias("next"))  # one row a part
        leaving = _first_after(known, reach).join(F.broadcast(whither), "__part")
        grown = known.unionByName(leaving.select(F.col("next").alias("__part"), F.coalesce("exit", "x").alias("x")))
        last = reach.groupBy("__part").agg(F.max("to").alias("to"), F.min("entry").alias("first"), F.max("entry").alias("final"))
        # a threshold that has left one map enters the next, and those above the last entry of the one enter the next directly
        through = _first_after(reach.select(F.col("to").alias("__part"), F.col("exit").alias("x"), F.col("__part").alias("own"), "entry"), reach).join(
            F.broadcast(last.select("__part", F.col("to").alias("next"))), "__part"
        ).select(F.col("own").alias("__part"), "entry", F.col("next").alias("to"), F.coalesce("exit", "x").alias("exit"))
        pairs = last.where(F.col("final") < F.col("first") + gap).select(F.col("__part").alias("own"), F.col("to").alias("__part"), (F.col("first") + gap).alias("most"))
        beyond = F.min(F.when(F.col("entry") >= F.col("most"), F.col("entry"))).over(Window.partitionBy("own"))
        direct = reach.join(F.broadcast(pairs), "__part").withColumn("beyond", beyond).where("entry < most or entry = beyond").select(F.col("own").alias("__part"), "entry", "to", "exit")
        known, reach = stored(grown.distinct(), "entries"), stored(through.unionByName(direct), "maps")
    return {r["__part"]: r["x"] for r in known.collect()}


def min_gap(rows: DataFrame, key: str, at: str, gap: float, parts: int | None = None) -> DataFrame:
    """key, kept: of a key's times in order those at least `gap` behind the last one kept; each time counts once, null and NaN ones
    do not count, and null keys are one key.

    Times are range-partitioned, so that a hot key fills many parts. A part that one key fills maps the threshold with which it
    is entered to the one with which it is left; a few doubling rounds compose these maps, and every part then marks its own
    times. What the driver sees is one row a part.
    """
    if not gap > 0:
        raise ValueError("the gap must be positive")
    times = rows.select(F.col(key), F.col(at).cast("double").alias("kept")).where("kept is not null and not isnan(kept)").distinct()
    store = sorted_store(times, [key, "kept"], parts, "times")
    kind, columns = dict(rows.dtypes)[key], [key, "kept", "__part"]
    ends = store.groupBy("__part").agg(F.min_by(F.struct(key), "__at").alias("first"), F.max_by(F.struct(key), "__at").alias("last")).orderBy("__part").collect()
    follows = {b["__part"]: a["__part"] for a, b in zip(ends, ends[1:], strict=False) if _same(a["last"][0], b["first"][0])}
    leaves = {a: b for b, a in follows.items()}
    filled = {e["__part"] for e in ends if _same(e["first"][0], e["last"][0])}
    in_parts = store.repartition("__part").sortWithinPartitions("__at").select(*columns)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _last_keys(batches):
            if part in leaves:
                last = thresholds(t[last_kept(t, gap)], gap)
                maps = part in filled and part in follows
                entries = t[: np.searchsorted(t, t[0] + gap) + 1] if maps else t[:0]
                begins = [] if maps else [last[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (len(entries) + len(begins)), pa.int64()), pa.array([*entries, *[None] * len(begins)], pa.float64()), pa.array([leaves[part]] * (len(entries) + len(begins)), pa.int64()), pa.array([*last[: len(entries)], *begins], pa.float64())],
                    ["__part", "entry", "to", "exit"],
                )

    thresholds_at: dict[int, float] = {}
    if leaves:
        found = stored(in_parts.where(F.col("__part").isin(*leaves)).mapInArrow(summed, "__part long, entry double, to long, exit double"), "summaries")
        thresholds_at = _entries(found.where("entry is null").select(F.col("to").alias("__part"), F.col("exit").alias("x")), found.where("entry is not null"), gap)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, threshold = None, None, -np.inf
        for batch in batches:
            if not batch.num_rows:
                continue
            t, parts_of = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            codes = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            new = np.flatnonzero(np.append(True, (np.diff(codes.indices.to_numpy()) != 0) | (np.diff(parts_of) != 0)))
            ends_at, bound = np.append(new[1:], len(t)), np.full(len(new), -np.inf)
            if parts_of[0] != part:
                bound[0] = thresholds_at.get(int(parts_of[0]), -np.inf)
            elif _same(codes[0].as_py(), name):
                bound[0] = threshold
            for place in np.flatnonzero(np.diff(parts_of[new])) + 1:
                bound[place] = thresholds_at.get(int(parts_of[new[place]]), -np.inf)
            kept = _kept(t, new, ends_at, bound, gap)
            own = kept[kept >= new[-1]]
            part, name = int(parts_of[-1]), codes[len(t) - 1].as_py()
            threshold = float(thresholds(t[own[-1:]], gap)[0]) if len(own) else bound[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], [key, "kept"]).take(pa.array(kept, pa.int64()))

    return in_parts.mapInArrow(mark, f"`{key}` {kind}, kept double")


def _last_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each part the times of its last key."""
    part, name, held = None, None, []
    for batch in batches:
        codes = pc.dictionary_encode(batch.column(0), null_encoding="encode")
        places, parts = codes.indices.to_numpy(), batch.column(2).to_numpy()
        cuts = np.flatnonzero(np.append(True, (np.diff(places) != 0) | (np.diff(parts) != 0)))
        for k, first in enumerate(cuts):
            end = cuts[k + 1] if k + 1 < len(cuts) else len(parts)
            same = part == parts[first] and _same(name, codes[int(first)].as_py())
            if part is not None and part != parts[first]:
                yield part, np.concatenate(held)
            held = [*held, batch.column(1).to_numpy()[first:end]] if same else [batch.column(1).to_numpy()[first:end]]
            part, name = int(parts[first]), codes[int(first)].as_py()
    if part is not None:
        yield part, np.concatenate(held)


def _kept(t: np.ndarray, begin: np.ndarray, end: np.ndarray, bound: np.ndarray, gap: float) -> np.ndarray:
    """Places kept in stretches of sorted times, each from its bound on."""
    found = []
    for k in np.flatnonzero(end - begin > _LONG):
        own = t[begin[k] : end[k]]
        first = int(np.searchsorted(own, bound[k]))
        if first < len(own):
            found.append(begin[k] + marked(own, gap, first))
    short = np.flatnonzero(end - begin <= _LONG)
    at, end, bound = begin[short], end[short], bound[short]
    while len(at):  # one time of each stretch a step
        ok = t[at] >= bound
        found.append(at[ok])
        bound = np.where(ok, thresholds(t[at], gap), bound)
        more = at + 1 < end
        at, end, bound = at[more] + 1, end[more], bound[more]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
