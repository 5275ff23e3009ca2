"""Progress events as a stream: bounded tails per item with carried start times, replays, and incremental appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from judgelake.operators.timeline import STAGES
from judgelake.shipping import shared_dir

TAIL = "item_id long, sequence int, event_id long, module string, started_at double"


def tail_updates(events: DataFrame, keep: int = 100) -> DataFrame:
    """Each trigger's new state of the items it touched: their last `keep` events (item_id, sequence, event_id, module,
    started_at). State per item is bounded by `keep` rows and one start time. events: event_id, item_id, ts, module,
    started_at; event_id orders an item's events, across triggers too; repeats of an event_id already seen count once."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, started, last, held = state.get if state.exists else (0, None, -1, [])
        rows = [tuple(r) for r in held]
        new = pd.concat(list(frames)).drop_duplicates("event_id").sort_values("event_id")
        for event_id, module, value in zip(new["event_id"], new["module"], new["started_at"], strict=True):
            if event_id <= last:
                continue
            last, sequence = int(event_id), sequence + 1
            started = started if pd.isna(value) else float(value)
            rows.append((sequence, last, module, started))
        rows = rows[-keep:]
        state.update((sequence, started, last, rows))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["item_id", "sequence", "event_id", "module", "started_at"])

    kept = "sequence int, started double, last long, rows array<struct<sequence:int,event_id:long,module:string,started_at:double>>"
    return events.groupBy("item_id").applyInPandasWithState(update, TAIL, kept, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by module and event-time window, with a watermark for late ones (an addition to the batch operators)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "module").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def new_only(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen within the watermark: replays add nothing. In a batch no key is seen twice."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


#: What tells two events without a sequence apart.
EVENT_FIELDS = ("updated_at", "module", "event", "judge", "round", "message")
#: Items that share a state: a call of Python costs more than an item's events.
GROUPS = 512
SEEN = "item_id long, key string, updated_at long, module string, message string, started_at double, stage int"


def event_key(sequence: Column, fields: list[Column]) -> Column:
    """The sequence if there is one, else EVENT_FIELDS, where a missing one is empty."""
    return F.when(sequence.isNotNull(), F.concat(F.lit("seq:"), sequence.cast("string"))).otherwise(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)))


def replayed_tails(events: DataFrame, keep: int = 100) -> DataFrame:
    """Batch twin of replay_safe(): item_id, key, updated_at, module, message, started_at, stage of the last `keep` different events
    of an item by (updated_at, key), with the last start time and the highest stage of all its events. Repeats count once."""
    once = events.groupBy("item_id", "key").agg(F.min_by(F.struct("updated_at", "module", "message", "started_at"), F.struct("updated_at", "module", "message")).alias("e")).select("item_id", "key", "e.*")
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("module")).cast("int") - 1
    sums = once.groupBy("item_id").agg(F.max_by("started_at", F.when(F.col("started_at").isNotNull(), F.struct("updated_at", "key"))).alias("started"), F.max(rank).alias("stage"))
    newest = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("updated_at"), F.desc("key")))
    kept = once.withColumn("rn", newest).where(F.col("rn") <= keep).drop("rn", "started_at")
    return kept.join(sums, "item_id").select("item_id", "key", "updated_at", "module", "message", F.col("started").alias("started_at"), "stage")


def replay_safe(events: DataFrame, keep: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """Each trigger's new state of the items it touched, as replayed_tails() would give it for all events so far. events: item_id, key
    (event_key), updated_at, module, message, started_at; one key is one event.

    State of an item: its last `keep` events in order and, beside them, the last start time and the highest stage. An event that is
    kept already or stands before all of a full tail changes nothing, so that replays and late events, however often and in
    whatever order, leave what the events once and in order would. Items share GROUPS states by hash, each two tables in Arrow's
    format, and a batch of events is merged into them at once. With ttl_ms, each item has its own, and items without events for
    so long lose it; such a stream must run on, since a trigger that ends with the input would wait for the time-outs.
    """
    item = ["nobody", "item_id"]

    def merged(kept: pd.DataFrame, sums: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        begun = new[new["started_at"].notna()].sort_values(["updated_at", "key"], kind="stable").drop_duplicates(item, keep="last")
        begun = begun.rename(columns={"updated_at": "at", "key": "by"})[[*item, "at", "by", "started_at"]]
        begun = pd.concat([f for f in (sums[sums["by"].notna()][begun.columns], begun) if len(f)] or [begun]).sort_values(["at", "by"], kind="stable").drop_duplicates(item, keep="last")
        stages = pd.concat([sums[[*item, "stage"]], new[[*item, "stage"]]]).groupby(item, as_index=False)["stage"].max()
        sums = stages.merge(begun, "left", item)
        sums["at"] = sums["at"].fillna(0).astype("int64")
        kept = pd.concat([kept, new[[*item, "updated_at", "key", "module", "message"]]]).drop_duplicates([*item, "key"])
        return kept.sort_values([*item, "updated_at", "key"]).groupby(item, sort=False).tail(keep), sums

    def packed(frame: pd.DataFrame) -> bytes:
        table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def unpacked(data: bytes) -> pd.DataFrame:
        return pa.ipc.open_stream(data).read_all().to_pandas()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = sums = None
        if state.exists:
            kept, sums = map(unpacked, state.get)
        touched = []
        for new in frames:
            if kept is None:
                kept, sums = new.iloc[:0][[*item, "updated_at", "key", "module", "message"]], new.iloc[:0].rename(columns={"updated_at": "at", "key": "by"})[[*item, "stage", "at", "by", "started_at"]]
            kept, sums = merged(kept, sums, new)
            touched.append(new[item].drop_duplicates())
        state.update((packed(kept), packed(sums)))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        out = kept.merge(pd.concat(touched).drop_duplicates(), "inner", item).merge(sums[[*item, "started_at", "stage"]], "left", item)
        yield out.assign(
            item_id=out["item_id"].astype("Int64").mask(out["nobody"]), stage=out["stage"].astype("Int32").mask(out["stage"] < 0),
        )[["item_id", "key", "updated_at", "module", "message", "started_at", "stage"]]

    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.coalesce("module", F.lit(""))).cast("int") - 1
    rows = events.select(
        F.pmod(F.xxhash64("item_id"), F.lit(GROUPS)).alias("group") if ttl_ms is None else F.col("item_id").alias("group"),
        F.col("item_id").isNull().alias("nobody"), F.coalesce("item_id", F.lit(0)).cast("long").alias("item_id"), "key", "updated_at", F.coalesce("module", F.lit("")).alias("module"),
        F.coalesce("message", F.lit("")).alias("message"), "started_at", rank.alias("stage"),
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("group").applyInPandasWithState(update, SEEN, "kept binary, sums binary", "update", timeout)


def latest_states(stream: DataFrame, change: Callable[[DataFrame], DataFrame], schema: str, key: str = "item_id") -> DataFrame:
    """The stream run to its end as a table: of what `change` gives in its triggers, each key's rows of the last trigger. Tables and
    checkpoints are in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/judgelake/stream-{uuid.uuid4().hex}"

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    change(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{base}/out")
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [key, "batch"]).drop("batch")
