"""Event streams: windows, bursts, sequences, live learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """New Parquet files of a folder as events with a watermark on a proper timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, width: str = "1 hour", ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """start, n per window; batch or stream."""
    return events.groupBy(F.window(ts, width), *(by or [])).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *(by or []), "n")


def bursts(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """start, end, n: events that follow each other within the gap, per key; a change restarts the quiet time."""
    return events.groupBy(F.session_window(ts, gap), *(by or [])).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *(by or []), "n")


def debounced(changes: DataFrame, poll: str = "2 seconds", quiet: str = "3 seconds", vault: str = "vault_id", ts: str = "ts") -> DataFrame:
    """start, fires, polls, added, changed, deleted: the updates that a watcher's polls set off, per vault; batch or stream.

    ``changes`` have a ``kind`` (added, changed, deleted). A poll sees what has
    changed since the one before; each that sees something restarts the quiet
    time, and the update that follows it knows the counts of the last.
    """
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "changed", "deleted")]
    polls = changes.groupBy(vault, F.window(ts, poll)).agg(*counts).withColumn("seen", F.window_time("window"))
    last = F.max_by(F.struct("added", "changed", "deleted"), "seen").alias("last")
    found = polls.groupBy(vault, F.session_window("seen", quiet).alias("s")).agg(F.count(F.lit(1)).alias("polls"), last)
    moment = F.expr("interval 1 microsecond")  # a window's time is its last moment; the poll follows it
    return found.select(vault, (F.col("s.start") + moment).alias("start"), (F.col("s.end") + moment).alias("fires"), "polls", "last.added", "last.changed", "last.deleted")


def spaced(events: DataFrame, keys: list[str], micros: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events of a key at least so many microseconds after the last one that was let through.

    An event after a silence of that length is always let through, so what is
    decided in order are only the events between two silences of a key.
    """
    gap = F.unix_micros(ts)
    rest = [c for c in events.columns if c not in keys]
    runs = events.groupBy(*keys, F.session_window(ts, f"{micros} microseconds")).agg(F.sort_array(F.collect_list(F.struct(gap.alias("__at"), F.col(tie).alias("__tie"), F.struct(*rest).alias("__row")))).alias("e"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.expr("array()").cast(runs.schema["e"].dataType).alias("kept"))

    def step(state: F.Column, x: F.Column) -> F.Column:
        free = state["last"].isNull() | (x["__at"] - state["last"] >= micros)
        return F.struct(F.when(free, x["__at"]).otherwise(state["last"]).alias("last"), F.when(free, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    kept = runs.select(*keys, F.explode(F.aggregate("e", start, step, lambda s: s["kept"])["__row"]).alias("r"))
    return kept.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def spaced_stream(events: DataFrame, keys: list[str], micros: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``spaced`` over a stream with a watermark: the time of the last event let through is the state of its key.

    State goes once the watermark is past what it could still hold back. Events that come out of order are judged
    by the distance to the last one let through, before or after it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns, micro = events.columns, pd.Timedelta(microseconds=1)

    def let_through(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values([ts, tie], kind="stable")
        at = ((rows[ts] - pd.Timestamp(0)) // micro).tolist()
        keep = []
        for x in at:
            keep.append(last is None or abs(x - last) >= micros)
            last = x if keep[-1] and (last is None or x > last) else last
        state.update((last,))
        until = max(last // 1000 + micros // 1000 + 1, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(until)
        yield rows[keep][columns]

    grouped = events.groupBy(*keys)
    return grouped.applyInPandasWithState(let_through, events.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def sequenced(events: DataFrame, vault: str = "vault_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with their number within the vault, from 1."""
    return events.withColumn("sequence", F.row_number().over(W.partitionBy(vault).orderBy(ts, tie)))


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch to ``sink(batch, id)`` until the available data are through."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn_live(stream: DataFrame, store, learn: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """Fold each micro-batch of activations into the stored synapses.

    ``learn(synapses, batch)`` gives the new ones; each batch becomes one
    snapshot of the store, which names it. A batch that is delivered again is
    known by its number and changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        base, state = store.version(), store.load()
        done = state["batches"].filter((F.col("stream") == checkpoint) & (F.col("batch") >= number))
        if batch.isEmpty() or not done.isEmpty():
            return
        named = batch.sparkSession.createDataFrame([(checkpoint, number)], "stream string, batch long")
        others = state["batches"].filter(F.col("stream") != checkpoint)
        store.save({"synapses": learn(state["synapses"], batch), "batches": others.unionByName(named)}, base)

    return deliver(stream, step, checkpoint)
