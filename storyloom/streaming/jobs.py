"""Streaming jobs: new findings, alias links, denial spikes, quotas, silent runs, ledgers, cost guards, open stays.

Stateful jobs keep their state per key and sort each micro-batch by their order; what comes in a later batch counts
as later, but for ``stays``, which sets rows from before its state aside as late.

State ends: with the row that finishes a run, with a timer, or ``ttl`` after a key's last change in the clock's time.
Timers and ttl fire in batches without rows as well, so a query with either needs a trigger that goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from storyloom.operators.checks import run_checks
from storyloom.operators.folds import interval_fold
from storyloom.operators.lineage import cut
from storyloom.sources.graph import Graph

KEY = ["world_id", "check_name", "explanation"]
LEDGER = "world_id long, check_name string, explanation string, severity string, kind string, first boolean, batch long"


def live_findings(ledger: DataFrame) -> DataFrame:
    """The findings that stand: those whose last entry isn't a retraction."""
    last = ledger.groupBy(*KEY).agg(F.max_by(F.struct("kind", "severity"), "batch").alias("l"))
    return last.filter("l.kind = 'found'").select(*KEY, "l.severity")


def stream_new_findings(assertions: DataFrame, graph_of: Callable[[DataFrame], Graph], ledger: str, checkpoint: str, checks: list[str] | None = None) -> StreamingQuery:
    """Recomputes the worlds that a micro-batch touches and appends what is new to the ledger: findings that don't stand in it yet, sealed ones never, and
    retractions of those that stand in it and are found no more.

    Of the named checks, or of all.  ``first`` marks the findings of the first batch in which a world has any.  ``graph_of`` gives the current graph of
    the worlds in a one-column table.  A batch that is run again leaves its own entries out by batch id, so every entry
    is written once.
    """

    spark = assertions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("batch").parquet(ledger)  # so that it can be read

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = cut(batch.select("world_id").distinct())
        found, _ = run_checks(graph_of(touched), checks)
        found = cut(found.filter(~F.col("sealed")).join(touched, "world_id", "left_semi").select(*KEY, "severity").dropDuplicates(KEY))
        before = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("batch") < number)
        standing = live_findings(before).join(touched, "world_id", "left_semi")
        told = before.select("world_id").distinct().withColumn("told", F.lit(True))
        new = found.join(standing.select(*KEY), KEY, "left_anti").join(told, "world_id", "left").select(*KEY, "severity", F.lit("found").alias("kind"), F.col("told").isNull().alias("first"))
        gone = standing.join(found.select(*KEY), KEY, "left_anti").select(*KEY, "severity", F.lit("retracted").alias("kind"), F.lit(False).alias("first"))
        both = new.unionByName(gone).withColumn("batch", F.lit(number).cast("long"))
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger)

    return assertions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alias_links(aliases: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (world, entity, alias) the first time it is seen; state is kept for ``delay`` of event time."""
    return aliases.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["world_id", "entity_id", "alias"])


def usage_windows(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per user and kind in tumbling windows of event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "user_id", "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "kind", "n")


def silent_runs(heartbeats: DataFrame, patience: str = "90 seconds", delay: str = "10 minutes") -> DataFrame:
    """Runs by sessions of heartbeats: a session's end is when the run fell silent."""
    return heartbeats.withWatermark("ts", delay).groupBy(F.session_window("ts", patience).alias("w"), "run_id").agg(F.count("*").alias("beats")).select("run_id", F.col("w.start").alias("began"), F.col("w.end").alias("silent_at"), "beats")


def failed_runs(beats: DataFrame, patience: str = "90 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions of (run_id, ts, finished) that ended without a finishing beat: failed at the session's end."""
    held = beats.withWatermark("ts", delay).groupBy(F.session_window("ts", patience).alias("w"), "run_id").agg(F.max("finished").alias("finished"))
    return held.filter(~F.coalesce("finished", F.lit(False))).select("run_id", F.col("w.end").alias("failed_at"), F.lit("failed").alias("status"))


class Watch(StatefulProcessor):
    """Per run the time of its last beat and a timer ``patience`` after it; a run whose timer fires before a finishing beat failed."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("until", "until long")

    def stop(self) -> None:
        if self.held.exists():
            self.handle.deleteTimer(self.held.get()[0])
        self.held.clear()

    def handleInputRows(self, key, rows, timerValues):
        finished = any(bool(f) for pdf in rows for f in pdf["finished"] if f is not None)
        self.stop()
        if not finished:
            until = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(until)
            self.held.update((until,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs()
        self.held.clear()
        yield pd.DataFrame({"run_id": [key[0]], "failed_at": [at], "status": ["failed"]})

    def close(self) -> None:
        pass


def watched_runs(beats: DataFrame, patience_ms: int = 90_000) -> DataFrame:
    """Beats (run_id, finished) as they come -> (run_id, failed_at in milliseconds, status) of runs from which nothing came for so long, by the clock and without later beats.

    A run that has finished or failed has no state.
    """
    return beats.select("run_id", "finished").groupBy("run_id").transformWithStateInPandas(Watch(patience_ms), "run_id long, failed_at long, status string", "append", "processingTime")


class Ordered(StatefulProcessor):
    """Folds each key's rows in order over one value of state; ``step`` takes the state (or None) and a row, and gives
    the new state (None: there is none any more) and the rows to emit.

    With ``patience`` (milliseconds of event time) a key of which nothing came for so long is closed: ``last`` gives the
    rows to emit from its state, which ends.
    """

    def __init__(self, order: list[str], state: str, columns: list[str], step: Callable[[tuple | None, object], tuple[tuple | None, list[tuple]]], ttl: int | None = None, patience: int | None = None, last: Callable | None = None):
        self.order, self.schema, self.columns, self.step, self.ttl, self.patience, self.last = order, state, columns, step, ttl, patience, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema, self.ttl) if self.ttl else handle.getValueState("held", self.schema)
        self.until = handle.getValueState("until", "until long") if self.patience else None

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        state, out = (tuple(self.held.get()) if self.held.exists() else None), []
        every = pd.concat(list(rows))
        for row in every.sort_values(self.order, na_position="last").itertuples():
            state, emitted = self.step(state, row)
            out += emitted
        if state is not None:
            self.held.update(state)
        else:
            self.held.clear()
        if self.patience:
            if self.until.exists():
                self.handle.deleteTimer(self.until.get()[0])
                self.until.clear()
            if state is not None:
                until = int(every["ts"].max().timestamp() * 1000) + self.patience
                self.handle.registerTimer(until)
                self.until.update((until,))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        out = self.last(key, tuple(self.held.get())) if self.held.exists() else []
        self.held.clear()
        self.until.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, keys: list[str], order: list[str], state: str, schema: str, step: Callable, ttl: int | None = None, patience: int | None = None, last: Callable | None = None) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    mode = "eventTime" if patience else "processingTime" if ttl else "none"
    return rows.groupBy(*keys).transformWithStateInPandas(Ordered(order, state, columns, step, ttl, patience, last), schema, "append", mode)


def run_ledger(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """Run events (run_id, event_id, sec) numbered within their run; readers then take the numbers behind their last.

    With a column ``finished`` the state of a run ends with the row that has it true.
    """
    ends = "finished" in events.columns

    def step(state, r):
        seq = (state[0] if state else 0) + 1
        return (None if ends and r.finished else (seq,)), [(r.run_id, r.event_id, r.sec, seq)]

    return folded(events, ["run_id"], ["sec", "event_id"], "seq long", "run_id long, event_id long, sec long, seq long", step, ttl)


def cost_guard(events: DataFrame, cap: float, ttl: int | None = None) -> DataFrame:
    """Of events (run_id, event_id, sec, cost) the first of each run at which its cost passes the cap, with the total; ``finished`` as in ``run_ledger``."""
    ends = "finished" in events.columns

    def step(state, r):
        before = state[0] if state else 0.0
        total = before + r.cost
        passed = bool(state and state[1])
        return (None if ends and r.finished else (total, passed or total > cap)), [] if passed or total <= cap else [(r.run_id, r.event_id, total)]

    return folded(events, ["run_id"], ["sec", "event_id"], "total double, passed boolean", "run_id long, event_id long, total double", step, ttl)


def sliding_quota(events: DataFrame, limits: dict[str, int], window: int, ttl: int | None = None) -> DataFrame:
    """Each event (user_id, kind, event_id, sec) with the count of its trailing window and whether that is over its
    kind's limit; state holds the times within one window."""

    def step(state, r):
        times = [t for t in (state[0] if state else []) if t > r.sec - window] + [int(r.sec)]
        over = len(times) > limits.get(r.kind, len(times))
        return (times,), [(r.user_id, r.kind, r.event_id, len(times), over)]

    return folded(events, ["user_id", "kind"], ["sec", "event_id"], "times array<long>", "user_id long, kind string, event_id long, used long, denied boolean", step, ttl)


def stays(rows: DataFrame, patience: int | None = None) -> DataFrame:
    """The interval fold of locations as rows come: a stay is emitted when a later move closes it, what is skipped, in
    conflict or anchored at once; the last stay of each subject is its state.  Rows from before the state's position are
    emitted as late; ``settled`` folds their subjects again.

    With ``patience``, and a column ``ts`` with a watermark, a subject of which nothing came for so many milliseconds of
    event time gives its last stay as open, and has no state any more."""

    def step(state, r):
        missing = r.position != r.position
        out = lambda hi, action: (r.world_id, r.subject_id, int(r.assertion_id), int(r.object_id), None if missing else int(r.position), hi, action)
        if missing or not r.starts:
            return state, [out(None if missing else int(r.position) + 1, "anchored")]
        at = (int(r.position), int(r.assertion_id))
        if state is None:
            return (int(r.object_id), *at, *at), []
        place, lo, first, *last = state
        if at < tuple(last):
            return state, [out(None, "late")]
        if place == r.object_id:
            return (place, lo, first, *at), [out(None, "skipped")]
        if lo == at[0]:
            return (place, lo, first, *at), [out(None, "conflict")]
        return (int(r.object_id), *at, *at), [(r.world_id, r.subject_id, first, place, lo, at[0], "closed")]

    schema = "world_id long, subject_id long, assertion_id long, object_id long, lo int, hi int, action string"
    last = lambda key, held: [(*key, held[2], held[0], held[1], None, "open")]
    return folded(rows, ["world_id", "subject_id"], ["position", "assertion_id"], "place long, lo int, first long, last int, last_id long", schema, step, patience=patience, last=last)


def settled(rows: DataFrame, emitted: DataFrame) -> DataFrame:
    """What ``stays`` has emitted, in a batch: subjects with late rows are folded again from all their rows, others stay as they are."""
    emitted = cut(emitted)
    late = emitted.filter("action = 'late'").select("world_id", "subject_id").distinct()
    again = interval_fold(rows.join(late, ["world_id", "subject_id"], "left_semi"))
    return emitted.join(late, ["world_id", "subject_id"], "left_anti").unionByName(again.select(*emitted.columns))


class DenialSpike(StatefulProcessor):
    """One alert whenever ``most`` denials fall within ``window`` seconds; the count then begins anew."""

    def __init__(self, most: int = 20, window: int = 300, ttl: int | None = None):
        self.most, self.window, self.ttl = most, window, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "sec long", self.ttl) if self.ttl else handle.getListState("times", "sec long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = sorted(int(s) for pdf in rows for s in pdf["sec"])
        held = [int(r[0]) for r in self.times.get()] if self.times.exists() else []
        fired = []
        for sec in new:
            held = [s for s in held if s > sec - self.window] + [sec]
            if len(held) >= self.most:
                fired.append(sec)
                held = []
        self.times.put([(s,) for s in held]) if held else self.times.clear()
        if fired:
            yield pd.DataFrame({"key": [key[0]] * len(fired), "sec": fired})

    def close(self) -> None:
        pass


def denial_spikes(denials: DataFrame, most: int = 20, window: int = 300, ttl: int | None = None) -> DataFrame:
    """(key, sec) in order of arrival -> alerts (key, sec); state holds at most ``most`` times a key."""
    return denials.groupBy("key").transformWithStateInPandas(DenialSpike(most, window, ttl), "key long, sec long", "append", "processingTime" if ttl else "none")


def run_to_memory(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a finite stream to its end into a table; for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
