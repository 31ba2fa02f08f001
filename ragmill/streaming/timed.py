"""Keyed state with timers: a job queue with leases and back-off, and token streams that close."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of the queries started inside lies in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Timed(StatefulProcessor):
    """What both share: which clock counts, and one timer for the next thing to do."""

    replay: bool

    def now(self, timers: TimerValues) -> int:
        return timers.getCurrentWatermarkInMs() if self.replay else timers.getCurrentProcessingTimeInMs()

    def wake_at(self, ms: int) -> None:
        if ms not in set(self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


JOB = "status string, attempts int, next_ms long, locked_ms long, created_ms long"
MOVES = "queue int, id long, at_ms long, status string, attempts int, until_ms long"


class JobQueue(_Timed):
    """The jobs of one queue: at each tick of the clock those that are due are claimed, at most `limit`, oldest first.

    A claim holds for `lease_ms`; a job without a result by then is claimed again. A failure makes a job pending again
    after min(longest, 2^min(attempts, 8)) seconds, and dead from `most` attempts. Jobs that are sent or dead leave the
    state. With `replay` the clock is the watermark, and rows wait until it has reached them, so the moves don't depend
    on how rows are dealt to micro-batches; without, it is processing time, and rows count when they arrive.
    """

    def __init__(self, limit: int = 50, lease_ms: int = 300_000, most: int = 10, longest: int = 300, tick_ms: int = 1000, replay: bool = True):
        self.limit, self.lease_ms, self.most, self.longest, self.tick_ms, self.replay = limit, lease_ms, most, longest, tick_ms, replay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "id long", JOB)
        self.inbox = handle.getListState("inbox", "at_ms long, id long, kind string")
        self.ticked = handle.getValueState("ticked", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = self.now(timerValues)
        got = [(r.at_ms if self.replay else now, r.id, r.kind) for r in rows if r.id is not None]
        if not got:
            return  # rows of the clock
        self.inbox.appendList(got)
        if self.replay:
            self.wake_at(max(min(g[0] for g in got), now + 1))
        else:
            yield from self.advance(key[0], now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key[0], self.now(timerValues))

    def advance(self, queue: int, until: int) -> Iterator[Row]:
        """Everything that happens up to a time, in order; what arrives at a tick comes before its claims."""
        jobs = {k[0]: list(v) for k, v in self.jobs.iterator()}
        before = {k: tuple(v) for k, v in jobs.items()}
        arrived = sorted(tuple(r) for r in self.inbox.get())
        later = [r for r in arrived if r[0] > until]
        arrived = arrived[: len(arrived) - len(later)][::-1]
        ticked = self.ticked.get()[0] if self.ticked.exists() else 0
        due_of = lambda j: j[2] if j[0] == "PENDING" else j[3] + 1
        tick_of = lambda ms: max(-(-ms // self.tick_ms) * self.tick_ms, ticked + self.tick_ms)
        heap = [(due_of(j), i) for i, j in jobs.items()]
        heapq.heapify(heap)
        while True:
            while heap and (heap[0][1] not in jobs or due_of(jobs[heap[0][1]]) != heap[0][0]):
                heapq.heappop(heap)  # the job has moved since
            tick = tick_of(heap[0][0]) if heap else None
            if arrived and (tick is None or arrived[-1][0] <= tick):
                at, i, kind = arrived.pop()
                job = jobs.get(i)
                if kind == "added" and job is None:
                    jobs[i] = ["PENDING", 0, at, 0, at]
                elif kind == "sent" and job:
                    yield Row(queue=queue, id=i, at_ms=at, status="PUBLISHED", attempts=job[1], until_ms=None)
                    del jobs[i]
                    continue
                elif kind == "failed" and job:
                    tries = job[1] + 1
                    wait = min(self.longest, 2 ** min(tries, 8)) * 1000
                    dead = tries >= self.most
                    yield Row(queue=queue, id=i, at_ms=at, status="DEAD" if dead else "PENDING", attempts=tries, until_ms=None if dead else at + wait)
                    if dead:
                        del jobs[i]
                        continue
                    jobs[i] = ["PENDING", tries, at + wait, 0, job[4]]
                else:
                    continue
                heapq.heappush(heap, (due_of(jobs[i]), i))
            elif tick is not None and tick <= until:
                due = []
                while heap and heap[0][0] <= tick:
                    ms, i = heapq.heappop(heap)
                    if i in jobs and due_of(jobs[i]) == ms:
                        due.append((jobs[i][4], i, ms))
                due.sort()
                for _, i, _ in due[: self.limit]:
                    jobs[i][0], jobs[i][3] = "PROCESSING", tick + self.lease_ms
                    yield Row(queue=queue, id=i, at_ms=tick, status="PROCESSING", attempts=jobs[i][1], until_ms=jobs[i][3])
                    heapq.heappush(heap, (due_of(jobs[i]), i))
                for _, i, ms in due[self.limit :]:
                    heapq.heappush(heap, (ms, i))
                ticked = tick
            else:
                break
        for i in before.keys() - jobs.keys():
            self.jobs.removeKey((i,))
        for i, j in jobs.items():
            if before.get(i) != tuple(j):
                self.jobs.updateValue((i,), tuple(j))
        self.inbox.put(later) if later else self.inbox.clear()
        self.ticked.update((ticked,))
        ahead = [tick] if tick is not None else []
        if ahead or later:
            self.wake_at(min(ahead + [r[0] for r in later[:1]]))


def job_moves(rows: DataFrame, late: str = "0 seconds", **settings) -> DataFrame:
    """queue, id, at, status, attempts, until: each move of the jobs of a stream (queue int, id long, kind, ts).

    kind is added, sent or failed. Rows without an id only move the clock on. Claims of a queue are made in one task,
    as its order asks for; queues are independent, so their number is how far it spreads. See JobQueue for settings.
    """
    keyed = rows.withWatermark("ts", late).select("queue", "id", "kind", F.unix_millis("ts").alias("at_ms"), "ts")
    clock = F.when(F.col("id").isNull(), -1).otherwise(F.col("queue"))
    job = JobQueue(**settings)
    mode = "eventTime" if job.replay else "processingTime"
    moves = keyed.withColumn("queue", clock.cast("int")).groupBy("queue").transformWithState(job, MOVES, "append", mode)
    return moves.where("queue >= 0").select("queue", "id", F.timestamp_millis("at_ms").alias("at"), "status", "attempts", F.timestamp_millis("until_ms").alias("until"))


REPLIES = "request_id long, text string, sources string, failed boolean, closed string"


class TokenStream(_Timed):
    """The events of one request, in whatever order they arrive, until it ends.

    A request whose sequence numbers are all there from 0 to its error or done is complete. One that stays silent for
    `idle_ms` is closed as it is. What arrives for a request that was closed is ignored for as long again.
    """

    def __init__(self, idle_ms: int = 60_000, replay: bool = True):
        self.idle_ms, self.replay = idle_ms, replay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, type string, payload string")
        self.seen = handle.getValueState("seen", "last_ms long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now, got = self.now(timerValues), list(rows)
        last, closed = self.seen.get() if self.seen.exists() else (0, False)
        last = max([last, *(r.at_ms if self.replay else now for r in got)])
        new = [(r.seq, r.type, r.payload) for r in got if r.seq is not None]
        if not new:
            return  # rows of the clock
        if not closed:
            self.events.appendList(new)
            events = {e[0]: e for e in self.events.get()}
            ends = [s for s, kind, _ in events.values() if kind in ("error", "done")]
            if ends and all(s in events for s in range(min(ends))):
                closed = True
                yield self.reply(key[0], events, "end")
        self.seen.update((last, closed))
        self.wake_at(max(last + self.idle_ms, now + 1))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.seen.exists():
            return
        last, closed = self.seen.get()
        if last + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            return  # something has come since
        if closed:
            self.seen.clear()
        else:
            yield self.reply(key[0], {e[0]: e for e in self.events.get()}, "timeout")
            self.seen.update((last, True))
            self.wake_at(self.now(timerValues) + self.idle_ms)

    def reply(self, request: int, events: dict, why: str) -> Row:
        self.events.clear()
        rows = sorted(events.values())
        stop = next((s for s, kind, _ in rows if kind == "error"), None)
        live = [r for r in rows if stop is None or r[0] < stop]
        sources = [p for _, kind, p in live if kind == "sources"]
        return Row(request_id=request, text="".join(p for _, kind, p in live if kind == "token" and p), sources=sources[-1] if sources else None, failed=stop is not None, closed=why)


def replies(rows: DataFrame, late: str = "0 seconds", **settings) -> DataFrame:
    """request_id, text, sources, failed, closed of a stream (request_id, seq, type, payload, ts): see TokenStream.

    Types are token, sources, error and done. Rows without a seq only move the clock on.
    """
    keyed = rows.withWatermark("ts", late).select("request_id", "seq", "type", "payload", F.unix_millis("ts").alias("at_ms"), "ts")
    clock = F.when(F.col("seq").isNull(), -1).otherwise(F.col("request_id"))
    tokens = TokenStream(**settings)
    mode = "eventTime" if tokens.replay else "processingTime"
    out = keyed.withColumn("request_id", clock.cast("long")).groupBy("request_id").transformWithState(tokens, REPLIES, "append", mode)
    return out.where("request_id >= 0")
