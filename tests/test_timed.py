"""The job queue and token streams with timers, against the batch rules."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from ragmill.operators import jobs
from ragmill.streaming import streams, timed

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
JOBS = "queue int, id long, kind string, ts timestamp, step int"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def run(spark, rows, schema, steps, flow):
    with timed.rocks(spark):
        return streams.replayed(spark.createDataFrame(rows, schema), F.col("step"), steps, lambda df: flow(df.drop("step"))).collect()


def by_batch_rules(spark, arrivals, ticks, limit, lease, most):
    """The same moves, by jobs.claim and jobs.reschedule at each tick."""
    table, moves = {}, []
    schema = "id long, status string, attempts int, next_attempt_at timestamp_ntz, locked_until timestamp_ntz, created_at timestamp_ntz"
    naive = lambda s: (T0 + dt.timedelta(seconds=s)).replace(tzinfo=None)
    for now in ticks:
        here = [a for a in arrivals if a[2] == now]
        for i, kind, _ in here:
            if kind == "added":
                table[i] = [i, "PENDING", 0, naive(now), None, naive(now)]
        results = {i: kind for i, kind, _ in here if kind != "added"}
        if results:
            claimed = spark.createDataFrame([tuple(table[i]) for i in results], schema)
            failed = spark.createDataFrame([(i,) for i, k in results.items() if k == "failed"], "id long")
            for r in jobs.reschedule(claimed, failed, str(naive(now)), most=most).collect():
                moves.append((r.id, now, r.status, r.attempts))
                table[r.id][1:5] = [r.status, r.attempts, r.next_attempt_at or table[r.id][3], None]
        state = spark.createDataFrame([tuple(r) for r in table.values()], schema)
        for r in jobs.claim(state, str(naive(now)), limit, f"{lease} seconds").collect():
            moves.append((r.id, now, "PROCESSING", r.attempts))
            table[r.id][1], table[r.id][4] = "PROCESSING", r.locked_until
    return sorted(moves)


ARRIVALS = [(1, "added", 0), (2, "added", 0), (3, "added", 0), (4, "added", 1), (1, "sent", 3), (2, "failed", 3), (3, "failed", 4), (2, "failed", 6), (4, "sent", 20), (3, "sent", 21)]


def test_claims_leases_and_retries_are_those_of_the_batch_rules(spark):
    want = by_batch_rules(spark, ARRIVALS, range(0, 31), 2, 10, 2)
    assert {m[2] for m in want} == {"PROCESSING", "PUBLISHED", "PENDING", "DEAD"} and len(want) > 10
    for split in (lambda s: min(2, s // 4), lambda s: min(2, int(s > 2) + int(s > 5))):
        rows = [(0, i, kind, at(s), split(s)) for i, kind, s in ARRIVALS] + [(7, None, None, at(30), 2), (3, None, None, at(1), 0)]
        got = run(spark, rows, JOBS, 3, lambda df: timed.job_moves(df, limit=2, lease_ms=10_000, most=2))
        assert sorted((r.id, int((r["at"].astimezone(UTC) - T0).total_seconds()), r.status, r.attempts) for r in got) == want
        until = {(r.id, r.status, r.attempts): r["until"] and int((r["until"].astimezone(UTC) - T0).total_seconds()) for r in got}
        assert until[2, "PENDING", 1] == 5 and until[2, "DEAD", 2] is None


class Held:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.maps, self.rows, self.value, self.timers = {}, [], None, set()

    getMapState = getListState = getValueState = lambda self, *_: Part(self)

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, ms):
        self.timers.add(ms)


class Part:
    def __init__(self, held):
        self.map, self.rows, self.held = {}, [], None

    def iterator(self):
        return iter(self.map.items())

    def removeKey(self, k):
        del self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def get(self):
        return self.held if self.held is not None else iter(self.rows)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows, self.held = [], None

    def exists(self):
        return self.held is not None

    def update(self, v):
        self.held = v


class Clock:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = lambda: ms


def test_processing_time_claims_when_rows_arrive_and_when_timers_fire():
    queue, held = timed.JobQueue(limit=9, lease_ms=5000, most=3, replay=False), Held()
    queue.init(held)
    came = lambda ms, *rows: [(r.id, r.at_ms, r.status, r.attempts) for r in queue.handleInputRows((0,), iter([Row(id=i, kind=k, at_ms=77) for i, k in rows]), Clock(ms))]
    fired = lambda ms: [(r.id, r.at_ms, r.status, r.attempts) for r in queue.handleExpiredTimer((0,), Clock(ms), None)]
    assert came(10_000, (1, "added"), (2, "added")) == [(1, 10_000, "PROCESSING", 0), (2, 10_000, "PROCESSING", 0)]
    assert held.timers == {16_000}
    assert came(12_500, (1, "sent"), (5, "sent")) == [(1, 12_500, "PUBLISHED", 0)]
    assert fired(15_999) == [] and fired(16_000) == [(2, 16_000, "PROCESSING", 0)]
    assert came(17_000, (2, "failed")) == [(2, 17_000, "PENDING", 1)] and fired(18_999) == []
    assert fired(19_000) == [(2, 19_000, "PROCESSING", 1)] and 25_000 in held.timers


TOKENS = "request_id long, seq long, type string, payload string, ts timestamp, step int"


def test_token_streams_split_over_runs_equal_the_batch_assembly(spark):
    rows = []
    for r in range(6):
        events = [("token", f"a{r} "), ("sources", "s1"), ("token", "b "), ("sources", "s2"), ("token", "c")] + ([("error", "x"), ("token", "late")] if r % 3 == 2 else []) + [("done", None)]
        rows += [(r, s, kind, load, at(s), (s * 7 + r) % 3) for s, (kind, load) in enumerate(events)]
    rows += [(0, 0, "token", "a0 ", at(1), 2)]  # delivered twice
    open_ = [(9, 0, "token", "never ", at(2), 0), (9, 1, "token", "ends", at(3), 2), (8, 1, "token", "no head", at(1), 0)]
    clock = [(0, None, None, None, at(10), 1), (0, None, None, None, at(500), 2)]
    got = run(spark, rows + open_ + clock, TOKENS, 3, lambda df: timed.replies(df, late="1 hour", idle_ms=60_000))
    batch = jobs.assemble_stream(spark.createDataFrame(rows, TOKENS).dropDuplicates(["request_id", "seq"])).collect()
    assert sorted((r.request_id, r.text, r.sources, r.failed, r.closed) for r in got) == sorted((r.request_id, r.text, r.sources, r.failed, "end") for r in batch)
    # with a watermark that passes, requests that stay silent are closed as they are, and what comes later is ignored
    more = [(8, 0, "token", "too late ", at(510), 3), (9, 2, "token", "!", at(510), 3)]
    got = run(spark, open_ + clock + more, TOKENS, 4, lambda df: timed.replies(df, late="30 seconds", idle_ms=60_000))
    assert sorted((r.request_id, r.text, r.closed) for r in got) == [(8, "no head", "timeout"), (9, "never ends", "timeout")]
